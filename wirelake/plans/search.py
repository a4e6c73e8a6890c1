"""Archive search, topics, headline recovery, lists of sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirelake.functions import sql as Q
from wirelake.functions import text as X
from wirelake.operators import pairs as P
from wirelake.operators import search as S
from wirelake.session import spread, stage, table

QUERY_SET = ("council", "wins contract", '"digital harbour"', "réacteur", "proj minist", "the")
TOPICS = ["harbour", "stadium", "merger", "peace treaty", "Réacteur", "shares fall"]


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "cleaned_items").select("item_id", "title", "description", "context", "item_time", "heuristic_score")).select("item_id", "title", F.concat_ws(" ", "description", "context").alias("body"), "item_time", (F.col("heuristic_score") >= 0.6).alias("top"))


def archive_search(spark, sf_dir):
    """What a set of queries finds, best first; newer items win ties."""
    docs, out = stage(_docs(spark, sf_dir), "docs"), None
    for q in QUERY_SET:
        hits = S.search(docs, q, "title", "body", F.col("top")).orderBy(F.desc("score"), F.desc("item_time"), "item_id").limit(50).select(F.lit(q).alias("query"), "item_id", "score")
        out = hits if out is None else out.unionByName(hits)
    return out


def search_months(spark, sf_dir):
    """Of the six newest months, how many items one query finds: older ones are not read when the archive is stored by month."""
    docs = _docs(spark, sf_dir).withColumn("month", F.date_format("item_time", "yyyy-MM"))
    months = docs.select("month").where("month is not null").distinct().orderBy(F.desc("month")).limit(6)
    return S.search(docs.join(F.broadcast(months), "month"), "the", "title", "body").groupBy("month").agg(F.count("*").alias("items"))


def topic_matches(spark, sf_dir):
    return S.topics(table(spark, sf_dir, "cleaned_items").withColumn("text", F.concat_ws(" ", "title", "description")), "item_id", "text", TOPICS)


def followed_and_muted(spark, sf_dir):
    """Items of followed topics, without those of a muted one."""
    m = topic_matches(spark, sf_dir)
    muted = m.where(F.col("topic") == TOPICS[-1]).select("item_id")
    return m.where(F.col("topic").isin(TOPICS[:3])).select("item_id").distinct().join(muted, "item_id", "left_anti")


def category_filter(spark, sf_dir):
    """Items of one category with a text in their words."""
    text = F.lower(F.concat_ws(" ", "title", "description"))
    return table(spark, sf_dir, "cleaned_items").where((F.col("inferred_category") == "Tech") & text.contains("digital")).select("item_id", "title")


def recovered_headlines(spark, sf_dir):
    """For each trend item the headline of a cleaned item that it is a form of: the same folded text, else three shared tokens or
    more, three fifths of both, and two more than the next best."""
    a = table(spark, sf_dir, "trend_items").select((F.col("item_no") * 2).alias("k"), X.fold(F.col("title")).alias("f"))
    b = table(spark, sf_dir, "cleaned_items").select((F.col("item_id") * 2 + 1).alias("k"), X.fold(F.col("title")).alias("f"))
    both = a.unionByName(b).where("f != ''").select("k", F.array_distinct(F.split("f", " ")).alias("toks"))
    # two sides of one table, so that pairs inside a side are few: they are dropped by parity
    p = P.token_pairs(both, "k", "toks", 3, 0.59999).where("a % 2 != b % 2")
    q = p.select(F.floor(F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")) / 2).alias("item_no"), F.floor(F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")) / 2).alias("item_id"), "shared")
    w = Window.partitionBy("item_no").orderBy(F.desc("shared"), "item_id")
    top = q.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("shared").over(w)).where("n = 1 and (next is null or shared - next >= 2)")
    exact = a.select(F.floor(F.col("k") / 2).alias("item_no"), "f").where("f != ''").join(b.where("f != ''").groupBy("f").agg(F.min(F.floor(F.col("k") / 2)).alias("item_id")), "f").select("item_no", "item_id", F.lit("exact").alias("how"))
    return exact.unionByName(top.select("item_no", "item_id", F.lit("wording").alias("how")).join(exact.select("item_no"), "item_no", "left_anti"))


def public_sources(spark, sf_dir):
    """The enabled feeds of each channel by name, as one line."""
    f = table(spark, sf_dir, "feeds").where("enabled").groupBy("channel", "publisher").agg(F.count("*").alias("n"))
    return f.groupBy("channel").agg(F.sum("n").alias("feeds"), F.array_join(F.array_sort(F.collect_list("publisher")), "; ").alias("publishers"))  # a dimension table


def run_overview(spark, sf_dir):
    """A sentence on each run, from its counts."""
    raw = table(spark, sf_dir, "raw_items").groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"), F.count_if(F.col("kept") == 1).alias("k"))
    return raw.select("run_id", F.format_string("%d reports from %d sources, %d kept.", "n", "s", "k").alias("text"))


def removed_stories(spark, sf_dir):
    """Events most of whose reports a withdrawn event has, or that have most of its reports: the category-less ones count as withdrawn."""
    ev = table(spark, sf_dir, "registry_events").select("event_id", F.col("category").isNull().alias("gone"), F.array_distinct("reports").alias("r"))
    r = ev.select("event_id", "gone", F.size("r").alias("n"), F.explode("r").alias("report"))
    j = r.where("not gone").alias("x").join(r.where("gone").alias("y"), "report")
    by = j.groupBy(F.col("x.event_id").alias("event_id"), F.col("y.event_id").alias("other"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count("*").alias("shared"))
    return by.where("shared > 0.5 * n or shared > 0.5 * m").groupBy("event_id").agg(F.count("*").alias("withdrawn")).unionByName(ev.where("gone").select("event_id", F.lit(0).cast("bigint").alias("withdrawn")))


QUERIES = {f.__name__: f for f in (archive_search, search_months, topic_matches, followed_and_muted, category_filter, recovered_headlines, public_sources, run_overview, removed_stories)}

_DOCS = f"d as (select item_id, item_time, heuristic_score >= 0.6 top, ' ' || {Q.fold('title')} h, ' ' || {Q.fold('''concat_ws(' ', description, context)''')} b from cleaned_items)"


def _found(q: str, top: bool = True) -> tuple[str, str]:
    terms = [Q.q(" " + t) for t in S.parse_query(q)]
    where = " and ".join(f"(contains(h, {t}) or contains(b, {t}))" for t in terms)
    return where, ("case when coalesce(top, false) then 0.5 else 0.0 end + " if top else "") + " + ".join(f"case when contains(h, {t}) then 3.0 else 1.0 end" for t in terms)


_TEXT = "' ' || " + Q.fold("concat_ws(' ', title, description)") + " || ' '"
_TOPIC = f"t as (select item_id, unnest(list_filter([{', '.join(f'case when contains({_TEXT}, {Q.q(f''' {S.parse_query(chr(34) + w + chr(34))[0]} ''')}) then {Q.q(w)} end' for w in TOPICS)}], lambda x: x is not null)) topic from cleaned_items)"
SQL = {
    "archive_search": f"with {_DOCS} " + " union all ".join(f"(select {Q.q(q)} query, item_id, ({_found(q)[1]})::double score from d where {_found(q)[0]} order by score desc, item_time desc nulls last, item_id limit 50)" for q in QUERY_SET),
    "search_months": f"with {_DOCS}, m as (select *, strftime(item_time, '%Y-%m') \"month\" from d), n as (select distinct \"month\" from m where \"month\" is not null order by 1 desc limit 6) select \"month\", count(*) items from m where \"month\" in (from n) and {_found('the')[0]} group by 1",
    "topic_matches": f"with {_TOPIC} select * from t",
    "followed_and_muted": f"with {_TOPIC} select distinct item_id from t where topic in ({Q.listed(TOPICS[:3])}) and item_id not in (select item_id from t where topic = {Q.q(TOPICS[-1])})",
    "category_filter": "select item_id, title from cleaned_items where inferred_category = 'Tech' and contains(lower(concat_ws(' ', title, description)), 'digital')",
    "recovered_headlines": f"with a as (select item_no, {Q.fold('title')} f from trend_items), b as (select item_id, {Q.fold('title')} f from cleaned_items), x as (select a.item_no, min(item_id) item_id from a join b using (f) where f != '' group by 1), ta as (select item_no, unnest(list_distinct(string_split(f, ' '))) t, len(list_distinct(string_split(f, ' '))) n from a where f != ''), tb as (select item_id, unnest(list_distinct(string_split(f, ' '))) t, len(list_distinct(string_split(f, ' '))) n from b where f != ''), p as (select item_no, item_id, count(*) s, any_value(ta.n) na, any_value(tb.n) nb from ta join tb using (t) group by all), w as (select *, row_number() over (partition by item_no order by s desc, item_id) n, lead(s) over (partition by item_no order by s desc, item_id) nx from p where s >= 3 and s >= 0.59999 * greatest(na, nb)) select item_no, item_id, 'exact' how from x union all select item_no, item_id, 'wording' from w where n = 1 and (nx is null or s - nx >= 2) and item_no not in (select item_no from x)",
    "public_sources": "with f as (select channel, publisher, count(*) n from feeds where enabled group by all) select channel, sum(n)::bigint feeds, string_agg(publisher, '; ' order by publisher) publishers from f group by channel",
    "run_overview": "select run_id, count(*) || ' reports from ' || count(distinct source) || ' sources, ' || count(*) filter (kept = 1) || ' kept.' text from raw_items group by run_id",
    "removed_stories": "with e as (select event_id, category is null gone, list_distinct(reports) r from registry_events), r as (select event_id, gone, len(r) n, unnest(r) report from e), j as (select x.event_id, y.event_id other, any_value(x.n) n, any_value(y.n) m, count(*) s from r x join r y using (report) where not x.gone and y.gone group by x.event_id, y.event_id) select event_id, count(*) withdrawn from j where s > 0.5 * n or s > 0.5 * m group by event_id union all select event_id, 0 from e where gone",
}
