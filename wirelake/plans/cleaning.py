"""Cleaning, ledger, folding, scores and selection over raw_items and trend_items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.functions import sql as Q
from wirelake.functions import text as X
from wirelake.operators import clean as C
from wirelake.operators import pairs as P
from wirelake.session import spread, stage, table


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_items")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.judge(spread(raw(spark, sf_dir)))


def survivors(spark, sf_dir):
    return judged(spark, sf_dir).where("reason is null").withColumn("key", X.dedupe_key(F.col("clean"))).where("key != ''")


def clean_ledger(spark, sf_dir):
    """Discards by reason and source, with what is kept: the counts add up to all items."""
    return judged(spark, sf_dir).groupBy("source", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("items"), F.sum(F.coalesce("duplicate_count", F.lit(1))).cast("bigint").alias("weight"))


def trend_discards(spark, sf_dir):
    """The rules on trend items, with descriptions and ranks."""
    items = spread(table(spark, sf_dir, "trend_items")).withColumn("rank", F.col("metadata")["rank"].try_cast("int"))
    return C.judge(items).select("item_no", "reason")


def discards_by_stage(spark, sf_dir):
    """Discards by stage, most first: the source's thresholds, hashtags, structure, content."""
    reason = F.col("reason")
    stage_ = F.when(reason.rlike("^(?:reddit|hn|github)_"), "source").when(reason == "generic_hashtag", "hashtag").when(reason == "too_short_or_non_ascii", "structure").otherwise("content")
    return judged(spark, sf_dir).where("reason is not null").groupBy(stage_.alias("stage")).agg(F.count("*").alias("items"), F.count_distinct("reason").alias("reasons"))


def ledger_balance(spark, sf_dir):
    """For each run: items in, discarded, folded into others and kept, each counted on its own, and whether they add up."""
    items = judged(spark, sf_dir).withColumn("key", F.when(F.col("reason").isNull(), X.dedupe_key(F.col("clean"))))
    by = items.groupBy("run_id").agg(F.count("*").alias("ingested"), F.count("reason").alias("discarded"))
    kept = items.where("reason is null").groupBy("run_id", "key").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.count("*").alias("clustered"), F.sum(F.col("n") - 1).alias("folded"))
    out = by.join(kept, "run_id", "left").na.fill(0, ["clustered", "folded"])
    return out.withColumn("balanced", F.col("ingested") == F.col("discarded") + F.col("folded") + F.col("clustered"))


def normalized_titles(spark, sf_dir):
    return spread(raw(spark, sf_dir).select("id", "source", "title")).select("id", X.normalize(F.col("title")).alias("title"), X.clean_title(F.col("source"), F.col("title")).alias("clean"))


def dedupe_exact_fold(spark, sf_dir):
    return C.fold_exact(survivors(spark, sf_dir), "key", "id", "raw_score")


def fold_urls(spark, sf_dir):
    """The different urls of each folded group, by their best item: one row each, so that no group is collected."""
    one = survivors(spark, sf_dir).where("url is not null").groupBy("key", "url").agg(F.min(F.struct((-F.coalesce("raw_score", F.lit(0.0))).alias("s"), "id")).alias("best"))
    return one.select("key", "url", F.row_number().over(Window.partitionBy("key").orderBy("best")).cast("bigint").alias("place"))


def near_duplicate_pairs(spark, sf_dir):
    """Different titles that share at least four fifths of their tokens: candidates by rare tokens, decided on all of them."""
    keys = survivors(spark, sf_dir).groupBy("key").agg(F.min("id").alias("id")).select("id", F.array_distinct(F.split("key", " ")).alias("toks"))
    return P.token_pairs(keys, "id", "toks", 1, 0.79999).withColumn("jaccard", F.round(P.jaccard(), 6)).where("jaccard >= 0.8").select("a", "b", "shared", "jaccard")


def kept_flags(spark, sf_dir):
    """The first raw row of every content hash that survives is flagged."""
    live = judged(spark, sf_dir).where("reason is null and content_hash is not null").groupBy("run_id", F.lower("content_hash").alias("hash")).agg(F.min("id").alias("first_id"))
    rows = raw(spark, sf_dir).select("id", "run_id", F.lower("content_hash").alias("hash"))
    return rows.join(live, ["run_id", "hash"], "left").select("id", F.coalesce(F.col("id") == F.col("first_id"), F.lit(False)).alias("survives"))


def content_hashes(spark, sf_dir):
    """sha1 of source, lower-case title and url: what an item is known by."""
    parts = F.concat_ws("|", "source", F.lower(F.trim("title")), F.coalesce("url", F.lit("")))
    return raw(spark, sf_dir).select("id", F.sha1(parts).alias("hash"))


def source_percentile(spark, sf_dir):
    return C.mid_rank(raw(spark, sf_dir).select("id", "source", "raw_score"), "source", "raw_score").select("id", F.round("pct", 6).alias("pct"))


def heuristic_scores(spark, sf_dir):
    """Scores of folded items: rank within their source, words that other sources share, sources of their copies, comments."""
    items = stage(survivors(spark, sf_dir).select("id", "key", "source", "clean", "raw_score", "comment_count", "url"), "survivors")
    from_ = items.groupBy("key").agg(F.collect_set("source").alias("sources"))  # one entry a source
    best = C.fold_exact(items, "key", "id", "raw_score").select(F.col("best_id").alias("id"), "key")
    one = items.join(best, ["id", "key"]).join(from_, "key").select("id", "source", "sources", F.col("clean").alias("title"), "raw_score", "comment_count")
    scored = C.corroboration(C.mid_rank(one, "source", "raw_score"))
    score = C.heuristic_score(F.col("pct"), F.col("source"), F.col("others"), F.size("sources"), F.col("comment_count"))
    return scored.select("id", F.col("others").cast("bigint").alias("others"), F.size("sources").cast("bigint").alias("sources"), F.round(score, 4).alias("score"))


def token_document_frequency(spark, sf_dir):
    tok = raw(spark, sf_dir).select("source", F.explode(X.significant_tokens(F.col("title"))).alias("token"))
    return tok.groupBy("token").agg(F.count("*").alias("df"), F.count_distinct("source").alias("sources"))


def frequency_caps(spark, sf_dir):
    """Document frequencies up to which a token is rare, by use: each the larger of a count and a share of all items."""
    n = raw(spark, sf_dir).agg(F.count("*").alias("n"))
    caps = {"rare": (4, 0.06), "nameless": (3, 0.01), "name": (4, 0.02), "distinctive": (3, 0.08), "candidate": (6, 0.1)}
    rows = F.array(*[F.struct(F.lit(k).alias("use"), F.greatest(F.lit(a).cast("bigint"), F.floor(F.col("n") * F.lit(b))).alias("cap")) for k, (a, b) in caps.items()])
    return n.select(F.inline(rows))


def name_words(spark, sf_dir):
    """Words that are names: written with a capital inside a sentence more than twice as often as without."""
    t = table(spark, sf_dir, "cleaned_items").select(F.concat_ws(". ", "title", F.coalesce("description", F.lit(""))).alias("t"))
    w = t.select(F.explode(F.regexp_extract_all("t", F.lit(r"[a-z,;] ([A-Za-z][A-Za-z']*)"), F.lit(1))).alias("w"))
    by = w.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w").rlike("^[A-Z]")).alias("capital"), F.count_if(F.col("w").rlike("^[a-z]")).alias("lower"))
    return by.where("capital > 2 * lower and length(word) >= 3")


def fair_floor_selection(spark, sf_dir):
    """Forty items a run: floors of 6 a source, 3 a feed of sources made of feeds, then by score."""
    many = F.col("source").isin("news_rss", "youtube", "google_news")
    items = raw(spark, sf_dir).where("heuristic_score is not null").select("id", "run_id", F.when(many, F.coalesce("feed", "source")).otherwise(F.col("source")).alias("grp"), F.when(many, 3).otherwise(6).alias("least"), "heuristic_score")
    return C.fair_floors(items, "run_id", "grp", "heuristic_score", "id", F.col("least"), 40).select("run_id", "id", "by_floor", F.col("place").cast("bigint").alias("place"))


def round_robin_interleave(spark, sf_dir):
    items = raw(spark, sf_dir).where("feed is not null").select("id", "run_id", "feed")
    return C.interleave(items, "run_id", "feed", "id", 60).select("run_id", "id", F.col("round").cast("bigint").alias("round"), F.col("turn").cast("bigint").alias("turn"))


def category_vote(spark, sf_dir):
    t = F.concat_ws(" ", "title", "description")
    items = table(spark, sf_dir, "trend_items").select("item_no", "category_hint", X.category_of(t).alias("voted"))
    return items.select("item_no", "voted", F.coalesce(F.col("voted") == F.col("category_hint"), F.lit(False)).alias("agrees"))


def headline_flags(spark, sf_dir):
    t = F.col("clean")
    caps = F.size(F.regexp_extract_all(t, F.lit(r"[A-Z][A-Za-z]+"), F.lit(0)))
    return judged(spark, sf_dir).select(
        "id", X.is_roundup(t).alias("roundup"), (F.size(X.significant_tokens(t)) < 3).alias("generic"), caps.cast("bigint").alias("capitalised"), F.size(X.numbers(t)).cast("bigint").alias("numbers")
    )


def hashtag_words(spark, sf_dir):
    return raw(spark, sf_dir).where(F.col("title").startswith("#")).select("id", X.split_hashtag(F.col("title")).alias("words"))


def parsed_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "trend_items").select("item_no", F.col("metadata")["views"].alias("views"), F.col("metadata")["rank"].alias("rank"))
    return rows.where("views is not null or rank is not null").select("item_no", X.parse_count(F.col("views")).alias("views"), X.parse_count(F.col("rank")).alias("rank"))


def url_groups(spark, sf_dir):
    rows = raw(spark, sf_dir).where("url is not null").select(X.canonical_url(F.col("url")).alias("page"), X.host(F.col("url")).alias("host"), "id", "url")
    return rows.groupBy("page").agg(F.min("host").alias("host"), F.count("*").alias("items"), F.count_distinct("url").alias("variants"), F.min("id").alias("first_id"))


def url_checks(spark, sf_dir):
    """Host, registrable domain, and whether a url may be shown, of every item with one."""
    u = F.col("url")
    return raw(spark, sf_dir).where("url is not null").select("id", X.host(u).alias("host"), X.registrable(X.host(u)).alias("domain"), X.public_url(u).alias("public"))


def late_arrivals(spark, sf_dir):
    """Rows captured after their run had ended by more than the allowed skew, by run."""
    runs = table(spark, sf_dir, "runs").select("run_id", "finished_at")
    late = raw(spark, sf_dir).select("run_id", "captured_at").join(runs, "run_id")
    return late.groupBy("run_id").agg(F.count("*").alias("items"), F.coalesce(F.sum((F.col("captured_at") > F.col("finished_at") + 900).cast("bigint")), F.lit(0)).alias("late"))


def entity_counts(spark, sf_dir):
    """Capitalised phrases of a run's titles and how many titles name them: the five most named of every run."""
    names = raw(spark, sf_dir).select("run_id", "id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))).alias("entity"))
    n = names.groupBy("run_id", "entity").agg(F.count("*").alias("titles"), F.min("id").alias("first_id"))
    rn = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("titles"), F.asc("first_id"), F.asc("entity")))
    return n.withColumn("rn", rn).where("rn <= 5").select("run_id", "entity", "titles", "first_id")


def feed_caps(spark, sf_dir):
    """Items a feed may bring into a run: the larger of its floor and its share of the total cap."""
    per = raw(spark, sf_dir).where("feed is not null").groupBy("run_id", "source").agg(F.count_distinct("feed").alias("feeds"), F.count("*").alias("items"))
    return per.select("run_id", "source", "feeds", F.least(F.lit(400).cast("bigint"), F.greatest(F.lit(60).cast("bigint"), F.lit(3) * F.col("feeds"))).alias("cap"), "items")


QUERIES = {f.__name__: f for f in (clean_ledger, trend_discards, discards_by_stage, ledger_balance, normalized_titles, dedupe_exact_fold, fold_urls, near_duplicate_pairs, kept_flags, content_hashes, source_percentile, heuristic_scores, token_document_frequency, frequency_caps, name_words, fair_floor_selection, round_robin_interleave, category_vote, headline_flags, hashtag_words, parsed_counts, url_groups, url_checks, late_arrivals, entity_counts, feed_caps)}


def judged_sql(rows: str) -> str:
    """Common tables ending in ``j``: the columns of ``rows`` (with description, subreddit and rnk) with clean and reason."""
    bare = f"replace(regexp_replace(lower({Q.normalize('title')}), '^#+', ''), ' ', '')"
    social = f"source in ({Q.listed(V.SOCIAL_SOURCES)})"
    m = lambda e, p: f"regexp_matches({e}, {Q.q(p)})"
    return f"""j0 as materialized (select *, {Q.clean_title('source', 'title')} clean, {bare} bare from ({rows})),
  j as materialized (select * exclude (bare), case
    when source = 'reddit' and lower(subreddit) in ({Q.listed(V.LOW_SIGNAL_SUBREDDITS)}) then 'reddit_low_signal_subreddit'
    when source = 'reddit' and (coalesce(raw_score, 0) < 20 or coalesce(comment_count, 0) < 5) and not coalesce(rnk <= 10, false) then 'reddit_low_engagement'
    when source = 'hackernews' and coalesce(raw_score, 0) < 10 then 'hn_low_points'
    when source = 'github' and coalesce(raw_score, 0) < 20 then 'github_low_stars'
    when source in ({Q.listed(V.TAG_SOURCES)}) and (bare in ({Q.listed(V.GENERIC_HASHTAGS)}) or {m('bare', V.GENERIC_HASHTAG)}) then 'generic_hashtag'
    when length(regexp_replace(clean, '[^A-Za-z0-9]', '', 'g')) < 3 or regexp_matches(regexp_replace(clean, '[^A-Za-z0-9]', '', 'g'), '^[0-9]+$') then 'too_short_or_non_ascii'
    when source in ({Q.listed(V.ANECDOTE_SOURCES)}) and {m('clean', V.ANECDOTE)} then 'personal_anecdote'
    when {social} and {m('clean', V.MEME_PHOTO)} then 'meme_or_photo'
    when {social} and {m('clean', V.PET)} then 'pet_post'
    when source not in ('arxiv', 'github') and {m('clean', V.BOX_SCORE)} then 'box_score_or_betting'
    when {m("concat_ws(' ', clean, substr(coalesce(description, ''), 1, 300))", V.PROMOTION)} then 'promotional'
    when source = 'youtube' and {m('title', V.VIDEO_CLIP)} then 'video_clip'
    when {social} and len({Q.significant_tokens('clean')}) = 0 and not regexp_matches(clean, '[A-Z]') then 'no_signal_tokens' end reason from j0)"""


_J = judged_sql("select *, null::varchar description, null::varchar subreddit, null::int rnk from raw_items")
_S = f"{_J}, s as materialized (select *, {Q.dedupe_key('clean')} as key from j where reason is null and {Q.dedupe_key('clean')} != '')"
_PCT = """case when n <= 1 then 0.75 else (below + 0.5 * eq) / n end pct from (
  select *, count(*) over (partition by source) n, count(*) over (partition by source, coalesce(raw_score, 0)) eq,
    rank() over (partition by source order by coalesce(raw_score, 0)) - 1 below from"""
_BEST = "arg_max(id, {'s': coalesce(raw_score, 0.0), 'i': -id})"

SQL = {
    "clean_ledger": f"with {_J} select source, coalesce(reason, 'kept') reason, count(*) items, sum(coalesce(duplicate_count, 1))::bigint weight from j group by all",
    "trend_discards": f"with {judged_sql('''select *, null::varchar subreddit, try_cast(metadata['rank'] as int) rnk from trend_items''')} select item_no, reason from j",
    "discards_by_stage": f"with {_J} select case when regexp_matches(reason, '^(?:reddit|hn|github)_') then 'source' when reason = 'generic_hashtag' then 'hashtag' when reason = 'too_short_or_non_ascii' then 'structure' else 'content' end stage, count(*) items, count(distinct reason) reasons from j where reason is not null group by 1",
    "ledger_balance": f"with {_J}, k as (select run_id, reason, case when reason is null then {Q.dedupe_key('clean')} end as key from j) select run_id, count(*) ingested, count(reason) discarded, count(distinct key) clustered, count(*) - count(reason) - count(distinct key) folded, true balanced from k group by run_id",
    "normalized_titles": f"with {_J} select id, {Q.normalize('title')} title, clean from j",
    "dedupe_exact_fold": f"with {_S} select key, {_BEST} best_id, min(id) first_id, count(*) copies, count(distinct source) sources, count(distinct url) urls from s group by key",
    "fold_urls": f"with {_S}, u as (select key, url, -coalesce(raw_score, 0.0) m, id from s where url is not null qualify row_number() over (partition by key, url order by -coalesce(raw_score, 0.0), id) = 1) select key, url, row_number() over (partition by key order by m, id)::bigint place from u",
    "near_duplicate_pairs": f"with {_S}, k as (select min(id) id, list_distinct(string_split(key, ' ')) t from s group by key), x as (select id, len(t) n, unnest(t) tok from k), p as (select a.id a, b.id b, count(*) shared, any_value(a.n) na, any_value(b.n) nb from x a join x b on a.tok = b.tok and a.id < b.id group by all) select a, b, shared, round(shared / (na + nb - shared), 6) jaccard from p where round(shared / (na + nb - shared), 6) >= 0.8",
    "kept_flags": f"with {_J}, h as (select id, run_id, lower(content_hash) h, reason from j), f as (select run_id, h, min(id) first_id from h where reason is null and h is not null group by all) select h.id, coalesce(h.id = f.first_id, false) survives from h left join f using (run_id, h)",
    "content_hashes": "select id, sha1(concat_ws('|', source, lower(trim(title)), coalesce(url, ''))) hash from raw_items",
    "source_percentile": f"select id, round(pct, 6) pct from (select id, {_PCT} raw_items))",
    "heuristic_scores": f"""with {_S}, g as (select key, list_distinct(list(source)) sources, {_BEST} id from s group by key), o1 as materialized (select s.id, s.source, g.sources, s.clean, s.raw_score, s.comment_count from g join s on g.id = s.id and g.key = s.key),
  p as (select id, {_PCT} o1)), t as materialized (select id, source, sources, unnest({Q.significant_tokens('clean')}) tok from o1),
  f as (select tok, list_distinct(flatten(list(sources))) srcs from t group by tok having count(*) <= (select greatest(3, floor(count(*) * 0.08)) from o1)),
  o as (select id, count(distinct other) n from (select t.id, t.source, unnest(srcs) other from t join f using (tok)) where other != source group by id)
  select o1.id, coalesce(o.n, 0)::bigint others, len(o1.sources)::bigint sources, round(greatest(0.0::double, least(1.0::double, 0.20::double + 0.45::double * p.pct::double * coalesce(map_extract_value(map {{{', '.join(f"'{k}': {v}::double" for k, v in V.SOURCE_WEIGHT.items())}}}, o1.source), 0.6::double)
    + least(3, coalesce(o.n, 0)) * 0.10::double + least(0.15::double, 0.05::double * (len(o1.sources) - 1)) + case when coalesce(comment_count, 0) > 0 then least(0.10::double, log10(1 + comment_count) / 30) else 0.0::double end)), 4) score
  from o1 join p using (id) left join o using (id)""",
    "token_document_frequency": f"select tok token, count(*) df, count(distinct source) sources from (select source, unnest({Q.significant_tokens('title')}) tok from raw_items) group by tok",
    "frequency_caps": "select use, greatest(a, floor((select count(*) from raw_items) * b))::bigint cap from (values ('rare', 4, 0.06::double), ('nameless', 3, 0.01::double), ('name', 4, 0.02::double), ('distinctive', 3, 0.08::double), ('candidate', 6, 0.1::double)) v(use, a, b)",
    "name_words": "with w as (select unnest(regexp_extract_all(concat_ws('. ', title, coalesce(description, '')), '[a-z,;] ([A-Za-z][A-Za-z'']*)', 1)) w from cleaned_items) select lower(w) word, count(*) filter (regexp_matches(w, '^[A-Z]')) capital, count(*) filter (regexp_matches(w, '^[a-z]')) \"lower\" from w group by 1 having count(*) filter (regexp_matches(w, '^[A-Z]')) > 2 * count(*) filter (regexp_matches(w, '^[a-z]')) and length(lower(w)) >= 3",
    "fair_floor_selection": """with a as (select id, run_id, case when source in ('news_rss', 'youtube', 'google_news') then coalesce(feed, source) else source end g, case when source in ('news_rss', 'youtube', 'google_news') then 3 else 6 end least_, heuristic_score s from raw_items where heuristic_score is not null),
  b as (select *, row_number() over (partition by run_id, g order by s desc, id) rn, max(s) over (partition by run_id, g) top from a),
  c as (select id, row_number() over (partition by run_id order by rn, top desc, g, id) turn from b where rn <= least_),
  d as (select b.*, coalesce(c.turn <= 30, false) by_floor from b left join c using (id)),
  e as (select *, row_number() over (partition by run_id order by by_floor desc, s desc, id) place from d)
  select run_id, id, by_floor, place from e where place <= 40""",
    "round_robin_interleave": "with a as (select id, run_id, feed, row_number() over (partition by run_id, feed order by id) round from raw_items where feed is not null), b as (select *, row_number() over (partition by run_id order by round, feed) turn from a) select run_id, id, round, turn from b where turn <= 60",
    "category_vote": f"select item_no, voted, coalesce(voted = category_hint, false) agrees from (select item_no, category_hint, {Q.category_of('''concat_ws(' ', title, description)''')} voted from trend_items)",
    "headline_flags": f"with {_J} select id, {Q.is_roundup('clean')} roundup, len({Q.significant_tokens('clean')}) < 3 generic, len(regexp_extract_all(clean, '[A-Z][A-Za-z]+'))::bigint capitalised, len({Q.numbers('clean')})::bigint numbers from j",
    "hashtag_words": f"select id, {Q.split_hashtag('title')} words from raw_items where starts_with(title, '#')",
    "parsed_counts": f"select item_no, {Q.parse_count('''metadata['views']''')} views, {Q.parse_count('''metadata['rank']''')} rank from trend_items where metadata['views'] is not null or metadata['rank'] is not null",
    "url_groups": f"select page, min(host) host, count(*) items, count(distinct url) variants, min(id) first_id from (select id, url, {Q.host('url')} host, {Q.canonical_url('url')} page from raw_items where url is not null) group by page",
    "url_checks": f"select id, {Q.host('url')} host, {Q.registrable(Q.host('url'))} \"domain\", {Q.public_url('url')} public from raw_items where url is not null",
    "late_arrivals": "select run_id, count(*) items, coalesce(sum((captured_at > finished_at + 900)::bigint), 0)::bigint late from raw_items join runs using (run_id) group by run_id",
    "entity_counts": "with e as (select run_id, id, unnest(list_distinct(regexp_extract_all(title, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'))) entity from raw_items), n as (select run_id, entity, count(*) titles, min(id) first_id from e group by all), r as (select *, row_number() over (partition by run_id order by titles desc, first_id, entity) rn from n) select run_id, entity, titles, first_id from r where rn <= 5",
    "feed_caps": "select run_id, source, count(distinct feed) feeds, least(400, greatest(60, 3 * count(distinct feed)))::bigint cap, count(*) items from raw_items where feed is not null group by run_id, source",
}
