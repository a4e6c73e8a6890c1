"""Candidate pairs, pair decisions, vector search, pair scores, groups and registry matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.functions import sql as Q
from wirelake.functions import text as X
from wirelake.operators import identity as I
from wirelake.operators import nearby as N
from wirelake.operators import pairs as P
from wirelake.operators.graph import components
from wirelake.session import spread, stage, table


def _titles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "cleaned_items").withColumn("toks", X.significant_tokens(F.col("title")))


def lexical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items about the same thing: three shared words and a quarter of all words, whatever the words' frequency.

    One row an item with its class (the smallest item of the same words) and the number of other classes that it is linked with,
    so copies and popular wordings don't multiply rows.
    """
    items = _titles(spark, sf_dir).select("item_id", F.array_sort("toks").alias("toks"))
    items = stage(items.withColumn("k", F.xxhash64("toks")), "token_sets")
    classes = items.groupBy("k", "toks").agg(F.min("item_id").alias("class_id"))
    links = P.token_pairs(classes.where(F.size("toks") > 0).select("class_id", "toks"), "class_id", "toks", 3, 0.24999).where(F.round(P.jaccard(), 6) >= 0.25)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return items.join(classes, ["k", "toks"]).join(ends, "class_id", "left").select("item_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _reports(spark, sf_dir) -> DataFrame:
    """What pairs of items are decided by."""
    items = table(spark, sf_dir, "cleaned_items").select("item_id", "title", F.unix_timestamp("item_time").alias("time"), F.to_date("item_time").alias("day"))
    f = stage(I.features(spread(items)).drop("title"), "features")
    tok = f.select(F.explode("toks").alias("token"))
    cap = f.agg(F.greatest(F.lit(4).cast("bigint"), F.floor(F.count("*") * F.lit(0.06))).alias("cap"))
    rare = tok.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(cap)).where("df <= cap").select("token")
    mine = f.select("item_id", F.explode("toks").alias("token")).join(rare, "token").groupBy("item_id").agg(F.collect_set("token").alias("rare"))  # tokens of one title
    return stage(f.join(mine, "item_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>"))).where(F.size("toks") >= 2), "reports")


def _near(reports: DataFrame, give, schema: str) -> DataFrame:
    """What ``give`` makes of the decided pairs of items of one story each, not far apart: all pairs but those of ``_excluded``."""
    return N.near_pairs(N.coded(reports.where("not roundup"), "item_id"), I.FAR_HOURS * 3600, give, schema)


def _excluded(reports: DataFrame) -> DataFrame:
    """(item_id, roundup, roundups, single): the pairs of each item that share two words, with a roundup on a side and without one."""
    n = P.partner_counts(reports, "item_id", "toks", "roundup")
    return n.select("item_id", "roundup", F.when(F.col("roundup"), F.col("others")).otherwise(F.col("flagged")).alias("roundups"), F.when(F.col("roundup"), 0).otherwise(F.col("others") - F.col("flagged")).alias("single"))


def pair_decisions(spark, sf_dir):
    """For every item how many of its pairs are accepted, rejected or left open, by reason.

    Pairs that share two words are decided one by one within the hours only; roundups and far pairs are counted.
    """
    f = _reports(spark, sf_dir)

    def count(d: pd.DataFrame) -> pd.DataFrame:
        ends = pd.DataFrame({"item_id": np.concatenate([d.a, d.b]), "code": np.concatenate([d.code, d.code])})
        return ends.groupby(["item_id", "code"]).size().reset_index(name="pairs")

    near = _near(f, count, f"item_id {dict(f.dtypes)['item_id']}, code int, pairs long").groupBy("item_id", "code").agg(F.sum("pairs").alias("pairs"))
    near = stage(near, "near_counts")
    n = stage(_excluded(f), "partner_counts")
    far = n.join(near.groupBy("item_id").agg(F.sum("pairs").alias("near")), "item_id", "left").select("item_id", (F.col("single") - F.coalesce("near", F.lit(0))).alias("pairs"))
    return near.select("item_id", N.verdict(F.col("code")).alias("verdict"), N.reason(F.col("code")).alias("reason"), "pairs").unionByName(
        _rejected(far, "reports far apart", "item_id")).unionByName(_rejected(n.withColumn("pairs", F.col("roundups")), "multi-story roundup", "item_id"))


def _rejected(counts: DataFrame, reason: str, *keys: str) -> DataFrame:
    return counts.where("pairs > 0").select(*keys, F.lit("reject").alias("verdict"), F.lit(reason).alias("reason"), F.col("pairs").cast("bigint").alias("pairs"))


#: Pairs of the decision log.
LOGGED = 4000


def pair_log(spark, sf_dir):
    """The decision log: at most 4,000 pairs, accepted ones first, then rejected, then neutral; roundups last.

    Accepted pairs are near ones, and of each block only its first 4,000 can be among them. If they don't fill the log, far pairs are
    listed too, those of many shared words first; all pairs are listed only if the log isn't full otherwise.
    """
    f = _reports(spark, sf_dir)
    kind = dict(f.dtypes)["item_id"]

    def best(d: pd.DataFrame) -> pd.DataFrame:
        d = d.assign(rank=N.RANKS[d.code.to_numpy()], size=-((2_000_000 * d.n + d.union) // (2 * d.union)), few=-d.n)  # jaccard to 6 decimals
        return d.sort_values(["rank", "few", "size", "a", "b"]).head(LOGGED)[["a", "b", "code", "n", "union"]]

    near = stage(_near(f, best, f"a {kind}, b {kind}, code int, n long, union long"), "near_log")
    near = near.select("a", "b", N.verdict(F.col("code")).alias("verdict"), N.reason(F.col("code")).alias("reason"), F.col("n").alias("shared"), F.round(F.col("n") / F.col("union"), 6).alias("jaccard"))
    rank = F.when(F.col("reason") == "multi-story roundup", 3).when(F.col("verdict") == "accept", 0).when(F.col("verdict") == "reject", 1).otherwise(2)

    def first(d: DataFrame) -> DataFrame:
        return d.orderBy(rank, F.desc("shared"), F.desc("jaccard"), "a", "b").limit(LOGGED).select("a", "b", "verdict", "reason", "shared", "jaccard")

    if near.where("verdict = 'accept'").count() >= LOGGED:
        return first(near)
    dates = F.array(*[F.lit(w) for w in V.DATE_WORDS])
    told = f.select("item_id", "time", "roundup", "toks", F.array_except("toks", dates).alias("plain"))
    for least in (6, 4, 3):
        far = _far(told.where("not roundup").withColumn("words", F.col("plain")), least)
        log = stage(first(near.where(f"verdict = 'accept' or verdict = 'reject' and shared >= {least}").unionByName(far)), "log")
        if log.count() >= LOGGED:
            return first(log)
    return first(near.unionByName(_far(told.withColumn("words", F.col("toks")), 2)))


def _far(told: DataFrame, least: int) -> DataFrame:
    """Pairs with a roundup on a side or far apart that share so many words, as ``decide`` gives them."""
    p = P.token_pairs(told, "item_id", "words", least)
    p = p.withColumn("reason", F.when(F.col("roundup_a") | F.col("roundup_b"), "multi-story roundup").when(F.abs(F.col("time_a") - F.col("time_b")) > I.FAR_HOURS * 3600, "reports far apart")).where("reason is not null")
    n = F.size(F.array_intersect("plain_a", "plain_b"))
    return p.select("a", "b", F.lit("reject").alias("verdict"), "reason", n.cast("bigint").alias("shared"), F.round(n / F.size(F.array_union("toks_a", "toks_b")), 6).alias("jaccard"))


def reason_counts(spark, sf_dir):
    """How many pairs that share two words have each verdict and reason, and how many of them support a merge."""
    f = _reports(spark, sf_dir)
    near = _near(f, lambda d: d.groupby("code").agg(pairs=("code", "size"), supported=("support", "sum")).reset_index(), "code int, pairs long, supported long")
    near = stage(near.groupBy("code").agg(F.sum("pairs").alias("pairs"), F.sum("supported").alias("supported")), "near_counts")
    # a pair of two roundups is counted at both, one with a single roundup at both too
    n = _excluded(f).agg(F.coalesce(F.sum("roundups"), F.lit(0)).alias("roundups"), F.coalesce(F.sum("single"), F.lit(0)).alias("single"))
    n = stage(n.crossJoin(near.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("near"))), "totals")
    far = n.select((F.col("single") / 2 - F.col("near")).alias("pairs"))
    known = near.select(N.verdict(F.col("code")).alias("verdict"), N.reason(F.col("code")).alias("reason"), "pairs", "supported")
    for counts, why in ((far, "reports far apart"), (n.select((F.col("roundups") / 2).alias("pairs")), "multi-story roundup")):
        known = known.unionByName(_rejected(counts, why).withColumn("supported", F.lit(0).cast("bigint")))
    return known


def knn_search(spark, sf_dir, floor: float = 0.45):
    """Twelve nearest embeddings with a cosine of at least ``floor`` for every embedding whose id is divisible by 50."""
    v = table(spark, sf_dir, "embeddings")
    hits = P.vector_search(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 12, floor)
    return hits.select(F.col("query").cast("bigint").alias("query"), F.col("other").cast("bigint").alias("other"), F.round("cosine", 6).alias("cosine"))


def vector_norms(spark, sf_dir):
    """Length and usability of every vector: what normalising would do. A vector of zeros is not usable."""
    v = table(spark, sf_dir, "vectors")
    sq = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = F.col("vec").isNotNull() & (F.size("vec") == F.col("dims")) & F.coalesce(F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    return v.select("vec_key", usable.alias("usable"), F.when(usable, F.round(F.sqrt(sq), 5)).alias("norm"))


def vector_cache(spark, sf_dir):
    """Vectors by what their keys name: provider, model and representation, how many can be used, and how many are 21 days old."""
    part = F.split("vec_key", r"\|")
    v = table(spark, sf_dir, "vectors").select(part[0].alias("provider"), part[1].alias("model"), F.element_at(part, -2).alias("repr"), "dims", "used", "vec")
    newest = v.agg(F.max("used").alias("newest"))
    return v.join(F.broadcast(newest)).groupBy("provider", "model", "repr", "dims").agg(
        F.count("*").alias("vectors"), F.count_if(F.coalesce(F.size("vec") == F.col("dims"), F.lit(False))).alias("whole"), F.count_if(F.col("used") < F.col("newest") - 21 * 86400).alias("old")
    )


def pair_scores(spark, sf_dir):
    """Precision, recall and F1 of folding by title key against content hashes."""
    rows = table(spark, sf_dir, "raw_items").select(X.dedupe_key(F.col("title")).alias("key"), F.lower("content_hash").alias("gold"))
    return P.pair_counts(rows, "key", "gold")


def mixed_groups(spark, sf_dir):
    """Title groups that hold several content hashes, with how many and the largest one's share."""
    rows = table(spark, sf_dir, "raw_items").where("content_hash is not null").groupBy(X.dedupe_key(F.col("title")).alias("key"), F.lower("content_hash").alias("gold")).agg(F.count("*").alias("n"))
    return rows.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("items"), F.round(F.max("n") / F.sum("n"), 6).alias("share")).where("kinds > 1")


def cohesive_story_groups(spark, sf_dir):
    """Cohesive groups inside each component of accepted pairs; far pairs that share two words are rejected ones."""
    f = _reports(spark, sf_dir)
    kind = dict(f.dtypes)["item_id"]
    d = _near(f, lambda p: p, f"a {kind}, b {kind}, code int, support boolean, n long, union long")
    d = stage(d.select("a", "b", N.verdict(F.col("code")).alias("verdict"), "support", F.round(F.col("n") / F.col("union"), 6).alias("cosine")), "decisions")
    comp = components(d.where("verdict = 'accept'").select("a", "b"))
    comp = stage(comp.unionByName(comp.select(F.col("root").alias("node"), "root")).distinct(), "shards")
    a, b = comp.select(F.col("node").alias("a"), F.col("root").alias("shard")), comp.select(F.col("node").alias("b"), F.col("root").alias("other"))
    told = f.select(F.col("item_id").alias("node"), "time", F.col("toks").alias("words")).join(comp.select("node", F.col("root").alias("shard")), "node")
    return P.cohesive_groups(d.join(a, "a").join(b, "b").where("shard = other").drop("other"), "shard", told, I.FAR_HOURS * 3600)


def partition_check(spark, sf_dir):
    """Each item is in exactly one story or alone: items, grouped ones, stories, and items in several (none)."""
    g = cohesive_story_groups(spark, sf_dir).groupBy("node").agg(F.count("*").alias("times"), F.first("grp").alias("grp"))
    j = table(spark, sf_dir, "cleaned_items").select("item_id").join(g, F.col("item_id") == F.col("node"), "left")
    return j.agg(F.count("*").alias("items"), F.count("node").alias("grouped"), F.count_distinct("grp").alias("stories"), F.count_if(F.col("times") > 1).alias("repeated"))


def registry_match(spark, sf_dir):
    """The registry event that each item continues.

    Candidates are events of the last 7 days that list the item's report, or share a rare stem (joined by stem and day, so a stem's
    posting list never meets all others). Scored is the cosine of weighted stems (title 2, description 1), both sides weighted by
    idf over items and events. A listed report with some wording wins over wording alone, which needs rare words and names; an item
    undecided between several events (within a tenth) matches none, and of a day's items only the best continues an event by wording.
    """
    items = table(spark, sf_dir, "cleaned_items").select("item_id", "title", "description", "url", F.unix_timestamp("item_time").alias("at"), F.to_date("item_time").alias("day"))
    events = table(spark, sf_dir, "registry_events").select("event_id", F.unix_timestamp("last_seen_utc").alias("seen"), "tokens", "name_counts", "reports")
    mine = items.select("item_id", F.explode(X.stems(F.col("title"))).alias("stem")).withColumn("w", F.lit(2.0)).unionByName(
        items.select("item_id", F.explode(X.stems(F.coalesce("description", F.lit("")))).alias("stem")).withColumn("w", F.lit(1.0))
    )
    mine = mine.groupBy("item_id", "stem").agg(F.sum("w").alias("w"))
    theirs = events.select("event_id", F.explode("tokens").alias("stem", "w"))
    n = items.agg(F.count("*").alias("i")).join(events.agg(F.count("*").alias("e"))).select((F.col("i") + F.col("e") + 1).alias("n"))
    idf = mine.select("stem").unionByName(theirs.select("stem")).groupBy("stem").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("stem", F.log(F.col("n") / (F.col("df") + 0.5)).alias("idf"))
    d = stage(mine.join(idf, "stem").select("item_id", "stem", "idf", (F.col("w") * F.col("idf")).alias("x")), "item_stems")
    e = stage(theirs.join(idf, "stem").select("event_id", "stem", (F.col("w") * F.col("idf")).alias("y")), "event_stems")
    dn = d.groupBy("item_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("dn"))
    en = e.groupBy("event_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("en"))
    days = events.select("event_id", "seen", F.explode(F.expr("sequence(0, 7)")).alias("later")).select("event_id", "seen", F.to_date(F.timestamp_seconds(F.col("seen") + F.col("later") * 86400)).alias("day"))
    when = items.select("item_id", "at", "day")
    rare = d.where("idf >= 3.0").select("item_id", "stem").join(when, "item_id").join(e.select("event_id", "stem").join(days, "event_id"), ["stem", "day"]).select("item_id", "event_id", "at", "seen")
    keys = items.select("item_id", "at", F.explode(F.array("url", F.concat(F.lit("t:"), X.dedupe_key(F.col("title"))))).alias("report"))
    listed = keys.join(events.select("event_id", "seen", F.explode("reports").alias("report")), "report").select("item_id", "event_id", "at", "seen", F.lit(True).alias("listed"))
    near = rare.withColumn("listed", F.lit(False)).unionByName(listed).where("at - seen between 0 and 7 * 86400").groupBy("item_id", "event_id").agg(F.max("listed").alias("listed"))
    near = stage(near, "near")
    names = events.select("event_id", F.transform(F.map_keys("name_counts"), lambda x: F.lower(x)).alias("known"))
    said = items.select("item_id", "day", F.lower("title").alias("low"))
    named = near.join(names, "event_id").join(said, "item_id").select("item_id", "event_id", "day", F.filter("known", lambda x: F.col("low").contains(x)).alias("shared_names"))
    named = named.withColumn("stems", F.flatten(F.transform("shared_names", lambda x: F.transform(F.split(x, " "), lambda w: F.substring(w, 1, 5)))))
    both = near.join(d, "item_id").join(e, ["event_id", "stem"]).join(named.select("item_id", "event_id", "stems"), ["item_id", "event_id"])
    dot = both.groupBy("item_id", "event_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.count_if((F.col("idf") >= 3.0) & ~F.array_contains("stems", F.col("stem"))).alias("rare"))
    s = near.join(dot, ["item_id", "event_id"]).join(named, ["item_id", "event_id"]).join(dn, "item_id").join(en, "event_id").withColumn("wording", F.round(F.col("dot") / (F.col("dn") * F.col("en")), 6))
    has = F.size("shared_names") > 0
    strong = (F.col("rare") >= 1) & (((F.col("wording") >= 0.45) & (has | (F.col("rare") >= 2))) | ((F.col("wording") >= 0.32) & has & (F.col("rare") >= 2)))
    s = s.withColumn("tier", F.when(F.col("listed") & (F.col("wording") >= 0.12), "reports").when(strong, "wording")).where("tier is not null")
    s = s.withColumn("score", F.when(F.col("tier") == "reports", 2.0 + F.col("wording")).otherwise(F.col("wording")))
    order = Window.partitionBy("item_id").orderBy("tier", F.desc("score"), "event_id")  # reports before wording
    top = s.withColumn("rn", F.row_number().over(order)).withColumn("best", F.first("score").over(order)).withColumn("first", F.first("tier").over(order))
    close = F.count_if((F.col("tier") == F.col("first")) & (F.col("score") >= 0.9 * F.col("best"))).over(Window.partitionBy("item_id"))
    won = top.withColumn("close", close).where("rn = 1 and close = 1")
    first = F.row_number().over(Window.partitionBy("event_id", "day").orderBy("tier", F.desc("score"), "item_id"))
    return won.withColumn("turn", first).where("turn = 1 or tier = 'reports'").select("item_id", "event_id", "tier", "wording", "rare")


def key_names(spark, sf_dir):
    """Names in at least two fifths (and two) of the titles of a content group."""
    rows = table(spark, sf_dir, "raw_items").select("id", X.dedupe_key(F.col("title")).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Z][a-z]+"), F.lit(0)))).alias("name"))
    size = table(spark, sf_dir, "raw_items").groupBy(X.dedupe_key(F.col("title")).alias("key")).agg(F.count("*").alias("n"))
    named = rows.groupBy("key", "name").agg(F.count("*").alias("titles"))
    return named.join(size, "key").where("titles >= 2 and titles >= 0.4 * n and key != ''").select("key", "name", "titles", "n")


def context_overlap(spark, sf_dir):
    """How much of a title's words its page's text supports, and whether all its figures are there."""
    t, c = F.col("title"), F.col("context")
    rows = table(spark, sf_dir, "cleaned_items").where("context is not null").select("item_id", X.stems(t).alias("t"), X.stems(c).alias("c"), F.size(F.array_except(X.numbers(t), X.numbers(c))).alias("missing"))
    return rows.where(F.size("t") > 0).select("item_id", F.size(F.array_intersect("t", "c")).cast("bigint").alias("shared"), F.round(X.overlap(F.col("t"), F.col("c")), 6).alias("support"), (F.col("missing") == 0).alias("figures"))


QUERIES = {f.__name__: f for f in (lexical_pairs, pair_decisions, pair_log, reason_counts, knn_search, vector_norms, vector_cache, pair_scores, mixed_groups, cohesive_story_groups, partition_check, registry_match, key_names, context_overlap)}

_T = f"i as (select item_id, list_sort({Q.significant_tokens('title')}) toks from cleaned_items), k as (select toks, min(item_id) class_id from i group by toks), t as (select class_id, unnest(toks) token, len(toks) size from k), p as (select x.class_id a, y.class_id b, count(*) shared, any_value(x.size) sa, any_value(y.size) sb from t x join t y on x.token = y.token and x.class_id < y.class_id group by all having count(*) >= 3), l as (select a, b from p where round(shared / (sa + sb - shared), 6) >= 0.25), e as (select class_id, count(*) links from (select a class_id from l union all select b from l) group by 1)"


def _ids(groups: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"case when len(list_intersect(toks, [{Q.listed(g.split())}])) > 0 then {i} end" for i, g in enumerate(groups)) + "], lambda x: x is not null)"


_ONE = {w: sorted(g.split())[0] for g in V.ACTIONS for w in g.split()}
_CLAIM = f"list_distinct(list_transform(list_transform(list_filter(regexp_extract_all(regexp_replace(replace(lower(title), 'u.s.', 'us'), '\\s+as\\s+.*$', ''), '[a-z0-9]+'), lambda w: w not in ({Q.listed(I.CLAIM_STOP)})), lambda w: regexp_replace(w, 's$', '')), lambda w: coalesce(map_extract_value(map {{{', '.join(f'{Q.q(a)}: {Q.q(b)}' for a, b in _ONE.items())}}}, w), w)))"
_ACTOR = f"list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace(lower(title), '^(?:sources?|reports?|exclusive|breaking)\\s*:\\s*', ''), {Q.q(V.ACTOR_ENDS + '.*$')}, ''), '[a-z]+'), lambda w: w not in ({Q.listed(V.ROLES)})))"
_APART = "(len({0}_a) > 0 and len({0}_b) > 0 and len(list_intersect({0}_a, {0}_b)) = 0)"
_SPECIFIC = "(len({0}) >= 2 or (len({0}) = 1 and length({0}[1]) > 4))"
_FEATURES = ("toks", "fam", "fld", "roundup", "claim", "actor", "bound", "negative", "names", "steps", "time", "day", "rare")
_D = f"""with f0 as materialized (select item_id, title, epoch(item_time)::bigint "time", item_time::date "day", {Q.significant_tokens('title')} toks0, regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''+.&-]*[a-z0-9+]|[a-z0-9]') seq from cleaned_items),
  f1 as materialized (select *, (select coalesce(list(x order by i), []) from (select x, min(i) i from (select unnest(seq) x, unnest(range(len(seq))) i) where list_contains(toks0, x) group by x)) toks from f0),
  f2 as materialized (select *, {_ids(V.EVENT_FAMILIES)} fam, {_ids(V.FIELDS)} fld, {Q.is_roundup('title')} roundup, {_CLAIM} claim, {_ACTOR} actor, lower(regexp_extract(title, '(?i)\\b(before|after|during|until)\\b', 1)) bound, regexp_matches(title, {Q.q(V.NEGATIONS)}) negative,
    list_distinct(list_transform(regexp_extract_all(title, '[a-z,;] ([A-Z][A-Za-z'']+)', 1), lambda w: lower(w))) names, case when len(toks) > 1 then list_transform(range(1, len(toks)), lambda i: array_to_string(list_sort(list_slice(toks, i, i + 1)), ' ')) else [] end steps from f1),
  r0 as (select token from (select unnest(toks) token from f2) group by token having count(*) <= (select greatest(4, floor(count(*) * 0.06::double)) from f2)),
  ra as (select item_id, list(token) rare from (select item_id, unnest(toks) token from f2) join r0 using (token) group by item_id),
  f as materialized (select f2.*, coalesce(rare, []) rare from f2 left join ra using (item_id)),
  tk as (select item_id, unnest(toks) token from f), c as (select x.item_id a, y.item_id b from tk x join tk y on x.token = y.token and x.item_id < y.item_id group by all having count(*) >= 2),
  p0 as (select a, b, {', '.join(f'x.{n} {n}_a, y.{n} {n}_b' for n in _FEATURES)} from c join f x on x.item_id = a join f y on y.item_id = b),
  p1 as (select *, list_filter(list_intersect(toks_a, toks_b), lambda w: w not in ({Q.listed(V.DATE_WORDS)})) both_, list_distinct(list_concat(names_a, names_b)) nm from p0),
  p2 as (select *, len(both_) n, len(both_) / len(list_distinct(list_concat(toks_a, toks_b))) jac, list_intersect(list_intersect(rare_a, rare_b), both_) rare2 from p1),
  p3 as (select *, list_filter(rare2, lambda w: not list_contains(nm, w)) what, greatest(least(len(rare2), 1), len(rare2) - len(list_filter(list_distinct(list_concat(steps_a, steps_b)), lambda s: list_contains(rare2, split_part(s, ' ', 1)) and list_contains(rare2, split_part(s, ' ', 2))))) phrases,
    list_contains(steps_a, array_to_string(list_sort(both_), ' ')) and list_contains(steps_b, array_to_string(list_sort(both_), ' ')) beside, len(list_intersect(claim_a, claim_b)) / greatest(1, len(list_distinct(list_concat(claim_a, claim_b)))) cl,
    len(list_intersect(list_intersect(claim_a, claim_b), [{Q.listed(sorted(g.split())[0] for g in V.ACTIONS)}])) > 0 act,
    coalesce(not (actor_a = actor_b or (len(actor_a) = 1 and coalesce(actor_a[1] = actor_b[-1], false)) or (len(actor_b) = 1 and coalesce(actor_b[1] = actor_a[-1], false))), true) other_actor from p2),
  p4 as (select *, case when roundup_a or roundup_b then 'reject:multi-story roundup' when abs(time_a - time_b) > {I.FAR_HOURS * 3600} then 'reject:reports far apart' when {_APART.format('fam')} then 'reject:different kinds of event' when {_APART.format('fld')} then 'reject:different prize or field'
    when len(list_intersect(names_a, names_b)) > 0 and coalesce(day_a = day_b, false) and cl >= 0.4 and act and (other_actor or (bound_a != '' and bound_b != '' and bound_a != bound_b) or negative_a != negative_b) then 'reject:opposite claims about the same actor and action'
    when {_APART.format('actor')} and {_SPECIFIC.format('actor_a')} and {_SPECIFIC.format('actor_b')} then 'reject:different central actors' when n = 0 then 'neutral:no shared words'
    when n >= 2 and jac >= 0.25 and (n >= 3 or n = len(toks_a) or n = len(toks_b) or not beside) then 'accept:shared wording' when phrases >= 2 and len(what) >= 1 then 'accept:two distinctive phrases in common' when len(rare2) > 0 then 'neutral:one distinctive phrase only' else 'neutral:no distinctive shared words' end ruled from p3),
  v as (select a, b, split_part(ruled, ':', 1) verdict, split_part(ruled, ':', 2) reason, n::bigint shared, round(jac, 6) jaccard, len(what) > 0 specific from p4)"""
_STEM = Q.stems
SQL = {
    "lexical_pairs": f"with {_T} select item_id, class_id, coalesce(links, 0) links from i join k using (toks) left join e using (class_id)",
    "pair_decisions": f"{_D} select item_id, verdict, reason, count(*) pairs from (select a item_id, verdict, reason from v union all select b, verdict, reason from v) group by all",
    "pair_log": f"{_D} select a, b, verdict, reason, shared, jaccard from v order by case when reason = 'multi-story roundup' then 3 when verdict = 'accept' then 0 when verdict = 'reject' then 1 else 2 end, shared desc, jaccard desc, a, b limit 4000",
    "reason_counts": f"{_D} select verdict, reason, count(*) pairs, sum((verdict = 'accept' or (verdict = 'neutral' and specific))::bigint)::bigint supported from v group by all",
    "knn_search": "with s as (select q.vec_id query, o.vec_id other, round(list_cosine_similarity(q.embedding::double[], o.embedding::double[]), 9) c from embeddings q join embeddings o on q.vec_id % 50 = 0 and o.vec_id != q.vec_id), r as (select *, row_number() over (partition by query order by c desc, other) rn from s where c >= 0.45) select query, other, round(c, 6) cosine from r where rn <= 12",
    "vector_norms": "select vec_key, u usable, case when u then round(sqrt(list_sum(list_transform(vec, lambda x: x::double * x::double))), 5) end norm from (select *, coalesce(vec is not null and len(vec) = dims and len(list_filter(vec, lambda x: not isfinite(x))) = 0 and len(list_filter(vec, lambda x: x != 0)) > 0, false) u from vectors)",
    "vector_cache": "select string_split(vec_key, '|')[1] provider, string_split(vec_key, '|')[2] model, string_split(vec_key, '|')[-2] repr, dims, count(*) vectors, count(*) filter (coalesce(len(vec) = dims, false)) whole, count(*) filter (used < (select max(used) from vectors) - 21 * 86400) old from vectors group by all",
    "pair_scores": f"with a as (select {Q.dedupe_key('title')} k, lower(content_hash) g from raw_items), c as (select k, g, count(*) n from a where k is not null and g is not null group by all), b as (select sum(n * (n - 1) / 2)::double in_both from c), m as (select sum(n * (n - 1) / 2)::double made from (select sum(n) n from c group by k)), t as (select sum(n * (n - 1) / 2)::double true_pairs from (select sum(n) n from c group by g)) select in_both, made, true_pairs, round(in_both / made, 6) \"precision\", round(in_both / true_pairs, 6) recall, round(2 * (in_both / made) * (in_both / true_pairs) / (in_both / made + in_both / true_pairs), 6) f1 from b, m, t",
    "mixed_groups": f"with a as (select {Q.dedupe_key('title')} as key, lower(content_hash) g, count(*) n from raw_items where content_hash is not null group by 1, 2) select key, count(*) kinds, sum(n)::bigint items, round(max(n) / sum(n), 6) share from a group by key having count(*) > 1",
    "registry_match": f"""with i as (select item_id, title, description, url, epoch(item_time)::bigint ts, item_time::date dy from cleaned_items), ev as (select event_id, epoch(last_seen_utc)::bigint seen, tokens, name_counts, reports from registry_events),
  m as (select item_id, stem, sum(w) w from (select item_id, unnest({_STEM('title')}) stem, 2.0::double w from i union all select item_id, unnest({_STEM("coalesce(description, '')")}), 1.0::double from i) group by all),
  th as (select event_id, t.key stem, t.value w from (select event_id, unnest(map_entries(tokens)) t from ev)),
  idf as (select stem, ln(((select count(*) from i) + (select count(*) from ev) + 1) / (count(*) + 0.5)) idf from (select stem from m union all select stem from th) group by stem),
  d as (select item_id, stem, idf, w * idf x from m join idf using (stem)), e as (select event_id, stem, w * idf y from th join idf using (stem)),
  dn as (select item_id, sqrt(sum(x * x)) dn from d group by item_id), en as (select event_id, sqrt(sum(y * y)) en from e group by event_id),
  nr as (select item_id, event_id, max(listed) listed from (select d.item_id, e.event_id, false listed from d join e using (stem) join i using (item_id) join ev using (event_id) where d.idf >= 3.0 and ts - seen between 0 and 604800
    union all select k.item_id, r.event_id, true from (select item_id, ts, unnest([url, 't:' || {Q.dedupe_key('title')}]) report from i) k join (select event_id, seen, unnest(reports) report from ev) r using (report) where ts - seen between 0 and 604800) group by all),
  nm as (select item_id, event_id, dy, list_filter(list_transform(map_keys(name_counts), lambda x: lower(x)), lambda x: contains(lower(title), x)) names from nr join i using (item_id) join ev using (event_id)),
  ns as (select *, flatten(list_transform(names, lambda x: list_transform(string_split(x, ' '), lambda w: substr(w, 1, 5)))) stems from nm),
  dot as (select item_id, event_id, sum(x * y) dot, count(*) filter (idf >= 3.0 and not list_contains(stems, stem)) rare from nr join d using (item_id) join e using (event_id, stem) join ns using (item_id, event_id) group by all),
  s0 as (select item_id, event_id, listed, rare, dy, len(names) > 0 has, round(dot / (dn * en), 6) wording from nr join dot using (item_id, event_id) join ns using (item_id, event_id) join dn using (item_id) join en using (event_id)),
  s1 as (select *, case when listed and wording >= 0.12 then 'reports' when rare >= 1 and ((wording >= 0.45 and (has or rare >= 2)) or (wording >= 0.32 and has and rare >= 2)) then 'wording' end tier from s0),
  s2 as (select *, case when tier = 'reports' then 2.0 + wording else wording end score from s1 where tier is not null),
  s3 as (select *, row_number() over w rn, first_value(score) over w best, first_value(tier) over w ft from s2 window w as (partition by item_id order by tier, score desc, event_id)),
  s4 as (select *, count(*) filter (tier = ft and score >= 0.9::double * best) over (partition by item_id) near from s3),
  s5 as (select *, row_number() over (partition by event_id, dy order by tier, score desc, item_id) turn from s4 where rn = 1 and near = 1)
  select item_id, event_id, tier, wording, rare from s5 where turn = 1 or tier = 'reports'""",
    "key_names": f"with a as (select id, {Q.dedupe_key('title')} as key, unnest(list_distinct(regexp_extract_all(title, '[A-Z][a-z]+'))) as name from raw_items), s as (select {Q.dedupe_key('title')} as key, count(*) n from raw_items group by 1), c as (select key, name, count(*) titles from a group by all) select key, name, titles, n from c join s using (key) where titles >= 2 and titles >= 0.4 * n and key != ''",
    "context_overlap": f"select item_id, len(list_intersect(t, c))::bigint shared, round(len(list_intersect(t, c)) / len(t), 6) support, missing = 0 figures from (select item_id, {_STEM('title')} t, {_STEM('context')} c, len(list_filter({Q.numbers('title')}, lambda x: not list_contains({Q.numbers('context')}, x))) missing from cleaned_items where context is not null) where len(t) > 0",
}
