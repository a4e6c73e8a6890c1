"""Editions, events and evidence over registry_events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.functions import sql as Q
from wirelake.functions import text as X
from wirelake.operators import editions as D
from wirelake.operators import pairs as P
from wirelake.operators import series as S
from wirelake.session import table


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each event and edition date: the highest revision."""
    a = table(spark, sf_dir, "registry_events").select("event_id", "category", F.explode("appearances").alias("a")).select("event_id", "category", "a.*")
    return D.latest(a, ["event_id", "edition_date"], [F.desc("revision"), F.desc("seen_utc"), F.asc("rank")])


def _reports(spark, sf_dir):
    return table(spark, sf_dir, "registry_events").select("event_id", F.posexplode("reports").alias("at", "report"))


def event_timeline(spark, sf_dir):
    """First and last day, editions, best rank and status of each event: archived 14 days after it was last seen."""
    a = appearances(spark, sf_dir)
    newest = a.agg(F.max("seen_utc").alias("newest"))
    by = a.groupBy("event_id").agg(F.min("edition_date").alias("first_date"), F.max("edition_date").alias("last_date"), F.count("*").alias("editions"), F.min("rank").cast("bigint").alias("best_rank"), F.max("seen_utc").alias("seen"))
    status = F.when(F.col("seen") < F.col("newest") - F.expr("interval 14 days"), "archived").otherwise("developing")
    return by.join(F.broadcast(newest)).select("event_id", "first_date", "last_date", "editions", "best_rank", status.alias("status"))


def edition_diff(spark, sf_dir):
    """Each edition against the one before: new, gone, rank changed, unchanged."""
    a = appearances(spark, sf_dir).select("event_id", "edition_date", "rank")
    dates = S.numbered(a.select("edition_date").distinct(), "edition_date", name="n")
    now = a.join(dates, "edition_date").select("event_id", "n", F.col("rank").alias("r"))
    last = dates.agg(F.max("n").alias("top"))
    before = now.join(F.broadcast(last)).where("n < top").select("event_id", (F.col("n") + 1).alias("n"), "r")
    d = D.compare(before, now, ["event_id", "n"], "r").where("n > 1")
    return d.join(dates, "n").groupBy("edition_date", "kind").agg(F.count("*").alias("stories"))


def edition_ranks(spark, sf_dir):
    """Ranks made contiguous inside each edition."""
    rn = F.row_number().over(Window.partitionBy("edition_date").orderBy("rank", "event_id"))
    return appearances(spark, sf_dir).select("edition_date", "event_id", rn.cast("bigint").alias("place"))


def section_groups(spark, sf_dir):
    """Stories by section of each edition; sections of fewer than three go under one heading."""
    n = F.count("*").over(Window.partitionBy("edition_date", "category"))
    a = appearances(spark, sf_dir).withColumn("section", F.when(n < 3, "Also today").otherwise(F.coalesce("category", F.lit("Also today"))))
    return a.groupBy("edition_date", "section").agg(F.count("*").alias("stories"), F.min("rank").cast("bigint").alias("lead"))


def section_topk(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("confidence"), "rank", "event_id", "edition_date"))
    return appearances(spark, sf_dir).withColumn("rn", rn).where("rn <= 10").select("category", "event_id", "edition_date", F.col("rn").cast("bigint").alias("place"))


def story_lineage(spark, sf_dir):
    """Unbroken runs of edition days of each event."""
    a = appearances(spark, sf_dir).select("event_id", F.datediff(F.to_date("edition_date"), F.lit("1970-01-01").cast("date")).alias("day"))
    return S.islands(a, "event_id", "day").select("event_id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "length")


def evidence_strength(spark, sf_dir):
    """How well each event is corroborated: reports by origin, channels, signals, age against the newest event."""
    r = _reports(spark, sf_dir).withColumn("url", F.when(~F.col("report").startswith("t:"), X.canonical_url(F.col("report"))))
    slug = F.regexp_replace(F.regexp_extract("report", r"/([^/?#]+)/?(?:[?#].*)?$", 1), r"-[0-9a-f]+$", "")
    items = table(spark, sf_dir, "raw_items").where("url is not null").groupBy(X.canonical_url(F.col("url")).alias("url")).agg(F.min("source").alias("source"))
    hosts = table(spark, sf_dir, "feeds").groupBy("host").agg(F.min("channel").alias("channel"))
    ev = table(spark, sf_dir, "registry_events").select("event_id", "last_seen_utc")
    newest = ev.agg(F.max("last_seen_utc").alias("newest"))
    age = ev.join(F.broadcast(newest)).select("event_id", ((F.unix_timestamp("newest") - F.unix_timestamp("last_seen_utc")) / 3600).alias("age_hours"))
    e = r.join(items, "url", "left").select("event_id", F.col("at").cast("bigint").alias("ref"), F.when(F.col("url").isNotNull(), X.host(F.col("report"))).alias("outlet"), F.when(F.col("url").isNull(), F.col("report")).otherwise(slug).alias("title_key"), F.coalesce(F.col("source").isin(V.SIGNAL_SOURCES), F.lit(False)).alias("signal"))
    e = e.withColumn("counted", F.col("outlet").isNotNull() & (F.col("outlet") != ""))
    origins = D.evidence_groups(e.where("counted and not signal").select("event_id", "ref", "outlet", "title_key"), "event_id").select("event_id", "ref", "origin")
    e = e.join(origins, ["event_id", "ref"], "left").join(hosts, F.col("outlet") == F.col("host"), "left").join(age, "event_id")
    s = D.strength(e, "event_id")
    return s.select("event_id", "independent", "reports", "repeats", "signals", "channels", F.round("age_hours", 4).alias("age_hours"), "points", "level")


def publisher_breakdown(spark, sf_dir):
    """Stories and articles of each host, and in how many channels it is listed."""
    r = _reports(spark, sf_dir).where("not startswith(report, 't:')").select("event_id", X.host(F.col("report")).alias("host"))
    by = r.groupBy("host").agg(F.count_distinct("event_id").alias("stories"), F.count("*").alias("articles"))
    return by.join(table(spark, sf_dir, "feeds").groupBy("host").agg(F.count_distinct("channel").alias("channels"), F.min("publisher").alias("publisher")), "host", "left").select("host", "publisher", "stories", "articles", F.coalesce("channels", F.lit(0)).alias("channels"))


def shared_reports(spark, sf_dir):
    """Reports that several events list: events that may be one."""
    r = _reports(spark, sf_dir).select("event_id", F.when(F.col("report").startswith("t:"), F.col("report")).otherwise(X.canonical_url(F.col("report"))).alias("key")).distinct()
    return r.groupBy("key").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event")).where("events > 1")


def event_identity(spark, sf_dir):
    """Stable fingerprints: sha1 of the sorted names, twelve hex digits, and sha256 of the sorted reports, twenty."""
    ev = table(spark, sf_dir, "registry_events")
    names = F.array_join(F.array_sort(F.map_keys("name_counts")), "|")
    reports = F.array_join(F.array_sort(F.array_distinct("reports")), "|")
    return ev.select("event_id", F.substring(F.sha1(names), 1, 12).alias("entity_id"), F.substring(F.sha2(reports, 256), 1, 20).alias("fingerprint"))


def profile_fold(spark, sf_dir):
    """Token profiles over an event's editions: each one decays the weights before it by 0.7; the 120 heaviest stay."""
    n = table(spark, sf_dir, "registry_events").select("event_id", F.size("appearances").alias("n"), F.explode("tokens").alias("token", "w"))
    weight = F.round(F.col("w") * (1 - F.pow(F.lit(0.7), F.col("n"))) / 0.3, 6)
    rn = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("weight"), "token"))
    return n.select("event_id", "token", weight.alias("weight")).withColumn("rn", rn).where("rn <= 120").drop("rn")


def continuity_check(spark, sf_dir):
    """Events of other ids with nearly the same headline stems."""
    ev = table(spark, sf_dir, "registry_events").where("headline is not null").select("event_id", X.stems(F.col("headline")).alias("s"))
    p = P.token_pairs(ev, "event_id", "s", 1, 0.59999)
    return p.select("a", "b", "shared", F.round(P.jaccard(), 6).alias("jaccard")).where("jaccard >= 0.6")


def stale_events(spark, sf_dir):
    """Events whose last appearance is more than 48 hours before the newest of their category."""
    ev = table(spark, sf_dir, "registry_events").select("event_id", F.coalesce("category", F.lit("-")).alias("category"), "last_seen_utc")
    top = ev.groupBy("category").agg(F.max("last_seen_utc").alias("newest"))
    return ev.join(top, "category").select("event_id", "category", (F.col("last_seen_utc") < F.col("newest") - F.expr("interval 48 hours")).alias("stale"))


def candidate_window(spark, sf_dir):
    """For each edition, how many events were seen in the seven days before it: a range join on day buckets."""
    ev = table(spark, sf_dir, "registry_events").select("event_id", F.to_date("last_seen_utc").alias("d"))
    dates = appearances(spark, sf_dir).select(F.to_date("edition_date").alias("edition")).distinct()
    days = dates.select("edition", F.explode(F.expr("sequence(date_sub(edition, 7), edition)")).alias("d"))
    return days.join(ev, "d").groupBy(F.date_format("edition", "yyyy-MM-dd").alias("edition_date")).agg(F.count("*").alias("candidates"))


def timeline_entries(spark, sf_dir):
    """Every event's appearances, one an edition and revision, numbered newest first."""
    a = table(spark, sf_dir, "registry_events").select("event_id", F.explode("appearances").alias("a")).select("event_id", "a.*")
    one = D.latest(a, ["event_id", "edition_date", "revision"], [F.desc("seen_utc"), F.asc("rank")])
    n = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("edition_date"), F.desc("revision")))
    return one.select("event_id", "edition_date", F.col("revision").cast("bigint").alias("revision"), F.col("rank").cast("bigint").alias("rank"), "tier", n.cast("bigint").alias("entry"))


def edition_churn(spark, sf_dir):
    """Of each edition how many events the one before had, how many are new, and how many of the other's are gone."""
    d = edition_diff(spark, sf_dir).groupBy("edition_date").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind").isin(*k), F.col("stories"))), F.lit(0)).alias(n) for n, k in (("kept", ("same", "changed")), ("new", ("new",)), ("gone", ("gone",)))]
    )
    return d.withColumn("carried", F.round(F.col("kept") / F.greatest(F.lit(1), F.col("kept") + F.col("gone")), 6))


def rank_moves(spark, sf_dir):
    """Appearances of an event that moved by two places or more since its last one, and those whose confidence grew or fell by half."""
    a = appearances(spark, sf_dir).select("event_id", "edition_date", "rank", "confidence")
    w = Window.partitionBy("event_id").orderBy("edition_date")
    m = a.select("*", F.lag("rank").over(w).alias("was"), F.lag("confidence").over(w).alias("had"), F.lag("edition_date").over(w).alias("before"))
    m = m.where("before is not null")
    kind = F.when(F.col("confidence") >= 1.5 * F.col("had"), "stronger").when(F.col("had") >= 1.5 * F.col("confidence"), "weaker").when(F.col("was") - F.col("rank") >= 2, "up").when(F.col("rank") - F.col("was") >= 2, "down")
    return m.select("event_id", "edition_date", kind.alias("kind")).where("kind is not null")


def what_changed(spark, sf_dir):
    """One sentence on each event's last appearance."""
    e = timeline_entries(spark, sf_dir)
    a, b = e.where("entry = 1"), e.where("entry = 2").select("event_id", F.col("rank").alias("was"), F.col("edition_date").alias("before"))
    text = F.when(F.col("was").isNull(), "First reported.").when(F.col("rank") < F.col("was"), F.format_string("Up from place %d to %d since %s.", "was", "rank", "before")).when(F.col("rank") > F.col("was"), F.format_string("Down from place %d to %d since %s.", "was", "rank", "before")).otherwise("No significant new developments.")
    return a.join(b, "event_id", "left").select("event_id", text.alias("text"))


def same_topic_links(spark, sf_dir):
    """For each event how many others tell of its topic: two shared headline tokens or more, three fifths of the smaller set."""
    ev = table(spark, sf_dir, "registry_events").where("headline is not null").select("event_id", X.significant_tokens(F.col("headline")).alias("t"))
    p = P.token_pairs(ev, "event_id", "t", 2).where(F.col("shared") >= 0.6 * F.least("size_a", "size_b"))
    return p.select(F.explode(F.array("a", "b")).alias("event_id")).groupBy("event_id").agg(F.count("*").alias("links"))


def _edition_pairs(spark, sf_dir):
    """Pairs of stories of one edition whose headlines share half their tokens."""
    heads = table(spark, sf_dir, "registry_events").where("headline is not null").select("event_id", X.significant_tokens(F.col("headline")).alias("t"))
    a = appearances(spark, sf_dir).select("edition_date", "event_id")
    p = P.token_pairs(heads, "event_id", "t", 1, 0.49999).where(F.round(P.jaccard(), 6) >= 0.5).select("a", "b")
    return p.join(a.select("edition_date", F.col("event_id").alias("a")), "a").join(a.select("edition_date", F.col("event_id").alias("b")), ["edition_date", "b"]).select("edition_date", "a", "b")


def pair_checks(spark, sf_dir):
    """Pairs of one edition that should be one story, by headline."""
    return _edition_pairs(spark, sf_dir)


def deduplicated_editions(spark, sf_dir):
    """Each edition in rank order without stories that repeat one above them."""
    stories = appearances(spark, sf_dir).select("edition_date", F.col("event_id").alias("key"), "rank")
    return D.keep_first(stories, _edition_pairs(spark, sf_dir), "edition_date")


def primary_reports(spark, sf_dir):
    """The report of each event whose address has most of the headline's stems; the first one wins ties."""
    ev = table(spark, sf_dir, "registry_events").where("headline is not null").select("event_id", X.stems(F.col("headline")).alias("h"), F.posexplode("reports").alias("at", "report")).where("not startswith(report, 't:')")
    words = X.stems(F.regexp_replace(F.regexp_extract("report", r"/([^/?#]+)/?(?:[?#].*)?$", 1), "-", " "))
    s = ev.select("event_id", "at", "report", F.size(F.array_intersect("h", words)).alias("n"))
    return D.latest(s, ["event_id"], [F.desc("n"), F.asc("at")]).select("event_id", "report", F.col("n").cast("bigint").alias("stems"))


def story_publishers(spark, sf_dir):
    """The first three different hosts of an event's reports, and how many more there are."""
    r = _reports(spark, sf_dir).where("not startswith(report, 't:')").groupBy("event_id", X.host(F.col("report")).alias("host")).agg(F.min("at").alias("at"))
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("event_id").orderBy("at", "host")))
    return r.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "host")))), lambda x: x["host"]), ", ").alias("hosts"), F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))  # three entries


def archive_index(spark, sf_dir):
    """One entry a date, newest first: highest revision, stories, and the leading event."""
    a = table(spark, sf_dir, "registry_events").select("event_id", F.explode("appearances").alias("a")).select("event_id", "a.edition_date", "a.revision", "a.rank")
    top = a.groupBy("edition_date").agg(F.max("revision").alias("revision"))
    by = a.join(top, ["edition_date", "revision"]).groupBy("edition_date", "revision").agg(F.count_distinct("event_id").alias("stories"), F.min_by("event_id", F.struct("rank", "event_id")).alias("lead"))
    dates = S.numbered(by.select("edition_date").distinct().withColumn("back", -F.datediff(F.to_date("edition_date"), F.lit("1970-01-01").cast("date"))), "back", name="place").select("edition_date", "place")
    return by.join(dates, "edition_date").select("edition_date", F.col("revision").cast("bigint").alias("revision"), "stories", "lead", F.col("place").cast("bigint").alias("place"))


def front_page(spark, sf_dir):
    """Each edition's first ten by rank, and by section how many stories are left below them; sections wholly above are links."""
    a = appearances(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("edition_date").orderBy("rank", "event_id")))
    by = a.groupBy("edition_date", F.coalesce("category", F.lit("-")).alias("section")).agg(F.count_if(F.expr("n <= 10")).alias("top"), F.count_if(F.expr("n > 10")).alias("below"))
    return by.withColumn("link_only", F.col("below") == 0)


def stable_event_ids(spark, sf_dir):
    """An id from an event's most counted name and its first day, and how many events share it."""
    ev = table(spark, sf_dir, "registry_events").select("event_id", F.date_format("first_seen_utc", "yyyy-MM-dd").alias("day"), F.explode_outer("name_counts").alias("name", "n"))
    top = D.latest(ev, ["event_id"], [F.desc_nulls_last("n"), F.asc("name")])
    ids = top.select("event_id", F.concat(F.lit("evt_"), F.substring(F.sha1(F.concat_ws("|", F.lower("name"), "day")), 1, 12)).alias("stable_id"))
    return ids.groupBy("stable_id").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def quality_checks(spark, sf_dir):
    """Checks of editions in three tiers with what they looked at and found; all tables are read once each."""
    a = appearances(spark, sf_dir)
    n = a.withColumn("place", F.row_number().over(Window.partitionBy("edition_date").orderBy("rank", "event_id"))).withColumn("same", F.count("*").over(Window.partitionBy("edition_date", "rank")))
    ed = n.select(F.inline(F.array(
        F.struct(F.lit("blocking").alias("tier"), F.lit("rank_taken_twice").alias("check"), (F.col("same") > 1).alias("bad")),
        F.struct(F.lit("notice").alias("tier"), F.lit("rank_gap").alias("check"), (F.col("rank") != F.col("place")).alias("bad")),
        F.struct(F.lit("warning").alias("tier"), F.lit("no_category").alias("check"), (F.col("category").isNull()).alias("bad")),
        F.struct(F.lit("warning").alias("tier"), F.lit("low_confidence").alias("check"), (F.coalesce(F.col("confidence") < 0.5, F.lit(True))).alias("bad")),
    )))
    ev = table(spark, sf_dir, "registry_events").select(F.inline(F.array(
        F.struct(F.lit("blocking").alias("tier"), F.lit("no_headline").alias("check"), F.coalesce(F.trim("headline") == "", F.lit(True)).alias("bad")),
        F.struct(F.lit("blocking").alias("tier"), F.lit("no_reports").alias("check"), (F.coalesce(F.size("reports") < 1, F.lit(True))).alias("bad")),
        F.struct(F.lit("warning").alias("tier"), F.lit("repeated_report").alias("check"), (F.coalesce(F.size("reports") > F.size(F.array_distinct("reports")), F.lit(False))).alias("bad")),
        F.struct(F.lit("warning").alias("tier"), F.lit("seen_out_of_order").alias("check"), (F.col("last_seen_utc") < F.col("first_seen_utc")).alias("bad")),
        F.struct(F.lit("notice").alias("tier"), F.lit("one_appearance").alias("check"), (F.coalesce(F.size("appearances") == 1, F.lit(False))).alias("bad")),
        F.struct(F.lit("blocking").alias("tier"), F.lit("bad_event_id").alias("check"), (~F.col("event_id").rlike("^ev-[0-9]{8}-[0-9a-f]{8}$")).alias("bad")),
    )))
    return ed.unionByName(ev).groupBy("tier", "check").agg(F.count("*").alias("looked_at"), F.count_if("bad").alias("found"))


def edition_selection(spark, sf_dir):
    a = appearances(spark, sf_dir).select("edition_date", F.col("event_id").alias("key"), F.coalesce("category", F.lit("-")).alias("category"), (F.col("confidence") / F.col("rank")).alias("score"))
    return D.greedy_top(a, "edition_date")


def hysteresis(spark, sf_dir):
    """Each date's newest revision, holding on to the stories of the revision before it: three a category.

    A story of both revisions is an incumbent with its new confidence; a new one needs a fifth more than the weakest.
    """
    a = table(spark, sf_dir, "registry_events").where("category is not null").select("event_id", "category", F.explode("appearances").alias("a")).select("event_id", "category", "a.edition_date", "a.revision", "a.confidence")
    a = D.latest(a, ["event_id", "edition_date", "revision"], [F.desc("confidence")])
    top = a.groupBy("edition_date").agg(F.max("revision").alias("newest"))
    a = a.join(top, "edition_date").where("revision >= newest - 1")
    by = a.groupBy(F.concat_ws("|", "edition_date", "category").alias("category"), F.col("event_id").alias("key")).agg(F.max_by("confidence", "revision").alias("score"), F.max(F.col("revision") < F.col("newest")).alias("was"))
    return D.hold(by.where("was").drop("was"), by.where("not was").drop("was"), "category", 3)


QUERIES = {f.__name__: f for f in (event_timeline, edition_diff, edition_ranks, section_groups, section_topk, story_lineage, evidence_strength, publisher_breakdown, shared_reports, event_identity, profile_fold, continuity_check, stale_events, candidate_window, timeline_entries, edition_churn, rank_moves, what_changed, same_topic_links, pair_checks, deduplicated_editions, primary_reports, story_publishers, archive_index, front_page, stable_event_ids, quality_checks, edition_selection, hysteresis)}

_A = "a0 as (select event_id, category, unnest(appearances) x from registry_events), a as (select event_id, category, x.edition_date edition_date, x.revision revision, x.seen_utc seen_utc, x.rank as rnk, x.confidence confidence from a0 qualify row_number() over (partition by event_id, x.edition_date order by x.revision desc, x.seen_utc desc, x.rank) = 1)"
_HOST = "regexp_replace(lower(regexp_extract(report, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
_R = "r as (select event_id, unnest(reports) report, unnest(range(len(reports))) ref from registry_events)"
_HEADS = f"h as (select event_id, unnest({Q.significant_tokens('headline')}) t, len({Q.significant_tokens('headline')}) n from registry_events where headline is not null), hp as (select x.event_id a, y.event_id b, count(*) shared, any_value(x.n) na, any_value(y.n) nb from h x join h y on x.t = y.t and x.event_id < y.event_id group by all)"
_ENTRIES = "n0 as (select event_id, unnest(appearances) x from registry_events), n1 as (select event_id, x.edition_date edition_date, x.revision::bigint revision, x.rank::bigint rnk, x.tier tier from n0 qualify row_number() over (partition by event_id, x.edition_date, x.revision order by x.seen_utc desc, x.rank) = 1), n as (select event_id, edition_date, revision, rnk \"rank\", tier, row_number() over (partition by event_id order by edition_date desc, revision desc)::bigint entry from n1)"
_SLUG = "regexp_extract(report, '/([^/?#]+)/?(?:[?#].*)?$', 1)"

SQL = {
    "event_timeline": f"with {_A} select event_id, min(edition_date) first_date, max(edition_date) last_date, count(*) editions, min(rnk)::bigint best_rank, case when max(seen_utc) < (select max(seen_utc) from a) - interval 14 days then 'archived' else 'developing' end status from a group by event_id",
    "edition_diff": f"with {_A}, d as (select edition_date, row_number() over (order by edition_date) n from (select distinct edition_date from a)), w as (select event_id, n, rnk from a join d using (edition_date)), p as (select event_id, n + 1 n, rnk from w where n < (select max(n) from d)), j as (select coalesce(p.n, w.n) n, case when p.event_id is null then 'new' when w.event_id is null then 'gone' when p.rnk is distinct from w.rnk then 'changed' else 'same' end kind from p full join w on p.event_id = w.event_id and p.n = w.n) select edition_date, kind, count(*) stories from j join d using (n) where n > 1 group by all",
    "edition_ranks": f"with {_A} select edition_date, event_id, row_number() over (partition by edition_date order by rnk, event_id)::bigint place from a",
    "section_groups": f"with {_A}, s as (select edition_date, rnk, case when count(*) over (partition by edition_date, category) < 3 then 'Also today' else coalesce(category, 'Also today') end section from a) select edition_date, section, count(*) stories, min(rnk)::bigint lead from s group by all",
    "section_topk": f"with {_A} select category, event_id, edition_date, rn::bigint place from (select *, row_number() over (partition by category order by confidence desc, rnk, event_id, edition_date) rn from a) where rn <= 10",
    "story_lineage": f"with {_A}, d as (select event_id, datediff('day', date '1970-01-01', edition_date::date) dy from a), g as (select event_id, dy, dy - row_number() over (partition by event_id order by dy) k from d) select event_id, min(dy)::bigint \"first\", max(dy)::bigint \"last\", count(*) length from g group by event_id, k",
    "evidence_strength": f"""with recursive {_R}, it as (select {Q.canonical_url('url')} u, min(source) source from raw_items where url is not null group by 1), fh as (select host, min(channel) channel from feeds group by host),
  e0 as (select event_id, ref, case when not starts_with(report, 't:') then {Q.host('report')} end outlet, case when starts_with(report, 't:') then report else regexp_replace({_SLUG}, '-[0-9a-f]+$', '') end title_key, case when not starts_with(report, 't:') then {Q.canonical_url('report')} end u from r),
  e as (select e0.*, coalesce(it.source in ({Q.listed(V.SIGNAL_SOURCES)}), false) signal, outlet is not null and outlet != '' counted, fh.channel from e0 left join it using (u) left join fh on fh.host = outlet),
  c as (select * from e where counted and not signal), l as (select distinct x.event_id, x.ref a, y.ref b from c x join c y on x.event_id = y.event_id and (x.outlet = y.outlet or (x.title_key = y.title_key and x.title_key != ''))),
  reach as (select event_id, a, b from l union select reach.event_id, reach.a, l.b from reach join l on l.event_id = reach.event_id and l.a = reach.b), o as (select event_id, a ref, min(b) origin from reach group by all),
  g as (select e.*, o.origin from e left join o using (event_id, ref)),
  s as (select event_id, count(distinct origin) filter (counted and not signal) independent, count(*) filter (counted and not signal) reports, count(*) filter (signal) signals, count(distinct channel) filter (not signal) channels from g group by event_id),
  w as (select s.*, (floor(epoch((select max(last_seen_utc) from registry_events))) - floor(epoch(last_seen_utc))) / 3600 age from s join registry_events using (event_id)),
  p as (select *, (case when independent < 2 then 0 when independent < 4 then independent else 4 end + (channels >= 2)::int + (age <= 24)::int)::bigint points from w)
  select event_id, independent, reports, reports - independent repeats, signals, channels, round(age, 4) age_hours, points, case when independent < 2 then 'limited' when points >= 5 then 'strong' else 'moderate' end level from p""",
    "timeline_entries": f"with {_ENTRIES} select * from n",
    "edition_churn": f"with {_A}, d as (select edition_date, row_number() over (order by edition_date) n from (select distinct edition_date from a)), w as (select event_id, n from a join d using (edition_date)), p as (select event_id, n + 1 n from w where n < (select max(n) from d)), j as (select coalesce(p.n, w.n) n, p.event_id x, w.event_id y from p full join w on p.event_id = w.event_id and p.n = w.n), k as (select n, count(*) filter (x is not null and y is not null) kept, count(*) filter (x is null) \"new\", count(*) filter (y is null) gone from j where n > 1 group by n) select edition_date, kept, \"new\", gone, round(kept / greatest(1, kept + gone), 6) carried from k join d using (n)",
    "rank_moves": f"with {_A}, m as (select event_id, edition_date, rnk, confidence, lag(rnk) over w was, lag(confidence) over w had, lag(edition_date) over w bef from a window w as (partition by event_id order by edition_date)), k as (select event_id, edition_date, case when confidence >= 1.5::double * had then 'stronger' when had >= 1.5::double * confidence then 'weaker' when was - rnk >= 2 then 'up' when rnk - was >= 2 then 'down' end kind from m where bef is not null) select * from k where kind is not null",
    "what_changed": f"with {_ENTRIES} select x.event_id, case when y.rank is null then 'First reported.' when x.rank < y.rank then 'Up from place ' || y.rank || ' to ' || x.rank || ' since ' || y.edition_date || '.' when x.rank > y.rank then 'Down from place ' || y.rank || ' to ' || x.rank || ' since ' || y.edition_date || '.' else 'No significant new developments.' end text from n x left join n y on y.event_id = x.event_id and y.entry = 2 where x.entry = 1",
    "same_topic_links": f"with {_HEADS}, l as (select a, b from hp where shared >= 2 and shared >= 0.6 * least(na, nb)) select event_id, count(*) links from (select a event_id from l union all select b from l) group by 1",
    "pair_checks": f"with {_A}, {_HEADS} select x.edition_date, a, b from hp join a x on x.event_id = hp.a join a y on y.event_id = hp.b and y.edition_date = x.edition_date where round(shared / (na + nb - shared), 6) >= 0.5",
    "primary_reports": f"with {_R}, w as (select r.event_id, ref, report, len(list_intersect({Q.stems('headline')}, {Q.stems(f'replace({_SLUG}, {chr(39)}-{chr(39)}, {chr(39)} {chr(39)})')})) n from r join registry_events using (event_id) where headline is not null and not starts_with(report, 't:')) select event_id, report, n::bigint stems from w qualify row_number() over (partition by event_id order by n desc, ref) = 1",
    "story_publishers": f"with {_R}, h as (select event_id, {Q.host('report')} host, min(ref) ref from r where not starts_with(report, 't:') group by 1, 2), k as (select *, row_number() over (partition by event_id order by ref, host) n from h) select event_id, string_agg(host, ', ' order by n) filter (n <= 3) hosts, greatest(count(*) - 3, 0) more from k group by event_id",
    "archive_index": "with a0 as (select event_id, unnest(appearances) x from registry_events), a as (select event_id, x.edition_date d, x.revision r, x.rank k from a0), t as (select * from a qualify r = max(r) over (partition by d)), g as (select d, any_value(r)::bigint r, count(distinct event_id) n, arg_min(event_id, {'k': k, 'e': event_id}) lead from t group by d) select d edition_date, r revision, n stories, lead, row_number() over (order by d desc)::bigint place from g",
    "front_page": f"with {_A}, n as (select *, row_number() over (partition by edition_date order by rnk, event_id) n from a) select edition_date, coalesce(category, '-') section, count(*) filter (n <= 10) top, count(*) filter (n > 10) below, count(*) filter (n > 10) = 0 link_only from n group by all",
    "stable_event_ids": "with e as (select event_id, strftime(first_seen_utc, '%Y-%m-%d') d, unnest(case when cardinality(name_counts) > 0 then map_entries(name_counts) else [null] end) t from registry_events), x as (select event_id, d, t.key k from e qualify row_number() over (partition by event_id order by t.value desc nulls last, t.key) = 1), i as (select event_id, 'evt_' || substr(sha1(concat_ws('|', lower(k), d)), 1, 12) s from x) select s stable_id, count(*) events, min(event_id) first_event from i group by s",
    "quality_checks": f"""with {_A}, n as (select *, row_number() over (partition by edition_date order by rnk, event_id) place, count(*) over (partition by edition_date, rnk) same from a),
  c as (select unnest([{{'t': 'blocking', 'c': 'rank_taken_twice', 'b': same > 1}}, {{'t': 'notice', 'c': 'rank_gap', 'b': rnk != place}}, {{'t': 'warning', 'c': 'no_category', 'b': category is null}}, {{'t': 'warning', 'c': 'low_confidence', 'b': coalesce(confidence < 0.5, true)}}]) x from n
  union all select unnest([{{'t': 'blocking', 'c': 'no_headline', 'b': coalesce(trim(headline) = '', true)}}, {{'t': 'blocking', 'c': 'no_reports', 'b': coalesce(len(reports) < 1, true)}}, {{'t': 'warning', 'c': 'repeated_report', 'b': coalesce(len(reports) > len(list_distinct(reports)), false)}}, {{'t': 'warning', 'c': 'seen_out_of_order', 'b': last_seen_utc < first_seen_utc}}, {{'t': 'notice', 'c': 'one_appearance', 'b': coalesce(len(appearances) = 1, false)}}, {{'t': 'blocking', 'c': 'bad_event_id', 'b': not regexp_matches(event_id, '^ev-[0-9]{{8}}-[0-9a-f]{{8}}$')}}]) from registry_events)
  select x.t tier, x.c \"check\", count(*) looked_at, count(*) filter (x.b) found from c group by all""",
    "publisher_breakdown": f"with {_R}, h as (select event_id, {_HOST} host from r where not starts_with(report, 't:')), b as (select host, count(distinct event_id) stories, count(*) articles from h group by host), f as (select host, count(distinct channel) channels, min(publisher) publisher from feeds group by host) select b.host, publisher, stories, articles, coalesce(channels, 0) channels from b left join f using (host)",
    "shared_reports": f"with {_R}, k as (select distinct event_id, case when starts_with(report, 't:') then report else {_HOST} || regexp_replace(regexp_extract(report, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') end as key from r) select key, count(*) events, min(event_id) first_event from k group by key having count(*) > 1",
    "event_identity": "select event_id, substr(sha1(array_to_string(list_sort(map_keys(name_counts)), '|')), 1, 12) entity_id, substr(sha256(array_to_string(list_sort(list_distinct(reports)), '|')), 1, 20) fingerprint from registry_events",
    "profile_fold": "with t as (select event_id, len(appearances) n, unnest(map_entries(tokens)) e from registry_events), w as (select event_id, e.key token, round(e.value * (1 - pow(0.7::double, n)) / 0.3::double, 6) weight from t) select event_id, token, weight from (select *, row_number() over (partition by event_id order by weight desc, token) rn from w) where rn <= 120",
    "continuity_check": f"with t as (select event_id, unnest(s) t, len(s) n from (select event_id, {Q.stems('headline')} s from registry_events where headline is not null)), p as (select x.event_id a, y.event_id b, x.n na, y.n nb, count(*) shared from t x join t y on x.t = y.t and x.event_id < y.event_id group by all) select a, b, shared, round(shared / (na + nb - shared), 6) jaccard from p where round(shared / (na + nb - shared), 6) >= 0.6",
    "stale_events": "select event_id, coalesce(category, '-') category, last_seen_utc < max(last_seen_utc) over (partition by coalesce(category, '-')) - interval 48 hours stale from registry_events",
    "candidate_window": f"with {_A}, d as (select distinct edition_date::date d from a) select strftime(d, '%Y-%m-%d') edition_date, count(*) candidates from d join registry_events e on e.last_seen_utc::date between d - 7 and d group by d",
}
