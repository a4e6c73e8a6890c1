"""Runs, momentum, source health, feed streaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirelake.operators import series as S
from wirelake.session import table

#: Look-back windows in hours and their weights.
WINDOWS = {96.0: 0.5, 168.0: 0.3, 336.0: 0.2}


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "runs").where("status = 'valid' and finished_at is not null")


def nearest_reference_run(spark, sf_dir):
    return S.nearest_runs(_runs(spark, sf_dir).select("run_id", "started_at"), WINDOWS).select("run_id", "hours", "ref_id", F.round("off", 3).alias("off"))


def run_lifecycle(spark, sf_dir):
    """Runs by status with their mean length, and how many have ended."""
    r = table(spark, sf_dir, "runs")
    return r.groupBy("status", "llm_mode").agg(F.count("*").alias("runs"), F.count("finished_at").alias("ended"), F.round(F.avg("exec_seconds"), 4).alias("mean_seconds"), F.sum("ingested").cast("bigint").alias("ingested"))


def cluster_history(spark, sf_dir):
    """The newest 20 valid runs and their counts."""
    return _runs(spark, sf_dir).orderBy(F.desc("started_at"), "run_id").limit(20).select("run_id", F.col("cluster_count").cast("bigint").alias("clusters"), F.col("filtered").cast("bigint").alias("filtered"))


def retained_runs(spark, sf_dir):
    """Runs that retention keeps: those within 120 days of the newest, and the newest valid one always."""
    r = table(spark, sf_dir, "runs")
    edge = r.agg((F.max("started_at") - 120 * 86400).alias("edge"), F.max(F.when(F.col("status") == "valid", F.col("started_at"))).alias("newest"))
    return r.join(F.broadcast(edge)).where("started_at >= edge or started_at = newest").select("run_id", "status")


def comparable_sources(spark, sf_dir):
    """For each run and reference: sources seen in both, in either, and whether coverage changed by more than a quarter."""
    refs = S.nearest_runs(_runs(spark, sf_dir).select("run_id", "started_at"), WINDOWS).select("run_id", "ref_id")
    seen = table(spark, sf_dir, "raw_items").groupBy("run_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    j = refs.join(seen, "run_id").join(seen.select(F.col("run_id").alias("ref_id"), F.col("sources").alias("before")), "ref_id")
    both, either = F.size(F.array_intersect("sources", "before")), F.size(F.array_union("sources", "before"))
    return j.select("run_id", "ref_id", both.cast("bigint").alias("in_both"), either.cast("bigint").alias("in_either"), (1 - both / either > 0.25).alias("uncertain"))


def source_balanced_momentum(spark, sf_dir):
    """Velocity and momentum of every category of a run: mean over comparable sources of mentions per 100 titles, against references."""
    raw = table(spark, sf_dir, "raw_items").where("category_hint is not null")
    per = raw.groupBy("run_id", "source", F.col("category_hint").alias("entity")).agg(F.count("*").alias("n"))
    total = table(spark, sf_dir, "raw_items").groupBy("run_id", "source").agg(F.count("*").alias("titles"))
    refs = S.nearest_runs(_runs(spark, sf_dir).select("run_id", "started_at"), WINDOWS).select("run_id", "hours", "ref_id")
    both = refs.join(total, "run_id").join(total.select(F.col("run_id").alias("ref_id"), "source", F.col("titles").alias("titles_before")), ["ref_id", "source"])
    named = per.select("run_id", "entity").distinct()
    grid = both.join(named, "run_id").join(per, ["run_id", "source", "entity"], "left").join(
        per.select(F.col("run_id").alias("ref_id"), "source", "entity", F.col("n").alias("n_before")), ["ref_id", "source", "entity"], "left"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rates = grid.groupBy("run_id", "entity", "hours").agg(
        F.avg(100.0 * zero("n") / F.col("titles")).alias("now"), F.avg(100.0 * zero("n_before") / F.col("titles_before")).alias("base"), F.avg(100.0 / F.col("titles_before")).alias("floor")
    )
    signal = F.tanh(2 * (F.col("now") - F.col("base")) / F.greatest("base", "floor"))
    weight = F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv])[F.col("hours")]
    v = rates.groupBy("run_id", "entity").agg((50 + 50 * F.sum(weight * signal) / F.sum(weight)).alias("velocity"), ((F.max("base") == 0) & (F.max("now") > 0)).alias("is_new"))
    v = v.withColumn("velocity", F.round("velocity", 4))
    return v.select("run_id", "entity", "velocity", S.momentum(F.col("velocity"), F.col("is_new")).alias("momentum"))


def entity_snapshot_upsert(spark, sf_dir):
    """Snapshots of categories by run; a second snapshot of the same key keeps the larger figures."""
    raw = table(spark, sf_dir, "raw_items").where("category_hint is not null")
    one = raw.groupBy("run_id", "category_hint").agg(F.count("*").alias("frequency"))
    two = raw.where("kept = 1").groupBy("run_id", "category_hint").agg((2 * F.count("*")).alias("frequency"))
    return one.unionByName(two).groupBy("run_id", "category_hint").agg(F.max("frequency").alias("frequency"))


def source_health(spark, sf_dir):
    """For each feed: runs with items, items, kept share, and its state against all runs."""
    runs = table(spark, sf_dir, "runs").agg(F.count("*").alias("runs"))
    used = table(spark, sf_dir, "raw_items").where("feed is not null").groupBy("feed").agg(F.count_distinct("run_id").alias("seen"), F.count("*").alias("items"), F.round(F.avg(F.coalesce("kept", F.lit(0)).cast("double")), 6).alias("kept_share"))
    feeds = table(spark, sf_dir, "feeds").select("feed", "channel", "enabled")
    j = feeds.join(used, "feed", "left").join(F.broadcast(runs))
    state = F.when(~F.col("enabled"), "off").when(F.col("seen").isNull(), "failed").when(F.col("seen") * 2 < F.col("runs"), "partial").otherwise("ok")
    return j.select("feed", "channel", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("items", F.lit(0)).alias("items"), "kept_share", state.alias("state"))


def coverage_block(spark, sf_dir):
    """By run: sources and feeds that delivered, the largest source's share, and whether the run is balanced."""
    by = table(spark, sf_dir, "raw_items").groupBy("run_id", "source").agg(F.count("*").alias("n"), F.count_distinct("feed").alias("feeds"))
    out = by.groupBy("run_id").agg(F.count("*").alias("sources"), F.sum("feeds").alias("feeds"), F.round(F.max("n") / F.sum("n"), 6).alias("largest"))
    return out.withColumn("balanced", F.col("largest") <= 0.9)


def feed_failure_streak(spark, sf_dir):
    """The longest stretch of runs without an item of a feed, between its appearances and up to the newest run."""
    order = S.numbered(table(spark, sf_dir, "runs").select("run_id", "started_at"), "started_at", "run_id").drop("started_at")
    seen = table(spark, sf_dir, "raw_items").where("feed is not null").select("feed", "run_id").distinct().join(order, "run_id")
    last = order.agg(F.max("i").alias("n"))
    w = Window.partitionBy("feed").orderBy("i")
    gaps = seen.withColumn("gap", F.col("i") - F.lag("i", 1, 0).over(w) - 1)
    out = gaps.groupBy("feed").agg(F.max("gap").alias("longest"), F.max("i").alias("newest")).join(F.broadcast(last))
    return out.select("feed", F.greatest("longest", F.col("n") - F.col("newest")).cast("bigint").alias("longest"), (F.col("n") - F.col("newest") >= 2).alias("failing"))


def unbroken_presence(spark, sf_dir):
    """Unbroken stretches of runs in which a source delivered."""
    order = S.numbered(table(spark, sf_dir, "runs").select("run_id", "started_at"), "started_at", "run_id").drop("started_at")
    rows = table(spark, sf_dir, "raw_items").select("source", "run_id").distinct().join(order, "run_id")
    return S.islands(rows, "source", "i").select("source", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "length")


def _grid(spark, sf_dir):
    """For every run and channel its enabled feeds and how many of them delivered, channels that delivered nothing included."""
    enabled = table(spark, sf_dir, "feeds").where("enabled")
    feeds = enabled.groupBy("channel").agg(F.count("*").alias("feeds"))
    ok = table(spark, sf_dir, "raw_items").join(enabled.select("feed", "channel"), "feed").groupBy("run_id", "channel").agg(F.count_distinct("feed").alias("ok"))
    grid = table(spark, sf_dir, "runs").select("run_id", F.explode(F.array(*[F.lit(c.channel) for c in feeds.select("channel").collect()] or [F.lit(None).cast("string")])).alias("channel"))  # one entry a channel
    return grid.join(feeds, "channel").join(ok, ["run_id", "channel"], "left").na.fill(0, ["ok"])


_OUT = "ok = 0 or (feeds >= 5 and ok < 0.2 * feeds)"


def outage_runs(spark, sf_dir):
    """Channels of a run where no feed delivered, or fewer than a fifth of five or more enabled ones."""
    return _grid(spark, sf_dir).select("run_id", "channel", "ok", "feeds", F.expr(_OUT).alias("outage"))


def coverage_states(spark, sf_dir):
    """By run how many channels delivered in full, in part and not at all, and the names of the failed ones."""
    g = _grid(spark, sf_dir)
    return g.groupBy("run_id").agg(
        F.count_if(F.expr("ok = feeds")).alias("full"), F.count_if(F.expr("ok > 0 and ok < feeds")).alias("partial"), F.count_if(F.expr("ok = 0")).alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok") == 0, F.col("channel")))), ", ").alias("failed_names"),  # one entry a channel
    )


def failing_feeds(spark, sf_dir):
    """Each enabled feed's failures in a row up to the newest run and since when, runs in which its channel was out left aside.

    Flagged are two failures or more over three days or more.
    """
    runs = table(spark, sf_dir, "runs").select("run_id", "started_at")
    enabled = table(spark, sf_dir, "feeds").where("enabled").select("feed", "channel")
    counted = _grid(spark, sf_dir).where(f"not ({_OUT})").select("run_id", "channel").join(runs, "run_id")
    seen = table(spark, sf_dir, "raw_items").where("feed is not null").select("feed", "run_id").distinct().withColumn("seen", F.lit(True))
    at = enabled.join(counted, "channel").join(seen, ["feed", "run_id"], "left")
    last = at.groupBy("feed").agg(F.max(F.when(F.col("seen"), F.col("started_at"))).alias("last_ok"), F.max("started_at").alias("newest"))
    bad = at.where("seen is null").join(last, "feed").where("last_ok is null or started_at > last_ok")
    out = bad.groupBy("feed").agg(F.count("*").alias("failures"), F.min("started_at").alias("since"), F.max("newest").alias("newest"))
    return out.select("feed", "failures", "since", ((F.col("failures") >= 2) & (F.col("newest") - F.col("since") >= 3 * 86400)).alias("failing"))


def retention_cascade(spark, sf_dir):
    """What retention would delete with each dropped run: its items and the urls that no kept run has."""
    raw = table(spark, sf_dir, "raw_items").select("run_id", "url")
    kept = retained_runs(spark, sf_dir).select("run_id")
    gone = raw.join(kept, "run_id", "left_anti")
    only = gone.where("url is not null").select("run_id", "url").distinct().join(raw.join(kept, "run_id").select("url").distinct(), "url", "left_anti")
    return gone.groupBy("run_id").agg(F.count("*").alias("items")).join(only.groupBy("run_id").agg(F.count("*").alias("last_urls")), "run_id", "left").na.fill(0, ["last_urls"])


def run_checks(spark, sf_dir):
    """Runs that break a rule of their life: ended without an end or before their start, more clusters or filtered items than items."""
    r = table(spark, sf_dir, "runs")
    rules = {"ended_without_end": "status != 'unknown' and finished_at is null", "ends_before_start": "finished_at < started_at", "more_filtered_than_ingested": "filtered > ingested", "more_clusters_than_kept": "cluster_count > ingested - filtered", "no_length": "finished_at is not null and exec_seconds is null"}
    return r.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.expr(e), F.lit(False)).alias("broken")) for k, e in rules.items()]))).groupBy("rule").agg(F.count("*").alias("runs"), F.count_if("broken").alias("broken"))


def backoff(spark, sf_dir):
    """Delay before the next attempt after each stretch of runs that are not valid: half an hour, doubled, six hours at most."""
    r = S.numbered(table(spark, sf_dir, "runs").select("run_id", "started_at", (F.col("status") != "valid").alias("bad")), "started_at", "run_id")
    bad = S.numbered(r.where("bad").select("run_id", "i"), "i", name="k").withColumn("island", F.col("i") - F.col("k"))
    first = bad.groupBy("island").agg(F.min("i").alias("first"))
    n = bad.join(first, "island").select("run_id", (F.col("i") - F.col("first") + 1).alias("n"))
    n = r.select("run_id").join(n, "run_id", "left").select("run_id", F.coalesce("n", F.lit(0)).alias("n"))
    return n.select("run_id", F.col("n").cast("bigint").alias("failures"), F.when(F.col("n") > 0, F.least(F.lit(360.0), 30 * F.pow(F.lit(2.0), F.col("n") - 1))).otherwise(0.0).alias("minutes"))


QUERIES = {f.__name__: f for f in (nearest_reference_run, run_lifecycle, cluster_history, retained_runs, comparable_sources, source_balanced_momentum, entity_snapshot_upsert, source_health, coverage_block, feed_failure_streak, unbroken_presence, outage_runs, coverage_states, failing_feeds, retention_cascade, run_checks, backoff)}

_W = ", ".join(f"({h}::double, {w}::double)" for h, w in WINDOWS.items())
_REFS = f"""v as (select run_id, started_at s from runs where status = 'valid' and finished_at is not null), w(hours, weight) as (values {_W}),
  c as (select a.run_id, hours, b.run_id ref_id, abs(b.s - (a.s - hours * 3600)) off from v a, w, v b where b.run_id != a.run_id and abs(b.s - (a.s - hours * 3600)) <= hours * 1800),
  c1 as (select *, row_number() over (partition by run_id, hours order by off, ref_id) r1 from c), c2 as (select * from c1 where r1 = 1),
  refs as (select run_id, hours, ref_id, off from (select *, row_number() over (partition by run_id, ref_id order by hours) r2 from c2) where r2 = 1)"""
_GRID = "f as (select channel, count(*) feeds from feeds where enabled group by channel), k as (select run_id, channel, count(distinct feed) ok from raw_items join (select feed, channel from feeds where enabled) using (feed) group by all), g as (select r.run_id, f.channel, coalesce(ok, 0) ok, feeds from runs r cross join f left join k on k.run_id = r.run_id and k.channel = f.channel)"
_ORDER = "o as (select run_id, row_number() over (order by started_at, run_id) i from runs)"
SQL = {
    "nearest_reference_run": f"with {_REFS} select run_id, hours, ref_id, round(off, 3) off from refs",
    "run_lifecycle": "select status, llm_mode, count(*) runs, count(finished_at) ended, round(avg(exec_seconds), 4) mean_seconds, sum(ingested)::bigint ingested from runs group by all",
    "cluster_history": "select run_id, cluster_count::bigint clusters, filtered::bigint filtered from runs where status = 'valid' and finished_at is not null order by started_at desc, run_id limit 20",
    "retained_runs": "select run_id, status from runs where started_at >= (select max(started_at) - 120 * 86400 from runs) or started_at = (select max(started_at) from runs where status = 'valid')",
    "comparable_sources": f"with {_REFS}, s as (select run_id, list_distinct(list(source)) l from raw_items group by run_id) select r.run_id, r.ref_id, len(list_intersect(a.l, b.l))::bigint in_both, len(list_distinct(list_concat(a.l, b.l)))::bigint in_either, 1 - len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) > 0.25 uncertain from refs r join s a on a.run_id = r.run_id join s b on b.run_id = r.ref_id",
    "source_balanced_momentum": f"""with {_REFS}, per as (select run_id, source, category_hint entity, count(*) n from raw_items where category_hint is not null group by all), tot as (select run_id, source, count(*) titles from raw_items group by all),
  g as (select r.run_id, r.hours, e.entity, 100.0::double * coalesce(p.n, 0) / a.titles now, 100.0::double * coalesce(q.n, 0) / b.titles base, 100.0::double / b.titles flr from refs r join tot a on a.run_id = r.run_id join tot b on b.run_id = r.ref_id and b.source = a.source
    join (select distinct run_id, entity from per) e on e.run_id = r.run_id left join per p on p.run_id = r.run_id and p.source = a.source and p.entity = e.entity left join per q on q.run_id = r.ref_id and q.source = a.source and q.entity = e.entity),
  m as (select run_id, entity, hours, avg(now) now, avg(base) base, avg(flr) flr from g group by all),
  v2 as (select run_id, entity, round(50 + 50 * sum(weight * tanh(2 * (now - base) / greatest(base, flr))) / sum(weight), 4) velocity, max(base) = 0 and max(now) > 0 is_new from m join w using (hours) group by run_id, entity)
  select run_id, entity, velocity, case when velocity is null then 'BASELINE' when is_new then 'NEW' when velocity >= 75 then 'SURGING' when velocity >= 60 then 'RISING' when velocity > 40 then 'STEADY' when velocity >= 25 then 'COOLING' else 'FADING' end momentum from v2""",
    "entity_snapshot_upsert": "select run_id, category_hint, greatest(count(*), coalesce(2 * sum((kept = 1)::bigint), 0))::bigint frequency from raw_items where category_hint is not null group by all",
    "source_health": "select f.feed, f.channel, coalesce(seen, 0) seen, coalesce(items, 0) items, kept_share, case when not enabled then 'off' when seen is null then 'failed' when seen * 2 < (select count(*) from runs) then 'partial' else 'ok' end state from feeds f left join (select feed, count(distinct run_id) seen, count(*) items, round(avg(coalesce(kept, 0)::double), 6) kept_share from raw_items where feed is not null group by feed) u using (feed)",
    "coverage_block": "select run_id, count(*) sources, sum(feeds)::bigint feeds, round(max(n) / sum(n), 6) largest, round(max(n) / sum(n), 6) <= 0.9 balanced from (select run_id, source, count(*) n, count(distinct feed) feeds from raw_items group by all) group by run_id",
    "feed_failure_streak": f"with {_ORDER}, s as (select distinct feed, run_id from raw_items where feed is not null), g as (select feed, i, i - lag(i, 1, 0) over (partition by feed order by i) - 1 gap from s join o using (run_id)), n as (select max(i) n from o) select feed, greatest(max(gap), any_value(n) - max(i))::bigint longest, any_value(n) - max(i) >= 2 failing from g, n group by feed",
    "unbroken_presence": f"with {_ORDER}, s as (select distinct source, i from raw_items join o using (run_id)), g as (select source, i, i - row_number() over (partition by source order by i) k from s) select source, min(i)::bigint \"first\", max(i)::bigint \"last\", count(*) length from g group by source, k",
    "coverage_states": f"with {_GRID} select run_id, count(*) filter (ok = feeds) \"full\", count(*) filter (ok > 0 and ok < feeds) partial, count(*) filter (ok = 0) failed, coalesce(string_agg(channel, ', ' order by channel) filter (ok = 0), '') failed_names from g group by run_id",
    "failing_feeds": f"with {_GRID}, c as (select run_id, channel, started_at from g join runs using (run_id) where not ({_OUT})), s as (select distinct feed, run_id from raw_items where feed is not null), t as (select f.feed, c.started_at, s.feed is not null seen from feeds f join c using (channel) left join s on s.feed = f.feed and s.run_id = c.run_id where f.enabled), l as (select feed, max(started_at) filter (seen) last_ok, max(started_at) newest from t group by feed) select t.feed, count(*) failures, min(started_at) since, count(*) >= 2 and max(newest) - min(started_at) >= 3 * 86400 failing from t join l on l.feed = t.feed where not seen and (last_ok is null or started_at > last_ok) group by t.feed",
    "retention_cascade": "with k as (select run_id from runs where started_at >= (select max(started_at) - 120 * 86400 from runs) or started_at = (select max(started_at) from runs where status = 'valid')), gone as (select * from raw_items where run_id not in (from k)), o as (select run_id, count(distinct url) n from gone where url is not null and url not in (select url from raw_items where url is not null and run_id in (from k)) group by run_id) select g.run_id, count(*) items, coalesce(any_value(o.n), 0) last_urls from gone g left join o on o.run_id = g.run_id group by g.run_id",
    "run_checks": "with c as (select unnest([{'r': 'ended_without_end', 'b': status != 'unknown' and finished_at is null}, {'r': 'ends_before_start', 'b': finished_at < started_at}, {'r': 'more_filtered_than_ingested', 'b': filtered > ingested}, {'r': 'more_clusters_than_kept', 'b': cluster_count > ingested - filtered}, {'r': 'no_length', 'b': finished_at is not null and exec_seconds is null}]) x from runs) select x.r \"rule\", count(*) runs, count(*) filter (coalesce(x.b, false)) broken from c group by 1",
    "outage_runs": f"with {_GRID} select run_id, channel, ok, feeds, {_OUT} outage from g",
    "backoff": "with a as (select run_id, status != 'valid' bad, row_number() over w i, started_at from runs window w as (order by started_at, run_id)), b as (select run_id, i - coalesce(max(case when not bad then i end) over (order by i), 0) n from a) select run_id, n::bigint failures, case when n > 0 then least(360.0::double, 30 * pow(2.0::double, n - 1)) else 0.0::double end \"minutes\" from b",
}
