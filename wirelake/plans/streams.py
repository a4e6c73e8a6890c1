"""The tables as streams: results after all files are in are those of the same query over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelake.plans.runs import _OUT, _grid
from wirelake.session import new_path, stage, table
from wirelake.streaming import streams as T


def _events(spark, sf_dir):
    like = spark.read.parquet(f"{sf_dir}/events.parquet")
    return T.source(spark, f"{sf_dir}/events.parquet", like).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_tumbling_counts(spark, sf_dir):
    """Events an hour and type, of the hours that events ten minutes late can't change any more."""
    return T.run(T.tumbling(_events(spark, sf_dir), "ts", ["event_type"], "1 hour", "10 minutes"), "tumbling")


def stream_sessions(spark, sf_dir):
    """Sessions of users, half an hour apart, that are over."""
    return T.run(T.sessions(_events(spark, sf_dir), "ts", "user_id", "30 minutes", "10 minutes"), "sessions")


def stream_first_hashes(spark, sf_dir):
    """Content hashes as they first come."""
    like = table(spark, sf_dir, "raw_items")
    raw = T.source(spark, f"{sf_dir}/raw_items.parquet", like).where("content_hash is not null").select(F.lower("content_hash").alias("hash"), F.timestamp_seconds("captured_at").alias("at"))
    return T.run(T.first_seen(raw, "at", "hash", "400 days"), "hashes").select("hash")


def stream_feed_streaks(spark, sf_dir):
    """Each feed's failures in a row, kept as state over runs that come in three batches."""
    runs = table(spark, sf_dir, "runs").select("run_id", "started_at")
    enabled = table(spark, sf_dir, "feeds").where("enabled").select("feed", "channel")
    seen = table(spark, sf_dir, "raw_items").where("feed is not null").select("feed", "run_id").distinct().withColumn("ok", F.lit(True))
    at = enabled.join(_grid(spark, sf_dir).where(f"not ({_OUT})").select("run_id", "channel").join(runs, "run_id"), "channel").join(seen, ["feed", "run_id"], "left")
    rows = stage(at.select("feed", F.col("started_at").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok")), "outcomes")
    third = rows.agg(F.percentile_approx("at", [0.33, 0.66]).alias("p")).first().p or [0.0, 0.0]
    path = new_path(spark, "stream")
    # one file a batch, in the order of the runs
    cuts = [rows.where(F.col("at") <= third[0]), rows.where((F.col("at") > third[0]) & (F.col("at") <= third[1])), rows.where(F.col("at") > third[1])]
    for c in cuts:
        c.coalesce(1).write.mode("append").parquet(path)
    out = T.latest(T.streaks(T.source(spark, path, rows, files=1), "feed"), "feed", "last", "streaks")
    return out.where("failures > 0").select("feed", "failures", "since")


def stream_run_totals(spark, sf_dir):
    """Items a run, merged batch by batch; a batch that comes twice counts once."""
    raw = T.source(spark, f"{sf_dir}/raw_items.parquet", table(spark, sf_dir, "raw_items"))
    totals = T.Totals(spark, "run_id")

    def twice(batch, number):
        totals.apply(batch, number)
        totals.apply(batch, number)

    T.merge_batches(raw.select("run_id"), twice, totals.path)
    return totals.read()


QUERIES = {f.__name__: f for f in (stream_tumbling_counts, stream_sessions, stream_first_hashes, stream_feed_streaks, stream_run_totals)}


SQL = {
    "stream_tumbling_counts": f"select time_bucket(interval '1 hour', ts) at time zone 'UTC' \"start\", (time_bucket(interval '1 hour', ts) + interval '1 hour') at time zone 'UTC' \"end\", event_type, count(*) n from events group by all having time_bucket(interval '1 hour', any_value(ts)) + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)",
    "stream_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g), w as (select user_id, min(ts) a, max(ts) + interval '30 minutes' z, count(*) n from s group by user_id, k) select user_id, a at time zone 'UTC' \"start\", z at time zone 'UTC' \"end\", n from w where z <= (select max(ts) - interval '10 minutes' from events)",
    "stream_first_hashes": "select distinct lower(content_hash) hash from raw_items where content_hash is not null",
    "stream_run_totals": "select run_id, count(*) n from raw_items group by run_id",
}
from wirelake.plans.runs import SQL as _RUNS  # noqa: E402

SQL["stream_feed_streaks"] = f"select feed, failures, since from ({_RUNS['failing_feeds']})"
