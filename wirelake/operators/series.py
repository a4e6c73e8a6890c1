"""Runs as a time series: reference runs, comparable sources, rates and momentum, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.session import stage


def nearest_runs(runs: DataFrame, windows: dict[float, float], tolerance: float = 0.5) -> DataFrame:
    """For each valid run and look-back the valid run closest to (start - hours), within the tolerance, each used once a run.

    runs: run_id, started_at. The range join is an equi-join on time buckets as wide as the largest slack, each reference being
    listed in its bucket and both neighbours, so no pair of distant runs is ever formed.
    """
    out = None
    for hours in windows:
        slack = hours * 3600 * tolerance
        want = runs.select("run_id", (F.col("started_at") - hours * 3600).alias("want")).withColumn("bucket", F.floor(F.col("want") / slack))
        refs = runs.select(F.col("run_id").alias("ref_id"), F.col("started_at").alias("ref_at"))
        refs = refs.withColumn("bucket", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col("ref_at") / slack) + i)))
        near = want.join(refs, "bucket").where((F.abs(F.col("ref_at") - F.col("want")) <= slack) & (F.col("ref_id") != F.col("run_id")))
        part = near.select("run_id", F.lit(float(hours)).alias("hours"), "ref_id", F.abs(F.col("ref_at") - F.col("want")).alias("off"))
        out = part if out is None else out.unionByName(part)
    best = F.row_number().over(Window.partitionBy("run_id", "hours").orderBy("off", "ref_id"))
    chosen = out.withColumn("rn", best).where("rn = 1").drop("rn")
    first = F.row_number().over(Window.partitionBy("run_id", "ref_id").orderBy("hours"))
    return chosen.withColumn("rn", first).where("rn = 1").drop("rn")


def momentum(velocity: Column, new: Column) -> Column:
    """The bucket of a velocity: thresholds 75, 60, 40 (exclusive) and 25."""
    return (
        F.when(velocity.isNull(), "BASELINE").when(new, "NEW").when(velocity >= 75, "SURGING").when(velocity >= 60, "RISING")
        .when(velocity > 40, "STEADY").when(velocity >= 25, "COOLING").otherwise("FADING")
    )


def islands(rows: DataFrame, by: str, order: str, step: int = 1) -> DataFrame:
    """Unbroken runs of an integer order within ``by``: first, last and length of each."""
    w = Window.partitionBy(by).orderBy(order)
    mark = rows.select(by, order).distinct().withColumn("island", F.col(order) - step * F.row_number().over(w))
    return mark.groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("island")


def numbered(rows: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task for all: ranges are numbered apart and offset by the counts before."""
    parts = stage(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_p", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_i", inside).join(offsets, "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")
