"""Streams over files: windowed counts, sessions, first sightings, keyed state, idempotent merges.

Each function takes a streaming table and gives one; ``run`` brings a stream to the end of what is there, from its checkpoint on, so
calling it again reads only new files. Append sinks hold what the watermark has closed and nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wirelake.session import new_path, nullable


def source(spark: SparkSession, path: str, like: DataFrame, files: int = 1000) -> DataFrame:
    """The file or files of ``path`` as a stream, with the schema of a table read from it; at most ``files`` of them at a time.

    A pattern that only the path fits is read, since a stream takes no single file by its name.
    """
    return spark.readStream.schema(nullable(like)).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Everything there is, appended to a table under ``at``, which is read back."""
    at = at or new_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(nullable(stream)).parquet(f"{at}/out")


def tumbling(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Events by window and ``by``, once a window can get no more events that are at most ``late`` behind."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Stretches of events of one key with no gap as long as ``gap``; those that the watermark has closed."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(events: DataFrame, time: str, key: str, within: str) -> DataFrame:
    """The first event of each key; a key is forgotten ``within`` of event time after it came, so the state is bounded."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def streaks(events: DataFrame, key: str) -> DataFrame:
    """(key, failures, since, last): failures in a row of each key after every batch; a success resets them.

    events: key string, at double, ok boolean. State is three numbers a key, whatever the number of events.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, since, last = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("at")
        for at, ok in zip(rows["at"], rows["ok"]):
            failures, since, last = (0, 0.0, at) if ok else (failures + 1, since if failures else at, at)
        state.update((failures, since, last))
        yield pd.DataFrame({key: [k[0]], "failures": [failures], "since": [since], "last": [last]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} string, failures long, since double, last double", "failures long, since double, last double", "update", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The last row that an update stream gave for each key; each batch is written once, however often it is tried."""
    at = new_path(stream.sparkSession, name)
    merge_batches(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/batch={i}"), at)
    rows = stream.sparkSession.read.parquet(at)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), F.struct("batch", order)).alias("r")).select(key, "r.*")


def merge_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], at: str) -> None:
    """``apply(batch, number)`` for all batches; applying a number again must change nothing."""
    stream.writeStream.foreachBatch(lambda b, i: apply(b, i)).option("checkpointLocation", f"{at}-checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()


class Totals:
    """Counts by key that grow with each batch, kept as one table a batch: a batch that comes again replaces its own counts."""

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key, self.path = spark, key, new_path(spark, "totals")

    def apply(self, batch: DataFrame, number: int) -> None:
        batch.groupBy(self.key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy(self.key).agg(F.sum("n").alias("n"))
