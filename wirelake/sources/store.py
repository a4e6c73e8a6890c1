"""Tables as they are kept: partitioned appends, replaced partitions, editions with a pointer, differences only.

All folders are under the session's shared folder or one given by the caller. A write is visible as a whole: new files go to a
folder of their own and the pointer, the last thing written, names it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def append_partitioned(rows: DataFrame, path: str, by: str) -> None:
    """Append rows to a table partitioned by ``by``; one shuffle keeps it at a few files a partition."""
    rows.repartition(by).write.mode("append").partitionBy(by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that ``rows`` have and leave the others, as a monthly file is when one of its dates changes."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_partitions(spark: SparkSession, path: str, by: str, values: list[str]) -> None:
    """Delete whole partitions, as retention does."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in values:
        fs.delete(fs_path(f"{path}/{by}={v}"), True)


class Versions:
    """Revisions of a table under one folder: each write is a new one, the pointer lists them with their checksums."""

    SCHEMA = "name string, revision int, folder string, rows long, checksum long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def pointer(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/pointer")
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def checksum(rows: DataFrame) -> tuple[int, int]:
        """Rows and a sum of their hashes, whatever their order."""
        cols = [F.to_json(c) if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(c) for c in sorted(rows.columns)]
        r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)") % 1_000_000_007), F.lit(0)).cast("long").alias("s")).first()
        return r.n, r.s

    def publish(self, name: str, rows: DataFrame) -> int:
        """Write the next revision of ``name``; returns its number."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        n, s = self.checksum(self.spark.read.parquet(folder))
        revision = (self.pointer().where(F.col("name") == name).agg(F.max("revision")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, revision, folder, n, s)], self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")
        return revision

    def load(self, name: str, revision: int | None = None) -> DataFrame:
        """A revision, by default the newest whose data is as its checksum says: a damaged one is passed over."""
        known = self.pointer().where(F.col("name") == name).orderBy(F.desc("revision")).collect()  # revisions of one name
        for r in known:
            if revision is None or r.revision == revision:
                try:
                    rows = self.spark.read.parquet(r.folder)
                    if self.checksum(rows) == (r.rows, r.checksum):
                        return rows
                except AnalysisException:
                    pass
        raise LookupError(f"no sound revision of {name}")

    def purge(self, keep: int) -> None:
        """Delete all but the newest ``keep`` revisions of each name, never a name's newest sound one."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in [r.name for r in self.pointer().select("name").distinct().collect()]:
            rows = self.pointer().where(F.col("name") == name).orderBy(F.desc("revision")).collect()
            for r in rows[max(1, keep) :]:
                fs_path(r.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(fs_path(r.folder), True)


def differences(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or not the same as before, and keys that are gone: what has to be written."""
    cols = [c for c in after.columns if c not in key]
    j = before.select(*key, F.struct(*cols).alias("_old")).join(after.select(*key, F.struct(*cols).alias("_new")), key, "full")
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return j.withColumn("kind", kind).where("kind is not null").select(*key, "kind", "_new.*")
