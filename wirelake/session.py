"""Session factory, table loading and lineage cuts.

Every intermediate table goes to the folder named by ``spark.checkpoint.dir``, which all executors of a cluster share, so a
lost executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_session(app: str = "wirelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, adaptive execution, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, so that they find it whatever their path is."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if os.path.isdir(os.path.join(root, "wirelake")):
            spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "wirelake"), "zip", root, "wirelake"))
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; zone-less timestamps are read as UTC instants."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: df[c].cast("timestamp") for c in ntz}) if ntz else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan of fewer partitions than there are cores, dealt out to all cores: for scans that feed costly expressions.

    A table of many files stays as it is; only small ones, which one task would work through alone, are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def workdir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` if set, else an own one, on local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="wirelake-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{workdir(spark)}/wirelake/{uuid.uuid4().hex}/{name}"


def nullable(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and lets several consumers share one computation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(nullable(df)).parquet(path)
    out._staged = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
