"""Queries on time texts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.functions.times import TimeDictionary
from wirelake.session import table


#: Where each table's time text and feed are, and its key.
FIELDS = {
    "raw_items": ("id", True, "item_ts", "feed"),
    "trend_items": ("item_no", True, "item_timestamp", None),
    "cleaned_items": ("item_id", False, "published_at", None),
}


def time_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """tbl, id, text, zone, day_first of every record of a table with a time text."""
    key, plain, text, feed = FIELDS[name]
    rows = table(spark, sf_dir, name).select(
        F.lit(name).alias("tbl"), F.col(key).alias("id"), (F.col(text) if plain else F.col("metadata")[text]).alias("text"), (F.col(feed) if feed else F.col("metadata")["feed"]).alias("feed")
    )
    feeds = table(spark, sf_dir, "feeds").select("feed", F.col("zone_name").alias("zone"), "day_first").dropDuplicates(["feed"])
    return rows.where("text is not null and text != ''").join(feeds, "feed", "left").select("tbl", "id", "text", "zone", "day_first")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables as three batches of one dictionary: a text that an earlier one had is not parsed again."""
    known = TimeDictionary(spark)
    return functools.reduce(DataFrame.unionByName, [known.resolve(time_texts(spark, sf_dir, t)) for t in FIELDS]).select("tbl", "id", "utc_us")


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
