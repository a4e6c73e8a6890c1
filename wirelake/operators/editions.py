"""Editions and events over time: differences, selection under caps, hysteresis, evidence strength, timelines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelake.session import stage, unstage


def latest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def compare(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """new, gone, changed or same for every key of two keyed tables, null-safe: what a differences-only publication writes."""
    j = before.select(*key, F.col(value).alias("old"), F.lit(True).alias("was")).join(now.select(*key, F.col(value).alias("fresh"), F.lit(True).alias("is")), key, "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("fresh")), "changed").otherwise("same")
    return j.select(*key, "old", "fresh", kind.alias("kind"))


def evidence_groups(evidence: DataFrame, story: str) -> DataFrame:
    """Reporting origins inside each story: evidence with the same outlet or the same title key belongs together.

    evidence: story, ref (long, unique in its story), outlet, title_key. Labels spread by minima over outlets and titles until none
    changes, however long a chain of copies is; each window holds the reports of one outlet in one story.
    """
    out = stage(evidence.withColumn("origin", F.col("ref")), "origins")
    while True:
        now = out.withColumn("_was", F.col("origin"))
        for link in ("outlet", "title_key"):
            linked = F.min("origin").over(Window.partitionBy(story, link))
            now = now.withColumn("origin", F.when(F.col(link).isNotNull() & (F.col(link) != ""), linked).otherwise(F.col("origin")))
        last, now = out, stage(now, "origins")
        unstage(last)
        out = now.drop("_was")
        out._staged = now._staged
        if now.where(F.col("origin") != F.col("_was")).isEmpty():
            return out


def strength(groups: DataFrame, story: str) -> DataFrame:
    """Independent reports, repeats, channels, signals, points and level of every story.

    groups: story, origin, channel, signal boolean, counted boolean (a report of a known outlet), age_hours (of the story's newest
    report). Points: 2 and 3 reports count as many, four or more 4; one more for two channels, and for a report within a day.
    """
    report = F.col("counted") & ~F.col("signal")
    by = groups.groupBy(story).agg(
        F.count_distinct(F.when(report, F.col("origin"))).alias("independent"), F.count_if(report).alias("reports"), F.count_if("signal").alias("signals"),
        F.count_distinct(F.when(~F.col("signal"), F.col("channel"))).alias("channels"), F.min("age_hours").alias("age_hours"),
    )
    points = F.when(F.col("independent") < 2, 0).when(F.col("independent") < 4, F.col("independent")).otherwise(4)
    points = points + F.when(F.col("channels") >= 2, 1).otherwise(0) + F.when(F.col("age_hours") <= 24, 1).otherwise(0)
    by = by.withColumn("points", points.cast("bigint")).withColumn("repeats", F.col("reports") - F.col("independent"))
    return by.withColumn("level", F.when(F.col("independent") < 2, "limited").when(F.col("points") >= 5, "strong").otherwise("moderate"))


def greedy_top(stories: DataFrame, edition: str, top: int = 10, per_category: int = 4, share: float = 0.34, shared: str = "Tech") -> DataFrame:
    """The top list of each edition: by rank, with a cap per category and a share cap on one of them, then filled up.

    stories: edition, key, category, score. Only the best ``top`` x 8 of a category can matter; they are cut by a window first,
    so that the greedy part sees a bounded number of rows whatever the edition's size.
    """
    rn = F.row_number().over(Window.partitionBy(edition, "category").orderBy(F.desc("score"), "key"))
    short = stories.withColumn("_rn", rn).where(F.col("_rn") <= top * 8).drop("_rn")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "key"], ascending=[False, True])
        taken: list[int] = []
        counts: dict[str, int] = {}
        for stage_ in (True, False):
            for i, c in zip(frame.index, frame.category):
                if len(taken) == top:
                    break
                if i in taken or (stage_ and (counts.get(c, 0) >= per_category or (c == shared and counts.get(c, 0) + 1 > share * top))):
                    continue
                taken.append(i)
                counts[c] = counts.get(c, 0) + 1
        out = frame.loc[taken]
        return pd.DataFrame({edition: out[edition], "key": out["key"], "place": range(1, len(out) + 1)})

    kind = dict(stories.dtypes)
    return short.groupBy(edition).applyInPandas(choose, f"{edition} {kind[edition]}, key {kind['key']}, place int")


def hold(listed: DataFrame, challengers: DataFrame, category: str, limit: int, margin: float = 1.2) -> DataFrame:
    """Hysteresis per category: incumbents stay unless a challenger scores ``margin`` times the weakest of them.

    Both sides are cut to the best ``limit`` of a category first; a challenger then replaces the weakest listed one, best first.
    """
    both = listed.withColumn("old", F.lit(True)).unionByName(challengers.withColumn("old", F.lit(False)))
    both = both.withColumn("_rn", F.row_number().over(Window.partitionBy(category, "old").orderBy(F.desc("score"), "key"))).where(F.col("_rn") <= limit).drop("_rn")

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        inside = frame[frame.old].sort_values(["score", "key"], ascending=[True, False]).to_dict("records")
        for c in frame[~frame.old].sort_values(["score", "key"], ascending=[False, True]).to_dict("records"):
            if len(inside) < limit:
                inside.append(c)
            elif c["score"] >= margin * inside[0]["score"]:
                inside[0] = c
            inside.sort(key=lambda r: (r["score"], r["key"]))
        return pd.DataFrame(inside)[[category, "key", "score", "old"]] if inside else frame.head(0)[[category, "key", "score", "old"]]

    kind = dict(both.dtypes)
    return both.groupBy(category).applyInPandas(choose, f"{category} {kind[category]}, key {kind['key']}, score double, old boolean")


def keep_first(stories: DataFrame, pairs: DataFrame, edition: str) -> DataFrame:
    """Stories of each edition in rank order, without those that repeat one already kept.

    stories: edition, key, rank; pairs: edition, a, b of stories of one edition that tell the same. Sequential inside an edition,
    whose stories are few by then; a story only meets those that it repeats.
    """
    links = pairs.select(edition, F.col("a").alias("key"), F.col("b").alias("other")).unionByName(pairs.select(edition, F.col("b").alias("key"), F.col("a").alias("other")))
    near = links.groupBy(edition, "key").agg(F.collect_set("other").alias("others"))
    rows = stories.join(near, [edition, "key"], "left")

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "key"])
        kept: set = set()
        take = []
        for key, others in zip(frame["key"], frame["others"]):
            fresh = others is None or not kept.intersection(others)
            take.append(fresh)
            if fresh:
                kept.add(key)
        out = frame[take]
        return pd.DataFrame({edition: out[edition], "key": out["key"], "place": range(1, len(out) + 1)})

    kind = dict(stories.dtypes)
    return rows.groupBy(edition).applyInPandas(keep, f"{edition} {kind[edition]}, key {kind['key']}, place int")
