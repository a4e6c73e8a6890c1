"""Connected components of a link table by alternating large-star and small-star steps.

Nothing is collected: each step is a partial minimum per node and a join back, written to the shared folder. A hub with very
many links costs no more than its rows, since the minimum is pre-aggregated and the join back may be split by skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.session import stage, unstage


def _star(directed: DataFrame, floor: bool) -> DataFrame:
    """directed(u, v): connect the neighbours v of u to the least of u and its neighbours."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = directed.join(least, "u")
    out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if floor:  # small star: u itself too
        out = out.unionByName(least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): every linked node with the smallest node of its component.

    Nodes may be any orderable type. Self-links and repeated links are ignored; an empty table gives an empty result.
    """
    edges = stage(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star keeps only neighbours above u
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        last, edges = edges, stage(_star(large, floor=True), "star")
        unstage(last)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
