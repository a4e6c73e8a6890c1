"""The k most similar vectors of every vector (problem 4): all products within the shards of near centres, shard results merged.

Equal vectors are folded into one node first, so copies cost nothing. The nodes of a space are divided by coarse centres, fitted on
a bounded sample (``SAMPLE`` nodes a centre, at most ``CENTRES`` centres a space), and the nodes of one centre by hash into shards
of about ``SHARD``, so that no shard follows the skew of the data. Every node is in a shard. A shard is searched by matrix products of all its
nodes with many queries at a time, which at this size costs less than searching a graph in numpy and misses nothing.

A node is searched in the shards of its nearest centres only: ``PROBES`` of them, and those nearly as near as the first. Query
blocks of a centre are spread over tasks and the candidates of all shards are merged. Their cosines are computed again in double
precision, so the result is exact but for neighbours that the routing missed; ``tests/llm/test_vectors.py`` measures
recall against brute force and the README gives the figures.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.session import stage, table

#: Nodes of one shard, about.
SHARD = 16384
#: Nodes that search a shard, or are routed, in one task, about.
QUERY_BLOCK = 16384
#: Centres of a space, at most, and the nodes that each is fitted on, about.
CENTRES, SAMPLE = 1024, 32
#: Centres whose shards a node is searched in at least, and how near to it others must be, as a share of the nearest one's cosine.
PROBES, NEARLY = 8, 0.3


def most_similar(x: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k rows of x with the greatest products with each row of q, in no order; -1 fills up."""
    n, strip = len(x), 16
    wide = -(-n // strip)
    s = np.full((len(q), strip * wide), -np.inf, np.float32)
    s[:, :n] = q @ x.T
    if wide <= k:
        ids = np.argpartition(-s, k - 1, 1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    else:  # the k greatest are in the k columns of the greatest maxima
        top = np.argpartition(-s.reshape(len(q), strip, wide).max(1), k - 1, 1)[:, :k]
        among = (top[:, :, None] + wide * np.arange(strip)).reshape(len(q), -1)
        ids = np.take_along_axis(among, np.argpartition(-np.take_along_axis(s, among, 1), k - 1, 1)[:, :k], 1)
    return np.where(ids < n, ids, -1)


def _unit(col: pd.Series | np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision, without overflow."""
    x = np.vstack([np.asarray(v, np.float64) for v in col])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """space, vec_key, vec of the vectors that count: neither null nor short nor long, all numbers finite, not all zero."""
    sound = F.col("vec").isNotNull() & F.col("vec_key").isNotNull() & (F.size("vec") == F.col("dims"))
    sound &= F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    space = F.regexp_replace("vec_key", r"\|[^|]*$", "")
    return vectors.where(sound).select(F.concat_ws("#", space, F.col("dims")).alias("space"), "vec_key", "vec")


def centres(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means."""
    rng = np.random.default_rng(5)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 0, total / np.maximum(length, 1e-12), c).astype(np.float32)
    return c


def _routes(nodes: DataFrame, sizes: DataFrame, probes: int, nearly: float) -> DataFrame:
    """(space, node, centre, asked): the centre of each node and the centres whose shards it is searched in."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        c = centres(_unit(frame.vec).astype(np.float32), int(frame.centres.iloc[0]))
        return pd.DataFrame({"space": frame.space.iloc[0], "blocks": frame.blocks.iloc[0], "dims": c.shape[1], "centres": [c.tobytes()]})

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"space": [], "node": [], "centre": [], "asked": []})
        c = np.frombuffer(right.centres.iloc[0], np.float32).reshape(-1, right.dims.iloc[0])
        sims = _unit(left.vec).astype(np.float32) @ c.T
        order = np.argsort(-sims, 1, kind="stable")
        best = np.take_along_axis(sims, order, 1)
        take = (np.arange(best.shape[1]) < probes) | (best >= nearly * best[:, :1])
        return pd.DataFrame({"space": left.space.to_numpy(), "node": left.node.to_numpy(), "centre": order[:, 0].astype(np.int32), "asked": [o[t].astype(np.int32) for o, t in zip(order, take)]})

    many = nodes.join(sizes.where("centres > 1"), "space")
    one = nodes.join(sizes.where("centres = 1"), "space").select("space", "node", F.lit(0).alias("centre"), F.array(F.lit(0)).alias("asked"))
    sample = many.where(F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(F.lit(1), F.floor(F.col("n") / (F.col("centres") * SAMPLE)))) == 0)
    fitted = sample.select("space", "blocks", "centres", "vec").groupBy("space").applyInPandas(fit, "space string, blocks int, dims int, centres binary")
    served = fitted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asks = many.select("space", F.pmod(F.xxhash64("node", F.lit(2)), "blocks").cast("int").alias("block"), "node", "vec")
    routed = asks.groupBy("space", "block").cogroup(served.groupBy("space", "block")).applyInPandas(route, "space string, node long, centre int, asked array<int>")
    return one.unionByName(routed)


def nearest(vectors: DataFrame, k: int = 5, shard: int = SHARD, probes: int = PROBES, nearly: float = NEARLY) -> DataFrame:
    """(vec_key, other, cosine, rank): the k most similar other vectors of each usable vector, within its space.

    vectors: vec_key string (unique), dims int, vec array<float>; other columns are ignored. Cosines are rounded to 9 decimals
    and ties go to the smaller key. Vectors that are null, of another length than dims, not finite or all zero are left out
    on both sides; copies of one vector are each other's neighbours. A space of fewer than k + 1 vectors gives all it has.
    """
    v = stage(usable(vectors).withColumns({"h1": F.xxhash64("vec"), "h2": F.hash("vec")}), "vectors")
    group = ["space", "h1", "h2"]
    # the k + 1 smallest keys of each distinct vector, by salt first: one vector may have a third of all rows
    salted = v.withColumn("salt", F.pmod(F.xxhash64("vec_key"), F.lit(64)))
    top = _smallest(_smallest(salted.select(*group, "salt", "vec_key"), [*group, "salt"], k + 1), group, k + 1)
    keys = top.groupBy(*group).agg(F.array_sort(F.collect_list("vec_key")).alias("keys"))
    nodes = stage(v.groupBy(*group).agg(F.any_value("vec").alias("vec")).join(keys, group).select("space", F.xxhash64(*group).alias("node"), "keys", "vec"), "nodes")
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n"))
    sizes = stage(
        sizes.select("space", "n", F.least(F.lit(CENTRES), F.ceil(F.col("n") / shard)).cast("int").alias("centres"), F.ceil(F.col("n") / QUERY_BLOCK).cast("int").alias("blocks")), "sizes"
    )
    routes = stage(_routes(nodes, sizes, probes, nearly), "routes")
    by = ["space", "centre"]
    asked = routes.select("space", F.explode("asked").alias("centre"), "node")
    places = routes.groupBy(*by).agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    places = stage(places.join(asked.groupBy(*by).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")), by), "places")  # one row a centre

    def part(count: str, seed: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x = np.vstack(frame.vec).astype(np.float32)
        facts = {c: [frame[c].iloc[0]] for c in ("space", "centre", "part", "blocks")}
        return pd.DataFrame(facts | {"keys": [frame["keys"].map(list).tolist()], "dims": [x.shape[1]], "vectors": [x.tobytes()]})

    placed = nodes.join(routes.select("space", "node", "centre"), ["space", "node"]).join(places, by).select("space", "centre", part("parts", 1).alias("part"), "blocks", "node", "keys", "vec")
    shards = stage(
        placed.groupBy("space", "centre", "part").applyInPandas(build, "space string, centre int, part int, blocks int, keys array<array<string>>, dims int, vectors binary"),
        "shards",
    )

    def search(query: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(stored):
            return pd.DataFrame({"node": [], "cosine": [], "other": []})
        g = stored.iloc[0]
        x = _unit(np.frombuffer(g.vectors, np.float32).reshape(-1, g.dims))
        single = x.astype(np.float32)
        held = np.array([len(m) for m in g["keys"]])
        names, place = np.unique(np.concatenate([np.asarray(m, object) for m in g["keys"]]).astype(str), return_inverse=True)
        first = np.cumsum(held) - held
        q, out, wide = _unit(query.vec), [], min(len(x), 4 * k)
        asking = query.node.to_numpy()
        for at in range(0, len(q), 512):
            b = q[at : at + 512]
            ids = most_similar(single, b.astype(np.float32), wide)
            row, col = np.nonzero(ids >= 0)
            node = ids[row, col]
            exact = np.round(np.einsum("nd,nd->n", x[node], b[row]), 9)
            many = held[node]  # each copy of a vector is a candidate
            row, exact = np.repeat(row, many), np.repeat(exact, many)
            key = place[np.repeat(first[node], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.lexsort((key, -exact, row))
            row, exact, key = row[order], exact[order], key[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = rank <= k  # k + 1 of them, as the node's own key may be one
            out.append(pd.DataFrame({"node": asking[at + row[best]], "cosine": exact[best], "other": names[key[best]]}))
        return pd.concat(out)

    asks = nodes.select("space", "node", "vec").join(asked, ["space", "node"]).join(places, by)
    asks = asks.select("space", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), part("blocks", 2).alias("block"), "node", "vec")
    served = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    at = ("space", "centre", "part", "block")
    flat = asks.groupBy(*at).cogroup(served.groupBy(*at)).applyInPandas(lambda left, right: search(left, right), "node long, cosine double, other string")
    # merge the shards: k + 1 best of the k + 1 that each gave
    order = F.row_number().over(_window(["node"], [F.desc("cosine"), F.asc("other")]))
    best = stage(flat.withColumn("at", order).where(F.col("at") <= k + 1), "best")
    lists = best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "cosine", "other"))).alias("best"))
    rows = v.select("vec_key", F.xxhash64("space", "h1", "h2").alias("node")).join(lists, "node")
    others = F.slice(F.filter("best", lambda b: b["other"] != F.col("vec_key")), 1, k)
    return rows.select("vec_key", F.posexplode(others).alias("rank", "b")).select("vec_key", F.col("b.other").alias("other"), F.col("b.cosine").alias("cosine"), (F.col("rank") + 1).alias("rank"))


def _window(by: list, order: list):
    return Window.partitionBy(*by).orderBy(*order)


def _smallest(df: DataFrame, by: list[str], n: int) -> DataFrame:
    return df.withColumn("at", F.row_number().over(_window(by, [F.asc("vec_key")]))).where(F.col("at") <= n).drop("at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "vectors"))
    return near.select(F.least("vec_key", "other").alias("key_a"), F.greatest("vec_key", "other").alias("key_b")).distinct()


QUERIES = {"p4_found": p4_found}
