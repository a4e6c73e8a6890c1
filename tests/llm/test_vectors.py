import numpy as np
import pytest

from wirelake.llm import vectors


def made_up(n, dims):
    """Half the vectors in groups of ten, half alone."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=(n // 20, dims)).repeat(10, 0) + 0.4 * rng.normal(size=(n // 20 * 10, dims))
    return np.vstack([near, rng.normal(size=(n - len(near), dims))]).astype(np.float32)


def recall(spark, x, k=5, **how):
    """Share of the k nearest by brute force, in double precision, that ``nearest`` gives."""
    n = len(x)
    rows = spark.createDataFrame([(f"m|{i:06}", x.shape[1], v.tolist()) for i, v in enumerate(x)], "vec_key string, dims int, vec array<float>")
    got = {(int(r.vec_key[2:]), int(r.other[2:])) for r in vectors.nearest(rows, k, **how).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -np.inf)
    best = np.argsort(-sims, 1)[:, :k]
    found = sum((i, j) in got for i in range(n) for j in best[i]) / (n * min(k, n - 1))
    print("recall", n, how, found)
    return found


@pytest.mark.parametrize("how", [{"shard": 2000}, {"shard": 16384}, {"shard": 400}], ids=["3 centres", "one graph", "15 centres"])
def test_recall_over_shards(spark, how):
    assert recall(spark, made_up(6000, 32), **how) >= 0.9


@pytest.mark.parametrize("n", [2, 3, 7, 90])
def test_small_spaces_go_through_the_graph_too(spark, n):
    assert recall(spark, made_up(n, 8)) >= 0.99


def test_hot_centres_are_cut_into_parts(spark):
    """A third of the vectors around one point."""
    rng = np.random.default_rng(4)
    x = np.vstack([np.ones((400, 16)) + 0.01 * rng.normal(size=(400, 16)), rng.normal(size=(800, 16))]).astype(np.float32)
    assert recall(spark, x, shard=100) >= 0.9


def test_unusable_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a|1", 2, [1.0, 0.0]), ("a|2", 2, [1.0, 0.0]), ("a|3", 2, [2.0, 0.0]), ("a|4", 2, [0.0, 1.0]), ("a|5", 2, None), ("a|6", 2, [0.0, 0.0]), ("a|7", 2, [nan, 1.0])]
    rows += [("a|8", 2, [inf, 1.0]), ("a|9", 2, [1.0]), ("b|1", 2, [1.0, 0.0]), (None, 2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_key string, dims int, vec array<float>").selectExpr("*", "'x' as node", "1 as space", "2 as rank")
    got = sorted((r.vec_key, r["rank"], r.other, r.cosine) for r in vectors.nearest(df, 2).collect())
    assert got == [("a|1", 1, "a|2", 1.0), ("a|1", 2, "a|3", 1.0), ("a|2", 1, "a|1", 1.0), ("a|2", 2, "a|3", 1.0), ("a|3", 1, "a|1", 1.0), ("a|3", 2, "a|2", 1.0), ("a|4", 1, "a|1", 0.0), ("a|4", 2, "a|2", 0.0)]
    assert vectors.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 5, 20, 300, 331, 5000])
def test_nothing_is_missed_within_a_shard(n):
    x = made_up(n + 40, 16)[:n]
    q = made_up(80, 16)
    got = vectors.most_similar(x, q, 20)
    best = np.argsort(-(q @ x.T), 1)[:, :20]
    assert all(set(g[g >= 0]) == set(b) for g, b in zip(got, best))


def test_shards_of_one_space_give_all_neighbours(spark):
    """As many centres as are asked: vectors alone, which graphs missed now and then."""
    x = np.random.default_rng(6).normal(size=(3000, 48)).astype(np.float32)
    assert recall(spark, x, shard=400) == 1.0
