from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from wirelake.llm import neardup as N


def near(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return bool(x) and sum((x & y).values()) * 100 >= 80 * max(sum(x.values()), sum(y.values()))


def groups_of(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(rows, 2):
        if a and b and near(a, b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {(find(i), i) for i, _ in rows if find(i) != i}


def texts(seed, n, words, size):
    """Texts with edited forms; the first words mostly come in threes, some words are repeated, some texts are long."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = [w for g in rng.choice(words // 6, rng.integers(0, 3), replace=False) for w in (f"g{g}a", f"g{g}b", f"g{g}c") if rng.random() < 0.95]
        t += [f"w{x}" for x in rng.integers(0, words, rng.integers(1, size))]
        t += t[: rng.integers(0, 3)]
        out.append(t)
        for _ in range(rng.integers(0, 3)):
            e = list(t)
            for _ in range(rng.integers(0, 1 + len(e) // 4)):
                e[rng.integers(len(e))] = f"x{rng.integers(0, 50)}"
            rng.shuffle(e)
            out.append(e)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "words", "size"), [(1, 30, 12), (2, 200, 25)])
def test_same_groups_as_all_pairs(spark, monkeypatch, seed, words, size):
    monkeypatch.setattr(N, "RARE", 60)
    monkeypatch.setattr(N, "STEP", 16)
    rows = texts(seed, 150, words, size)
    frame = spark.createDataFrame([("t", i, t) for i, t in rows], "tbl string, id long, text string")
    bagged = N.bags(frame)
    assert len(N.group_words(bagged).word) > 3  # the groups are found and used
    got = {(r.first_id, r.id) for r in N.near_groups(frame).collect()}
    assert got == groups_of(rows)


def test_long_texts_nulls_and_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "CELLS", 100_000)
    rng = np.random.default_rng(7)
    long = [f"w{x}" for x in rng.integers(0, 3000, 9000)]
    edited = long[:4000] + ["new"] * 500 + long[4500:]
    other = long[:4000] + [f"o{x}" for x in range(2500)] + long[6500:]
    rows = [("t", 5, " ".join(long)), ("t", 9, " ".join(edited)), ("t", 4, " ".join(other)), ("t", 1, None), ("t", 2, ""), ("t", 3, "...")]
    rows += [("u", i, "Same words here") for i in (7, 8, 8)] + [("u", 6, "here SAME words"), ("t", 6, "Same words here")]
    df = spark.createDataFrame(rows, "tbl string, id long, text string").selectExpr("*", "0 as rep", "'z' as bag")
    assert sorted(tuple(r) for r in N.near_groups(df).distinct().collect()) == [("t", 5, 9), ("u", 6, 7), ("u", 6, 8)]
    assert N.near_groups(df.limit(0)).count() == 0


def test_thresholds_cover_all_and_cost_least():
    """Against trying out all thresholds."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        cnt = rng.integers(1, 4, rng.integers(1, 5))
        n = np.array([cnt.sum()])
        cost = rng.integers(0, 20, cnt.sum()).astype(float)
        first = np.cumsum(cnt) - cnt
        for c, f in zip(cnt, first):  # the more occurrences are needed, the fewer texts have them
            cost[f : f + c] = -np.sort(-cost[f : f + c])
        got, total = N.allocate(np.zeros(len(cnt), int), cnt, cost, first, n, 60)
        units = N.missing_bound(n, 60)[0] + 1
        best = defaultdict(lambda: np.inf)
        best[0] = 0.0
        for c, f in zip(cnt, first):
            old = dict(best)
            for have, price in old.items():
                for u in range(1, c + 1):
                    best[have + u] = min(best[have + u], price + cost[f + c - u])
        assert (got + 1).sum() >= units and total[0] == min(p for u, p in best.items() if u >= units)
