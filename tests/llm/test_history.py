from collections import Counter

import numpy as np

from wirelake.llm import history

COLUMNS = "id long, start double, valid boolean, hash string, title string, report_key string"


def near(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return bool(x) and sum((x & y).values()) * 100 >= 80 * max(sum(x.values()), sum(y.values()))


def repeats(rows, reports=()):
    """By comparing all pairs."""
    out = set()
    for i, start, _, h, t, key in rows:
        earlier = [r for r in rows if r[2] and r[1] < start]
        if any((h and r[3] == h) or near(t or "", r[4] or "") for r in earlier) or any(k == key and seen < start for k, seen in reports):
            out.add(i)
    return out


def made_up(batches, size, seed=2):
    rng = np.random.default_rng(seed)
    old, rows = [], []
    for b in range(batches):
        for i in range(size):
            if old and rng.random() < 0.4:
                t = old[rng.integers(len(old))].split()
                for _ in range(rng.integers(0, 4)):
                    t[rng.integers(len(t))] = f"e{rng.integers(0, 30)}"
                title = " ".join(rng.permutation(t))
            else:
                title = " ".join(f"w{x}" for x in rng.integers(0, 80, rng.integers(4, 14)))
            old.append(title)
            start = float(b * 10 + rng.integers(0, 3))
            rows.append((b * 1000 + i, start, bool(rng.random() < 0.8), f"h{rng.integers(0, 400)}" if rng.random() < 0.9 else None, title, f"k{rng.integers(0, 60)}"))
    return rows


def test_many_batches_with_reopening_equal_all_pairs(spark, tmp_path):
    rows, path = made_up(9, 25), str(tmp_path / "history")
    reports = [("k1", 15.0), ("k2", 0.0), (None, 0.0)]
    listed = spark.createDataFrame(reports, "report_key string, seen double")
    found = set()
    for b in range(9):
        store = history.History.open(spark, path, tier=2)  # merges at every level
        batch = spark.createDataFrame([r for r in rows if r[0] // 1000 == b], COLUMNS)
        found |= {r.id for r in store.ingest(batch, listed).collect()}
        assert len(store.runs) <= 4
    assert found == repeats(rows, reports)


def test_rebuild_and_odd_rows(spark, tmp_path):
    store = history.History(spark, str(tmp_path / "history"))
    first = [(1, 1.0, True, "a", "one two three four five", None), (2, 1.0, True, None, None, None), (3, 1.0, True, None, "", None), (4, None, True, "z", "six", None), (5, 1.0, False, "b", "seven eight", None)]
    assert store.ingest(spark.createDataFrame(first, COLUMNS).selectExpr("*", "1 as bag", "2 as n")).count() == 0
    store.rebuild()
    second = [(6, 2.0, True, "a", "x", None), (7, 2.0, True, "c", "One, TWO three four five!", None), (7, 2.0, True, "c", "five four three two one", None), (8, 2.0, True, "b", "seven eight", None), (9, 2.0, False, None, None, None), (10, 2.0, True, "z", "", None)]
    assert sorted(r.id for r in store.ingest(spark.createDataFrame(second, COLUMNS)).collect()) == [6, 7, 7]
    assert store.ingest(spark.createDataFrame([], COLUMNS)).count() == 0
