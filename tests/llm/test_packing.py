from collections import Counter

import numpy as np
import pytest

from wirelake.llm import packing as P

RNG = np.random.default_rng(3)
HISTOGRAMS = {
    "one short length": {100: 1000},
    "two lengths": {300: 10_000, 900: 100},
    "long ones": {int(x): 3 for x in range(700, 1001)},
    "mixed": {int(x): int(n) for x, n in zip(RNG.integers(1, 2049, 600), RNG.integers(1, 5000, 600))},
    "full": {2048: 7, 1: 3},
    "empty": {},
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_patterns_hold_every_item_once_within_capacity(name):
    hist = HISTOGRAMS[name]
    patterns = P.pack(hist)
    held = Counter()
    for lengths, count in patterns:
        assert sum(x * t for x, t in lengths) <= P.CAPACITY and count > 0
        for x, t in lengths:
            held[x] += t * count
    assert held == Counter(hist)
    assert len(patterns) <= 2 * len(hist)


def test_little_room_is_left():
    assert P.fill(P.pack({100: 1000})) > 0.95  # 20 of 100 in each of 50 containers
    assert sum(n for _, n in P.pack({300: 10_000, 900: 100})) <= -(-10_000 // 6) + 51  # no container holds more than 6 x 300
    assert P.fill(P.pack(HISTOGRAMS["mixed"])) > 0.95


def test_every_text_has_a_container(spark):
    words = "alpha bravo charlie delta "
    rows = [(1, words * 5), (2, None), (3, ""), (4, words * 900), (5, "x"), (6, words * 5), (6, words * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as container", "'a' as piece")  # names that clash
    got = P.containers(docs, capacity=64).collect()
    load = Counter()
    for r in got:
        if r.container is not None:
            load[r.container] += r.n_tokens
    assert max(load.values()) <= 64
    assert sorted({r.doc_id for r in got}) == [1, 2, 3, 4, 5, 6]
    assert all((r.container is None) == (r.n_tokens == 0) for r in got) and len([r for r in got if r.doc_id == 6]) == 2
    long = sorted((r.piece, r.n_tokens) for r in got if r.doc_id == 4)
    assert [p for p, _ in long] == list(range(len(long))) and all(n == 64 for _, n in long[:-1])
    assert P.containers(docs.limit(0)).count() == 0
