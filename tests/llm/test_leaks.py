import random

import pytest

from wirelake.llm import leaks as L


@pytest.mark.parametrize("block", [2, 3, 4])
def test_windows_are_found_wherever_they_stand(block):
    """Against trying every position; few different words, so that blocks repeat."""
    rng = random.Random(block)
    words = [f"w{i}" for i in range(6)]
    passages = [(i, [rng.choice(words) for _ in range(rng.randint(3, 20))]) for i in range(30)]
    search = L.WuManber(passages, 5, block)
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        windows = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        assert search.items(text) == {i for i, p in passages if any(tuple(p[j : j + 5]) in windows for j in range(len(p) - 4))}


def test_blocks_grow_with_the_passages(monkeypatch):
    monkeypatch.setattr(L, "FEW", 10)
    assert L.WuManber([(1, ["a"] * 12)]).block == 3 and L.WuManber([(1, ["a"] * 12)], block=2).block == 2


def test_documents_and_items(spark):
    passage = "The quick brown fox jumps over the lazy dog and then runs far away from here."
    items = spark.createDataFrame([(1, passage, "s"), (2, None, "s"), (3, "too short", "s"), (4, passage.upper(), "t")], "item_id long, passage string, suite string")
    docs = [(1, "Before. " + passage.replace(" ", "\n") + " After"), (2, "the quick brown fox jumps over the lazy dog and then"), (3, None), (4, ""), (5, "x " * 20000 + "“The quick—brown fox, jumps: over the lazy dog; and then!”")]
    frame = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").selectExpr("*", "7 as item_id")
    want = [(1, 1), (1, 4)]
    assert sorted(tuple(r) for r in L.leaked(frame, items).collect()) == want
    assert sorted(tuple(r) for r in L.leaked(frame, items, window=11).collect()) == [(d, i) for d in (1, 2, 5) for i in (1, 4)]
    assert sorted(tuple(r) for r in L.leaked(frame, items, block_words=4).collect()) == want  # several blocks of patterns
    assert L.leaked(frame, items.limit(0)).count() == 0 and L.leaked(frame.limit(0), items).count() == 0
