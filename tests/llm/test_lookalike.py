import itertools

from wirelake.llm import lookalike as A

SAME = ["café news", "café news", "cаfé news", "café news", "ca​fé news", "ｃａｆé news"]


def test_forms_of_the_same_looks():
    assert {A.canonical_text(t) for t in SAME} == {"café news"}
    assert [A.canonical_text(t) for t in ("x²", "½", "№ 5", "CAFÉ", "ΠΑ", "ꓐꓳꓦ", "ᎪᏴ")] == ["x²", "½", "№ 5", "CAFÉ", "ΠA", "BOV", "AB"]
    for t in SAME:
        assert A.canonical_text(A.canonical_text(t)) == A.canonical_text(t)


def test_pairs_and_classes(spark):
    rows = [("t", i, t) for i, t in enumerate(SAME)] + [("t", 20, "café news"), ("t", 21, "Café news"), ("u", 1, "café news"), ("t", 30, None), ("t", 31, ""), ("t", 32, ""), ("t", 20, "café news")]
    frame = spark.createDataFrame(rows, "tbl string, id long, text string").selectExpr("*", "1 as form", "2 as raw")
    pairs = {tuple(r) for r in A.lookalike_pairs(frame).collect()}
    want = {("t", min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations([r for r in rows if r[0] == "t" and r[2] and A.canonical_text(r[2]) == "café news"], 2) if a[2] != b[2]}
    assert pairs == want
    assert [tuple(r) for r in A.lookalike_classes(frame).collect()] == [("t", 0, 8, 6, 5)]
    assert A.lookalike_pairs(frame.limit(0)).count() == 0 and A.lookalike_classes(frame.limit(0)).count() == 0
