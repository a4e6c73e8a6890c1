from wirelake.llm import truncation


def test_closing_phrases_outside_the_sample_count(spark, monkeypatch):
    """A phrase on many texts none of which is in the sample; one that goes on in sentences outside it; words known by all rows."""
    monkeypatch.setattr(truncation, "SAMPLE", 0)
    texts = ["He said this. Read the full story here"] * 10 + ["It rained. The town council met"] * 4 + [f"The town council met on day {i}." for i in range(9)]
    rows = spark.createDataFrame([("t", i, "s", t) for i, t in enumerate(texts)], "tbl string, id long, source string, text string")
    known, _ = truncation.fit(rows)
    assert "Read the full story here" in known.phrases and "The town council met" not in known.phrases
    assert all(map(known.word, ("town", "Council", "day"))) and not known.word("unheard")


def test_prefixes():
    begun = truncation.Prefixes({"a", "a b", "a c", "a b c", "b"})
    assert sorted(begun.of("a b cd")) == ["a", "a b", "a b c"] and list(begun.of("a b")) == ["a"] and list(begun.of("c")) == []


def test_clip_lengths_of_any_size(spark):
    texts = [("t", "x" * (30_000 if i < 20 else 29_000 + 37 * i) + str(i).zfill(3)) for i in range(60)] + [("u", "y" * i) for i in range(1, 60)]
    assert truncation.clip_lengths(spark.createDataFrame(texts, "tbl string, text string")) == {"t": {30_003}}


def test_cut_texts_are_told_from_whole_ones(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("ren", "tal", "mis", "vok") for c in ("a", "or", "ing", "eth")]
    whole = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(400)]
    long = [" ".join(rng.sample(whole, 4)) for _ in range(300)]
    cut = [t[: rng.randint(20, len(t) - 8)].rstrip(" .") for t in long[:100]]
    rows = [("t", i, "s", t) for i, t in enumerate(long[100:] + cut)] + [("t", 900, "s", None), ("t", 901, "s", " ")]
    frame = spark.createDataFrame(rows, "tbl string, id long, source string, text string").selectExpr("*", "0 as chance")
    chance = {r.id: r.chance for r in truncation.truncated(frame).collect()}
    assert 900 not in chance and 901 not in chance and len(chance) == 300
    assert sum(chance[i] > 0.5 for i in range(200, 300)) >= 80 and sum(chance[i] > 0.5 for i in range(200)) <= 4
    assert truncation.truncated(frame.limit(0)).count() == 0
