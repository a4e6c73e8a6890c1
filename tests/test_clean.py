import pytest
from pyspark.sql import functions as F

from wirelake.functions import text as X
from wirelake.operators import clean as C


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first().v


NORMAL = [
    ("Straße &amp; Café – 'now'!!!!", "Strasse & Cafe - 'now'!"),
    ("  - Price £5 … see https://x.test/a now ", "Price GBP 5 . see now"),  # three points are one, as any run of a mark is
    ("ＦＵＬＬ​width", "FULLwidth"),
    ("plain title", "plain title"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("text,want", NORMAL)
def test_normalized_text(spark, text, want):
    assert value(spark, text, X.normalize) == want


def test_words_urls_and_counts(spark):
    assert value(spark, "#GBvsATLFinalRound2", X.split_hashtag) == "GB vs ATL Final Round 2"
    assert value(spark, "Dr. Smith left. He said 5.5 is fine! Is it? yes", X.sentences) == ["Dr. Smith left.", "He said 5.5 is fine!", "Is it? yes"]
    assert value(spark, "1,204 of 3.5, 1,204", X.numbers) == ["1204", "3.5"]
    assert value(spark, "a b c d", lambda t: X.ngrams(F.split(t, " "), 3)) == ["a b c", "b c d"]
    assert value(spark, "www.news.bbc.co.uk", X.registrable) == "bbc.co.uk"
    assert [value(spark, u, X.public_url) for u in ("https://a.test/x", "http://10.0.0.1/x", "ftp://a.test", "https://localhost/", None)] == [True, False, False, False, False]
    assert [value(spark, t, X.parse_count) for t in ("12.3K", "1,204", "200+", "x", None)] == [12300.0, 1204.0, 200.0, None, None]


RULES = [
    ("reddit", "A fine long title here", 5.0, 9, None, "reddit_low_engagement"),
    ("reddit", "A fine long title here", 5.0, 9, 3, None),
    ("reddit", "Look at my cat today", 50.0, 9, None, "personal_anecdote"),
    ("reddit", "Cats seen on Avon bridge", 50.0, 9, None, "pet_post"),
    ("hackernews", "A fine long title here", 9.0, None, None, "hn_low_points"),
    ("github", "owner/tool: does things", None, None, None, "github_low_stars"),
    ("tiktok", "#fallvibes", 5.0, None, None, "generic_hashtag"),
    ("news_rss", "12 34", None, None, None, "too_short_or_non_ascii"),
    ("news_rss", "Best bets and odds for Sunday", None, None, None, "box_score_or_betting"),
    ("news_rss", "This lamp is on sale now", None, None, None, "promotional"),
    ("youtube", "Full match: Avon against Long", None, None, None, "video_clip"),
    ("news_rss", "Council approves the harbour plan", None, None, None, None),
]


def test_rules_in_order(spark):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(RULES)], "id long, source string, title string, raw_score double, comment_count int, rank int")
    got = {r.id: r.reason for r in C.judge(rows.selectExpr("*", "1 as alnum")).collect()}
    assert got == {i: r[5] for i, r in enumerate(RULES)}


def test_mid_rank_and_fold(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, "x"), (2, "a", 3.0, "x"), (3, "a", 3.0, None), (4, "b", None, "y")], "id long, source string, raw_score double, url string")
    assert {r.id: r.pct for r in C.mid_rank(rows, "source", "raw_score").collect()} == {1: 0.5 / 3, 2: 2 / 3, 3: 2 / 3, 4: 0.75}
    got = C.fold_exact(rows.withColumn("key", F.lit("k")), "key", "id", "raw_score").collect()
    assert [tuple(r) for r in got] == [("k", 2, 1, 4, 2, 2)]


def test_floors_go_first_and_a_hot_group_gets_no_more(spark):
    """A third of the rows are of one group."""
    rows = [(i, 1, f"g{i % 6}" if i >= 40 else "hot", 1.0 - i / 1000) for i in range(120)]
    items = spark.createDataFrame(rows, "id long, run long, grp string, score double")
    got = C.fair_floors(items, "run", "grp", "score", "id", F.lit(2), 20).collect()
    assert len(got) == 20 and sum(r.by_floor for r in got) == 14 and len({r.grp for r in got}) == 7
    assert [r.id for r in sorted(got, key=lambda r: r.place) if not r.by_floor] == list(range(2, 8))
    turns = C.interleave(items, "run", "grp", "id", 9).orderBy("turn").collect()
    assert [r.grp for r in turns][:7] == sorted({r[2] for r in rows}) and [r.round for r in turns] == [1] * 7 + [2] * 2
