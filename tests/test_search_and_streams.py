import datetime as dt

from pyspark.sql import functions as F

from wirelake.operators import search as S
from wirelake.streaming import streams as T


def test_queries_are_parsed():
    assert S.parse_query('Réacteur "New  York" the the') == ["reacteur", "new york", "the"]
    assert S.parse_query('  "" ') == [] and len(S.parse_query(" ".join(map(str, range(20))))) == 8


def test_search_scores_word_starts(spark):
    docs = spark.createDataFrame([(1, "New York reactor", "x", True), (2, "x", "new yorkers and a réacteur", False), (3, "anew york", "reactor", False), (4, None, None, None)], "id long, h string, b string, top boolean")
    got = {r.id: r.score for r in S.search(docs, '"new york" react', "h", "b", F.col("top")).collect()}
    assert got == {1: 6.5, 2: 2.0}
    assert S.search(docs, "", "h", "b").count() == 0


def test_topics_are_whole_phrases(spark):
    rows = spark.createDataFrame([(1, "The Peace Treaty holds"), (2, "peacetime treaty"), (3, None)], "id long, t string")
    assert [(r.id, r.topic) for r in S.topics(rows, "id", "t", ["peace treaty", "hold"]).collect()] == [(1, "peace treaty")]


def _at(minute):
    return dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


def test_windows_sessions_and_restart(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, ts timestamp"
    spark.createDataFrame([("a", _at(1)), ("a", _at(2)), ("b", _at(3)), ("a", _at(70))], schema).coalesce(1).write.parquet(path)
    src = lambda: T.source(spark, path, spark.read.parquet(path))
    first = T.run(T.tumbling(src(), "ts", ["k"], "1 hour", "5 minutes"), "w", out)
    assert sorted((r.k, r.n) for r in first.collect()) == [("a", 2), ("b", 1)]
    spark.createDataFrame([("a", _at(200)), ("a", _at(4))], schema).coalesce(1).write.mode("append").parquet(path)  # the second is too late
    again = T.run(T.tumbling(src(), "ts", ["k"], "1 hour", "5 minutes"), "w", out)
    assert sorted((r.k, r.n) for r in again.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    s = T.run(T.sessions(src(), "ts", "k", "10 minutes", "5 minutes"), "s")
    assert sorted((r.k, r.n) for r in s.collect()) == [("a", 1), ("a", 3), ("b", 1)]


def test_streaks_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    for rows in ([("f", 1.0, True), ("f", 2.0, False), ("g", 1.0, False)], [("f", 3.0, False), ("g", 3.0, True)], [("f", 4.0, False)]):
        spark.createDataFrame(rows, "feed string, at double, ok boolean").coalesce(1).write.mode("append").parquet(path)
    got = T.latest(T.streaks(T.source(spark, path, spark.read.parquet(path), files=1), "feed"), "feed", "last", "s").collect()
    assert {r.feed: (r.failures, r.since) for r in got} == {"f": (3, 2.0), "g": (0, 0.0)}
