import pytest
from pyspark.sql import functions as F

from wirelake.sources import payloads as P
from wirelake.sources import store as K


def one(spark, payload, **rest):
    return spark.createDataFrame([(payload, *rest.values())], ["payload", *rest])


def test_rss_and_broken_payloads(spark):
    xml = "<?xml version='1.0'?><rss version='2.0'><channel><title>F</title><item><title> A &amp; B </title><link>http://a.test/1</link><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description></item><item><title></title><link>x</link></item><item><title>C</title><guid>http://a.test/3</guid></item></channel></rss>"
    got = [(r.feed, r["rank"], r.title, r.url, r.description, r.raw_score) for r in P.rss_items(one(spark, xml, feed="f")).orderBy("rank").collect()]
    assert got == [("f", 1, "A & B", "http://a.test/1", "Some text", 3.0), ("f", 3, "C", "http://a.test/3", None, 1.0)]
    bad = spark.createDataFrame([("f", xml[:90]), ("g", None), ("h", "{}"), ("i", "")], "feed string, payload string")
    assert P.rss_items(bad).count() == 0
    assert {r.feed: r.state for r in P.feed_states(bad, "feed").collect()} == {k: "failed" for k in "fghi"}


def test_atom_links_authors_and_categories(spark):
    xml = "<feed><title>T</title><entry><title>Paper</title><link href='http://a.test/pdf' rel='related'/><link href='http://a.test/abs' rel='alternate'/><summary>Text</summary><updated>2026-01-01T00:00:00Z</updated><author><name>A</name></author><author><name>B</name></author><category term='cs.AI'/></entry></feed>"
    r = P.atom_items(one(spark, xml, feed="f")).first()
    assert (r.title, r.url, r.authors, r.categories, r.raw_score) == ("Paper", "http://a.test/abs", ["A", "B"], ["cs.AI"], 1.0)


def test_json_listings(spark):
    forum = '{"data":{"children":[{"data":{"title":"Pinned","stickied":true}},{"data":{"title":" Kept ","url":"u","score":5,"num_comments":2}},{"data":{"title":"Adult","over_18":true}}]}}'
    assert [tuple(r) for r in P.forum_items(one(spark, forum, run="r")).collect()] == [("r", 2, "Kept", "u", 5.0, 2)]
    hits = spark.createDataFrame([(1, '{"hits":[{"objectID":"a","title":"A","points":1}]}'), (2, '{"hits":[{"objectID":"a","title":"A2","points":9},{"objectID":"b","title":"B"}]}'), (3, "no json")], "query int, payload string")
    assert sorted((r.hit, r.title) for r in P.hit_items(hits, "query").collect()) == [("a", "A"), ("b", "B")]
    links = spark.createDataFrame([("s1", '[{"url":"u","title":"L","history":[{"accounts":"3"},{"accounts":"4"},{"accounts":"90"}]}]'), ("s2", '[{"url":"u","title":"M","history":[{"accounts":"9"}]}]')], "server string, payload string")
    assert [(r.url, r.title, r.raw_score, r.server) for r in P.link_items(links, "server").collect()] == [("u", "M", 9.0, "s2")]


def test_pages_links_titles_and_times(spark):
    page = '<html><head><title>Plain</title><meta property="og:title" content="The &amp; title"><meta name="description" content="Sum"></head><body><p>short</p><p>' + "long words " * 8 + "</p></body></html>"
    got = one(spark, page).select(*[c.alias(k) for k, c in P.page_context(F.col("payload")).items()]).first()
    assert (got.page_title, got.summary, got.lead) == ("The & title", "Sum", ("long words " * 8).strip())
    titles = spark.createDataFrame([("Storm hits - The Paper", "The Paper"), ("Storm - a-b", "Other"), ("Storm", None)], "t string, p string")
    assert [r.v for r in titles.select(P.without_publisher(F.col("t"), F.col("p")).alias("v")).collect()] == ["Storm hits", "Storm - a-b", "Storm"]
    assert one(spark, "https://n.test/articles/!!").select(P.decode_token(F.col("payload")).alias("v")).first().v is None
    times = spark.sql("select timestamp'2026-01-01 10:00' r, t from values (null), (timestamp'1990-01-01'), (timestamp'2026-01-01 10:20'), (timestamp'2026-01-01 10:10'), (timestamp'2026-01-01 09:00') as x(t)")
    assert [r.n for r in times.select(P.publication_time(F.col("t"), F.col("r"))["note"].alias("n")).collect()] == ["missing", "too old", "in the future", "clamped", "stated"]
    assert [r.title for r in P.make_items(spark.createDataFrame([(" a ",), ("",), (None,), ("x" * 2000,)], "title string")).collect()] == ["a", "x" * 1000]


def test_versions_and_differences(spark, tmp_path):
    store = K.Versions(spark, str(tmp_path))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (1, "x")], "k int, v string")
    assert (store.publish("t", a), store.publish("t", b)) == (1, 2)
    assert sorted(map(tuple, K.differences(store.load("t", 1), store.load("t"), ["k"]).collect())) == [(2, "changed", "z"), (3, "new", None)]
    folder = store.pointer().where("revision = 2").first().folder
    spark.createDataFrame([(9, "bad")], "k int, v string").write.mode("overwrite").parquet(folder)  # damaged: its checksum is another
    assert store.load("t").count() == 2
    with pytest.raises(LookupError):
        store.load("none")
    store.publish("t", b)
    store.purge(1)
    assert store.load("t").count() == 3


def test_partitions_are_replaced_and_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "k int, m string")
    K.append_partitioned(rows, path, "m")
    K.replace_partitions(rows.where("k = 0"), path, "m")
    K.drop_partitions(spark, path, "m", ["b"])
    assert sorted((r.k, r.m) for r in spark.read.parquet(path).collect()) == [(0, "a"), (2, "c"), (5, "c"), (8, "c")]
