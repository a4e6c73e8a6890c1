"""Payloads made of the tables' own rows, read back: feeds, listings, pages, links; and tables as they are stored."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirelake.functions import sql as Q
from wirelake.operators import editions as D
from wirelake.plans.editions import appearances
from wirelake.sources import payloads as P
from wirelake.sources import store as K
from wirelake.session import new_path, table


def _feeds_xml(spark, sf_dir):
    items = table(spark, sf_dir, "raw_items").where("feed is not null").select("id", "feed", "title", "url", F.col("category_hint").alias("description"))
    return P.feed_xml(items, "feed", [F.desc("id")])


def rss_feeds(spark, sf_dir):
    """The newest 30 items of each feed, written as RSS and read again: titles, addresses, ranks and scores."""
    return P.rss_items(_feeds_xml(spark, sf_dir)).select("feed", "rank", F.sha1("title").alias("title"), F.nullif("url", F.lit("")).alias("url"), F.nullif("description", F.lit("")).alias("description"), "raw_score")


def feed_health(spark, sf_dir):
    """States of payloads, a cut and an empty one among them."""
    good = _feeds_xml(spark, sf_dir)
    cut = good.select(F.concat(F.lit("cut "), "feed").alias("feed"), F.substring("payload", 1, 60).alias("payload"))
    bare = good.select(F.concat(F.lit("bare "), "feed").alias("feed"), F.regexp_replace("payload", "(?s)<item>.*</item>", "").alias("payload"))
    return P.feed_states(good.unionByName(cut).unionByName(bare), "feed").groupBy("state").agg(F.count("*").alias("feeds"), F.sum("items").alias("items"))


def forum_listing(spark, sf_dir):
    """Listings of one run and source as JSON, pinned items left out."""
    items = table(spark, sf_dir, "raw_items").where("source = 'reddit'").select("run_id", "id", F.struct(F.struct("title", "url", F.col("raw_score").alias("score"), F.col("comment_count").alias("num_comments"), (F.col("id") % 7 == 0).alias("stickied"), F.lit(False).alias("over_18")).alias("data")).alias("c"))
    listed = items.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("id"))).where("n <= 100")
    payload = listed.groupBy("run_id").agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "c"))), lambda x: x["c"]).alias("children")).alias("data"))).alias("payload"))  # 100 a listing
    return P.forum_items(payload).select("run_id", F.col("rank").cast("bigint").alias("rank"), F.sha1("title").alias("title"), "raw_score", F.col("comment_count").cast("bigint").alias("comment_count"))


def search_hits(spark, sf_dir):
    """Results of two queries, by score and by newness; an item found by both counts once, as the first has it."""
    items = table(spark, sf_dir, "raw_items").where("source = 'hackernews' and url is not null").select("id", F.struct(F.col("url").alias("objectID"), "title", "url", F.col("raw_score").alias("points"), F.col("comment_count").alias("num_comments")).alias("h"), "raw_score")
    out = None
    for q, order in ((1, [F.desc("raw_score"), F.asc("id")]), (2, [F.desc("id")])):
        top = items.orderBy(*order).limit(50).withColumn("n", F.row_number().over(Window.orderBy(*order)))  # a result page
        one = top.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]).alias("hits"))).alias("payload")).withColumn("query", F.lit(q))
        out = one if out is None else out.unionByName(one)
    return P.hit_items(out, "query").select("hit", F.sha1("title").alias("title"), "raw_score")


def trending_links(spark, sf_dir):
    """Links of several servers with their accounts by day."""
    items = table(spark, sf_dir, "raw_items").where("url is not null and source in ('mastodon', 'bluesky')").select("source", "id", F.struct("url", "title", F.array(F.struct(F.coalesce("comment_count", F.lit(1)).cast("string").alias("accounts"), F.lit("0").alias("uses")), F.struct(F.lit("2").alias("accounts"), F.lit("0").alias("uses")), F.struct(F.lit("9").alias("accounts"), F.lit("0").alias("uses"))).alias("history")).alias("l"))
    listed = items.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("n <= 200")
    payload = listed.groupBy("source").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n", "l"))), lambda x: x["l"])).alias("payload"))  # 200 a listing
    return P.link_items(payload, "source").select("url", F.sha1("title").alias("title"), "raw_score", "source")


def publisher_suffixes(spark, sf_dir):
    """Titles with their publisher behind a dash, as an aggregator shows them, and without it again."""
    rows = table(spark, sf_dir, "trend_items").select("item_no", F.col("metadata")["publisher"].alias("publisher"), "title")
    shown = F.concat_ws(" - ", "title", F.when(F.col("item_no") % 2 == 0, F.col("publisher")).otherwise(F.lit("Some Paper")))
    return rows.where("publisher is not null").select("item_no", P.without_publisher(shown, F.col("publisher")).alias("bare"))


def resolved_links(spark, sf_dir):
    """Addresses inside an aggregator's links, decoded; links that hold none give null."""
    rows = table(spark, sf_dir, "raw_items").where("url is not null").select("id", "url")
    token = F.translate(F.regexp_replace(F.base64(F.encode(F.concat(F.lit("\b\u0013"), "url"), "UTF-8")), "[=\r\n]", ""), "+/", "-_")
    link = F.when(F.col("id") % 10 == 0, F.col("url")).otherwise(F.concat(F.lit("https://news.google.com/rss/articles/"), token, F.lit("?oc=5")))
    return rows.select("id", P.decode_token(link).alias("url"))


def page_contexts(spark, sf_dir):
    """Pages as HTML, read for their title, description and first long paragraphs."""
    c = table(spark, sf_dir, "cleaned_items").where("context is not null").select("item_id", "title", "description", "context")
    body = F.array_join(F.transform(F.split("context", "\n"), lambda p: F.concat(F.lit("<p>"), P.escape(p), F.lit("</p>"))), "\n")
    html = F.concat(F.lit("<html><head><title>x</title><meta property=\"og:title\" content=\""), P.escape(F.col("title")), F.lit("\"><meta name=\"description\" content=\""), P.escape(F.coalesce("description", F.lit(""))), F.lit("\"></head><body>"), body, F.lit("</body></html>"))
    got = P.page_context(F.col("html"))
    return c.select("item_id", html.alias("html")).select("item_id", F.sha1(got["page_title"]).alias("page_title"), F.length(got["summary"]).cast("bigint").alias("summary"), F.sha1(got["lead"]).alias("lead"))


def channel_velocity(spark, sf_dir):
    """The three fastest items of each feed by comments an hour since capture, against the newest capture."""
    raw = table(spark, sf_dir, "raw_items").where("feed is not null").select("id", "feed", "comment_count", "captured_at")
    newest = raw.agg(F.max("captured_at").alias("newest"))
    rows = P.velocity(raw.join(F.broadcast(newest)), "feed", 3, F.coalesce("comment_count", F.lit(0)).cast("double"), (F.col("newest") - F.col("captured_at")) / 3600, 240.0)
    return rows.select("feed", "id", F.round("rate", 6).alias("rate"), F.col("place").cast("bigint").alias("place"))


def rank_scores(spark, sf_dir):
    """Scores of listed items: the stated count, or the place from the end."""
    t = table(spark, sf_dir, "trend_items").select("item_no", "source", F.col("metadata")["rank"].try_cast("int").alias("rank"), "raw_score")
    n = F.count("rank").over(Window.partitionBy("source"))
    return t.select("item_no", F.coalesce("raw_score", (n - F.col("rank") + 1).cast("double")).alias("score"))


def stored_items(spark, sf_dir):
    """Items appended by run in two writes, three runs replaced, one dropped, and counted as they are stored."""
    raw = table(spark, sf_dir, "raw_items").select("id", "run_id", "source", "kept")
    path = new_path(spark, "items")
    K.append_partitioned(raw.where("id % 2 = 0"), path, "run_id")
    K.append_partitioned(raw.where("id % 2 = 1"), path, "run_id")
    runs = [r.run_id for r in table(spark, sf_dir, "runs").orderBy("run_id").limit(4).collect()]
    K.replace_partitions(raw.where(F.col("run_id").isin(runs[:3]) & (F.col("kept") == 1)), path, "run_id")
    K.drop_partitions(spark, path, "run_id", runs[3:4])
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("items"), F.sum(F.coalesce("kept", F.lit(0)).cast("bigint")).alias("kept"))


def stored_editions(spark, sf_dir):
    """Editions published twice under one name: the newest sound revision and what a differences-only write would touch."""
    a = appearances(spark, sf_dir).select("event_id", "edition_date", "rank", "confidence")
    first = D.latest(a, ["event_id"], [F.asc("edition_date")])
    last = D.latest(a, ["event_id"], [F.desc("edition_date")])
    store = K.Versions(spark, new_path(spark, "editions"))
    store.publish("stories", first)
    store.publish("stories", last.where("rank <= 20"))
    d = K.differences(store.load("stories", 1), store.load("stories"), ["event_id"])
    return d.groupBy("kind").agg(F.count("*").alias("stories"))


QUERIES = {f.__name__: f for f in (rss_feeds, feed_health, forum_listing, search_hits, trending_links, publisher_suffixes, resolved_links, page_contexts, channel_velocity, rank_scores, stored_items, stored_editions)}


def _strip(e: str, limit: int) -> str:
    e = f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        e = f"replace({e}, {Q.q(a)}, {Q.q(b)})"
    return f"substr(trim(regexp_replace({e}, '\\s+', ' ', 'g')), 1, {limit})"


def _esc(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        e = f"replace({e}, {Q.q(a)}, {Q.q(b)})"
    return e


_APP = "a0 as (select event_id, unnest(appearances) x from registry_events), a as (select event_id, x.edition_date d, x.rank r, x.confidence c from a0 qualify row_number() over (partition by event_id, x.edition_date order by x.revision desc, x.seen_utc desc, x.rank) = 1)"
SQL = {
    "rss_feeds": "with t as (select *, row_number() over (partition by feed order by id desc) n from raw_items where feed is not null), k as (select *, count(*) over (partition by feed) c from t where n <= 30) select feed, n::int \"rank\", sha1(trim(title)) title, url, category_hint description, (c - n + 1)::double raw_score from k where trim(title) != ''",
    "feed_health": "with t as (select feed, least(30, count(*)) n from raw_items where feed is not null group by feed) select 'ok' state, count(*) feeds, sum(n)::bigint items from t union all select 'failed', count(*), 0 from t union all select 'empty', count(*), 0 from t",
    "forum_listing": "with t as (select *, row_number() over (partition by run_id order by id) n from raw_items where source = 'reddit') select run_id, n \"rank\", sha1(trim(title)) title, raw_score, comment_count::bigint comment_count from t where n <= 100 and id % 7 != 0 and trim(title) != ''",
    "search_hits": "with i as (select * from raw_items where source = 'hackernews' and url is not null), q as (select 1 q, row_number() over (order by raw_score desc nulls last, id) n, * from i union all select 2, row_number() over (order by id desc), * from i), k as (select * from q where n <= 50 qualify row_number() over (partition by url order by q, n) = 1) select url hit, sha1(trim(title)) title, raw_score from k",
    "trending_links": "with t as (select *, row_number() over (partition by source order by id) n from raw_items where url is not null and source in ('mastodon', 'bluesky')), k as (select *, coalesce(comment_count, 1) + 2 s from t where n <= 200 qualify row_number() over (partition by url order by s desc, n, source desc) = 1) select url, sha1(trim(title)) title, s::double raw_score, source from k",
    "publisher_suffixes": "select item_no, trim(title) bare from trend_items where metadata['publisher'] is not null",
    "resolved_links": "select id, case when id % 10 != 0 then url end url from raw_items where url is not null",
    "page_contexts": f"with c as (select item_id, title, coalesce(description, '') d, list_filter(list_transform(string_split(context, chr(10)), lambda p: {_strip(_esc('p'), 2000)}), lambda p: length(p) >= 60) ps from cleaned_items where context is not null) select item_id, sha1({_strip(_esc('title'), 500)}) page_title, length({_strip(_esc('d'), 500)})::bigint summary, sha1(array_to_string(ps[1:2], ' ')) lead from c",
    "channel_velocity": "with t as (select id, feed, coalesce(comment_count, 0)::double c, ((select max(captured_at) from raw_items where feed is not null) - captured_at) / 3600 age from raw_items where feed is not null), k as (select *, c / greatest(1.0, age) r from t where age between -0.25 and 240) select feed, id, round(r, 6) rate, row_number() over (partition by feed order by r desc, id)::bigint place from k qualify row_number() over (partition by feed order by r desc, id) <= 3",
    "rank_scores": "with t as (select item_no, source, try_cast(metadata['rank'] as int) k, raw_score from trend_items) select item_no, coalesce(raw_score, (count(k) over (partition by source) - k + 1)::double) score from t",
    "stored_items": "with r as (select run_id, row_number() over (order by run_id) n from runs), t as (select i.run_id, coalesce(i.kept, 0) kept, coalesce(r.n, 99) n from raw_items i left join r using (run_id)) select run_id, count(*) items, sum(kept)::bigint kept from t where n > 4 or (n <= 3 and kept = 1) group by run_id",
    "stored_editions": f"with {_APP}, f as (select * from a qualify row_number() over (partition by event_id order by d) = 1), l as (select * from a qualify row_number() over (partition by event_id order by d desc) = 1), m as (select * from l where r <= 20), j as (select case when f.event_id is null then 'new' when m.event_id is null then 'gone' when f.d is distinct from m.d or f.r is distinct from m.r or f.c is distinct from m.c then 'changed' end k from f full join m on f.event_id = m.event_id) select k kind, count(*) stories from j where k is not null group by k",
}
