"""Items from payloads: feeds as XML, listings as JSON, pages as HTML. Fetching is not done here; payloads are columns of text.

Every reader takes a table with a ``payload`` column and whatever identifies it, and gives one row an item, ranked in the payload's
order. A payload that can't be read gives no items and is reported by ``feed_states``; it never ends a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import text as X

_RSS = "channel struct<title:string, item:array<struct<title:string, link:string, description:string, pubDate:string, guid:string>>>"
_ATOM = "title string, entry array<struct<title:string, link:array<struct<_href:string, _rel:string>>, summary:string, updated:string, author:array<struct<name:string>>, category:array<struct<_term:string>>>>"
_FORUM = "struct<data:struct<children:array<struct<data:struct<title:string, url:string, score:double, num_comments:int, stickied:boolean, over_18:boolean>>>>>"
_HITS = "struct<hits:array<struct<objectID:string, title:string, url:string, points:double, num_comments:int>>>"
_LINKS = "array<struct<url:string, title:string, history:array<struct<accounts:string, uses:string>>>>"


def strip_html(text: Column, limit: int = 500) -> Column:
    """Text without tags, character references resolved, at most ``limit`` characters."""
    bare = F.regexp_replace(text, r"<[^>]*>", " ")
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, limit)


def _rank_score(df: DataFrame, *by: str) -> DataFrame:
    """Adds raw_score n - rank + 1 and drops items without a title; rank is kept, as the payload has it."""
    return df.withColumn("raw_score", (F.col("n") - F.col("rank") + 1).cast("double")).drop("n").where(F.coalesce(F.trim("title"), F.lit("")) != "")


def rss_items(payloads: DataFrame) -> DataFrame:
    """Items of RSS payloads: title, url, description, published, rank, raw_score, beside the payload's other columns."""
    rest = [c for c in payloads.columns if c != "payload"]
    one = payloads.select(*rest, F.from_xml("payload", _RSS, {"mode": "PERMISSIVE"}).alias("x")).select(*rest, F.col("x.channel.item").alias("items"))
    each = one.select(*rest, F.size("items").alias("n"), F.posexplode("items").alias("at", "i"))
    flat = each.select(*rest, "n", (F.col("at") + 1).alias("rank"), F.trim("i.title").alias("title"), F.trim(F.coalesce("i.link", "i.guid")).alias("url"), strip_html(F.col("i.description")).alias("description"), F.col("i.pubDate").alias("published"))
    return _rank_score(flat)


def atom_items(payloads: DataFrame) -> DataFrame:
    """Items of Atom payloads; the alternate link wins, categories and the first five authors are arrays."""
    rest = [c for c in payloads.columns if c != "payload"]
    one = payloads.select(*rest, F.from_xml("payload", _ATOM, {"mode": "PERMISSIVE"}).alias("x")).select(*rest, F.col("x.entry").alias("items"))
    each = one.select(*rest, F.size("items").alias("n"), F.posexplode("items").alias("at", "i"))
    link = F.coalesce(F.get(F.filter("i.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get("i.link", F.lit(0))["_href"])
    flat = each.select(
        *rest, "n", (F.col("at") + 1).alias("rank"), F.trim("i.title").alias("title"), F.trim(link).alias("url"), strip_html(F.col("i.summary")).alias("description"), F.col("i.updated").alias("published"),
        F.slice(F.col("i.author.name"), 1, 5).alias("authors"), F.col("i.category._term").alias("categories"),
    )
    return _rank_score(flat)


def forum_items(payloads: DataFrame) -> DataFrame:
    """Items of forum listings as JSON, without pinned and adult ones, best first: by score, then place."""
    rest = [c for c in payloads.columns if c != "payload"]
    one = payloads.select(*rest, F.from_json("payload", _FORUM).alias("x")).select(*rest, F.posexplode(F.col("x.data.children")).alias("at", "c"))
    kept = one.where("not coalesce(c.data.stickied, false) and not coalesce(c.data.over_18, false)")
    return kept.select(*rest, (F.col("at") + 1).alias("rank"), F.trim("c.data.title").alias("title"), F.col("c.data.url").alias("url"), F.col("c.data.score").alias("raw_score"), F.col("c.data.num_comments").alias("comment_count")).where("title != ''")


def hit_items(payloads: DataFrame, order: str) -> DataFrame:
    """Items of search results as JSON: of several queries, ranked by ``order``, the first hit of an id counts."""
    one = payloads.select(order, F.posexplode(F.from_json("payload", _HITS)["hits"]).alias("at", "h"))
    first = one.groupBy(F.col("h.objectID").alias("hit")).agg(F.min_by("h", F.struct(order, "at")).alias("h"))
    return first.select("hit", F.trim("h.title").alias("title"), F.col("h.url").alias("url"), F.col("h.points").alias("raw_score"), F.col("h.num_comments").alias("comment_count"))


def link_items(payloads: DataFrame, server: str) -> DataFrame:
    """Trending links as JSON, of several servers: accounts of the first two days add up, the best server's entry of a url stays."""
    one = payloads.select(server, F.posexplode(F.from_json("payload", _LINKS)).alias("at", "l"))
    score = F.aggregate(F.slice("l.history", 1, 2), F.lit(0.0), lambda s, h: s + F.coalesce(h["accounts"].try_cast("double"), F.lit(0.0)))
    rows = one.select(server, "at", F.col("l.url").alias("url"), F.trim("l.title").alias("title"), score.alias("raw_score")).where("url is not null")
    best = rows.groupBy("url").agg(F.max_by(F.struct("title", "raw_score", server), F.struct(F.col("raw_score"), -F.col("at"), server)).alias("b"))
    return best.select("url", "b.title", "b.raw_score", F.col(f"b.{server}").alias(server))


def without_publisher(title: Column, publisher: Column) -> Column:
    """A headline without its trailing publisher: the exact one if known, else what stands after the last dash."""
    exact = F.endswith(title, F.concat(F.lit(" - "), publisher))
    cut = F.left(title, F.length(title) - F.length(publisher) - 3)
    return F.trim(F.when(exact, cut).otherwise(F.regexp_replace(title, r"\s+-\s+[^-]{2,60}$", "")))


def page_context(html: Column) -> dict[str, Column]:
    """Title, description and the first two paragraphs of 60 characters or more of a page."""
    og = F.regexp_extract(html, r"<meta\s+property=\"og:title\"\s+content=\"([^\"]*)\"", 1)
    plain = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    meta = F.regexp_extract(html, r"<meta\s+name=\"description\"\s+content=\"([^\"]*)\"", 1)
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), lambda p: strip_html(p, 2000))
    return {"page_title": strip_html(F.when(og != "", og).otherwise(plain)), "summary": strip_html(meta), "lead": F.concat_ws(" ", F.slice(F.filter(paragraphs, lambda p: F.length(p) >= 60), 1, 2))}


def decode_token(url: Column) -> Column:
    """The address inside an aggregator's link, if its last path part is base64 of one; else null."""
    token = F.regexp_extract(url, r"/articles/([A-Za-z0-9_-]+)", 1)
    pad = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), "=")
    text = F.try_to_binary(pad, F.lit("base64")).cast("string")
    found = F.regexp_extract(text, r"(https?://[\x21-\x7E]+)", 1)
    return F.when((token != "") & (found != ""), found)


def make_items(rows: DataFrame) -> DataFrame:
    """The common form of an item: trimmed titles of at most 1,000 characters; rows without a title go."""
    title = F.substring(F.trim("title"), 1, 1000)
    return rows.withColumn("title", title).where(F.col("title") != "")


def publication_time(stated: Column, retrieved: Column) -> Column:
    """(value, note): times before 1995 or more than 15 minutes after retrieval are refused, those within are set to retrieval."""
    skew = F.expr("interval 15 minutes")
    return (
        F.when(stated.isNull(), F.struct(F.lit(None).cast("timestamp").alias("value"), F.lit("missing").alias("note")))
        .when(stated < F.lit("1995-01-01").cast("timestamp"), F.struct(F.lit(None).cast("timestamp").alias("value"), F.lit("too old").alias("note")))
        .when(stated > retrieved + skew, F.struct(F.lit(None).cast("timestamp").alias("value"), F.lit("in the future").alias("note")))
        .when(stated > retrieved, F.struct(retrieved.alias("value"), F.lit("clamped").alias("note")))
        .otherwise(F.struct(stated.alias("value"), F.lit("stated").alias("note")))
    )


def velocity(items: DataFrame, channel: str, k: int, views: Column, age_hours: Column, oldest: float = 72.0) -> DataFrame:
    """Views an hour of items at most ``oldest`` hours old and not more than a quarter of an hour ahead: the k best of each channel."""
    rows = items.withColumn("age", age_hours).where((F.col("age") <= oldest) & (F.col("age") >= -0.25)).withColumn("rate", views / F.greatest(F.lit(1.0), F.col("age")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(channel).orderBy(F.desc("rate"), "id"))).where(F.col("place") <= k)


def feed_states(payloads: DataFrame, feed: str) -> DataFrame:
    """(feed, state, items): ok, empty, or failed for a payload that is no feed; counted without ending the job."""
    n = F.size(F.from_xml("payload", _RSS, {"mode": "PERMISSIVE"})["channel"]["item"])
    state = F.when(F.coalesce(n, F.lit(-1)) > 0, "ok").when(F.col("payload").rlike(r"(?s)^\s*<(?:\?xml|rss)\b.*</rss>\s*$"), "empty").otherwise("failed")
    return payloads.select(feed, state.alias("state"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint").alias("items"))


def escape(text: Column) -> Column:
    """Text for XML: without control characters, signs as references."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def feed_xml(items: DataFrame, feed: str, order: list[Column], newest: int = 30) -> DataFrame:
    """(feed, payload): an RSS feed of the ``newest`` items of each feed; title, url and description columns."""
    top = items.withColumn("_n", F.row_number().over(Window.partitionBy(feed).orderBy(*order))).where(F.col("_n") <= newest)
    one = F.concat(F.lit("<item><title>"), escape(F.coalesce("title", F.lit(""))), F.lit("</title><link>"), escape(F.coalesce("url", F.lit(""))), F.lit("</link><description>"), escape(F.coalesce("description", F.lit(""))), F.lit("</description></item>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", one.alias("x")))), lambda s: s["x"]), "")  # at most ``newest``
    return top.groupBy(feed).agg(F.concat(F.lit("<?xml version=\"1.0\"?><rss version=\"2.0\"><channel><title>"), escape(F.first(feed)), F.lit("</title>"), body, F.lit("</channel></rss>")).alias("payload"))
