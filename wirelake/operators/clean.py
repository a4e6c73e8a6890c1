"""Cleaning, folding, scoring and selecting raw items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.functions import text as X


def judge(items: DataFrame) -> DataFrame:
    """Adds clean (the normalised title) and reason, the first rule that an item breaks, or null.

    items: source, title, raw_score, comment_count, and description, subreddit, rank (int) where known. Rules in order: thresholds of
    the source, generic hashtags, structure, then content. Forum items without counts count as verified by their rank, up to 10.
    """
    for name, kind in (("description", "string"), ("subreddit", "string"), ("rank", "int")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    items = X.pinned(items.drop("clean", "reason"), clean=X.clean_title(c("source"), c("title"))).withColumn("alnum", F.regexp_replace("clean", r"[^A-Za-z0-9]", ""))
    tag = F.when(c("source").isin(V.TAG_SOURCES), c("title"))
    bare = F.replace(F.regexp_replace(F.lower(X.normalize(tag)), r"^#+", ""), F.lit(" "), F.lit(""))
    score, n = F.coalesce("raw_score", F.lit(0.0)), F.coalesce("comment_count", F.lit(0))
    social = c("source").isin(V.SOCIAL_SOURCES)
    reason = (
        F.when((c("source") == "reddit") & F.lower("subreddit").isin(V.LOW_SIGNAL_SUBREDDITS), "reddit_low_signal_subreddit")
        .when((c("source") == "reddit") & ((score < 20) | (n < 5)) & ~F.coalesce(c("rank") <= 10, F.lit(False)), "reddit_low_engagement")
        .when((c("source") == "hackernews") & (score < 10), "hn_low_points")
        .when((c("source") == "github") & (score < 20), "github_low_stars")
        .when(c("source").isin(V.TAG_SOURCES) & (bare.isin(V.GENERIC_HASHTAGS) | bare.rlike(V.GENERIC_HASHTAG)), "generic_hashtag")
        .when((F.length("alnum") < 3) | c("alnum").rlike(r"^[0-9]+$"), "too_short_or_non_ascii")
        .when(c("source").isin(V.ANECDOTE_SOURCES) & c("clean").rlike(V.ANECDOTE), "personal_anecdote")
        .when(social & c("clean").rlike(V.MEME_PHOTO), "meme_or_photo")
        .when(social & c("clean").rlike(V.PET), "pet_post")
        .when(~c("source").isin("arxiv", "github") & c("clean").rlike(V.BOX_SCORE), "box_score_or_betting")
        .when(F.concat_ws(" ", "clean", F.substring(F.coalesce("description", F.lit("")), 1, 300)).rlike(V.PROMOTION), "promotional")
        .when((c("source") == "youtube") & c("title").rlike(V.VIDEO_CLIP), "video_clip")
        .when(social & (F.size(X.significant_tokens(c("clean"))) == 0) & ~c("clean").rlike("[A-Z]"), "no_signal_tokens")
    )
    return X.pinned(items, reason=reason).drop("alnum")


def fold_exact(items: DataFrame, key: str, order: str, best: str) -> DataFrame:
    """One row for each key: the item of the best score (the earliest winning ties) and what its copies add."""
    top = F.max_by(F.col(order), F.struct(F.coalesce(F.col(best), F.lit(0.0)), -F.col(order)))
    return items.where(F.col(key) != "").groupBy(key).agg(
        top.alias("best_id"), F.min(order).alias("first_id"), F.count("*").alias("copies"), F.count_distinct("source").alias("sources"), F.count_distinct("url").alias("urls")
    )


def mid_rank(items: DataFrame, by: str, value: str) -> DataFrame:
    """Mid-rank percentile of ``value`` within ``by``: (below + half of the equal ones) / n; a lone item has 0.75.

    Counts of distinct values are ranked instead of rows, so one hot group is a window over its distinct values only.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    counts = items.withColumn("v", v).groupBy(by, "v").agg(F.count("*").alias("equal"))
    w = Window.partitionBy(by)
    below = F.sum("equal").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.select(by, "v", F.when(F.sum("equal").over(w) <= 1, 0.75).otherwise((F.coalesce(below, F.lit(0)) + 0.5 * F.col("equal")) / F.sum("equal").over(w)).alias("pct"))
    return items.withColumn("v", v).join(ranked, [by, "v"]).drop("v")


def fair_floors(items: DataFrame, scope: str, group: str, score: str, key: str, floor: Column, cap: int, share: float = 0.75) -> DataFrame:
    """Within each scope at most ``cap`` items: every group's best ones first, in rounds, up to ``share`` of the cap; then by score.

    floor: how many of its group an item's rank may be to count as a floor. An item beyond the first ``cap`` of its group can't be
    chosen, so each group is cut to those before the scope is ranked: that window holds ``cap`` rows a group, whatever its size.
    """
    by = [F.desc(score), F.asc(key)]
    placed = items.withColumn("rn", F.row_number().over(Window.partitionBy(scope, group).orderBy(*by))).where(F.col("rn") <= cap)
    placed = placed.withColumn("lead", F.max(score).over(Window.partitionBy(scope, group))).withColumn("floor", floor)
    inside = F.col("rn") <= F.col("floor")
    turn = F.row_number().over(Window.partitionBy(scope).orderBy(F.when(inside, F.col("rn")), F.desc("lead"), F.asc(group), F.asc(key)))
    chosen = placed.withColumn("turn", F.when(inside, turn - F.count_if(~inside).over(Window.partitionBy(scope)))).withColumn("by_floor", inside & (F.col("turn") <= int(cap * share)))
    order = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("by_floor"), *by))
    return chosen.withColumn("place", order).where(F.col("place") <= cap).drop("rn", "lead", "turn", "floor")


def interleave(items: DataFrame, scope: str, group: str, key: str, cap: int) -> DataFrame:
    """Round robin over the groups of a scope by position, up to ``cap`` items; each group is cut to its first ``cap`` first."""
    rn = F.row_number().over(Window.partitionBy(scope, group).orderBy(key))
    turn = F.row_number().over(Window.partitionBy(scope).orderBy("round", group))
    return items.withColumn("round", rn).where(F.col("round") <= cap).withColumn("turn", turn).where(F.col("turn") <= cap)


def corroboration(items: DataFrame, cap_share: float = 0.08) -> DataFrame:
    """For each item the sources other than its own that share one of its distinctive tokens, as others.

    items: id, source, title, sources (array: where its copies come from). Distinctive tokens occur in at most max(3, ``cap_share``
    of all items); their source sets are small (one entry a source).
    """
    total = items.agg(F.greatest(F.lit(3), F.floor(F.count("*") * cap_share)).alias("cap"))
    tok = items.select("id", "source", "sources", F.explode(X.significant_tokens(F.col("title"))).alias("token"))
    from_ = tok.select("token", F.explode("sources").alias("s")).groupBy("token").agg(F.collect_set("s").alias("seen"))
    rare = tok.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(total)).where("df <= cap").join(from_, "token").select("token", "seen")
    other = tok.join(rare, "token").select("id", "source", F.explode("seen").alias("other")).where("other != source").groupBy("id").agg(F.count_distinct("other").alias("others"))
    return items.join(other, "id", "left").withColumn("others", F.coalesce("others", F.lit(0)))


def heuristic_score(pct: Column, source: Column, others: Column, sources: Column, comments: Column) -> Column:
    """From rank in its source, other sources with its words, sources of its copies, and comments; between 0 and 1."""
    weights = F.create_map(*[F.lit(x) for kv in V.SOURCE_WEIGHT.items() for x in kv])
    talk = F.when(F.coalesce(comments, F.lit(0)) > 0, F.least(F.lit(0.10), F.log10(1 + comments) / 30)).otherwise(0.0)
    raw = 0.20 + 0.45 * pct * F.coalesce(weights[source], F.lit(0.6)) + F.least(F.lit(3), others) * 0.10 + F.least(F.lit(0.15), 0.05 * (sources - 1)) + talk
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
