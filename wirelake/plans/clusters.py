"""Groups of items as clusters: relevance, drops, best titles, combined scores."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from wirelake.functions import sql as Q
from wirelake.functions import text as X
from wirelake.operators import editions as D
from wirelake.plans.runs import SQL as RUNS
from wirelake.plans.runs import source_balanced_momentum
from wirelake.session import table


def relevance(score: Column, platforms: Column, publishers: Column, n: Column) -> Column:
    """1 to 10: mean score, platforms and publishers up to three, and size up to eight, weighted .40, .20, .15 and .25."""
    cap = lambda c: F.least(F.lit(1.0), c)
    return 1 + 9 * (0.40 * cap(score) + 0.20 * cap(platforms / 3) + 0.15 * cap(publishers / 3) + 0.25 * cap(F.log2(1 + n) / F.log2(F.lit(9.0))))


def _facts(rows, *by: str):
    """Counts of a group; sources and hosts are pre-aggregated, so a group of any size is a few rows when it is counted."""
    one = rows.groupBy(*by, "source", X.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.sum(F.coalesce("heuristic_score", F.lit(0.0)).cast("decimal(20,6)")).alias("s"), F.min("id").alias("first_id"))
    return one.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("s").cast("double") / F.sum("n")).alias("score"), F.count_distinct("source").alias("platforms"), F.count_distinct("host").alias("publishers"), F.min("first_id").alias("first_id"))


def cluster_relevance(spark, sf_dir):
    """Relevance of each group of one title, and why it would be dropped: alone without a good score, or of little relevance."""
    rows = table(spark, sf_dir, "raw_items").withColumn("key", X.dedupe_key(F.col("title"))).where("key != ''")
    f = _facts(rows, "key").withColumn("relevance", F.round(relevance(F.col("score"), F.col("platforms"), F.col("publishers"), F.col("n")), 4))
    why = F.when((F.col("n") == 1) & (F.col("score") < 0.8) & (F.col("relevance") < 7), "singleton").when(F.col("relevance") < 4, "low_relevance")
    return f.select("first_id", "n", "platforms", "publishers", "relevance", why.alias("dropped"))


def best_titles(spark, sf_dir):
    """The title of each group of two or more that says most: of its six best scored ones, the score and up to eight tokens count."""
    rows = table(spark, sf_dir, "raw_items").select("id", X.dedupe_key(F.col("title")).alias("key"), F.coalesce("heuristic_score", F.lit(0.0)).alias("s"), F.size(X.tokens(F.col("title"))).alias("t")).where("key != ''")
    sized = rows.join(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1"), "key")
    top = sized.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("s"), "id"))).where("k <= 6")
    return D.latest(top, ["key"], [F.desc(F.round(F.col("s") + 0.04 * F.least("t", F.lit(8)), 6)), F.asc("id")]).select("first_id", F.col("id").alias("best_id"))


def combined_scores(spark, sf_dir):
    """Each run's categories by relevance and velocity together, .6 and .4, numbered from the best."""
    rows = table(spark, sf_dir, "raw_items").where("category_hint is not null")
    f = _facts(rows, "run_id", "category_hint").withColumn("relevance", relevance(F.col("score"), F.col("platforms"), F.col("publishers"), F.col("n")))
    j = f.join(source_balanced_momentum(spark, sf_dir).withColumnRenamed("entity", "category_hint"), ["run_id", "category_hint"])
    c = j.withColumn("combined", F.round(0.6 * F.round("relevance", 6) * 10 + 0.4 * F.col("velocity"), 2))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("combined"), F.desc("n"), "category_hint"))
    return c.select("run_id", "category_hint", "combined", "momentum", place.cast("bigint").alias("place"))


def run_velocity(spark, sf_dir):
    """A run's velocity: its categories' velocities weighted by their items, and the category with most of them."""
    n = table(spark, sf_dir, "raw_items").where("category_hint is not null").groupBy("run_id", F.col("category_hint").alias("entity")).agg(F.count("*").alias("n"))
    j = source_balanced_momentum(spark, sf_dir).join(n, ["run_id", "entity"])
    return j.groupBy("run_id").agg(F.round(F.sum(F.col("n") * F.col("velocity")) / F.sum("n"), 3).alias("velocity"), F.min_by("entity", F.struct(-F.col("n"), "entity")).alias("lead"))


QUERIES = {f.__name__: f for f in (cluster_relevance, best_titles, combined_scores, run_velocity)}

_REL = "1 + 9 * (0.40::double * least(1.0::double, score) + 0.20::double * least(1.0::double, platforms / 3) + 0.15::double * least(1.0::double, publishers / 3) + 0.25::double * least(1.0::double, log2(1 + n) / log2(9.0::double)))"
_FACTS = f"count(*) n, sum(coalesce(heuristic_score, 0)::decimal(20,6))::double / count(*) score, count(distinct source) platforms, count(distinct {Q.host('url')}) publishers, min(id) first_id"
SQL = {
    "cluster_relevance": f"with f as (select {Q.dedupe_key('title')} as key, {_FACTS} from raw_items group by 1), r as (select *, round({_REL}, 4) relevance from f where key != '') select first_id, n, platforms, publishers, relevance, case when n = 1 and score < 0.8 and relevance < 7 then 'singleton' when relevance < 4 then 'low_relevance' end dropped from r",
    "best_titles": f"with t as (select id, {Q.dedupe_key('title')} as key, coalesce(heuristic_score, 0) s, len({Q.tokens('title')}) t from raw_items), n as (select *, count(*) over (partition by key) n, min(id) over (partition by key) first_id, row_number() over (partition by key order by s desc, id) k from t where key != '') select first_id, id best_id from n where n > 1 and k <= 6 qualify row_number() over (partition by key order by round(s + 0.04::double * least(t, 8), 6) desc, id) = 1",
    "combined_scores": f"with f as (select run_id, category_hint, {_FACTS} from raw_items where category_hint is not null group by 1, 2), v as ({RUNS['source_balanced_momentum']}), c as (select f.run_id, category_hint, n, momentum, round(0.6::double * round({_REL}, 6) * 10 + 0.4::double * velocity, 2) combined from f join v on v.run_id = f.run_id and v.entity = f.category_hint) select run_id, category_hint, combined, momentum, row_number() over (partition by run_id order by combined desc, n desc, category_hint)::bigint place from c",
    "run_velocity": f"with v as ({RUNS['source_balanced_momentum']}), n as (select run_id, category_hint entity, count(*) n from raw_items where category_hint is not null group by 1, 2) select run_id, round(sum(n * velocity) / sum(n), 3) velocity, arg_min(entity, {{'n': -n, 'e': entity}}) lead from v join n using (run_id, entity) group by run_id",
}
