"""Search over stored texts: parsed queries, word-start matches, scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.functions import text as X

#: Terms of a query that count.
TERMS = 8


def parse_query(query: str) -> list[str]:
    """Up to eight terms; what stands in quotes is one phrase. Terms are folded as the texts are."""
    found = [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]
    folded = (re.sub(r"[^a-z0-9]+", " ", t.lower().translate(str.maketrans(X.FOLD_FROM, X.FOLD_TO))).strip() for t in found)
    return [t for t in dict.fromkeys(folded) if t][:TERMS]


def search(docs: DataFrame, query: str, headline: str, body: str, top: Column | None = None) -> DataFrame:
    """Rows in which every term begins a word of the headline or the body, with a score: 3 a term in the headline, else 1, and half a
    point for ``top`` rows. An empty query finds nothing. One pass over the rows; a query's size is bounded, theirs isn't.
    """
    terms = parse_query(query)
    if not terms:
        return docs.limit(0).withColumn("score", F.lit(0.0))
    d = docs.withColumns({"_h": F.concat(F.lit(" "), X.fold(F.coalesce(headline, F.lit("")))), "_b": F.concat(F.lit(" "), X.fold(F.coalesce(body, F.lit(""))))})
    hits = [(F.col("_h").contains(" " + t), F.col("_b").contains(" " + t)) for t in terms]
    score = F.when(F.coalesce(top, F.lit(False)), 0.5).otherwise(0.0) if top is not None else F.lit(0.0)
    for h, _ in hits:
        score = score + F.when(h, 3.0).otherwise(1.0)
    wanted = None
    for h, b in hits:
        wanted = (h | b) if wanted is None else wanted & (h | b)
    return d.where(wanted).withColumn("score", score).drop("_h", "_b")


def topics(items: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, topic): whole words or phrases of ``words``, a reader's list, that a text mentions, in any case."""
    low = F.concat(F.lit(" "), X.fold(F.coalesce(text, F.lit(""))), F.lit(" "))
    found = F.filter(F.array(*[F.when(low.contains(f" {' '.join(parse_query(chr(34) + w + chr(34)))} "), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    return items.select(key, F.explode(found).alias("topic"))
