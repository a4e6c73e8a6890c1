"""Texts in containers of fixed capacity (problem 8): shortest-pack-first packing over the length histogram.

Lengths are token counts of a public tokenizer. Only the histogram (at most one entry per length up to the capacity) reaches
the driver. Lengths are placed longest first, each on the packing patterns with the shortest contents, whole counts of a
pattern at a time, so the work does not depend on the number of texts. Patterns become intervals of ranks: the r-th text of a
length has one container. Ranks are counted by hash bucket and prefix sums, the buckets of a length following its count, so one
length may hold any share of the texts.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.session import spread, stage, table

CAPACITY = 2048
#: A public vocabulary as base64 pieces and ranks; any file of the kind will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that vocabulary's texts are split before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of one length that are ranked in one task, about.
RANKED = 100_000
_LOADED: dict[str, object] = {}


def _encoder(path: str):
    """The tokenizer, loaded once in each worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every row; a null text has 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t.as_py() or "")) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n], names=["doc_id", "n_tokens"])

    texts = spread(documents.select("doc_id", "text"))
    return texts.mapInArrow(count, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens long")


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing patterns, each a list of (length, times) with the number of its containers: every item has exactly one place.

    Lengths come longest first. A length goes on the pattern of the shortest contents that has room, whole counts at a time, so
    each length splits at most one pattern. What fits nowhere opens the fewest containers that hold it, spread evenly. There are
    thus at most two patterns for each length of the histogram, and one pattern has at most sqrt(2 x capacity) different lengths.
    """
    done: list[tuple[list[tuple[int, int]], int]] = []
    open_: list[tuple[int, int, list[tuple[int, int]], int]] = []  # contents, order of opening, lengths, containers
    order = 0

    def put(used: int, lengths: list[tuple[int, int]], count: int, into: list) -> None:
        nonlocal order
        order += 1
        if used == capacity:
            done.append((lengths, count))
        elif count:
            into.append((used, order, lengths, count))

    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if open_ and open_[0][0] + length <= capacity:
                used, at, lengths, count = heapq.heappop(open_)
                n = min(left, count)
                left -= n
                if n < count:
                    heapq.heappush(open_, (used, at, lengths, count - n))
                *rest, (last, times) = lengths
                put(used + length, [*rest, (last, times + 1)] if last == length else [*lengths, (length, 1)], n, grown)
            elif grown:  # the patterns that took this length may take another one
                for g in grown:
                    heapq.heappush(open_, g)
                grown = []
            else:
                need = -(-left // (capacity // length))
                each, more = divmod(left, need)
                put((each + 1) * length, [(length, each + 1)], more, grown)
                put(each * length, [(length, each)], need - more, grown)
                break
        for g in grown:
            heapq.heappush(open_, g)
    return done + [(lengths, count) for _, _, lengths, count in open_]


def fill(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> float:
    """Used share of all containers."""
    room = sum(count for _, count in patterns) * capacity
    return sum(x * times * count for lengths, count in patterns for x, times in lengths) / room if room else 1.0


#: Ranks of one length stay below this.
_RANKS = 1 << 44


def intervals(patterns: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks by length: sorted starts (length x ``_RANKS`` + first rank), first container and number of containers of each."""
    rows: list[tuple[int, int, int]] = []
    nexts: dict[int, int] = {}
    base = 0
    for lengths, count in patterns:
        for x, times in lengths:
            at = nexts.get(x, 0)
            rows.append((x * _RANKS + at, base, count))
            nexts[x] = at + times * count
        base += count
    start, first, count = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return start, first, count


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, n_tokens, container) of every text.

    documents: doc_id, text; other columns are ignored, repeated ids are packed each on its own. A text longer than the
    capacity is split into full pieces and a rest, numbered from 0; no other text is split. Null texts and texts without a
    token need no room: their row has n_tokens 0 and a null container. Equal inputs give equal containers.
    """
    spark = documents.sparkSession
    counted = stage(token_counts(documents, tokenizer), "token_counts")
    full = (F.col("n_tokens") / capacity).cast("long")
    whole = F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("long") - 1)
    pieces = counted.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(whole).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") < full, capacity).otherwise(F.col("n_tokens") % capacity).cast("int").alias("length")
    )
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(intervals(pack(histogram, capacity)))  # at most 2 x capacity patterns of few lengths
    buckets = spark.createDataFrame([(x, -(-n // RANKED)) for x, n in histogram.items()], "length int, buckets long")  # at most ``capacity`` rows
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))
    bucketed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", bucket)
    counts = stage(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "length_counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = bucketed.withColumn("inside", inside).join(offsets, ["length", "bucket"]).select("doc_id", "piece", F.col("length").alias("n_tokens"), (F.col("offset") + F.col("inside")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, count = places.value
        for b in batches:
            wanted = b.column("n_tokens").to_numpy().astype(np.int64) * _RANKS + b.column("rank").to_numpy()
            at = np.searchsorted(start, wanted, "right") - 1
            out = first[at] + (wanted - start[at]) % count[at]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("n_tokens"), pa.array(out)], names=["doc_id", "piece", "n_tokens", "container"])

    kind = dict(pieces.dtypes)["doc_id"]
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, n_tokens int, container long")
    bare = counted.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(bare)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(table(spark, sf_dir, "documents"))


QUERIES = {"p8_containers": p8_containers}
