"""Evaluation passages inside documents (problem 9): Wu-Manber search over words.

The symbols are words, so punctuation, spacing and line breaks don't count. The patterns are all windows of ``WINDOW`` words
of all passages. A shift table over blocks of words tells how far the search may jump: a block that no pattern has lets it skip
``WINDOW`` - 1 words or one less for each further word of a block, so most of a clean document is never looked at. Where the shift
is zero, the block is a pattern's last one: its bucket gives the pattern positions, whose first word and then all words are
compared directly. A block has two words, and one more for each thousandfold of the passage words beyond ``FEW``, so that with many
test items zero shifts and full buckets stay rare.

The passages go to the executors in blocks of at most ``BLOCK_WORDS`` words, one pass over the documents for each block, so
that what is broadcast is bounded however many test items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.lookalike import plain_text
from wirelake.session import spread, table

#: Consecutive words that make a leak.
WINDOW = 12
#: Passage words in one block of patterns.
BLOCK_WORDS = 1_000_000
#: Passage words up to which blocks of two words will do.
FEW = 50_000
_WORD = re.compile(r"[^\W_]+")


def text_words(text: str) -> list[str]:
    if not text.isascii() or "&" in text:
        text = plain_text(text)
    return _WORD.findall(text.lower().replace("ß", "ss"))


class WuManber:
    """Shift table and suffix buckets for all windows of the passages (item, words)."""

    def __init__(self, passages: list[tuple[int, list[str]]], window: int = WINDOW, block: int | None = None):
        self.window, self.passages = window, [p for p in passages if len(p[1]) >= window]
        total, size = sum(len(w) for _, w in self.passages), 2
        while total > FEW * 1000 ** (size - 2):
            size += 1
        self.block = min(block or size, window)
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(self.passages):
            for j in range(self.block, len(words) + 1):
                at = tuple(words[j - self.block : j])
                left = max(0, window - j)  # words between this block and the end of the first window that has it
                self.shift[at] = min(self.shift.get(at, left), left)
                if not left:
                    self.bucket.setdefault(at, []).append((k, j))

    def items(self, words: list[str]) -> set[int]:
        """Items of which ``words`` hold a window."""
        found: set[int] = set()
        at, end, size = self.window, len(words), self.block
        skip, get = self.window - size + 1, self.shift.get
        while at <= end:
            here = tuple(words[at - size : at])
            jump = get(here, skip)
            if not jump:
                start = at - self.window
                for k, stop in self.bucket[here]:
                    item, passage = self.passages[k]
                    if item not in found and passage[stop - self.window] == words[start] and passage[stop - self.window : stop] == words[start:at]:
                        found.add(item)
                jump = 1
            at += jump
        return found


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): documents that hold at least ``window`` consecutive words of an item's passage.

    documents: doc_id, text; items: item_id, passage; other columns are ignored. Null and empty texts, and passages shorter
    than the window, are never cases. A pair comes once, however often the passage occurs; repeated ids come once each row.
    """
    spark = documents.sparkSession
    items = items.where("passage is not null").select("item_id", "passage")
    total = items.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * block_words)))
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        search = WuManber([(r.item_id, text_words(r.passage)) for r in part.collect()], window)
        hits = _search(documents, spark.sparkContext.broadcast(search), dict(items.dtypes)["item_id"])
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def _search(documents: DataFrame, search, item_type: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = search.value.items
        for b in batches:
            rows, items = [], []
            for i, text in enumerate(b.column("text")):
                for item in find(text_words(text.as_py())):
                    rows.append(i)
                    items.append(item)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(items)], names=["doc_id", "item_id"])

    texts = spread(documents.where("text is not null and text != ''").select("doc_id", "text"))
    return texts.mapInArrow(scan, f"doc_id {dict(texts.dtypes)['doc_id']}, item_id {item_type}")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each test item: the documents it leaked into."""
    hits = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite").join(hits, "item_id")


QUERIES = {"p9_found": p9_found, "p9_leak_report": p9_leak_report}
