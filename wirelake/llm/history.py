"""New batches against all history (problem 1): multi-key sorted-neighbourhood runs.

Every accepted text has several sort keys: its rarest word bits (the k-th occurrence of a word), one more than a near text can
lack. The keys of a batch are one sorted run, cut into ``RANGES`` fixed ranges of the key space; the store is a list of such runs.
A new batch reads the ranges that its own keys fall into, and a new text is compared with its neighbours only: the window around
it is the block of entries with the same sort key and a length within the bound, so no fixed width can cut a neighbour off.

What a batch costs: its own rows are tokenised, sorted and written once. Of the history it reads the narrow key columns of those
ranges, joined against the batch (Spark broadcasts the batch's side while it is small, so the history isn't shuffled), and the
words of the neighbours only. Old texts are never tokenised, sorted or compared with each other again. Runs are compacted in
tiers: when ``TIER`` runs of one level are there, they are merged into one of the next, so an entry is rewritten once a level.

The order of bits is that of a table of estimated counts (``BUCKETS`` entries, whatever the data), frozen with the store's first
batch: any fixed order finds the same pairs, a good one only makes blocks short. ``rebuild`` renews it. A block of one key holds
different texts only, since equal word bags are folded, and is joined by sort-merge, which splits skewed keys.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wirelake.llm.lookalike import plain
from wirelake.llm.neardup import BUCKETS, STEP, _bucket, bags, missing_bound, with_bits
from wirelake.session import new_path, spread, stage, table

#: Ranges of a store's hash keys, cut evenly.
RANGES = 16
#: Runs of one level that are merged into one of the next.
TIER = 3


SCHEMAS = {
    "texts": "k1 long, k2 int, start double, bits array<bigint>, rng int",
    "hashes": "h1 long, h2 int, start double, rng int",
    "keys": "key long, k1 long, k2 int, start double, n int, rng int",
}


def _bits(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bits of a batch: text index and bit of each, and the bits of each text."""
    col = batch.column("bits")
    n = np.diff(col.offsets.to_numpy()).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), col.flatten().to_numpy(zero_copy_only=False), n


def bit_counts(texts: DataFrame) -> np.ndarray:
    """Estimated counts by bucket of bits, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(_bucket(_bits(b)[1]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return _array(texts.select("bits").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())


def _array(got: pd.DataFrame) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def sort_keys(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(rng, key, k1, k2, n, start): each text under its sort keys, without its words.

    Keys are the rarest bits in the frozen order, one more than a near text can lack. Of two near texts the first shared bit in
    that order is then a key of both.
    """
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                b = batch.slice(i, STEP)
                rec, bit, n = _bits(b)
                by = np.lexsort((bit, shared.value[_bucket(bit)], rec))
                rec, bit = rec[by], bit[by]
                keep = np.arange(len(rec)) - (np.cumsum(n) - n)[rec] <= missing_bound(n)[rec]
                at = pa.array(rec[keep])
                out = [b.column(c).take(at) for c in ("k1", "k2", "start")]
                yield pa.RecordBatch.from_arrays([pa.array(bit[keep]), *out, pa.array(n[rec[keep]].astype(np.int32))], names=["key", "k1", "k2", "start", "n"])

    got = texts.select("k1", "k2", "start", "bits").mapInArrow(sign, "key long, k1 long, k2 int, start double, n int")
    return got.select(key_range("key").alias("rng"), "*")


def key_range(key: str) -> Column:
    return F.shiftrightunsigned(key, 64 - (RANGES - 1).bit_length()).cast("int")


def report_url(url: Column) -> Column:
    """A url without scheme, leading www., case of the host, query, fragment and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"/.*$", 0), r"/+$", ""))


def report_title(title: Column) -> Column:
    """``t:`` and the title in lower-case ASCII, every other run of characters made one space."""
    bare = F.regexp_replace(F.lower(_ascii(plain(title))), r"[^a-z0-9]+", " ")
    return F.concat(F.lit("t:"), F.trim(bare))


def _ascii(col: Column) -> Column:
    """Accented Latin letters without their accents; the form of ``plain`` has them composed."""
    src = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŠšŽžĀāĂăĄąĆćČčĎďĒēĔĕĖėĘęĚěĞğĪīĬĭĮįİıŁłŃńŇňŌōŎŏŐőŘřŚśŞşŢţŤťŪūŬŭŮůŰűŲųŹźŻż"
    dst = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyySsZzAaAaAaCcCcDdEeEeEeEeEeGgIiIiIiIiLlNnNnOoOoOoRrSsSsTtTtUuUuUuUuUuZzZz"
    out = F.translate(col, src, dst)
    for a, b in (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _short(col: str, name: str) -> list[Column]:
    """A text as a 96-bit key in two columns; null stays null."""
    c = F.col(col)
    return [F.when(c.isNotNull(), F.xxhash64(c)).alias(f"{name}1"), F.when(c.isNotNull(), F.hash(c)).alias(f"{name}2")]


class History:
    """What earlier valid runs brought, as runs sorted by key in fixed key ranges under one folder of the shared file system.

    Of each run ``texts`` has the words and first valid start of each word bag, ``hashes`` the first start of each content hash,
    ``keys`` the sorted entries. A run counts once the manifest lists it, so a batch that failed leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, tier: int = TIER):
        self.spark, self.path, self.tier = spark, path or new_path(spark, "history"), tier
        self.runs: list[tuple[str, int]] = []  # folder and level
        self.counts: np.ndarray | None = None
        self._generation = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, tier: int = TIER) -> History:
        """An earlier store, by its manifest: the rows of the highest generation. A folder without one is a new store."""
        self = cls(spark, path, tier)
        try:
            rows = spark.read.parquet(f"{path}/manifest")
        except AnalysisException:
            return self
        self._generation = rows.agg(F.max("generation")).first()[0]
        newest = rows.where(F.col("generation") == self._generation).orderBy("place").collect()  # a few runs a level
        self.runs = [(r.run, r.level) for r in newest]
        self.counts = _array(spark.read.parquet(newest[0].counts).toPandas())
        self._counts_at = newest[0].counts
        return self

    def _read(self, kind: str, runs: list[tuple[str, int]] | None = None) -> DataFrame | None:
        one = [self.spark.read.schema(SCHEMAS[kind]).parquet(f"{r}/{kind}") for r, _ in (self.runs if runs is None else runs)]
        return functools.reduce(DataFrame.unionByName, one) if one else None

    def _commit(self, runs: list[tuple[str, int]]) -> None:
        self.runs, self._generation = runs, self._generation + 1
        rows = [(self._generation, i, r, level, self._counts_at) for i, (r, level) in enumerate(runs)]
        self.spark.createDataFrame(rows, "generation int, place int, run string, level int, counts string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _new_run(self) -> str:
        return f"{self.path}/{uuid.uuid4().hex}"

    def ingest(self, batch: DataFrame, reports: DataFrame | None = None) -> DataFrame:
        """Verdicts on a batch, then the batch's valid rows join the history.

        batch: id, start double (of its run), valid boolean, hash, title, report_key strings. reports: report_key, seen double.
        Gives the id of each row for which an earlier valid row has the same hash or a near title, or an earlier report lists
        its key. Rows without a start are never repeats. Nulls in hash, title or report_key just don't match; ids may repeat.
        Batches must come with rising starts to see each other; within a batch the order of starts counts.
        """
        batch = batch.where("start is not null").withColumn("title", F.coalesce("title", F.lit("")))
        slim = bags(batch, "title", keep_empty=True).select(
            "id", "start", "valid", *_short("hash", "h"), *([] if reports is None else _short("report_key", "r")), "k1", "k2", "bag"
        )
        rows = stage(slim, "batch")
        run = self._new_run()
        texts = rows.where(F.size("bag") > 0).groupBy("k1", "k2")
        texts = texts.agg(F.any_value("bag").alias("bag"), F.min(F.when(F.col("valid"), F.col("start"))).alias("start"))
        self._write(with_bits(texts, keep_bag=False), f"{run}/texts", "k1")
        self._write(rows.where("valid and h1 is not null").groupBy("h1", "h2").agg(F.min("start").alias("start")), f"{run}/hashes", "h1")
        mine = self._read("texts", [(run, 0)])
        if self.counts is None:
            self._freeze(bit_counts(mine))
        self._write_keys(sort_keys(mine, self.counts), run)
        seen = self._text_seen(mine, self._read("keys", [(run, 0)]))
        hashes = self._read("hashes", [(run, 0)]).select("h1", "h2", "start")
        if self.runs:
            asked = rows.where("h1 is not null").select("h1", "h2").distinct()
            hashes = hashes.unionByName(self._read("hashes").select("h1", "h2", "start").join(asked, ["h1", "h2"], "left_semi"))
        hash_seen = hashes.groupBy("h1", "h2").agg(F.min("start").alias("hash_seen"))
        out = rows.drop("bag", "valid").join(seen, ["k1", "k2"], "left").drop("k1", "k2").join(hash_seen, ["h1", "h2"], "left").drop("h1", "h2")
        before = F.least("text_seen", "hash_seen")
        if reports is not None:
            listed = reports.where("report_key is not null").select(*_short("report_key", "r"), "seen").groupBy("r1", "r2").agg(F.min("seen").alias("report_seen"))
            out = out.join(listed, ["r1", "r2"], "left")
            before = F.least(before, F.col("report_seen"))
        found = stage(out.where(before < F.col("start")).select("id"), "found")
        self._commit([*self.runs, (run, 0)])
        self._settle()
        return found

    def _touched(self, kind: str, asked: Column, of: DataFrame) -> DataFrame:
        """The old entries of a kind in the ranges that ``asked`` falls into; the other ranges are not read."""
        wanted = [r[0] for r in of.select(asked).distinct().collect()]  # at most RANGES
        return self._read(kind).where(F.col("rng").isin(wanted))

    def _text_seen(self, mine: DataFrame, new: DataFrame) -> DataFrame:
        """(k1, k2, text_seen): for the texts of a batch, the first start of a text that is equal or near."""
        cols = ["key", "k1", "k2", "start", "n"]
        around = new.select(*cols).where("start is not null")
        if self.runs:
            around = around.unionByName(self._touched("keys", F.col("rng"), new).select(*cols).where("start is not null"))
        around = around.select("key", F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("start").alias("near"), F.col("n").alias("o_n"))
        # neighbours matter only if they are earlier than the text itself
        window = new.join(around, "key").where(
            ((F.col("k1") != F.col("o1")) | (F.col("k2") != F.col("o2")))
            & (F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * 80)
            & (F.col("start").isNull() | (F.col("near") < F.col("start")))
        )
        pairs = stage(window.groupBy("k1", "k2", "o1", "o2").agg(F.min("near").alias("near")), "neighbours")
        other = mine.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("bits").alias("o_bits"))
        firsts = mine.select("k1", "k2", F.col("start").alias("seen"))
        if self.runs:
            asked = pairs.select("o1", "o2").distinct()
            old = self._touched("texts", key_range("o1"), asked).select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("bits").alias("o_bits"))
            other = other.unionByName(old.join(asked, ["o1", "o2"], "left_semi")).dropDuplicates(["o1", "o2"])
            equal = self._touched("texts", F.col("rng"), mine).select("k1", "k2", F.col("start").alias("seen"))
            firsts = firsts.unionByName(equal.join(mine.select("k1", "k2"), ["k1", "k2"], "left_semi"))
        both = pairs.join(mine.select("k1", "k2", "bits"), ["k1", "k2"]).join(other, ["o1", "o2"])
        near = both.where(F.size(F.array_intersect("bits", "o_bits")) * 100 >= F.greatest(F.size("bits"), F.size("o_bits")) * 80)
        firsts = firsts.unionByName(near.select("k1", "k2", F.col("near").alias("seen")))
        return firsts.where("seen is not null").groupBy("k1", "k2").agg(F.min("seen").alias("text_seen"))

    def _write(self, rows: DataFrame, path: str, key: str, ranged: bool = True) -> None:
        if ranged:
            rows = rows.withColumn("rng", key_range(key))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // RANGES + 1  # files of a range
        rows.repartition(F.col("rng"), F.pmod(key, F.lit(parts))).sortWithinPartitions("rng", key).write.partitionBy("rng").parquet(path)

    def _write_keys(self, keys: DataFrame, run: str) -> None:
        self._write(keys, f"{run}/keys", "key", ranged=False)

    def _freeze(self, counts: np.ndarray) -> None:
        self.counts, at = counts, np.flatnonzero(counts)
        self._counts_at = f"{self._new_run()}/counts"
        self.spark.createDataFrame(pd.DataFrame({"bucket": at, "n": counts[at]}), "bucket long, n long").coalesce(1).write.parquet(self._counts_at)

    def _settle(self) -> None:
        """Merge full tiers, the lowest first."""
        level = 0
        while any(x >= level for _, x in self.runs):
            same = [r for r in self.runs if r[1] == level]
            if len(same) >= self.tier:
                self._commit([r for r in self.runs if r[1] != level] + [(self._merged(same), level + 1)])
            level += 1

    def _merged(self, runs: list[tuple[str, int]]) -> str:
        """Several runs as one: one row for each word bag and hash, entries as they are but for those of a bag's later starts."""
        run = self._new_run()
        for kind, key, by, rest in (("texts", "k1", ["k1", "k2"], [F.any_value("bits").alias("bits")]), ("hashes", "h1", ["h1", "h2"], []), ("keys", "key", ["key", "k1", "k2"], [F.any_value("n").alias("n")])):
            one = self._read(kind, runs).where("start is not null").groupBy(*by).agg(F.min("start").alias("start"), *rest)
            self._write(one, f"{run}/{kind}", key)
        return run

    def rebuild(self) -> None:
        """All runs as one, its keys by renewed counts."""
        if not self.runs:
            return
        run, level = self._merged(self.runs), max(x for _, x in self.runs)
        texts = self._read("texts", [(run, 0)])
        self._freeze(bit_counts(texts))
        fresh = self._new_run()
        for kind, key in (("texts", "k1"), ("hashes", "h1")):
            self._write(self._read(kind, [(run, 0)]).drop("rng"), f"{fresh}/{kind}", key)
        self._write_keys(sort_keys(texts, self.counts), fresh)
        self._commit([(fresh, level)])


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of raw_items as a batch for ``History.ingest``."""
    runs = table(spark, sf_dir, "runs").select("run_id", F.col("started_at").alias("start"), (F.col("status") == "valid").alias("valid"))
    raw = spread(table(spark, sf_dir, "raw_items").select("id", "run_id", "title", "url", "content_hash"))
    bare = F.when(F.col("url").isNull(), F.col("title"))  # only these titles are put into their consistent form
    key = F.when(F.col("url").isNotNull(), report_url(F.col("url"))).otherwise(report_title(bare))
    return raw.join(runs, "run_id").select("id", "start", "valid", F.lower("content_hash").alias("hash"), "title", key.alias("report_key"))


def listed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "registry_events").select(F.col("first_seen_utc").cast("double").alias("seen"), F.explode("reports").alias("r"))
    key = F.when(F.col("r").startswith("t:"), F.col("r")).otherwise(report_url(F.col("r")))
    return events.select("seen", key.alias("report_key"))


#: Batches in which p1_found brings the runs in: enough for one compaction and a batch after it.
BATCHES = 4


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of raw_items in batches of as many runs each, in the runs' order: each is checked against the stored earlier ones."""
    batch, reports = stage(batch_rows(spark, sf_dir), "rows"), listed_reports(spark, sf_dir)
    cuts = table(spark, sf_dir, "runs").agg(F.percentile_approx("started_at", [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
    history, out, low = History(spark), None, None
    for high in [*sorted(set(cuts)), None]:
        part = batch if low is None else batch.where(F.col("start") > low)
        found = history.ingest(part if high is None else part.where(F.col("start") <= high), reports)
        out, low = found if out is None else out.unionByName(found), high
    return out


QUERIES = {"p1_found": p1_found}
