"""Groups of near texts (problem 2): generalised pigeonhole search over word bits.

Two texts are near if the words they share, counted with repeats, are at least 80 % of the words of the longer one. A text is
a bit vector with one bit for each (word, k-th occurrence). Correlated bits are grouped into partitions: the bits of one word,
which are nested, and the bits of up to ``GROUP`` frequent words that mostly come together, as found in a sample.

If a text of n words is near another one, at most d = n - ceil(0.8 n) of its bits are missing there. Thresholds t_i >= -1 per
partition with sum(t_i + 1) = d + 1 therefore leave at least one partition with at most t_i missing bits. For a word with c
occurrences that means: the other text has it at least c - t_i times, one probe of the key (word, c - t_i). For a group of c words
it has some c - t_i of them, one probe for each such subset. The thresholds are unequal and chosen for each text by dynamic
programming, so that the sum of the estimated candidates of its probes is least. Estimates come from a table of ``BUCKETS`` counts
over all texts: its size is fixed, whatever the data. Estimates and groups only steer the cost: any of them finds all near pairs.

A text is indexed under all its keys of an estimate up to its own dearest probe. Of two near texts the one with the cheaper
dearest probe then always finds the other, so the index stays short and nothing is missed. Candidates are verified exactly.
Texts of the same words are folded into one representative first, so a text copied a million times costs one. The kernels take
texts of like length together, as many as ``CELLS`` entries of the programme's table allow, so long texts are done one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.llm.lookalike import titles_and_descriptions, word_array
from wirelake.operators.graph import components
from wirelake.session import stage

#: Entries of the table of estimated counts: a fixed bound on what is broadcast (2 MB).
BUCKETS = 1 << 18
#: Texts of one step of the kernels, and entries of their largest array (2 bytes each), at most.
STEP, CELLS = 1024, 16_000_000
#: Words of the sample in which groups are found; words in more than one of ``RARE`` texts of it may be grouped; words of a group.
SAMPLE_WORDS, RARE, GROUP = 400_000, 200, 3
#: Share of the texts with either word that have both, for the two to be grouped.
TOGETHER = 0.4


def bags(texts: DataFrame, text: str = "text", keep_empty: bool = False) -> DataFrame:
    """Adds bag, the sorted hashes of the text's words, and its 96-bit key (k1, k2); texts without a word go unless kept."""
    bag = F.sort_array(F.transform(word_array(F.col(text)), lambda w: F.xxhash64(w)))
    out = texts.withColumn("bag", bag)
    return (out if keep_empty else out.where(F.size("bag") > 0)).withColumns({"k1": F.xxhash64("bag"), "k2": F.hash("bag")})


def with_bits(bagged: DataFrame, keep_bag: bool = True) -> DataFrame:
    """Adds bits: a 64-bit hash of each (word, k-th occurrence) of the bag, in the bag's order; linear in the text's length."""
    kept = [c for c in bagged.columns if keep_bag or c != "bag"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec, word, cnt, n = _words(b)
            bits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(_keys_of(rec, word, cnt)[3]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), bits], names=[*kept, "bits"])

    kinds = dict(bagged.dtypes)
    return bagged.mapInArrow(add, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", bits array<bigint>")


def _mix(word: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The 64-bit key of (word, occurrences needed)."""
    x = word.view(np.uint64) + need.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(46)).astype(np.int64)


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sorted bags of a batch: text index, word and count of each different word, and the words of each text."""
    col = batch.column("bag")
    n = np.diff(col.offsets.to_numpy()).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    rec = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (rec[1:] != rec[:-1])
    at = np.flatnonzero(new)
    return rec[at], flat[at], np.diff(np.append(at, len(flat))), n


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of like length, few enough for the kernels' arrays."""
    for b in batches:
        n = np.diff(b.column("bag").offsets.to_numpy()).astype(np.int64)
        order = np.argsort(n, kind="stable")
        cells = n[order] * (missing_bound(n[order]) + 2)
        b, i = b.take(pa.array(order)), 0
        while i < len(n):
            j = min(len(n), i + STEP)
            while j > i + 1 and cells[j - 1] * (j - i) > CELLS:
                j = i + (j - i) // 2
            yield b.slice(i, j - i)
            i = j


def _keys_of(rec: np.ndarray, word: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All keys (word, 1..count) of a batch: text, index of the word's row, needed occurrences, key."""
    row = np.repeat(np.arange(len(word)), cnt)
    need = np.arange(len(row)) - np.repeat(np.cumsum(cnt) - cnt, cnt) + 1
    return rec[row], row, need, _mix(word[row], need)


class Groups(NamedTuple):
    """Words that mostly come together: the words, sorted, and the group of each."""

    word: np.ndarray
    group: np.ndarray

    def of(self, word: np.ndarray) -> np.ndarray:
        """The group of each word, -1 for none."""
        if not len(self.word):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, self.group[at], -1)


def group_words(bagged: DataFrame) -> Groups:
    """Groups of frequent words by how often they come together, from a sample of about ``SAMPLE_WORDS`` words."""
    size = bagged.agg(F.coalesce(F.sum(F.size("bag")), F.lit(0)).alias("n")).first().n
    sample = bagged.where(F.pmod(F.xxhash64("bag", F.lit(1)), F.lit(max(1, size // SAMPLE_WORDS))) == 0).select(F.array_distinct("bag").alias("bag"))
    col = sample.toArrow().column("bag").combine_chunks()  # bounded by the sample
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    text = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
    word, of, count = np.unique(col.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    often = np.flatnonzero(count * RARE > len(col))
    at = np.full(len(word), -1)
    at[often] = np.arange(len(often))
    has = np.zeros((len(col), len(often)), np.float32)
    kept = at[of] >= 0
    has[text[kept], at[of][kept]] = 1
    both = has.T @ has
    share = both / np.maximum(count[often][:, None] + count[often][None, :] - both, 1)
    a, b = np.nonzero(np.triu(share >= TOGETHER, 1))
    group = np.arange(len(often))
    for i in np.argsort(-share[a, b], kind="stable"):
        x, y = group[a[i]], group[b[i]]
        if x != y and (group == x).sum() + (group == y).sum() <= GROUP:
            group[group == y] = x
    shared = np.bincount(group, minlength=len(often))[group] > 1 if len(often) else np.zeros(0, bool)
    return Groups(word[often][shared], group[shared])


def _subsets(rec: np.ndarray, word: np.ndarray, cnt: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Subsets of two or three words of one group in a text: text, group, size, key, and whether each word comes once."""
    at = np.flatnonzero(group >= 0)
    at = at[np.lexsort((word[at], group[at], rec[at]))]
    r, g, w, once = rec[at], group[at], word[at].view(np.uint64), cnt[at] == 1
    out = []
    for steps in ((0, 1), (0, 2), (0, 1, 2)):
        i = np.arange(max(0, len(at) - steps[-1]))
        i = i[(r[i] == r[i + steps[-1]]) & (g[i] == g[i + steps[-1]])]
        mixed = sum((w[i + s] * np.uint64(2 * k + 3) for k, s in enumerate(steps)), np.zeros(len(i), np.uint64))
        out.append((r[i], g[i], np.full(len(i), len(steps)), _mix(mixed.view(np.int64), np.zeros(len(i), np.int64)), np.logical_and.reduce([once[i + s] for s in steps])))
    return tuple(np.concatenate(c) for c in zip(*out))


def estimates(bagged: DataFrame, groups: Groups) -> np.ndarray:
    """Counts of all keys by bucket over all rows; at most ``BUCKETS`` numbers reach the driver."""
    shared = bagged.sparkSession.sparkContext.broadcast(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in _steps(batches):
            rec, word, cnt, _ = _words(b)
            total += np.bincount(_bucket(_keys_of(rec, word, cnt)[3]), minlength=BUCKETS)
            total += np.bincount(_bucket(_subsets(rec, word, cnt, shared.value.of(word))[3]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = bagged.select("bag").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def missing_bound(n: np.ndarray, percent: int = 80) -> np.ndarray:
    """Most bits of a text of n words that a near text can lack."""
    return n - (n * percent + 99) // 100


def allocate(rec: np.ndarray, cnt: np.ndarray, cost: np.ndarray, first: np.ndarray, n: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of all partitions by dynamic programming, many texts at a time.

    rec, cnt: text and bit count of each partition, by text; cost: estimated candidates of key (word, need), those of one
    partition from ``first`` on by rising need. Gives the threshold of each partition (-1: not probed) and each text's total.
    """
    units = missing_bound(n, percent) + 1
    size = np.bincount(rec, minlength=len(n))
    slot = np.arange(len(rec)) - np.repeat(np.cumsum(size) - size, size)
    wide, far = int(units.max()), float("inf")
    best = np.full((len(n), wide + 1), far)
    best[:, 0] = 0.0
    took = np.zeros((int(size.max()), len(n), wide + 1), np.int16)
    by_slot = np.argsort(slot, kind="stable")
    ends = np.cumsum(np.bincount(slot))
    for j in range(len(ends)):
        part = by_slot[(ends[j - 1] if j else 0) : ends[j]]
        texts = rec[part]
        old, new = best[texts], best[texts].copy()
        choice = np.zeros_like(new, np.int16)
        for u in range(1, min(int(cnt[part].max()), wide) + 1):  # u = threshold + 1 units
            can = cnt[part] >= u
            price = np.where(can, cost[np.where(can, first[part] + cnt[part] - u, 0)], far)
            moved = np.empty_like(old)
            moved[:, u:] = old[:, : wide + 1 - u]
            moved[:, :u] = old[:, :1]  # more units than asked for do as well
            moved[:, 0] = far
            moved += price[:, None]
            less = moved < new
            new = np.where(less, moved, new)
            choice[less] = u
        best[texts] = new
        took[j, texts] = choice
    threshold = np.full(len(rec), -1, np.int64)
    left = units.copy()
    at = np.cumsum(size) - size
    for j in range(len(ends) - 1, -1, -1):
        has = np.flatnonzero(size > j)
        u = took[j, has, left[has]]
        threshold[at[has] + j] = u - 1
        left[has] = np.maximum(left[has] - u, 0)
    return threshold, best[np.arange(len(n)), units]


def text_keys(rec: np.ndarray, word: np.ndarray, cnt: np.ndarray, n: np.ndarray, groups: Groups, counts: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys under which each text is indexed: text, key, and whether the text probes it."""
    k_rec, k_row, k_need, key = _keys_of(rec, word, cnt)
    cost = counts[_bucket(key)]
    group = groups.of(word)
    s_rec, s_group, s_size, s_key, s_once = _subsets(rec, word, cnt, group)
    s_cost = counts[_bucket(s_key)]
    # partitions: each word, but those of one group in a text that come once, two or more, are one
    lone = np.where(cnt == 1, group, -1)
    pair_of = rec * (int(group.max(initial=0)) + 1) + lone
    named, member, many = np.unique(pair_of[lone >= 0], return_inverse=True, return_counts=True)
    in_group = np.zeros(len(word), bool)
    in_group[np.flatnonzero(lone >= 0)] = many[member] > 1
    g_at = np.flatnonzero(many > 1)
    place = np.full(len(named), -1)
    place[g_at] = np.arange(len(g_at))
    g_rec, g_cnt = named[g_at] // (int(group.max(initial=0)) + 1), many[g_at]
    # cost of needing 1, 2 or 3 words of a group
    g_cost = np.zeros((len(g_at), GROUP + 1))
    words_in = np.flatnonzero(in_group)
    g_of_word = place[np.searchsorted(named, pair_of[words_in])]
    first_key = np.cumsum(cnt) - cnt
    np.add.at(g_cost, (g_of_word, 1), cost[first_key[words_in]])
    s_at = np.searchsorted(named, s_rec * (int(group.max(initial=0)) + 1) + s_group)
    s_in = np.where(s_once & (s_at < len(named)), place[np.minimum(s_at, len(named) - 1)] if len(named) else -1, -1)
    np.add.at(g_cost, (s_in[s_in >= 0], s_size[s_in >= 0]), s_cost[s_in >= 0])
    own = np.flatnonzero(~in_group)
    p_rec, p_cnt = np.concatenate([rec[own], g_rec]), np.concatenate([cnt[own], g_cnt])
    flat = np.concatenate([cost, g_cost[:, 1:].ravel()])
    p_first = np.concatenate([first_key[own], len(cost) + GROUP * np.arange(len(g_at))])
    order = np.argsort(p_rec, kind="stable")
    threshold = np.empty(len(order), np.int64)
    threshold[order] = allocate(p_rec[order], p_cnt[order], flat, p_first[order], n, percent)[0]
    need = p_cnt - threshold  # one more than there are if the partition is not probed
    word_need = np.full(len(word), -1)
    word_need[own] = need[: len(own)]
    group_need = need[len(own) :]
    word_need[words_in] = np.where(group_need[g_of_word] == 1, 1, -1)
    probe = k_need == word_need[k_row]
    s_probe = (s_in >= 0) & (s_size == group_need[np.maximum(s_in, 0)]) if len(g_at) else np.zeros(len(s_in), bool)
    all_rec, all_key, all_cost, all_probe = np.concatenate([k_rec, s_rec]), np.concatenate([key, s_key]), np.concatenate([cost, s_cost]), np.concatenate([probe, s_probe])
    dearest = np.zeros(len(n))
    np.maximum.at(dearest, all_rec[all_probe], all_cost[all_probe])
    keep = all_probe | (all_cost <= dearest[all_rec])
    return all_rec[keep], all_key[keep], all_probe[keep]


def signatures(bagged: DataFrame, counts: np.ndarray, groups: Groups, percent: int = 80) -> DataFrame:
    """(tbl, key, rep, n, probe): the index rows of every text, those that it probes marked."""
    shared = bagged.sparkSession.sparkContext.broadcast((counts.astype(np.float64), groups))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, groups_ = shared.value
        for b in _steps(batches):
            rec, word, cnt, n = _words(b)
            of, key, probe = text_keys(rec, word, cnt, n, groups_, table_, percent)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [b.column("tbl").take(at), pa.array(key), b.column("rep").take(at), pa.array(n[of].astype(np.int32)), pa.array(probe)], names=["tbl", "key", "rep", "n", "probe"]
            )

    return bagged.select("tbl", "rep", "bag").mapInArrow(sign, "tbl string, key long, rep long, n int, probe boolean")


def near_links(reps: DataFrame, percent: int = 80) -> DataFrame:
    """(tbl, a, b), a < b: all near pairs of representatives. ``reps``: tbl, rep long (unique in tbl), bag (all different), bits."""
    groups = group_words(reps)
    sig = stage(signatures(reps, estimates(reps, groups), groups, percent), "signatures")
    q = sig.where("probe").select("tbl", "key", F.col("rep").alias("q"), F.col("n").alias("qn"))
    close = F.least("n", "qn") * 100 >= F.greatest("n", "qn") * percent
    pairs = q.join(sig.drop("probe"), ["tbl", "key"]).where((F.col("q") != F.col("rep")) & close)
    pairs = stage(pairs.select("tbl", F.least("q", "rep").alias("a"), F.greatest("q", "rep").alias("b")).distinct(), "candidates")
    left, right = (reps.select("tbl", F.col("rep").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    both = pairs.join(left, ["tbl", "a"]).join(right, ["tbl", "b"])
    near = F.size(F.array_intersect("bits_a", "bits_b")) * 100 >= F.greatest(F.size("bits_a"), F.size("bits_b")) * percent
    return both.where(near).select("tbl", "a", "b")


def near_groups(texts: DataFrame, percent: int = 80) -> DataFrame:
    """(tbl, first_id, id): every record but the smallest of each group of records joined by near texts.

    ``texts``: tbl string, id long, text string; other columns are ignored. Null, empty and wordless texts are in no group.
    Rows of the same words are in one group; a row repeated with the same id counts once. Whole texts count, of any length.
    """
    all_rows = stage(bags(texts.select("tbl", "id", "text").where(F.col("text").isNotNull())).select("tbl", "id", "k1", "k2", "bag"), "bags")
    reps = stage(with_bits(all_rows.groupBy("tbl", "k1", "k2").agg(F.min("id").alias("rep"), F.any_value("bag").alias("bag"))), "representatives")
    node = lambda c: F.struct("tbl", F.col(c).alias("id"))
    roots = components(near_links(reps, percent).select(node("a").alias("a"), node("b").alias("b")))
    roots = roots.select(F.col("node.tbl").alias("tbl"), F.col("node.id").alias("rep"), F.col("root.id").alias("root"))
    first = reps.select("tbl", "k1", "k2", "rep").join(roots, ["tbl", "rep"], "left").select("tbl", "k1", "k2", F.coalesce("root", "rep").alias("first_id"))
    out = all_rows.select("tbl", "id", "k1", "k2").join(first, ["tbl", "k1", "k2"]).where(F.col("id") != F.col("first_id"))
    return out.select("tbl", "first_id", "id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(titles_and_descriptions(spark, sf_dir))


QUERIES = {"p2_found": p2_found}
