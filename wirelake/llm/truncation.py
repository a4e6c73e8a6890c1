"""Texts cut off by field limits (problem 6): hashed logistic regression on artificially cut values.

Training needs no labels. Values that end as a sentence does are intact; cut at a random letter, at a word, at a length at which
the field is often found, with a mark of omission or inside a piece of markup, they give positives. The same values as they are,
without their last full stop, up to the end of an inner line, and values ending in a phrase that comes back on many records but
never goes on inside a sentence give negatives. Seen of a text are its closing characters, the words before its end with names
and figures masked, how much stands after its last sentence end, and how its length relates to the lengths that the field
clips at. Lengths, words and closing phrases are counted in all rows, without a cap: words by hash bucket, so that what the scorer
knows of them has a fixed size, lengths and phrases by their share of the rows. The weights are fitted on a sample of ``SAMPLE``
rows a field; every record is then scored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.session import spread, stage, table

#: Rows of a field that the classifier is fitted on, at most.
SAMPLE = 6000
#: Hashed weights, and hashed counts of words.
BITS, WORD_BITS = 18, 21

_MARK = re.compile(r"\s*(?:\.{3,}|…|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\))\s*$")
_STOP = re.compile(r"[.!?。][\"»”’')\]]*$")
_MARKUP = re.compile(r"(?:<[^<>]{0,40}|&#?\w{0,8})$")
_AFTER_STOP = re.compile(r"(?<=[.!?])[\"»”’')\]]*\s+")
_LEAD = re.compile(r"[^:.]{2,30}:(?=\s)")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")


def _masked(tokens: list[str], shout: bool) -> list[str]:
    out = []
    for t in tokens:
        if t[0].isdigit():
            out.append("9")
        elif t[0].isupper() and not shout:
            out.append("N")
        else:
            out.append(t.lower())
    return out


class Known:
    """What the scorer knows of the data: clip lengths by field, vocabulary, and closing phrases that are complete."""

    def __init__(self, limits: dict[str, set[int]], words: np.ndarray, phrases: set[str]):
        self.limits, self.words, self.phrases = limits, words, phrases

    def word(self, word: str) -> bool:
        return bool(self.words[_bucket(word.lower())])

    def complete(self, line: str, tail: str) -> bool:
        return any(p in self.phrases for p in phrases_of(line, tail))


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) >> (32 - WORD_BITS)


def tail_of(text: str) -> tuple[str, str]:
    """The last line, and what stands after its last sentence end."""
    line = text.rstrip().rsplit("\n", 1)[-1].strip()
    return line, _AFTER_STOP.split(line)[-1]


def phrases_of(line: str, tail: str) -> list[str]:
    """A closing phrase as it is and with names masked, figures masked in both; one with a mark only if it is the whole line."""
    mark = bool(_MARK.search(tail))
    if not tail or (mark and line != tail) or (not mark and _STOP.search(tail)):
        return []
    tokens = _TOKEN.findall(_MARK.sub("", tail) if mark else tail)
    end = " \x02" if mark else ""
    plain = " ".join("9" if t[0].isdigit() else t for t in tokens)
    masked = " ".join(_masked(tokens, tail.isupper()))
    lead = _LEAD.match(tail) if line == tail and not mark else None
    return [plain + end] + ([" ".join(_TOKEN.findall(lead[0])) + " \x03"] if lead else []) + ([masked + end] if masked != plain and sum(t.isalpha() and t != "N" for t in masked.split()) > 1 else [])


def features(text: str, field: str, known: Known) -> list[int]:
    """Hashed features of a text."""
    body = text.rstrip()
    line, tail = tail_of(text)
    mark = bool(_MARK.search(line))
    bare = _MARK.sub("", tail) if mark else tail
    shout = len(bare) > 8 and bare.isupper()
    tokens = _TOKEN.findall(bare)
    last = _masked(tokens[-4:], shout)
    end = body[-1:]
    if mark:
        kind = "mark"
    elif _MARKUP.search(body):
        kind = "markup"
    elif end == "�":
        kind = "broken"
    elif _STOP.search(body):
        kind = "stop"
    elif end.isalpha():
        kind = "letter"
    elif end.isdigit():
        kind = "digit"
    else:
        kind = "sign " + end
    n = len(text)
    limits = known.limits.get(field, ())
    at = "at" if n in limits else "under" if any(n + i in limits for i in range(1, 14)) else "free"
    words = sum(t[0].isalnum() for t in tokens)
    complete = known.complete(line, tail)
    lone = line == tail
    rows = body.rsplit("\n", 3)
    over = next((r for r in reversed(rows[:-1]) if r.strip()), "")
    above = "none" if not over else "stop" if _STOP.search(over.rstrip()) else "headline" if over.count(" ") > 4 else "short"
    seen = [f"kind {kind} {complete}", f"kind {kind} {at} {complete}", f"space {text != body and '\n' not in text[len(body):]} {kind} {complete}"]
    if not complete and kind not in ("stop", "mark", "markup", "broken"):
        word = tokens[-1] if tokens else ""
        novel = "name" if word[:1].isupper() and not shout else "figure" if word[:1].isdigit() else "sign" if not word[:1].isalnum() else "known" if known.word(word) else "novel"
        seen += [f"word {novel}", f"word {novel} {at}", f"length {min(len(word), 4)} {novel}"]
        seen += [f"{k} {' '.join(last[-k:])}" for k in (1, 2, 3, 4) if len(last) >= k]
        seen += [f"words {min(words, 12)} {lone} {above}", f"lone {lone} {above}", f"parts {sum(c in '|·>' for c in line) > 0}"]
    return [zlib.crc32(f.encode()) >> (32 - BITS) for f in seen]


def _cuts(text: str, limits: list[int], rng: np.random.Generator) -> list[str]:
    """Two artificially cut forms of an intact text."""
    out = []
    for _ in range(2):
        usable = [x for x in limits if x < len(text) - 1]
        at = int(rng.choice(usable)) if usable and rng.random() < 0.5 else int(rng.integers(max(1, len(text) // 4), max(2, len(text) - 1)))
        cut, how = text[:at], rng.random()
        if how < 0.45:
            pass
        elif how < 0.75:
            mark = str(rng.choice(["...", "…", " ...", " …", " [...]", " [...]"]))
            word = cut[: at - len(mark)].rsplit(" ", 1)[0].rstrip() if rng.random() < 0.8 else cut[: at - len(mark)]
            cut = word + mark
        elif how < 0.82:
            cut = cut.rsplit(" ", 1)[0] + " " + str(rng.choice(["<a hre", "&quo", "<p", "</", "&am", '<a href="ht']))
        elif how < 0.86:
            cut += "�"
        else:
            cut = cut.rsplit(" ", 1)[0]
        if cut.strip() and not _STOP.search(cut.rstrip()) or _MARK.search(cut):
            out.append(cut)
    return out


def _train(x: list[list[int]], y: list[int], rounds: int = 6, rate: float = 0.25, decay: float = 1e-6) -> np.ndarray:
    """Weights by stochastic gradient descent with per-weight rates."""
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1.0)
    rng = np.random.default_rng(11)
    sizes = np.array([len(r) for r in x])
    flat, start = np.concatenate([np.array(r) for r in x]), np.append(0, np.cumsum(sizes))
    y_ = np.array(y, float)
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            ids = np.concatenate([flat[start[r] : start[r + 1]] for r in rows])
            of = np.repeat(np.arange(len(rows)), sizes[rows])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[ids], len(rows)), -30, 30)))
            g = (p - y_[rows])[of] + decay * w[ids]
            np.add.at(seen, ids, g * g)
            np.subtract.at(w, ids, rate * g / np.sqrt(seen[ids]))
    return w


def clip_lengths(texts: DataFrame) -> dict[str, set[int]]:
    """Lengths at which many more texts of a field end than at those just below; from all rows, one count a length.

    A limit has at least one in 2,000 of a field's different texts, which bounds what reaches the driver.
    """
    sized = texts.select("tbl", F.length("text").alias("n"), F.xxhash64("text").alias("h")).distinct()  # copies of a text count once
    counts = stage(sized.groupBy("tbl", "n").agg(F.count("*").alias("c")), "lengths")
    total = counts.groupBy("tbl").agg(F.sum("c").alias("total"))
    # texts clipped at a word end are just below a limit, so those above it are its surroundings
    above = counts.select("tbl", F.explode(F.sequence(F.col("n") - 8, F.col("n") - 1)).alias("n"), F.col("c").alias("other")).groupBy("tbl", "n").agg((F.sum("other") / 8).alias("around"))
    j = counts.join(above, ["tbl", "n"], "left").join(total, "tbl")
    found = j.where((F.col("c") >= F.greatest(F.lit(3), F.col("total") / 2000)) & (F.col("c") > 5 * F.coalesce("around", F.lit(0.0)) + 2) & (F.col("n") >= 20))
    out: dict[str, set[int]] = {}
    for r in found.select("tbl", "n").collect():
        out.setdefault(r.tbl, set()).add(r.n)
    return out


def _closing(texts: DataFrame) -> DataFrame:
    """(phrase, n): how often a phrase ends a text, or a line that others follow, in all rows."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [p for t in b.column("text").to_pylist() for p in [*phrases_of(*tail_of(t)), *_inner_phrases(t)]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["phrase"])

    return texts.select("text").mapInArrow(close, "phrase string").groupBy("phrase").agg(F.count("*").alias("n"))


def _inner_phrases(text: str) -> list[str]:
    return [p for line in text.rstrip().split("\n")[:-1] for p in phrases_of(line.strip(), line.strip())]


def _intact(text: str) -> bool:
    return bool(_STOP.search(text.rstrip()) and not _MARK.search(text.rstrip()))


def _sentences(text: str) -> Iterator[str]:
    """Sentences that end as such, with names masked and not, figures masked in both."""
    for line in text.split("\n"):
        for sentence in _AFTER_STOP.split(line.strip()):
            tokens = _TOKEN.findall(sentence)
            if tokens and _STOP.search(sentence):
                yield from {" ".join(_masked(tokens, False)), " ".join("9" if x[0].isdigit() else x for x in tokens)}


class Prefixes:
    """Which of many phrases a sentence begins with and goes on after, be it in the middle of a word."""

    def __init__(self, phrases: set[str]):
        self.phrases, self.shorter, chain = sorted(phrases), [], []
        for i, p in enumerate(self.phrases):
            while chain and not p.startswith(self.phrases[chain[-1]]):
                chain.pop()
            self.shorter.append(chain[-1] if chain else -1)
            chain.append(i)

    def of(self, sentence: str) -> Iterator[str]:
        at = bisect.bisect_left(self.phrases, sentence) - 1
        while at >= 0:
            if sentence.startswith(self.phrases[at]):
                yield self.phrases[at]
            at = self.shorter[at]


def _going_on(texts: DataFrame, phrases: set[str]) -> dict[str, int]:
    """How many sentences of all intact texts begin with a phrase and go on."""
    shared = texts.sparkSession.sparkContext.broadcast(sorted(phrases))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, total = Prefixes(set(shared.value)), Counter()
        for b in batches:
            total.update(p for t in b.column("text").to_pylist() if _intact(t) for s in _sentences(t) for p in begun.of(s))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["phrase", "n"])

    return {r.phrase: r.n for r in texts.select("text").mapInArrow(count, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("n")).collect()}


def _words(texts: DataFrame) -> np.ndarray:
    """For each hash bucket whether its words are known: more than two in all intact texts, and one in ten million of their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << WORD_BITS, np.int64)
        for b in batches:
            for w, n in Counter(w for t in b.column("text").to_pylist() if _intact(t) for w in re.findall(r"[^\W\d_]+", t.lower())).items():
                total[_bucket(w)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most 2 ** WORD_BITS rows
    out = np.zeros(1 << WORD_BITS, bool)
    out[got.bucket[got.n >= max(3, got.n.sum() / 10_000_000)].to_numpy(np.int64)] = True
    return out


def _phrases(texts: DataFrame) -> set[str]:
    """Complete closing phrases: those on one text in 5,000, and three, that seldom go on. Counted in all rows."""
    often = _closing(texts).where(F.col("n") >= max(3, texts.count() // 5000))  # bounded by 5,000 times the phrases of a text
    closing = {r.phrase: r.n for r in often.collect()}
    bare = {p: re.sub(" [\x02\x03]$", "", p) for p in closing}
    goes_on = _going_on(texts, set(bare.values()))
    return {p for p, n in closing.items() if goes_on.get(bare[p], 0) * 2 < n}


def fit(texts: DataFrame) -> tuple[Known, np.ndarray]:
    """Knowledge from all texts, and the classifier from a bounded sample of them."""
    limits = clip_lengths(texts)
    fields = [r.tbl for r in texts.select("tbl").distinct().collect()]
    sample: list[tuple[str, str]] = []
    for f in sorted(fields):
        rows = texts.where(F.col("tbl") == f).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("text").collect()
        sample += [(f, r.text) for r in rows]
    intact = [(f, t) for f, t in sample if _intact(t)]
    words = _words(texts)
    phrases = _phrases(texts)
    known = Known(limits, words, phrases)
    rng = np.random.default_rng(5)
    x: list[list[int]] = []
    y: list[int] = []

    def learn(text: str, field: str, cut: int) -> None:
        x.append(features(text, field, known))
        y.append(cut)

    for f, t in intact:
        learn(t, f, 0)
        bare = re.sub(r"[.!?]+[\"»”’')\]]*$", "", t.rstrip())
        if bare and rng.random() < 0.5:
            learn(bare, f, 0)
        for c in _cuts(t, sorted(limits.get(f, ())), rng):
            learn(c, f, 1)
        rows = t.rstrip().split("\n")
        ends = [k for k in range(1, len(rows)) if rows[k - 1].strip() and not _STOP.search(rows[k - 1].rstrip())]
        for k in rng.permutation(ends)[:3]:
            learn("\n".join(rows[:k]), f, 0)
    for f, t in sample:
        if known.complete(*tail_of(t)):
            learn(t, f, 0)
    return known, (_train(x, y) if x else np.zeros(1 << BITS))


def truncated(texts: DataFrame) -> DataFrame:
    """tbl, id, source and the chance that the text was cut, of every record with a text.

    texts: tbl, id, source, text; other columns are ignored. Null and empty texts give no row; a repeated row gives its row
    again; with no intact text to learn from the chance is 0.5.
    """
    texts = spread(texts.where("text is not null and trim(text) != ''").select("tbl", "id", "source", "text"))
    known, weights = fit(texts)
    shared = texts.sparkSession.sparkContext.broadcast((known, weights.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        for b in batches:
            z = np.array([w[features(t, f, known)].sum() for f, t in zip(b.column("tbl").to_pylist(), b.column("text").to_pylist())], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("tbl"), b.column("id"), b.column("source"), pa.array(1 / (1 + np.exp(-z)))], names=["tbl", "id", "source", "chance"])

    return texts.mapInArrow(score, "tbl string, id long, source string, chance double")


def field_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = table(spark, sf_dir, "trend_items").select(F.lit("trend_items").alias("tbl"), F.col("item_no").alias("id"), F.coalesce(F.col("metadata")["feed"], "source").alias("source"), F.col("description").alias("text"))
    cleaned = table(spark, sf_dir, "cleaned_items").select(F.lit("cleaned_items").alias("tbl"), F.col("item_id").alias("id"), F.coalesce(F.col("metadata")["feed"], "source").alias("source"), F.col("context").alias("text"))
    return trend.unionByName(cleaned)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(field_texts(spark, sf_dir)).where("chance > 0.5").select("tbl", "id")


def p6_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and share of cut ones by field and source."""
    scored = truncated(field_texts(spark, sf_dir))
    return scored.groupBy("tbl", "source").agg(F.count("*").alias("records"), F.avg((F.col("chance") > 0.5).cast("double")).alias("rate"))


QUERIES = {"p6_found": p6_found, "p6_source_rates": p6_source_rates}
