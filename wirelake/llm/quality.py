"""Per-document text quality statistics (problem 10): a hidden Markov model labels every line.

The states are prose, list, table and junk. What is seen of a line is its share of common words, what it starts and ends with,
its length, and its share of digits, symbols and separators; the words of a line count by its most probable state in the
whole sequence, so that a wrapped line of prose is told from a headline by its neighbours. Long lines are cut at sentence
ends first, as one line may hold records and prose.

The chances start from the tables below, which say what the states mean, and are fitted by Viterbi training on all documents, each
round's counts being taken where the documents are; the tables count as ``PRIOR`` lines for each ``FIT_DOCS`` documents, so a corpus
without tables doesn't make the state drift. Languages without a list of common words get theirs from all their documents: the words
that ``COMMON`` of them have. What is seen of the lines is written once, since reading them costs ten times as much as decoding. All
statistics cover whole documents, and sequences are decoded many at a time with numpy.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.session import spread, stage, table

#: Documents for which the given tables count once, at least; rounds; lines that they count for.
FIT_DOCS, ROUNDS, PRIOR = 4000, 2, 100_000
#: Share of a language's documents that have a common word.
COMMON = 0.3
# Common words of the corpus languages.
COMMON_WORDS = {
    "en": "the of and a an in to that is was for on with as at by it be from or not are this but they you he she who which were has have had will would about its their no one more than after over said into if so what there some these those his her our we i do does did can could may must every any through before since because while where when how while only also other others most many much neither nor both each during between against out up down off then now here just like such own same too very",
    "fr": "le la les l d de des du et en un une à au aux que qu qui par pour dans sur est ne n pas ce cet cette ces plus avec se s son sa ses il elle ils elles on nous vous a ont été était avait aussi ou où mais comme leur leurs y sont être fait selon après avant sous entre sans même tout tous dont si bien beaucoup ceux",
    "de": "der die das und den dem des ein eine einer eines einem einen zu zum zur mit von vom im in am an auf für ist nicht sich wie um wurde werden wird hat haben hatte war waren aus nach bei vor über unter sagte es er sie wir ihr ich dass als auch noch nur aber oder wenn so will wo was man durch gegen bis seit",
    "es": "el la los las de del y e o un una unos unas al a en se por con para su sus que lo le les fue fueron ha han había no sí como más pero entre según sin muchos es son era ser está este esta estos estas ese esa eso ya también muy donde cuando hasta desde sobre tras ante antes después",
}
STATES = ("prose", "list", "table", "junk")
#: Words above which a line is cut at its sentence ends.
LONG_LINE = 24

_LISTED = frozenset(w for v in COMMON_WORDS.values() for w in v.split())
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"\r\n|[\n\r  \x0b\x0c\x85]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"»”’')\]]*\s+(?=\S)")
_TERMINAL = re.compile(r"[.!?…][\"»”’')\]\s]*$")
_INNER = re.compile(r"[a-zà-ÿ][.!?][\"»”’')]*\s+[\"«“‘¿¡(]*[A-ZÀ-Þ]")
_LEAD = re.compile(r"^(?:>\s*)*(?:\[?\d{1,2}[:.h]\d\d(?:[:.]\d\d)?\]?(?:\s*(?:GMT|UTC|Uhr))?\s*[-–—:]?\s+|[^\W\d_]+\d+:\s+)?")
_ITEM = re.compile(r"^\s*(?:[-*•·–▪‣]\s|\d{1,3}[.)]\s|#)")
_SEPARATED = re.compile(r"\t|\S {2,}\S.* {2,}\S|\|.*\|?|;.*;|[{}\[\]<>]|https?://|\d\s*[:;,]\s*[\"\d]")

# Chances of each seen value by state: prose, list, table, junk.
_SHARE = ((0.03, 0.38, 0.90, 0.86), (0.07, 0.16, 0.05, 0.06), (0.15, 0.22, 0.03, 0.05), (0.25, 0.16, 0.01, 0.02), (0.50, 0.08, 0.01, 0.01))
# How a line starts and ends belongs together: wrapped prose seldom has a capital first and no sentence end at all.
_EDGES = {
    "lower stop": (0.18, 0.01, 0.04, 0.10), "lower inner": (0.18, 0.005, 0.01, 0.02), "lower open": (0.13, 0.055, 0.12, 0.20),
    "upper stop": (0.32, 0.04, 0.18, 0.22), "upper inner": (0.12, 0.005, 0.01, 0.02), "upper open": (0.05, 0.52, 0.36, 0.24),
    "item stop": (0.004, 0.03, 0.02, 0.02), "item inner": (0.003, 0.005, 0.005, 0.005), "item open": (0.003, 0.315, 0.105, 0.025),
    "other stop": (0.004, 0.005, 0.05, 0.05), "other inner": (0.003, 0.005, 0.005, 0.005), "other open": (0.003, 0.005, 0.095, 0.095),
}
_LENGTH = ((0.04, 0.38, 0.10, 0.10), (0.10, 0.25, 0.45, 0.20), (0.56, 0.36, 0.43, 0.30), (0.30, 0.01, 0.02, 0.40))
_FORM = {"plain": (0.97, 0.90, 0.15, 0.45), "parted": (0.025, 0.08, 0.45, 0.15), "figures": (0.004, 0.01, 0.35, 0.10), "symbols": (0.001, 0.01, 0.05, 0.30)}
_FIRST = (0.55, 0.20, 0.15, 0.10)
_NEXT = ((0.94, 0.025, 0.02, 0.015), (0.05, 0.91, 0.025, 0.015), (0.05, 0.025, 0.91, 0.015), (0.05, 0.025, 0.025, 0.90))


_TABLES = {"share": np.array(_SHARE), "edges": np.array(list(_EDGES.values())), "length": np.array(_LENGTH), "form": np.array(list(_FORM.values()))}
_EDGE_AT, _FORM_AT = {k: i for i, k in enumerate(_EDGES)}, {k: i for i, k in enumerate(_FORM)}


class Model(NamedTuple):
    """Log chances: of each seen value by state (a last row of zeros for what wasn't seen), of first states and of next states."""

    seen: dict[str, np.ndarray]
    first: np.ndarray
    next: np.ndarray
    common: frozenset[str] = frozenset()


def _model(seen: dict[str, np.ndarray], first: np.ndarray, nxt: np.ndarray, common: frozenset[str] = frozenset()) -> Model:
    """From chances or counts."""
    by_state = {k: np.vstack([np.log(v / v.sum(0)), np.zeros(len(STATES))]) for k, v in seen.items()}
    return Model(by_state, np.log(first / first.sum()), np.log(nxt / nxt.sum(1, keepdims=True)), common)


GIVEN = _model(_TABLES, np.array(_FIRST), np.array(_NEXT))


@lru_cache(maxsize=20_000)
def _seen(line: str, more: frozenset[str] = frozenset()) -> tuple[int, ...] | None:
    """Words, letters of words, common words, whether it ends a sentence, and the seen values; None for a blank line."""
    body = _LEAD.sub("", line, count=1) or line
    words = _WORD.findall(body.lower())
    n = len(words)
    if not n:
        return None if not body.strip() else (0, 0, 0, 0, -1, -1, -1, _FORM_AT["symbols"])
    common = sum(w in _LISTED or w in more for w in words)
    share = common / n
    # a few words say little about their share, unless there are common ones among them
    s = 0 if share == 0 else 1 if share < 0.12 else 2 if share < 0.2 else 3 if share < 0.3 else 4
    if n < 3 and share == 0:
        s = 1
    head = body.lstrip("\"«“‘'¿¡(> ")[:1]
    start = "item" if _ITEM.match(line) else "lower" if head.islower() else "upper" if head.isupper() else "other"
    stop = bool(_TERMINAL.search(body))
    edges = _EDGE_AT[f"{start} {'stop' if stop else 'inner' if _INNER.search(body) else 'open'}"]
    signs = sum(not (c.isalnum() or c.isspace()) for c in body)
    figures = sum(w[0].isdigit() for w in words)
    form = "symbols" if signs > 0.2 * len(body) else "figures" if figures > 0.34 * n else "parted" if _SEPARATED.search(body) else "plain"
    return n, sum(map(len, words)), common, int(stop), s, edges, 0 if n < 3 else 1 if n < 7 else 2 if n < 19 else 3, _FORM_AT[form]


def _units(text: str) -> list[str]:
    out = []
    for line in _BREAK.split(text):
        if line.count(" ") > LONG_LINE:
            out += _SENTENCE.split(line)
        elif line and not line.isspace():
            out.append(line)
    return out


def _lines(texts: list[str | None], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """What is seen of all lines of many texts, and the number of lines of each text."""
    found = [[x for x in (_seen(u, common) for u in _units(t or "")) if x] for t in texts]
    flat = [x for f in found for x in f]
    return np.array(flat, np.int64).reshape(-1, 8), np.array([len(f) for f in found], np.int64)


def decode(chances: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """The most probable state of every line (Viterbi), texts of like length together."""
    out = np.empty(len(chances), np.int64)
    start = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    for i in range(0, len(order), 256):
        part = order[i : i + 256]
        n = sizes[part]
        wide = int(n[-1])
        at = np.minimum(start[part][:, None] + np.arange(wide), len(chances) - 1)
        x = chances[at]
        came = np.empty((wide, len(part), len(STATES)), np.int8)
        score = model.first + x[:, 0]
        last = score.copy()
        for t in range(1, wide):
            step = score[:, :, None] + model.next
            came[t] = step.argmax(1)
            score = step.max(1) + x[:, t]
            last[n > t] = score[n > t]
        state = last.argmax(1)
        for t in range(wide - 1, -1, -1):
            live = n > t
            out[at[live, t]] = state[live]
            if t:
                state[live] = came[t, live, state[live]]
    return out


def _states(lines: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    return decode(sum(model.seen[k][lines[:, 4 + i]] for i, k in enumerate(_TABLES)), sizes, model)


def statistics(texts: list[str | None], model: Model = GIVEN) -> dict[str, np.ndarray]:
    """Words, mean word length, share of lines ending in punctuation, of common words, and of words by state, of each text."""
    return _statistics(*_lines(texts, model.common), model)


def _statistics(lines: np.ndarray, sizes: np.ndarray, model: Model) -> dict[str, np.ndarray]:
    count = len(sizes)
    of = np.repeat(np.arange(count), sizes)
    words, letters, common, stops = (np.bincount(of, lines[:, i], count) for i in range(4))
    state = _states(lines, sizes, model) if len(lines) else np.zeros(0, np.int64)
    by = [np.bincount(of, lines[:, 0] * (state == k), count) for k in range(len(STATES))]
    some, void = np.maximum(words, 1), sizes == 0
    means = {"mean_word": letters / some, "line_end_share": stops / np.maximum(sizes, 1), "common_share": common / some}
    return {"words": words.astype(np.int64)} | {k: np.where(void, np.nan, v) for k, v in means.items()} | {k: b / some for k, b in zip(STATES, by)}


def _parsed(documents: DataFrame, common: frozenset[str]) -> DataFrame:
    """doc_id, signs, and lines: what is seen of each document's lines, a number after the other."""
    shared = documents.sparkSession.sparkContext.broadcast(common)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, n = _lines(b.column("text").to_pylist(), shared.value)
            each = [x.T.astype(np.int32).tobytes() for x in np.split(lines, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("signs"), pa.array(each, pa.binary())], names=["doc_id", "signs", "lines"])

    signs = F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]+", "")) / F.greatest(F.length("text"), F.lit(1))
    texts = spread(documents.where("text is not null").select("doc_id", "text")).select("doc_id", signs.alias("signs"), "text")
    return texts.mapInArrow(parse, f"doc_id {dict(texts.dtypes)['doc_id']}, signs double, lines binary")


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lines of many documents and their number, as ``_lines`` gave them."""
    each = [np.frombuffer(x, np.int32).reshape(8, -1).T for x in column.to_pylist()]
    return np.concatenate([*each, np.zeros((0, 8), np.int32)]).astype(np.int64), np.array([len(x) for x in each], np.int64)


def _counts(parsed: DataFrame, model: Model, prior: float) -> Model:
    """The chances again, from the states that the model gives the lines."""
    shared = parsed.sparkSession.sparkContext.broadcast(model)
    sizes = {k: v.size for k, v in _TABLES.items()} | {"first": len(STATES), "next": len(STATES) ** 2}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, n = _read(b.column("lines"))
            if not len(lines):
                continue
            state = _states(lines, n, shared.value)
            begin = np.zeros(len(lines), bool)
            begin[(np.cumsum(n) - n)[n > 0]] = True
            total = []
            for i, (k, v) in enumerate(_TABLES.items()):
                ok = lines[:, 4 + i] >= 0
                total.append(np.bincount(lines[ok, 4 + i] * len(STATES) + state[ok], minlength=v.size))
            total += np.bincount(state[begin], minlength=len(STATES)), np.bincount((state[:-1] * len(STATES) + state[1:])[~begin[1:]], minlength=len(STATES) ** 2)
            flat = np.concatenate(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "n"])

    got = parsed.select("lines").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a fixed number of rows
    flat = np.zeros(sum(sizes.values()))
    flat[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    cut = np.split(flat, np.cumsum(list(sizes.values()))[:-1])
    parts = dict(zip(sizes, cut))
    seen = {k: parts[k].reshape(v.shape) + prior / len(STATES) * v / v.sum(0) for k, v in _TABLES.items()}
    return _model(seen, parts["first"] + prior * np.array(_FIRST), parts["next"].reshape(len(STATES), -1) + prior / len(STATES) * np.array(_NEXT), model.common)


def common_words(texts: DataFrame) -> frozenset[str]:
    """Words that ``COMMON`` of the documents of a language without a list have; at most 1 / ``COMMON`` times a text's words."""
    unlisted = texts.where(F.col("lang").isNotNull() & ~F.substring(F.lower("lang"), 1, 2).isin(list(COMMON_WORDS)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = Counter((lang, w) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()) for w in set(_WORD.findall(t.lower())))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "word", "n"])

    counted = unlisted.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = counted.join(unlisted.groupBy("lang").agg(F.count("*").alias("docs")), "lang").where((F.col("n") >= F.col("docs") * COMMON) & (F.col("n") >= 5))
    return frozenset(r.word for r in often.select("word").distinct().collect())


def _fitted(documents: DataFrame) -> tuple[Model, DataFrame]:
    texts = documents.where("text is not null")
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    model = GIVEN._replace(common=common_words(texts.select("text", lang.alias("lang"))))
    parsed = stage(_parsed(documents, model.common), "lines")
    prior = PRIOR * max(1, parsed.count() // FIT_DOCS)
    for _ in range(ROUNDS):
        model = _counts(parsed, model, prior)
    return model, parsed


def fit(documents: DataFrame) -> Model:
    """The model of a corpus, from all its documents."""
    return _fitted(documents)[0]


_MEANS = ("mean_word", "line_end_share", "common_share")


def document_statistics(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, symbol_ratio, words, mean_word, line_end_share, common_share, and prose, list, table, junk, the shares of the words
    in lines of each kind (adding up to 1).

    documents: doc_id, text, and lang if there is one; other columns are ignored. Null texts give no row; an empty or blank text
    gives words 0, null means and zero shares; a text of signs only has words 0, its shares 0. One row for each row, repeated
    ones too. model: a fitted one; by default it is fitted on the documents themselves.
    """
    model, parsed = (model, _parsed(documents, model.common)) if model else _fitted(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _statistics(*_read(b.column("lines")), shared.value)
            cols = [pa.array(v, from_pandas=True) if k in _MEANS else pa.array(v) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("signs"), *cols], names=["doc_id", "symbol_ratio", *out])

    kinds = ", ".join(f"{k} double" for k in (*_MEANS, *STATES))
    return parsed.mapInArrow(label, f"doc_id {dict(parsed.dtypes)['doc_id']}, symbol_ratio double, words long, {kinds}")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").where(F.trim(F.col("text")) != "")
    return document_statistics(documents).where("prose < 0.5").select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_statistics(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
