"""One consistent form for text that looks the same (problem 7).

Method: a normalization quick check finds the unstable segments of a text; only those are normalised, together with the one
character before them as boundary context, and the canonical segments are spliced into the unchanged rest. The quick check
runs inside the JVM as a regular expression over the whole column, so stable texts (nearly all) never reach Python.

What is made the same: composed and decomposed accents (canonical composition), full-width and half-width forms, letter
ligatures, styled mathematical letters, every kind of space, look-alike letters of other scripts; zero-width and other
invisible characters go. Superscripts, fractions and signs that look different stay as they are. Letter case and accents stay.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.session import spread, table

# Letters that look like a Latin letter, and that letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "ό": "ó", "ϊ": "ï", "ί": "í", "ι": "ı",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ѐ": "È",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ё": "ë", "ѐ": "è", "ӏ": "l", "Ӏ": "I", "ӓ": "ä", "Ӓ": "Ä", "ӧ": "ö",
    "Ӧ": "Ö", "ӑ": "ă", "Ӑ": "Ă", "ӗ": "ĕ", "Ӗ": "Ĕ",
    # Armenian and IPA
    "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ո": "n", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U", "ɡ": "g", "ɑ": "a", "ǃ": "!", "ɩ": "ı",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮞ": "4",
    "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "Ᏻ": "G",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
    "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
# Characters without width.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Kinds of compatibility mapping that keep the looks of a character.
_SAME_LOOKS = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _mapping() -> dict[int, str]:
    out: dict[int, str] = {ord(k): v for k, v in LOOKALIKES.items()}
    out |= dict.fromkeys(map(ord, INVISIBLE), "") | dict.fromkeys([*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)], "")
    for cp in [*range(0x80, 0x3400), *range(0xA4D0, 0xA500), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        if cp in out:
            continue
        if c.isspace() and unicodedata.category(c) == "Zs":
            out[cp] = " "
        elif unicodedata.decomposition(c).startswith(_SAME_LOOKS) or 0xFB00 <= cp <= 0xFB06:
            plain = unicodedata.normalize("NFKC", c)
            out[cp] = "".join(LOOKALIKES.get(x, x) for x in plain)
    return out


MAPPING = _mapping()


#: Ranges of stable characters that make up nearly all text; the quick check in the JVM only has to pass these.
_STABLE = "\\t\\n\\r -~\u00a1-\u00ac\u00ae-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c2\u2012-\u2027\u2030-\u205e\u20a0-\u20bf\u4e00-\u9fff"


#: The quick check as a regular expression of Java and Python: it finds every unstable character, and a few more.
QUICK_CHECK = f"[^{_STABLE}]"
_SEGMENT = re.compile(f"[^{_STABLE}]+")


def canonical_text(text: str) -> str:
    """The consistent form of one text; applying it twice changes nothing more."""
    out, last = [], 0
    for m in _SEGMENT.finditer(text):
        start = max(m.start() - 1, last)  # the character that a mark may combine with
        out += text[last:start], unicodedata.normalize("NFC", unicodedata.normalize("NFC", text[start : m.end()]).translate(MAPPING))
        last = m.end()
    return "".join(out) + text[last:] if out else text


def plain_text(text: str) -> str:
    """Character references resolved, then the consistent form."""
    return canonical_text(html.unescape(text) if "&" in text else text)


@F.pandas_udf(T.StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _plain_udf(s: pd.Series) -> pd.Series:
    return s.map(plain_text, na_action="ignore")


def _unstable(col: Column) -> Column:
    """Whether the quick check fails; plain ASCII, told by its length in bytes, is stable."""
    return (F.octet_length(col) != F.char_length(col)) & col.rlike(QUICK_CHECK)


def canonical(col: Column) -> Column:
    """The consistent form of a text column; null stays null. Only texts that fail the quick check are sent to Python."""
    return F.coalesce(_canonical_udf(F.when(_unstable(col), col)), col)


def plain(col: Column) -> Column:
    """As ``canonical``, character references resolved first."""
    return F.coalesce(_plain_udf(F.when(col.contains("&") | _unstable(col), col)), col)


def word_array(col: Column) -> Column:
    """The words of a text: longest runs of letters and digits of its consistent form, without letter case; accents count."""
    low = F.replace(F.lower(plain(col)), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (tbl, id_a, id_b), id_a < id_b, of records whose texts look the same but are not the same characters.

    ``texts``: tbl string, id long, text string. Null and empty texts take no part; repeated rows of equal text make no pair;
    other columns are ignored. Two texts that both pass the quick check can only look the same if they are the same, so one
    side of every pair is an unstable text: the small unstable side is joined with all rows on a 96-bit key of the form.
    """
    form = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).select(
        "tbl", "id", F.xxhash64("text").alias("raw"), _unstable(F.col("text")).alias("unstable"), canonical(F.col("text")).alias("form")
    ).select("tbl", "id", "raw", "unstable", F.xxhash64("form").alias("k1"), F.hash("form").alias("k2"))
    u = form.where("unstable").select("tbl", "k1", "k2", F.col("id").alias("u_id"), F.col("raw").alias("u_raw"))
    j = u.join(form, ["tbl", "k1", "k2"]).where((F.col("u_raw") != F.col("raw")) & (~F.col("unstable") | (F.col("u_id") < F.col("id"))))
    return j.select("tbl", F.least("u_id", "id").alias("id_a"), F.greatest("u_id", "id").alias("id_b"))


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(tbl, first_id, records, variants, unstable): the records that look the same, where they are not all the same characters.

    The linear form of ``lookalike_pairs``: one row for each such group, however many pairs it makes. Null and empty texts take
    no part. Copies are counted before the shuffle, so a text on a third of all rows costs one row a task.
    """
    seen = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("form", canonical(F.col("text")))
    one = seen.groupBy("tbl", F.xxhash64("form").alias("k1"), F.hash("form").alias("k2"), F.xxhash64("text").alias("raw")).agg(
        F.count("*").alias("n"), F.min("id").alias("first_id"), F.max(F.when(F.col("form") != F.col("text"), 1).otherwise(0)).alias("odd")
    )
    out = one.groupBy("tbl", "k1", "k2").agg(
        F.min("first_id").alias("first_id"), F.sum("n").alias("records"), F.count("*").alias("variants"), F.sum(F.when(F.col("odd") == 1, F.col("n")).otherwise(0)).alias("unstable")
    )
    return out.where("variants > 1").select("tbl", "first_id", "records", "variants", "unstable")


def titles_and_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, text of the two tables that problems 2 and 7 look at."""
    raw = table(spark, sf_dir, "raw_items").select(F.lit("raw_items").alias("tbl"), F.col("id"), F.col("title").alias("text"))
    trend = table(spark, sf_dir, "trend_items").select(F.lit("trend_items").alias("tbl"), F.col("item_no").alias("id"), F.col("description").alias("text"))
    return spread(raw.unionByName(trend))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(titles_and_descriptions(spark, sf_dir))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(titles_and_descriptions(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}
