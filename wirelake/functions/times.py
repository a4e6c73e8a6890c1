"""Mixed timestamp texts as UTC instants (problem 5), wholly inside the JVM.

Method: the raw texts are de-duplicated together with what their reading depends on (zone and day-month order of their source)
into a dictionary of distinct values; each is parsed exhaustively once, the dictionary is kept and grows with new texts, and
the instants are joined back to the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wirelake.session import new_path

# Month names by number.
MONTHS = {
    1: "jan january janvier januar jänner enero ene janv",
    2: "feb february février februar febrero fevrier févr",
    3: "mar march mars märz marzo maerz mär",
    4: "apr april avril abril abr avr",
    5: "may mai mayo",
    6: "jun june juin juni junio",
    7: "jul july juillet juli julio juil",
    8: "aug august août agosto aout ago",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october octobre oktober octubre okt",
    11: "nov november novembre noviembre",
    12: "dec december décembre dezember diciembre dez decembre déc dic",
}
# Zone abbreviations of daylight time.
DAYLIGHT = ["ADT", "AEDT", "AKDT", "BST", "CDT", "CEST", "EDT", "EEST", "HDT", "IST", "MDT", "NDT", "NZDT", "PDT", "WEST"]
#: Instants before this one are not taken as stated.
EARLIEST = 788_918_400_000_000  # 1995-01-01
_CLOCK = r"(\d{1,2})[:hH.](\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"\s*(?:([AaPp])\.?[Mm]\.?)?"
_ZONE = r"\s*(?:Uhr|uhr)?\s*\(?(Z|z|[+\-−]\d{2}:?\d{2}|[A-Z]{2,5}(?![a-z]))?\)?"
_NAME = r"([A-Za-zäéûÄÉ]{3,10})"
#: Form of a text, and its year, month, day, hour, minute, second, fraction, half of day and zone in that order.
_FORMS = (
    (rf"^(\d{{4}})[\-/.](\d{{1,2}})[\-/.](\d{{1,2}})(?:[Tt]|,?\s+){_CLOCK}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})(?:\.|er)?[\s\-]+(?:de\s+)?{_NAME}\.?[\s\-]+(?:de\s+)?(\d{{4}}|\d{{2}}),?\s+(?:à\s+|um\s+|a\s+las\s+)?{_CLOCK}{_HALF}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:\p{{L}}+\.?,?\s+)?{_NAME}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}),?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})[/.\-](\d{{1,2}})[/.\-](\d{{4}}),?\s+{_CLOCK}{_HALF}{_ZONE}$", "$3|$1/|$2|$4|$5|$6|$7|$8|$9"),
)
_EPOCH = r"^(?:/Date\()?(\d{9,19})(?:[.,](\d+))?(?:[+\-]\d{4})?(?:\)/)?$"


def _epoch(text: Column) -> Column:
    """Microseconds of a count since 1970; its unit follows from its digits."""
    whole, part = F.regexp_extract(text, _EPOCH, 1), F.regexp_extract(text, _EPOCH, 2)
    digits = F.length(whole)
    scale = F.when(digits <= 11, 6).when(digits <= 14, 3).when(digits <= 17, 0).otherwise(-3)
    shifted = F.rpad(part, 6, "0")
    micros = F.when(scale == 6, F.concat(whole, shifted)).when(scale == 3, F.concat(whole, F.substring(shifted, 1, 3))).when(scale == 0, whole)
    return F.coalesce(micros, F.substring(whole, 1, digits - 3)).try_cast("long")


def with_instants(df: DataFrame) -> DataFrame:
    """Adds utc_us, the microseconds since 1970 UTC that ``text`` states, or null.

    zone: the IANA zone of texts without one, UTC if null; day_first: whether numeric dates start with the day, false if null.
    Null for empty texts, dates without a time of day, impossible dates, and instants before 1995. Digits beyond microseconds
    are dropped, missing seconds are zero. A local time that occurs twice is the first, unless its zone abbreviation is one of
    standard time; one that is skipped is read with the offset before the change. A zone abbreviation other than GMT and UTC
    is one of the given zone. Each step is a projection of its own, so that no text is matched twice.
    """
    c = F.col
    kept = df.columns
    t = F.trim(F.translate("text", "\u00a0\u202f\u2009", "   "))
    fields = F.lit(None).cast("string")
    for form, order in reversed(_FORMS):
        fields = F.when(c("_t").rlike(form), F.regexp_replace("_t", form, order)).otherwise(fields)
    df = df.withColumn("_t", t).withColumn("_p", F.split(fields, r"\|"))
    df = df.withColumns({n: c("_p")[i] for i, n in enumerate(("_y", "_m", "_d", "_h", "_i", "_s", "_f", "_a", "_z"))})
    names = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in words.split() for x in (w, n)])
    numeric = F.endswith("_m", F.lit("/"))
    df = df.withColumns({"_swap": numeric & F.coalesce("day_first", F.lit(False)), "_m": F.regexp_replace("_m", "/", "")})
    year, hour = c("_y").try_cast("int"), c("_h").try_cast("int")
    offset = r"^[+\-−](\d{2}):?(\d{2})$"
    df = df.withColumns(
        {
            "_month": F.when(c("_swap"), c("_d").try_cast("int")).otherwise(F.coalesce(c("_m").try_cast("int"), names[F.lower("_m")])),
            "_day": F.when(c("_swap"), c("_m").try_cast("int")).otherwise(c("_d").try_cast("int")),
            "_year": F.when(F.length("_y") == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year),
            "_hour": F.when(c("_a") == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.upper("_a") == "P", 12).otherwise(0)),
            "_minute": c("_i").try_cast("int"),
            "_second": F.concat(F.when(c("_s") == "", "0").otherwise(c("_s")), F.lit("."), F.rpad(F.substring("_f", 1, 6), 6, "0")).try_cast("decimal(16,6)"),
            "_shift": F.regexp_extract("_z", offset, 1).try_cast("long") * 60 + F.regexp_extract("_z", offset, 2).try_cast("long"),
            "_place": F.coalesce("zone", F.lit("UTC")),
        }
    )
    sound = (c("_hour") < 24) & (c("_minute") < 60) & (c("_second") < 60)
    df = df.withColumn("_local", F.when(sound, F.try_make_timestamp_ntz("_year", "_month", "_day", "_hour", "_minute", "_second")))
    east = F.startswith("_z", F.lit("+"))
    df = df.withColumns(
        {
            "_shift": F.when(F.upper("_z").isin("Z", "GMT", "UTC", "UT"), 0).otherwise(F.when(east, c("_shift")).otherwise(-c("_shift"))),
            "_first": F.convert_timezone(c("_place"), F.lit("UTC"), c("_local")),
        }
    )
    later = c("_first") + F.expr("interval 1 hour")
    standard = (c("_z") != "") & ~c("_z").isin(DAYLIGHT)
    chosen = F.when(standard & (F.convert_timezone(F.lit("UTC"), c("_place"), later) == c("_local")), later).otherwise(c("_first"))

    def micros(x: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x)

    stated = F.when(c("_t").rlike(_EPOCH), _epoch(c("_t"))).when(c("_shift").isNotNull(), micros(c("_local")) - c("_shift") * 60_000_000)
    df = df.withColumn("_us", stated.otherwise(micros(chosen)))
    return df.select(*kept, F.when(c("_us") >= EARLIEST, c("_us")).alias("utc_us"))


#: Parts of a dictionary that are merged into one.
PARTS = 16


class TimeDictionary:
    """Distinct time texts with the instants they state, kept as a table that grows with every batch of rows.

    Each batch adds one part, under ``path``, that counts once the manifest lists it; ``PARTS`` parts are merged into one. A
    path that holds an earlier dictionary reopens it.
    """

    KEY = ("text", "zone", "day_first")
    SCHEMA = "text string, zone string, day_first boolean, utc_us long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.parts, self._generation = spark, path or new_path(spark, "times"), [], 0
        if path:
            try:
                rows = spark.read.schema("generation int, part string").parquet(f"{path}/manifest")
            except AnalysisException:
                return
            self._generation = rows.agg(F.max("generation")).first()[0] or 0
            self.parts = [r.part for r in rows.where(F.col("generation") == self._generation).collect()]  # at most PARTS

    def known(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], self.SCHEMA)

    def _commit(self, parts: list[str]) -> None:
        self.parts, self._generation = parts, self._generation + 1
        rows = [(self._generation, p) for p in parts]
        self.spark.createDataFrame(rows, "generation int, part string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, rows: DataFrame) -> str:
        part = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(part)
        return part

    def add(self, rows: DataFrame) -> None:
        """Parse the texts of ``rows`` that the dictionary lacks, each once."""
        new = _keyed(rows).select(*self.KEY).where("text is not null and text != ''").distinct()
        if self.parts:
            new = new.join(self.known(), list(self.KEY), "left_anti")
        self._commit([*self.parts, self._write(with_instants(new))])
        if len(self.parts) > PARTS:
            self._commit([self._write(self.known())])

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``rows`` (text, zone, day_first and any other columns) with utc_us; rows that state no instant go.

        Null and empty texts state none; a repeated row comes back as often; a column utc_us that rows bring is replaced.
        """
        self.add(rows)
        return _keyed(rows.drop("utc_us")).join(self.known().where("utc_us is not null"), list(self.KEY))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"zone": F.coalesce("zone", F.lit("UTC")), "day_first": F.coalesce("day_first", F.lit(False))})
