"""Text functions over the stored texts: sentences, repeats, overlaps, flags, names, times of day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirelake.functions import fixed as V
from wirelake.functions import sql as Q
from wirelake.functions import text as X
from wirelake.session import spread, table
from wirelake.sources.payloads import publication_time

#: Other names of categories, and what a name contains where no alias fits: parameters.
ALIASES = {"tech": "Tech", "technology": "Tech", "ai": "Science & AI", "science": "Science & AI", "sport": "Sports", "sports": "Sports", "film": "Entertainment", "culture": "Internet Culture", "politics": "News", "world": "News"}
CONTAINS = (("sport", "Sports"), ("tech", "Tech"), ("scien", "Science & AI"), ("entertain", "Entertainment"), ("culture", "Internet Culture"), ("news", "News"))
DANGLING = "a an the of to in on at by for from with and or but as that which who is are was were".split()
PAGE_VOICE = r"(?i)\b(?:click here|sign up|subscribe|read more|cookies?|newsletter|all rights reserved|follow us|log in)\b"
ZONE = "America/Chicago"


def _trend(spark, sf_dir):
    return spread(table(spark, sf_dir, "trend_items"))


def sentence_split(spark, sf_dir):
    """The sentences of every description, numbered, with their words."""
    s = _trend(spark, sf_dir).where("description is not null").select("item_no", F.posexplode(X.sentences(F.col("description"))).alias("place", "sentence"))
    return s.select("item_no", F.col("place").cast("bigint").alias("place"), F.sha1("sentence").alias("sentence"), F.size(X.tokens(F.col("sentence"))).cast("bigint").alias("words"))


def repeated_ngrams(spark, sf_dir, n: int = 4):
    """How many runs of four tokens a description repeats within itself."""
    rows = _trend(spark, sf_dir).where("description is not null").select("item_no", X.ngrams(X.tokens(F.col("description")), n).alias("g"))
    return rows.select("item_no", F.size("g").cast("bigint").alias("runs"), (F.size("g") - F.size(F.array_distinct("g"))).cast("bigint").alias("repeated"))


def restated_descriptions(spark, sf_dir):
    """How much of a title its description says again, and how much it adds."""
    t, d = X.significant_tokens(F.col("title")), X.significant_tokens(F.col("description"))
    rows = _trend(spark, sf_dir).where("description is not null").select("item_no", t.alias("t"), d.alias("d"))
    return rows.select("item_no", F.round(X.overlap(F.col("t"), F.col("d")), 6).alias("restates"), F.size(F.array_except("d", "t")).cast("bigint").alias("adds"), F.round(X.jaccard(F.col("t"), F.col("d")), 6).alias("jaccard"))


def brief_lines(spark, sf_dir, limit: int = 170):
    """The first sentence of a description, clipped at a word."""
    first = F.get(X.sentences(F.col("description")), F.lit(0))
    rows = _trend(spark, sf_dir).where("description is not null").select("item_no", first.alias("s")).where("s is not null")
    clipped = F.when(F.length("s") <= limit, F.col("s")).otherwise(F.concat(F.regexp_replace(F.substring("s", 1, limit - 3), r"\s+\S*$", ""), F.lit("...")))
    return rows.select("item_no", clipped.alias("line"))


def text_flags(spark, sf_dir):
    """Of each description: whether it speaks for the page, begins in the middle, ends dangling, is thin, or repeats its title."""
    toks = X.tokens(F.col("description"))
    rows = _trend(spark, sf_dir).where("description is not null").select("item_no", "description", toks.alias("w"), X.significant_tokens(F.col("title")).alias("t"), X.significant_tokens(F.col("description")).alias("d"))
    last = F.regexp_extract(F.lower("description"), r"([a-z]+)[^a-z]*$", 1)
    return rows.select(
        "item_no", F.col("description").rlike(PAGE_VOICE).alias("page_voice"), F.col("description").rlike(r"^\s*[a-z]").alias("fragment"), last.isin(DANGLING).alias("dangling"),
        (F.size("w") < 15).alias("thin"), F.coalesce(X.overlap(F.col("d"), F.col("t")) > 0.6, F.lit(False)).alias("echo"),
    )


def gate_reasons(spark, sf_dir):
    """Why texts would be held back, counted: empty, thin, echoes of the headline, prompt leaks, and page voices."""
    d, t = F.col("description"), F.col("title")
    empty = F.coalesce(F.trim(d) == "", F.lit(True))
    echo = F.coalesce(X.overlap(X.significant_tokens(d), X.significant_tokens(t)) > 0.6, F.lit(False))
    flags = {"empty": empty, "thin": ~empty & (F.size(X.tokens(d)) < 15), "headline_echo": ~empty & echo, "prompt_leak": F.coalesce(d.rlike(V.PROMPT_LEAK), F.lit(False)), "page_voice": F.coalesce(d.rlike(PAGE_VOICE), F.lit(False))}
    reasons = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]), lambda x: x.isNotNull())
    return _trend(spark, sf_dir).select("source", F.explode(F.when(F.size(reasons) == 0, F.array(F.lit("passed"))).otherwise(reasons)).alias("reason")).groupBy("source", "reason").agg(F.count("*").alias("texts"))


def quarantine_log(spark, sf_dir):
    """The newest twenty held-back texts of each day of retrieval."""
    d = F.col("description")
    held = _trend(spark, sf_dir).where((F.size(X.tokens(d)) < 15) | d.rlike(V.PROMPT_LEAK)).select("item_no", F.substring(F.col("metadata")["retrieved_at"], 1, 10).alias("day"), F.col("metadata")["retrieved_at"].alias("at"))
    n = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("at"), "item_no"))
    return held.where("day is not null").withColumn("n", n).where("n <= 20").select("day", "item_no", F.col("n").cast("bigint").alias("n"))


def language_share(spark, sf_dir):
    """Share of function words among a document's tokens by language: what tells English from the others."""
    toks = X.tokens(F.col("text"))
    stop = F.array(*[F.lit(w) for w in V.STOPWORDS])
    rows = spread(table(spark, sf_dir, "documents").select("lang", "text")).select(F.coalesce("lang", F.lit("?")).alias("lang"), toks.alias("w")).select("lang", F.size("w").alias("n"), F.size(F.filter("w", lambda x: F.array_contains(stop, x))).alias("s"))
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").cast("bigint").alias("words"), F.count_if(F.col("s") >= 0.2 * F.col("n")).alias("english"))


def search_folds(spark, sf_dir):
    return table(spark, sf_dir, "cleaned_items").select("item_id", X.fold(F.col("title")).alias("folded"))


def outlet_keys(spark, sf_dir):
    """Each outlet by its publisher's letters, or its domain where there is none: items, names and hosts."""
    rows = table(spark, sf_dir, "raw_items").where("url is not null").select("feed", X.host(F.col("url")).alias("host"))
    named = rows.join(table(spark, sf_dir, "feeds").select("feed", "publisher"), "feed", "left")
    key = F.coalesce(F.nullif(F.regexp_replace(F.lower("publisher"), "[^a-z0-9]+", ""), F.lit("")), X.registrable(F.col("host")))
    return named.where(~X.registrable(F.col("host")).isin(V.AGGREGATORS)).groupBy(key.alias("outlet")).agg(F.count("*").alias("items"), F.count_distinct("publisher").alias("names"), F.count_distinct("host").alias("hosts"))


def coerced_categories(spark, sf_dir):
    """Free category texts as known ones: by alias, else by what they contain."""
    low = F.trim(F.lower("category"))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    out = F.lit(None).cast("string")
    for part, name in reversed(CONTAINS):
        out = F.when(low.contains(part), F.lit(name)).otherwise(out)
    return table(spark, sf_dir, "feeds").select("feed", F.coalesce(alias[low], out, F.lit("News")).alias("category"))


def central_dates(spark, sf_dir):
    """The calendar date and hour of an item in one zone, clock changes included."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("item_time").cast("timestamp_ntz"))
    return table(spark, sf_dir, "cleaned_items").select("item_id", F.date_format(local, "yyyy-MM-dd").alias("date"), F.hour(local).cast("bigint").alias("hour"))


def age_buckets(spark, sf_dir):
    """Items by how old they are against the newest."""
    c = table(spark, sf_dir, "cleaned_items").select("item_time")
    newest = c.agg(F.max("item_time").alias("newest"))
    hours = (F.unix_timestamp("newest") - F.unix_timestamp("item_time")) / 3600
    bucket = F.when(hours.isNull(), "unknown").when(hours < 1, "under an hour").when(hours < 24, "today").when(hours < 48, "yesterday").when(hours < 168, "this week").otherwise("older")
    return c.join(F.broadcast(newest)).groupBy(bucket.alias("age")).agg(F.count("*").alias("items"))


def json_payloads(spark, sf_dir):
    """JSON inside prose, with a trailing comma: found, mended and read back."""
    said = F.concat(F.lit("Sure! ```json\n"), F.regexp_replace(F.to_json("metadata"), r"\}$", ",}"), F.lit("\n``` done"))
    found = F.regexp_replace(F.regexp_extract(said, r"(?s)(\{.*\})", 1), r",\s*\}$", "}")
    return table(spark, sf_dir, "cleaned_items").select("item_id", F.from_json(found, "map<string,string>").alias("m")).select("item_id", F.cardinality("m").cast("bigint").alias("keys"), F.col("m")["publisher"].alias("publisher"))


def feed_fingerprints(spark, sf_dir):
    """A feed's settings as sixteen hex digits, whatever their order."""
    parts = F.array_join(F.array_sort(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in ("publisher", "channel", "lang", "zone_name", "day_first", "enabled")])), "|")
    return table(spark, sf_dir, "feeds").select("feed", F.substring(F.sha2(parts, 256), 1, 16).alias("fingerprint"))


def publication_notes(spark, sf_dir):
    """What is wrong with the stated times of items, against when their run captured them."""
    raw = table(spark, sf_dir, "raw_items").select(F.timestamp_seconds(F.col("item_ts").try_cast("double")).alias("stated"), F.timestamp_seconds("captured_at").alias("captured"))
    return raw.select(publication_time(F.col("stated"), F.col("captured"))["note"].alias("note")).groupBy("note").agg(F.count("*").alias("items"))


QUERIES = {f.__name__: f for f in (sentence_split, repeated_ngrams, restated_descriptions, brief_lines, text_flags, gate_reasons, quarantine_log, language_share, search_folds, outlet_keys, coerced_categories, central_dates, age_buckets, json_payloads, feed_fingerprints, publication_notes)}

_SIG_T, _SIG_D, _TOK = Q.significant_tokens("title"), Q.significant_tokens("description"), Q.tokens("description")
_LEAK, _VOICE = f"coalesce(regexp_matches(description, {Q.q(V.PROMPT_LEAK)}), false)", f"coalesce(regexp_matches(description, {Q.q(PAGE_VOICE)}), false)"
SQL = {
    "sentence_split": f"with s as (select item_no, {Q.sentences('description')} l from trend_items where description is not null), e as (select item_no, unnest(l) s, unnest(range(len(l))) place from s) select item_no, place::bigint place, sha1(s) sentence, len({Q.tokens('s')})::bigint words from e",
    "repeated_ngrams": f"with t as (select item_no, {_TOK} w from trend_items where description is not null), g as (select item_no, {Q.ngrams('w', 4)} g from t) select item_no, len(g)::bigint runs, (len(g) - len(list_distinct(g)))::bigint repeated from g",
    "restated_descriptions": f"with t as (select item_no, {_SIG_T} t, {_SIG_D} d from trend_items where description is not null) select item_no, round({Q.overlap('t', 'd')}, 6) restates, len(list_filter(d, lambda x: not list_contains(t, x)))::bigint adds, round({Q.jaccard('t', 'd')}, 6) jaccard from t",
    "brief_lines": f"with s as (select item_no, ({Q.sentences('description')})[1] s from trend_items where description is not null) select item_no, case when length(s) <= 170 then s else regexp_replace(substr(s, 1, 167), '\\s+\\S*$', '') || '...' end line from s where s is not null",
    "text_flags": f"select item_no, {_VOICE} page_voice, regexp_matches(description, '^\\s*[a-z]') fragment, regexp_extract(lower(description), '([a-z]+)[^a-z]*$', 1) in ({Q.listed(DANGLING)}) dangling, len({_TOK}) < 15 thin, coalesce({Q.overlap(_SIG_D, _SIG_T)} > 0.6, false) echo from trend_items where description is not null",
    "gate_reasons": f"with f as (select source, coalesce(trim(description) = '', true) em, len({_TOK}) n, coalesce({Q.overlap(_SIG_D, _SIG_T)} > 0.6, false) echo, {_LEAK} leak, {_VOICE} voice from trend_items), r as (select source, list_filter([case when em then 'empty' end, case when not em and n < 15 then 'thin' end, case when not em and echo then 'headline_echo' end, case when leak then 'prompt_leak' end, case when voice then 'page_voice' end], lambda x: x is not null) r from f), e as (select source, unnest(case when len(r) = 0 then ['passed'] else r end) reason from r) select source, reason, count(*) texts from e group by all",
    "quarantine_log": f"with h as (select item_no, substr(metadata['retrieved_at'], 1, 10) \"day\", metadata['retrieved_at'] t from trend_items where len({_TOK}) < 15 or {_LEAK}) select \"day\", item_no, row_number() over (partition by \"day\" order by t desc, item_no)::bigint n from h where \"day\" is not null qualify row_number() over (partition by \"day\" order by t desc, item_no) <= 20",
    "language_share": f"with w as (select coalesce(lang, '?') lang, {Q.tokens('text')} w from documents), s as (select lang, len(w) n, len(list_filter(w, lambda x: x in ({Q.listed(V.STOPWORDS)}))) s from w) select lang, count(*) documents, sum(n)::bigint words, count(*) filter (s >= 0.2 * n) english from s group by lang",
    "search_folds": f"select item_id, {Q.fold('title')} folded from cleaned_items",
    "outlet_keys": f"with r as (select feed, {Q.host('url')} host from raw_items where url is not null), n as (select r.*, publisher, {Q.registrable('r.host')} d from r left join feeds using (feed)) select coalesce(nullif(regexp_replace(lower(publisher), '[^a-z0-9]+', '', 'g'), ''), d) outlet, count(*) items, count(distinct publisher) names, count(distinct host) hosts from n where d not in ({Q.listed(V.AGGREGATORS)}) group by 1",
    "coerced_categories": f"select feed, coalesce(map_extract_value(map {{{', '.join(f'{Q.q(a)}: {Q.q(b)}' for a, b in ALIASES.items())}}}, trim(lower(category))), case {' '.join(f'when contains(trim(lower(category)), {Q.q(a)}) then {Q.q(b)}' for a, b in CONTAINS)} end, 'News') category from feeds",
    "central_dates": f"select item_id, strftime(timezone('{ZONE}', item_time::timestamptz), '%Y-%m-%d') \"date\", hour(timezone('{ZONE}', item_time::timestamptz))::bigint \"hour\" from cleaned_items",
    "age_buckets": "with h as (select (floor(epoch((select max(item_time) from cleaned_items))) - floor(epoch(item_time))) / 3600 h from cleaned_items) select case when h is null then 'unknown' when h < 1 then 'under an hour' when h < 24 then 'today' when h < 48 then 'yesterday' when h < 168 then 'this week' else 'older' end age, count(*) items from h group by 1",
    "json_payloads": "select item_id, cardinality(metadata)::bigint keys, metadata['publisher'] publisher from cleaned_items",
    "feed_fingerprints": "select feed, substr(sha256(array_to_string(list_sort(['publisher=' || coalesce(publisher, 'null'), 'channel=' || coalesce(channel, 'null'), 'lang=' || coalesce(lang, 'null'), 'zone_name=' || coalesce(zone_name, 'null'), 'day_first=' || coalesce(day_first::varchar, 'null'), 'enabled=' || coalesce(enabled::varchar, 'null')]), '|')), 1, 16) fingerprint from feeds",
    "publication_notes": "with s as (select try_cast(item_ts as double) s, captured_at c from raw_items) select case when s is null then 'missing' when s < 788918400 then 'too old' when s > c + 900 then 'in the future' when s > c then 'clamped' else 'stated' end note, count(*) items from s group by 1",
}
