"""The expressions of ``wirelake.functions.text`` as SQL for DuckDB."""

from __future__ import annotations

from wirelake.functions import fixed as V
from wirelake.functions import text as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(q, words))


def ascii_form(e: str) -> str:
    for a, b in V.TRANSLITERATION.items():
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"regexp_replace(translate({e}, {q(X.FOLD_FROM)}, {q(X.FOLD_TO)}), '[^\\x00-\\x7F]+', '', 'g')"


def _trim_marks(e: str) -> str:
    return f"regexp_replace(regexp_replace({e}, ' +', ' ', 'g'), '^[ |:;,-]+|[ |:;,-]+$', '', 'g')"


def normalize(e: str) -> str:
    for a, b in V.REFERENCES.items():
        e = f"replace({e}, {q(a)}, {q(b)})"
    e = f"regexp_replace({ascii_form(e)}, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g')"
    e = f"regexp_replace({e}, '[\\x00-\\x1F\\x7F]', ' ', 'g')"
    for m in ("!", "?", "."):
        e = f"regexp_replace({e}, '[{m}]{{3,}}', '{m}', 'g')"
    return _trim_marks(e)


def clean_title(source: str, title: str) -> str:
    """Nested queries keep the expression short: the caller must alias ``title`` to a column."""
    t = normalize(title)
    return (
        f"(select case when length(c) > 350 then regexp_replace(substr(c, 1, 347), ' [^ ]*$', '') || '...' else c end from (select {_trim_marks(f'regexp_replace(b, {q(V.CLICKBAIT)}, {q(chr(32))}, {q(chr(103))})')} c"
        f" from (select case when {source} in ({listed(V.TAG_SOURCES)}) and starts_with(a, '#') then {split_hashtag('a')} else a end b from (select {t} a))))"
    )


def fold(e: str) -> str:
    return f"trim(regexp_replace(lower(translate({e}, {q(X.FOLD_FROM)}, {q(X.FOLD_TO)})), '[^a-z0-9]+', ' ', 'g'))"


def dedupe_key(e: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g')), '^the ', '')"


def tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), '[a-z0-9][a-z0-9''+.&-]*[a-z0-9+]|[a-z0-9]')"


def significant_tokens(e: str) -> str:
    return f"list_distinct(list_filter({tokens(e)}, lambda t: length(t) >= 3 and not regexp_matches(t, '^[0-9]+$') and t not in ({listed(V.STOPWORDS)})))"


def stems(e: str, letters: int = 5) -> str:
    return f"list_distinct(list_transform({significant_tokens(dedupe_key(e))}, lambda t: substr(t, 1, {letters})))"


def parse_count(e: str) -> str:
    form = "'^\\s*([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*([KkMmBb]?)\\+?\\s*$'"
    return f"try_cast(replace(regexp_extract({e}, {form}, 1), ',', '') as double) * case upper(regexp_extract({e}, {form}, 2)) when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 else 1.0 end"


def host(e: str) -> str:
    return f"regexp_replace(lower(regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"


def registrable(e: str) -> str:
    three = f"regexp_extract({e}, '([^.]+\\.(?:co|com|org|net|gov|ac|edu)\\.[a-z]{{2}})$', 1)"
    return f"case when {three} != '' then {three} else regexp_extract({e}, '([^.]+\\.[^.]+)$', 1) end"


def canonical_url(e: str) -> str:
    return f"{host(e)} || regexp_replace(regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '')"


def public_url(e: str) -> str:
    return f"coalesce(regexp_matches({e}, '^https?://[^/\\s]+\\.[^/\\s]+') and not regexp_matches({host(e)}, '^(?:localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|0\\.)'), false)"


def split_hashtag(e: str) -> str:
    bare = f"trim(regexp_replace({e}, '^#+', ''))"
    s = f"regexp_replace(replace(regexp_replace({bare}, '([A-Z])vs([A-Z])', '\\1 vs \\2', 'g'), '_', ' '), '([a-z])([A-Z0-9])', '\\1 \\2', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
    return f"case when contains({bare}, ' ') then {bare} else trim(regexp_replace({s}, ' +', ' ', 'g')) end"


def is_roundup(e: str) -> str:
    parts = f"list_filter(regexp_split_to_array({e}, '\\s+\\|\\s+'), lambda p: len(list_filter(regexp_split_to_array(trim(p), '\\s+'), lambda w: w != '')) >= 4)"
    return f"(regexp_matches({e}, {q(V.LIVE_BLOG)}) or regexp_matches({e}, {q(V.DIGEST)}) or len({parts}) >= 2)"


def category_of(e: str) -> str:
    votes = {c: f"len(regexp_extract_all(lower({e}), '\\b(?:{'|'.join(w)})\\b'))" for c, w in X.CATEGORY_WORDS.items()}
    most = f"greatest({', '.join(votes.values())})"
    return f"case when {most} = 0 then null {' '.join(f'when {v} = {most} then {q(c)}' for c, v in votes.items())} end"


def ngrams(e: str, n: int) -> str:
    return f"case when len({e}) >= {n} then list_transform(range(1, len({e}) - {n} + 2), lambda i: array_to_string(list_slice({e}, i, i + {n - 1}), ' ')) else [] end"


def sentences(e: str) -> str:
    guarded = f"regexp_replace({e}, '\\b((?:Mr|Mrs|Ms|Dr|St|Gov|Sen|Rep|Gen|No|vs|Inc|Ltd|Co|Jr|Sr|[A-Z])\\.)\\s+', '\\1' || chr(1), 'g')"
    cut = f"string_split(regexp_replace({guarded}, '([.!?][\"'')]*)\\s+([A-Z0-9\"''(])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    return f"list_filter(list_transform({cut}, lambda s: trim(replace(s, chr(1), ' '))), lambda s: s != '')"


def numbers(e: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({e}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(regexp_replace(x, ',+$', ''), ',', '')))"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / nullif(len(list_distinct({a})), 0)"


def jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0)"
