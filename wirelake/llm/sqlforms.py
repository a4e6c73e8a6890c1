"""What problems 1, 2, 4, 7 and 9 ask for, as SQL for DuckDB: plain statements that compare all pairs, for small tables only."""

from __future__ import annotations

from wirelake.llm.lookalike import MAPPING

_ONE = {chr(k): v for k, v in MAPPING.items() if len(v) == 1}
_NONE = [chr(k) for k, v in MAPPING.items() if not v]
_MORE = {chr(k): v for k, v in MAPPING.items() if len(v) > 1}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form(e: str) -> str:
    """The consistent form of a text."""
    e = f"nfc_normalize({e})"
    for a, b in _MORE.items():
        e = f"replace({e}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize(translate({e}, {_q(''.join([*_ONE, *_NONE]))}, {_q(''.join(_ONE.values()))}))"


def words(e: str) -> str:
    """The words of a text; of character references only those of markup."""
    for a, b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&AMP;", "&")):
        e = f"replace({e}, {_q(a)}, {_q(b)})"
    return f"regexp_extract_all(replace(lower({form(e)}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"


TEXTS = "x as (select 'raw_items' tbl, id, title text from raw_items union all select 'trend_items', item_no, description from trend_items)"


def near(rows: str) -> str:
    """Common tables from rows (tbl, id, text): ``b`` (tbl, id, bag) and ``p`` (tbl, a, b), the near pairs of different bags."""
    return f"""b as materialized (select tbl, id, list_sort({words('text')}) bag from ({rows}) where text is not null), k as materialized (select tbl, bag, len(bag) n, row_number() over () k from (select distinct tbl, bag from b where len(bag) > 0)),
  w as materialized (select tbl, k, n, word, count(*) c from (select tbl, k, n, unnest(bag) word from k) group by all),
  p as materialized (select x.tbl, x.k a, y.k b from w x join w y on x.tbl = y.tbl and x.word = y.word and x.k < y.k and x.n * 100 >= y.n * 80 and y.n * 100 >= x.n * 80 group by x.tbl, x.k, y.k having sum(least(x.c, y.c)) * 100 >= 80 * greatest(any_value(x.n), any_value(y.n)))"""


LOOKALIKES = f"with {TEXTS}, f as materialized (select tbl, id, text, {form('text')} form from x where text is not null and text != '') select a.tbl, a.id id_a, b.id id_b from f a join f b on a.tbl = b.tbl and a.form = b.form and a.id < b.id and a.text != b.text"
CLASSES = f"with {TEXTS}, f as materialized (select tbl, id, text, {form('text')} form from x where text is not null and text != '') select tbl, min(id) first_id, count(*) records, count(distinct text) variants, count(*) filter (text != form) \"unstable\" from f group by tbl, form having count(distinct text) > 1"
GROUPS = f"""with recursive {TEXTS}, {near('select * from x')}, e as (select tbl, a, b from p union all select tbl, b, a from p), r as (select tbl, k a, k b from k union select r.tbl, r.a, e.b from r join e on e.tbl = r.tbl and e.a = r.b),
  c as (select a k, min(b) root from r group by a), m as (select b.tbl, b.id, root from b join k using (tbl, bag) join c using (k)), s as (select *, min(id) over (partition by tbl, root) first_id from m) select distinct tbl, first_id, id from s where id != first_id"""


def _url(e: str) -> str:
    bare = f"regexp_replace(regexp_replace(trim({e}), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '[?#].*$', '')"
    return f"regexp_replace(lower(regexp_extract({bare}, '^[^/]*')), '^www\\.', '') || regexp_replace(regexp_extract({bare}, '/.*$'), '/+$', '')"


HISTORY = f"""with i as materialized (select r.id, r.title, r.url, lower(content_hash) h, started_at s, status = 'valid' v from raw_items r join runs using (run_id) where started_at is not null), {near("select 'raw_items' tbl, id, title text from i")},
  o as (select b.id, k.k from b join k using (tbl, bag)), f as (select k, min(s) filter (v) s from o join i using (id) group by k), q as (select a, b from p union all select b, a from p union all select k, k from k),
  t as (select q.a k, min(f.s) s from q join f on f.k = q.b group by q.a), g as (select h, min(s) s from i where v and h is not null group by h),
  l as (select case when starts_with(r, 't:') then r else {_url('r')} end as key, min(seen) seen from (select epoch(first_seen_utc) seen, unnest(reports) r from registry_events) group by 1),
  y as (select i.*, case when url is not null then {_url('url')} else 't:' || trim(regexp_replace(lower(strip_accents({form('title')})), '[^a-z0-9]+', ' ', 'g')) end as key from i)
  select distinct y.id from y left join o using (id) left join t using (k) left join g using (h) left join l using (key) where t.s < y.s or g.s < y.s or l.seen < y.s"""
NEAREST = """with v as (select vec_key, regexp_replace(vec_key, '\\|[^|]*$', '') sp, dims, vec::double[] v from vectors where vec is not null and len(vec) = dims and len(list_filter(vec, lambda x: not isfinite(x))) = 0 and len(list_filter(vec, lambda x: x != 0)) > 0),
  r as (select x.vec_key a, y.vec_key b, row_number() over (partition by x.vec_key order by round(list_cosine_similarity(x.v, y.v), 9) desc, y.vec_key) n from v x join v y on x.sp = y.sp and x.dims = y.dims and x.vec_key != y.vec_key)
  select distinct least(a, b) key_a, greatest(a, b) key_b from r where n <= 5"""


def _runs(key: str, text: str, table: str) -> str:
    return f"(select distinct {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) g from (select {key}, {words(text)} w from {table}) where len(w) >= 12)"


LEAKS = f"select distinct doc_id, item_id from {_runs('doc_id', 'text', 'documents')} join {_runs('item_id', 'passage', 'eval_items')} using (g)"
LEAK_REPORT = f"with h as ({LEAKS}) select item_id, any_value(suite) suite, count(*) documents, min(doc_id) first_doc from h join eval_items using (item_id) group by item_id"
