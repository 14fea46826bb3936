"""SQL of queries whose operators plain SQL can repeat by other means, for comparison on small tables."""

from __future__ import annotations

from . import license_scan, pii

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _templates() -> str:
    rows = []
    for t, (label, phrase) in enumerate([*license_scan.BASE, *license_scan.NOTICES]):
        g = license_scan.grams(phrase)
        rows += [(t, label, t < len(license_scan.BASE), len(g), len(license_scan.words(phrase)), *x) for x in g]
    return ", ".join(f"({', '.join(map(_quoted, r))})" for r in rows)


LICENSES = rf"""
with t(template, label, base, n_grams, n_words, tpos, t1, t2, t3) as (values {_templates()}),
docs as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
words as (select rid, p - 1 as pos, w[p] as w1, w[p + 1] as w2, w[p + 2] as w3 from (select rid, w, unnest(range(1, len(w))) as p from docs)),
votes as (
  select rid, template, any_value(label) as label, any_value(base) as base, any_value(n_grams) as n_grams, any_value(n_words) as n_words,
         pos - tpos as diagonal, list(distinct tpos) as ats, min(pos) as first, max(pos) as last
  from words join t on w1 = t1 and w2 = t2 and (t3 is null or w3 = t3) group by rid, template, pos - tpos),
passages as (
  select *, sum(fresh) over (partition by rid, template order by diagonal rows unbounded preceding) as passage
  from (select *, (base or coalesce(diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {license_scan.NEAR}, true))::int as fresh from votes)),
merged as (
  select rid, template, any_value(label) as label, any_value(base) as base, any_value(n_words) as n_words, min(first) as start,
         max(last) + any_value(n_words) - any_value(n_grams) + 1 as stop, len(list_distinct(flatten(list(ats))))::double / any_value(n_grams) as coverage
  from passages group by rid, template, passage),
spans as (select * from merged where coverage >= case when base then 1 else {license_scan.COVERAGE} end and stop - start <= {license_scan.STRETCH} * n_words),
found as (
  select rid, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
         string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
  from spans group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from docs left join found using (rid)"""

EMBEDDINGS = """
with recursive v as (select row_number() over () as rid, vec_id, embedding::double[] as e from embeddings),
ok as (
  select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.rid as a, b.rid as b from ok a join ok b on a.rid <> b.rid and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(rid, other) as (select rid, rid from v union select r.rid, l.b from reach r join links l on l.a = r.other),
parts as (select r.rid, min(o.vec_id) as component_id from reach r join v o on o.rid = r.other group by r.rid),
counts as (select a as rid, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
from v join parts using (rid) left join counts using (rid)"""

_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _found(kind: int) -> str:
    p = _PATTERNS[kind]
    return f"select rid, text, {kind} as kind, regexp_extract_all(text, '{p}') as m, list_transform(string_split_regex(text, '{p}'), lambda x: len(x)) as g from docs"


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_SUM = "coalesce(list_sum({0}), 0)"
_PUNCT = r"""[,;:!?.)\]"'']*"""


def _terms(token: str, start: str) -> str:
    """The term of a white-space token, or an empty text; a token that begins what is seen needs a bracket or quote."""
    end = rf"(\p{{L}}{{3,}}){_PUNCT}$"
    return rf"""case when {start} > 0 then regexp_extract({token}, '(?:^|[(\["'']){end}', 1) else regexp_extract({token}, '[(\["'']{end}', 1) end"""


PII = rf"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_found(k) for k in range(4))}),
places as (
  select rid, text, kind, m[i] as v, ({_SUM.format("g[1:i]")} + {_SUM.format("list_transform(m[1:i - 1], lambda x: len(x))")})::int as start
  from (select *, unnest(range(1, len(m) + 1)) as i from found)),
digits as (select *, {_DIGITS} as d from places),
base as (
  select rid, text, kind, v, start, start + len(v)::int as stop from digits
  where case kind when 0 then true when 1 then list_bool_and(list_transform(string_split(v, '.'), lambda x: ltrim(x, '0') = '' or (len(ltrim(x, '0')) <= 3 and ltrim(x, '0')::int <= 255)))
    when 3 then len(d) between 10 and 15
    else len(d) between 14 and 19 and list_sum(list_transform(range(len(d)), lambda i: case when i % 2 = 0 then d[len(d) - i]::int else 2 * d[len(d) - i]::int - case when d[len(d) - i]::int > 4 then 9 else 0 end end)) % 10 = 0 end),
held as (select distinct rid, kind || ':' || lower(v) as entity from base),
windows as (select distinct rid, -1 as origin, ' ' || text || ' ' as ctx from base),
tokens as (
  select rid, origin, len(ctx) as size, m[i] as token, ({_SUM.format("g[1:i]")} + {_SUM.format("list_transform(m[1:i - 1], lambda x: len(x))")})::int as off
  from (select *, unnest(range(1, len(m) + 1)) as i from (
    select *, regexp_extract_all(ctx, '[^\t\n\x0B\f\r ]+') as m, list_transform(string_split_regex(ctx, '[^\t\n\x0B\f\r ]+'), lambda x: len(x)) as g from windows))),
near as (
  select rid, origin + off + len(token) - len(regexp_extract(token, '\p{{L}}+{_PUNCT}$')) as start, {_terms("token", "off")} as term from tokens where off + len(token) < size),
terms as (select rid, lower(term) as term, start::int as start, (start + len(term))::int as stop from near where term <> ''),
every_token as (select rid, unnest(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) as token from docs),
n_t as (select term, count(distinct rid) as n_t from (select rid, lower({_terms("token", "1")}) as term from every_token) where term <> '' group by term),
n_e as (select entity, count(*) as n_e from held group by 1),
n_et as (select entity, term, count(*) as n_et from held join (select distinct rid, term from terms) using (rid) group by all),
n as (select count(*)::double as n from docs),
disclosing as (
  select entity, term from n_et join n_e using (entity) join n_t using (term), n
  where ln(n / n_e) > 0 and ln(n_et * n / (n_e * n_t)) >= {pii.THRESHOLD}::double * ln(n / n_e)),
marked as (select distinct rid, 4 as kind, start, stop from terms join held using (rid) join disclosing using (entity, term)),
spans as (select rid, kind, start, stop from base union all select * from marked),
joined as (
  select rid, string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) as spans,
         string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (where kind < 4) as base,
         count(*) filter (where kind = 0) as n_email, count(*) filter (where kind = 1) as n_ip, count(*) filter (where kind = 2) as n_card, count(*) filter (where kind = 3) as n_phone
  from spans group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (rid)"""
