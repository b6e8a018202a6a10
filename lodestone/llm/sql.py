"""DuckDB SQL of the operators that SQL can express, written independently of their plans.

Spans: ``regexp_replace`` puts marks around the matches of a kind, and the lengths of the parts between marks give the offsets.
"""

from __future__ import annotations


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(no: int, kind: str, pattern: str, valid: str = "true") -> str:
    """(row, no, kind, start, stop, m): the matches of one kind; ``valid`` is a condition on m."""
    return f"""
    select row, {no} as no, '{kind}' as kind, start, start + length(m) as stop, m from (
        select row, i, m, coalesce(sum(length(m)) over (partition by row order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start
        from (select row, unnest(p) as m, unnest(range(1, len(p) + 1)) as i from (
            select row, string_split_regex(regexp_replace(t, {_quoted(pattern)}, chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]') as p from texts)))
    where i % 2 = 0 and {valid}"""


TEXTS = "texts as (select row_number() over () as row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t from documents)"


def _report(counted: tuple[str, ...], more: str = "") -> str:
    """One row for each document, of CTEs ``texts`` and ``spans``."""
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, no)"
    base = f"filter (where no < {len(counted)})"
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in counted)
    return f"""
select doc_id, {counts}, sha256(coalesce({joined} {base}, '')) as base_sha256, coalesce({joined}, '') as spans{more}
from texts left join spans using (row) group by row, doc_id"""


OP7 = f"""
with {TEXTS},
spans as ({" union all ".join((
    _kind(0, "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
          r"""length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6"""),
    _kind(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    _kind(2, "hex", "[0-9a-f]+", "length(m) >= 24"),
    _kind(3, "pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    _kind(4, "github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    _kind(5, "slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    _kind(6, "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    _kind(7, "google", "AIza[A-Za-z0-9_-]{35}"),
))})
{_report(("assign", "access", "hex"))}
"""

DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"""list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i:
    case when i % 2 = 1 then reverse({DIGITS})[i]::int when reverse({DIGITS})[i]::int > 4 then 2 * reverse({DIGITS})[i]::int - 9 else 2 * reverse({DIGITS})[i]::int end)) % 10 = 0"""
CODE = "replace(m, ' ', '')"
MOD97 = f"""list_reduce(list_transform(string_split(substr({CODE}, 5) || substr({CODE}, 1, 4), ''), lambda c:
    case when c between '0' and '9' then c::int else ascii(c) - 55 end), lambda a, c: case when c < 10 then (a * 10 + c) % 97 else (a * 100 + c) % 97 end) = 1"""
#: Bank numbers stand between other characters, which are doubled first so that neighbours have one each; halves are put together again in the lengths.
ONCE = "regexp_replace({}, '(?s)([^A-Za-z0-9\\x01\\x02])[^A-Za-z0-9\\x01\\x02]', '\\1', 'g')"
IBAN = f"""
    select row, 4 as no, 'iban' as kind, start, start + length(m) as stop, m from (
        select row, i, m, coalesce(sum(length(m)) over (partition by row order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start
        from (select row, unnest(p) as m, unnest(range(1, len(p) + 1)) as i from (
            select row, list_transform(string_split_regex(regexp_replace(regexp_replace(t, '(?s)([^A-Za-z0-9])', '\\1\\1', 'g'),
                '(^|[^A-Za-z0-9])([A-Z]{{2}}[0-9]{{2}}(?:(?:\\x20\\x20)?[A-Z0-9]{{4}}){{2,7}}(?:(?:\\x20\\x20)?[A-Z0-9]{{1,3}})?)($|[^A-Za-z0-9])',
                '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '[\\x01\\x02]'), lambda x: {ONCE.format("x")}) as p from texts)))
    where i % 2 = 0 and length({CODE}) between 15 and 34 and {MOD97}"""

OP10 = f"""
with {TEXTS},
found as ({" union all ".join((
    _kind(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    _kind(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 and coalesce(try_cast(ltrim(x, '0') as int), 0) <= 255))"),
    _kind(2, "card", r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) between 12 and 19 and {LUHN}"),
    _kind(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) between 9 and 15"),
    IBAN,
))}),
scored as (
    select f.*, [0.9::double, 0.6, 0.8, 0.7, 0.9][no + 1] as weight, substr(t, greatest(1, start - 39), least(start, 40)) as before
    from found f join texts using (row)),
spans as (
    select row, no, kind, start, stop, round(weight + case when (no = 0 and regexp_matches(before, '(?i)\\b(?:e-?mail|contact|write)\\b'))
        or (no = 1 and regexp_matches(before, '(?i)\\b(?:ip|host|server|address)\\b')) or (no = 2 and regexp_matches(before, '(?i)\\b(?:card|visa|credit|payment)\\b'))
        or (no = 3 and regexp_matches(before, '(?i)\\b(?:phone|tel|call|mobile|fax)\\b')) or (no = 4 and regexp_matches(before, '(?i)\\b(?:iban|account|bank|transfer)\\b'))
        then 0.1 else 0.0 end, 2)::double as score
    from scored)
{_report(("email", "ip", "card", "phone"), ", coalesce(string_agg(score::varchar, ',' order by start, no), '') as scores")}
"""

OP8 = """
with usable as (
    select distinct vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
pairs as (
    select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) as score
    from usable q join usable c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""

OP6 = r"""
with words as (
    select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w, row_number() over () as row from documents where text is not null),
items as (
    select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w, row_number() over () as item from benchmark where text is not null),
sized as (select *, least(len(w), 5) as width from items where len(w) > 0),
own as (
    select item_id, item, width, len(w) - width + 1 as m, array_to_string(w[q:q + width - 1], ' ') as x
    from sized, lateral unnest(range(1, len(w) - width + 2)) as u(q)),
counted as (select item_id, item, width, m, x, count(*) as c from own group by all),
cut as (
    select doc_id, row, width, len(w) - width + 1 as n, q - 1 as p, array_to_string(w[q:q + width - 1], ' ') as x
    from words, (select distinct width from sized), lateral unnest(range(1, len(w) - width + 2)) as u(q)),
hits as (
    select doc_id, row, n, p, item_id, item, m, c, x, row_number() over (partition by row, item, x order by p) as r
    from cut join counted using (width, x)),
ranges as (
    select h.*, greatest(0, h.p - h.m + 1, coalesce(b.p + 1, 0)) as low, least(h.p, greatest(0, h.n - h.m)) as high
    from hits h left join hits b on b.row = h.row and b.item = h.item and b.x = h.x and b.r = h.r - h.c),
changes as (
    select doc_id, row, n, item_id, item, m, low as s, 1 as d from ranges where low <= high
    union all select doc_id, row, n, item_id, item, m, high + 1, -1 from ranges where low <= high),
sums as (select doc_id, row, n, item_id, item, m, s, sum(d) as d from changes group by all),
running as (select *, sum(d) over (partition by row, item order by s) as common from sums),
told as (select *, (common::double) / (m + least(m, n) - common)::double as similarity from running),
best as (
    select *, row_number() over (partition by row, item order by similarity desc, s) as r from told where similarity >= 0.8)
select doc_id, item_id, similarity, s::integer as start, m::integer as n_shingles from best where r = 1
"""
