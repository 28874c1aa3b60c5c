"""DuckDB SQL of the query op11_pii: each kind's matches and gaps as rows, places as window sums."""

from __future__ import annotations

from .pii import AFTER, BASE, BEFORE, DOUBT, DOUBTFUL, KINDS, LEAST, RAISE, Kind

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_ORD = "list_transform(string_split({}, ''), lambda c: ascii(c))"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: case when i % 2 = 1 then c::int when c::int > 4 then 2 * c::int - 9 else 2 * c::int end)) % 10 = 0"
# Each character's number in two digits, a digit's in one: the text of the whole number, taken apart again for the remainder.
_MOVED = "array_to_string(list_transform(string_split(substr(replace(x, ' ', ''), 5) || replace(x, ' ', '')[1:4], ''), lambda c: case when ascii(c) < 65 then c else (ascii(c) - 55)::varchar end), '')"
_MOD = f"list_reduce(list_transform(string_split({_MOVED}, ''), lambda c: c::int), lambda a, c: (a * 10 + c) % 97) = 1"
_VALID = {
    "email": "true",
    "ip": rf"regexp_matches(x, '^{_BYTE}(?:\.{_BYTE}){{3}}$')",
    "card": f"case when length({_DIGITS}) between 12 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": _MOD,
    "ssn": "not regexp_matches(x, '^(?:000|666|9)|-00-|0000$')",
    "tel": f"length({_DIGITS}) between 9 and 12",
}


def _of(place: int, kind: Kind) -> str:
    around = f"translate(right(before, {BEFORE}) || ' ' || left(after, {AFTER}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = lambda words: f"regexp_matches({around}, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)')::int"
    apart = f" and not regexp_matches(right(before, {BEFORE}), '{kind.apart[0]}') and not regexp_matches(left(after, {AFTER}), '{kind.apart[1]}')" if kind.apart else ""
    least = "" if kind in BASE else f" where score >= {LEAST}"
    return rf"""select * from (
  select rn, begin, {place} as place, begin + length(x) as finish, '{kind.name}' as kind,
    greatest(0, least(100, {kind.score} + {RAISE} * {word(kind.near)} - {DOUBT} * {word(DOUBTFUL)})) as score
  from (
    select rn, x, before, after,
      (sum(length(before) + length(x)) over (partition by rn order by i) - length(x))::bigint as begin
    from (
      select rn, unnest(found) as x, unnest(gaps[:len(found)]) as before, unnest(gaps[2:]) as after, unnest(range(len(found))) as i
      from (select rn, regexp_extract_all(text, '{kind.pattern}') as found, string_split_regex(text, '{kind.pattern}') as gaps from d)))
  where {_VALID[kind.name]}{apart}){least}"""


def _sql() -> str:
    spans = "\nunion all\n".join(_of(place, kind) for place, kind in enumerate(KINDS))
    one = "kind || ':' || begin || ':' || finish"
    base = f"place < {len(BASE)}"
    counts = ", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in BASE)
    counted = ", ".join(f"count(*) filter (where kind = '{k.name}') as n_{k.name}" for k in BASE)
    return f"""
with d as (select row_number() over () as rn, doc_id, coalesce(text, '') as text from documents),
s as ({spans}),
g as (
  select rn, {counted},
    string_agg({one}, ',' order by begin, place) filter (where {base}) as base,
    string_agg({one}, ',' order by begin, place) as spans, string_agg(score::varchar, ',' order by begin, place) as scores
  from s group by rn)
select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
from d left join g using (rn)
"""


PII_SQL = _sql()
