"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise or lower their score.

Only column functions: a table of texts is one scan, without any shuffle. Every kind's pattern is split out of the
text once, which gives the matches and the gaps between them; places are sums of their lengths. The context of a
match is the end of the gap before it and the head of the gap after it, so the work is linear in the text. Sums run
in blocks of BLOCK matches, since appending to one long array would copy it each time.

Spans of the kinds in BASE are reported whenever they are confirmed, whatever their score; the others need LEAST.

Defined cases: null texts count as empty and have no spans; texts of any length are read whole; rows may repeat and ids
may be null or equal; an empty table gives an empty result; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty, unused

#: Code points before and after a match that are searched for context words.
BEFORE, AFTER = 48, 24
#: What context adds and doubt takes, in percent, and what spans of further kinds need.
RAISE, DOUBT, LEAST = 30, 20, 50
BLOCK = 256
DOUBTFUL = "example|sample|version|invoice|order|isbn|beispiel|ejemplo|exemple|rechnung|factura|facture"

# Lengths of account numbers by country; fixed values.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
}


def iban_pattern() -> str:
    """Country, two check digits and exactly as many characters as the country asks for, single blanks between any two."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "(?:" + "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())) + ")"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _small_parts(x: Column) -> Column:
    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.rlike(x, F.lit(rf"^{byte}(?:\.{byte}){{3}}$"))


def luhn(x: Column) -> Column:
    return F.length(_digits(x)).between(12, 19) & F.call_function("luhn_check", _digits(x))


def mod_97(x: Column) -> Column:
    """Whether the number that letters (10 to 35) and digits make, first four characters last, leaves 1."""
    compact = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4)), "")
    worth = lambda c: F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(F.ascii(c) < 65, 10).otherwise(100) + worth(c)) % 97
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """pattern: what the kind means, leftmost and greedy. linear: the same matches in time linear in the text.

    valid: of a match. apart: what must not stand just before and just after it, as patterns. near: words that raise the score.
    needs: what every match holds, so that texts without it need no search.
    """

    name: str
    pattern: str
    score: int
    near: str
    valid: Callable[[Column], Column]
    linear: str | None = None
    apart: tuple[str, str] | None = None
    needs: str = ""


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match begins where a run of its first class does, or where the last match ended.
BASE = (
    Kind(
        "email",
        rf"{_LOCAL}+@{_LABEL}+(?:\.{_LABEL}+)+",
        80,
        "e-?mail|mail|contact|contacto|kontakt|write",
        lambda x: F.lit(True),
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
        needs="@",
    ),
    Kind("ip", r"[0-9]+(?:\.[0-9]+){3}", 60, "ip|address|server|host|adresse|servidor|serveur", _small_parts, r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])+", 70, "card|credit|visa|mastercard|karte|tarjeta|carte", luhn, r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 60, "phone|tel|call|mobile|fax|telefon|handy|anrufen|telefono|movil|portable", lambda x: F.length(_digits(x)).between(9, 15), needs="+"),
)
FURTHER = (
    Kind("iban", iban_pattern(), 80, "iban|account|bank|konto|cuenta|compte", mod_97, "(?=[A-Z]{2}[0-9]{2})" + iban_pattern(), ("[A-Za-z0-9]$", "^[A-Za-z0-9]")),
    Kind(
        "ssn",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        30,
        "ssn|social|security",
        lambda x: ~F.rlike(x, F.lit("^(?:000|666|9)|-00-|0000$")),
        None,
        ("[0-9-]$", "^-?[0-9]"),
    ),
    Kind(
        "tel",
        r"0[0-9][\x20()./0-9-]{5,18}[0-9]",
        30,
        "phone|tel|call|mobile|fax|telefon|handy|anrufen|telefono|movil|portable",
        lambda x: F.length(_digits(x)).between(9, 12),
        None,
        (r"(?:[+0-9][\x20()./-]*|[A-Za-z.-])$", "^[0-9A-Za-z]"),
    ),
)
KINDS = BASE + FURTHER
SPAN = "struct<start:bigint,place:int,end:bigint,kind:string,text:string,score:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Of an array of bigint: the sum of all elements before each, and one for the end."""
    last = lambda a: F.get(a, F.size(a) - 1)
    zero = F.array(F.lit(0).cast("bigint"))
    grow = lambda sums, x: F.array_append(sums, last(sums) + x)

    def blocks(all_lengths: Column) -> Column:
        inside = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_lengths) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(all_lengths, b * BLOCK + 1, F.lit(BLOCK)), zero, grow))
        # The last sum of a block is the first of the next.
        before = lambda s: F.slice(F.aggregate(s, zero, lambda sums, x: grow(sums, last(x))), 1, F.size(s))
        own = lambda x: F.slice(x, 1, F.least(F.lit(BLOCK), F.size(x)))
        return _let(inside, lambda s: F.flatten(F.zip_with(s, before(s), lambda x, add: F.transform(own(x), lambda v: v + add))))

    return _let(lengths, blocks)


def score_of(kind: Kind, before: Column, after: Column) -> Column:
    """Percent, from a confirmed match's surroundings."""
    around = F.translate(F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = lambda words: F.rlike(around, F.lit(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(kind.score) + RAISE * word(kind.near) - DOUBT * word(DOUBTFUL)))


def _spans_of(kind: Kind, text: Column) -> Column:
    pattern = kind.linear or kind.pattern
    base = kind in BASE

    def built(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, x: (F.length(g) + F.length(x)).cast("bigint"))

            def spans(sums: Column) -> Column:
                def span(x: Column, i: Column) -> Column:
                    before, after = F.get(gaps, i), F.get(gaps, i + 1)
                    begin = F.get(sums, i) + F.length(before)
                    holds = kind.valid(x)
                    if kind.apart:
                        holds = holds & ~F.rlike(F.right(before, F.lit(BEFORE)), F.lit(kind.apart[0])) & ~F.rlike(F.left(after, F.lit(AFTER)), F.lit(kind.apart[1]))
                    whole = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("place"), (begin + F.length(x)).alias("end"), F.lit(kind.name).alias("kind"), x.alias("text"), score_of(kind, before, after).alias("score"))
                    return F.when(holds, whole)

                return F.transform(found, span)

            return _let(running_sums(lengths), spans)

        return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), placed))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), built)
    found = F.when(F.contains(text, F.lit(kind.needs)), found) if kind.needs else found
    return F.filter(F.coalesce(found, F.array().cast(f"array<{SPAN}>")), lambda s: s.isNotNull() & (F.lit(base) | (s["score"] >= LEAST)))


def pii_spans(text: Column) -> Column:
    """Array of SPAN by start, then kind: all personal data of a text, places in code points, ends exclusive."""
    return F.sort_array(F.concat(*[_spans_of(k, text) for k in KINDS]))


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """docs with a column of pii_spans(); it takes a longer name if docs has one of that name."""
    return docs.withColumn(unused(docs.columns, name), pii_spans(text_or_empty(docs[text_col])))


def told(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(found: DataFrame, spans_col: str = "spans", id_col: str = "doc_id") -> DataFrame:
    """id, counts of the base kinds, SHA-256 of the base spans, all spans and their scores as text."""
    spans = F.col(spans_col)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k.name)).cast("bigint").alias(f"n_{k.name}")
    base = F.filter(spans, lambda s: s["place"] < len(BASE))
    return found.select(
        F.col(id_col),
        *[count(k) for k in BASE],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
