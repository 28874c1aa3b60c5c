"""Personal data against plain regular expressions and whole-number arithmetic."""

import hashlib
import re

import pytest

from courierlake.llm import pii

SCHEMA = "doc_id bigint, text string, spans string, start string, kind string, x string"
EXTRA = ("x",) * 4
IBAN = "DE89 3704 0044 0532 0130 00"
TEXTS = [
    None,
    "",
    "  \n",
    "bob@x.example, a.b+c@d-e.co.uk. x@y z@.q @w.e a@b.c.d_e@f.g-h é@x.y",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 0255.00.1.000001 1.2.3. 999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 1 2 3 0000 0000 0000",
    "+1 (743) 555-3824, +123, +49 30 (0) 1234567.. + 1 2, +1234567890123456, phone +44.20.7946.0958)",
    f"pay to my account {IBAN}, {IBAN[:-1]}1, GB29NWBK60161331926819 X{IBAN} {IBAN}x",
    "my ssn is 123-45-6789, 000-12-3456 and 123-45-67890; order 987-65-4321",
    "tel 030 1234567 or call 01 23 45 67 89; 0123456789 alone, phone +49 030 1234567 version tel 030 7654321",
    "漢字 😀 bob@x.example 😀 1.1.1.1 " * 700,
    "a" * 30_000 + "@b.c " + "1." * 20_000 + "0" * 20_000 + " a@b" + ".c" * 20_000,
    "+1" + "(" * 20_000 + "2 " + "1 " * 20_000,
]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def small(x):
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in x.split("."))


def iban(x):
    compact = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


VALID = {
    "email": lambda x: True,
    "ip": small,
    "card": lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d),
    "phone": lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15,
    "iban": iban,
    "ssn": lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000",
    "tel": lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 12,
}


def brute(text):
    text, found = text or "", []
    for place, kind in enumerate(pii.KINDS):
        hits = [m.span() for m in re.finditer(kind.pattern, text)]
        ends = [0, *[b for _, b in hits]]
        begins = [*[a for a, _ in hits], len(text)]
        for k, (a, b) in enumerate(hits):
            before, after = text[ends[k] : a][-pii.BEFORE :], text[b : begins[k + 1]][: pii.AFTER]
            if not VALID[kind.name](text[a:b]):
                continue
            if kind.apart and (re.search(kind.apart[0][:-1] + r"\Z", before) or re.search(kind.apart[1], after)):
                continue
            around = re.sub("[A-Z]", lambda m: m[0].lower(), before + " " + after)
            word = lambda words: bool(re.search(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)", around))  # noqa: E731, B023
            score = max(0, min(100, kind.score + pii.RAISE * word(kind.near) - pii.DOUBT * word(pii.DOUBTFUL)))
            if kind in pii.BASE or score >= pii.LEAST:
                found.append((a, place, b, kind.name, text[a:b], score))
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    return [(k, t, *EXTRA) for k, t in enumerate(TEXTS)] + [(None, TEXTS[3], *EXTRA), (3, TEXTS[3], *EXTRA)]


def test_spans(spark, rows):
    found = pii.find_pii(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), "spans_"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans_"]] for r in found.collect()}
    assert got == {r[0]: brute(r[1]) for r in rows}
    kinds = {s[3] for spans in got.values() for s in spans}
    assert kinds == {k.name for k in pii.KINDS}


def test_digests(spark, rows):
    got = sorted(map(tuple, pii.pii_digests(pii.find_pii(spark.createDataFrame(rows, SCHEMA), name="found"), "found").collect()), key=str)
    want = []
    for doc, text, *_ in rows:
        spans = brute(text)
        told = lambda some: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in some)
        base = told([s for s in spans if s[1] < len(pii.BASE)])
        want.append((doc, *[sum(s[3] == k.name for s in spans) for k in pii.BASE], hashlib.sha256(base.encode()).hexdigest(), told(spans), ",".join(str(s[5]) for s in spans)))
    assert got == sorted(want, key=str)


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pii.find_pii(none).count() == 0
    plan = pii.pii_digests(pii.find_pii(none), "spans_")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_running_sums(spark):
    for n in (0, 1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 3 * pii.BLOCK):
        values = spark.range(1).selectExpr(f"transform(slice(sequence(1, {n + 1}), 1, {n}), x -> cast(x as bigint)) as v")
        got = values.select(pii.running_sums(values["v"])).first()[0]
        assert got[: n + 1] == [k * (k + 1) // 2 for k in range(n + 1)]
