"""Phrase mining against plain counting; shards and merges against one count of everything."""

import random
import re
from collections import Counter, defaultdict

import pytest
import pyarrow as pa

from courierlake.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, phrase string, a string, head string, n string"
EXTRA = ("x",) * 4
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    return f, n


def brute(rows, least, share, top):
    f, n = counted(rows)
    out = []
    for lang, g in f.items():
        found = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + m] for p, b in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= share * found[p[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in dropped:
                s, k = min((2_000_000 * a // (g[p[:k]] + g[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def fixture():
    r = random.Random(3)
    some = ["new", "york", "city", "of", "the", "é", "Zürich", "漢字", "x\x00y", "\x85", "a-b", "(c)"]
    texts = [None, "", " \t ", "one", "a b c d e f", "New York, new\tyork.\nNEW YORK!new  york?" * 12, "again and again and again " * 40, "k" * 3000]
    texts += [" ".join(r.choices(some, [9, 8, 3, 5, 6, 1, 1, 1, 1, 1, 1, 1], k=r.randint(1, 120))) + r.choice(["", ".", " . ; "]) for _ in range(60)]
    rows = [(k, t, ["en", "en", None, "de", "und"][k % 5], *EXTRA) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, texts[6], "fr", *EXTRA)]


@pytest.mark.parametrize("least, share, top", [(30, 80, 2000), (3, 60, 25), (2, 101, 7), (10**6, 80, 5)])
def test_phrases(spark, least, share, top):
    rows = fixture()
    got = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(4), least, share, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([r[1:3] for r in rows], least, share, top)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def merged(batches, merge, key=lambda x: (x["block"], x["kind"], x["lang"].encode())):
    rows, out = sorted((x for b in batches for x in b.to_pylist()), key=key), []
    for i in range(0, len(rows), 5):
        out += merge.add(pa.RecordBatch.from_pylist(rows[i : i + 5], batches[0].schema))
    return [*out, *merge.merged()]


@pytest.mark.parametrize("shard, distinct, chunk, row, most, number, finer", [(1 << 20, 60_000, 1 << 18, 512, 1 << 20, 8, None), (40, 60_000, 11, 2, 3, 1, 4), (7, 9, 3, 1, 50, 16, 64), (1, 60_000, 1, 5, 1, 2, None)])
def test_shards_and_merges(monkeypatch, shard, distinct, chunk, row, most, number, finer):
    monkeypatch.setattr(C, "ROW", row)
    rows = [r[1:3] for r in fixture()]
    batches = []
    for part in (rows[::3], rows[1::3], rows[2::3]):
        own = C.Shard(number, shard, distinct, chunk)
        for text, lang in part:
            batches += own.add(lang or "und", (text or "").encode())
        batches += own.tries()
    if finer:
        coarse = {(x["lang"], x["block"]) for b in batches for x in b.to_pylist()}
        batches = merged(batches, C.Merge(2, most, finer))
        assert coarse == {(x["lang"], x["block"] * number // finer) for b in batches for x in b.to_pylist()}
    nodes = [x for b in merged(batches, C.Merge(2, most)) for x in b.to_pylist()]
    f, n = counted(rows)
    total = Counter()
    for x in nodes:
        if x["size"] == 0:
            total[x["lang"]] += x["a"]
    assert total == +n
    want = {(lang, " ".join(p)): (a, g[p[:2]] if len(p) > 2 else None, g[p[:3]] if len(p) > 3 else None) for lang, g in f.items() for p, a in g.items() if a > 1}
    phrases = [x for x in nodes if x["size"]]
    assert {(x["lang"], x["phrase"]): (x["a"], x["l2"], x["l3"]) for x in phrases} == want and len(phrases) == len(want)


def test_two_steps(spark, monkeypatch):
    """More blocks than one step deals out."""
    monkeypatch.setattr(C, "FINE", 4)
    monkeypatch.setattr(C, "TASK_BLOCKS", 2)
    monkeypatch.setattr(C, "BLOCK_BYTES", 1 << 9)
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    assert sorted(map(tuple, C.collocations(df, 3, 80, 50).collect())) == brute([r[1:3] for r in rows], 3, 80, 50)


def test_exact_beyond_64_bits(spark):
    a = 9 * 10**15
    df = spark.createDataFrame([(a, [a + 1, a], [a + 2, a + 5])], "a bigint, l array<bigint>, r array<bigint>")
    got = df.select(C._cut(df["a"], df["l"], df["r"]).alias("c")).select("c.*").first()
    assert tuple(got) == (*min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate([(a + 1, a + 2), (a, a + 5)])), a + 1, a + 2)
