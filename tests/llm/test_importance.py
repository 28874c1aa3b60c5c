"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from courierlake.llm import importance as I

SCHEMA = "doc_id bigint, text string, id string, words string, score string, rank string"
EXTRA = ("x",) * 4
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text, n):
    row = words(text)
    return [zlib.crc32(" ".join(row[i : i + k]).encode()) % I.BUCKETS for k in range(1, n + 1) for i in range(len(row) - k + 1)]


def brute(rows, target, percent, least, n=1):
    s = Counter(b for r in rows for b in features(r[1], n))
    t = Counter(b for x in target for b in features(x, n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + I.BUCKETS) / ((s[b] + 1) * (T + I.BUCKETS))))
    out = []
    for doc, text, *_ in rows:
        own = features(text, n)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words(text)), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def fixture():
    texts = [None, "", " .,; ", "One", "ÉÀ éà Straße 漢字 x1 1x", "the cat sat on the mat " * 9, "the cat sat on the mat " * 9, "w" * 50_000 + " tail", " ".join(f"w{k % 977}" for k in range(40_000))]
    texts += [" ".join(f"v{(k * k + j) % 89}" for j in range(15 + k)) for k in range(60)]
    rows = [(k, t, *EXTRA) for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[5], *EXTRA), (None, texts[20], *EXTRA)]


@pytest.mark.parametrize("percent, least, n", [(10, 20, 1), (100, 1, 1), (37, 20, 2), (0, 20, 1)])
def test_draw(spark, monkeypatch, percent, least, n):
    rows, target = fixture(), ["the mat", None, "v1 v2 v3 v4", "w1 w2"]
    got = I.resample(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), percent, least, n=n)
    assert got.columns == ["doc_id", "words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, percent, least, n)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(I, "CHUNK", 7)
    monkeypatch.setattr(I, "HELD", 5)
    for text in ("a bb ccc dddd eeeee ffffffffffffffffff g h", "", "   ", "x" * 40, "x" * 14 + " ", "a.b.c.d.e.f.g.h"):
        for n in (1, 2, 3):
            assert sorted(np.concatenate([[], *I.hashed(text.encode(), n)]).astype(int).tolist()) == sorted(features(text, n))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(fixture(), SCHEMA)
    assert I.resample(none, some).count() == 0
    got = sorted(map(tuple, I.resample(some, none.select("text")).collect()), key=str)
    assert got == brute(fixture(), [], 10, 20)
