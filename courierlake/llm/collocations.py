"""Phrases whose words go together more often than their parts do, by depth-limited count tries.

Every task turns its texts into tries of depth MAX_WORDS, one for each language and shard of SHARD words: each start
of a phrase is a path, equal paths are counted. A trie is written sorted and front-coded, cut into blocks by ranges of
the hash of a path's first two words, as many as the size of the input asks for, so that no block grows with it. Spark
deals the rows out by block, and tasks merge the runs that many shards have of it: there, a walk along the sorted paths
sums every node's count and knows the counts of its ancestors, which are the left parts of a phrase. Nodes seen often
enough are kept; no other can be a part of a candidate. Right parts come by suffix links: each node is joined with that
of its words but the first, which already knows its own right parts. Beyond FINE * FINE blocks, shards are cut by coarse
ranges first; tasks merge some shards of one and cut what they get by the fine ranges, so that rows stay long.

Memory of a task: SHARD words as numbers and their words, or about MERGED paths to be merged; the distinct paths of one
block; one text, split in parts of CHUNK bytes. Nothing reaches the driver.

Defined cases: null texts are empty, null languages count as `und`; texts of any length are read whole; equal rows count
each; ties are broken by the phrase's bytes; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, stable_rows, text_or_empty

MAX_WORDS = 4
#: Words of a shard, distinct words that end it, bytes of a text that are split at one time.
SHARD, DISTINCT, CHUNK = 1 << 20, 65_000, 1 << 18
#: Paths in a row, and paths that are merged at one time.
ROW, MERGED = 512, 1 << 19
#: Rows that are read at one time.
READ = 128
#: Bytes of input for a block, blocks for a task, and the root of the most blocks that a shard is cut into in one step.
BLOCK_BYTES, TASK_BLOCKS, FINE = 2 << 20, 8, 256
#: Salts for the first cut of a top list.
SALTS = 64
#: Kinds of rows: words by their own hash, paths by that of their first two words.
WORDS, PATHS = 0, 1
#: A-Z in lower case; what ends a piece as line feeds, tabs as blanks.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUNS = "lang string, kind int, block int, words binary, shape binary, more binary"
_NODES = "lang string, size int, phrase string, head string, rest string, a bigint, l2 bigint, l3 bigint"


class _Ids(dict):
    """Numbers of words, given as they come: 0 for nothing, 1 for the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(tokens: list[bytes], ids: _Ids) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))


def _distinct(columns: list[np.ndarray], counts: np.ndarray | None, bits: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of numbers below 1 << bits, sorted, each once, and how often it was there."""
    if sum(bits) <= 64:
        key = np.zeros(len(columns[0]), np.uint64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << np.uint64(b)) | c.astype(np.uint64)
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, counts = key[order], counts[order]
        first, total, out = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key), []
        key = key[first]
        for b in bits[::-1]:
            out.append((key & np.uint64((1 << b) - 1)).astype(np.int64))
            key = key >> np.uint64(b)
        columns = out[::-1]
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
        counts = None if counts is None else counts[order]
        columns, total = [c[first] for c in columns], len(order)
    if counts is None:
        return columns, np.diff(np.append(first, total))
    return columns, np.add.reduceat(counts, first)


def _blocks(path: np.ndarray, kind: int, hashes: np.ndarray, number: int) -> np.ndarray:
    """The range of each path: nested, where one number is a multiple of another."""
    first = hashes[path[:, 0]]
    mixed = first if kind == WORDS else (first * 31 + hashes[path[:, 1]]) * 2654435761 & 0xFFFFFFFF
    return mixed * number >> 32


class Shard:
    """Words of one task, by language, until they are enough for tries; `number`: of blocks."""

    def __init__(self, number: int, words: int = SHARD, distinct: int = DISTINCT, chunk: int = CHUNK):
        self.number, self.most, self.distinct, self.chunk = number, words, distinct, chunk
        self._clear()

    def _clear(self) -> None:
        self.ids, self.parts, self.held = _Ids(), {}, 0

    def add(self, lang: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        plain = raw.translate(_PLAIN).replace(b"\n", b" \n ")
        at = 0
        while at < len(plain):
            end = plain.find(b" ", at + self.chunk)
            end = len(plain) if end < 0 else end
            self._take(lang, _numbered(plain[at:end].split(b" "), self.ids))
            at = end
            if self.held >= self.most or len(self.ids) >= self.distinct:
                yield from self.tries(lang if at < len(plain) else None)
        self._take(lang, np.array([1]))

    def _take(self, lang: str, found: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append(found[found > 0])
        self.held += len(found)

    def tries(self, goes_on: str | None = None) -> Iterator[pa.RecordBatch]:
        """All tries, as rows. goes_on: the language whose last text has not ended; its last words start paths in the next shard."""
        words = list(self.ids)
        by = sorted(range(2, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[by] = np.arange(1, len(by) + 1)
        ranked = [b"", *[words[i] for i in by]]
        left = {}
        for lang, found in self.parts.items():
            row = np.concatenate(found)
            starts = len(row)
            if lang == goes_on:
                starts = max(0, starts - MAX_WORDS + 1)
                left[lang] = [words[i] for i in row[starts:]]
            yield from _trie(lang, rank[row], starts, ranked, self.number)
        self._clear()
        for lang, carried in left.items():
            self._take(lang, _numbered(carried, self.ids))


def _trie(lang: str, row: np.ndarray, starts: int, words: list[bytes], number: int) -> Iterator[pa.RecordBatch]:
    """The words and the trie of a sequence (0: the end of a piece)."""
    columns = [row[:starts]]
    for k in range(1, MAX_WORDS):
        later = np.zeros(starts, np.int64)
        rest = row[k : starts + k]
        later[: len(rest)] = rest
        columns.append(np.where(columns[-1] == 0, 0, later))
    there = columns[0] > 0
    columns = [c[there] for c in columns]
    if not len(columns[0]):
        return
    hashes = np.array([crc32(w) for w in words], np.int64)
    counts = np.bincount(columns[0], minlength=len(words))
    own = np.flatnonzero(counts)
    yield _rows(lang, WORDS, np.stack([own, *[np.zeros_like(own)] * (MAX_WORDS - 1)], axis=1), counts[own], words, hashes, number)
    columns, counts = _distinct(columns, None, [(len(words) - 1).bit_length()] * MAX_WORDS)
    # A word before the end of its piece is no path.
    there = columns[1] > 0
    if there.any():
        yield _rows(lang, PATHS, np.stack([c[there] for c in columns], axis=1), counts[there], words, hashes, number)


def _rows(lang: str, kind: int, path: np.ndarray, counts: np.ndarray, words: list[bytes], hashes: np.ndarray, number: int) -> pa.RecordBatch:
    """Sorted paths as rows of _RUNS: of each path the words that the one before it has not; depths and small counts in a byte."""
    block = _blocks(path, kind, hashes, number)
    order = np.argsort(block, kind="stable")
    path, counts, block = path[order], counts[order], block[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    # Long rows are cut.
    inside = np.arange(len(path)) - np.repeat(first, np.diff(np.append(first, len(path))))
    first = np.flatnonzero(inside % ROW == 0)
    n = (path > 0).sum(axis=1)
    shared = np.zeros(len(path), np.int64)
    shared[1:] = np.minimum(np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1), n[1:] - 1)
    shared[first] = 0
    written = (np.arange(MAX_WORDS) >= shared[:, None]) & (path > 0)
    tokens = [words[i] for i in path[written].tolist()]
    upto = np.append(0, np.cumsum(written.sum(axis=1)))
    shape = ((n - 1) | shared << 2 | np.minimum(counts, 15) << 4).astype(np.uint8)
    ends = np.append(first[1:], len(path))
    text = [b" ".join(tokens[a:b]) for a, b in zip(upto[first].tolist(), upto[ends].tolist(), strict=True)]
    slices = list(zip(first.tolist(), ends.tolist(), strict=True))
    large = counts >= 15
    more = [counts[a:b][large[a:b]].astype("<i8").tobytes() for a, b in slices]
    columns = [[lang] * len(first), [kind] * len(first), block[first], text, [shape[a:b].tobytes() for a, b in slices], more]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "kind", "block", "words", "shape", "more"])


class Merge:
    """Merges the runs of blocks; gives nodes of blocks that no later row continues, or their paths cut by `number` ranges."""

    def __init__(self, least: int, most: int = MERGED, number: int | None = None):
        self.least, self.most, self.number = least, most, number
        self.keys: list[tuple] = []
        self.ids, self.parts, self.held, self.room = _Ids(), [], 0, most

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, b.num_rows, READ):
            self._read(b.slice(at, READ))
            if self.held >= self.room:
                yield from self.merged(False)

    def _read(self, b: pa.RecordBatch) -> None:
        langs, kinds, blocks, texts, shapes, mores = (c.to_pylist() for c in b.columns)
        own = []
        for key in zip(langs, kinds, blocks, strict=True):
            if not self.keys or self.keys[-1] != key:
                self.keys.append(key)
            own.append(len(self.keys) - 1)
        sizes = [len(s) for s in shapes]
        shape = np.frombuffer(b"".join(shapes), np.uint8).astype(np.int64)
        n, shared, counts = (shape & 3) + 1, shape >> 2 & 3, shape >> 4
        counts[counts == 15] = np.frombuffer(b"".join(mores), "<i8")
        tokens = _numbered(b" ".join(texts).split(b" "), self.ids)
        offset = np.cumsum(n - shared) - (n - shared)
        at = np.arange(len(shape))
        columns = [np.repeat(np.array(own), sizes)]
        for level in range(MAX_WORDS):
            new = (shared <= level) & (level < n)
            value = np.zeros(len(shape), np.int64)
            value[new] = tokens[(offset + level - shared)[new]]
            value = value[np.maximum.accumulate(np.where(new, at, 0))]
            columns.append(np.where(level < n, value, 0))
        self.parts.append((columns, counts))
        self.held += len(shape)

    def merged(self, ended: bool = True) -> Iterator[pa.RecordBatch]:
        """All blocks but the last, which later rows may continue, unless all rows have ended or paths go on to finer ranges."""
        if not self.parts:
            return
        columns = [np.concatenate([p[0][k] for p in self.parts]) for k in range(MAX_WORDS + 1)]
        counts = np.concatenate([p[1] for p in self.parts])
        self.parts = []
        columns, counts = _distinct(columns, counts, [max(1, (len(self.keys) - 1).bit_length()), *[(len(self.ids) - 1).bit_length()] * MAX_WORDS])
        words = list(self.ids)
        upto = len(counts) if ended or self.number else int(np.searchsorted(columns[0], len(self.keys) - 1))
        if upto:
            done = [c[:upto] for c in columns]
            yield from self._told(done, counts[:upto], words) if self.number is None else self._cut(done, counts[:upto], words)
        # What is left of the last block starts anew, with numbers of its own.
        self.keys, self.ids = self.keys[-1:], _Ids()
        rest = [np.zeros(len(counts) - upto, np.int64)]
        for c in columns[1:]:
            used, back = np.unique(c[upto:], return_inverse=True)
            rest.append(np.array([self.ids[words[i]] for i in used.tolist()], np.int64)[back] if len(used) else used)
        self.parts = [(rest, counts[upto:])] if len(rest[0]) else []
        self.held = len(counts) - upto
        self.room = max(self.most, 2 * self.held)

    def _cut(self, columns: list[np.ndarray], counts: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        hashes = np.array([crc32(w) for w in words], np.int64)
        of = [self.keys[i][:2] for i in range(len(self.keys))]
        for lang, kind in dict.fromkeys(of):
            own = np.array([k == (lang, kind) for k in of])[columns[0]]
            if own.any():
                yield _rows(lang, kind, np.stack([c[own] for c in columns[1:]], axis=1), counts[own], words, hashes, self.number)

    def _told(self, columns: list[np.ndarray], counts: np.ndarray, words: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Rows of _NODES: a block's sum of words without a phrase, and the nodes met often enough."""
        key, *columns = columns
        kind = np.array([k[1] for k in self.keys])[key]
        new = np.zeros(len(counts), bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        rows = [[] for _ in range(8)]

        def tell(first, total, size, above):
            named = [self.keys[i][0] for i in key[first].tolist()]
            told = [[words[i].decode() for i in c[first].tolist()] for c in columns[:size]]
            phrases = [" ".join(x) for x in zip(*told, strict=True)] if size else [None] * len(named)
            rest = [" ".join(x) for x in zip(*told[1:], strict=True)] if size > 1 else [None] * len(named)
            for r, x in zip(rows, (named, [size] * len(named), phrases, told[0] if size else phrases, rest, total.tolist(), *above), strict=True):
                r += x

        first = np.flatnonzero(new)
        total = np.add.reduceat(counts, first)
        keep = kind[first] == WORDS
        none = lambda n: [None] * int(n)
        tell(first[keep], total[keep], 0, [none(keep.sum())] * 2)
        sums, group = [], []
        for level, c in enumerate(columns):
            new = new.copy()
            new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            total = np.add.reduceat(counts, first)
            sums.append(total)
            group.append(np.cumsum(new) - 1)
            keep = (c[first] > 0) & (total >= self.least) & (kind[first] == (PATHS if level else WORDS))
            first, total = first[keep], total[keep]
            # The counts of the ancestors on the path.
            tell(first, total, level + 1, [sums[k][group[k][first]].tolist() if k < level else none(len(first)) for k in (1, 2)])
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["lang", "size", "phrase", "head", "rest", "a", "l2", "l3"])


def frequent_nodes(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Nodes of all tries together that were met `least` times, with the counts of their ancestors from the second on.

    Rows of size 0 have parts of the number of all words of a language.
    """
    rows = stable_rows(docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), text_or_empty(docs[text_col]).alias("text")), "phrases-input")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    number = max(1, -(-size // BLOCK_BYTES))
    coarse = number
    if number > FINE * FINE:
        coarse = -(-number // FINE)
        number = coarse * FINE

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(coarse)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from shard.add(lang, text.as_py().encode())
        yield from shard.tries()

    def merge(finer: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            merged = Merge(least, number=finer)
            for b in batches:
                yield from merged.add(b)
            yield from merged.merged()

        return run

    runs = rows.mapInArrow(build, _RUNS)
    if coarse < number:
        # Several tasks to a coarse block, whatever shards their rows are of.
        dealt = runs.repartition(-(-number // TASK_BLOCKS), "block", F.pmod(F.xxhash64("words"), F.lit(FINE // TASK_BLOCKS)))
        runs = dealt.sortWithinPartitions("block", "kind", "lang").mapInArrow(merge(number), _RUNS)
    blocks = runs.repartitionById(-(-number // TASK_BLOCKS), F.expr(f"block div {TASK_BLOCKS}").cast("int")).sortWithinPartitions("block", "kind", "lang")
    return materialize(blocks.mapInArrow(merge(None), _NODES), "nodes")


def _parts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of each language; candidates (lang, size, phrase, a, lefts, rights by cut), right parts found along suffix links."""
    totals = nodes.where("size = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = nodes.where("size = 1")
    first = frequent.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l1"))
    linked = frequent.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r1"), F.array().cast("array<bigint>").alias("further"))
    found = None
    for size in range(2, MAX_WORDS + 1):
        level = nodes.where(F.col("size") == size).join(first, ["lang", "head"]).join(linked, ["lang", "rest"])
        lefts = F.array(*[F.col(f"l{k}") for k in range(1, size)])
        level = level.select("lang", "size", "phrase", "a", lefts.alias("lefts"), F.concat(F.array("r1"), "further").alias("rights"))
        level = materialize(level, f"phrases{size}")
        linked = level.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r1"), F.col("rights").alias("further"))
        found = level if found is None else found.unionByName(level)
    return totals, found


def _cut(a: Column, lefts: Column, rights: Column) -> Column:
    """The cut with the lowest score: struct(score, k, l, r)."""
    exact = lambda c: c.cast("decimal(19,0)")

    def at(x: Column, k: Column) -> Column:
        left, right = x["0"], x["1"]
        return F.struct(F.call_function("div", exact(a) * 2_000_000, exact(left) + exact(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.zip_with(lefts, rights, lambda x, y: F.struct(x.alias("0"), y.alias("1"))), at))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to MAX_WORDS words.

    least: occurrences of a candidate. share: percent of a phrase's occurrences that a longer one must have to stand for it.
    """
    totals, found = _parts(frequent_nodes(docs, least, text_col, lang_col))
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = found.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share))
    scored = own.select("lang", "phrase", "a", _cut(F.col("a"), F.col("lefts"), F.col("rights")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # One language may have most phrases: the best of each salt first, then the best of these.
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    few = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", best("lang", "salt")).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = few.withColumn("rank", best("lang").cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
