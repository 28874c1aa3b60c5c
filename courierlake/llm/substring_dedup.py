"""Removal of repeated substrings by distributed prefix doubling.

A byte goes if a substring of LENGTH bytes that covers it also starts anywhere else. Substrings are named by
prefix doubling: the name of the 2h bytes at p is made of the names at p and p + h, from 8 bytes up to HALF and
then LENGTH = 2 * HALF. Spark sorts positions by name at growing lengths, reranks those that share a name and
drops those that have become unique:

1. Names of HALF bytes. Of all positions, those are sorted that some LENGTH-byte window chooses: the smallest
   name inside it (about 2 of HALF positions). Equal windows choose the same place in them, so a chosen
   position with a unique name rules out all windows that chose it. Positions that share a name and the whole
   stretch of their windows are settled for all these windows at once.
2. Names of CORE bytes. The windows of an open position that lie within STEP bytes share a core, the pair of
   names at its start and CORE - HALF further on; a unique core rules them out.
3. Names of LENGTH bytes - the pair of names at p and p + HALF - for the windows that are still open: they are
   sorted again; a shared name is a repeat, past the threshold.

Names are 64-bit fingerprints, so that no table of ranks has to travel: equal strings have equal names on
every executor. Each task first combines what it has: a name that it holds many times is sent on once, and its
positions are known to be shared. Frequent passages thus send one row for each task. The texts are shuffled
once, by document, for steps 2, 3 and the cut; all of it is one job that recovers from lost executors.

Defined cases: null text counts as empty; documents below LENGTH bytes keep everything; matches within one
document count, overlapping ones too; repeated rows are repeats of each other; ids may be null or repeated; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stable_rows

HALF = 100
LENGTH = 2 * HALF
STEP = 25
CORE = LENGTH - STEP
#: Bytes that the naming works on at once: its arrays stay in the cache.
CHUNK = 1 << 17
#: Bytes of the table for each partition of the shuffles.
PART_BYTES = 32 << 20
#: Positions that a task combines before it sends them.
HELD = 1_500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    z = a * _A
    z ^= z >> np.uint64(31)
    z += b
    z *= _B
    z ^= z >> np.uint64(29)
    z *= _C
    z ^= z >> np.uint64(32)
    return z


def half_names(x: np.ndarray) -> np.ndarray:
    """Names of the HALF bytes at each position that has as many."""
    x = np.ascontiguousarray(x)
    n = np.ndarray(len(x) - 7, "<u8", x, 0, (1,)).astype(np.uint64)
    n = _pair(n, n >> np.uint64(7))
    h = 8
    while 2 * h <= HALF:
        n, h = _pair(n[:-h], n[h:]), 2 * h
    return _pair(n[: len(n) - (HALF - h)], n[HALF - h :])


def full_names(half: np.ndarray) -> np.ndarray:
    return _pair(half[:-HALF], half[HALF:])


def core_names(half: np.ndarray) -> np.ndarray:
    return _pair(half[: -(CORE - HALF)], half[CORE - HALF :] + np.uint64(1))


def chosen_positions(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """For a text of at least LENGTH bytes: names, stretch names, first windows, window counts of chosen positions, and their distances from the first window."""
    half = half_names(x)
    full = full_names(half)
    # The smallest name, and the first place of it: both are the same in equal windows.
    low = (half & ~_PLACE) | np.arange(len(half), dtype=np.uint64)
    size = 1
    while 2 * size <= HALF + 1:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (HALF + 1 - size)], low[HALF + 1 - size :])
    place = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    at = place[first]
    shape = ((at - first).astype(np.uint64) << np.uint64(16)) | count.astype(np.uint64)
    stretch = _pair(_pair(full[first], full[first + count - 1]), shape)
    return half[at], stretch, first, count, at - first


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends and bytes of a binary column, without copies."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(len(column) + 1, np.int64)
    return ends, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys in a sorted array, and for each element the number of its run."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


# What a row says: the windows from `start` on, `count` of them, of document `uid` ...
OPEN, TWICE, NOTED, SHARED, PENDING = range(5)
# OPEN    ... have not been compared yet.
# TWICE   ... are shared or compared further already, but stand for their name to others.
# NOTED   ... will be compared further anyway; only says that the name exists at least twice.
# SHARED  ... are repeats.
# PENDING ... are to be compared further.
#
# start, count, the distance of the chosen position (not for SHARED rows, which may be long) and the kind share
# one number, so that rows stay short.
_FIRST = "key bigint, stretch bigint, uid bigint, at bigint"
_LATER = "key bigint, uid bigint, at bigint"


def _packed(start: np.ndarray, count: np.ndarray, off: np.ndarray | int, kind: int) -> np.ndarray:
    return start.astype(np.int64) << 32 | (count.astype(np.int64) | np.int64(0) + off << 8) << 3 | kind


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind, middle = at & 7, at >> 3 & (1 << 29) - 1
    return at >> 32, np.where(kind == SHARED, middle, middle & 255), np.where(kind == SHARED, 0, middle >> 8), kind


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(np.ascontiguousarray(c).view(np.int64)) for k, c in columns.items()})


def _spread(uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys for rows that are settled: anything that spreads them out."""
    return _pair(uid.astype(np.uint64), start.astype(np.uint64))


def _merged(uid: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining ranges of windows as one."""
    order = np.lexsort((start, uid))
    uid, start, count = uid[order], start[order], count[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] != start[:-1] + count[:-1])]))
    return uid[new], start[new], np.add.reduceat(count, new)


def combine_choices(key, stretch, uid, start, count, off) -> Iterator[pa.RecordBatch]:
    """What a task can say about its own chosen positions; names that it holds once are left OPEN."""
    order = np.lexsort((stretch, key))
    key, stretch, uid, start, count, off = (c[order] for c in (key, stretch, uid, start, count, off))
    heads, run = _runs(key)
    both, part = _runs(_pair(key, stretch))
    in_name, in_part = np.bincount(run), np.bincount(part)
    alone = in_name[run] == 1
    twice = in_part[part] > 1
    # A name with several stretches: every single stretch, and one of each shared one, is compared in step 2.
    parts_of = np.bincount(run[both])
    several = parts_of[run] > 1
    lead = np.zeros(len(key), bool)
    lead[both] = True
    pending = several & lead
    named = np.zeros(len(key), bool)
    named[heads] = True
    kinds = ((alone, OPEN), (twice & lead & ~several, TWICE), (named & several, NOTED))
    for mask, kind in kinds:
        if mask.any():
            yield _batch(key=key[mask], stretch=stretch[mask], uid=uid[mask], at=_packed(start[mask], count[mask], off[mask], kind))
    if twice.any():
        u, s, c = _merged(uid[twice], start[twice], count[twice])
        yield _batch(key=_spread(u, s), stretch=u, uid=u, at=_packed(s, c, 0, SHARED))
    if pending.any():
        u, s = uid[pending], start[pending]
        yield _batch(key=_spread(u, s), stretch=u, uid=u, at=_packed(s, count[pending], off[pending], PENDING))


def compare_choices(key, stretch, uid, at) -> Iterator[pa.RecordBatch]:
    """All rows of some names: settles shared stretches, keeps what has to be compared further, drops unique names."""
    start, count, off, kind = _unpacked(at)
    done = kind >= SHARED
    if done.any():
        yield _batch(uid=uid[done], at=at[done])
    key, stretch, uid, start, count, off, kind = (c[~done] for c in (key, stretch, uid, start, count, off, kind))
    if not len(key):
        return
    order = np.lexsort((kind, stretch, key))
    key, stretch, uid, start, count, off, kind = (c[order] for c in (key, stretch, uid, start, count, off, kind))
    _, run = _runs(key)
    # NOTED rows stand apart: their stretches are compared further, wherever they are.
    both, part = _runs(_pair(_pair(key, stretch), (kind == NOTED).astype(np.uint64)))
    weight = np.where(kind == OPEN, 1, 2)
    repeated = np.bincount(run, weight)[run] > 1
    shared = repeated & (np.bincount(part, weight)[part] > 1) & (kind != NOTED)
    several = np.bincount(run[both])[run] > 1
    lead = np.zeros(len(key), bool)
    lead[both] = True
    told = shared & (kind == OPEN)
    pending = repeated & several & (kind != NOTED) & (lead | ~shared)
    if told.any():
        u, s, c = _merged(uid[told], start[told], count[told])
        yield _batch(uid=u, at=_packed(s, c, 0, SHARED))
    if pending.any():
        yield _batch(uid=uid[pending], at=_packed(start[pending], count[pending], off[pending], PENDING))


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        uid = b.column(0).to_numpy(zero_copy_only=False)
        ends, data = _buffers(b.column(1))
        for i in np.flatnonzero(np.diff(ends) >= LENGTH):
            x = data[ends[i] : ends[i + 1]]
            for at in range(0, len(x) - LENGTH + 1, CHUNK):
                # Windows are dealt to chunks, so each is chosen for once; stretches may end at a chunk's edge.
                key, stretch, first, count, off = chosen_positions(x[at : at + CHUNK + LENGTH - 1])
                held.append((key, stretch, np.full(len(key), uid[i]), first + at, count, off))
                n += len(key)
            if n > HELD:
                yield from combine_choices(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield from combine_choices(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _gather(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate(c) for c in zip(*held, strict=True)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the rows of a partition; all rows of a name are in one partition."""
    if columns := _gather(batches):
        key, stretch, uid, at = columns
        yield from compare_choices(key.view(np.uint64), stretch.view(np.uint64), uid, at)


def _combined(key, uid, start, count, off, told: int) -> Iterator[pa.RecordBatch]:
    """Names a task holds once are left OPEN; of those it holds more often, one stands for all, and all are told."""
    order = np.argsort(key, kind="stable")
    key, uid, start, count, off = (c[order] for c in (key, uid, start, count, off))
    heads, run = _runs(key)
    many = np.bincount(run)[run] > 1
    lead = np.zeros(len(key), bool)
    lead[heads] = True
    for mask, kind in ((~many, OPEN), (many & lead, TWICE)):
        if mask.any():
            yield _batch(key=key[mask], uid=uid[mask], at=_packed(start[mask], count[mask], off[mask], kind))
    if many.any():
        u, s, c, o = (x[many] for x in (uid, start, count, off))
        if told == SHARED:
            u, s, c = _merged(u, s, c)
            o = 0
        yield _batch(key=_spread(u, s), uid=u, at=_packed(s, c, o, told))


def _open_ranges(b: pa.RecordBatch):
    """Settled rows of a batch of documents, and slices of its open ones: their uid, start, count, distance and first byte."""
    uid = b.column(0).to_numpy(zero_copy_only=False)
    ends, data = _buffers(b.column(1))
    cuts = b.column(2).offsets.to_numpy()
    at = b.column(2).values.to_numpy(zero_copy_only=False)[cuts[0] : cuts[-1]]
    of = np.repeat(np.arange(len(uid)), np.diff(cuts))
    start, count, off, kind = _unpacked(at)
    settled, slices = kind == SHARED, []
    todo = np.flatnonzero(~settled)
    # In slices, so that the arrays of the naming stay small.
    for lo in range(0, len(todo), 1000):
        rows = todo[lo : lo + 1000]
        slices.append((uid[of[rows]], start[rows], count[rows], off[rows], ends[of[rows]] + start[rows]))
    return (uid[of[settled]], start[settled], count[settled]), slices, data


def _each(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the given sizes, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _further(named, told: int):
    """A step of the doubling: named() gives key, uid, start, count and distance of what open rows become."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            settled, slices, data = _open_ranges(b)
            if len(settled[0]):
                u, s, c = _merged(*settled)
                yield _batch(key=_spread(u, s), uid=u, at=_packed(s, c, 0, SHARED))
            for one in slices:
                held.append(named(data, *one))
                n += len(held[-1][0])
                if n > HELD:
                    yield from _combined(*(np.concatenate(c) for c in zip(*held, strict=True)), told)
                    held, n = [], 0
        if held:
            yield from _combined(*(np.concatenate(c) for c in zip(*held, strict=True)), told)

    return step


def _cores(data, uid, start, count, off, begin):
    """The windows of each chosen position by distance from it, STEP at a time, named by the core that they share."""
    sizes = count + LENGTH - 1
    names = core_names(half_names(data[_each(begin, sizes)]))
    base = np.cumsum(sizes) - sizes
    group = off // STEP - (off - count + 1) // STEP + 1
    row = np.repeat(np.arange(len(uid)), group)
    # Distances run from off down to off - count + 1; groups are cut at multiples of STEP.
    j = (off // STEP)[row] - (np.arange(len(row)) - np.repeat(np.cumsum(group) - group, group))
    high, low = np.minimum(off[row], STEP * j + STEP - 1), np.maximum((off - count + 1)[row], STEP * j)
    core = base[row] + off[row] - STEP * j
    return names[core], uid[row], start[row] + off[row] - high, high - low + 1, high


def _wholes(data, uid, start, count, off, begin):
    """Every window, named by all of its bytes."""
    sizes = count + LENGTH - 1
    names = full_names(half_names(data[_each(begin, sizes)]))
    place = _each(np.cumsum(sizes) - sizes, count)
    one = np.ones(len(place), np.int64)
    return names[place], np.repeat(uid, count), _each(start, count), one, one


def _settle(told: int):
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _gather(batches)
        if not columns:
            return
        key, uid, at = columns
        done = (at & 7) >= SHARED
        if done.any():
            yield _batch(uid=uid[done], at=at[done])
        key, uid, at = key[~done], uid[~done], at[~done]
        order = np.argsort(key, kind="stable")
        key, uid, at = key[order], uid[order], at[order]
        _, run = _runs(key)
        weight = np.where((at & 7) == TWICE, 2, 1)
        keep = (np.bincount(run, weight)[run] > 1) & ((at & 7) == OPEN) if len(key) else np.zeros(0, bool)
        if keep.any():
            start, count, off, _ = _unpacked(at[keep])
            u = uid[keep]
            if told == SHARED:
                u, start, count = _merged(u, start, count)
                off = 0
            yield _batch(uid=u, at=_packed(start, count, off, told))

    return settle


def removed_spans(size: int, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes covered by the windows from start on, count of them: an array of (begin, end)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + count - 1 + LENGTH, -1)
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    return turns.reshape(-1, 2)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, spans (array of struct(begin, end) of removed bytes), kept (binary)."""
    spark = docs.sparkSession
    docs = stable_rows(docs, "documents")
    # Each partition is sorted in one piece: their number follows the size of the table, known of files, as docs are by now.
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Plans that do not know it say an absurd size.
    known = size if size < 1 << 60 else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known // PART_BYTES)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("body"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                ends, data = _buffers(b.column(1))
                spans, kept = [], []
                for i, found in enumerate(b.column(2)):
                    body = data[ends[i] : ends[i + 1]]
                    if not found.is_valid or not len(found.values):
                        spans.append([])
                        kept.append(body.tobytes())
                        continue
                    cuts = removed_spans(len(body), *_unpacked(found.values.to_numpy(zero_copy_only=False))[:2])
                    spans.append([{"begin": int(x), "end": int(y)} for x, y in cuts])
                    keep = np.ones(len(body), bool)
                    for x, y in cuts:
                        keep[x:y] = False
                    kept.append(body[keep].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(ends)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"]
                )

    def of_document(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "uid").groupBy("uid").agg(F.collect_list("at").alias("rows")).withColumnRenamed("uid", "uid_")

    dealt = texts.repartition(parts, "uid")

    def with_text(rows: DataFrame) -> DataFrame:
        # All joins read the same exchange of the texts; the id goes along so that they are the same plan.
        joined = dealt.hint("shuffle_hash").join(of_document(rows).hint("shuffle_hash"), F.col("uid") == F.col("uid_"), "inner")
        return joined.select("uid", "body", "rows", "id")

    # Step 1.
    chosen = texts.select("uid", "body").mapInArrow(_choose, _FIRST).repartition(parts, "key").mapInArrow(_compare, "uid bigint, at bigint")
    # Step 2.
    cores = with_text(chosen).mapInArrow(_further(_cores, PENDING), _LATER).repartition(parts, "key").mapInArrow(_settle(PENDING), "uid bigint, at bigint")
    # Step 3.
    settled = with_text(cores).mapInArrow(_further(_wholes, SHARED), _LATER).repartition(parts, "key").mapInArrow(_settle(SHARED), "uid bigint, at bigint")
    repeats = of_document(settled).withColumnRenamed("rows", "repeats")
    # The cut.
    joined = dealt.join(repeats.hint("shuffle_hash"), F.col("uid") == F.col("uid_"), "left")
    out = joined.select("id", "body", "repeats").mapInArrow(cut, f"id {kind}, n_bytes bigint, spans array<struct<begin:int,end:int>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def span_digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of what remove_repeats() gives."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["begin"]).cast("long"))
    return cut.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


