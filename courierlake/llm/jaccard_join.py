"""Similarity join on word n-grams: rare-first prefixes, length, positional and suffix filters.

1. Blocks of documents give their distinct shingles, as tokens of 48 bits, to buckets. Each bucket knows how often
   its tokens occur and tells each block the counts of those that occur more than once. Tokens that one block
   alone holds HOT times or more are noted once for each block and rank behind all others, so a frequent passage
   costs one note for each block.
2. Ordered by count, rarest first, a document's prefix are its first n - ceil(0.75 n) + 1 tokens. Tokens that
   occur nowhere else come first and match nothing: most documents have no further token in their prefix, and no
   partner. The others are grouped into classes of equal shingle sets, by 128 bits over the whole hashes.
3. Classes meet on prefix tokens. Candidates pass the length filter, the positional filter and the suffix filter
   (tokens fall into SUFFIX_PARTS ranges, in each of which no more can be shared than the poorer side has), and
   are verified once, on the n-grams of the two texts themselves.

Shingles that share a token are told apart where it counts: a document's tokens are a multiset, one for each
distinct shingle (64 bits, from a sum of pseudo-random numbers by byte and place, mixed over the words), so that
prefixes miss no pair, and verification compares words. A link never rests on a hash.

All links count towards components, but pairs inside a component need no verification: in LEADER_ROUNDS
rounds, every prefix token's classes are compared with one of them - one with few shingles of its own, as the
original of a group of copies has - and components are formed; then the pairs that still lie in different
components are compared, all of them. A group of n near copies thus costs about n comparisons, without a cap:
what the leaders do not settle is compared in full. Tokens and leaders that many rows share are split over tasks.

Defined cases: null and blank texts have the empty set and link with nothing; texts with fewer words than a
shingle have one shingle, the whole sequence; repeated rows are equal sets and link; ids may be null (they
come last when the smallest id names a component); very long texts are taken whole, each by one task; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, join_weighed, materialize, stable_rows

SIZE = 5
HOT = 64
#: Shingles of a block, about; and of a bucket.
BLOCK_SHINGLES = 2_000_000
BUCKET_SHINGLES = 3_000_000
#: Documents whose prefixes are Python objects at once: one for each of some hundred tokens.
DOCUMENTS = 250
LEADER_ROUNDS = 3
#: So many ids, counted first, are broadcast to a scan (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Rows of one token, or pairs of one leader, that a task takes before they are split.
SPLIT = 256
SUFFIX_PARTS = 16
#: Bytes of text hashed at once, which take about forty times as much memory.
_CHUNK = 1 << 18
_MASK = np.uint64((1 << 48) - 1)
_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Pseudo-random numbers by place in a word and byte, for the first places.
_PLACES = 32
_NUMBERS = _mix(np.arange(_PLACES * 256, dtype=np.uint64) * _R + _M2)


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    at = (place << 8) + byte
    if not len(at) or place.max() < _PLACES:
        return _NUMBERS[at]
    return np.where(place < _PLACES, _NUMBERS[np.minimum(at, len(_NUMBERS) - 1)], _mix(at.astype(np.uint64) * _R + _M2))


def shingle_hashes(x: np.ndarray, ends: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in one byte array, given by their ends (len + 1): shingle hashes and the text each is of, repeats included."""
    n = len(x)
    capital = (x >= 65) & (x <= 90)
    x = np.where(capital, x + np.uint8(32), x)
    blank = (x == 32) | ((x >= 9) & (x <= 13))
    inside = np.concatenate([[False], ~blank, [False]])
    # Texts are apart even where no blank is between them.
    start = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edges = ends[(ends > 0) & (ends < n)]
    start[edges] = ~blank[edges]
    stop[edges - 1] = ~blank[edges - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = e - s
    begin = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    words = _mix(np.add.reduceat(_numbers(place, x[~blank]), begin) + lengths.astype(np.uint64))
    of = np.searchsorted(ends, s, side="right") - 1
    count = np.bincount(of, minlength=len(ends) - 1)
    first = np.cumsum(count) - count
    left = first[of] + count[of] - np.arange(len(s))
    # Shingle at word i: its words, each with a factor of its place; shorter texts have one shingle.
    h = np.zeros(len(s), np.uint64)
    for k in range(size):
        part = words[k:] * np.uint64(2 * (k + 1) * 0x51ED270B + 1)
        ok = left[: len(part)] > k
        h[: len(part)][ok] += _mix(part[ok] + np.uint64(k))
    short = count[of] < size
    h = _mix(h + np.where(short, count[of], size).astype(np.uint64))
    keep = (left >= size) | (short & (left == count[of]))
    return h[keep], of[keep]


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# Rows between blocks and buckets. HEADER: a block's documents; ASK: tokens for a bucket; ANSWER: their counts.
HEADER, ASK, ANSWER = range(3)
_ROW = "block bigint, bucket int, kind int, docs binary, counts binary, shingles binary, numbers binary"


def _row(block, bucket, kind, docs, counts, shingles, numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "kind": pa.array([kind], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in (("docs", docs), ("counts", counts), ("shingles", shingles), ("numbers", numbers))}}
    )


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(len(column) + 1, np.int64)
    return ends, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _runs(of: np.ndarray, documents: int) -> np.ndarray:
    return np.bincount(of, minlength=documents).astype("<i4")


def set_sums(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128 bits for each document, from its distinct shingles in any order; n of them each, one document after the other."""
    at = np.cumsum(n) - n
    sums = np.zeros((2, len(n)), np.uint64)
    full = n > 0
    for row, seed in zip(sums, (_M1, _M2), strict=True):
        row[full] = _mix(np.add.reduceat(_mix(h ^ seed), at[full]) if full.any() else sums[0, :0]) + n[full].astype(np.uint64)
    return sums


def frequent_values(h: np.ndarray, least: int) -> np.ndarray:
    """The values that h holds so many times or more, in order."""
    s = np.sort(h)
    return np.unique(s[least - 1 :][s[least - 1 :] == s[: max(len(s) - least + 1, 0)]])


def among(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of h are among values, which are in order."""
    out = np.zeros(len(h), bool)
    for lo in range(0, len(h) if len(values) else 0, _CHUNK):
        part = h[lo : lo + _CHUNK]
        out[lo : lo + _CHUNK] = values[np.minimum(np.searchsorted(values, part), len(values) - 1)] == part
    return out


def _blocks(buckets: int, size: int, frequent: int):
    """Reads documents, sends each block's shingles to the buckets and keeps a header with the set sizes."""

    def send(uid: np.ndarray, n: np.ndarray, sums: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = int(uid[0])
        of = np.repeat(np.arange(len(uid), dtype=np.int32), n)
        notes = frequent_values(h, frequent)
        hot = among(h, notes)
        yield _row(block, -1, HEADER, uid.astype("<i8").tobytes(), np.concatenate([n.astype("<i4"), _runs(of[hot], len(uid))]).tobytes(), _pack48(h[hot]), sums.astype("<u8").tobytes())
        place = np.empty(len(h), np.int32)
        np.remainder(h, np.uint64(buckets), out=place, casting="unsafe")
        place[hot] = -1
        cuts = np.cumsum(np.bincount(place + 1, minlength=buckets + 1))
        order = np.argsort(place, kind="stable")
        del hot, place
        for k in range(buckets):
            at = order[cuts[k] : cuts[k + 1]]
            mine = notes[notes % np.uint64(buckets) == k]
            if len(at) or len(mine):
                docs, counts = np.unique(of[at], return_counts=True)
                yield _row(block, k, ASK, docs.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), _pack48(h[at]), _pack48(mine))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids, set sizes, sums and tokens: the texts follow each other, so sizes tell which text a token is of.
        held, total = [], 0

        def together() -> list[np.ndarray]:
            columns = [np.concatenate(c, axis=-1) for c in zip(*held, strict=True)]
            held.clear()
            return columns

        for b in batches:
            uid = b.column(0).to_numpy(zero_copy_only=False)
            ends, data = _texts(b.column(1))
            lo = 0
            while lo < len(uid):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _CHUNK, side="right")) - 1)
                hi = min(hi, len(uid))
                h, of = shingle_hashes(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], size)
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
                h, n = h[new], np.bincount(of[new], minlength=hi - lo)
                held.append((uid[lo:hi], n, set_sums(h, n), h & _MASK))
                total += len(h)
                lo = hi
                if total >= BLOCK_SHINGLES:
                    yield from send(*together())
                    total = 0
        if held:
            yield from send(*together())

    return blocks


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, one after the other: frequencies of their shingles, for the blocks that asked."""
    asks: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == HEADER:
                yield _row(*(r[c] for c in ("block", "bucket", "kind", "docs", "counts", "shingles", "numbers")))
            else:
                asks.setdefault(r["bucket"], []).append(r)
    for bucket in sorted(asks):
        rows = sorted(asks.pop(bucket), key=lambda r: r["block"])
        h = np.concatenate([_unpack48(r["shingles"]) for r in rows])
        hot = np.unique(np.concatenate([_unpack48(r["numbers"]) for r in rows]))
        h.sort()
        # The tokens that occur more than once or are noted, and how often they do; all others occur once.
        known = np.union1d(frequent_values(h, 2), hot)
        frequency = np.searchsorted(h, known, side="right") - np.searchsorted(h, known)
        frequency[among(known, hot)] = (1 << 31) - 1
        del h
        for r in rows:
            mine = _unpack48(r["shingles"])
            keep = among(mine, known)
            if keep.any():
                docs = np.repeat(np.frombuffer(r["docs"], "<i4"), np.frombuffer(r["counts"], "<i4"))[keep]
                docs, counts = np.unique(docs, return_counts=True)
                f = frequency[np.searchsorted(known, mine[keep])]
                yield _row(r["block"], bucket, ANSWER, docs.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), _pack48(mine[keep]), f.astype("<i4").tobytes())


_DOC = "uid bigint, n int, key binary, known int, prefix array<struct<token:bigint,place:int>>, parts array<int>"


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _prefixes(percent: int):
    """Blocks with their answers, rows of a block in a row: set sizes, and prefixes where partners are possible."""

    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        head = next(r for r in rows if r["kind"] == HEADER)
        uid = np.frombuffer(head["docs"], "<i8")
        sums = np.ascontiguousarray(np.frombuffer(head["numbers"], "<u8").reshape(2, -1).T)
        numbers = np.frombuffer(head["counts"], "<i4")
        n, hot_runs = numbers[: len(uid)].astype(np.int64), numbers[len(uid) :]
        answers = [r for r in rows if r["kind"] == ANSWER]
        h = np.concatenate([_unpack48(head["shingles"])] + [_unpack48(r["shingles"]) for r in answers])
        of = np.concatenate([np.repeat(np.arange(len(uid), dtype=np.int32), hot_runs)] + [np.repeat(np.frombuffer(r["docs"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in answers])
        f = np.concatenate([np.full(len(head["shingles"]) // 6, (1 << 31) - 1, np.int32)] + [np.frombuffer(r["numbers"], "<i4") for r in answers])
        known = np.bincount(of, minlength=len(uid))
        inside = prefix_length(n, percent) - (n - known)
        maybe = (inside > 0) & (n > 0)
        keep = maybe[of]
        h, of, f = h[keep], of[keep], f[keep]
        order = np.lexsort((h, f, of))
        h, of = h[order], of[order]
        del order, f, keep
        cuts = np.searchsorted(of, np.arange(len(uid) + 1))
        for lo in range(0, len(uid), DOCUMENTS):
            out = []
            for i in range(lo, min(lo + DOCUMENTS, len(uid))):
                if not maybe[i]:
                    out.append((int(uid[i]), int(n[i]), None, None, None, None))
                    continue
                items = h[cuts[i] : cuts[i + 1]]
                parts = np.bincount((items >> np.uint64(44)).astype(np.int64), minlength=SUFFIX_PARTS)
                first = items[: inside[i]]
                # Of equal tokens the first stands for all.
                new = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                out.append((int(uid[i]), int(n[i]), sums[i].tobytes(), len(items), [{"token": int(first[k]), "place": k} for k in new.tolist()], parts.tolist()))
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int32())])), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["uid", "n", "key", "known", "prefix", "parts"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if rows and rows[0]["block"] != r["block"]:
                    yield from finish(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield from finish(rows)

    return prefixes


def ngrams(body: bytes, size: int = SIZE) -> set[tuple[bytes, ...]]:
    """The set of a text as words: its distinct n-grams, or the whole sequence if it is shorter."""
    words = body.translate(_LOWER).split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def _verify(percent: int, size: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead = None, None
        for b in batches:
            keep = []
            for member, leader, x, y in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                # Rows of one leader stand together.
                if held != leader:
                    held, lead = leader, ngrams(y.as_py(), size)
                own = ngrams(x.as_py(), size)
                both = len(own & lead)
                keep.append(100 * both >= percent * (len(own) + len(lead) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return verify


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _verified(passed: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame | None:
    """pairs(a, b) with linked, from the texts of both, None if there are no pairs; b may be in many pairs, which are split over tasks."""
    passed = materialize(passed, "passed")
    if passed.isEmpty():
        return None
    named = materialize(passed.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "pairids")
    bodies = materialize(texts.join(_few(named), "uid", "left_semi"), "bodies")
    # At most one leader for each SPLIT pairs.
    often = passed.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("splits")).where("splits > 1")
    often = materialize(often, "often")
    pairs = passed.join(_few(often), "b", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("a"), F.col("splits")), F.lit(0)))
    pairs = pairs.select("a", "b", "salt").join(bodies.withColumnsRenamed({"uid": "a", "body": "x"}), "a")
    leaders = pairs.select("b", "salt").distinct().join(bodies.withColumnsRenamed({"uid": "b", "body": "y"}), "b")
    whole = pairs.join(leaders.hint("merge"), ["b", "salt"]).select("a", "b", "x", "y")
    tried = materialize(whole.mapInArrow(_verify(percent, size), "a bigint, b bigint, linked boolean"), "verified")
    discard(passed, named, often, bodies)
    return tried


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = 75, frequent: int = HOT) -> DataFrame:
    """One row per document: id, n_shingles, class_id (equal sets share it; null: no possible partner), component_id."""
    spark = docs.sparkSession
    docs = stable_rows(docs, "documents")
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    total, length = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, length // (6 * BUCKET_SHINGLES), 1)

    texts = numbered.select("uid", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    asked = texts.mapInArrow(_blocks(buckets, size, frequent), _ROW)
    # Headers have a bucket of their own each, by block, so that they are dealt out.
    counted = asked.repartition(buckets, F.when(F.col("kind") == HEADER, F.col("block")).otherwise(F.col("bucket").cast("bigint"))).mapInArrow(_count, _ROW)
    answered = counted.repartition(buckets, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(_prefixes(percent), _DOC)
    answered = materialize(answered, "shingled")

    # A class has the name of one of its documents, whose text stands for all.
    members = answered.where("key is not null").groupBy("key").agg(
        F.min("uid").alias("cls"), F.count(F.lit(1)).alias("members"), *[F.any_value(c).alias(c) for c in ("n", "known", "parts", "prefix")]
    )
    classes = materialize(members, "classes")
    tokens = classes.select("cls", "n", "known", F.explode("prefix").alias("t")).select("cls", "n", "known", "t.token", "t.place").withColumn("comp", F.col("cls"))
    tokens = materialize(tokens, "tokens")

    def possible(one: str, other: str) -> Column:
        """Length and positional filter of two rows of one token."""
        n, m, known, known_too = (F.col(f"{x}.{c}") for c in ("n", "known") for x in (one, other))
        i, j = (F.col(f"{x}.place") for x in (one, other))
        # What precedes the token in both, and the token and what follows it.
        most = F.least(i, j) + F.least(known - i, known_too - j)
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (most * (100 + percent) >= (n + m) * percent)

    def similar_parts(one: Column, other: Column, n: Column, m: Column) -> Column:
        """Suffix filter: what the ranges of the tokens can share at most."""
        most = F.aggregate(F.zip_with(one, other, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        return most * (100 + percent) >= (n + m) * percent

    def untried(pairs: DataFrame) -> DataFrame:
        if links is None:
            return pairs
        seen = links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        return pairs.join(seen, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")

    links = found = None
    for turn in range(LEADER_ROUNDS + 1):
        # Tokens whose classes are in one component have nothing left to settle; they do not come back.
        own = F.struct(F.floor((F.col("n") - F.col("known")) * 20 / F.col("n")), F.xxhash64("cls", F.lit(turn)), F.col("cls"))
        lead = F.min_by(F.struct("cls", "n", "known", "place", "comp"), own)
        about = tokens.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("shared"), lead.alias("lead"))
        about = materialize(about.where("c0 <> c1").drop("c0", "c1"), "about")
        if about.isEmpty():
            break
        open_tokens = materialize(join_weighed(tokens, about, "token", "rows", tokens.count(), "inner"), "open")
        discard(tokens, about)
        if turn < LEADER_ROUNDS:
            rows = open_tokens.alias("l").where(F.col("lead.comp") != F.col("comp")).where(possible("l", "lead"))
            passed = pairs = materialize(rows.select(F.col("cls").alias("a"), F.col("lead.cls").alias("b")).distinct(), "pairs")
            parts = classes.select("cls", "parts", "n")
            # A class has few leaders, a leader many classes.
            passed = passed.join(parts.withColumnsRenamed({"cls": "a", "parts": "pa", "n": "na"}), "a")
            leads = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("pairs")).join(parts.withColumnsRenamed({"cls": "b", "parts": "pb", "n": "nb"}), "b")
            passed = join_weighed(passed, leads, "b", "pairs", pairs.count(), "inner")
            passed = passed.where(similar_parts(*map(F.col, ("pa", "pb", "na", "nb")))).select("a", "b")
        else:
            # All bounds are part of the join, which makes no row that they exclude; and of the tokens that two classes
            # share, the first one makes the row: before it, nothing is shared. Tokens that two components share are
            # all still open. Rows of a frequent token are split: one side takes a part, the other all of them.
            lists = open_tokens.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("own"))
            lists = lists.select("cls", F.transform("own", lambda t: t["token"]).alias("tokens"))
            left = open_tokens.drop("lead").join(classes.select("cls", "parts"), "cls").join(lists, "cls").withColumn("splits", F.ceil(F.col("shared") / SPLIT).cast("int"))
            left = pairs = materialize(left, "sketched")
            l = left.withColumn("salt", F.pmod(F.hash("cls"), F.col("splits"))).alias("l")
            r = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).alias("r")
            larger = (F.col("l.n") > F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.cls") > F.col("r.cls")))
            rest = F.least(F.col("l.known") - F.col("l.place"), F.col("r.known") - F.col("r.place"))
            enough = rest * (100 + percent) >= (F.col("l.n") + F.col("r.n")) * percent
            first = F.get(F.array_intersect("l.tokens", "r.tokens"), F.lit(0)) == F.col("l.token")
            bounds = (F.col("l.comp") != F.col("r.comp")) & larger & possible("l", "r") & enough & similar_parts(*(F.col(c) for c in ("l.parts", "r.parts", "l.n", "r.n"))) & first
            passed = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.salt") == F.col("r.salt")) & bounds)
            passed = passed.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b"))
        tried = _verified(untried(passed), texts, percent, size)
        tokens = open_tokens.select("cls", "n", "known", "token", "place", "comp")
        if tried is not None:
            links = tried if links is None else links.unionByName(tried)
            if not tried.where("linked").isEmpty():
                found = materialize(connected_components(links.where("linked")).withColumnRenamed("node", "cls"), "comps")
                tokens = tokens.drop("comp").join(_few(found), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        if turn < LEADER_ROUNDS:
            tokens = materialize(tokens, "tokens")
        discard(open_tokens, pairs)

    ids = numbered.select("uid", "id")
    named = materialize(ids.join(answered.select("uid", F.col("n").cast("long").alias("n_shingles"), "key"), "uid"), "named")
    by_class = named.where("key is not null").groupBy("key").agg(F.min("id").alias("low"))
    by_class = by_class.join(classes.select("key", "cls", "members"), "key")
    by_class = by_class.join(found, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")) if found is not None else by_class.withColumn("comp", F.col("cls"))
    by_class = materialize(by_class, "byclass")
    by_comp = by_class.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    outcome = join_weighed(by_class, by_comp, "comp", "classes", total).select("key", "members", F.col("cls").alias("class_id"), "component_id")
    outcome = materialize(outcome, "outcome")
    done = join_weighed(named.where("key is not null"), outcome, "key", "members", total)
    alone = named.where("key is null").withColumns({"component_id": F.col("id"), "class_id": F.lit(None).cast("bigint")})
    columns = [F.col("id").alias(id_col), "n_shingles", "class_id", "component_id"]
    return done.select(*columns).unionByName(alone.select(*columns))
