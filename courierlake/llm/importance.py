"""Importance resampling: documents drawn by how much their hashed n-grams look like a target's.

Two passes in Arrow batches. The first counts hashed n-grams of corpus and target, np.bincount in every partition, and
treeReduce merges these vectors of fixed length, so the driver gets a few of them however many partitions there are.
The second gathers each n-gram's gain from the broadcast vector of gains (8 bytes a bucket) and sums them by document.
Drawing without replacement is a top k of weights with Gumbel noise, seeded by the id: noise falls alike in every run.

Ranks need no global sort: scores are whole thousandths of a logarithm, so distinct ones number some ten thousands
whatever the input; counts by score give the cut and every score's first rank, and only rows above the cut are numbered,
in a window for each score.

Memory of a task: the vectors, one text, the words of CHUNK bytes of it and about HELD buckets.

Defined cases: null texts have no words; an id may be null, which counts as empty in the noise, sorts first among equal
scores, and may repeat: rows of one id have equal noise; texts of any length are counted whole; without a target all
gains come from the corpus alone; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, stable_rows

BUCKETS = 10_000
#: Bytes of a text whose words are lists at one time.
CHUNK = 1 << 20
#: Features that are summed at one time.
HELD = 1 << 20
#: Letters A-Z in lower case, all ASCII but letters and digits as blanks.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Lists of the words of a text, cut at blanks about every CHUNK bytes."""
    at = 0
    while at < len(raw):
        end = at + CHUNK
        if end < len(raw):
            plain = raw[at:end].translate(_PLAIN)
            cut = plain.rfind(b" ")
            while cut < 0 and end < len(raw):  # a word of more than CHUNK bytes
                more = raw[end : end + CHUNK].translate(_PLAIN)
                cut = more.find(b" ")
                cut = cut if cut < 0 else cut + len(plain)
                plain, end = plain + more, end + CHUNK
            plain = plain if cut < 0 else plain[:cut]
        else:
            plain = raw[at:].translate(_PLAIN)
        at += max(1, len(plain))
        yield plain.split()


def hashed(raw: bytes, n: int = 1) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to n consecutive words of a text, in parts."""
    last: list[bytes] = []
    for words in _words(raw):
        yield np.fromiter(map(crc32, words), np.int64, len(words)) % BUCKETS
        for k in range(2, n + 1):
            # Runs that end in this part; the words before it are in last.
            row = last[len(last) - min(k - 1, len(last)) :] + words
            runs = [crc32(b" ".join(row[i : i + k])) for i in range(len(row) - k + 1)]
            yield np.array(runs, np.int64) % BUCKETS
        last = (last + words)[-(n - 1) :] if n > 1 else []


def _blocks(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch, and how many words and features each has here, and their buckets; about HELD features at a time."""
    rows, words, sizes, parts, held = [], [], [], [], 0
    for row, text in enumerate(column):
        for k, part in enumerate(hashed((text.as_py() or "").encode(), n)):
            rows.append(row)
            words.append(len(part) if k % n == 0 else 0)
            sizes.append(len(part))
            parts.append(part)
            held += len(part)
            if held >= HELD:
                yield np.repeat(rows, sizes), np.bincount(rows, words, len(column)).astype(np.int64), np.concatenate(parts)
                rows, words, sizes, parts, held = [], [], [], [], 0
    if rows:
        yield np.repeat(rows, sizes), np.bincount(rows, words, len(column)).astype(np.int64), np.concatenate(parts)


def bucket_counts(docs: DataFrame, target: DataFrame, text_col: str = "text", n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the corpus and in the target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            own = b.column(0).to_numpy()
            for rows, _, buckets in _blocks(b.column(1), n):
                held += np.bincount(own[rows] * BUCKETS + buckets, minlength=2 * BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["counts"])

    side = lambda df, own: df.select(F.lit(own).cast("bigint").alias("own"), F.col(text_col).alias("text"))
    vectors = side(docs, 0).unionByName(side(target, 1)).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    total = vectors.treeReduce(np.add, depth=3)
    return total[:BUCKETS], total[BUCKETS:]


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each count raised by one."""
    ratio = (target + 1.0) * (corpus.sum() + BUCKETS) / ((corpus + 1.0) * (target.sum() + BUCKETS))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 1) -> DataFrame:
    """id, words, n_features, weight: the floored mean of the gains of a document's features, 0 without any."""
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, gained = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for rows, own, buckets in _blocks(b.column(1), n):
                words += own
                features += np.bincount(rows, minlength=b.num_rows)
                # Sums of whole numbers below 2 ** 53: exact in doubles.
                gained += np.bincount(rows, sent.value[buckets], b.num_rows).astype(np.int64)
            weight = gained // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], ["id", "words", "n_features", "weight"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(weigh, f"id {kind}, words bigint, n_features bigint, weight bigint").withColumnRenamed("id", id_col)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, the same for an id in every run."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digest, 16, 10).cast("bigint") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(share)))


def drawn(scored: DataFrame, percent: int, least: int, id_col: str = "doc_id") -> DataFrame:
    """scored(id, words, n_features, weight, score) with rank: 1, 2, 3 by score, then id, for percent of the rows with enough words."""
    able = F.col("words") >= least
    counts = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    # One row for each score that occurs: the noise and the gains bound their number.
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = counts.select(F.col("score").alias("level"), above.alias("above"), wanted.alias("wanted")).where("above < wanted")
    levels = F.broadcast(levels)
    high = scored.where(able).join(levels, F.col("score") == F.col("level"))
    rank = F.col("above") + F.row_number().over(Window.partitionBy("level").orderBy(F.col(id_col).asc_nulls_first(), "n_features"))
    high = high.withColumn("rank", rank.cast("bigint"))
    high = high.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank"))).select(*scored.columns, "rank")
    low = scored.join(levels, able & (F.col("score") == F.col("level")), "left_anti")
    return high.unionByName(low.withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    percent of the documents with at least `least` words are drawn, rounded down.
    """
    kept = stable_rows(docs.select(docs[id_col], docs[text_col]), "resample-input")
    weights = importance_weights(kept, bucket_gains(*bucket_counts(kept, target, text_col, n)), id_col, text_col, n)
    return drawn(materialize(weights.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "weights"), percent, least, id_col)
