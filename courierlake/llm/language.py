"""Language identification as a mixture: each document's language proportions by expectation-maximisation.

Fitting: hashed 4-byte n-grams of the letters of a bounded sample of labelled documents, counted on the
executors, give one n-gram distribution per language. Prediction: with p_l(g) the likelihood of n-gram g under
language l, EM finds the proportions that maximise sum_g count(g) log sum_l pi_l p_l(g). Language sets grow
along the fitted proportions, one language at a time and up to all that were learned, as long as a larger set can
still be better; the set with the best penalised likelihood is selected (each further language costs
PENALTY * log(n-grams); overlapping n-grams count 1/4 each, for each byte takes part in four). The likelihood is
concave in the proportions, which bounds what is left to gain: EM of a set ends when that is small or the set
cannot be the best. The predicted language has the largest proportion in the selected set.

Bounds: SAMPLE_PER_LANGUAGE documents per language are fitted on, all of their text; a model holds BINS
numbers per language, so it and the sample grow with the number of languages, not with the documents. Every whole
document is predicted, in Arrow batches.

Defined cases: null texts and texts without a letter (digits, marks that combine with no letter) are `und` with
score 0, as is everything when there is nothing to learn from; rows with a null id, text or language are not
learned from; very long texts are taken whole; repeated rows get equal results; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_LANGUAGE = 2000
SAMPLE_PARTS = 50
BINS = 1 << 14
PENALTY = 2.0
#: Steps of EM between two looks at what is left to gain; they double up to MOST_STEPS.
EM_STEPS = 6
MOST_STEPS = 96
#: EM ends when a log likelihood is at most GAP + GAP_SHARE * n-grams below its maximum; rounding errors are far smaller.
GAP, GAP_SHARE = 0.1, 1e-5
#: n-grams (distinct, of a batch) that EM handles at once.
CHUNK_GRAMS = 60_000


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: BINS x languages: likelihoods.
    table: np.ndarray


def letters_only(text: Column) -> Column:
    """Lower case, every run of other characters as one blank; empty for null, and without a letter: marks alone are none."""
    kept = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))
    return F.when(F.rlike(kept, F.lit(r"\p{L}")), kept).otherwise(F.lit(""))


def _grams(raw: np.ndarray) -> np.ndarray:
    """Bins of the 4-byte n-grams of one text, edges marked by blanks."""
    padded = np.empty(len(raw) + 2, np.uint32)
    padded[0] = padded[-1] = 32
    padded[1:-1] = raw
    if len(padded) < 4:
        padded = np.concatenate([padded, np.full(4 - len(padded), 32, np.uint32)])
    word = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    return (word * np.uint32(2654435761)) >> np.uint32(18)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without copies."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield data[a:b]


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learns from the rows of docs with a language; the sample are the ids with the smallest hashes."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # Each of SAMPLE_PARTS parts of a language gives its share, so that a frequent language is not one task's work.
    known = known.withColumn("h", F.md5(F.col("id").cast("string").cast("binary"))).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(SAMPLE_PARTS)))
    chosen = known.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("n") <= max(1, sample_per_language // SAMPLE_PARTS))
    # At most sample_per_language narrow rows per language are broadcast to the scan of the texts.
    chosen = chosen.select("id", "lang").distinct()
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("lang", letters_only(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                if len(raw):
                    total.setdefault(lang, np.zeros(BINS, np.int64))[:] += np.bincount(_grams(raw), minlength=BINS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bin": at.astype(np.int32), "n": counts[at]})

    rows = sample.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((BINS, len(languages)))
    counts[rows["bin"].to_numpy(int), rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = rows["n"].to_numpy(float)
    counts += 0.5
    return LanguageModel(languages, (counts / counts.sum(0)).astype(np.float32) if languages else counts)


def _mix(likelihood: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over all documents of a chunk. likelihood: languages x n-grams; weights: languages x documents.

    Returns proportions, log likelihoods, and how far each of these is below the best possible at most: the
    likelihood is concave in the proportions, so the steepest direction bounds what is left to gain. Languages
    that start with weight 0 stay out.
    """
    total = np.add.reduceat(counts, starts, dtype=np.float64)
    free = weights > 0
    for step in range(steps + 1):
        mixed = np.zeros(likelihood.shape[1], np.float32)
        for p, w in zip(likelihood, weights, strict=True):
            mixed += p * np.repeat(w, sizes)
        pull = counts / mixed
        gain = np.stack([np.add.reduceat(p * pull, starts, dtype=np.float64) for p in likelihood])
        if step < steps:
            weights = (weights * gain / total).astype(np.float32)
    fit = np.add.reduceat(counts * np.log(mixed), starts, dtype=np.float64)
    return weights, fit, np.maximum(np.where(free, gain, 0).max(0) - total, 0)


def _settle(likelihood: np.ndarray, counts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_mix until each document's log likelihood is as good as its best, or that cannot exceed its limit."""
    weights, fit, short = weights.copy(), np.zeros(len(sizes)), np.zeros(len(sizes))
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(counts, starts, dtype=np.float64)
    left, steps = np.arange(len(sizes)), EM_STEPS
    while len(left):
        rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in left])
        few = sizes[left]
        weights[:, left], fit[left], short[left] = _mix(likelihood[:, rows], counts[rows], np.cumsum(few) - few, few, weights[:, left], steps)
        left = left[(short[left] > GAP + GAP_SHARE * total[left]) & (fit[left] + short[left] > limit[left])]
        steps = min(2 * steps, MOST_STEPS)
    return weights, fit, short


def infer_mixtures(model: LanguageModel, bins: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For documents given by distinct bins and their counts (none empty): proportions in the selected set, set sizes."""
    sizes, k = np.array([len(b) for b in bins]), len(model.languages)
    starts = np.cumsum(sizes) - sizes
    at, n = np.concatenate(bins), np.concatenate(counts).astype(np.float32)
    likelihood = np.stack([column[at] for column in np.ascontiguousarray(model.table.T)])
    cost = PENALTY * np.log(np.maximum(np.add.reduceat(n, starts), 2))
    single = np.stack([np.add.reduceat(n * np.log(p), starts, dtype=np.float64) for p in likelihood])
    first = single.argmax(0)
    chosen = np.zeros((k, len(bins)), np.float32)
    chosen[first, np.arange(len(bins))] = 1
    best, size = single.max(0) / 4 - cost, np.ones(len(bins), int)
    every, fit, short = _mix(likelihood, n, starts, sizes, np.full((k, len(bins)), 1 / k, np.float32), EM_STEPS)
    # Where even the best mixture of all languages does not pay for a second language, one language it is.
    open_ = np.flatnonzero((fit + short) / 4 - 2 * cost > best)
    if k > 1 and len(open_):
        rows = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in open_])
        some, weight, few = likelihood[:, rows], n[rows], sizes[open_]
        every, fit, short = _settle(some, weight, few, every[:, open_], 4 * (best[open_] + 2 * cost[open_]))
        order = np.argsort(-every, axis=0, kind="stable")
        most, begin = (fit + short) / 4, np.cumsum(few) - few
        for m in range(2, k + 1):
            # No set is more likely than the mixture of all languages.
            now = np.flatnonzero(most - m * cost[open_] > best[open_])
            if not len(now):
                break
            at, rows = open_[now], np.concatenate([np.arange(begin[i], begin[i] + few[i]) for i in now])
            mask = np.zeros((k, len(now)), np.float32)
            np.put_along_axis(mask, order[:m, now], 1.0, axis=0)
            start = every[:, now] * mask + mask * np.float32(1e-4)
            weights, fit, _ = _settle(some[:, rows], weight[rows], few[now], (start / start.sum(0)).astype(np.float32), 4 * (best[at] + m * cost[at]))
            value = fit / 4 - m * cost[at]
            better = value > best[at]
            best[at] = np.where(better, value, best[at])
            size[at] = np.where(better, m, size[at])
            chosen[:, at] = np.where(better, weights, chosen[:, at])
    return chosen.T, size


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, languages (array of struct(lang, proportion), largest first)."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    languages = np.array([*model.languages, "und"], object)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            proportions, sizes = np.zeros((n, max(1, len(model.languages)))), np.zeros(n, int)
            held, bins, counts, grams = [], [], [], 0

            def flush() -> None:
                if held:
                    proportions[held], sizes[held] = infer_mixtures(model, bins, counts)
                    held.clear(), bins.clear(), counts.clear()

            for i, raw in enumerate(_texts(b.column(1))):
                if len(raw) and model.languages:
                    seen = np.bincount(_grams(raw), minlength=BINS)
                    at = np.flatnonzero(seen)
                    held.append(i), bins.append(at), counts.append(seen[at])
                    grams += len(at)
                    if grams > CHUNK_GRAMS:
                        flush()
                        grams = 0
            flush()
            order = np.argsort(-proportions, axis=1, kind="stable")
            top = np.where(sizes > 0, order[:, 0], len(model.languages))
            score = np.where(sizes > 0, proportions[np.arange(n), order[:, 0]], 0.0)
            found = [[{"lang": languages[j], "proportion": float(proportions[i, j])} for j in order[i, : sizes[i]]] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(languages[top], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("proportion", pa.float64())])))],
                names=["doc", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col), letters_only(docs[text_col]).alias("text"))
    out = rows.mapInArrow(predict, f"doc {kind}, lang_pred string, score double, languages array<struct<lang:string,proportion:double>>")
    return out.withColumnRenamed("doc", id_col)
