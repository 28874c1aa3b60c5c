"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: relative weights in equal phases of training, normalised to mean 1,
so that the schedule integrates to the source's weight. Targets share the corpus size by weight, stop at
`cap` times the source's size, and the excess is shared again by weight until no source is above. A source's
documents form a stream in an order fixed by the MD5 of their ids, repeated as often as the target asks and
cut at the word where the demand ends. A document whose stream offset is y of the target trains at the
position t where the integrated schedule reaches y; documents are range-sorted by that position.

Stream offsets are prefix sums over (source, hash bucket): bucket sums are small, and inside a bucket a
window adds up. Buckets grow in number with the table, so a source with a third of all rows is spread out; rows
without an id are dealt to buckets by their text. Sources are few: their table is one small window.

Defined cases: null text has size 0 and is never taken; null sources form one source, ordered last; repeated
rows take part one by one; rows of equal id are ordered by size, then by their text; very long texts are taken
whole; columns with clashing names are kept; an empty table gives an empty result; a
source of size 0 has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize, stable_rows, text_or_empty, unused

#: Weights, and phase schedules, by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
CURRICULUM = ((1.0, 1.0, 1.0, 1.0), (0.4, 0.8, 1.2, 1.6), (1.6, 1.2, 0.8, 0.4))
#: Rows of a bucket, about.
BUCKET_ROWS = 2000


def words_in(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = 3) -> DataFrame:
    """sizes(source, source_size) with weight, rank and target: one row per source, so one small window."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(cap)
    by_level = Window.orderBy(limit / F.col("weight"), "rank")
    everything = Window.partitionBy()
    filled = ranked.withColumn("limit", limit)
    filled = filled.withColumn("before", F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    filled = filled.withColumn("open_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    filled = filled.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")) / F.col("open_weight"))
    fits = F.col("level") <= F.col("limit") / F.col("weight")
    # The level falls or stays from one source to the next, until it fits; the first that fits holds for all.
    first = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    return filled.withColumn("target", F.least(F.col("limit").cast("double"), first * F.col("weight"))).select("source", "source_size", "rank", "weight", "target")


def training_position(share: Column, rank: Column, curriculum=CURRICULUM) -> Column:
    """Inverts the integrated schedule of a source: share in [0, 1] of its demand to training time in [0, 1]."""
    phases = len(curriculum[0])
    out = None
    for k, plan in enumerate(curriculum):
        total, cum = sum(plan), [0.0]
        for w in plan:
            cum.append(cum[-1] + w / total)
        at = F.lit(1.0)
        for j in reversed(range(phases)):
            if cum[j + 1] > cum[j]:
                at = F.when(share < F.lit(cum[j + 1]), (F.lit(float(j)) + (share - F.lit(cum[j])) / F.lit(cum[j + 1] - cum[j])) / F.lit(float(phases))).otherwise(at)
        out = at if out is None else F.when(rank % len(curriculum) == k, at).otherwise(out)
    return out


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, curriculum=CURRICULUM, cap: int = 3, carry: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, positions, first_position.

    positions: array of struct(epoch, words, position), one entry for each time that the mix takes words of
    the document; words is below size only where the source's demand ends. carry: further columns to keep;
    keep them narrow. ordered: range-sorted by first_position.
    """
    # Rows of one id and size, and rows without an id, are told apart by their text.
    told = F.md5(text_or_empty(docs[text_col]).cast("binary"))
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), words_in(docs[text_col]).alias("size"), told.alias("told"), *[docs[c] for c in carry])
    sized = materialize(sized, "mix")
    n = docs.count()
    bits = min(16, max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS)))))
    order = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    place = lambda c: F.shiftright(F.conv(F.substring(c, 1, 4), 16, 10).cast("int"), 16 - bits)
    rows = sized.withColumn("order", order).withColumn("bucket", place("order").cast("bigint") * (1 << bits) + F.when(F.col("id").isNull(), place("told")).otherwise(F.lit(0)))
    # Null sources need a key of their own to join on.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    sums = materialize(sums, "mixsums")
    targets = source_targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")).drop("key"), weights, cap)
    targets = targets.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    before = F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bucket_size")
    offsets = sums.select("key", "bucket", before.alias("bucket_start")).join(targets, "key")
    offsets = materialize(offsets, "mixoffsets")

    inside = Window.partitionBy("key", "bucket").orderBy("order", "id", "size", "told").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(offsets, ["key", "bucket"])
    placed = placed.withColumn("start", F.col("bucket_start") + F.col("inside")).withColumn("demand", F.floor(F.col("target") + 0.5))
    whole = F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0))
    placed = placed.withColumn("epochs", whole)
    rest = F.greatest(F.lit(0), F.least("size", F.col("demand") - F.col("epochs") * F.col("source_size") - F.col("start")))
    placed = placed.withColumn("rest", rest).withColumn("taken", F.col("epochs") * F.col("size") + F.col("rest"))

    def take(e: Column) -> Column:
        share = (e * F.col("source_size") + F.col("start")) / F.col("demand")
        return F.struct(e.cast("int").alias("epoch"), F.when(e < F.col("epochs"), F.col("size")).otherwise(F.col("rest")).alias("words"), training_position(share, F.col("rank"), curriculum).alias("position"))

    last = F.col("epochs") + (F.col("rest") > 0).cast("long") - 1
    takes = F.when((F.col("taken") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), last)), take))
    out = placed.withColumn("positions", F.coalesce(takes, F.array().cast("array<struct<epoch:int,words:bigint,position:double>>")))
    out = out.withColumn("first_position", F.get("positions", F.lit(0))["position"])
    # Range sort by position; what is never taken has no place in the order and comes first, spread by its hash.
    out = out.orderBy("first_position", "order", "id", "told") if ordered else out
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "positions", "first_position", *[c for c in carry])


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The training stream: a row of docs for each time that the mix takes it, all columns kept, in order.

    A document at the end of its source's demand is cut after the words still asked for.
    """
    docs = stable_rows(docs, "documents")
    uid, size, take = (unused(docs.columns, c) for c in ("__uid", "__size", "__take"))
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    mixed = mix_documents(numbered, id_col, text_col, source_col, carry=(uid,), ordered=False, **how)
    takes = mixed.select(uid, F.col("size").alias(size), F.explode("positions").alias(take))
    rows = takes.join(numbered, uid)
    # Only a document at the end of its source's demand is cut; the others keep their text untouched.
    words = F.split(F.regexp_replace(F.col(text_col), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    head = F.array_join(F.slice(words, 1, F.col(f"{take}.words").cast("int")), " ")
    text = F.when(F.col(f"{take}.words") < F.col(size), head).otherwise(F.col(text_col))
    rows = rows.orderBy(f"{take}.position", uid, f"{take}.epoch")
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
