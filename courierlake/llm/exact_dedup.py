"""Exact deduplication: 128-bit content hash, byte comparison inside each hash group, one surviving id.

Plan: one shuffle of the distinct texts (copies are combined before it, so a group that holds a third of
all rows costs one row per task), then a narrow join that brings each group's outcome to its rows. The few
groups with more than 1/1000 of all rows - at most 1000 of them - reach their rows by broadcast, the others
by a shuffle in which no key can be hot.

Defined cases: null text counts as empty; null ids never win against others, and a group of null ids only
keeps null; rows that repeat id and text all count in group_size and carry the same outcome; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HEAVY, materialize, text_or_empty, unused


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, hash_bits: int = 128
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", which id of equal texts survives. normalise: Column -> Column, applied before
    comparison. hash_bits: length of the grouping hash (a multiple of 4); any length gives the same result,
    because the bytes are compared inside each group.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    text: Column = text_or_empty(docs[text_col])
    text = normalise(text) if normalise else text
    best = F.min if keep == "min" else F.max
    rows = docs.select(docs[id_col].alias("id"), text.alias("body")).withColumn("sha", F.sha2("body", 256))
    rows = rows.withColumn("key", F.substring("sha", 1, hash_bits // 4))

    # Grouping by hash and text compares bytes within the hash group; singles need no outcome.
    groups = (
        rows.groupBy("key", "body")
        .agg(F.count(F.lit(1)).alias("group_size"), best("id").alias("keep_id"))
        .where("group_size > 1")
        .select(F.sha2("body", 256).alias("sha"), "group_size", "keep_id")
    )
    groups = materialize(groups, "exact")
    heavy_from = docs.count() / HEAVY
    heavy = groups.where(F.col("group_size") > heavy_from).select(
        F.col("sha").alias("h_sha"), F.col("group_size").alias("h_size"), F.col("keep_id").alias("h_keep")
    )
    light = groups.where(F.col("group_size") <= heavy_from)
    narrow = rows.select("id", "sha").join(F.broadcast(heavy), F.col("sha") == F.col("h_sha"), "left")
    # Rows of heavy groups have their outcome; a null key keeps them out of the shuffle join's hot partitions.
    narrow = narrow.withColumn("l_sha", F.when(F.col("h_sha").isNull(), F.col("sha")))
    light = light.select(F.col("sha").alias("l_sha"), F.col("group_size").alias("l_size"), F.col("keep_id").alias("l_keep"))
    done = narrow.where("l_sha is not null").join(light, "l_sha", "left").select("id", "sha", F.col("l_size").alias("size"), F.col("l_keep").alias("keep"))
    done = done.unionByName(narrow.where("l_sha is null").select("id", "sha", F.col("h_size").alias("size"), F.col("h_keep").alias("keep")))
    keep_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return done.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that survive, with all their columns; rows that repeat a surviving id appear once.

    Copies are combined before the shuffle: each task sends one row for each text it has.
    """
    others = [c for c in docs.columns if c != text_col]
    empty = unused(docs.columns, "null")
    row = F.struct(docs[text_col].isNull().alias(empty), *[docs[c] for c in others])
    keyed = docs.select(text_or_empty(docs[text_col]).alias("__body"), row.alias("__row")).withColumn("__key", F.substring(F.sha2("__body", 256), 1, 32))
    # Null ids lose; rows of equal id and text are told apart by a hash of their columns, so that reruns agree.
    own = F.col("__row").getField(id_col)
    rank = F.struct(own.isNull() if keep == "min" else own.isNotNull(), own, F.xxhash64("__row"))
    kept = keyed.groupBy("__key", "__body").agg((F.min_by if keep == "min" else F.max_by)("__row", rank).alias("__row"))
    text = F.when(~F.col("__row").getField(empty), F.col("__body"))
    return kept.select(*[text.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns])
