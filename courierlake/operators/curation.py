"""Decisions about contacts as an append-only log, applied over the filtered table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folded import FoldedTable

CLEAR, NOT_HUMAN, RESTORE = "clear", "not_human", "restore"


def effective(contacts: DataFrame, filtered: DataFrame, decisions: DataFrame) -> DataFrame:
    """filtered(email, not_clear) after decisions(email, action, ts): the last one of a contact counts.

    clear marks a filtered contact, not_human removes it, restore brings a candidate back, marked clear; a
    restore of a contact that the rules reject has no effect.
    """
    allowed = decisions.join(contacts.select("email", "not_spam"), "email").where((F.col("action") != RESTORE) | F.col("not_spam"))
    last = allowed.groupBy("email").agg(F.max_by("action", F.struct("ts", "action")).alias("action"))
    both = filtered.withColumn("present", F.lit(True)).join(last, "email", "full_outer")
    kept = both.where((F.coalesce("present", F.lit(False)) | (F.col("action") == RESTORE)) & (F.coalesce("action", F.lit("")) != NOT_HUMAN))
    return kept.select("email", F.when(F.col("action").isin(CLEAR, RESTORE), F.lit(False)).otherwise(F.col("not_clear")).alias("not_clear"))


def decide(spark, email: str, action: str, ts: int) -> DataFrame:
    """One row for the log."""
    if not email:
        raise ValueError("an address is needed")
    return spark.createDataFrame([(email.strip().lower(), action, ts)], "email string, action string, ts bigint")


LOG = "email string, action string, ts bigint"


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The decisions that effective() can still ask for: of each contact the last one, and the last one that is no restore.

    Which of the two counts depends on the rules, whose verdict on the contact may change later.
    """
    at = F.struct("ts", "action")
    last = decisions.groupBy("email").agg(F.max(at).alias("any"), F.max(F.when(F.col("action") != RESTORE, at)).alias("other"))
    both = F.array_distinct(F.array_compact(F.array("any", "other")))
    return last.select("email", F.explode(both).alias("d")).select("email", "d.action", "d.ts")


def decision_log(spark, path: str) -> FoldedTable:
    """Decisions in a folder: append(decide(...)) adds to the log, compact() shortens it, rows() are what effective() needs."""
    return FoldedTable(spark, path, LOG, last_decisions)
