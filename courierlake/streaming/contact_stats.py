"""Extension: contact statistics over a stream of exchanges, kept up to date with Structured Streaming.

All of contact_stats() is made of sums and extremes, the first name included: it is the least by archive, message and
recipient. So a stream gives the batch's rows whatever its micro-batches are and in whatever order messages come; no
message is ever late, and state is one row a contact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.stats import contact_stats_at_once
from ..sources.folded import FoldedTable

PARTIAL = (
    "email string, named struct<source_file:string,msg_pos:bigint,rcpt_idx:int,name:string>, received bigint, sent bigint, "
    "first_ts bigint, last_ts bigint, total_chars bigint, email_count bigint, meetings bigint"
)


def running_stats(exchanges: DataFrame) -> DataFrame:
    """contact_stats() as a stream's state; use output mode update or complete."""
    return contact_stats_at_once(exchanges)


def partial_stats(exchanges: DataFrame) -> DataFrame:
    """One row per contact in PARTIAL form, which merged_stats() puts together."""
    place = {"source_file": F.lit(None).cast("string"), "msg_pos": F.lit(None).cast("bigint"), "rcpt_idx": F.lit(None).cast("int")}
    known = {c: F.col(c).cast(t) if c in exchanges.columns else place[c] for c, t in (("source_file", "string"), ("msg_pos", "bigint"), ("rcpt_idx", "int"))}
    named = F.when(F.col("name") != "", F.struct(*[x.alias(c) for c, x in known.items()], "name"))
    count = lambda of: F.when(of, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return merged_stats(
        exchanges.select(
            F.col("contact").alias("email"),
            named.alias("named"),
            count(F.col("dir") == "received").alias("received"),
            count(F.col("dir") == "sent").alias("sent"),
            F.col("date").cast("bigint").alias("first_ts"),
            F.col("date").cast("bigint").alias("last_ts"),
            F.col("chars").cast("bigint").alias("total_chars"),
            F.lit(1).cast("bigint").alias("email_count"),
            count(F.col("is_meeting")).alias("meetings"),
        )
    )


def merged_stats(partials: DataFrame) -> DataFrame:
    """One row per contact from any number of PARTIAL rows."""
    least, most = ("named", "first_ts"), ("last_ts",)
    sums = [c for c in partials.columns if c not in ("email", *least, *most)]
    return partials.groupBy("email").agg(*[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most], *[F.sum(c).cast("bigint").alias(c) for c in sums])


def contact_table(spark: SparkSession, path: str) -> FoldedTable:
    """The kept statistics in the folder path."""
    return FoldedTable(spark, path, PARTIAL, merged_stats)


def kept_stats(table: FoldedTable) -> DataFrame:
    """contact_stats() of all exchanges that the table has taken in."""
    name = F.coalesce("named.name", F.lit("")).alias("name")
    return table.rows().select("email", name, "received", "sent", "first_ts", "last_ts", "total_chars", "email_count", "meetings")


def keep_stats(exchanges: DataFrame, path: str, checkpoint: str, compact_every: int = 50, **trigger) -> StreamingQuery:
    """Starts a query that adds each micro-batch of exchanges to the table at path, as a part of its own.

    A micro-batch that is run again after a failure finds its part written, or writes it then; so each message counts
    once. checkpoint: the query's own folder, which belongs to the table and is never used with another one.
    """
    table = contact_table(exchanges.sparkSession, path)

    def add(rows: DataFrame, number: int) -> None:
        table.append(partial_stats(rows), number)
        if (number + 1) % compact_every == 0:
            table.compact()

    return exchanges.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_volume(exchanges: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Messages per window and direction; late ones count up to the watermark, which also bounds the state."""
    timed = exchanges.withColumn("at", F.timestamp_seconds("date")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every), "dir").agg(F.count(F.lit(1)).alias("messages"))
