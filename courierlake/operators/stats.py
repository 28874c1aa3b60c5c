"""Statistics per correspondent, and the rule filter built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import local_part, per_month, round2, spam_rules


def _totals() -> dict[str, Column]:
    """The aggregates of one contact, or of any part of its exchanges."""
    return {
        "received": F.count_if(F.col("dir") == "received"),
        "sent": F.count_if(F.col("dir") == "sent"),
        "first_ts": F.min("date"),
        "last_ts": F.max("date"),
        "total_chars": F.sum("chars"),
        "email_count": F.count(F.lit(1)),
        "meetings": F.count_if("is_meeting"),
    }


def contact_stats(exchanges: DataFrame) -> DataFrame:
    """One row per contact from exchanges(contact, name, dir, date, chars, is_meeting, msg_pos, rcpt_idx).

    The first name in order of archive, message and recipient counts. Exchanges are added up by contact and name first:
    numbers alone, so map-side by hash and without a sort of all rows, which an aggregate that holds a text would need.
    """
    outer, inner = ([c] if c in exchanges.columns else [] for c in ("source_file", "rcpt_idx"))
    by_name = exchanges.groupBy(F.col("contact").alias("email"), "name", *outer, *inner).agg(F.min("msg_pos").alias("msg_pos"), *[x.alias(c) for c, x in _totals().items()])
    named = F.when(F.col("name") != "", F.struct(*outer, "msg_pos", *inner))
    over = {"first_ts": F.min, "last_ts": F.max}
    return by_name.groupBy("email").agg(F.coalesce(F.min_by("name", named), F.lit("")).alias("name"), *[over.get(c, F.sum)(c).alias(c) for c in _totals()])


def contact_stats_at_once(exchanges: DataFrame) -> DataFrame:
    """contact_stats() as one aggregation, for streams, whose state can be that of one only."""
    named = F.when(F.col("name") != "", F.struct(*[c for c in ("source_file", "msg_pos", "rcpt_idx") if c in exchanges.columns]))
    return exchanges.groupBy(F.col("contact").alias("email")).agg(F.coalesce(F.min_by("name", named), F.lit("")).alias("name"), *[x.alias(c) for c, x in _totals().items()])


def _rate(total: Column) -> Column:
    days = (F.col("last_ts") - F.col("first_ts")) / 86400.0
    months = days / 30.44
    rate = F.when((F.col("first_ts") >= F.col("last_ts")) | (months < 1), total.cast("double")).otherwise(round2(total / months))
    return F.when(F.col("first_ts").isNotNull(), rate)


def contact_metrics(stats: DataFrame) -> DataFrame:
    """Monthly rates (null without dates), mean length, span in days, and the local part where no name is known."""
    days = F.when(F.col("last_ts") > F.col("first_ts"), round2((F.col("last_ts") - F.col("first_ts")) / 86400.0)).otherwise(F.lit(0.0))
    return stats.where("received + sent > 0").select(
        "email",
        F.when(F.col("name") == "", local_part(F.col("email"))).otherwise(F.col("name")).alias("name"),
        "received",
        "sent",
        _rate(F.col("sent")).alias("sent_per_month"),
        _rate(F.col("received")).alias("received_per_month"),
        F.when(F.col("email_count") > 0, round2(F.col("total_chars") / F.col("email_count"))).alias("average_chars"),
        days.alias("duration"),
        "meetings",
    )


def with_spam_rules(contacts: DataFrame) -> DataFrame:
    """The six rules as columns, spam_reason (the first that holds) and not_spam."""
    rules = spam_rules(F.col("email"), F.col("name"), F.col("received"), F.col("sent"))
    flagged = contacts.withColumns({f"is_{k}": v for k, v in rules.items()})
    reason = F.coalesce(*[F.when(F.col(f"is_{k}"), F.lit(k)) for k in rules])
    return flagged.withColumn("spam_reason", reason).withColumn("not_spam", F.col("spam_reason").isNull())


def candidates(contacts: DataFrame) -> DataFrame:
    return with_spam_rules(contacts).select(*contacts.columns, "not_spam")


def verified(contacts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """contacts_filtered(email, not_clear) of the candidates: all unclear without classes; class 0 goes, 1 is clear, others are unclear."""
    kept = contacts.where("not_spam").select("email")
    if classes is None:
        return kept.withColumn("not_clear", F.lit(True))
    joined = kept.join(classes.select("email", "cls"), "email", "left").withColumn("cls", F.coalesce("cls", F.lit(2)))
    return joined.where("cls <> 0").select("email", (F.col("cls") != 1).alias("not_clear"))


def filtered_contacts(contacts: DataFrame, filtered: DataFrame) -> DataFrame:
    """Contacts that passed, with not_clear and total, largest total first."""
    joined = contacts.join(filtered, "email").withColumn("total", F.col("received") + F.col("sent"))
    return joined.orderBy(F.desc("total"), "email")


def excluded_contacts(contacts: DataFrame, filtered: DataFrame, candidates_only: bool = True) -> DataFrame:
    out = contacts.join(filtered, "email", "left_anti")
    out = out.where("not_spam") if candidates_only else out
    return out.withColumn("total", F.col("received") + F.col("sent")).orderBy(F.desc("total"), "email")


def spam_stats(contacts: DataFrame, filtered: DataFrame) -> DataFrame:
    out = contacts.join(filtered, "email", "left_anti")
    return out.agg(F.count(F.lit(1)).alias("excluded_count"), F.coalesce(F.sum(F.col("received") + F.col("sent")), F.lit(0)).cast("bigint").alias("excluded_total"))


def live_rate(total: str) -> Column:
    """Unrounded monthly rate from the span in days."""
    return per_month(F.col(total), F.col("duration"))
