"""The star graph of contacts, and figures derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..config import EngineConfig

_RANKINGS = "array<struct<name:string,rank:bigint,points:double>>"


def nodes(scored: DataFrame, config: EngineConfig) -> DataFrame:
    """The centre and one row per contact."""
    rows = scored.select(F.col("email").alias("id"), "name", "email", F.lit(False).alias("is_center"), "received", "sent", "score", "rankings", "not_clear")
    center = scored.sparkSession.range(1).select(
        F.lit("me").alias("id"), F.lit(config.my_name).alias("name"), F.lit(config.me).alias("email"), F.lit(True).alias("is_center"),
        F.lit(0).cast("bigint").alias("received"), F.lit(0).cast("bigint").alias("sent"), F.lit(float(rules.CENTER_SCORE)).alias("score"), F.array().cast(_RANKINGS).alias("rankings"), F.lit(False).alias("not_clear"),
    )
    return center.unionByName(rows)


def links(contacts: DataFrame) -> DataFrame:
    """One link for each direction that has messages."""
    both = F.array(
        F.struct(F.col("email").alias("source"), F.lit("me").alias("target"), F.lit("received").alias("type"), F.col("received").alias("weight")),
        F.struct(F.lit("me").alias("source"), F.col("email").alias("target"), F.lit("sent").alias("type"), F.col("sent").alias("weight")),
    )
    return contacts.select(F.explode(F.filter(both, lambda x: x["weight"] > 0)).alias("l")).select("l.*")


def visible_links(all_links: DataFrame, shown: DataFrame) -> DataFrame:
    """Links both of whose ends are shown; the centre always is."""
    own = shown.select(F.lower("email").alias("e")).distinct()
    is_me = lambda c: F.col(c) == "me"
    left = all_links.join(own, F.lower("source") == F.col("e"), "left").withColumn("s", is_me("source") | F.col("e").isNotNull()).drop("e")
    both = left.join(own, F.lower("target") == F.col("e"), "left").withColumn("t", is_me("target") | F.col("e").isNotNull()).drop("e")
    return both.where("s and t").drop("s", "t")


def graph_stats(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count(F.lit(1)).alias("total_contacts"), F.coalesce(F.sum("received"), F.lit(0)).alias("total_received"), F.coalesce(F.sum("sent"), F.lit(0)).alias("total_sent"))


def limited(scored: DataFrame, limit: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("score"), "email").limit(limit)


def node_radius(score: Column, top: Column) -> Column:
    return F.when(top <= 0, F.lit(11.0)).otherwise(F.lit(11.0) + score / top * 19)


def node_sizes(scored: DataFrame) -> DataFrame:
    """radius, received_ratio and the rounded percentage of what was received."""
    total = F.col("received") + F.col("sent")
    top = scored.agg(F.max("score")).scalar()
    ratio = F.when(total > 0, F.col("received") / total).otherwise(F.lit(0.5))
    share = F.when(total > 0, F.floor(F.col("received") * 100 / total + 0.5)).otherwise(F.lit(0)).cast("bigint")
    return scored.select("email", node_radius(F.col("score"), top).alias("radius"), ratio.alias("received_ratio"), share.alias("received_percent"))


def collapsed_radius(members: Column) -> Column:
    return F.least(F.lit(86.0), F.lit(38.0) + F.sqrt(members) * 9)


def overview(contacts: DataFrame, spam: DataFrame) -> DataFrame:
    """Figures of the statistics page as numbers: exchanged, sent per received, mails per contact, spam share."""
    totals = graph_stats(contacts).withColumn("k", F.lit(1)).join(spam.withColumn("k", F.lit(1)), "k")
    exchanged = F.col("total_received") + F.col("total_sent")
    traffic = exchanged + F.col("excluded_total")
    return totals.select(
        "total_contacts",
        exchanged.alias("exchanged"),
        F.when(F.col("total_received") > 0, F.floor(F.col("total_sent") / F.col("total_received") * 100 + 0.5) / 100).alias("sent_per_received"),
        F.when(F.col("total_contacts") > 0, F.floor(exchanged / F.col("total_contacts") * 10 + 0.5) / 10).alias("mails_per_contact"),
        F.when(traffic > 0, F.floor(F.col("excluded_total") / traffic * 1000 + 0.5) / 10).alias("spam_percent"),
    )


def leaders(contacts: DataFrame, domains: DataFrame, groups: DataFrame) -> DataFrame:
    """What is largest, by kind: received, sent, domain by volume, message group by members."""
    first = lambda df, kind, name, value: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("bigint").alias("value")).orderBy(F.desc("value"), "name").limit(1)
    return (
        first(contacts, "received", "email", "received")
        .unionByName(first(contacts, "sent", "email", "sent"))
        .unionByName(first(domains, "domain", "label", "total"))
        .unionByName(first(groups, "message_group", "label", "size"))
    )
