"""Events with their occurrences, and statistics per attendee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.rrule import occurrences, parse_rule
from ..functions.text import local_part
from .groups import organisational
from .order import paged


def expand_events(events: DataFrame, now: int, lookback_days: int = rules.LOOKBACK_DAYS, cap: int = rules.MAX_OCCURRENCES, include_master: bool = True) -> DataFrame:
    """Master rows (occurrence_idx 0) and one row per occurrence within the window.

    Events without a rule stay if they start in the window; masters always stay. Occurrences keep their number
    even where earlier ones lie before the window.
    """
    since = now - lookback_days * 86400
    ruled = events.withColumn("is_recurring", F.col("rrule") != "").withColumn("rule", parse_rule(F.col("rrule")))
    master = ruled.where(F.col("is_recurring") | F.col("dtstart").between(since, now)).withColumn("occurrence_idx", F.lit(0).cast("bigint"))
    span = F.coalesce("dtend", "dtstart") - F.col("dtstart")
    series = ruled.where(F.col("is_recurring") & F.col("rule.reason").isNull())
    repeats = series.select("*", F.posexplode(occurrences(F.col("rule"), F.col("dtstart"), F.lit(now).cast("bigint"), cap)).alias("pos", "at"))
    repeats = repeats.withColumn("occurrence_idx", F.col("pos").cast("bigint") + 1).where(F.col("at") >= since)
    repeats = repeats.withColumn("dtend", F.col("at") + span).withColumn("dtstart", F.col("at")).drop("pos", "at")
    return (master.unionByName(repeats) if include_master else repeats).drop("rule")


def spread(scanned: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores, and so of a small table, dealt to all of them; others as they are.

    For rows that become many, as those of recurrence rules; plans with shuffles are dealt out already.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(cores) if scanned.rdd.getNumPartitions() < cores else scanned


def attendances(events: DataFrame, me: str) -> DataFrame:
    """One row per event and attendee other than me."""
    own = F.get(F.filter("attendees", lambda a: F.lower(F.trim(a["email"])) == me), F.lit(0))["partstat"]
    rows = events.select(
        "event_id", F.lower(F.trim("organizer_email")).alias("organizer"), (F.col("dtend") - F.col("dtstart")).alias("length"), F.size("attendees").alias("n"), own.alias("mine"), F.posexplode("attendees").alias("pos", "a")
    )
    return rows.withColumn("email", F.lower(F.trim("a.email"))).where((F.col("email") != "") & (F.col("email") != me))


def event_pages(events: DataFrame, me: str, size: int = 10_000) -> DataFrame:
    """email, page, event_ids: the events of each attendee in order, at most `size` a row, however many an attendee has."""
    return paged(attendances(events, me).select("email", "event_id"), "email", "event_id", size).withColumnRenamed("values", "event_ids")


def attendee_stats(events: DataFrame, me: str, lists: bool = True) -> DataFrame:
    """One row per attendee other than me: events organised and invited to, mean length and size, acceptance.

    lists: with all event_ids in the row, which suits attendees of bounded numbers of events; event_pages() has them in
    rows of bounded size.
    """
    rows = attendances(events, me)
    rows = rows.withColumn("organized", (F.col("organizer") != "") & (F.col("email") == F.col("organizer")))
    answer = F.upper(F.trim(F.when(F.col("organized"), F.col("mine")).otherwise(F.col("a.partstat"))))
    rows = rows.withColumn("answer", answer)
    named = F.when(F.col("a.name") != "", F.struct("event_id", "pos"))
    stats = rows.groupBy("email").agg(
        F.coalesce(F.min_by("a.name", named), F.lit("")).alias("name"),
        F.count_if("organized").alias("organized_events_count"),
        F.count_if(~F.col("organized")).alias("invited_events_count"),
        F.count(F.lit(1)).alias("total_events_count"),
        *([F.sort_array(F.collect_list("event_id")).alias("event_ids")] if lists else []),
        (F.sum("length") / F.count("length")).alias("avg_duration_seconds"),
        (F.sum("n") / F.count("n")).alias("avg_attendee_count"),
        F.count_if(F.col("answer") == "ACCEPTED").alias("accepted_count"),
        F.count_if(F.col("answer") == "DECLINED").alias("declined_count"),
    )
    answered = F.col("accepted_count") + F.col("declined_count")
    return stats.withColumn("acceptance_rate", F.when(answered > 0, F.col("accepted_count") / answered))


def link_contacts(attendees: DataFrame, contacts: DataFrame | None) -> DataFrame:
    """Attendees that are contacts take the contact's name and address."""
    if contacts is None:
        return attendees.withColumn("contact_email", F.lit(None).cast("string"))
    known = contacts.select(F.lower("email").alias("email"), F.col("email").alias("contact_email"), F.col("name").alias("contact_name"))
    return attendees.join(known, "email", "left").withColumn("name", F.coalesce("contact_name", "name")).drop("contact_name")


def calendar_graph(attendees: DataFrame) -> DataFrame:
    """Attendees with a calendar score, best first."""
    usable = attendees.where("avg_duration_seconds is not null and avg_attendee_count > 0 and total_events_count > 0")
    score = F.col("avg_duration_seconds") / F.col("avg_attendee_count") * F.col("total_events_count")
    shown = F.when(F.col("name") == "", local_part(F.col("email"))).otherwise(F.col("name"))
    return usable.withColumn("score", score).withColumn("name", shown).orderBy(F.desc("score"), "email")


def as_graph(scored: DataFrame) -> DataFrame:
    """Calendar nodes in the shape of mail nodes: organised counts as received, the rest of all events as sent."""
    sent = F.greatest(F.lit(0), F.col("total_events_count") - F.col("organized_events_count"))
    return scored.select("email", "name", F.col("organized_events_count").alias("received"), sent.alias("sent"), "score")


def calendar_totals(events: DataFrame, attendees: DataFrame) -> DataFrame:
    length = F.when(F.col("dtstart").isNotNull() & F.col("dtend").isNotNull(), F.col("dtend") - F.col("dtstart"))
    totals = events.agg(F.count(F.lit(1)).alias("total_meetings"), F.coalesce(F.sum(length) / F.count(length), F.lit(0.0)).alias("avg_seconds"))
    people = attendees.agg(F.count(F.lit(1)).alias("unique_attendees"))
    return totals.withColumn("k", F.lit(1)).join(people.withColumn("k", F.lit(1)), "k").drop("k")


def top_organisation(attendees: DataFrame) -> DataFrame:
    """The organisation with most meetings."""
    sums = organisational(attendees).groupBy("domain").agg(F.sum("total_events_count").alias("meetings")).where("meetings > 0")
    return sums.orderBy(F.desc("meetings"), "domain").limit(1)
