"""Recurrence rules: parsing, and expansion by array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .dates import ics_date

DAY, WEEK = 86400, 604800


def parse_rule(rrule: Column) -> Column:
    """struct(freq, interval, by_day, until, count, reason); reason says why a rule is not expanded."""
    def found(keys: str) -> str:
        return rf"(?is)^(?:.*;)? *(?:{keys}) *="

    def value(key: str) -> Column:
        """Between the first and the second = of the last part of that name."""
        return F.when(F.rlike(rrule, F.lit(found(key))), F.regexp_extract(rrule, found(key) + "([^;=]*)", 1))

    freq = F.upper(value("FREQ"))
    days = F.transform(F.split(value("BYDAY"), ","), lambda d: F.array_position(F.array(*[F.lit(w) for w in rules.WEEKDAYS]), F.regexp_replace(F.upper(F.trim(d)), r"^[+-]?\d+", "")).cast("int") - 1)
    reason = (
        F.when(F.rlike(rrule, F.lit(found("|".join(rules.UNSUPPORTED_RULE_KEYS)))), F.lit("unsupported key"))
        .when(freq.isNull(), F.lit("missing FREQ"))
        .when(~freq.isin("DAILY", "WEEKLY", "MONTHLY"), F.lit("unsupported FREQ"))
    )
    return F.struct(
        freq.alias("freq"),
        F.greatest(F.lit(1), F.coalesce(value("INTERVAL").try_cast("int"), F.lit(1))).alias("interval"),
        F.coalesce(F.filter(days, lambda d: d >= 0), F.array().cast("array<int>")).alias("by_day"),
        ics_date(value("UNTIL")).alias("until"),
        value("COUNT").try_cast("int").alias("count"),
        reason.alias("reason"),
    )


def weekday(seconds: Column) -> Column:
    """0 for Monday, in UTC."""
    return F.pmod(F.floor(seconds / DAY) + 3, F.lit(7)).cast("int")


def week_index(seconds: Column) -> Column:
    """Weeks since the epoch: they begin on Thursdays."""
    return F.floor(seconds / WEEK)


def add_month(seconds: Column, months: Column) -> Column:
    """Same day and clock some months later, the day cut to the month's length."""
    date = F.date_from_unix_date(F.floor(seconds / DAY).cast("int"))
    return F.unix_date(F.add_months(date, months.cast("int"))).cast("bigint") * DAY + F.pmod(seconds, F.lit(DAY))


def occurrences(rule: Column, start: Column, cutoff: Column, cap: int = rules.MAX_OCCURRENCES) -> Column:
    """array<bigint> of starts, the first at the event's own start if the rule allows it.

    COUNT counts from there, 0 like 1; at most cap. Monthly steps go from each occurrence to the next, so a day
    cut at a short month stays cut.
    """
    stop = F.least(F.coalesce(rule["until"], cutoff), cutoff)
    limit = F.least(F.lit(cap), F.greatest(F.lit(1), F.coalesce(rule["count"], F.lit(cap))))
    none = F.array().cast("array<bigint>")
    step = rule["interval"].cast("bigint")
    # No more days than the limit can use.
    last_daily = F.least(stop, start + step * DAY * (limit - 1))
    daily = F.slice(F.sequence(start, last_daily, step * DAY), F.lit(1), limit)
    days = F.when(F.size(rule["by_day"]) > 0, rule["by_day"]).otherwise(F.array(weekday(start)))
    last_weekly = F.least(stop, start + (limit.cast("bigint") + 1) * step * WEEK)
    # Only the weeks that count, and in them only the days asked for; weeks begin on Thursdays (day 3).
    weeks = F.sequence(week_index(start), week_index(last_weekly), step)
    clock = F.pmod(start, F.lit(DAY))
    starts = F.flatten(F.transform(weeks, lambda w: F.transform(days, lambda d: w * WEEK + F.pmod(d - 3, F.lit(7)) * DAY + clock)))
    weekly = F.array_sort(F.array_distinct(F.filter(starts, lambda t: (t >= start) & (t <= last_weekly))))
    months = F.least(limit - 1, F.floor((stop - start) / (28 * DAY)).cast("int") + 1)
    # Days up to the 28th exist in every month; later ones are cut step by step, and stay cut.
    plain = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), months)), lambda k: add_month(start, k * step))
    short = F.filter(plain, lambda t: t <= stop)
    day_of_month = F.dayofmonth(F.date_from_unix_date(F.floor(start / DAY).cast("int")))
    following = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), months)),
        F.struct(F.array(start).alias("got"), start.alias("at")),
        lambda s, _: F.transform(F.array(add_month(s["at"], step)), lambda t: F.struct(F.when(t <= stop, F.array_append(s["got"], t)).otherwise(s["got"]).alias("got"), t.alias("at")))[0],
    )["got"]
    chain = F.when(day_of_month <= 28, short).otherwise(following)
    return (
        F.when(rule["reason"].isNotNull() | start.isNull() | (start > stop), none)
        .when(rule["freq"] == "DAILY", daily)
        .when(rule["freq"] == "WEEKLY", F.slice(weekly, F.lit(1), limit))
        .otherwise(F.slice(chain, F.lit(1), limit))
    )
