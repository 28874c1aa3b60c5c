"""Dates of mail and calendar files as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names of RFC 2822 and their offsets.
ZONES = {"UT": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
# Names of days and months.
DAYS, MONTHS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def strip_comments(text: Column) -> Column:
    """Without text in parentheses, nested to any depth; an open one takes all that follows, a lone closing one stays."""
    step = lambda s, c: F.struct(
        (s["depth"] + F.when(c == "(", F.lit(1)).when((c == ")") & (s["depth"] > 0), F.lit(-1)).otherwise(F.lit(0))).alias("depth"),
        F.when((s["depth"] == 0) & (c != "("), F.concat(s["kept"], c)).otherwise(s["kept"]).alias("kept"),
    )
    walked = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept")), step)["kept"]
    return F.when(F.contains(text, F.lit("(")), walked).otherwise(text)


def mail_date(text: Column) -> Column:
    """RFC 2822 date; null if it is none. A day name, if given, has to be right, or the date has to be a Monday.

    Years of two digits are of 1950 to 2049, of three after 1900; letters but J stand for no known zone and count as UTC.
    """
    plain = F.trim(F.regexp_replace(strip_comments(text), r"\s+", " "))
    shape = rf"(?i)^(?:({'|'.join(DAYS)}), ?)?(\d{{1,2}}) ({'|'.join(MONTHS)}) (\d{{2,4}}) (\d{{2}}):(\d{{2}})(?::(\d{{2}}))? ([+-]\d{{4}}|[A-IK-Z]|[A-Z]{{2,3}})$"
    part = lambda n: F.regexp_extract(plain, shape, n)
    zone = F.when(F.length(part(8)) == 1, F.lit("+0000")).otherwise(part(8))
    for name, offset in ZONES.items():
        zone = F.when(F.upper(part(8)) == name, F.lit(offset)).otherwise(zone)
    given = part(4).try_cast("int")
    century = F.when(F.length(part(4)) == 4, F.lit(0)).when((F.length(part(4)) == 2) & (given < 50), F.lit(2000)).otherwise(F.lit(1900))
    year = F.lpad((given + century).cast("string"), 4, "0")
    month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(part(3)))
    stamp = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0"))
    clock = F.concat_ws(":", part(5), part(6), F.when(part(7) == "", F.lit("00")).otherwise(part(7)))
    local = F.try_to_timestamp(F.concat(stamp, F.lit(" "), clock, F.lit(" +0000")), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    offset = (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60) * F.when(F.startswith(zone, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    seconds = F.unix_seconds(local)
    weekday = F.pmod(F.floor(seconds / 86400) + 3, F.lit(7)).cast("int")
    named = F.array_position(F.array(*[F.lit(d.lower()) for d in DAYS]), F.lower(part(1))) - 1
    right = (part(1) == "") | (named == weekday) | (weekday == 0)
    return F.when(plain.rlike(shape) & right, seconds - offset)


def ics_date(text: Column) -> Column:
    """20240131T090000Z, 20240131T090000 and 20240131, all read as UTC; others null."""
    shape = F.when(text.rlike(r"^\d{8}T\d{6}Z$"), F.substring(text, 1, 15)).when(text.rlike(r"^\d{8}T\d{6}$"), text).when(text.rlike(r"^\d{8}$"), F.concat(text, F.lit("T000000")))
    return F.unix_seconds(F.try_to_timestamp(F.concat(shape, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmssX")))


def day(seconds: Column) -> Column:
    """YYYY-MM-DD in UTC; empty for null."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit(""))
