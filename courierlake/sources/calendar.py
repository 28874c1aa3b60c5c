"""Calendar files (iCalendar) as a table of events."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ics_date
from ..functions.ics import attendee, mail_address, parameter, property_name, property_value, unescape


def unfold(content: Column) -> Column:
    """Continuation lines joined, without the one character that marks them."""
    return F.regexp_replace(content, r"\r?\n[ \t]", "")


def readable(value: Column) -> Column:
    """Text of raw bytes without the lines that are not UTF-8."""
    # One character for each byte, so that lines can be told apart before they are read.
    lines = F.split(F.decode(value.cast("binary"), "ISO-8859-1"), "\n")
    raw = lambda x: F.encode(x, "ISO-8859-1").cast("string")
    kept = F.transform(F.filter(lines, lambda x: F.is_valid_utf8(raw(x))), raw)
    return F.when(F.is_valid_utf8(value), value).otherwise(F.array_join(kept, "\n"))


def _inputs(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths that exist, as folders and files, in order; the others are warned of."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders, files = [], []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(conf).globStatus(where) or []
        if not len(found):
            warnings.warn(f"not a file or directory: {path}", stacklevel=3)
        for x in found:
            (folders if x.isDirectory() else files).append(x.getPath().toString())
    return folders, files


def read_ics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per event: source_path, source_file (its base name), event_pos (grows along the file) and the event's own lines.

    path: files, and folders of which all *.ics files are read, but no folders in them; missing ones are warned of.
    Spark splits files of any length at the lines that begin an event. Lines that are not UTF-8 are left out; an
    event that does not end is none.
    """
    folders, files = _inputs(spark, [path] if isinstance(path, str) else list(path))
    texts = spark.read.option("lineSep", "\nBEGIN:VEVENT")
    tables = [texts.option("pathGlobFilter", "*.[iI][cC][sS]").text(sorted(folders))] if folders else []
    tables += [texts.option("pathGlobFilter", "*").text(sorted(files))] if files else []
    if not tables:
        return spark.createDataFrame([], "source_path string, source_file string, event_pos bigint, lines array<string>")
    rows = [t.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_name").alias("source_file"), (F.shiftleft("_metadata.file_block_start", 20) + F.monotonically_increasing_id() % (1 << 33)).alias("event_pos"), "value") for t in tables]
    pieces = rows[0].unionByName(rows[1]) if len(rows) > 1 else rows[0]
    text = F.regexp_replace(readable(F.col("value")), "^BEGIN:VEVENT(?=\\s*\n)", "")
    # The line break before the next event is gone, but for its first half.
    lines = F.transform(F.split(unfold(F.regexp_replace(text, r"\r\z", "")), r"\r?\n"), lambda x: F.rtrim(x))
    # The rest of the line that begins the event is empty; everything up to its end counts, nested components included.
    end = F.array_position(F.transform(lines, lambda x: F.trim(x)), "END:VEVENT")
    events = pieces.withColumn("lines", lines).withColumn("end", end.cast("int")).where((F.col("end") > 0) & (F.trim(F.get("lines", F.lit(0))) == ""))
    return events.select("source_path", "source_file", "event_pos", F.slice("lines", 2, F.greatest(F.lit(0), F.col("end") - 2)).alias("lines"))


def parse_events(events: DataFrame) -> DataFrame:
    """Properties of events; scalars take the last line of their name, texts are unescaped, missing ones are empty."""
    lines = F.col("lines")

    def last(name: str) -> Column:
        return F.try_element_at(F.filter(lines, lambda x: property_name(x) == name), F.lit(-1))

    text = lambda name: F.coalesce(unescape(property_value(last(name))), F.lit(""))
    plain = lambda name: F.coalesce(property_value(last(name)), F.lit(""))
    date = lambda name: ics_date(F.trim(property_value(last(name))))
    return events.select(
        *[c for c in ("source_path", "source_file", "event_pos") if c in events.columns],
        plain("UID").alias("uid"),
        text("SUMMARY").alias("summary"),
        text("DESCRIPTION").alias("description"),
        text("LOCATION").alias("location"),
        F.coalesce(mail_address(property_value(last("ORGANIZER"))), F.lit("")).alias("organizer_email"),
        F.coalesce(parameter(last("ORGANIZER"), "CN"), F.lit("")).alias("organizer_name"),
        F.transform(F.filter(lines, lambda x: property_name(x) == "ATTENDEE"), attendee).alias("attendees"),
        date("DTSTART").alias("dtstart"),
        date("DTEND").alias("dtend"),
        date("CREATED").alias("created"),
        date("LAST-MODIFIED").alias("last_modified"),
        plain("STATUS").alias("status"),
        plain("TRANSP").alias("transp"),
        F.coalesce(property_value(last("SEQUENCE")).try_cast("bigint"), F.lit(0)).cast("bigint").alias("sequence"),
        plain("RRULE").alias("rrule"),
    )
