"""Views that present order and event tables as mail, calendar and thread data, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import scratch_dir
from ..operators.order import dealt

ME = "s1@corp1.example"
#: 2024-02-01, the end of look-back windows.
NOW = 1706745600

_MAIL = """
select event_id as msg_pos, 0 as rcpt_idx,
  concat(case user_id % 13 when 3 then 'no-reply' when 5 then 'team.' when 8 then 'newsletter_' else 'u' end, cast(user_id as {s}), '@',
    case user_id % 6 when 0 then 'gmail.com' when 1 then 'acme.example' when 2 then 'mail.sendgrid.net' when 3 then 'globex.example' when 4 then 'outlook.com' else 'initech.example' end) as contact,
  case when event_id % 3 = 0 then '' when user_id % 11 = 0 then 'ACME SUPPORT' else concat('User ', cast(user_id as {s}), ' v', cast(event_id % 2 as {s})) end as name,
  case when user_id % 10 = 7 then 'received' when event_type in ('click', 'purchase') then 'sent' else 'received' end as dir,
  {epoch_ts} as date, cast(floor(value * 10) as bigint) as chars, event_type = 'signup' as is_meeting
from events
"""

_PERSON = "concat('s', cast({k} as {s}), '@', case {k} % 4 when 0 then 'gmail.com' when 1 then 'corp1.example' when 2 then 'corp2.example' else 'corp3.example' end)"

_EVENT = """
select o_orderkey as event_id, concat('series', cast(o_custkey as {s})) as uid,
  case when o_orderkey % 5 = 0 then ' ' else concat('Meeting ', cast(o_custkey % 400 as {s}), ' ') end as summary,
  {epoch_od} as dtstart, case when o_orderkey % 17 = 0 then null else {epoch_od} + 1800 * (1 + o_orderkey % 4) end as dtend,
  {organizer} as organizer_email
from orders
"""

_ATTENDEE = """
select l_orderkey as event_id, l_linenumber as pos, {person} as email,
  case when l_orderkey % 4 = 0 then '' else concat('Supplier ', cast(l_suppkey as {s})) end as name,
  case l_returnflag when 'A' then 'ACCEPTED' when 'R' then 'declined ' else 'NEEDS-ACTION' end as partstat
from lineitem
"""

_THREAD = """
select concat('c', cast(o_custkey % 200 as {s}), '@mail.example') as "from", {person} as "to",
  concat(case o_orderkey % 3 when 0 then 'Re: ' when 1 then 'fwd:' else '' end, 'Topic ', cast(o_orderkey % 50 as {s})) as subject
from orders join lineitem on o_orderkey = l_orderkey
"""


def _fill(sql: str, duck: bool) -> str:
    s = "varchar" if duck else "string"
    epoch = (lambda c: f"cast(floor(epoch({c})) as bigint)") if duck else (lambda c: f"unix_timestamp({c})")
    filled = sql.format(s=s, epoch_ts=epoch("ts"), epoch_od=epoch("o_orderdate"), person=_PERSON.format(k="l_suppkey", s=s), organizer=_PERSON.format(k="(o_custkey % 100)", s=s))
    return filled if duck else filled.replace('"', "`")


def duck(name: str) -> str:
    return _fill({"mail": _MAIL, "event": _EVENT, "attendee": _ATTENDEE, "thread": _THREAD}[name], True)


def _table(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(" ".join(_fill(sql, False).split()).replace("from events", "from {events}").replace("from orders join lineitem", "from {orders} join {lineitem}").replace("from orders", "from {orders}").replace("from lineitem", "from {lineitem}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, _MAIL, "events")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, _THREAD, "orders", "lineitem")


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their attendees in order, also events without any; ten people make an event at most here, so the lists are short."""
    people = _table(spark, sf_dir, _ATTENDEE, "lineitem")
    # Lists and events meet where the rows have been dealt, in shares that do not grow with the tables.
    total = people.count()
    people = dealt(people, total, "event_id")
    lists = people.selectExpr("event_id", "struct(pos, email, name, '' as role, partstat, '' as cutype) as a").groupBy("event_id").agg({"a": "collect_list"})
    lists = lists.withColumnRenamed("collect_list(a)", "a").selectExpr("event_id", "transform(sort_array(a), x -> struct(x.email, x.name, x.role, x.partstat, x.cutype)) as attendees")
    nobody = "cast(array() as array<struct<email:string,name:string,role:string,partstat:string,cutype:string>>)"
    return dealt(_table(spark, sf_dir, _EVENT, "orders"), total, "event_id").join(lists, "event_id", "left").withColumn("attendees", F.expr(f"coalesce(attendees, {nobody})"))


def mail_archive(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as mbox files, a message for each turn; returns their folder."""
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    key, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    head = [
        F.concat(F.lit("From r"), key, F.lit("@mail.example x")),
        F.concat(F.lit('From: "The '), "role", F.lit('" <R'), key, F.lit("@Mail.Example>")),
        F.concat(F.lit("To: t"), turn, F.lit("@x.example,\n\tMe <s1@corp1.example>")),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Cc: c"), key, F.lit("@x.example"))).otherwise(F.lit("X-Note: none")),
        F.concat(F.lit("Subject: =?utf-8?B?"), F.base64(F.concat(F.lit("Thread "), key, F.lit("/"), turn).cast("binary")), F.lit("?=")),
        F.concat(F.lit("Date: "), F.date_format(day, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)")),
    ]
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), "^From ", ">From ")
    at = scratch_dir(spark)
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("\n", *head, F.lit(""), body).alias("value")).write.text(at)
    return at


def calendar_files(spark: SparkSession, sf_dir: str) -> str:
    """Customers as calendar events in *.ics files; returns their folder."""
    key = F.col("c_custkey").cast("string")
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:c"), key),
        F.concat(F.lit("SUMMARY:Visit\\, "), F.substring("c_name", 1, 5), F.lit("\n "), F.substring("c_name", 6, 99)),
        F.concat(F.lit("DTSTART:"), F.date_format(F.timestamp_seconds(F.lit(1_690_000_000) + F.col("c_custkey") * 600), "yyyyMMdd'T'HHmmss'Z'")),
        F.concat(F.lit('ORGANIZER;CN="'), "c_name", F.lit('":MAILTO:C'), key, F.lit("@corp.example")),
        F.concat(F.lit('ATTENDEE;CN="A: b";PARTSTAT=ACCEPTED:mailto:n'), F.col("c_nationkey").cast("string"), F.lit("@x.example")),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("BEGIN:VALARM\nDESCRIPTION:alarm\nEND:VALARM")).otherwise(F.lit("DESCRIPTION:none")),
        F.lit("END:VEVENT"),
    ]
    at = scratch_dir(spark)
    written = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat_ws("\n", F.lit("BEGIN:VCALENDAR"), *lines, F.lit("END:VCALENDAR")).alias("value"))
    written.write.text(at)
    return f"{at}/*.txt"
