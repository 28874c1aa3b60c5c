import pytest
from pyspark.sql import functions as F

from courierlake.functions import dates, ics, mime, rrule, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("plain", "plain"),
        ("=?UTF-8?B?0J/RgNC40LLQtdGC?=", "Привет"),
        ("=?UTF-8?Q?Weekly_report?=", "Weekly report"),
        ("=?utf-8?Q?a=20b?= =?utf-8?Q?c?=", "a bc"),
        ("=?utf-8?Q?a?= b =?utf-8?Q?c?=", "a b c"),
        ("=?utf-8?B?not base64!?= x", "=?utf-8?B?not base64!?= x"),
        ("=?utf-8?Q?a?= =?utf-8?X?b?=", "a =?utf-8?X?b?="),
        ("a =?utf-8?Q?open", "a =?utf-8?Q?open"),
        ("a =?broken", "a =?broken"),
        ("=?koi8-r?B?8NLJ18XU?=", "Привет"),
    ],
)
def test_header_words(given, wanted):
    assert mime.header_text(given) == wanted


def test_bodies():
    assert mime.body_quoted(b"a =\nb =3D =zz _") == b"a b = =zz _"
    assert mime.charset_text(b"\x81\x93", "latin1") == "\x81“"
    assert mime.charset_text("Привет".encode("cp1251"), "Windows-1251") == "Привет"
    assert mime.charset_text(b"\xff", "nonsense") == "�"
    assert mime.transfer_decoded(b"aGk=\n", "base64") == b"hi"
    assert mime.transfer_decoded(b"???", "base64") == b"???"
    body = b"skip\n--b\nContent-Type: text/html\n\n<p>\n--b\ncontent-type: text/plain;\n charset=utf-8\n\nhello\n--b--\n"
    assert mime.plain_text(body, "multipart/mixed", "", "", "b") == "hello\n"
    assert mime.plain_text(body.replace(b"--b--\n", b""), "multipart/mixed", "", "", "b") == ""
    assert mime.plain_text(b"x", "text/html", "", "", "") == ""
    assert mime.plain_text(b"x", "multipart/mixed", "", "", "") == ""
    assert mime.plain_text(b"x", "", "", "", "") == "x"


@pytest.mark.parametrize(
    "given, email, name",
    [
        ("Alice Smith <alice@Example.com>", "alice@example.com", "Alice Smith"),
        ("bob@example.com", "bob@example.com", "bob"),
        ('"Smith, John" <john@example.com>', "john@example.com", "Smith, John"),
        ("x@y.z <x@y.z>", "x@y.z", "x"),
        ("nobody", None, None),
    ],
)
def test_sender(spark, given, email, name):
    got = one(spark, text.sender_parts(F.lit(given)))
    assert (got and got.email, got and got.name) == (email, name)


def test_recipients_split_inside_quotes(spark):
    got = one(spark, text.recipients(F.lit('Bob <b@x.y>, "A, B" <c@x.y>,, none')))
    assert [r.email for r in got] == ["b@x.y", "c@x.y"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Mon, 1 Jan 2024 10:00:00 +0000", 1704103200),
        ("25 Dec 2023 10:30:00 GMT", 1703500200),
        ("Mon, 25 Dec 2023 12:30:00 +0200 (CEST (x))", 1703500200),
        ("Tue, 25 Dec 2023 10:30:00 +0000", 1703500200),
        ("Mon, 2 Jan 2024 10:00:00 +0000", None),
        ("not a date", None),
        (None, None),
    ],
)
def test_mail_date(spark, given, wanted):
    assert one(spark, dates.mail_date(F.lit(given).cast("string"))) == wanted


def test_ics_values(spark):
    assert one(spark, dates.ics_date(F.lit("20240101T090000Z"))) == 1704099600
    assert one(spark, dates.ics_date(F.lit("20240101"))) == 1704067200
    assert one(spark, dates.ics_date(F.lit("2024"))) is None
    line = F.lit('ATTENDEE;CN="Doe: J";PARTSTAT=ACCEPTED:MAILTO:J@X.y')
    got = one(spark, ics.attendee(line))
    assert (got.email, got.name, got.partstat, got.role) == ("j@x.y", "Doe: J", "ACCEPTED", "")
    assert one(spark, ics.property_name(line)) == "ATTENDEE"
    assert one(spark, ics.unescape(F.lit(r"a\nb\,c\;d\\n\x"))) == "a\nb,c;d\\n\\x"


def _expand(spark, rule, start=1704067200, cutoff=1735689600, cap=10_000):
    return one(spark, rrule.occurrences(rrule.parse_rule(F.lit(rule)), F.lit(start).cast("bigint"), F.lit(cutoff).cast("bigint"), cap))


def test_recurrence(spark):
    day, week = 86400, 604800
    start = 1704067200  # a Monday
    assert _expand(spark, "FREQ=DAILY;COUNT=3") == [start, start + day, start + 2 * day]
    assert _expand(spark, "FREQ=DAILY;INTERVAL=2;UNTIL=20240105T000000Z") == [start, start + 2 * day, start + 4 * day]
    assert _expand(spark, "FREQ=WEEKLY;BYDAY=MO;COUNT=4") == [start + k * week for k in range(4)]
    assert _expand(spark, "FREQ=WEEKLY;COUNT=2") == [start, start + week]
    assert len(_expand(spark, "FREQ=DAILY", cap=5)) == 5
    assert _expand(spark, "FREQ=DAILY;COUNT=0") == [start]
    assert _expand(spark, "FREQ=YEARLY") == [] == _expand(spark, "FREQ=DAILY;BYMONTH=1") == _expand(spark, "COUNT=2")
    jan31 = 1706659200
    assert [x for x in _expand(spark, "FREQ=MONTHLY;COUNT=3", start=jan31)] == [jan31, 1709164800, 1711670400]


@pytest.mark.parametrize(
    "email, name, received, sent, reason",
    [
        ("noreply@x.y", "A", 1, 1, "noreply"),
        ("mailer-daemon@x.y", "A", 1, 1, "automated"),
        ("the.team@x.y", "A", 1, 1, "marketing"),
        ("rosales@x.y", "A", 1, 0, "one_way"),
        ("a@mail.ebay.com", "A", 1, 1, "blocked_domain"),
        ("a@notebay.com", "A", 1, 1, None),
        ("rosales@x.y", "Rosa", 1, 1, None),
        ("a@x.y", "ACME", 1, 1, "suspicious_name"),
        ("a@x.y", "CEO", 1, 1, None),
        ("a@x.y", "ЖЖ", 1, 1, "suspicious_name"),
        ("a@x.y", "a!!", 1, 1, "suspicious_name"),
        ("a@x.y", "The system notification", 1, 1, "suspicious_name"),
        ("a@x.y", "", 1, 1, None),
    ],
)
def test_spam_rules(spark, email, name, received, sent, reason):
    from courierlake.operators.stats import with_spam_rules

    row = spark.createDataFrame([(email, name, received, sent)], "email string, name string, received bigint, sent bigint")
    assert with_spam_rules(row).first()["spam_reason"] == reason


def test_meetings_and_subjects(spark):
    assert one(spark, text.is_meeting(F.lit("Hi"), F.lit("see https://us02web.ZOOM.us/j/1")))
    assert one(spark, text.is_meeting(F.lit("Meeting with Bob"), F.lit("")))
    assert not one(spark, text.is_meeting(F.lit("Hi"), F.lit("no")))
    assert one(spark, text.clean_subject(F.lit("RE:  Re: x "))) == "Re: x"
    assert one(spark, text.format_duration(F.lit(3700))) == "1h 2m"
    assert one(spark, text.blend_colors(F.array(F.lit("#000000"), F.lit("#ffffff")))) == "#808080"
    assert one(spark, text.percent(F.lit(1), F.lit(0))) == 0


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("Mon, 25 Dec 2023 10:30:00 +0000 (a (b (c (d (e (f (g) h))))))", 1703500200),
        ("25 Dec 23 10:30:00 Z", 1703500200),
        ("25 Dec 123 10:30 A", 1703500200),
        ("25 Dec 93 10:30 GMT", 756815400),
        ("25 Dec 2023 10:30 J", None),
        ("25 Dec 2023 10:30 +0000 (open", 1703500200),
        ("25 Dec 2023 10:30 +0000 )", None),
        ("25 Dec 2023 05:30 (x) EST", 1703500200),
    ],
)
def test_dates_of_old_forms(spark, given, wanted):
    assert one(spark, dates.mail_date(F.col("d")), d=given) == wanted


def test_comments(spark):
    rows = ["", "a", "(a)b", "a(b(c)d)e", "a(b", "a)b(c)", "((((((((x))))))))y", "é(ü)漢"]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(dates.strip_comments(F.col("t")).alias("x")).collect()]
    assert got == ["", "a", "b", "ae", "a", "a)b", "y", "é漢"]


def test_escapes_of_calendar_texts(spark):
    rows = ["\\n", "\\\\n", "\\\\\\n", "a\u0001b", "\\x\\", "\\,\\;\\N", "\\\\\\\\"]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(ics.unescape(F.col("t")).alias("x")).collect()]
    assert got == ["\n", "\\n", "\\\n", "a\u0001b", "\\x\\", ",;\n", "\\\\"]
    long = "ATTENDEE;CN=" + "n" * 150_000 + ":mailto:a@x"
    assert len(one(spark, ics.parameter(F.col("d"), "CN"), d=long)) == 150_000
