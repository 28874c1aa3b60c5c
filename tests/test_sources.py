import pytest
from pyspark.sql import functions as F

from courierlake.config import EngineConfig, read_env_file
from courierlake.operators import calendar as cal
from courierlake.operators import classify, curation, groups
from courierlake.plans import api
from courierlake.sources.calendar import parse_events, read_ics

ME, NOW = "you@example.com", 1706745600


def message(sender, to, subject=None, date=None, body="Hello", extra=()):
    head = [f"From {sender} x", f"From: {sender}", f"To: {to}", *extra]
    head += [f"Subject: {subject}"] if subject is not None else []
    head += [f"Date: {date}"] if date else []
    return "\n".join([*head, "", body, ""]) + "\n"


MBOX = (
    "noise before the first message\n"
    + message("Alice <alice@x.example>", ME, "Kickoff", "Mon, 1 Jan 2024 10:00:00 +0000")
    + message(ME, "Alice <alice@x.example>", "Re: Kickoff", "Tue, 2 Jan 2024 09:00:00 +0000", "https://zoom.us/j/1")
    + message(ME, "Bob <bob@x.example>", "=?UTF-8?Q?Weekly_report?=", "Thu, 4 Jan 2024 08:30:00 +0000", extra=["Cc: Carol <carol@y.example>,", " You <you@example.com>"])
    + message("bob@x.example", ME, body=">From me\nnot a separator")
    + message("dave@x.example", ME, "Alone", "not a date")
    + message("no-reply@shop.example", ME, "Shipped", "Sat, 6 Jan 2024 12:00:00 +0000")
)

ICS = """BEGIN:VCALENDAR\r
BEGIN:VEVENT\r
UID:a\r
SUMMARY:Plan\\, and\r
  more\r
DTSTART:20240101T090000Z\r
DTEND:20240101T100000Z\r
ORGANIZER;CN=Bob:mailto:bob@x.example\r
ATTENDEE;CN="You";PARTSTAT=ACCEPTED:mailto:you@example.com\r
ATTENDEE;CN="Bob";PARTSTAT=NEEDS-ACTION:mailto:Bob@x.example\r
ATTENDEE;PARTSTAT=DECLINED:mailto:al@x.example\r
RRULE:FREQ=WEEKLY;BYDAY=MO;COUNT=3\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:b\r
SUMMARY:Plan\\, and more\r
DTSTART:20240110\r
SEQUENCE:x\r
ATTENDEE:mailto:al@x.example\r
ATTENDEE:mailto:cy@x.example\r
BEGIN:VALARM\r
DESCRIPTION:alarm\r
END:VALARM\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:old\r
DTSTART:20200110\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:year\r
DTSTART:20200110\r
RRULE:FREQ=YEARLY\r
END:VEVENT\r
END:VCALENDAR\r
"""


def workspace(spark, tmp_path, name="w"):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.mbox").write_text(MBOX)
    (folder / "c.ICS").write_bytes(ICS.encode())
    return api.load(spark, EngineConfig(ME, NOW), mbox=str(folder / "a.mbox"), ics=str(folder))


def test_mail_end_to_end(spark, tmp_path):
    w = workspace(spark, tmp_path)
    mails = w.mails.collect()
    assert len(mails) == 7
    assert sum(m["date"] is None for m in mails) == 2
    assert {m["subject"] for m in mails} >= {"Weekly report", ""}
    assert any(m["content"].startswith(">From me\nnot a separator") for m in mails)
    got = {r["email"]: r for r in w.contacts.collect()}
    assert set(got) == {"alice@x.example", "bob@x.example", "carol@y.example", "dave@x.example", "no-reply@shop.example"}
    assert (got["alice@x.example"]["received"], got["alice@x.example"]["sent"], got["alice@x.example"]["meetings"]) == (1, 1, 1)
    assert got["alice@x.example"]["duration"] == 0.96 and got["alice@x.example"]["name"] == "Alice"
    assert got["dave@x.example"]["sent_per_month"] is None and got["dave@x.example"]["duration"] == 0.0
    assert {r["email"] for r in w.filtered.collect()} == {"alice@x.example", "bob@x.example"}
    assert w.spam_stats().first().asDict() == {"excluded_count": 3, "excluded_total": 3}
    assert {r["label"]: r["members"] for r in w.message_groups().collect()} == {"Weekly report": ["bob@x.example", "carol@y.example"]}
    nodes, links, totals = w.graph()
    assert nodes.count() == 3 and links.count() == 4 and totals.first()["total_contacts"] == 2
    assert {r["label"]: r["size"] for r in w.domains().collect()} == {"x.example": 2}
    top, shown = w.overall()
    assert top.count() == 3 and shown.count() == 4
    assert w.statistics()[0].first()["exchanged"] == 4
    assert w.all_contacts().where("excluded").count() == 3


def test_decisions(spark, tmp_path):
    w = workspace(spark, tmp_path)
    w = w.mark("alice@x.example", curation.CLEAR, 1).mark("bob@x.example", curation.NOT_HUMAN, 2).mark("dave@x.example", curation.RESTORE, 3)
    assert {(r["email"], r["not_clear"]) for r in w.contacts_view().collect()} == {("alice@x.example", False)}
    assert [r["email"] for r in w.excluded_contacts().collect()] == ["bob@x.example"]
    w = w.mark("bob@x.example", curation.RESTORE, 4)
    assert w.contacts_view().count() == 2


def test_calendar(spark, tmp_path):
    folder = tmp_path / "ics"
    folder.mkdir()
    (folder / "c.ics").write_bytes(ICS.encode())
    events = parse_events(read_ics(spark, str(folder)))
    rows = {r["uid"]: r for r in events.collect()}
    assert rows["a"]["summary"] == "Plan, and more" and rows["a"]["organizer_email"] == "bob@x.example" and rows["a"]["dtend"] - rows["a"]["dtstart"] == 3600
    assert rows["b"]["description"] == "alarm" and rows["b"]["sequence"] == 0 and len(rows["b"]["attendees"]) == 2
    spread = cal.expand_events(events, NOW)
    assert {(r["uid"], r["occurrence_idx"]) for r in spread.collect()} == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("year", 0)}
    spread = spread.withColumn("event_id", F.col("event_pos") * 100 + F.col("occurrence_idx"))
    stats = {r["email"]: r for r in cal.attendee_stats(spread, ME).collect()}
    bob, al = stats["bob@x.example"], stats["al@x.example"]
    assert (bob["organized_events_count"], bob["accepted_count"], bob["acceptance_rate"], bob["avg_duration_seconds"]) == (4, 4, 1.0, 3600.0)
    assert (al["total_events_count"], al["declined_count"], al["name"], al["acceptance_rate"]) == (5, 4, "", 0.0)
    labels = {r["label"] for r in groups.event_members(spread, ME).select("label").collect()}
    assert labels == {"Plan, and more", "Plan, and more — 2024-01-10"}


def test_votes(spark):
    contacts = spark.createDataFrame([("A", "a@x"), ("B", "b@x")], "name string, email string").coalesce(1)
    votes = classify.collect_votes(contacts, lambda prompt: "1, 0" if "2. B" in prompt else "1")
    assert {(r["email"], r["cls"]) for r in classify.unanimous(votes).collect()} == {("a@x", 1), ("b@x", 0)}
    assert classify.parse_answer("1 x 0", 3) is None
    split = spark.createDataFrame([("a", k, k % 2) for k in range(4)], "email string, vote_no int, vote int")
    assert classify.unanimous(split).first()["cls"] == 2


def test_errors_of_the_client_are_attempts(spark):
    calls = []

    def client(text):
        calls.append(1)
        if len(calls) % 2:
            raise RuntimeError("busy")
        return "1 0"

    contacts = spark.createDataFrame([("A", "a@x"), ("B", "b@x")], "name string, email string").coalesce(1)
    assert {(r["email"], r["cls"]) for r in classify.unanimous(classify.collect_votes(contacts, client, at_once=1)).collect()} == {("a@x", 1), ("b@x", 0)}
    assert classify.collect_votes(contacts, lambda text: 1 / 0).isEmpty()


def test_counters(spark, tmp_path):
    got = {r["counter"]: r["n"] for r in workspace(spark, tmp_path).counters().collect()}
    assert got == {"mails": 7, "contacts": 5, "candidates": 2, "masters": 3, "occurrences": 3, "unsupported_rules": 1}


def test_env_file(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# note\nA='x y'\nB=2\n")
    assert read_env_file(str(path), {"B": "3", "C": "4"}) == {"A": "x y", "B": "3"}


def test_stream(spark, tmp_path):
    from courierlake.plans.adapters import exchanges
    from courierlake.streaming.contact_stats import running_stats, windowed_volume

    source = tmp_path / "in"
    exchanges(spark, "/root/testdata/sf0.001").write.parquet(str(source))
    batch = running_stats(spark.read.parquet(str(source)))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    q = running_stats(stream).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("running").collect()) == sorted(batch.collect())
    w = windowed_volume(stream).writeStream.outputMode("update").format("memory").queryName("volume").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("volume").count() > 0


def test_archives_are_split_and_ordered(spark, tmp_path):
    """Messages of several files and splits, odd lines included, equal those of a reader of whole files."""
    from courierlake.sources.mail import _messages, read_mbox

    odd = b"From a x\nFrom: a@x\nFrom the header\nSubject: one\n\nbody\nFrom \xff\xfe not a line\nmore\n"
    bare = b"From b x\nSubject: no body\nFrom c x\nX: still the header of b\n\nbody of b\n\n"
    texts = {
        "a.mbox": b"noise\n\n" + odd + bare + b"".join(f"From m{k} x\r\nSubject: s{k}\r\n\r\nline {k}\r\n>From here\r\n\r\n".encode() for k in range(300)),
        "b.mbox": b"From z x\nSubject: \xd0\xbf\xff\nTo: y\n\n\xd0\xbf\n" + bare * 40 + odd * 30,
        "c.mbox": b"no message at all\n",
        "d.mbox": b"",
    }
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    want = [(name, [(h["name"], h["value"]) for h in heads], body) for name, raw in sorted(texts.items()) for heads, body in _messages(raw.removesuffix(b"\n"))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "700", "61"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = read_mbox(spark, str(tmp_path)).orderBy("source_file", "msg_pos").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [(r["source_file"].rsplit("/", 1)[1], [(h["name"], h["value"]) for h in r["headers"]], bytes(r["body"])) for r in got] == want
        numbers = {}
        for r in got:
            numbers.setdefault(r["source_file"], []).append(r["msg_pos"])
        assert all(n == list(range(len(n))) for n in numbers.values())


def test_first_name_over_several_archives(spark, tmp_path):
    (tmp_path / "1.mbox").write_text(message("al@x.example", ME, "a") * 3)
    (tmp_path / "2.mbox").write_text(message("Al One <al@x.example>", ME, "b") + message("Al Two <al@x.example>", ME, "c"))
    w = api.load(spark, EngineConfig(ME, NOW), mbox=[str(tmp_path / "2.mbox"), str(tmp_path / "1.mbox")])
    assert [(r["name"], r["received"]) for r in w.contacts.collect()] == [("al", 5)]
    (tmp_path / "1.mbox").write_text("")
    w = api.load(spark, EngineConfig(ME, NOW), mbox=str(tmp_path))
    assert [(r["name"], r["received"]) for r in w.contacts.collect()] == [("Al One", 2)]
    assert w.mails.select("source_file", "msg_pos", "rcpt_idx").distinct().count() == w.mails.count() == 2


def test_bad_bytes_and_missing_paths(spark, tmp_path):
    raw = ICS.encode().replace(b"UID:b\r\n", b"UID:b\r\nLOCATION:\xff\xfe\r\nLOCATION:caf\xc3\xa9\r\n")
    (tmp_path / "a.ics").write_bytes(raw)
    (tmp_path / "b.ICS").write_bytes(b"BEGIN:VEVENT\nUID:first\nEND:VEVENT\nBEGIN:VEVENT\nUID:open\nBEGIN:VEVENT\nUID:last\nEND:VEVENT")
    (tmp_path / "c.txt").write_bytes(b"BEGIN:VEVENT\nUID:no\nEND:VEVENT\n")
    (tmp_path / "inner.ics").mkdir()
    with pytest.warns(UserWarning, match="not a file"):
        events = parse_events(read_ics(spark, [str(tmp_path), str(tmp_path / "nothing"), str(tmp_path / "c.txt")])).collect()
    rows = {r["uid"]: r for r in events}
    assert set(rows) == {"a", "b", "old", "year", "first", "last", "no"} and rows["b"]["location"] == "café"
    assert (rows["a"]["source_file"], rows["first"]["source_file"]) == ("a.ics", "b.ICS") and rows["a"]["event_pos"] < rows["b"]["event_pos"] < rows["old"]["event_pos"]
    with pytest.warns(UserWarning):
        assert read_ics(spark, str(tmp_path / "nothing")).isEmpty()


def test_calendar_without_mail_and_tables_that_stay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.ics").write_bytes(ICS.encode())
    w = api.load(spark, EngineConfig(ME, NOW), ics=str(tmp_path / "in"))
    assert w.contacts.isEmpty() and w.mails.isEmpty() and w.attendees.where("contact_email is not null").isEmpty()
    ids = [(r["event_id"], r["occurrence_idx"]) for r in w.events.orderBy("event_id").collect()]
    assert [k for _, k in ids] == [0, 1, 2, 3, 0, 0] and len(set(ids)) == 6
    assert w.overall()[0].count() == 2 and w.graph()[0].count() == 1
    api.save(w, str(tmp_path / "kept"))
    again = api.reopen(spark, w.config, str(tmp_path / "kept"))
    assert sorted(map(str, again.attendees.collect())) == sorted(map(str, w.attendees.collect())) and again.decisions is None
    found = again.node_detail(" Bob@x.example ").collect()
    assert [(r["email"], r["mail_score"], r["total_events_count"]) for r in found] == [("bob@x.example", None, 4)]


def test_an_earlier_sender_stays(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("From x\nFrom: Al <al@x.example>\nFrom: nobody\nTo: you@example.com\n\nhi\n")
    (tmp_path / "b.mbox").write_text("From x\nFrom: Al <al@x.example>\nFrom: B <b@x.example>\nTo: you@example.com\n\nhi\n")
    w = api.load(spark, EngineConfig(ME, NOW), mbox=str(tmp_path))
    assert sorted(r["email"] for r in w.contacts.collect()) == ["al@x.example", "b@x.example"]
