"""Ranking reports as files, pages of long lists, rings, and the views of groups in a workspace."""

import pytest
from pyspark.sql import functions as F

from courierlake.operators import calendar as cal
from courierlake.operators import groups, order, ranking
from courierlake.plans import reports

from test_sources import workspace

CONTACTS = "email string, name string, received bigint, sent bigint, duration double, average_chars double, meetings bigint"


def _contacts(spark, n=90):
    rows = [(f"c{k:03d}@x.example", None if k == 5 else f"N {k}", k % 7, k % 5 + 1, float(k % 11) * 20.25, None if k == 3 else k / 7, k % 3) for k in range(n)]
    return spark.createDataFrame(rows, CONTACTS), rows


def _read(path, report):
    files = sorted((path / f"report={report}").glob("part-*"))
    return "".join(f.read_text() for f in files), len(files)


def _ranks(values):
    shown = sorted((round(v, 9) for v in values), reverse=True)
    return [shown.index(round(v, 9)) + 1 for v in values]


def test_files_put_together_are_the_reports(spark, tmp_path):
    contacts, rows = _contacts(spark)
    # Without joined ranges each report comes in several files.
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        reports.write_reports(contacts, str(tmp_path / "r"), {"sent": 1.0, "received": 0.2})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    names = {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()}
    assert names == {f"report={m}_ranking" for m in [*ranking.METRICS, "composite"]}
    several = 0

    def expected(values, shown):
        lines = sorted((rank, r[0], f"{rank}. {r[1] or ''} {r[0]} {shown(v)}\n") for rank, r, v in zip(_ranks(values), rows, values, strict=True))
        return "".join(x[2] for x in lines)

    rate = lambda total, days: float(total) if days <= 0 or days / 30.44 < 1 else total / (days / 30.44)
    columns = {
        "sent": ([float(r[3]) for r in rows], lambda v: str(int(v))),
        "received": ([float(r[2]) for r in rows], lambda v: str(int(v))),
        "sent_per_month": ([rate(r[3], r[4]) for r in rows], "{:.2f}".format),
        "received_per_month": ([rate(r[2], r[4]) for r in rows], "{:.2f}".format),
        "duration": ([r[4] for r in rows], "{:.2f}".format),
        "email_length": ([r[5] or 0.0 for r in rows], "{:.2f}".format),
    }
    for metric, (values, shown) in columns.items():
        text, files = _read(tmp_path / "r", f"{metric}_ranking")
        several += files > 1
        assert text == expected(values, shown), metric
    n, points = len(rows), []
    ranks = [_ranks([float(r[3]) for r in rows]), _ranks([float(r[2]) for r in rows])]
    for a, b in zip(*ranks, strict=True):
        points.append(((n - a + 1) * 1.0, (n - b + 1) * 0.2))
    total = [a + b for a, b in points]
    lines = []
    for k, place in enumerate(_ranks(total)):
        told = f"sent:#{ranks[0][k]} ({points[k][0]:.1f}), received:#{ranks[1][k]} ({points[k][1]:.1f})"
        lines.append((place, rows[k][0], f"{place}. {rows[k][1] or ''} {rows[k][0]} | score: {total[k]:.1f} | {told}\n"))
    head = "\n".join(reports.header_lines({"sent": 1.0, "received": 0.2}, n)) + "\n"
    text, files = _read(tmp_path / "r", "composite_ranking")
    several += files > 1
    assert text == head + "".join(x[2] for x in sorted(lines))
    assert text.startswith("# Composite Contact Ranking\n# Rankings used:\n#   - sent (coefficient: 1)\n#   - received (coefficient: 0.2)\n#\n") and "(90)\n#\n\n1. " in text
    assert several > 2


def test_reports_of_no_contacts(spark, tmp_path):
    contacts, _ = _contacts(spark, 0)
    reports.write_reports(contacts, str(tmp_path / "r"))
    assert _read(tmp_path / "r", "composite_ranking")[0].endswith("(0)\n#\n\n")


def test_pages_hold_all_values_in_order(spark):
    rows = [("hot", k) for k in range(1000, 0, -1)] + [("cold", 5), ("cold", 5), ("none", None), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    pages = order.paged(df, "k", "v", 64).collect()
    assert max(len(r["values"]) for r in pages) == 64
    got = {}
    for r in sorted(pages, key=lambda r: (str(r["k"]), r["page"])):
        got.setdefault(r["k"], []).extend(r["values"])
    assert got == {"hot": list(range(1, 1001)), "cold": [5, 5], "none": [None], None: [1]}
    assert sorted(r["page"] for r in pages if r["k"] == "hot") == list(range(16))


def test_busy_attendees_have_pages(spark):
    person = "struct<email:string,name:string,role:string,partstat:string,cutype:string>"
    events = spark.range(500).select(
        F.format_string("e%05d", "id").alias("event_id"), F.lit("o@x").alias("organizer_email"), F.lit(0).cast("bigint").alias("dtstart"), F.lit(60).cast("bigint").alias("dtend"),
        F.expr(f"cast(array(struct('Bob@x', '', '', '', ''), struct('me@x', '', '', '', ''), struct('c' || id, '', '', '', '')) as array<{person}>)").alias("attendees"),
    )
    pages = {(r["email"], r["page"]): r["event_ids"] for r in cal.event_pages(events, "me@x", 100).collect()}
    assert len(pages) == 505 and pages["bob@x", 4] == [f"e{k:05d}" for k in range(400, 500)]
    listed = cal.attendee_stats(events, "me@x")
    assert listed.where("email = 'bob@x'").first()["event_ids"] == sum((pages["bob@x", k] for k in range(5)), [])
    short = cal.attendee_stats(events, "me@x", lists=False)
    assert sorted(map(str, short.collect())) == sorted(map(str, listed.drop("event_ids").collect()))


def test_rings(spark):
    sizes = {"one": 1, "two": 2, "three": 3, "eight": 8, "nine": 9}
    members = spark.createDataFrame([(label, f"m{k}") for label, n in sizes.items() for k in range(n)], "label string, member string")
    rings = {}
    for r in groups.ring_edges(members.unionByName(members)).collect():
        rings.setdefault(r["label"], set()).add((r["a"], r["b"]))
    assert rings == {"two": {("m0", "m1")}, **{label: {(f"m{k}", f"m{(k + 1) % n}") for k in range(n)} for label, n in sizes.items() if n in (3, 8)}}
    gathered = {(r["label"], r["a"], r["b"]) for r in groups.rope_edges(groups.gather(members)).collect()}
    assert gathered == {(label, *e) for label, edges in rings.items() for e in edges}


def test_group_views(spark, tmp_path):
    w = workspace(spark, tmp_path)
    for kind in ("domain", "message", "event"):
        members = w.members(kind)
        assert members.columns == ["label", "member"]
        whole = {r["label"]: r["members"] for r in groups.gather(members).collect()}
        pages = {}
        for r in sorted(w.group_members(kind, size=1).collect(), key=lambda r: r["page"]):
            assert len(r["members"]) == 1
            pages.setdefault(r["label"], []).extend(r["members"])
        assert pages == whole
        w.group_scores(kind, 3).collect()
        w.group_links(kind).collect()
    shared = {r["member"] for r in w.shared_groups("event", "BOB@x.example ").collect()}
    assert shared <= {r["member"] for r in w.members("event").collect()}
    assert "event_ids" not in w.attendees.columns and w.event_pages().count() >= w.attendees.count()
    with pytest.raises(ValueError):
        w.members("city")
    w.write_reports(str(tmp_path / "reports"))
    assert (tmp_path / "reports" / "report=sent_ranking").is_dir()
