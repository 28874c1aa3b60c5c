"""Labels of event series against the plain loop that gives each series the first free name in order."""

import random

import pytest
from pyspark.sql import functions as F

from courierlake.operators import groups, order

ME = "me@x.com"


def plain(series):
    """uid -> label of (uid, base, date) in first-seen order."""
    taken, counters, out = set(), {}, {}
    for uid, base, date in series:
        label = base
        if label in taken:
            label = f"{base} — {date}" if date else base
            if label in taken:
                n = counters.get(base, 1) + 1
                while f"{base} ({n})" in taken:
                    n += 1
                counters[base] = n
                label = f"{base} ({n})"
        taken.add(label)
        out[uid] = label
    return out


def labels(spark, series):
    df = spark.createDataFrame([(u, b, d, f"{k:06d}") for k, (u, b, d) in enumerate(series)], "uid string, base string, date string, first_id string")
    rows = groups.event_labels(df.repartition(3)).collect()
    assert len(rows) == len(series) == len({r["label"] for r in rows})
    return {r["uid"]: r["label"] for r in rows}


D = "2024-01-15"
CASES = [
    [("X", ""), ("X", ""), ("X", ""), ("X (2)", "")],
    [("X (2)", ""), ("X", ""), ("X", ""), ("X", ""), ("X (2)", "")],
    [("X", ""), ("X (3)", ""), ("X", ""), ("X", ""), ("X (2)", ""), ("X", ""), ("X (2)", ""), ("X (2) (2)", "")],
    [("X", D), ("X — " + D, ""), ("X", D), ("X", D), ("X", "2024-01-16"), ("X — 2024-01-16", D), ("X — 2024-01-16", D)],
    [("X", D), ("X", D), ("X — " + D, ""), ("X — " + D, D), ("X — " + D, D), (f"X — {D} — {D}", "")],
    [("X (1)", ""), ("X (02)", ""), ("X", ""), ("X", ""), ("(2)", ""), (" (2)", ""), ("Y (2)", ""), ("Y (2)", ""), ("a\nb", ""), ("a\nb", ""), ("a\nb (2)", "")],
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_clashing_titles(spark, case):
    series = [(f"u{k}", b, d) for k, (b, d) in enumerate(CASES[case])]
    assert labels(spark, series) == plain(series)


def test_many_clashes(spark):
    r = random.Random(11)
    titles = ["X", "X", "X", "X (2)", "X (3)", "X (5)", "X (7)", "X (2) (2)", "X (2) (3)", "X — " + D, f"X — {D} (2)", f"X (2) — {D}", "Y", "Y (2)", "Z"]
    series = [(f"u{k}", r.choice(titles), r.choice(["", D, "2024-01-16"])) for k in range(150)]
    assert labels(spark, series) == plain(series)


def event(k, uid, title, people, dtstart=1705276800):
    return (f"{k:04d}", uid, title, dtstart, [(p, "", "", "", "") for p in people])


EVENT = "event_id string, uid string, summary string, dtstart bigint, attendees array<struct<email:string,name:string,role:string,partstat:string,cutype:string>>"


def test_series_to_groups(spark):
    day, both = 86400, ["A@x.com ", "b@x.com"]
    rows = [event(k, "s1", "Standup", [ME, *both], 1705276800 + 7 * k * day) for k in range(3)]
    rows += [event(3, "solo", "Just us", [ME, "only@x.com"]), event(4, "s2", " 1:1 ", both), event(5, "s3", "1:1", both, 1705276800 + 30 * day), event(6, "s4", " ", both)]
    rows += [event(7, "s5", None, ["c@x.com", "d@x.com", "c@x.com"]), event(8, "none", "X", []), event(9, "s6", "1:1 (2)", ["e@x.com", "f@x.com"])]
    members = groups.event_members(spark.createDataFrame(rows, EVENT), ME)
    got = {r["label"]: r["members"] for r in groups.gather(members).collect()}
    assert got == {
        "Standup": ["a@x.com", "b@x.com"],
        "1:1": ["a@x.com", "b@x.com"],
        "1:1 — 2024-02-14": ["a@x.com", "b@x.com"],
        "(untitled event)": ["a@x.com", "b@x.com"],
        "(untitled event) — 2024-01-15": ["c@x.com", "d@x.com"],
        "1:1 (2)": ["e@x.com", "f@x.com"],
    }
    assert {r["uid"] for r in groups.event_members(spark.createDataFrame(rows, EVENT), ME, labels=False).collect()} == {"s1", "s2", "s3", "s4", "s5", "s6"}
    assert groups.event_members(spark.createDataFrame([], EVENT), ME).isEmpty()


@pytest.mark.parametrize("heavy", [1000, 10])
def test_shares_of_tasks_follow_the_input(spark, monkeypatch, heavy):
    """One large group, one member of all groups and repeated rows: the results of plain Python, from partitions of bounded size."""
    monkeypatch.setattr(order, "PART_ROWS", 50)
    monkeypatch.setattr(order, "HEAVY", heavy)
    pairs = [(f"g{i % 60}", f"u{i * 7 % 90}@d{i % 5}.x") for i in range(400)] + [("big", f"u{i}@d{i % 3}.x") for i in range(600)] + [(f"g{i}", "all@d.x") for i in range(60)] + [("two", "a@d.x"), ("two", "b@d.x"), ("one", "a@d.x")]
    members = spark.createDataFrame(pairs + pairs[:300], "label string, member string")
    rows, total = groups._each_once(members)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert total == len(pairs) + 300 and len(sizes) >= total // 50 and max(sizes) < 2.5 * 50
    own: dict[str, set] = {}
    for label, member in pairs:
        own.setdefault(label, set()).add(member)
    ring = {(g, m[i], m[(i + 1) % len(m)]) for g, x in own.items() if 2 <= len(x) <= 8 for m in [sorted(x)] for i in range(1 if len(m) == 2 else len(m))}
    assert sorted(tuple(r) for r in groups.ring_edges(members).collect()) == sorted(ring)
    for email in ("all@d.x", "u7@d1.x", "a@d.x"):
        shared: dict[str, list] = {}
        for g, x in own.items():
            if email in x and len(x) >= 3:
                for m in x - {email}:
                    shared.setdefault(m, []).append((-len(x), g))
        assert {tuple(r) for r in groups.co_members(members, email).select("member", "shared", "largest").collect()} == {(m, len(v), min(v)[1]) for m, v in shared.items()}
    known = {m: i for i, m in enumerate(sorted({m for _, m in pairs})) if i % 4}
    nodes = spark.createDataFrame([(m.upper(), float(i), i, 2 * i) for m, i in known.items()], "email string, score double, received bigint, sent bigint")
    told = {(g, len(v), float(sum(known[m] for m in v)), sum(known[m] for m in v), 2 * sum(known[m] for m in v), len({m.split("@")[1] for m in v})) for g, x in own.items() for v in [x & set(known)] if len(v) >= 3}
    found = groups.group_scores(members, nodes).select("label", "members", "score", "received", "sent", "domains").collect()
    assert {tuple(r) for r in found} == told and len(found) == len(told)
    assert [(-r["score"], r["label"]) for r in found] == sorted((-r["score"], r["label"]) for r in found)
