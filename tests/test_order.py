"""Ranks without a global sort against plain sorting."""

import random

from pyspark.sql import functions as F

from courierlake.operators import order
from courierlake.operators.order import numbered, places_of, with_place, with_rank
from courierlake.operators.ranking import overall


def rows(n=400):
    r = random.Random(4)
    return [(f"{r.choice('abcx')}{r.choice('abcx')}{k}@x", r.choice([0.0, -0.0, 1.0, 2.5, -3.0, 1e-9, 1e12, float(r.randint(-50, 50)), r.random()])) for k in range(n)]


def test_ranks(spark):
    table = rows()
    df = spark.createDataFrame(table, "email string, score double").repartition(5)
    for down in (True, False):
        got = {r["email"]: r["rank"] for r in with_rank(df, "score", "rank", down).collect()}
        assert got == {e: 1 + sum((t > s) if down else (t < s) for _, t in table) for e, s in table}


def test_places(spark):
    table = rows()
    df = spark.createDataFrame(table, "email string, score double").repartition(5)
    order = sorted(table, key=lambda x: (-x[1], x[0]))
    want = {e: k + 1 for k, (e, _) in enumerate(order)}
    assert {r["email"]: r["place"] for r in with_place(df, "score", "email", "place").collect()} == want
    few = df.where("email like 'a%'")
    got = {r["email"]: r["place"] for r in places_of(df, few, "score", "email", "place").collect()}
    assert got and got == {e: want[e] for e in got}
    assert with_place(df.limit(0), "score", "email", "place").isEmpty() and places_of(df, few.limit(0), "score", "email", "place").isEmpty()


def test_overall(spark):
    r = random.Random(8)
    mail = [(f"p{k}@x", f"n{k}", k, 1, float(r.randint(0, 60))) for k in range(300)]
    side = [(f"p{k}@x", f"c{k}", float(r.randint(0, 60))) for k in range(150, 500)]
    got = overall(spark.createDataFrame(mail, "email string, name string, received bigint, sent bigint, score double"), spark.createDataFrame(side, "email string, name string, score double")).collect()
    place = lambda table: {e: k + 1 for k, e in enumerate(e for e, _ in sorted(((x[0], x[-1]) for x in table), key=lambda x: (-x[1], x[0])))}
    m, c = place(mail), place(side)
    points = lambda k: 302.0 - 2 * k if k and k <= 150 else 0.0
    want = sorted(((points(m.get(e)) + points(c.get(e)) / 2, e) for e in {*m, *c}), key=lambda x: (-x[0], x[1]))
    assert [(x["total_points"], x["email"]) for x in got] == [x for x in want if x[0] > 0][:150]
    assert all((x["mail_rank"], x["calendar_rank"]) == (m.get(x["email"]), c.get(x["email"])) for x in got)


def test_nulls_stay(spark):
    """Null values share the last rank; null ties come last; user columns keep their names and values."""
    table = [("a", 2.0, 7, 8), ("b", None, 7, 8), (None, 2.0, 7, 8), ("c", 3.0, 7, 8), ("d", None, 7, 8), (None, None, 7, 8), ("e", -0.0, 7, 8), ("f", 0.0, 7, 8)]
    df = spark.createDataFrame(table, "email string, score double, __own int, __v int")
    for down in (True, False):
        got = {(r["email"], r["score"]): (r["rank"], r["__own"], r["__v"]) for r in with_rank(df, "score", "rank", down).collect()}
        there = [s for _, s, *_ in table if s is not None]
        assert got == {(e, s): (len(there) + 1 if s is None else 1 + sum((t > s) if down else (t < s) for t in there), 7, 8) for e, s, *_ in table}
    places = {(r["email"], r["score"]): r["place"] for r in with_place(df, "score", "email", "place").collect()}
    want = sorted(table, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0] is None, r[0] or ""))
    assert places == {(e, s): k + 1 for k, (e, s, *_) in enumerate(want)}
    assert with_rank(df.limit(0), "score", "rank").isEmpty()


def test_any_distribution(spark):
    """Values that differ late, far apart, or not at all: no window holds more than its share."""
    for values in ("1.0 + id * 1e-9", "exp(id % 700)", "if(id % 3 = 0, 5.0, id * 1.0)", "cast('inf' as double)"):
        df = spark.range(20_000).selectExpr("id", f"cast({values} as double) as score", "concat('u', id) as email")
        want = {r["id"]: r["r"] for r in df.selectExpr("id", "rank() over (order by score desc) as r").collect()}
        assert {r["id"]: r["rank"] for r in with_rank(df, "score", "rank").collect()} == want
    counts = df.select((F.lit(1.0) + F.col("id") * 1e-9).alias("v"))
    splitters = counts.agg(F.percentile_approx("v", [k / order.RANGES for k in range(1, order.RANGES)], order.ACCURACY)).first()[0]
    sizes = counts.groupBy(F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s < F.col("v")))).count().agg(F.max("count")).first()[0]
    assert sizes <= 3 * 20_000 / order.RANGES


def test_equal_values_are_split(spark, monkeypatch):
    """Rows of one value are dealt out by their tie: no task gets more than three times the mean."""
    seen = []
    monkeypatch.setattr(order, "written", lambda df: seen.append(df.persist()) or seen[-1])
    df = spark.range(0, 200_000, 1, 8).selectExpr("concat('common.prefix.', id) as email", "1.0 as score")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = with_place(df, "score", "email", "place")
        assert got.selectExpr("count(*) as n", "count(distinct place) as d", "min(place) as a", "max(place) as b").first()[:] == (200_000, 200_000, 1, 200_000)
        assert got.orderBy("email").limit(3).select("place").collect() == [(1,), (2,), (3,)]
        sizes = [r["count"] for r in seen[0].groupBy("__part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_numbered_groups(spark):
    r = random.Random(5)
    table = [(r.choice(["a", "a", "a", "b", None]), k) for k in r.sample(range(10_000), 600)]
    got = {tuple(x) for x in numbered(spark.createDataFrame(table, "g string, k int").repartition(5), ["g"], [F.asc("k")], "n").collect()}
    assert got == {(g, k, 1 + sum(h == g and j < k for h, j in table)) for g, k in table}
