"""All queries against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from courierlake.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in plans.oracle_sql():
        assert got
        return
    found = db.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert columns == [names[i] for i in order]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_later_decisions_count(spark, monkeypatch):
    seen, apply = [], plans.curation.effective
    monkeypatch.setattr(plans.curation, "effective", lambda contacts, kept, log: seen.append(log) or apply(contacts, kept, log))
    plans.queries()["curation_effective"](spark, SF)
    log = [(r["email"], r["action"], r["ts"]) for r in seen[0].collect()]
    twice = {e for e, a, ts in log if ts == 1 and a == "clear"} & {e for e, a, ts in log if ts == 2 and a != "clear"}
    assert twice and len({e for e, _, _ in log}) * 2 == len(log)


def test_durations_of_all_orders(spark, db):
    """The rounding that the query labels does not reach."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", plans.text.format_duration(plans.F.col("o_orderkey") * 7).alias("d"))
    minutes = "cast(floor(o_orderkey * 7 / 60 + 0.5) as bigint)"
    sql = f"select o_orderkey, case when {minutes} >= 60 then ({minutes} // 60) || 'h ' || ({minutes} % 60) || 'm' else {minutes} || 'm' end from orders"
    assert sorted(map(tuple, orders.collect())) == sorted(db.execute(sql).fetchall())
