"""Tables of parts and snapshots: streams of exchanges under any cut, decisions under any compaction."""

import random

import pytest
from pyspark.sql import functions as F

from courierlake.operators import curation, stats
from courierlake.streaming.contact_stats import contact_table, keep_stats, kept_stats, partial_stats, running_stats

EXCHANGES = "contact string, name string, dir string, date bigint, chars bigint, is_meeting boolean, source_file string, msg_pos bigint, rcpt_idx int"


def _exchanges(n, seed):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        name = draw.choice(["", None, f"N{draw.randrange(9)}", f"M{k}"])
        out.append((f"c{draw.randrange(12)}@x.example", name, draw.choice(["sent", "received"]), draw.choice([None, draw.randrange(10**6)]), draw.randrange(500), draw.random() < 0.2, f"f{k % 3}-{seed}", k, 0))
    draw.shuffle(out)
    return out


def _sorted(df):
    rows = df.select("email", "name", "received", "sent", "first_ts", "last_ts", "total_chars", "email_count", "meetings").collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("cut, compact_every", [(1, 2), (7, 3), (40, 50)])
def test_streams_equal_the_batch_under_any_cut(spark, tmp_path, cut, compact_every):
    rows = _exchanges(40, cut)
    source = tmp_path / "in"
    cuts = max(1, len(rows) // cut)
    step = -(-len(rows) // min(cuts, 6))
    for lo in range(0, len(rows), step):
        spark.createDataFrame(rows[lo : lo + step], EXCHANGES).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EXCHANGES).option("maxFilesPerTrigger", 1).parquet(str(source))
    wanted = _sorted(stats.contact_stats(spark.createDataFrame(rows, EXCHANGES)))
    keep_stats(stream, str(tmp_path / "t"), str(tmp_path / "cp"), compact_every).awaitTermination(120)
    table = contact_table(spark, str(tmp_path / "t"))
    assert table.last() == -(-len(rows) // step) - 1
    assert _sorted(kept_stats(table)) == wanted
    # The stream's own state gives the same, first names included.
    name = f"state{cut}"
    running_stats(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    assert _sorted(spark.table(name)) == wanted


def test_statistics_need_no_sort_of_all_rows(spark):
    rows = _exchanges(60, 8)
    df = spark.createDataFrame(rows, EXCHANGES)
    assert _sorted(stats.contact_stats(df)) == _sorted(stats.contact_stats_at_once(df))
    few = df.drop("source_file", "rcpt_idx")
    assert _sorted(stats.contact_stats(few)) == _sorted(stats.contact_stats_at_once(few))
    plan = stats.contact_stats(df)._jdf.queryExecution().sparkPlan().toString().splitlines()
    kinds = [line.split("(")[0].split()[-1] for line in plan if "Aggregate" in line.split("(")[0]]
    # From the top: by contact, final and partial; by contact and name, final and partial.
    assert [k.removeprefix("+-").strip() for k in kinds] == ["SortAggregate", "SortAggregate", "HashAggregate", "HashAggregate"]


def test_late_and_repeated_parts(spark, tmp_path):
    rows = _exchanges(30, 5)
    table = contact_table(spark, str(tmp_path / "t"))
    part = lambda k: partial_stats(spark.createDataFrame(rows[k * 10 : k * 10 + 10], EXCHANGES))
    # A part whose write broke off counts for nothing, and is written when the micro-batch is run again.
    for k in (0, 1):
        table.append(part(k), k)
    broken = tmp_path / "t" / "part-000000000002"
    table.append(part(2), 2)
    (broken / "_SUCCESS").unlink()
    assert table.last() == 1
    table.append(part(2), 2)
    table.append(part(2), 2)
    table.append(part(0), 0)
    wanted = _sorted(stats.contact_stats(spark.createDataFrame(rows, EXCHANGES)))
    assert _sorted(kept_stats(table)) == wanted
    table.compact()
    # Parts that a snapshot holds are not taken twice.
    table.append(part(1), 1)
    assert _sorted(kept_stats(table)) == wanted


def test_a_snapshot_that_broke_off_counts_for_nothing(spark, tmp_path):
    table = contact_table(spark, str(tmp_path / "t"))
    for k in range(2):
        table.append(partial_stats(spark.createDataFrame(_exchanges(9, k), EXCHANGES)))
    before = _sorted(kept_stats(table))
    table.compact()
    (tmp_path / "t" / "snapshot-000000000001" / "_SUCCESS").unlink()
    assert _sorted(kept_stats(table)) == before
    table.compact()
    assert _sorted(kept_stats(table)) == before


def test_reads_cost_the_snapshot_and_later_parts(spark, tmp_path):
    table = contact_table(spark, str(tmp_path / "t"))
    rows = []
    for k in range(7):
        more = _exchanges(5, 100 + k)
        rows += more
        table.append(partial_stats(spark.createDataFrame(more, EXCHANGES)))
        if k % 3 == 2:
            table.compact()
    folders = {f.split("/")[-2] for f in table._stored(table.last()).inputFiles()}
    assert folders == {"snapshot-000000000005", "part-000000000006"}
    # The version before the last snapshot can still be read, those before the snapshot ahead of it cannot.
    left = {p.name for p in (tmp_path / "t").iterdir()}
    assert left == {"snapshot-000000000002", "snapshot-000000000005", *[f"part-{k:012d}" for k in (3, 4, 5, 6)]}
    upto3 = stats.contact_stats(spark.createDataFrame(rows[:20], EXCHANGES))
    name = F.coalesce("named.name", F.lit("")).alias("name")
    assert _sorted(table.rows(upto=3).withColumn("name", name)) == _sorted(upto3)
    with pytest.raises(ValueError):
        table.rows(upto=1)
    assert _sorted(kept_stats(table)) == _sorted(stats.contact_stats(spark.createDataFrame(rows, EXCHANGES)))


def test_empty_tables(spark, tmp_path):
    table = contact_table(spark, str(tmp_path / "t"))
    assert kept_stats(table).isEmpty() and table.last() == -1
    table.compact()
    table.append(partial_stats(spark.createDataFrame([], EXCHANGES)))
    table.compact()
    assert kept_stats(table).isEmpty()


def test_decisions_compacted_at_any_time_have_the_same_effect(spark, tmp_path):
    draw = random.Random(3)
    contacts = spark.createDataFrame([(f"c{k}", k % 2 == 0) for k in range(8)], "email string, not_spam boolean")
    # Rules that judge otherwise later on.
    others = contacts.withColumn("not_spam", ~F.col("not_spam"))
    filtered = spark.createDataFrame([(f"c{k}", True) for k in range(0, 8, 2)], "email string, not_clear boolean")
    log, all_rows = curation.decision_log(spark, str(tmp_path / "log")), []
    for round_ in range(3):
        rows = [(f"c{draw.randrange(8)}", draw.choice([curation.CLEAR, curation.NOT_HUMAN, curation.RESTORE]), draw.randrange(6)) for _ in range(9)]
        all_rows += rows
        log.append(spark.createDataFrame(rows, curation.LOG))
        if round_ != 1:
            log.compact()
        full = spark.createDataFrame(all_rows, curation.LOG)
        for judged in (contacts, others):
            got = curation.effective(judged, filtered, log.rows())
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, curation.effective(judged, filtered, full).collect()))
    assert log.rows().groupBy("email").count().where("count > 2").isEmpty()
