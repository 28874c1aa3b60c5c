"""Calls of an external client: how many at once, none lost, time-outs, retries."""

import os
import time
import uuid

from courierlake.operators import classify


def _people(spark, n, parts):
    rows = spark.range(n).selectExpr("concat('P', id) as name", "concat('p', id, '@x.example') as email")
    return rows.repartition(parts) if parts > 1 else rows.coalesce(1)


def _counting(folder, hold=0.02, answer=None):
    """A client that notes how many calls run while it runs, over all processes."""

    def client(text):
        own = os.path.join(folder, "run-" + uuid.uuid4().hex)
        open(own, "w").close()
        now = len([f for f in os.listdir(folder) if f.startswith("run-")])
        n = text.count("@x.example")
        open(os.path.join(folder, f"seen-{now}-{n}-{uuid.uuid4().hex}"), "w").close()
        time.sleep(hold)
        os.remove(own)
        return answer(n) if answer else ",".join("1" * n)

    return client


def _seen(folder):
    return [tuple(int(x) for x in f.split("-")[1:3]) for f in os.listdir(folder) if f.startswith("seen-")]


def test_at_most_so_many_calls_and_no_batch_lost(spark, tmp_path):
    for k, (n, parts, at_once) in enumerate([(430, 7, 4), (430, 1, 4), (120, 5, 3), (90, 3, 1)]):
        folder = tmp_path / str(k)
        folder.mkdir()
        votes = classify.collect_votes(_people(spark, n, parts), _counting(str(folder)), at_once=at_once, delay=0.0)
        assert votes.count() == 4 * n and votes.select("email").distinct().count() == n
        assert {r["cls"] for r in classify.unanimous(votes).collect()} == {1}
        seen = _seen(folder)
        assert max(now for now, _ in seen) <= at_once
        if at_once > 1:
            assert max(now for now, _ in seen) > 1
        # Full batches, but for the last one of each task.
        assert sum(size for _, size in seen) == 4 * n and sum(size < classify.BATCH for _, size in seen) <= 4 * at_once


def test_batches_fill_over_arrow_batches(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        classify.collect_votes(_people(spark, 100, 1), _counting(str(tmp_path), 0.0), delay=0.0).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {size for _, size in _seen(tmp_path)} == {50}


def test_calls_are_made_once(spark, tmp_path):
    votes = classify.collect_votes(_people(spark, 60, 2), _counting(str(tmp_path), 0.0), delay=0.0)
    made = len(_seen(tmp_path))
    assert votes.count() == votes.count() == 240
    assert len(_seen(tmp_path)) == made


def test_late_answers_fail_and_give_up_their_place(spark, tmp_path):
    def client(text):
        first = tmp_path / "first"
        try:
            first.touch(exist_ok=False)
        except FileExistsError:
            return "1" * 3
        time.sleep(30)
        return "0" * 3

    began = time.perf_counter()
    votes = classify.collect_votes(_people(spark, 3, 1), client, at_once=1, delay=0.0, timeout=0.5)
    assert time.perf_counter() - began < 25
    assert {(r["email"], r["cls"]) for r in classify.unanimous(votes).collect()} == {(f"p{k}@x.example", 1) for k in range(3)}


def test_incomplete_answers_are_asked_for_again(spark, tmp_path):
    votes = classify.collect_votes(_people(spark, 2, 1), _counting(str(tmp_path), 0.0, lambda n: "1"), delay=0.0)
    assert votes.isEmpty()
    # 20 attempts at a vote, each with two retries.
    assert len(_seen(tmp_path)) == classify.MAX_ATTEMPTS * (classify.RETRIES + 1)


def test_delay_keeps_the_place(spark, tmp_path):
    began = time.perf_counter()
    classify.collect_votes(_people(spark, 50, 1), _counting(str(tmp_path), 0.0), at_once=1, delay=0.3)
    assert time.perf_counter() - began >= 4 * 0.3


def test_no_contacts(spark, tmp_path):
    assert classify.collect_votes(_people(spark, 0, 1), _counting(str(tmp_path)), delay=0.0).isEmpty()
    assert not _seen(tmp_path)
