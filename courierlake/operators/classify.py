"""Optional classification of contacts by an external model: off unless a client is passed in.

The client is a picklable callable from a prompt to an answer. Batches of contacts are voted on independently; all tasks
together hold at most as many calls at once as asked for.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import written

VOTES, RETRIES, MAX_ATTEMPTS, BATCH = 4, 2, 20, 50
AT_ONCE, DELAY, TIMEOUT = 4, 0.2, 120.0


def prompt(rows: list[tuple[str, str]]) -> str:
    listed = "\n".join(f"{i}. {name} <{email}>" for i, (name, email) in enumerate(rows, 1))
    return f"For each of the {len(rows)} senders below answer 1 for a person and 0 for an automated sender, digits only, in order.\n{listed}"


def parse_answer(text: str, n: int) -> list[int] | None:
    """The first n digits 0 or 1, None if there are fewer."""
    digits = [int(c) for c in text if c in "01"][:n]
    return digits if len(digits) == n else None


def _within(seconds: float, client: Callable[[str], str], text: str) -> str | None:
    """The client's answer; None for an error, and for an answer that takes longer, which is no longer waited for."""
    box: queue.SimpleQueue[str | None] = queue.SimpleQueue()

    def call() -> None:
        try:
            box.put(client(text))
        except Exception:  # noqa: BLE001  whatever the client raises is an attempt that failed
            box.put(None)

    threading.Thread(target=call, daemon=True).start()
    try:
        return box.get(timeout=seconds)
    except queue.Empty:
        return None


@dataclass
class _Batch:
    rows: list[tuple[str, str]]
    votes: list[list[int]] = field(default_factory=list)
    attempts: int = 0
    running: int = 0


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[_Batch]:
    """Full batches whatever the frames' lengths; only the last may be shorter."""
    rows: list[tuple[str, str]] = []
    for frame in frames:
        rows += zip(frame["name"], frame["email"], strict=True)
        while len(rows) >= size:
            yield _Batch(rows[:size])
            rows = rows[size:]
    if rows:
        yield _Batch(rows)


def collect_votes(contacts: DataFrame, client: Callable[[str], str], at_once: int = AT_ONCE, delay: float = DELAY, timeout: float = TIMEOUT, batch: int = BATCH) -> DataFrame:
    """email, vote_no, vote: VOTES complete answers a batch of contacts(name, email); none for a batch that does not reach them.

    at_once: most calls at a time over all tasks, of which each task has its share. delay: seconds that a call keeps its
    place after its answer. timeout: seconds until a call counts as failed and gives up its place. A vote whose answer is
    incomplete is asked for again, RETRIES times; after an error or a time-out it has failed. A batch asks for the votes
    that it lacks, all at once, until it has them or has made MAX_ATTEMPTS.

    All calls are made when this function runs, as its result is a table in the shared folder: no later action repeats
    them. A task that is run again, after an executor's loss or by speculation, does repeat its own.
    """
    if at_once < 1:
        raise ValueError("at least one call at a time is needed")
    # As a table, contacts have been computed by all cores before few tasks read them.
    listed = written(contacts.select("name", "email")).coalesce(at_once)
    tasks = listed.rdd.getNumPartitions()

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        share = at_once // tasks + (TaskContext.get().partitionId() < at_once % tasks)

        def one(rows: list[tuple[str, str]]) -> list[int] | None:
            for _ in range(RETRIES + 1):
                text = _within(timeout, client, prompt(rows))
                if text is None:
                    return None
                time.sleep(delay)
                if (answer := parse_answer(text, len(rows))) is not None:
                    return answer
            return None

        coming = _batches(frames, batch)
        asked: dict[Future, _Batch] = {}
        with ThreadPoolExecutor(share) as pool:

            def ask(b: _Batch) -> None:
                b.running = VOTES - len(b.votes)
                b.attempts += b.running
                for _ in range(b.running):
                    asked[pool.submit(one, b.rows)] = b

            while True:
                # One batch has a vote for each place at least; as many as places are kept open, no more are read.
                while len({id(b) for b in asked.values()}) < share and (b := next(coming, None)) is not None:
                    ask(b)
                if not asked:
                    return
                for done in wait(asked, return_when=FIRST_COMPLETED).done:
                    b = asked.pop(done)
                    b.running -= 1
                    if (answer := done.result()) is not None:
                        b.votes.append(answer)
                    if b.running:
                        continue
                    if len(b.votes) < VOTES and b.attempts < MAX_ATTEMPTS:
                        ask(b)
                    elif len(b.votes) == VOTES:
                        told = [(email, k, v) for k, votes in enumerate(b.votes) for (_, email), v in zip(b.rows, votes, strict=True)]
                        yield pd.DataFrame(told, columns=["email", "vote_no", "vote"])

    return written(listed.mapInPandas(vote, "email string, vote_no int, vote int"))


def unanimous(votes: DataFrame) -> DataFrame:
    """email, cls: 0 or 1 if all VOTES agree, 2 otherwise."""
    agreed = F.when((F.count(F.lit(1)) == VOTES) & (F.min("vote") == F.max("vote")), F.min("vote")).otherwise(F.lit(2))
    return votes.groupBy("email").agg(agreed.cast("int").alias("cls"))
