"""Ranking reports as ordered text: a line for each contact, one report a metric and the composite one."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..files import written
from ..operators import ranking

#: Metrics shown as whole numbers; the others have two decimals.
WHOLE = ("sent", "received")


def _plain(number: float) -> str:
    """A number without needless decimals or exponents."""
    return format(Decimal(repr(float(number))).normalize(), "f")


def header_lines(coefficients: dict[str, float], contacts: int | str) -> list[str]:
    """What precedes the composite ranking."""
    # The text of the header.
    return [
        "# Composite Contact Ranking",
        "# Rankings used:",
        *[f"#   - {name} (coefficient: {_plain(weight)})" for name, weight in coefficients.items()],
        "#",
        "# Score formula: sum of (n - rank + 1) * coefficient for each ranking",
        f"# where n = total number of contacts ({contacts})",
        "#",
        "",
    ]


def report_lines(contacts: DataFrame, coefficients: dict[str, float] | None = None) -> DataFrame:
    """report, rank, nth, email, line: all reports; by rank, nth and email the lines of one are in order.

    Header lines have rank 0 and their number, contacts rank 1 on and nth 0. contacts are written to the shared folder
    first, as each report reads them; a missing name is empty.
    """
    coefficients = coefficients or rules.COEFFICIENTS
    contacts = written(contacts.withColumn("name", F.coalesce("name", F.lit(""))))
    nth = F.lit(0).alias("nth")
    out = None
    for metric in ranking.METRICS:
        ranked = ranking.metric_ranking(contacts, metric)
        rows = ranked.select(F.lit(f"{metric}_ranking").alias("report"), "rank", nth, "email", ranking.ranking_line(metric in WHOLE).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    scored = ranking.composite_ranking(ranking.composite(contacts, coefficients, meetings=False))
    name = F.lit("composite_ranking").alias("report")
    rows = scored.select(name, "rank", nth, "email", ranking.composite_line().alias("line"))
    # The number of contacts stands in for the mark that the lines are made with.
    mark = "\u0000"
    counted = contacts.agg(F.count(F.lit(1)).cast("string").alias("n"))
    told = counted.select("n", F.posexplode(F.array(*map(F.lit, header_lines(coefficients, mark)))).alias("pos", "text"))
    head = told.select(name, F.lit(0).cast("bigint").alias("rank"), (F.col("pos") + 1).alias("nth"), F.lit("").alias("email"), F.replace("text", F.lit(mark), F.col("n")).alias("line"))
    return out.unionByName(rows).unionByName(head)


def write_reports(contacts: DataFrame, path: str, coefficients: dict[str, float] | None = None) -> None:
    """All reports as text in path/report=NAME, written by one job.

    Files of a report are in order of their names, and so are the lines in them: put together they are the report. No task
    sorts or writes a report alone: lines are dealt out by ranges of the whole order.
    """
    order = ["report", "rank", "nth", "email"]
    rows = written(report_lines(contacts, coefficients))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("report", "line").write.partitionBy("report").text(path)
