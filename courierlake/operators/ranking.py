"""Rankings of contacts, composite scores and the Borda merge.

Ranks run over contacts, the aggregate of all messages, by counts of distinct values (see order); totals are
aggregates of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..files import written
from .order import places_of, with_place, with_rank
from .stats import live_rate

#: Metric of each ranking.
METRICS: dict[str, Column | str] = {"sent": "sent", "sent_per_month": "sent_pm", "received": "received", "received_per_month": "received_pm", "duration": "duration", "email_length": "average_chars"}


def competition_ranks(rows: DataFrame, value: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """rows with rank 1, 1, 3: equal values (to nine decimals) share one."""
    return with_rank(rows, F.round(F.col(value), 9), name, descending)


def metric_ranking(contacts: DataFrame, metric: str, descending: bool = True) -> DataFrame:
    """rank, name, email, value of one of METRICS."""
    rates = contacts.withColumns({"sent_pm": live_rate("sent"), "received_pm": live_rate("received")})
    valued = rates.select("name", "email", F.coalesce(F.col(METRICS[metric]).cast("double"), F.lit(0.0)).alias("value"))
    return competition_ranks(valued, "value", descending=descending).select("rank", "name", "email", "value")


def _decimals(number: Column, n: int) -> Column:
    """A number with n decimals and no separators; halves go to the even digit."""
    return F.call_function("format_number", number, F.lit("0." + "0" * n))


def ranking_line(whole: bool) -> Column:
    """The line of a row of a ranking; whole numbers cut, others with two decimals."""
    value = F.col("value").cast("bigint").cast("string") if whole else _decimals(F.col("value"), 2)
    return F.concat(F.col("rank").cast("string"), F.lit(". "), "name", F.lit(" "), "email", F.lit(" "), value)


def ranking_lines(ranking: DataFrame, whole: bool) -> DataFrame:
    """Text lines of a ranking."""
    return ranking.orderBy("rank", "email").select(ranking_line(whole).alias("line"))


def rank_points(rank: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), n - rank + 1)


def composite(contacts: DataFrame, coefficients: dict[str, float] | None = None, meetings: bool = True) -> DataFrame:
    """contacts with score and rankings: weighted points of each ranked metric, and the share of meetings if asked for.

    contacts are written to the shared folder first, as every rank, count and total reads them. Contacts without a value
    of a metric share its last rank.
    """
    coefficients = coefficients or rules.COEFFICIENTS
    contacts = out = written(contacts)
    n = contacts.agg(F.count(F.lit(1))).scalar()
    parts, names = [], []
    for name, weight in coefficients.items():
        # Ranks come from the contacts themselves, not from what has been added to them.
        out = with_rank(out, name, f"rank_{name}", among=contacts)
        out = out.withColumn(f"points_{name}", rank_points(F.col(f"rank_{name}"), n) * F.lit(float(weight)))
        parts.append(F.col(f"points_{name}"))
        names.append(F.struct(F.lit(name).alias("name"), F.col(f"rank_{name}").alias("rank"), F.col(f"points_{name}").alias("points")))
    rankings = F.array(*names)
    if meetings:
        out = out.withColumn("meetings_total", contacts.agg(F.coalesce(F.sum("meetings"), F.lit(0))).scalar())
        bonus = F.when(F.col("meetings_total") > 0, F.col("meetings") / F.col("meetings_total") * rules.MEETINGS_BONUS)
        parts.append(F.coalesce(bonus, F.lit(0.0)))
        rankings = F.when(F.col("meetings_total") > 0, F.array_append(rankings, F.struct(F.lit("meetings").alias("name"), F.lit(0).cast("bigint").alias("rank"), bonus.alias("points")))).otherwise(rankings)
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return out.withColumn("score", score).withColumn("rankings", rankings).select(*contacts.columns, "score", "rankings", *[f"rank_{k}" for k in coefficients])


def composite_ranking(scored: DataFrame) -> DataFrame:
    return competition_ranks(scored, "score").select("rank", "name", "email", "score", "rankings")


def composite_line() -> Column:
    """The line of a row of composite_ranking()."""
    told = F.array_join(F.transform("rankings", lambda r: F.concat(r["name"], F.lit(":#"), r["rank"].cast("string"), F.lit(" ("), _decimals(r["points"], 1), F.lit(")"))), ", ")
    return F.concat(F.col("rank").cast("string"), F.lit(". "), "name", F.lit(" "), "email", F.lit(" | score: "), _decimals(F.col("score"), 1), F.lit(" | "), told)


def composite_lines(ranking: DataFrame) -> DataFrame:
    return ranking.orderBy("rank", "email").select(composite_line().alias("line"))


def ordinal_points(scores: DataFrame, email: str = "email", score: str = "score") -> DataFrame:
    """email (lower case), rank 1..n without ties, Borda points."""
    ranked = with_place(scores.select(F.col(email).alias("given"), F.col(score).alias("score")), "score", "given", "rank").select(F.lower("given").alias("email"), "rank")
    points = F.when(F.col("rank") <= rules.BORDA_WINDOW, F.lit(rules.BORDA_TOP) - 2 * (F.col("rank") - 1)).otherwise(F.lit(0))
    return ranked.withColumn("points", points.cast("double"))


def overall(mail: DataFrame, calendar: DataFrame, top_n: int = rules.BORDA_WINDOW) -> DataFrame:
    """Borda merge of mail(email, name, received, sent, score) and calendar(email, name, score): the top contacts.

    Only the first BORDA_WINDOW of either side have points, so only they, and the same contacts on the other side, are
    looked at: at most twice as many rows, whose places come from one aggregation of each side. Both sides are written
    to the shared folder first, as several steps read them.
    """
    mail, calendar = written(mail.select("email", "name", "received", "sent", "score")), written(calendar.select("email", "name", "score"))
    best = lambda rows: rows.select(F.lower("email").alias("key"), F.col("score"), "email").orderBy(F.desc("score"), "email").limit(rules.BORDA_WINDOW).select("key")
    few = best(mail).unionByName(best(calendar)).distinct()

    def side(rows: DataFrame, weight: float, prefix: str) -> DataFrame:
        shown = rows.join(F.broadcast(few), F.lower("email") == F.col("key")).drop("key")
        placed = places_of(rows, shown, "score", "email", "rank")
        points = F.when(F.col("rank") <= rules.BORDA_WINDOW, F.lit(rules.BORDA_TOP) - 2 * (F.col("rank") - 1)).otherwise(F.lit(0)).cast("double") * weight
        others = [c for c in ("received", "sent") if c in rows.columns]
        return placed.select(F.lower("email").alias("email"), F.col("name").alias(f"{prefix}_name"), *others, F.col("rank").alias(f"{prefix}_rank"), points.alias(f"{prefix}_points"))

    both = side(mail, 1.0, "mail").join(side(calendar, rules.CALENDAR_WEIGHT, "calendar"), "email", "full_outer")
    filled = both.select(
        "email",
        F.coalesce("mail_name", "calendar_name", "email").alias("name"),
        *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("received", "sent")],
        "mail_rank",
        "calendar_rank",
        *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("mail_points", "calendar_points")],
    ).withColumn("total_points", F.col("mail_points") + F.col("calendar_points"))
    return filled.where("total_points > 0").orderBy(F.desc("total_points"), "email").limit(top_n)


def panel_places(scored: DataFrame, query: str = "") -> DataFrame:
    """Places of a list after its search: equal scores share one; colour by order among all. scored is written to the shared folder first."""
    scored = written(scored)
    ordered = with_place(scored, "score", "email", "color").withColumn("color", (F.col("color") - 1) % rules.PALETTE_SIZE)
    found = ordered.where(F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("email"), F.lit(query.lower())))
    return with_rank(found, "score", "place")
