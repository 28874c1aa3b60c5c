"""Ranks and numbers of all rows of a table without sorting it in one task.

Ranks by a number: rows are counted by distinct value, and the distinct values fall into ranges whose splitters come
from a quantile sketch of them, so the ranges follow any distribution. Sums of ranges add up in one small table, values
inside a range in a window, and the rows find the rank of their value by a join, which adaptive execution splits where
many rows share a value.

Numbers in an order that tells all rows apart: the rows are dealt out by ranges of the whole order, ties included, so
rows that are equal but for their last key are split like any others; each range is numbered from the sum of the ranges
before it.

Null values come after all others, whatever the direction, and share a rank; null ties come last among equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..files import written

#: Ranges of distinct values, and the sketch's accuracy: a range has at most about a hundredth of all.
RANGES = 256
ACCURACY = 10_000

#: Rows that a partition of dealt() has on average, and the share of all rows, 1/HEAVY, from which a key is broadcast.
PART_ROWS = 250_000
HEAVY = 1000


def _own(columns: list[str], *names: str) -> list[str]:
    """The names, each longer where a column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """rows dealt out by keys, to as many partitions as `total` rows ask for, so that a task's share does not grow with the data.

    The session's number of partitions knows nothing of the input, and small partitions are put together up to a size in
    compressed bytes, of which a task that sorts or hashes needs many times as much.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-total // PART_ROWS)), *keys)


def join_dealt(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with one fact row per key, where weight says how many of the `total` rows have the key.

    Keys with more than 1/HEAVY of all rows, at most HEAVY of them, come by broadcast; all others are dealt out.
    """
    heavy, light = facts.where(F.col(weight) > total / HEAVY), facts.where(F.col(weight) <= total / HEAVY)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(dealt(others, total, key).join(dealt(light, total, key), key))


def with_rank(rows: DataFrame, value: Column | str, name: str, descending: bool = True, among: DataFrame | None = None) -> DataFrame:
    """rows with their competition rank (1, 1, 3) by a number. among: a table with the same values, if rows is costly to read twice.

    Rows with a null value stay and share the last rank. A column called `name` is replaced.
    """
    own, v, n, r, rank = _own([*rows.columns, name, *(among.columns if among is not None else [])], "__own", "__v", "__n", "__r", "__rank")
    # The key grows in the order of ranks; zero has one sign.
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    key = (-number if descending else number) + 0.0
    counts = (rows if among is None else among).select(key.alias(v)).groupBy(v).agg(F.count(F.lit(1)).alias(n))
    splitters = counts.agg(F.percentile_approx(v, [k / RANGES for k in range(1, RANGES)], ACCURACY)).scalar()
    # A null key gets the range after all others.
    place = F.when(F.col(v).isNull(), F.lit(RANGES)).otherwise(F.size(F.filter(f"{r}a", lambda s: s < F.col(v))))
    counts = counts.withColumn(f"{r}a", F.coalesce(splitters, F.array().cast("array<double>"))).select(v, n, place.alias(r))
    sums = counts.groupBy(F.col(r).alias(f"{r}s")).agg(F.sum(n).alias(f"{n}s"))
    ahead = Window.orderBy(f"{r}s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(f"{r}s", F.coalesce(F.sum(f"{n}s").over(ahead), F.lit(0)).alias(f"{n}s"))
    inside = Window.partitionBy(r).orderBy(F.asc_nulls_last(v)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(n, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    ranks = ranks.join(F.broadcast(sums), F.col(r) == F.col(f"{r}s")).select(v, (F.col(f"{n}s") + F.col(n) + 1).cast("bigint").alias(rank))
    found = rows.withColumn(own, key).join(ranks, F.col(own).eqNullSafe(F.col(v)))
    return found.select(*[c for c in rows.columns if c != name], F.col(rank).alias(name))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """rows numbered 1, 2, 3 in each group of `by`, in an order that tells the rows of a group apart.

    No group has to fit a task. The rows are written to the shared folder once, as ranges are drawn from them.
    """
    (part,) = _own([*rows.columns, name], "__part")
    before, many = f"{part}b", f"{part}n"
    ranged = written(rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(*by, part).agg(F.count(F.lit(1)).alias(many))
    along = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"{part}_{k}") for k, c in enumerate(by)], F.col(part).alias(f"{part}s"), F.coalesce(F.sum(many).over(along), F.lit(0)).alias(before))
    same = F.col(part) == F.col(f"{part}s")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"{part}_{k}"))
    own = ranged.withColumn(many, F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)))
    return own.join(starts, same).select(*[c for c in rows.columns if c != name], (F.col(before) + F.col(many)).cast("bigint").alias(name))


def with_place(rows: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """rows numbered 1, 2, 3 by descending number, equal ones by a text. Null numbers and null texts come last."""
    (own,) = _own([*rows.columns, name], "__own")
    placed = numbered(rows.withColumn(own, F.col(value).cast("double") + 0.0), [], [F.desc_nulls_last(own), F.asc_nulls_last(tie)], name)
    return placed.select(*[c for c in rows.columns if c != name], name)


def places_of(rows: DataFrame, wanted: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """The places that with_place() gives to the few rows of wanted(value, tie), found in one aggregation of rows.

    wanted has to be small: its keys go to all tasks as one array.
    """
    key = F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t"))
    keys = wanted.agg(F.array_sort(F.collect_set(key))).scalar()
    # A row stands before all wanted rows that no more wanted rows precede.
    ahead = rows.select(key.alias("own"), keys.alias("keys")).select(F.size(F.filter("keys", lambda k: k < F.col("own"))).alias("j"))
    counts = ahead.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(F.collect_list(F.struct("j", "n"))).scalar()
    told = wanted.withColumns({"__keys": keys, "__sums": sums}).withColumn("__j", F.array_position("__keys", key) - 1)
    place = F.aggregate(F.filter("__sums", lambda s: s["j"] <= F.col("__j")), F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    return told.withColumn(name, place).drop("__keys", "__sums", "__j")


def paged(rows: DataFrame, key: str, value: str, size: int = 10_000) -> DataFrame:
    """key, page (0, 1, 2) and values: the values of each key in order, at most `size` a row, so that no row grows with the data."""
    listed = numbered(rows.select(key, value), [key], [F.asc_nulls_last(value)], "n_")
    page = F.floor((F.col("n_") - 1) / size).cast("bigint")
    return listed.groupBy(key, page.alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_", value))), lambda x: x[value]).alias("values"))
