"""What several operators of this package need: tables in the shared folder, and whole-text conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of this package define it: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys with more than 1/HEAVY of all rows are handled by broadcast; there are at most HEAVY of them.
HEAVY = 1000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves if driver and executors are one process, as in tests; on a
    cluster it would be another folder on each machine, so there the setting has to be made.
    """
    global _own_dir
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not is_one_process(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="courierlake-")
    return _own_dir


def is_one_process(master: str) -> bool:
    """Whether driver and executors are one process: local, local[n], local[n, failures], but no local cluster."""
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    The files go with discard(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/courierlake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = (files, where)
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that no later step reads, so that loops do not pile them up."""
    for table in tables:
        if written := getattr(table, "_written", None):
            written[0].delete(written[1], True)


def unused(columns: list[str], name: str) -> str:
    """name, or a longer one that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def stable_rows(df: DataFrame, label: str) -> DataFrame:
    """df itself if it reads a table, row by row; otherwise df written to the shared folder and read again.

    Operators that number rows in scan order and scan twice need the same order each time. Scans of files keep
    it, whatever columns they read; plans that deal rows out again need not.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-!").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation"} else materialize(df, label)


def text_or_empty(column: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_weighed(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Left or inner join of rows with one fact row per key, where weight says how many of the `total` rows have the key.

    Keys with more than 1/HEAVY of all rows, at most HEAVY of them, come by broadcast; the rest by a shuffle
    in which no key is hot. weight is dropped.
    """
    limit = total / HEAVY
    others = [c for c in facts.columns if c not in (key, weight)]
    heavy = facts.where(F.col(weight) > limit).select(F.col(key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in others])
    light = facts.where(F.col(weight) <= limit).select(F.col(key).alias("__lk"), *others)
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    done = marked.where("__hk is not null").select(*rows.columns, *[F.col(f"__h_{c}").alias(c) for c in others])
    open_rows = marked.where("__hk is null").select(*rows.columns)
    return done.unionByName(open_rows.join(light, F.col(key) == F.col("__lk"), how).drop("__lk"))
