"""Tables that grow by small parts: a log of parts, and now and then a snapshot of all parts so far.

Everything is Parquet in one folder. A part or snapshot counts from the moment its write has been completed, so readers
see a part whole or not at all, and a write that broke off is written again. One writer at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class FoldedTable:
    """Rows of `schema` in the folder `path`, brought to their least form by `fold`.

    fold(a + b) has to be fold(fold(a) + fold(b)): sums, extremes and last values by key are. Then a snapshot stands for
    the parts that it was made of, and reads cost one snapshot and the parts since.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.fold = spark, path.rstrip("/"), schema, fold
        self._at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self) -> dict[str, list[int]]:
        """Numbers of the complete parts and snapshots, in order."""
        found: dict[str, list[int]] = {"part": [], "snapshot": []}
        if self._files.exists(self._at):
            for x in self._files.listStatus(self._at):
                named = re.fullmatch(r"(part|snapshot)-(\d+)", x.getPath().getName())
                if named and self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")):
                    found[named[1]].append(int(named[2]))
        return {kind: sorted(numbers) for kind, numbers in found.items()}

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number:012d}"

    def last(self) -> int:
        """Number of the last part, -1 before the first."""
        return max([-1, *(n for numbers in self._complete().values() for n in numbers)])

    def append(self, rows: DataFrame, part: int | None = None) -> int:
        """Adds a part, the next one if it has no number, and returns its number. A part that is there already is not written again."""
        found = self._complete()
        number = self.last() + 1 if part is None else part
        if number not in found["part"] and number > max([-1, *found["snapshot"]]):
            self.fold(rows).select(*self._names()).write.mode("overwrite").parquet(self._folder("part", number))
        return number

    def _names(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _stored(self, upto: int) -> DataFrame:
        found = self._complete()
        base = max([-1, *(n for n in found["snapshot"] if n <= upto)])
        folders = [self._folder("snapshot", base)] if base >= 0 else []
        folders += [self._folder("part", n) for n in found["part"] if base < n <= upto]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self, upto: int | None = None) -> DataFrame:
        """The table after all parts, or after those up to one that is not before oldest()."""
        if upto is not None and upto < self.oldest():
            raise ValueError(f"parts up to {upto} have been put together with later ones")
        return self.fold(self._stored(self.last() if upto is None else upto))

    def oldest(self) -> int:
        """The first part after which the table can still be read: parts before the last snapshot but one go with compact()."""
        found = self._complete()
        first = min(found["snapshot"], default=-1)
        return first if first >= 0 and not any(n <= first for n in found["part"]) else min(found["part"], default=-1)

    def compact(self) -> None:
        """Writes a snapshot of all parts. Those of the snapshot before it stay for readers that are at work; what only earlier ones needed goes."""
        found, last = self._complete(), self.last()
        before = max([-1, *found["snapshot"]])
        if last == before:
            return
        self.rows().write.mode("overwrite").parquet(self._folder("snapshot", last))
        for kind, numbers in found.items():
            for n in numbers:
                if n < before or (kind == "part" and n == before):
                    self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(kind, n)), True)
