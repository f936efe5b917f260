"""Keyed totals kept as batches of partial aggregates, folded together in levels.

A batch adds one folder with the partial aggregates of its own keys, so its cost
follows the batch. When a level has ``FAN`` folders they are merged into one of the
next level; after n batches a reader meets at most ``FAN - 1`` folders on each of
about log n levels. A version lists the folders that hold the table: it is written
after them, and readers take the newest, so they never see half a merge. A batch that is
run again writes the same folders and version over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 4


class Levels:
    """``keys`` identify a row; ``merge`` gives each column from the partial columns of the same names."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], merge: Mapping[str, Column], fan: int = FAN):
        self.spark, self.path, self.keys, self.merge, self.fan = spark, path, list(keys), dict(merge), fan

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str = "") -> list[str]:
        files, place = self._files()
        inner = self.spark._jvm.org.apache.hadoop.fs.Path(place, folder) if folder else place
        return sorted(s.getPath().getName() for s in files.listStatus(inner)) if files.exists(inner) else []

    def version(self) -> tuple[int, list[str]]:
        """Number and folders of the newest version; -1 and none before the first batch."""
        names = [n for n in self._names("versions") if n.isdigit()]
        if not names:
            return -1, []
        rows = self.spark.read.parquet(f"{self.path}/versions/{names[-1]}").collect()  # one short row
        return int(names[-1]), list(rows[0]["folders"])

    def _write_version(self, number: int, folders: Sequence[str]) -> None:
        """Written beside the versions and then moved there, which makes it visible at once."""
        files, place = self._files()
        of = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(place, name)
        made = f"{self.path}/made/{number:012d}"
        self.spark.createDataFrame([(list(folders),)], "folders array<string>").coalesce(1).write.mode("overwrite").parquet(made)
        files.mkdirs(of("versions"))
        files.delete(of(f"versions/{number:012d}"), True)
        files.rename(of(f"made/{number:012d}"), of(f"versions/{number:012d}"))

    def _merged(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in self.merge.items()])

    def add(self, partial: DataFrame, number: int) -> None:
        """Add a batch of partial aggregates; older batch numbers than the newest version's are known already."""
        newest, folders = self.version()
        if number <= newest:
            return
        own = f"0/{number:012d}"
        kind = self._merged(partial).schema  # of all folders: a sum is wider than what it adds

        def typed(df: DataFrame) -> DataFrame:
            return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind])

        typed(partial).write.mode("overwrite").parquet(f"{self.path}/{own}")
        folders, gone = [*folders, own], []
        level = 0
        while len(full := [f for f in folders if f.startswith(f"{level}/")]) >= self.fan:
            made = f"{level + 1}/{number:012d}"
            typed(self._merged(self.spark.read.parquet(*[f"{self.path}/{f}" for f in full]))).write.mode("overwrite").parquet(f"{self.path}/{made}")
            folders = [f for f in folders if f not in full] + [made]
            gone += full
            level += 1
        self._write_version(number, folders)
        self._forget(number, folders)

    def _forget(self, number: int, live: Sequence[str]) -> None:
        """Delete versions before the last two, and folders that neither of these lists."""
        files, place = self._files()
        of = lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(place, name)
        versions = [n for n in self._names("versions") if n.isdigit()]
        used = set(live)
        for name in versions[-2:]:
            used |= set(self.spark.read.parquet(f"{self.path}/versions/{name}").collect()[0]["folders"])
        for name in versions[:-2]:
            files.delete(of(f"versions/{name}"), True)
        for level in [n for n in self._names() if n.isdigit()]:
            for name in self._names(level):
                if f"{level}/{name}" not in used and int(name) <= number:
                    files.delete(of(f"{level}/{name}"), True)

    def read(self) -> DataFrame | None:
        """The table; None before the first batch."""
        _, folders = self.version()
        return self._merged(self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])) if folders else None
