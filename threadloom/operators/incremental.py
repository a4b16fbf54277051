"""Fingerprints and the cache of what was read before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def file_fingerprints(files: DataFrame) -> DataFrame:
    """(path, cursor) of a frame with file ``_metadata``: time and size."""
    m = F.col("_metadata")
    rows = files.select(m["file_path"].alias("path"), F.concat_ws(":", F.unix_micros(m["file_modification_time"]), m["file_size"]).alias("cursor"))
    return rows.distinct()


def latest_cursor(parents: DataFrame, children: DataFrame, key: str, time: str) -> DataFrame:
    """The greatest time of each parent's children, 0 where there is none."""
    most = children.groupBy(key).agg(F.max(time).alias("cursor"))
    return parents.join(most, key, "left").select(key, F.coalesce("cursor", F.lit(0).cast("bigint")).alias("cursor"))


def cache_hits(live: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Cached rows whose cursor is known and unchanged."""
    return cache.join(live.where("cursor <> ''").select(*key, "cursor"), [*key, "cursor"], "left_semi")


def cache_misses(live: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Live rows that must be read: new, changed, or of an unknown cursor."""
    return live.join(cache.where("cursor <> ''").select(*key, "cursor"), [*key, "cursor"], "left_anti")


def cache_prune(cache: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Cached rows that are still live, whatever a caller's filter."""
    return cache.join(live.select(*key).distinct(), key, "left_semi")


def cache_current(cache: DataFrame, version: str) -> DataFrame:
    return cache.where(F.col("writer_version") == version)


class Cache:
    """A cache of what was read from sessions, in a folder that all machines reach.

    Writes only add: a generation is a table of changed rows, and of a key the rows
    of its last generation count.  ``compact`` leaves one generation.  Rows of another
    ``version`` of the writer don't count, so a new version begins empty.  ``rows`` have
    the key columns, ``cursor`` and whatever is kept."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], version: str):
        self.spark, self.folder, self.key, self.version = spark, folder.rstrip("/"), key, version

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def generations(self) -> list[str]:
        """Complete generations, oldest first; one whose writer died is no table."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [str(f.getPath().getName()) for f in fs.listStatus(path)]
        return sorted(n for n in names if n.startswith("g") and fs.exists(Path(f"{self.folder}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """Current rows, or None if nothing was ever written."""
        names = self.generations()
        if not names:
            return None
        # a generation may lack a column that a later one has
        parts = [self.spark.read.parquet(f"{self.folder}/{n}").withColumn("_g", F.lit(i)) for i, n in enumerate(names)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        last = F.max("_g").over(Window.partitionBy(*self.key))
        return cache_current(rows.withColumn("_last", last).where("_g = _last").drop("_g", "_last"), self.version).drop("writer_version")

    def lookup(self, live: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """Rows that can be used, and the live rows that have to be read."""
        rows = self.read()
        if rows is None:
            return None, live
        return cache_hits(live, rows, self.key), cache_misses(live, rows, self.key)

    def _write(self, rows: DataFrame) -> str:
        names = self.generations()
        n = int(names[-1][1:9]) + 1 if names else 0
        name = f"g{n:08d}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("writer_version", F.lit(self.version)).write.parquet(f"{self.folder}/{name}")
        return name

    def upsert(self, rows: DataFrame) -> None:
        """Adds or replaces whole keys; either all rows count afterwards or none."""
        self._write(rows)

    def compact(self, live: DataFrame | None = None) -> None:
        """One generation of the current rows, of keys in ``live`` if given, whatever
        a caller's filter on what is listed."""
        rows, names = self.read(), self.generations()
        if rows is None:
            return
        self._write(rows if live is None else cache_prune(rows, live, self.key))
        fs, _ = self._fs()
        for n in names:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}"), True)
