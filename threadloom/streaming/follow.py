"""Sessions as they are written: a stream over the files of a store.

A file counts again whenever it is new to the stream; stores that rewrite a file
under its name are followed by the batch cache (``operators.incremental``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import Unsupported, get
from ..operators.incremental import Cache
from ..sources.stores import parse


def transcripts(spark: SparkSession, harness: str, root: str, files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame of transcripts, for formats with a file each."""
    fmt = get(harness)
    if fmt.units != "file":
        raise Unsupported(f"a session of {fmt.name} is more than a file")
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    source = source.option("recursiveFileLookup", True).option("pathGlobFilter", fmt.glob).option("maxFilesPerTrigger", files_per_batch)
    rows = source.load(root)
    if getattr(fmt, "skip", None):
        rows = rows.where(~F.col("path").rlike(fmt.skip))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stamp = F.concat_ws(":", F.unix_micros("modificationTime"), "length")
    units = rows.select(
        F.col("path").alias("source"), F.col("modificationTime").alias("mtime"), stamp.alias("fingerprint"),
        F.array(F.struct(name.alias("name"), "content")).alias("files"),
    )
    return parse(units, harness)


def into_cache(rows: DataFrame, cache: Cache, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, once: bool = False):
    """Starts a query that puts each batch into a cache, keyed as the cache is;
    ``once`` stops when what is there has been read."""

    def put(batch: DataFrame, _: int) -> None:
        changed = (prepare or (lambda x: x))(batch).withColumn("cursor", F.coalesce("fingerprint", F.lit(""))).drop("fingerprint")
        cache.upsert(changed)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()
