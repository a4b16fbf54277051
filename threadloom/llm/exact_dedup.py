"""Exact dedup through an extendible-hash index on shared files.

1. Entries (key = 64-bit hash of the text, id) are written to the shared folder;
   texts are not moved.  Those of one key are counted before they are shuffled,
   so the index has one line for each key, however many copies there are.
2. The directory doubles while a bucket is overfull: a bucket is a range of keys
   that share their high bits.  It is grown on the driver from counts per prefix,
   some ten numbers for each bucket of ``BUCKET_ENTRIES`` keys.
3. Owner tasks hold consecutive buckets, that is a range of keys, and write their
   part of the index, sorted by key, to a file each.
4. Texts are read for the keys with several entries only.  Each task first
   collapses equal texts, so of a text with any number of copies an owner gets one
   for each task; the owner chains the texts of a key and compares their bytes, so
   documents that merely collide are told apart.

The row with the least id of each text stays.  A key's rows are then marked by a
join on the key alone, and only those of collided keys by their text as well.

Defined cases: a null text equals nothing and stays; empty texts equal each other;
a null id sorts last, so such a row stays only if no copy has an id; repeated rows
(same id and text) count as copies and one stays; a very long text is hashed and
compared whole; an empty table gives an empty one; extra columns pass through
untouched in whatever names they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, maybe_broadcast, pick, stored, unpick

#: Keys a bucket holds before it splits.
BUCKET_ENTRIES = 16_384
#: Keys up to which a join with the documents is a broadcast.
KEY_BROADCAST = 500_000
#: Bytes of distinct texts that a task holds before it hands them to the owners.
COMBINE_BYTES = 32 << 20


class Directory:
    """Extendible-hash directory over key prefixes of ``bits`` bits."""

    def __init__(self, counts: np.ndarray, bits: int, capacity: int):
        self.bits = bits
        self.sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.depth = 0
        self.slots = np.zeros(1, np.int64)
        self.local = [0]
        self.first = [0]  # prefix of each bucket at its own depth
        queue = [(0, 0)]
        while queue:
            bucket, prefix = queue.pop()
            depth = self.local[bucket]
            if depth >= bits or self.entries(prefix, depth) <= capacity:
                continue
            if depth == self.depth:  # the directory doubles
                self.slots = np.repeat(self.slots, 2)
                self.depth += 1
            new = len(self.local)
            self.local[bucket] = depth + 1
            self.local.append(depth + 1)
            self.first[bucket] = prefix << 1
            self.first.append((prefix << 1) | 1)
            width = 1 << (self.depth - depth - 1)
            start = ((prefix << 1) | 1) * width
            self.slots[start : start + width] = new
            queue += [(bucket, prefix << 1), (new, (prefix << 1) | 1)]

    def entries(self, prefix: int, depth: int) -> int:
        width = 1 << (self.bits - depth)
        return int(self.sums[(prefix + 1) * width] - self.sums[prefix * width])

    def owners(self, most: int) -> np.ndarray:
        """The owner of each bucket: consecutive buckets with about as many
        entries go to each of ``most`` owners."""
        order = sorted(range(len(self.local)), key=lambda b: self.first[b] << (self.depth - self.local[b]))
        sizes = np.array([self.entries(self.first[b], self.local[b]) for b in order])
        each = max(1, -(-int(sizes.sum()) // most))
        out = np.zeros(len(order), np.int64)
        out[order] = np.minimum((np.cumsum(sizes) - sizes) // each, most - 1)
        return out

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def _key(text: str, bits: int) -> Column:
    key = F.xxhash64(text)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def _grown(entries: DataFrame, capacity: int, key_bits: int) -> Directory:
    n = entries.count()
    bits = min(key_bits, max(0, int(np.ceil(np.log2(max(1, n / capacity)))) + 3))
    while True:
        prefix = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
        got = entries.groupBy(prefix.alias("p")).count().toArrow()
        counts = np.zeros(1 << bits, np.int64)
        counts[got.column("p").to_numpy()] = got.column("count").to_numpy()
        if counts.max() <= capacity or bits >= key_bits:
            return Directory(counts, bits, capacity)
        bits += 1


def _owned(rows: DataFrame, directory: Directory, owners: int) -> DataFrame:
    """Rows (key, ...) with ``bucket``, in the tasks of their owners, sorted by
    key."""
    of_bucket = directory.owners(owners)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = directory.bucket(b.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(bucket), pa.array(of_bucket[bucket].astype(np.int32))], [*b.schema.names, "bucket", "owner"]
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType()), T.StructField("owner", T.IntegerType())])
    placed = rows.mapInArrow(lean(place), schema).repartitionById(owners, "owner")
    return placed.drop("owner").sortWithinPartitions("key")


def build_index(
    docs: DataFrame, id_col: str, text_col: str, capacity: int = BUCKET_ENTRIES, key_bits: int = 64
) -> tuple[DataFrame, DataFrame, Directory]:
    """The stored entries (key, id); the stored index (key, n, bucket), ``n``
    being the entries of the key; and the directory."""
    chosen = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL")
    thin = stored(chosen.select(_key("text", key_bits).alias("key"), "id"), "exact-entries")
    keys = stored(thin.groupBy("key").agg(F.count("*").alias("n")), "exact-counts")
    directory = _grown(keys, capacity, key_bits)
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return thin, stored(_owned(keys, directory, owners), "exact-index"), directory


def _order(i) -> tuple:
    return (i is None, i if i is not None else 0)


def _combine(size: int):
    """Equal (key, text) of a task become one: the least id, how many rows have
    that id, and how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        count = 0
        schema = None

        def out() -> pa.RecordBatch:
            cols = [[k for k, _ in held], [t for _, t in held], *([v[j] for v in held.values()] for j in range(3))]
            kinds = [pa.int64(), pa.binary(), schema.field("id").type, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "text", "id", "same", "n"])

        for b in batches:
            schema = b.schema
            for k, t, i in zip(b.column("key").to_pylist(), b.column("text"), b.column("id").to_pylist()):
                _merge(held, (k, t.as_buffer().to_pybytes() if len(t.as_py()) else b""), i, 1, 1)
                count += len(t.as_py())
                if count > size:
                    yield out()
                    held.clear()
                    count = 0
        if held:
            yield out()

    return run


def _merge(held: dict, at, i, same: int, n: int) -> None:
    before = held.get(at)
    if before is None:
        held[at] = [i, same, n]
        return
    before[2] += n
    if before[0] == i:
        before[1] += same
    elif _order(i) < _order(before[0]):
        before[0], before[1] = i, same


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key, sorted: its distinct texts with their least id.  A text comes
    back only if its key has another."""
    key, chain = None, {}

    def out(schema: pa.Schema) -> pa.RecordBatch:
        alone = len(chain) == 1
        cols = [[key] * len(chain), [None if alone else t for t in chain], *([v[j] for v in chain.values()] for j in range(3))]
        kinds = [pa.int64(), pa.binary(), schema.field("id").type, pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "text", "kept_id", "same", "n"])

    done: list[pa.RecordBatch] = []
    schema = None
    for b in batches:
        schema = b.schema
        rows = zip(b.column("key").to_pylist(), b.column("text"), *(b.column(c).to_pylist() for c in ("id", "same", "n")))
        for k, t, i, same, n in rows:
            if k != key:
                if chain:
                    done.append(out(schema))
                key, chain = k, {}
                if len(done) >= 1000:
                    yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                    done = []
            _merge(chain, t.as_py(), i, same, n)
    if chain:
        done.append(out(schema))
    if done:
        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]


class Chains:
    """The distinct texts of the keys with several entries: (key, text, kept_id,
    same, n).  ``text`` is null unless the key has more than one; ``same`` rows
    have the id that stays."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, capacity: int, key_bits: int, combine: int):
        self.key_bits = key_bits
        self.thin, index, directory = build_index(docs, id_col, text_col, capacity, key_bits)
        keys = maybe_broadcast(index.where("n > 1").select("key"), KEY_BROADCAST)
        rows = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL")
        rows = rows.select(_key("text", key_bits).alias("key"), "id", F.col("text").cast("binary").alias("text")).join(keys, "key")
        kind = rows.schema["id"].dataType
        fields = [T.StructField("key", T.LongType()), T.StructField("text", T.BinaryType())]
        counts = [T.StructField("same", T.LongType()), T.StructField("n", T.LongType())]
        firsts = rows.mapInArrow(lean(_combine(combine)), T.StructType([*fields, T.StructField("id", kind), *counts]))
        owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chained = _owned(firsts, directory, owners).select("key", "text", "id", "same", "n")
        found = chained.mapInArrow(lean(_chain), T.StructType([*fields, T.StructField("kept_id", kind), *counts]))
        found = stored(found, "exact-chains")
        self.alone = found.where("text IS NULL AND n > 1").select("key", "kept_id", "same")
        self.collided = found.where("text IS NOT NULL").select("key", F.col("text").cast("string").alias("c_text"), "kept_id", "same")
        self.has_collided = not self.collided.isEmpty()


def duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_ENTRIES,
    key_bits: int = 64,
    combine: int = COMBINE_BYTES,
) -> DataFrame:
    """(id, kept_id): every row that is a copy, beside the row that stays."""
    chains = Chains(docs, id_col, text_col, capacity, key_bits, combine)
    other = ~F.col("id").eqNullSafe(F.col("kept_id"))
    rows = chains.thin.join(maybe_broadcast(chains.alone, KEY_BROADCAST), "key").where(other).select("id", "kept_id")
    again = chains.alone.select("kept_id", "same")
    if chains.has_collided:
        whole = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL").withColumn("key", _key("text", key_bits))
        met = whole.join(chains.collided, "key").where((F.col("text") == F.col("c_text")) & other)
        rows = rows.unionByName(met.select("id", "kept_id"))
        again = again.unionByName(chains.collided.select("kept_id", "same"))
    again = again.where("same > 1").select(
        F.col("kept_id").alias("id"), "kept_id", F.explode(F.sequence(F.lit(2).cast("long"), F.col("same"))).alias("copy")
    )
    return rows.unionByName(again.drop("copy")).withColumnRenamed("id", id_col)


def drop_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_ENTRIES,
    key_bits: int = 64,
    combine: int = COMBINE_BYTES,
) -> DataFrame:
    """``docs`` with one row for each text.  Rows whose key has no chain pass
    straight from the scan."""
    chains = Chains(docs, id_col, text_col, capacity, key_bits, combine)
    keyed = pick(docs, row=True, id=id_col, text=text_col).withColumn("key", _key("text", key_bits))
    # xxhash64 of null is a constant, so null texts are taken before the joins
    nulls = keyed.where("text IS NULL").select("row")
    known = keyed.where("text IS NOT NULL")
    stays = F.col("id").eqNullSafe(F.col("kept_id"))
    alone = maybe_broadcast(chains.alone, KEY_BROADCAST)
    keep = known.join(alone, "key", "left").where(F.col("same").isNull() | stays)
    if chains.has_collided:
        keep = keep.join(chains.collided.select("key").distinct(), "key", "left_anti")
    keep = keep.select("row", "key", "text", "same")
    if chains.has_collided:
        met = known.join(chains.collided, "key").where((F.col("text") == F.col("c_text")) & stays)
        keep = keep.unionByName(met.select("row", "key", "text", "same"))
    once = keep.where("same IS NULL OR same = 1").select("row")
    repeated = keep.where("same > 1").dropDuplicates(["key", "text"]).select("row")
    return unpick(once.unionByName(repeated).unionByName(nulls), docs)


ORACLE_SQL = """
    SELECT doc_id, kept_id FROM (
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id
        FROM documents WHERE text IS NOT NULL)
    WHERE doc_id <> kept_id"""
