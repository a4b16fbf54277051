"""Best-fit-decreasing packing of documents into context windows.

A document longer than the window is first cut into full windows; its rest is
packed with the others.  Best fit depends on lengths alone, so the plan is made
from the exact length histogram (at most ``window`` rows whatever the corpus):
pieces of one length are placed together, longest first, each into the open
window with the least sufficient room, which a segment tree indexed by
remaining capacity finds.  The plan says which ranks of a length go to which
windows; ranks are counted in parallel, and one join by length applies it.  The
result is that of the one-by-one method over the whole corpus, not per shard.

Defined cases: documents with a null text and empty ones take no space and are
left out; those with a null id are packed with ``unknown``, as segments with a
null doc_id, and else left out; pieces of equal length (ties) rank by bucket of
the id's hash and then id; rows with repeated ids each get a place, and each of
their full cuts a window of its own; a very long document gives as many full
windows as it has, made by a generator and never held together; an empty table
gives no windows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZERS, maybe_broadcast, stored, with_length

WINDOW = 2048
#: Ranks within a length are counted in buckets of the id's hash: so many at
#: least, and one for so many pieces.
BUCKETS = 32
BUCKET_ROWS = 1 << 20
#: The plan has a few rows per length; beyond this it is joined by a shuffle.
PLAN_BROADCAST = 500_000


class CapacityTree:
    """Segment tree over remaining capacities; a leaf holds whether windows
    with that room are open."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = bytearray(2 * self.size)

    def set(self, room: int, on: bool) -> None:
        i = room + self.size
        self.any[i] = on
        i //= 2
        while i:
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` with an open window."""
        i = need + self.size
        if i >= 2 * self.size:
            return None
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first window, per window, offset): rank
    ``r`` goes to window ``first + (r - first rank) // per window``.  Windows
    of equal room are kept as runs of numbers, so the work follows the number
    of distinct lengths and never that of documents."""
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    steps: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(room: int, lo: int, hi: int) -> None:
        if room and lo < hi:
            open_[room].append((lo, hi))
            tree.set(room, True)

    for length in sorted((x for x in histogram if 0 < x <= window), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                lo, hi = made, made + -(-left // each)
                made = hi
            else:
                lo, hi = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
                each = room // length
            # a window is tighter once it has taken one, so it takes all it can
            full = min(hi - lo, left // each)
            if full:
                steps.append((length, rank, rank + full * each, lo, each, window - room))
                rank += full * each
                left -= full * each
                put(room - each * length, lo, lo + full)
                lo += full
            if lo < hi and 0 < left < each:
                steps.append((length, rank, rank + left, lo, left, window - room))
                put(room - left * length, lo, lo + 1)
                left, lo = 0, lo + 1
            put(room, lo, hi)
    return steps


def pieces(lengths: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Full windows cut from overlong documents, and what is left to pack.  Rows
    with a null id need a ``row`` that tells them apart, or are left out."""
    if "row" not in lengths.columns:
        lengths = lengths.where(F.col("id").isNotNull()).withColumn("row", F.lit(None).cast("long"))
    lengths = lengths.where(F.col("n") > 0)
    full = lengths.where(F.col("n") >= window).select(
        "id",
        "row",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / window) - 1)).alias("cut"),
    )
    full = full.select("id", "row", (F.col("cut") * window).alias("start"), F.lit(window).cast("long").alias("len"))
    rest = lengths.select(
        "id", "row", (F.floor(F.col("n") / window) * window).alias("start"), (F.col("n") % window).alias("len")
    ).where("len > 0")
    return full, rest


def pack_lengths(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows from (id, n) and perhaps ``row``: ``window_id, n_docs, used, segments``, segments
    being an array of (doc_id, start, len, offset) in order of offset.  Numbers
    of packed windows are >= 0 and without gaps; full cuts are numbered from -1
    down, with gaps and never twice."""
    spark = lengths.sparkSession
    full, rest = pieces(lengths, window)
    buckets = max(BUCKETS, -(-rest.count() // BUCKET_ROWS))
    rest = rest.withColumn("b", F.pmod(F.xxhash64("id", "row"), F.lit(buckets)).cast("int"))
    counts = rest.groupBy("len", "b").agg(F.count("*").alias("n"))
    counts = stored(counts, "packing-counts")  # at most window x buckets rows
    histogram = {r[0]: r[1] for r in counts.groupBy("len").agg(F.sum("n")).collect()}
    steps = spark.createDataFrame(
        plan(histogram, window),
        "p_len bigint, r0 bigint, r1 bigint, w0 bigint, each bigint, off bigint",
    )
    before = Window.partitionBy("len").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("len", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("len", "b").orderBy("id", "start", "row")
    ranked = rest.withColumn("local", F.row_number().over(local) - 1).join(
        maybe_broadcast(base, PLAN_BROADCAST), ["len", "b"]
    )
    ranked = ranked.withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.join(
        maybe_broadcast(steps, PLAN_BROADCAST),
        (F.col("len") == F.col("p_len")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1")),
    )
    at = F.col("rank") - F.col("r0")
    placed = placed.select(
        (F.col("w0") + F.floor(at / F.col("each"))).alias("window_id"),
        F.struct(
            (F.col("off") + (at % F.col("each")) * F.col("len")).alias("offset"),
            F.col("id").alias("doc_id"), "start", "len",
        ).alias("s"),
    )
    packed = placed.groupBy("window_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    cuts = full.select(
        (-1 - F.monotonically_increasing_id()).alias("window_id"),
        F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.col("id").alias("doc_id"), "start", "len")).alias("s"),
    )
    return packed.unionByName(cuts).select(
        "window_id",
        F.size("s").cast("long").alias("n_docs"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["len"]).alias("used"),
        F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["len"].alias("len"), x["offset"].alias("offset"))).alias("segments"),
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tokenizer: str = "byte_bpe_50k.tiktoken",
    folder: str = TOKENIZERS,
    unknown: bool = False,
) -> DataFrame:
    """Packs whole documents by their exact encoded length, those with a null id
    only if ``unknown``.  Texts are encoded once; what is stored and shuffled
    after that is (id, length)."""
    lengths = with_length(docs, text_col, tokenizer, folder, {"id": id_col})
    chosen = [F.col("id"), F.col("n_tokens").alias("n")]
    if unknown:
        chosen.append(F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("row"))
    lengths = stored(lengths.select(*chosen), "packing-lengths")
    return pack_lengths(lengths, window)
