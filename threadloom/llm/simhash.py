"""SimHash near-dedup by pigeonhole blocks in two levels.

A document's features are its distinct lower-cased words.  Each feature's hash
picks a row of a fixed random bit table, and every bit of the 512-bit fingerprint
is the weighted majority over the features; a word of four letters or more has
``LONG_WEIGHT`` times the weight of a shorter one.

The fingerprint is split into blocks, and fingerprints that share a block form a
group.  Within a group the other bits are split into blocks again (longer ones in
a larger group, so that few unrelated rows meet), and rows that share one are
verified by Hamming distance.  There are ``TABLES`` disjoint blocks of either
kind, so a pair that differs in fewer than ``TABLES`` bits always shares a block
and, within it, another.  Near copies lie further apart, up to ``MAX_DISTANCE``
bits, and there some share none.

So a second pass finds every link that is left.  The bits are cut into disjoint
parts with radii such that a pair within ``MAX_DISTANCE`` bits differs by at most
the radius in one part at least; all values within the radius are looked up, and
what they hold is verified unless the first pass has connected it.  Rows are cut
into sides, and each two sides are a task, so no pair within the distance is
missed.  Connected pairs form a group of copies, of which the row with the least id
stays.

Equal fingerprints are collapsed before the join, and many rows that share blocks
emit a spanning forest instead of all pairs, so a group of thousands of copies
costs one comparison for each copy and block.  With more fingerprints the blocks
get longer and more; a group that is still too large for a task is cut into parts,
and each pair of parts is a task of its own.

Defined cases: a text that is null, empty or without a word has no fingerprint
and stays; texts of the same distinct words have equal fingerprints and are near
copies (ties in a bit's vote give 0); a very long text counts with all its words; a
null id sorts last; rows of equal id and text are repeats, of which one stays; an
empty table gives an empty one; other columns pass through in whatever names they
have.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_chunks, lean, maybe_broadcast, pick, stored, texts, unpick
from .components import components

BITS = 512
#: Blocks of either level; a closer pair is never missed.
TABLES = 24
TABLE_BITS = 10
#: Bits of a block within a group of at most 2^12 rows; one bit more for each
#: doubling.
SET_BITS = 12
#: How many inner blocks a pair at ``MAX_DISTANCE`` shares within a group, at least
#: and on average.
SETS_SHARED = 1.6
#: Pairs of sf0.1 up to here have a median word ratio of 0.89 or more; beyond 87
#: bits most are unrelated.
MAX_DISTANCE = 80
#: Rows of a group that a task holds; outer blocks are so long that groups of
#: unrelated rows have at most a quarter of it.
GROUP_ROWS = 1 << 20
TABLE_ROWS = 1 << 16
LONG_LETTERS = 4
LONG_WEIGHT = 4
#: Rows of a side in the second pass: at most, and at least while there are fewer
#: than ``SIDES`` sides.
SIDE_ROWS = 1 << 20
LEAST_SIDE_ROWS = 1 << 12
SIDES = 8
#: Pairs that are expanded at once.
PAIRS = 1 << 18
#: Removed rows up to which the anti-join is a broadcast.
ROW_BROADCAST = 500_000
#: Runs of at most so many rows that agree in a set are compared pair by pair at once.
_SMALL_RUN = 8
WORD = re.compile(r"\w+")


class Fingerprints:
    """Texts to fingerprints; the bit table is the same in every process."""

    def __init__(self, seed: int = 11):
        packed = np.random.default_rng(seed).integers(0, 256, (TABLE_ROWS, BITS // 8), np.uint8)
        self.bits = np.unpackbits(packed, axis=1)

    def of(self, text: str | None) -> bytes | None:
        feats = set(WORD.findall(text.lower())) if text else None
        if not feats:
            return None
        h = xxhash.xxh3_64_intdigest
        rows = np.fromiter((h(w) % TABLE_ROWS for w in feats), np.int64, len(feats))
        long = np.fromiter((len(w) >= LONG_LETTERS for w in feats), bool, len(feats))
        votes, total = np.zeros(BITS, np.int64), 0
        for part, weight in ((rows[long], LONG_WEIGHT), (rows[~long], 1)):
            total += weight * len(part)
            for s in range(0, len(part), 16_384):
                votes += weight * self.bits[part[s : s + 16_384]].sum(axis=0, dtype=np.uint16).astype(np.int64)
        return np.packbits(2 * votes > total).tobytes()


def _values(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The number that the chosen ``bits`` (n, b) of each of the fingerprints
    (n, BITS/8) make."""
    out = np.zeros(len(fps), np.int64)
    rows = np.arange(len(fps))
    for at in bits.T:
        out = (out << 1) | ((fps[rows, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
    return out


def table_shape(n: int) -> tuple[int, int]:
    """(blocks, bits of a block) for ``n`` fingerprints: longer blocks keep groups
    small, and more of them the share of near copies that meet."""
    bits = max(TABLE_BITS, math.ceil(math.log2(max(1, n) * 4 / GROUP_ROWS)))
    return math.ceil(TABLES / (1 - MAX_DISTANCE / BITS) ** (bits - TABLE_BITS)), bits


def _blocks(rng: np.random.Generator, places: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """(blocks, bits) places; as many as possible have none in common."""
    whole = len(places) // bits
    out = [rng.permutation(places)[: whole * bits].reshape(whole, bits) for _ in range(-(-blocks // whole))]
    return np.concatenate(out)[:blocks]


@cache
def table_bits(tables: int = TABLES, bits: int = TABLE_BITS) -> np.ndarray:
    return _blocks(np.random.default_rng(12), np.arange(BITS), tables, bits)


@cache
def set_bits(size: int, tables: int = TABLES, bits: int = TABLE_BITS) -> np.ndarray:
    """(tables, sets, size) bits of the inner blocks, of those that the outer
    block doesn't use."""
    sets = max(TABLES, math.ceil(SETS_SHARED / (1 - MAX_DISTANCE / BITS) ** size))
    rests = [np.setdiff1d(np.arange(BITS), used) for used in table_bits(tables, bits)]
    return np.stack([_blocks(np.random.default_rng([13, t, size]), rest, sets, size) for t, rest in enumerate(rests)])


def table_keys(fps: np.ndarray, tables: int = TABLES, bits: int = TABLE_BITS) -> np.ndarray:
    """(n, tables) keys: the number of the block above its bits."""
    keys = [_values(fps, np.broadcast_to(at, (len(fps), bits))) for at in table_bits(tables, bits)]
    return (np.arange(tables) << bits) | np.stack(keys, axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what pairs within ``most`` bits connect, found by
    breadth-first search: each row meets only rows that are not yet reached."""
    rest = np.arange(len(words))
    edges: list[tuple[int, int]] = []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            a = front.pop()
            near = distance(words[rest], words[a]) <= most
            found = rest[near].tolist()
            edges += [(f, a) for f in found]
            front += found
            rest = rest[~near]
    return edges


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A binary column of BITS/8 bytes each as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(column), BITS // 8)


def fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp) of rows with a fingerprint; ``row`` is a hash of id and
    text that tells apart rows of one id."""
    chosen = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("id", "text").alias("row"), "text")
    kind = chosen.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprints()
        for b in batches:
            fps = pa.array([make.of(t) for t in texts(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), fps], ["id", "row", "fp"])

    return chosen.mapInArrow(lean(run), f"id {kind}, row bigint, fp binary").where(F.col("fp").isNotNull())


def meeting(keys: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (u, v) with equal keys whose components are those of all pairs within
    ``most`` bits."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, _SMALL_RUN + 1):
        at = first[sizes == n]
        for i in range(n if len(at) else 0):
            for j in range(i):
                u, v = order[at + i], order[at + j]
                near = distance(words[u], words[v]) <= most
                us.append(u[near])
                vs.append(v[near])
    for s, n in zip(first[sizes > _SMALL_RUN].tolist(), sizes[sizes > _SMALL_RUN].tolist()):
        run = order[s : s + n]
        edges = np.array(forest(words[run], most), np.int64).reshape(-1, 2)
        us.append(run[edges[:, 0]])
        vs.append(run[edges[:, 1]])
    return np.concatenate(us), np.concatenate(vs)


def group_edges(groups: np.ndarray, tables: np.ndarray, fps: np.ndarray, most: int, shape=(TABLES, TABLE_BITS)) -> np.ndarray:
    """(n, 2) rows that share an inner block within their group, the groups being
    rows of equal numbers that lie together, and differ in at most ``most`` bits."""
    words = fps.view(np.uint64)
    new = np.concatenate([[True], groups[1:] != groups[:-1]])
    largest = int(np.diff(np.append(np.flatnonzero(new), len(groups))).max())
    size = max(SET_BITS, (largest - 1).bit_length())
    bits, dense = set_bits(size, *shape), np.cumsum(new)
    found = np.zeros(0, np.int64)
    for s in range(bits.shape[1]):
        u, v = meeting((dense << size) | _values(fps, bits[tables, s]), words, most)
        pair = np.maximum(u, v) * len(groups) + np.minimum(u, v)
        found = np.union1d(found, pair)
    return np.stack(np.divmod(found, len(groups)), axis=1)


def hot_groups(fps: DataFrame, shape: tuple[int, int], most: int) -> dict[int, int]:
    """key -> number of parts, of the groups with more than ``most`` rows.  Tasks
    count before the shuffle; there are at most blocks x rows / ``most`` such
    groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(table_keys(_bytes(b.column("fp")), *shape), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    sizes = fps.mapInArrow(lean(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return {r["key"]: -(-r["n"] // (most // 2)) for r in sizes.collect()}


def parts(most: int, bits: int) -> list[tuple[np.ndarray, int]]:
    """(places, radius) of disjoint parts of ``bits`` bits.  The radii, each raised by
    one, add up to ``most`` + 1, so a pair that is beyond the radius in every part
    differs in more than ``most`` bits."""
    count = BITS // bits
    places = np.random.default_rng(14).permutation(BITS)[: count * bits].reshape(count, bits)
    low, extra = divmod(most + 1, count)
    return [(at, low if i < extra else low - 1) for i, at in enumerate(places) if i < extra or low]


@cache
def ball(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits of which at most ``radius`` are set."""
    shells = [np.zeros(1, np.int64)]
    for _ in range(min(radius, bits)):
        last = shells[-1]
        shells.append(np.concatenate([last[last < (1 << k)] | (1 << k) for k in range(bits)]))
    return np.concatenate(shells)


@cache
def part_bits(n: int, most: int) -> int:
    """The length of parts that costs the least lookups and pairs among ``n`` rows."""

    def cost(bits: int) -> float:
        lookups = sum(math.comb(bits, k) for _, r in parts(most, bits) for k in range(min(r, bits) + 1))
        return lookups * (1 + 16 * n / 2**bits)

    return min(range(12, 25), key=cost)


def crossed(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every (x, y) of a..a+an and b..b+bn, about ``PAIRS`` at a time."""
    size = an * bn
    yield a[size == 1], b[size == 1]
    a, an, b, bn, size = (x[size > 1] for x in (a, an, b, bn, size))
    ends, s = np.cumsum(size), 0
    while s < len(size):
        if size[s] > PAIRS:
            step = max(1, PAIRS // int(bn[s]))
            for k in range(0, int(an[s]), step):
                rows = np.arange(k, min(k + step, int(an[s])))
                for j in range(0, int(bn[s]), PAIRS):
                    cols = np.arange(j, min(j + PAIRS, int(bn[s])))
                    yield a[s] + np.repeat(rows, len(cols)), b[s] + np.tile(cols, len(rows))
            s += 1
            continue
        e = int(np.searchsorted(ends, ends[s] - size[s] + PAIRS, "right"))
        at = np.repeat(np.arange(s, e), size[s:e])
        k = np.arange(len(at)) - np.repeat(ends[s:e] - size[s:e] - (ends[s] - size[s]), size[s:e])
        i, j = np.divmod(k, bn[at])
        yield a[at] + i, b[at] + j
        s = e


class Part:
    """The rows of a side by their value in a part, those of a value by class: rows of
    equal value and class are a run, runs of equal value a bucket."""

    def __init__(self, values: np.ndarray, classes: np.ndarray):
        self.order = np.lexsort((classes, values))
        v, c = values[self.order], classes[self.order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (c[1:] != c[:-1])
        self.first = np.flatnonzero(new)
        self.rows = np.diff(np.append(self.first, len(v)))
        self.run_class, v = c[self.first], v[self.first]
        bucket = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        self.values, self.bucket, self.runs = v[bucket], bucket, np.diff(np.append(bucket, len(v)))


def links(a: np.ndarray, a_class: np.ndarray, b: np.ndarray, b_class: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (u of ``a``, v of ``b``) of different classes that differ in at most
    ``most`` bits, one pair for each two classes that have any.  ``b`` may be ``a``."""
    found = [np.zeros((4, 0), np.int64)]
    same = b is a
    a_words, b_words = a.view(np.uint64), b.view(np.uint64)
    a_head, b_head = (np.ascontiguousarray(w[:, :3]) for w in (a_words, b_words))

    def compare(one: Part, two: Part, at: list[np.ndarray], other: list[np.ndarray]) -> None:
        x, y = np.concatenate(at), np.concatenate(other)
        for p, q in crossed(one.bucket[x], one.runs[x], two.bucket[y], two.runs[y]):
            apart = one.run_class[p] != two.run_class[q]
            if same:  # a bucket meets itself, others meet those of larger values
                apart &= p < q
            p, q = p[apart], q[apart]
            for i, j in crossed(one.first[p], one.rows[p], two.first[q], two.rows[q]):
                u, v = one.order[i], two.order[j]
                near = distance(a_head[u], b_head[v]) <= most
                u, v = u[near], v[near]
                near = distance(a_words[u], b_words[v]) <= most
                if near.any():
                    u, v = u[near], v[near]
                    found.append(np.stack([a_class[u], b_class[v], u, v]))
        if len(found) > 64:
            found[:] = [_one_of_each(found, same)]

    bits = part_bits(len(b), most)
    for places, radius in parts(most, bits):
        one = Part(_values(a, np.broadcast_to(places, (len(a), bits))), a_class)
        two = one if same else Part(_values(b, np.broadcast_to(places, (len(b), bits))), b_class)
        present = np.zeros(1 << bits, bool)
        present[two.values] = True
        rank = np.cumsum(present, dtype=np.int32)
        at, other, held = [], [], 0
        for mask in ball(bits, radius).tolist():
            value = one.values ^ mask
            hit = present[value]
            if same and mask:
                hit &= value > one.values
            x = np.flatnonzero(hit)
            if len(x):
                at.append(x)
                other.append(rank[value[x]] - 1)
                held += len(x)
            if held > PAIRS:
                compare(one, two, at, other)
                at, other, held = [], [], 0
        if held:
            compare(one, two, at, other)
    return tuple(_one_of_each(found, same)[2:])


def _one_of_each(found: list[np.ndarray], same: bool) -> np.ndarray:
    """The first of the found pairs for each two classes."""
    f = np.concatenate(found, axis=1)
    c = np.sort(f[:2], axis=0) if same else f[:2]
    return f[:, np.unique(c, axis=1, return_index=True)[1]]


def missing_links(fps: DataFrame, classes: DataFrame, n: int, max_distance: int) -> DataFrame:
    """(u, v) of the ``n`` distinct fingerprints that connect classes (node, root)
    within ``max_distance`` bits; a fingerprint that is no node is its own class or
    that of the nodes whose root it is."""
    sides = max(1, min(SIDES, n // LEAST_SIDE_ROWS), -(-n // SIDE_ROWS))
    tasks = sides * (sides + 1) // 2

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        held.clear()
        fps = np.concatenate([_bytes(c) for c in t.column("fp").chunks])
        root = pc.coalesce(t.column("root"), t.column("fp")).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        task, side = t.column("task").to_numpy(), t.column("side").to_numpy()
        del t
        for k in np.unique(task).tolist():
            own = [np.flatnonzero((task == k) & (side == x)) for x in np.unique(side[task == k])]
            a = (fps[own[0]], root[own[0]])
            # a task of two sides of which one is empty compares nothing: each side has a task of its own
            b = a if k < sides else (fps[own[1]], root[own[1]]) if len(own) > 1 else (a[0][:0], a[1][:0])
            if len(b[0]):
                u, v = links(*a, *b, max_distance)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in f], pa.binary()) for f in (a[0][u], b[0][v])], ["u", "v"])

    chosen = fps.join(classes, fps["fp"] == classes["node"], "left").select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(sides)).cast("int").alias("side"))
    chosen = chosen.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    # tasks below ``sides`` are a side by itself, the others rows and columns of a triangle
    task = F.when(low == high, low).otherwise(F.lit(sides) + (high * (high - 1) / 2).cast("int") + low)
    keyed = chosen.select(task.cast("int").alias("task"), "side", "fp", "root")
    return keyed.repartitionById(tasks, "task").mapInArrow(lean(join), "u binary, v binary")


def near_edges(fps: DataFrame, max_distance: int = MAX_DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v) fingerprints whose components are those of all pairs that differ in at
    most ``max_distance`` bits."""
    fps = stored(fps.select("fp").distinct(), "simhash-distinct")
    n = fps.count()
    shape = table_shape(n)
    hot = hot_groups(fps, shape, group_rows) if n > group_rows else {}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = table_keys(_bytes(b.column("fp")), *shape)
            at = np.repeat(np.arange(len(keys)), shape[0])
            flat, part = keys.ravel(), np.zeros(len(at), np.int64)
            if hot:
                parts = np.array([hot.get(k, 1) for k in flat.tolist()], np.int64)
                flat, at, part, parts = (np.repeat(x, parts) for x in (flat, at, part, parts))
                other = np.arange(len(at)) - np.maximum.accumulate(np.where(np.append(True, (flat[1:] != flat[:-1]) | (at[1:] != at[:-1])), np.arange(len(at)), 0))
                mine = np.array([xxhash.xxh3_64_intdigest(f) for f in b.column("fp").to_pylist()], np.uint64)[at] % parts.astype(np.uint64)
                mine = mine.astype(np.int64)
                part = np.minimum(mine, other) * parts + np.maximum(mine, other)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), pa.array(part), b.column("fp").take(pa.array(at))], ["key", "part", "fp"]
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, ["key", "part"]):
            key, part = t.column("key").to_numpy(), t.column("part").to_numpy()
            group = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            edges = group_edges(group, key >> shape[1], _bytes(t.column("fp")), max_distance, shape)
            fp = t.column("fp").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [fp.take(pa.array(edges[:, 0])), fp.take(pa.array(edges[:, 1]))], ["u", "v"]
            )

    keyed = fps.mapInArrow(lean(spread), "key bigint, part bigint, fp binary")
    keyed = keyed.repartition("key", "part").sortWithinPartitions("key", "part")
    classes = components(keyed.mapInArrow(lean(join), "u binary, v binary"))
    left = stored(missing_links(fps, classes, n, max_distance), "simhash-links")
    return classes.toDF("u", "v").unionByName(left)


def _removed(docs: DataFrame, id_col: str, text_col: str, max_distance: int):
    """Rows of groups with more than one: (id, row, kept_id, kept_row, n) where
    n counts the rows equal to this one."""
    fps = stored(fingerprint(docs, id_col, text_col), "simhash-fps")
    comp = components(near_edges(fps, max_distance))
    least = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row"))
    rows = fps.join(comp, fps["fp"] == comp["node"], "left").select(
        "id", "row", F.coalesce("root", "fp").alias("root")
    )
    groups = rows.groupBy("root").agg(least.alias("k"), F.count("*").alias("size")).where("size > 1")
    rows = rows.groupBy("root", "id", "row").agg(F.count("*").alias("n")).join(groups, "root")
    return stored(
        rows.select("id", "row", F.col("k.id").alias("kept_id"), F.col("k.row").alias("kept_row"), "n"),
        "simhash-groups",
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """(id, kept_id) of every row that goes, beside the row that stays."""
    rows = _removed(docs, id_col, text_col, max_distance)
    is_kept = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))
    extra = F.when(is_kept, F.col("n") - 1).otherwise(F.col("n")).cast("int")
    return rows.select(F.col("id").alias(id_col), "kept_id", F.explode(F.array_repeat(F.lit(0), extra))).drop("col")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """``docs`` with one row of each group."""
    rows = _removed(docs, id_col, text_col, max_distance)
    is_kept = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row"))
    gone = maybe_broadcast(rows.where(~is_kept).select(F.col("id").alias("g_id"), F.col("row").alias("g_row")), ROW_BROADCAST)
    twice = maybe_broadcast(
        rows.where(is_kept & (F.col("n") > 1)).select(F.col("id").alias("g_id"), F.col("row").alias("g_row")), ROW_BROADCAST
    )
    keyed = pick(docs, row=True, id=id_col, text=text_col).select("id", F.xxhash64("id", "text").alias("h"), F.col("row").alias("whole"))
    same = (F.col("h") == F.col("g_row")) & F.col("id").eqNullSafe(F.col("g_id"))
    left = keyed.join(gone, same, "left_anti")
    once = left.join(twice, same, "left_anti").select(F.col("whole").alias("row"))
    repeated = left.join(twice, same, "left_semi").dropDuplicates(["id", "h"]).select(F.col("whole").alias("row"))
    return unpick(once.unionByName(repeated), docs)
