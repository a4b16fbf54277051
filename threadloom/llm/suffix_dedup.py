"""Suffix-array dedup: passages of ``least`` words or more that repeat.

A window of ``least`` consecutive words (split at white space) is repeated if
the same words stand earlier, in order of document id and position.  The union
of a document's repeated windows are its repeated spans; the first occurrence
of each passage stays.

The sorted suffixes come from the column-wise construction of ``colbwt``, which
runs in owner tasks.  What makes one collection into many, exactly:

1. Every window is owned by the least hash of its ``gram``-word grams, which
   depends on its words alone, so equal windows have one owner.  Consecutive
   windows of one owner make one string of at most ``2 least - gram`` words;
   that also bounds the rounds, however long the documents are.
2. Owners that occur once in the corpus can own no repeat.  A first pass sends
   (owner, hash of the text) only, and texts are read again just for owners
   that occur at least twice.  Equal texts are collapsed before.
3. An owner task collapses equal strings and builds transform, common prefixes
   and suffixes of the rest, many owners together, in sequential files of the
   shared folder; neighbours that share ``least`` words are equal windows.
4. An owner of more than ``HOT_OWNER`` texts (a passage that much of the corpus
   shares) isn't given to one task.  Its strings are collapsed by tasks before they
   are shuffled, the first of each kind are cut into their windows, and those are
   collapsed again.

Texts are told apart by two 64-bit hashes, words are compared as they are.

Defined cases: a null text and one of fewer than ``least`` words has no span;
of equal texts the row of least id (null last) stays, and each other row is
repeated as a whole; rows of equal id and text count as copies; ties (a window at
several places of one text) go to the first place; a very long text is held by one
task while its strings are cut, and travels on as strings of bounded length; a
``gram`` below 1 or above ``least`` raises; an empty table gives none; other
columns are not read by ``repeated_spans`` and pass through ``cut_repeats`` in
whatever names they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .colbwt import repeats
from .common import WordHash, fits, key_chunks, lean, maybe_broadcast, pick, position, registered, shared_dir, stored, texts, unpick

LEAST = 50
GRAM = 16
#: Symbols that are sorted together; a single owner's strings are never parted.
CHUNK_SYMBOLS = 500_000
#: Distinct words of those; so many have numbers of two bytes, which sort faster.
CHUNK_WORDS = 60_000
#: Texts of an owner beyond which its strings don't go to one task.
HOT_OWNER = 1 << 16
#: Rows up to which a join with the documents is a broadcast.
ROW_BROADCAST = 500_000
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)


def slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Owners:
    """Owners of the windows of texts."""

    def __init__(self, least: int, gram: int):
        self.least, self.gram, self.width = least, gram, least - gram + 1
        self.hash = WordHash()
        self.power = self.inverse = np.ones(1, np.uint64)

    def grams(self, words: list[str]) -> np.ndarray:
        """Even 64-bit hashes of all grams."""
        n = len(words)
        if len(self.power) <= n:
            size = max(4096, 2 * n)
            for name, b in (("power", _B), ("inverse", _B_INVERSE)):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash.of(words) * self.power[:n], out=s[1:])
        g = (s[self.gram :] - s[: n + 1 - self.gram]) * self.inverse[: n + 1 - self.gram]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(29)
        return g & np.uint64(0xFFFFFFFFFFFFFFFE)

    def of(self, words: list[str]) -> np.ndarray:
        """Distinct owners; the last bit is set if a text has two places of it
        near each other."""
        if len(words) < self.least:
            return np.empty(0, np.int64)
        g = self.grams(words)
        m = slide(g, self.width, np.minimum)
        pad = np.zeros(self.width - 1, np.uint64)
        chosen = slide(np.concatenate([pad, m, pad]), self.width, np.maximum) == g
        values, n = np.unique(g[chosen], return_counts=True)
        return (values | (n > 1).astype(np.uint64)).view(np.int64)

    def strings(self, words: list[str], wanted: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
        """(owner, first word, end word, whether windows inside may be equal) of
        the strings whose owner is in ``wanted`` (sorted)."""
        if len(words) < self.least:
            return
        g = self.grams(words)
        m = slide(g, self.width, np.minimum)
        first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        owner = m[first].view(np.int64)
        at = np.minimum(np.searchsorted(wanted, owner), len(wanted) - 1)
        ends = np.append(first[1:], len(m))
        for k in np.flatnonzero(wanted[at] == owner).tolist():
            for s in range(int(first[k]), int(ends[k]), self.width):
                e = min(s + self.width, int(ends[k]))
                tie = np.count_nonzero(g[s : e + self.width - 1] == m[s]) > 1
                yield int(owner[k]), s, e + self.least - 1, tie


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL")
    return rows.select(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "id", "text")


def _thin(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> DataFrame:
    """(h1, h2, id, n_words, owners) of each text, in the shared folder."""
    rows = _hashed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Owners(least, gram)
        for b in batches:
            n_words, found = [], []
            for t in texts(b.column("text")):
                words = t.split()
                n_words.append(len(words))
                found.append(owners.of(words))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays(
                [b.column("h1"), b.column("h2"), b.column("id"), pa.array(n_words, pa.int32()), lists],
                ["h1", "h2", "id", "n_words", "owners"],
            )

    return stored(
        rows.mapInArrow(lean(run), f"h1 bigint, h2 bigint, id {kind}, n_words int, owners array<bigint>"), "suffix-texts"
    )


def _shared_owners(thin: DataFrame, hot: int = HOT_OWNER) -> DataFrame:
    """(key, owner, n): null ``n`` for each text of the owners that two texts have,
    or one at two places; and with null ``key`` the number of texts of each owner
    with more than ``hot``.  Rows of an owner stream: what is held of it is one
    text, until there is another."""
    pairs = thin.select("h1", F.explode("owners").alias("o")).select(
        F.col("o").bitwiseAND(F.lit(-2)).alias("owner"),
        F.col("h1").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("o").bitwiseAND(F.lit(1))).alias("key"),
    )

    def out(key: np.ndarray, owner: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(owner), pa.int64())
        columns = [pa.array(key), pa.array(owner), none] if n is None else [none, pa.array(owner), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, ["key", "owner", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text, several, size = None, 0, False, 0  # of the owner that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            owner, key = b.column("owner").to_numpy(), b.column("key").to_numpy()
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(first, len(owner)))
            texts_ = key & -2
            low, high = np.minimum.reduceat(texts_, first), np.maximum.reduceat(texts_, first)
            some = (low != high) | (np.maximum.reduceat(key & 1, first) > 0)
            if owner[0] == last:
                fresh = not several and (bool(some[0]) or low[0] != text)
                some[0] |= several or low[0] != text
                sizes[0] += size
                if fresh:
                    yield out(np.array([text]), owner[:1])
            elif last is not None and size > hot:
                yield out(None, np.array([last]), np.array([size]))
            full = np.flatnonzero(sizes[:-1] > hot)
            if len(full):
                yield out(None, owner[first[full]], sizes[full])
            last, text, several, size = int(owner[-1]), int(texts_[-1]), bool(some[-1]), int(sizes[-1])
            keep = np.repeat(some, np.diff(np.append(first, len(owner))))
            yield out(texts_[keep], owner[keep])
        if last is not None and size > hot:
            yield out(None, np.array([last]), np.array([size]))

    sorted_ = pairs.repartition("owner").sortWithinPartitions("owner", "key")
    return stored(sorted_.mapInArrow(lean(choose), "key bigint, owner bigint, n bigint"), "suffix-shared")


def _owned_strings(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, least: int, gram: int) -> DataFrame:
    rows = _hashed(docs, id_col, text_col)
    w = wanted.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("id").alias("w_id"), "wanted")
    same = (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("w_id"))
    rows = rows.join(w, same).select("id", "h1", "text", "wanted")
    id_type = rows.schema["id"].dataType
    names = ["owner", "id", "row", "start", "tie", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Owners(least, gram)
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i in range(b.num_rows):
                words = b.column("text")[i].as_py().split()
                wanted = np.sort(b.column("wanted")[i].values.to_numpy())
                row, rid = b.column("h1")[i].as_py(), b.column("id")[i].as_py()
                for owner, s, e, tie in owners.strings(words, wanted):
                    for c, x in zip(out, (owner, rid, row, s, tie, " ".join(words[s:e]))):
                        c.append(x)
                if len(out[0]) > 20_000 or i == b.num_rows - 1:
                    kinds = [pa.int64(), b.schema.field("id").type, pa.int64(), pa.int32(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out = [[] for _ in names]

    schema = T.StructType(
        [
            T.StructField("owner", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("row", T.LongType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("tie", T.BooleanType()),
            T.StructField("string", T.StringType()),
        ]
    )
    return rows.mapInArrow(lean(run), schema)


def _first_of_groups(parts, rank: np.ndarray, pos0: np.ndarray, sizes: np.ndarray):
    """(string, offset, string of the first) of windows that aren't the first of
    their group; a group that goes on is held until it ends."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64))

    def later(suffix: np.ndarray, group: np.ndarray):
        i = suffix >> 32
        offset = sizes[i] - (suffix & 0xFFFFFFFF)
        order = np.lexsort((pos0[i] + offset, rank[i], group))
        g = group[order]
        new = np.append(True, g[1:] != g[:-1])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return i[order][~new], offset[order][~new], i[head][~new]

    for suffix, group in parts:
        suffix, group = np.concatenate([held[0], suffix]), np.concatenate([held[1], group])
        if not len(group):
            continue
        cut = int(np.searchsorted(group, group[-1]))
        held = (suffix[cut:], group[cut:])
        if cut:
            yield later(suffix[:cut], group[:cut])
    if len(held[0]):
        yield later(*held)


def _runs(offset: np.ndarray, first: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (inclusive) of the stretches of neighbouring windows of one
    string whose first occurrence is in one string."""
    new = np.append(True, (head[1:] != head[:-1]) | (offset[1:] != offset[:-1] + 1) | (first[1:] != first[:-1]))
    s = np.flatnonzero(new)
    return s, np.append(s[1:], len(head)) - 1


def _repeats_of_owners(strings: DataFrame, least: int, chunk: int) -> DataFrame:
    """(id, row, start, end, first_id) from owned strings."""
    folder = registered(strings.sparkSession, f"{shared_dir(strings.sparkSession)}/threadloom/columns")
    id_type = strings.schema["id"].dataType
    names = ["id", "row", "start", "end", "first_id"]

    def emit(t: pa.Table, at: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        ids = t.column("id").combine_chunks()
        columns = [ids.take(pa.array(at)), pa.array(t.column("row").to_numpy()[at])]
        columns += [pa.array(start, pa.int32()), pa.array(end, pa.int32()), ids.take(pa.array(first))]
        return pa.RecordBatch.from_arrays(columns, names)

    def sort(t: pa.Table, at: np.ndarray, symbols: list[np.ndarray], n_symbols: int):
        """(string, offset, first string) of the repeated windows of the strings
        in rows ``at``."""
        ids = t.column("id").combine_chunks()
        mine = ids.take(pa.array(at)).to_pylist()
        rows, starts = t.column("row").to_numpy()[at], t.column("start").to_numpy()[at].astype(np.int64)
        order = sorted(range(len(at)), key=lambda k: (mine[k] is None, mine[k] if mine[k] is not None else 0, rows[k]))
        rank = np.empty(len(at), np.int64)
        before, r = None, -1
        for k in order:
            if (mine[k], rows[k]) != before:
                before, r = (mine[k], rows[k]), r + 1
            rank[k] = r
        sizes = np.fromiter(map(len, symbols), np.int64, len(symbols))
        groups = repeats(symbols, n_symbols, least, folder)
        parts = list(_first_of_groups(groups, rank, starts, sizes))
        none = np.zeros(0, np.int64)
        i, offset, first = (np.concatenate([none, *(p[k] for p in parts)]) for k in range(3))
        o = np.lexsort((offset, i))
        return i[o], offset[o], first[o]

    def spread(t: pa.Table, copies: tuple, heads: np.ndarray, found: tuple) -> Iterator[pa.RecordBatch]:
        """Spans of the strings ``heads``, whose repeated windows are ``found``, and
        of their ``copies`` (rows, their head's number, windows): all windows of a
        copy are repeated, from where those of its head are, or from its head."""
        starts = t.column("start").to_numpy().astype(np.int64)
        i, offset, first = found
        if len(i):
            s, e = _runs(offset, first, i)
            yield emit(t, heads[i[s]], starts[heads[i[s]]] + offset[s], starts[heads[i[s]]] + offset[e] + least, heads[first[s]])
        rows, head, windows = copies
        if not len(rows):
            return
        used, back = np.unique(head, return_index=True)
        n = windows[back]
        ends = np.cumsum(n)
        source = np.repeat(used, n)
        place = np.full(len(heads), -1, np.int64)
        place[used] = ends - n
        mine = place[i] >= 0
        source[place[i[mine]] + offset[mine]] = first[mine]
        owner = np.repeat(np.arange(len(used)), n)
        s, e = _runs(np.arange(len(source)) - np.repeat(ends - n, n), source, owner)
        n_runs = np.bincount(owner[s], minlength=len(used))
        first_run = np.cumsum(n_runs) - n_runs
        k = np.searchsorted(used, head)
        row = np.repeat(np.arange(len(rows)), n_runs[k])
        run = np.arange(len(row)) - np.repeat(np.cumsum(n_runs[k]) - n_runs[k], n_runs[k]) + first_run[k][row]
        at = rows[row]
        o = s[run] - (ends - n)[k][row]
        yield emit(t, at, starts[at] + o, starts[at] + e[run] - (ends - n)[k][row] + least, heads[source[s[run]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, ["owner"], 16_384):
            # rows of equal id and text give each string twice: one occurrence
            again = _equal(t.column("string").combine_chunks())
            for c in ("owner", "row", "start"):
                x = t.column(c).to_numpy()
                again = again & (x[1:] == x[:-1])
            t = t.filter(pa.array(np.append(True, ~again))).combine_chunks()
            owner = t.column("owner").to_numpy()
            string = t.column("string").combine_chunks()
            changes = np.append(True, owner[1:] != owner[:-1])
            # rows are sorted by owner and string, so equal strings are neighbours
            same = np.append(False, _equal(string) & ~changes[1:])
            tie = t.column("tie").to_numpy()
            heads = np.flatnonzero(~same)  # rows of the distinct strings
            head_of = np.cumsum(~same) - 1
            first_head = np.flatnonzero(np.append(True, owner[heads][1:] != owner[heads][:-1]))
            next_head = np.append(first_head[1:], len(heads))
            windows = np.zeros(len(heads), np.int64)
            number: dict[str, int] = {}
            picked: list[int] = []
            symbols: list[np.ndarray] = []
            begin = count = 0
            for h, e in zip(first_head.tolist(), next_head.tolist()):
                alone = e - h < 2 and not tie[heads[h]]
                for k in range(h, e):
                    row = int(heads[k])
                    if alone and not (row + 1 < len(same) and same[row + 1]):
                        continue
                    x = string[row].as_py().split(" ")
                    windows[k] = len(x) - least + 1
                    if not alone:
                        picked.append(k)
                        symbols.append(np.fromiter((number.setdefault(w, len(number) + 1) for w in x), np.int64, len(x)))
                        count += len(x)
                if count >= chunk or len(number) >= CHUNK_WORDS or e == len(heads):
                    found = (np.zeros(0, np.int64),) * 3
                    if picked:
                        at = np.array(picked)
                        i, offset, first = sort(t, heads[at], symbols, len(number) + 1)
                        found = at[i], offset, at[first]
                    rows = np.flatnonzero(same & (head_of >= begin) & (head_of < e))
                    yield from spread(t, (rows, head_of[rows], windows[head_of[rows]]), heads, found)
                    number, picked, symbols, begin, count = {}, [], [], e, 0

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("row", T.LongType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("first_id", id_type),
        ]
    )
    owned = strings.repartition("owner").sortWithinPartitions(
        "owner", "string", F.col("id").asc_nulls_last(), "row", "start"
    )
    return owned.mapInArrow(lean(run), schema)


def _repeats_of_hot(strings: DataFrame, least: int) -> DataFrame:
    """The same of the strings of hot owners, without a task for each: equal
    strings are collapsed, then the windows of the first of them.  A window's first
    occurrence is in the first of its string, so nothing is lost."""
    rank = F.struct(F.col("id").isNull().alias("unknown"), "id", "row", "start")
    strings = stored(strings, "suffix-hot")
    firsts = stored(strings.groupBy("owner", "string").agg(F.min(rank).alias("f")), "suffix-hot-firsts")
    at = F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("o")
    split = F.split("string", " ").alias("w")
    windows = firsts.select("owner", "string", "f", split).select("owner", "string", "f", "w", at)
    window = F.concat_ws(" ", F.slice("w", F.col("o") + 1, least)).alias("window")
    moved = F.struct("f.unknown", "f.id", "f.row", (F.col("f.start") + F.col("o")).alias("start")).alias("f")
    windows = windows.select("owner", "string", "o", moved, window)
    least_of = windows.groupBy("owner", "window").agg(F.min("f").alias("g"))
    known = stored(windows.join(least_of, ["owner", "window"]).select("owner", "string", "o", "g"), "suffix-hot-windows")
    each = strings.join(known, ["owner", "string"]).withColumn("start", (F.col("start") + F.col("o")).cast("int"))
    here = F.col("id").eqNullSafe(F.col("g.id")) & (F.col("row") == F.col("g.row")) & (F.col("start") == F.col("g.start"))
    return each.where(~here).select("id", "row", "start", (F.col("start") + least).cast("int").alias("end"), F.col("g.id").alias("first_id")).distinct()


def _equal(string: pa.Array) -> np.ndarray:
    """Whether each string but the first equals the one before."""
    import pyarrow.compute as pc

    return pc.equal(string[1:], string[:-1]).to_numpy(zero_copy_only=False).astype(bool)


def _spans(docs: DataFrame, id_col: str, text_col: str, least: int, gram: int, chunk: int, hot: int):
    """Spans (id, row, start, end, first_id) of the rows that stand for their
    text, and the copies (h1, h2, id, kept_id, n_words, n): n rows that go."""
    if not 1 <= gram <= least:
        raise ValueError(f"gram {gram} isn't between 1 and least {least}")
    thin = _thin(docs, id_col, text_col, least, gram)
    least_id = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id"))
    kept = stored(
        thin.groupBy("h1", "h2").agg(least_id["id"].alias("id"), F.count("*").alias("n"), F.max("n_words").alias("n_words")),
        "suffix-kept",
    )
    shared = _shared_owners(thin, hot)
    wanted = shared.where("key IS NOT NULL").groupBy("key").agg(F.collect_set("owner").alias("wanted"))
    wanted = kept.select("h1", "h2", "id", F.col("h1").bitwiseAND(F.lit(-2)).alias("key")).join(wanted, "key")
    strings = _owned_strings(docs, wanted, id_col, text_col, least, gram)
    large = shared.where("key IS NULL").select("owner")
    if large.isEmpty():
        spans = _repeats_of_owners(strings, least, chunk)
    else:
        strings, large = stored(strings, "suffix-strings"), maybe_broadcast(large, ROW_BROADCAST)
        spans = _repeats_of_owners(strings.join(large, "owner", "left_anti"), least, chunk)
        spans = spans.unionByName(_repeats_of_hot(strings.join(large, "owner", "left_semi"), least))
    spans = stored(spans, "suffix-spans")
    several = kept.where((F.col("n") > 1) & (F.col("n_words") >= least))
    several = several.select("h1", "h2", F.col("id").alias("kept_id"), "n_words")
    copies = thin.groupBy("h1", "h2", "id").agg(F.count("*").alias("n")).join(several, ["h1", "h2"])
    stays = F.col("id").eqNullSafe(F.col("kept_id")).cast("int")
    return spans, copies.withColumn("gone", F.col("n") - stays), kept


def _merged(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap joined: (id, row, start, end, first_ids)."""
    by = Window.partitionBy("id", "row").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("n", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "row", "n").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_sort(F.collect_set("first_id")).alias("first_ids"),
    )


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    gram: int = GRAM,
    chunk: int = CHUNK_SYMBOLS,
    hot: int = HOT_OWNER,
) -> DataFrame:
    """(id, start_word, end_word, first_ids): every repeated span, with the ids of
    the documents where its windows stand first (known ids only); that of a text
    with a row before it is the whole, from that row's document."""
    spans, copies, _ = _spans(docs, id_col, text_col, least, gram, chunk, hot)
    whole = copies.select(
        F.col("id"),
        F.lit(0).alias("start"),
        F.col("n_words").alias("end"),
        F.array_compact(F.array("kept_id")).alias("first_ids"),
        F.explode(F.array_repeat(F.lit(0), F.col("gone").cast("int"))).alias("copy"),
    ).drop("copy")
    out = _merged(spans).select("id", "start", "end", "first_ids").unionByName(whole)
    return out.select(
        F.col("id").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "first_ids"
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of sorted, disjoint spans."""
    import re

    places = [m.start() for m in re.finditer(r"\S+", text)]
    places.append(len(text))
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s]])
        at = places[e]
    out.append(text[at:])
    return "".join(out).rstrip()


def cut_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    gram: int = GRAM,
    chunk: int = CHUNK_SYMBOLS,
    hot: int = HOT_OWNER,
) -> DataFrame:
    """``docs`` without the words of repeated spans.  A row of which no word is
    left goes; ``n_chars`` (if there is one) follows the text.  Other rows pass
    straight from the scan."""
    spans, copies, _ = _spans(docs, id_col, text_col, least, gram, chunk, hot)
    cut = _merged(spans).groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    cut = stored(cut.select(F.col("id").alias("c_id"), F.col("row").alias("c_row"), "cut"), "suffix-cut")
    copies = stored(copies.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("kept_id").alias("g_id")).distinct(), "suffix-copies")
    whole = pick(docs, row=True, id=id_col, text=text_col).select(
        F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "id", "text", F.col("row").alias("whole")
    )
    copies = maybe_broadcast(copies, ROW_BROADCAST)
    same = F.col("text").isNotNull() & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    alone = whole.join(copies, same, "left_anti")
    stays = whole.join(copies, same & F.col("id").eqNullSafe(F.col("g_id"))).dropDuplicates(["h1", "h2"])
    rows = alone.unionByName(stays.select(*alone.columns))
    if fits(cut, ROW_BROADCAST):
        cut = F.broadcast(cut)
    here = F.col("text").isNotNull() & (F.col("h1") == F.col("c_row")) & F.col("id").eqNullSafe(F.col("c_id"))
    joined = rows.join(cut, here, "left")
    untouched = joined.where("cut IS NULL").select("whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for t, c in zip(texts(b.column("text")), b.column("cut").to_pylist()):
                left.append(_without(t, [(x["start"], x["end"]) for x in c]))
            yield pa.RecordBatch.from_arrays([b.column("whole"), pa.array(left, pa.string())], ["whole", "left"])

    schema = T.StructType([T.StructField("whole", joined.schema["whole"].dataType), T.StructField("left", T.StringType())])
    changed = joined.where("cut IS NOT NULL").select("whole", "text", "cut").mapInArrow(lean(run), schema).where("left <> ''")
    new = []
    for i, c in enumerate(docs.columns):
        if i == position(docs, text_col):
            new.append(F.col("left").alias(f"_{i}"))
        elif c == "n_chars":
            new.append(F.length("left").cast(docs.schema[i].dataType).alias(f"_{i}"))
        else:
            new.append(F.col("whole").getField(f"_{i}").alias(f"_{i}"))
    return untouched.select("whole.*").unionByName(changed.select(*new)).toDF(*docs.columns)


#: Words are split at white space as Python does it for ASCII texts.
ORACLE_SQL = f"""
    WITH t AS (
        SELECT doc_id, string_split_regex(trim(text, E' \\t\\n\\r\\x0b\\x0c'), '\\s+') AS w,
               min(doc_id) OVER (PARTITION BY text) AS kept
        FROM documents WHERE text IS NOT NULL),
    windows AS (
        SELECT doc_id, p, array_to_string(w[p + 1 : p + {LEAST}], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(len(w) - {LEAST} + 1)) AS p FROM t WHERE doc_id = kept AND len(w) >= {LEAST})),
    seen AS (
        SELECT doc_id, p, row_number() OVER v AS k, first_value(doc_id) OVER v AS first_id
        FROM windows WINDOW v AS (PARTITION BY x ORDER BY doc_id, p)),
    repeated AS (
        SELECT *, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM seen WHERE k > 1),
    numbered AS (
        SELECT *, sum(CASE WHEN gap <= {LEAST} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM repeated),
    spans AS (
        SELECT doc_id, min(p) AS s, max(p) + {LEAST} AS e, list_sort(list(DISTINCT first_id)) AS first_ids
        FROM numbered GROUP BY doc_id, n
        UNION ALL
        SELECT doc_id, 0, len(w), [kept] FROM t WHERE doc_id <> kept AND len(w) >= {LEAST})
    SELECT doc_id, CAST(s AS INT) AS start_word, CAST(e AS INT) AS end_word, array_to_string(first_ids, ',') AS first_ids
    FROM spans"""
