"""Language-model scoring by a hidden Markov model over words.

Every word's exact count is kept in a stored table.  The most frequent words are
symbols of their own; how many follows the square root of the corpus's words,
so the model grows with the input.  Other words fall into hashed classes, whose
number grows alike, and a word is emitted with its class's probability times its
share of the class, joined from the table of counts.  A class keeps a mass for
unseen words: that of its words seen once, and one more.

Texts become symbol sequences once, in the shared folder.  Each Baum-Welch round
runs forward-backward over all of them: every task sums its expected counts,
which are added across tasks as integers (2^-16 of a count), so the model doesn't
depend on the order of adding; nor do scores, as shares are added as integers too.

Training and scoring are exact over whole documents.  A longer document than
``SEGMENT`` words is worked on in stretches side by side: each is first multiplied
out to one matrix, those are chained from either end, and so every stretch begins
with the forward and ends with the backward vector of its place.  A very long
document takes no longer loop over words than others.

Defined cases: a null text has null scores; one that is empty or without a word
has 0 words and log-likelihood 0, and no perplexity; null ids are kept as they
are; repeated rows are scored alike and each counts in training; words of equal
count (ties) are all in the vocabulary or none is; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, maybe_broadcast, pick, stored, texts

STATES = 8
#: Symbols of their own, at least, and how many for the root of the corpus's words.
VOCABULARY = 8_000
VOCABULARY_ROOT = 4
#: Words of the vocabulary for each class of the words outside it.
CLASS_WORDS = 125
ROUNDS = 4
SEGMENT = 1024
#: Words that a task works on at a time.
BATCH_WORDS = 1_000_000
#: Words or classes of the model up to which a join with them is a broadcast.
MODEL_BROADCAST = 500_000
_UNIT = 1 << 16
#: Logarithms of shares are added in units of 2^-32.
_LOG_UNIT = 1 << 32
_COUNTER_WORDS = 300_000
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents.  Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"]
            )

        c: Counter[str] = Counter()
        for b in batches:
            for t in texts(b.column("text")):
                if t:
                    c.update(words(t))
                if len(c) > _COUNTER_WORDS:
                    yield out()
                    c.clear()
        yield out()

    parts = pick(docs, text=text_col).mapInArrow(lean(run), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def model_size(total: int, least: int = VOCABULARY) -> tuple[int, int]:
    """Words with a symbol of their own, and classes, for ``total`` words."""
    vocabulary = max(least, VOCABULARY_ROOT * math.isqrt(total))
    return vocabulary, -(-vocabulary // CLASS_WORDS)


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most ``most`` words; of those that are equally frequent all or none."""
    # at most as many rows as the root of twice the corpus's words
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    n, size = sizes.column("n").to_numpy(), sizes.column("words").to_numpy()
    order = np.argsort(-n)
    within = order[np.cumsum(size[order]) <= most]
    if not len(within):
        return []
    chosen = counts.where(F.col("n") >= int(n[within[-1]])).toArrow()
    found = zip(chosen.column("word").to_pylist(), chosen.column("n").to_pylist())
    return sorted(found, key=lambda x: (-x[1], x[0]))


def word_hash(word: str) -> int:
    """63 bits, those of ``hashed`` in Spark."""
    return xxhash.xxh64_intdigest(word, 42) >> 1


def hashed(column: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 1)


class Symbols(dict):
    """word -> symbol, or for a word outside the vocabulary the size of that and
    the word's hash together; the memo of those is bounded."""

    def __init__(self, vocabulary: list[str], most: int = 300_000):
        super().__init__({w: i for i, w in enumerate(vocabulary)})
        self.vocabulary, self.most = vocabulary, len(vocabulary) + most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update((w, i) for i, w in enumerate(self.vocabulary))
            if word in self:
                return self[word]
        s = self[word] = len(self.vocabulary) + word_hash(word)
        return s


def sequences(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], classes: int) -> DataFrame:
    """(row, id, symbols, rare): ``row`` numbers the rows, symbols are little-
    endian uint32 bytes, null for a null text, and ``rare`` are the hashes of the
    words outside the vocabulary.  Must be stored before rows are matched."""
    chosen = pick(docs, id=id_col, text=text_col)
    kind = chosen.schema["id"].dataType.simpleString()
    known = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Symbols(vocabulary).__getitem__
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out, rare, ends = [], [np.zeros(0, np.int64)], [0]
            for t in texts(b.column("text")):
                got = np.fromiter(map(get, words(t)) if t else (), np.uint64)
                outside = got >= known
                hashes = got[outside] - np.uint64(known)
                got[outside] = known + hashes % np.uint64(classes)
                out.append(None if t is None else got.astype(np.uint32).tobytes())
                rare.append(hashes.astype(np.int64))
                ends.append(ends[-1] + len(hashes))
            rows = np.arange(row, row + len(out))
            row += len(out)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rare)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), b.column("id"), pa.array(out, pa.binary()), lists], ["row", "id", "symbols", "rare"]
            )

    return chosen.mapInArrow(lean(run), f"row bigint, id {kind}, symbols binary, rare array<bigint>")


def class_shares(counts: DataFrame, known: list[str], classes: int) -> tuple[DataFrame, np.ndarray]:
    """(hash, share) of each word outside the vocabulary, ``share`` being the
    logarithm of its part of its class; and the logarithm for an unseen word of
    each class.  A class has as many unseen words as seen ones and one more."""
    least = counts.sparkSession.createDataFrame([(w,) for w in known], "word string")
    rare = counts.join(maybe_broadcast(least, MODEL_BROADCAST), "word", "left_anti").select(hashed("word").alias("hash"), "n")
    rare = rare.groupBy("hash").agg(F.sum("n").alias("n")).withColumn("class", (F.col("hash") % classes).cast("int"))
    once = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
    stats = rare.groupBy("class").agg(F.sum("n").alias("total"), (once + 1).alias("kept"), (F.count("*") + 1).alias("types"))
    unseen = np.zeros(classes)
    sizes = stats.collect()  # one row for each class of the model
    for r in sizes:
        unseen[r["class"]] = np.log(r["kept"] / (r["total"] + r["kept"]) / r["types"])
    whole = counts.sparkSession.createDataFrame(
        [(r["class"], r["total"] + r["kept"]) for r in sizes], "class int, whole bigint"
    )
    return rare.join(maybe_broadcast(whole, MODEL_BROADCAST), "class").select("hash", F.log(F.col("n") / F.col("whole")).alias("share")), unseen


def with_shares(seqs: DataFrame, shares: DataFrame, unseen: np.ndarray) -> DataFrame:
    """Stored sequences and ``tail``, the sum of the logarithms of the shares of
    a row's words outside the vocabulary."""
    none = seqs.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(unseen)], "class int, none double")
    each = seqs.select("row", F.explode("rare").alias("hash")).join(shares, "hash", "left")
    each = each.withColumn("class", (F.col("hash") % len(unseen)).cast("int")).join(maybe_broadcast(none, MODEL_BROADCAST), "class")
    unit = F.round(F.coalesce("share", "none") * _LOG_UNIT).cast("long")
    tails = stored(each.groupBy("row").agg(F.sum(unit).alias("units")), "hmm-tails")
    tail = F.coalesce(F.col("units") / _LOG_UNIT, F.lit(0.0)).alias("tail")
    return seqs.join(tails, "row", "left").select("id", "symbols", tail)


@dataclass
class HMM:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (K, M)

    @classmethod
    def initial(cls, unigram: np.ndarray, states: int = STATES, seed: int = 5) -> HMM:
        """Every state near the corpus's word frequencies, told apart by noise
        of a fixed seed."""
        r = np.random.default_rng(seed)
        emit = (unigram + 0.5) * r.uniform(0.5, 1.5, (states, len(unigram)))
        move = r.uniform(0.5, 1.5, (states, states)) + np.eye(states)
        start = np.ones(states)
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def segments(seqs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of all sequences as columns of a (size, n) matrix, longest
    first; their lengths; and the sequence each is of (in order within it)."""
    lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
    parts = -(-lengths // size)
    owner = np.repeat(np.arange(len(seqs)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(size, lengths[owner] - number * size)
    order = np.argsort(-length, kind="stable")
    flat = np.concatenate(seqs) if len(seqs) else np.zeros(0, np.uint32)
    at = (np.cumsum(lengths) - lengths)[owner] + number * size
    owner, length, at = owner[order], length[order], at[order]
    grid = np.zeros((size, len(owner)), np.int64)
    for t in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))
        grid[t, :n] = flat[at[:n] + t]
    return grid, length, owner


def _live(length: np.ndarray) -> list[int]:
    """How many columns (sorted longest first) still have a symbol at step t."""
    top = int(length[0]) if len(length) else 0
    return [int(np.searchsorted(-length, -t, side="left")) for t in range(top)]


def transfers(model: HMM, grid: np.ndarray, length: np.ndarray, lead: np.ndarray, kind=np.float64) -> np.ndarray:
    """The product of the matrices of each stretch, up to a factor.  The first word
    of a sequence (of the stretches marked ``lead``) has no move before it.  A word's
    emissions are taken over their mean, so products stay near 1 for many words."""
    k, live = len(model.start), _live(length)
    b = np.ascontiguousarray((model.emit / model.emit.mean(axis=0)).T.astype(kind))
    move = model.move.astype(kind)
    prod = np.broadcast_to(np.eye(k, dtype=kind), (len(length), k, k)).copy()
    for t, n in enumerate(live):
        p = prod[:n]
        moved = (p.reshape(-1, k) @ move).reshape(n, k, k)
        if t == 0:
            moved[lead[:n]] = p[lead[:n]]
        np.multiply(moved, b[grid[t, :n]][:, None, :], out=p)
        if t % 16 == 15:
            p /= p.sum(axis=(1, 2))[:, None, None]
    return prod / prod.sum(axis=(1, 2))[:, None, None]


def borders(model: HMM, grid: np.ndarray, length: np.ndarray, owner: np.ndarray, backward: bool = False):
    """Whether each stretch leads its sequence, the state's distribution before it
    (given the words up to there), and if ``backward`` the backward vector at its
    end, scaled so that its product with the forward vector there is 1."""
    k = len(model.start)
    enter = np.broadcast_to(model.start, (len(owner), k)).copy()
    leave = np.ones((len(owner), k))
    # a stable sort keeps the order of columns within a sequence, whose last
    # stretch is its shortest
    order = np.argsort(owner, kind="stable")
    first = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1]))
    count = np.diff(np.append(first, len(owner)))
    lead = np.zeros(len(owner), bool)
    lead[order[first]] = True
    several = count > 1
    first, count = first[several], count[several]
    if not len(first):
        return lead, enter, leave
    within = np.zeros(len(owner), bool)
    within[order] = np.repeat(several, np.diff(np.append(np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1])), len(owner))))
    at = np.flatnonzero(within)
    prod = np.zeros((len(owner), k, k))
    # training works in single precision, scoring in double
    prod[at] = transfers(model, grid[:, at], length[at], lead[at], np.float32 if backward else np.float64)
    for j in range(int(count.max()) - 1):
        todo = first[count > j + 1] + j
        w = np.einsum("nk,nkl->nl", enter[order[todo]], prod[order[todo]])
        enter[order[todo + 1]] = w / w.sum(axis=1, keepdims=True)
    for j in range(int(count.max()) - 2, -1, -1) if backward else ():
        todo = first[count > j + 1] + j
        w = np.einsum("nkl,nl->nk", prod[order[todo + 1]], leave[order[todo + 1]])
        leave[order[todo]] = w / (enter[order[todo + 1]] * w).sum(axis=1, keepdims=True)
    return lead, enter, leave


def expected_counts(model: HMM, seqs: list[np.ndarray], size: int = SEGMENT):
    """Expected start, transition and emission counts, and the log-likelihood
    of the sequences, by the scaled forward-backward recursion."""
    k, m = model.emit.shape
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    grid, length, owner = segments(seqs, size)
    live = _live(length)
    if not live:
        return start, move, emit, 0.0
    lead, enter, leave = borders(model, grid, length, owner, backward=True)
    later = np.flatnonzero(~lead)
    a = model.move.astype(np.float32)
    b = np.ascontiguousarray(model.emit.T.astype(np.float32))
    begin = enter.copy()
    begin[later] = enter[later] @ model.move
    enter, leave = enter.astype(np.float32), leave.astype(np.float32)
    ones = np.ones((k, 1), np.float32)  # a product sums short rows faster
    alpha, scale, like = [], [], 0.0
    for t, n in enumerate(live):
        f = begin.astype(np.float32) if t == 0 else alpha[-1][:n] @ a
        f = f * b[grid[t, :n]]
        c = f @ ones
        f /= c
        alpha.append(f)
        scale.append(c)
        like += float(np.log(c.astype(np.float64)).sum())
    beta = np.ones((0, k), np.float32)
    gammas, symbols = [], []
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        if len(beta) < n:  # stretches that end here
            beta = np.concatenate([beta, leave[len(beta) : n]])
        gamma = alpha[t] * beta
        gamma /= gamma @ ones
        gammas.append(gamma)
        symbols.append(grid[t, :n])
        x = b[grid[t, :n]] * beta / scale[t]
        if t:
            move += (alpha[t - 1][:n].T @ x) * a
            beta = x @ a.T
        else:
            move += (enter[later].T @ x[later]) * a
            start += gamma[lead].sum(axis=0)
    g, s = np.concatenate(gammas), np.concatenate(symbols)
    for i in range(k):
        emit[i] += np.bincount(s, weights=g[:, i], minlength=m)
    return start, move, emit, like


def log_likelihoods(model: HMM, seqs: list[np.ndarray], size: int = SEGMENT) -> np.ndarray:
    """Exact log-likelihood of each whole sequence."""
    out = np.zeros(len(seqs))
    grid, length, owner = segments(seqs, size)
    live = _live(length)
    if not live:
        return out
    lead, f, _ = borders(model, grid, length, owner)
    f[~lead] = f[~lead] @ model.move
    b = np.ascontiguousarray(model.emit.T)
    logs, ones = np.zeros(len(owner)), np.ones(len(model.start))
    for t, n in enumerate(live):
        f = (f if t == 0 else f[:n] @ model.move) * b[grid[t, :n]]
        c = f @ ones
        f /= c[:, None]
        logs[:n] += np.log(c)
    np.add.at(out, owner, logs)
    return out


def _batched(column: pa.Array) -> Iterator[list[np.ndarray | None]]:
    held: list[np.ndarray | None] = []
    size = 0
    for raw in texts(column):
        held.append(None if raw is None else np.frombuffer(raw, np.uint32))
        size += 0 if raw is None else len(raw) // 4
        if size >= BATCH_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _round(seqs: DataFrame, model: HMM) -> HMM:
    """One Baum-Welch round over the stored sequences.  Counts have one row for
    each symbol, then for each state's moves, then for the starts."""
    k, m = model.emit.shape
    names = [f"n{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + k + 1, k))
        for b in batches:
            for part in _batched(b.column("symbols")):
                start, move, emit, _ = expected_counts(model, [x for x in part if x is not None and len(x)])
                total[:m] += emit.T
                total[m : m + k] += move
                total[m + k] += start
        whole = np.rint(total * _UNIT).astype(np.int64)
        at = np.flatnonzero(whole.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(whole[at, i]) for i in range(k))], ["i", *names])

    counts = np.zeros((m + k + 1, k))
    parts = seqs.select("symbols").mapInArrow(lean(run), ", ".join(f"{n} bigint" for n in ["i", *names]))
    # one row for each symbol of the model comes back
    got = parts.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    counts[got.column("i").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1) / _UNIT
    start = counts[m + k] + 1e-2
    move = counts[m : m + k] + 1e-2
    emit = counts[:m].T + 1e-3
    return HMM(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: int = VOCABULARY,
    states: int = STATES,
    rounds: int = ROUNDS,
) -> tuple[HMM, DataFrame]:
    """The model, and the sequences it was trained on.  ``vocabulary`` is the
    least number of words with a symbol of their own."""
    counts = stored(word_counts(docs, text_col), "hmm-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    vocabulary, classes = model_size(total, vocabulary)
    top = most_frequent(counts, vocabulary)
    known = [w for w, _ in top]
    unigram = np.array([n for _, n in top] + [(total - sum(n for _, n in top)) / classes] * classes, float)
    seqs = stored(sequences(docs, id_col, text_col, known, classes), "hmm-sequences")
    model = HMM.initial(unigram, states)
    for _ in range(rounds):
        model = _round(seqs, model)
    return model, with_shares(seqs, *class_shares(counts, known, classes))


def score(seqs: DataFrame, model: HMM) -> DataFrame:
    """(id, n_words, log_likelihood, perplexity) of sequences with shares."""
    kind = seqs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: list[int | None] = []
            like: list[float | None] = []
            for part in _batched(b.column("symbols")):
                got = log_likelihoods(model, [x if x is not None else np.zeros(0, np.uint32) for x in part])
                n += [None if x is None else len(x) for x in part]
                like += [None if x is None else float(y) for x, y in zip(part, got)]
            like = [None if y is None else y + t for y, t in zip(like, b.column("tail").to_pylist())]
            ppl = [float(np.exp(-y / x)) if x else None for x, y in zip(n, like)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(like, pa.float64()), pa.array(ppl, pa.float64())],
                ["id", "n_words", "log_likelihood", "perplexity"],
            )

    return seqs.select("id", "symbols", "tail").mapInArrow(lean(run), f"id {kind}, n_words bigint, log_likelihood double, perplexity double")


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Trains on ``docs`` and scores each of its rows."""
    model, seqs = train(docs, id_col, text_col, **options)
    return score(seqs, model).withColumnRenamed("id", id_col)
