"""Toxicity by a convolutional text classifier.

A word's vector is the sum of hashed embeddings of the word and of its first 3,
4 and 5 letters.  Filters of width 1, 2 and 3 run over the whole text, each is
max-pooled over the document, and a logistic layer gives the score.  Trained in
numpy; the threshold of each language is calibrated on held-out documents.

The classifier is fitted on every labelled document, one row for each id.  Up to
``SHARD_ROWS`` of them are fitted at once.  More are dealt to shards by their ids'
hashes: each shard is a task that trains on from the common model, what the shards
changed is averaged (an embedding over the shards that learned it), and that is
repeated for each of ``ROUNDS``.  A fifth of the documents is held out for the
thresholds (if that has no toxic one, thresholds come from all); beyond
``SHARD_ROWS`` scores are counted by steps of 1/``STEPS`` for that.  A threshold stays
within ``THRESHOLD_RANGE``.  Every document is scored over its whole text.

Defined cases: a null or empty text (or one without a word) has no score and is
never toxic; a null language, or one with few labels, gets the threshold over
all; a score that equals the threshold (a tie) is toxic; a document labelled twice
differently counts as toxic; of rows with one id the one of least language and text
hash is learned from, and each gets its verdict; a very long text is scored whole;
without a toxic and a clean label nothing can be learned and no document is toxic;
an empty table gives an empty one; other columns pass through ``drop_toxic``
untouched in whatever names they have.
"""

from __future__ import annotations

import copy
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, pick, position, stored, texts, unpick

#: Labelled rows that are fitted at once.
SHARD_ROWS = 8_000
#: Labelled ids of a broadcast; more are joined with the documents a slice at a time.
LABEL_BROADCAST = 2_000_000
STEPS = 1 << 16
#: Words that are scored at once, and distinct words of a memo: they bound a task's memory.
SPAN_WORDS = 50_000
MEMO_WORDS = 60_000
#: Clean documents are the harder half to leave alone: so many for each toxic one.
CLEAN_FACTOR = 2
BUCKETS = 1 << 16
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 5
#: Epochs of each round of training by shards.
ROUNDS = (3, 2)
PREFIXES = (3, 4, 5)
#: A language with fewer held-out toxic documents gets the overall threshold.
LEAST_TOXIC = 5
#: Few held-out documents can't move a threshold out of this.
THRESHOLD_RANGE = (0.3, 0.9)
WORD = re.compile(r"\w+")
_PAD = max(WIDTHS) - 1
_FEATURES = 1 + len(PREFIXES)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordTable(dict):
    """word -> number of its row in ``rows``, the bucket numbers of its
    features, kept flat.  Row 0 is the padding between documents."""

    def __init__(self, most: int = MEMO_WORDS):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.rows = array("i", (BUCKETS,) * _FEATURES)

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest
        n = self[word] = len(self.rows) // _FEATURES
        self.rows.append(h(word) % BUCKETS)
        self.rows.extend([h(f"{k}<{word[:k]}") % BUCKETS for k in PREFIXES])
        return n

    def ids(self, doc: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, doc), np.int32, len(doc))

    def features(self, used: np.ndarray) -> np.ndarray:
        return np.array(self.rows, np.int32).reshape(-1, _FEATURES)[used]


def layout(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' row numbers in one array with padding after each; starts and
    lengths."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(sizes + _PAD) - sizes - _PAD
    ids = np.zeros(int((sizes + _PAD).sum()), np.int32)
    for s, d in zip(starts.tolist(), docs):
        ids[s : s + len(d)] = d
    return ids, starts, sizes


@dataclass
class Model:
    """Embeddings, filters and output layer, with thresholds by language."""

    emb: np.ndarray
    conv: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    overall: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        emb = r.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        emb[BUCKETS] = 0
        return cls(
            emb,
            [r.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
            0.0,
        )

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = self.emb[rows[:, 0]].copy()
        for k in range(1, rows.shape[1]):
            v += self.emb[rows[:, k]]
        return v

    def activations(self, x: np.ndarray, local: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(filters, positions) before the bias.  ``x`` has the vectors of the
        distinct words, which are multiplied by all filters before they are
        spread over the text; windows that begin in padding are -inf."""
        weights = np.concatenate([c[j] for c in self.conv for j in range(len(c))], axis=1)
        spread = np.take((x @ weights).T.copy(), local, axis=1)
        act = np.empty((FILTERS * len(WIDTHS), len(local)), np.float32)
        row = 0
        for k, w in enumerate(WIDTHS):
            part = act[k * FILTERS : (k + 1) * FILTERS]
            part[:] = spread[row : row + FILTERS]
            for j in range(1, w):
                part[:, :-j] += spread[row + j * FILTERS : row + (j + 1) * FILTERS, j:]
            row += w * FILTERS
        pads = (starts + sizes)[:, None] + np.arange(_PAD)
        act[:, pads.ravel()] = -np.inf
        return act

    def score(self, x: np.ndarray, local: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(self.activations(x, local, starts, sizes), starts, axis=1).T
        hidden = np.maximum(top + np.concatenate(self.bias), 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.overall) if lang is not None else self.overall


def _spans(docs: list, size: int) -> Iterator[slice]:
    """Slices of consecutive documents with about ``size`` words."""
    start, count = 0, 0
    for i, d in enumerate(docs):
        count += len(d) + _PAD
        if count >= size:
            yield slice(start, i + 1)
            start, count = i + 1, 0
    if start < len(docs):
        yield slice(start, len(docs))


@dataclass
class State:
    """A model in training, with Adagrad's sums of squares."""

    model: Model
    emb: np.ndarray
    par: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, seed: int = 7) -> State:
        m = Model.fresh(seed)
        params = [np.full(p.shape, 1e-3, np.float32) for p in (*m.conv, *m.bias)]
        return cls(m, np.full((BUCKETS + 1, 1), 1e-3, np.float32), params, np.full(m.out.shape, 1e-3, np.float32), 1e-3)

    def table(self) -> np.ndarray:
        """Embeddings, and in the last column their sums of squares."""
        return np.concatenate([self.model.emb, self.emb], axis=1)

    def rest(self) -> np.ndarray:
        m = self.model
        parts = [*m.conv, *m.bias, m.out, [m.out_bias], *self.par, self.out, [self.out_bias]]
        return np.concatenate([np.asarray(p, np.float64).ravel() for p in parts])

    def add(self, table: np.ndarray, rest: np.ndarray) -> None:
        m = self.model
        m.emb += table[:, :-1]
        self.emb += table[:, -1:]
        at = 0
        for p in (*m.conv, *m.bias, m.out, None, *self.par, self.out):
            if p is None:
                m.out_bias += float(rest[at])
                at += 1
            else:
                p += rest[at : at + p.size].reshape(p.shape).astype(np.float32)
                at += p.size
        self.out_bias += float(rest[at])


def class_weights(toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    return np.where(toxic, n / max(1, 2 * n_toxic), n / max(1, 2 * (n - n_toxic)))


def train(
    docs: list[np.ndarray], table: WordTable, toxic: np.ndarray, epochs: int = EPOCHS, seed: int | list[int] = 7,
    state: State | None = None, weight: np.ndarray | None = None,
) -> Model:
    """Adagrad on the logistic loss; the gradient reaches only the words that
    the pooling picked, so a step's cost is that of its forward pass.  ``state``,
    if given, is trained further."""
    state = State.fresh(seed) if state is None else state
    m, g_emb, g_par, g_out, g_ob = state.model, state.emb, state.par, state.out, state.out_bias
    rng = np.random.default_rng(seed)
    weight = class_weights(toxic, len(toxic), toxic.sum()) if weight is None else weight
    params = [*m.conv, *m.bias]
    rows_of = np.array(table.rows, np.int32).reshape(-1, _FEATURES)
    rate, batch = 0.1, 32
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            ids, starts, sizes = layout([docs[i] for i in pick])
            used, local = np.unique(ids, return_inverse=True)
            rows = rows_of[used]
            vec = m.vectors(rows)
            act = m.activations(vec, local, starts, sizes)
            arg = np.array([a + act[:, a : a + max(z, 1)].argmax(axis=1) for a, z in zip(starts.tolist(), sizes.tolist())])
            top = act[np.arange(act.shape[0]), arg]
            pre = top + np.concatenate(m.bias)
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.out_bias, -30, 30)))
            d = ((p - toxic[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_out, d_ob = hidden.T @ d, float(d.sum())
            d_pre = (d[:, None] * m.out) * (pre > 0)
            touched: dict[str, list] = {"row": [], "grad": []}
            grads = []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                dp, at = d_pre[:, cols], arg[:, cols]
                g = np.zeros_like(m.conv[k])
                for j in range(w):
                    pos = np.minimum(at + j, len(local) - 1)
                    g[j] = np.einsum("nf,nfd->df", dp, vec[local[pos]])
                    touched["row"].append(rows[local[pos].ravel()])
                    touched["grad"].append((dp[:, :, None] * m.conv[k][j].T[None]).reshape(-1, DIM))
                grads.append(g)
            grads += [d_pre[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            for q, g, acc in zip(params, grads, g_par):
                acc += g * g
                q -= rate * g / np.sqrt(acc)
            g_out += d_out * d_out
            m.out -= rate * d_out / np.sqrt(g_out)
            g_ob += d_ob * d_ob
            m.out_bias -= rate * d_ob / np.sqrt(g_ob)
            feats = np.concatenate(touched["row"])
            grad = np.repeat(np.concatenate(touched["grad"]), feats.shape[1], axis=0)
            uniq, back = np.unique(feats.ravel(), return_inverse=True)
            total = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(total, back, grad)
            total[uniq == BUCKETS] = 0
            g_emb[uniq] += (total * total).mean(axis=1, keepdims=True)
            m.emb[uniq] -= rate * total / np.sqrt(g_emb[uniq])
    state.out_bias = g_ob
    return m


def score_ids(m: Model, docs: list[np.ndarray], table: WordTable) -> np.ndarray:
    """Scores of documents given as rows of ``table``; a batch's distinct words
    get their vectors once."""
    out = np.zeros(len(docs))
    n_rows = len(table.rows) // _FEATURES
    for s in _spans(docs, SPAN_WORDS):
        ids, starts, sizes = layout(docs[s])
        seen = np.zeros(n_rows, bool)
        seen[ids] = True
        local = (np.cumsum(seen) - 1)[ids]
        x = m.vectors(table.features(np.flatnonzero(seen)))
        out[s] = m.score(x, local, starts, sizes)
    return out


def score_words(m: Model, docs: list[list[str]], table: WordTable | None = None) -> np.ndarray:
    """Scores of documents given as words."""
    table = WordTable() if table is None else table
    if len(table) > table.most:
        table.reset()
    return score_ids(m, [table.ids(d) for d in docs], table)


def _scores(m: Model, docs: Iterator[list[str]]) -> Iterator[float | None]:
    """The score of each document, None without a word; few are held at a time."""
    table, held, size = WordTable(), [], 0
    for d in docs:
        held.append(table.ids(d))
        size += len(d)
        if size > SPAN_WORDS:
            yield from (float(x) if len(h) else None for x, h in zip(score_ids(m, held, table), held))
            held, size = [], 0
            if len(table) > table.most:
                table.reset()
    if held:
        yield from (float(x) if len(h) else None for x, h in zip(score_ids(m, held, table), held))


def best_threshold(score: np.ndarray, toxic: np.ndarray, clean: np.ndarray | None = None) -> float:
    """The middle of the widest gap among thresholds of best F1.  ``toxic`` marks the
    toxic documents, or counts them for each score if ``clean`` counts the others."""
    order = np.argsort(-score, kind="stable")
    s, t = score[order], toxic[order]
    hit = np.cumsum(t)
    said = np.arange(1, len(s) + 1) if clean is None else hit + np.cumsum(clean[order])
    f1 = 2 * hit / (said + max(1, t.sum()))
    last = np.append(s[1:] != s[:-1], True)
    f1 = np.where(last, f1, -1)
    best, gap = 0.5, -1.0
    for i in np.flatnonzero(f1 == f1.max()):
        low = s[i + 1] if i + 1 < len(s) else 0.0
        if s[i] - low > gap:
            best, gap = (s[i] + low) / 2, s[i] - low
    return float(np.clip(best, *THRESHOLD_RANGE))


def fit(sample: list[tuple[str | None, str | None, int]], epochs: int = EPOCHS) -> Model | None:
    """A model from (text, lang, toxic) rows; a fifth of them is held out for
    the thresholds.  None if a class is missing."""
    table = WordTable(1 << 60)  # bounded by the sample
    rows = [(table.ids(words(t)), lang, bool(x)) for t, lang, x in sample if t]
    rows = [r for r in rows if len(r[0])]
    toxic = np.array([r[2] for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    docs = [r[0] for r in rows]
    held = np.zeros(len(rows), bool)
    for kind in (toxic, ~toxic):
        held[np.flatnonzero(kind)[4::5]] = True
    m = train([docs[i] for i in np.flatnonzero(~held)], table, toxic[~held], epochs)
    if not toxic[held].any():
        held[:] = True
    at = np.flatnonzero(held)
    score = score_ids(m, [docs[i] for i in at], table)
    m.overall = best_threshold(score, toxic[at])
    langs = np.array([rows[i][1] or "" for i in at])
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if toxic[at][own].sum() >= LEAST_TOXIC and not toxic[at][own].all():
            m.thresholds[lang] = best_threshold(score[own], toxic[at][own])
    return m


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), one row for each labelled id."""
    marks = pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> list[tuple[str, str, int]]:
    """All labelled rows for a fit at once, or only ``sample_rows``, for trials.  Strata
    are made of ids and languages alone; texts are fetched for the drawn ids only."""
    marks = _marks(labels)
    known = pick(docs, doc_id="doc_id", lang="lang", text="text")
    thin = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).join(marks, "doc_id")
    drawn = thin.select("doc_id", "toxic")
    if sample_rows is not None:
        by = Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
        drawn = (
            thin.withColumn("k", F.row_number().over(by))
            .withColumn("k", F.when(F.col("toxic") > 0, F.col("k")).otherwise(F.floor(F.col("k") / CLEAN_FACTOR)))
            .orderBy("k", F.desc("toxic"), "lang", "doc_id")
            .limit(sample_rows)
            .select("doc_id", "toxic")
        )
    # bounded by sample_rows or SHARD_ROWS, so a broadcast; one row comes back for each id
    one = F.struct(F.col("lang").isNull().alias("unknown"), "lang", F.xxhash64("text").alias("h"), "text", "toxic")
    rows = known.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(one).alias("r"))
    found = rows.select("doc_id", "r.text", "r.lang", "r.toxic").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    found = found.select(["text", "lang", "toxic"]).take(pa.array(order))
    return list(zip(*(found.column(c).to_pylist() for c in found.column_names)))


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Documents with labels.  Texts aren't shuffled for it: the labels are broadcast, and
    if they are many, a slice after the other, of which the results are stored."""
    known = pick(docs, doc_id="doc_id", lang="lang", text="text").where("text IS NOT NULL")
    slices = max(1, -(-marks.count() // LABEL_BROADCAST))
    if slices == 1:
        return known.join(F.broadcast(marks), "doc_id")
    of = F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(slices))
    parts = [known.where(of == k).join(F.broadcast(marks.where(of == k)), "doc_id") for k in range(slices)]
    return reduce(DataFrame.unionByName, [stored(p, "toxicity-labelled") for p in parts])


def _dealt(rows: DataFrame, shards: int, held: bool | None) -> DataFrame:
    """(shard, doc_id, lang, text, toxic), a partition for each shard, where all rows of
    an id stand together, the one to learn from first.  ``held``: only those held out,
    or only the others."""
    if held is not None:
        rows = rows.where((F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0) == held)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", F.asc_nulls_last("lang"), F.xxhash64("text"))
    return rows.select("shard", "doc_id", "lang", "text", F.col("toxic") > 0)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None, list[str], bool]]:
    """(shard, lang, words, toxic) of the first row of each id, if it has a word."""
    last: object = None
    for b in batches:
        shard, ids, langs, marks = (b.column(k).to_pylist() for k in (0, 1, 2, 4))
        for k, t in enumerate(texts(b.column(3))):
            if ids[k] != last and (w := words(t)):
                yield shard[k], langs[k], w, marks[k]
            last = ids[k]


def _shard_run(state: State, epochs: int, turn: int, pieces: int, n: int, n_toxic: int):
    """Trains on a shard: (piece, shard, rows, toxic, change) of the table's pieces and, as
    piece -1, of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(1 << 60)  # bounded by the shard
        rows = [(shard, lang, table.ids(w), toxic) for shard, lang, w, toxic in _learned(batches)]
        if not rows:
            return
        shard, toxic = rows[0][0], np.array([r[3] for r in rows], bool)
        own = copy.deepcopy(state)
        train([r[2] for r in rows], table, toxic, epochs, [7, turn, shard], own, class_weights(toxic, n, n_toxic))
        change = own.table() - state.table()
        parts = [(-1, own.rest() - state.rest()), *enumerate(np.array_split(change, pieces))]
        for k, x in parts:
            columns = [pa.array([v], t) for v, t in ((k, pa.int32()), (shard, pa.int32()), (len(rows), pa.int64()), (int(toxic.sum()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes()], pa.binary())], ["piece", "shard", "n", "n_toxic", "change"])

    return run


def _mean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each piece, rows sorted by piece and shard.  An embedding's mean
    is over the shards that learned it."""
    piece, total, seen, n, n_toxic = None, np.zeros(0), np.zeros(0), 0, 0

    def done() -> pa.RecordBatch:
        mean = (total / np.maximum(seen, 1)).astype(np.float64 if piece == -1 else np.float32)
        columns = [pa.array([v], t) for v, t in ((piece, pa.int32()), (n, pa.int64()), (n_toxic, pa.int64()), (mean.tobytes(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["piece", "n", "n_toxic", "change"])

    for b in batches:
        for k, w, t, raw in zip(b.column("piece").to_pylist(), b.column("n").to_pylist(), b.column("n_toxic").to_pylist(), b.column("change")):
            x = np.frombuffer(raw.as_buffer(), np.float64) if k == -1 else np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, DIM + 1)
            if k != piece:
                if piece is not None:
                    yield done()
                piece, total, n, n_toxic = k, np.zeros(x.shape), 0, 0
                seen = np.zeros(1 if k == -1 else (len(x), 1))
            total += w * x.astype(np.float64)
            seen += w if k == -1 else w * (x[:, -1:] > 0)
            n, n_toxic = n + w, n_toxic + t
    if piece is not None:
        yield done()


def _score_counts(model: Model):
    """(lang, step, toxic, clean): how many documents have a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[tuple[str, bool]] = []

        def docs() -> Iterator[list[str]]:
            for _, lang, w, toxic in _learned(batches):
                of.append((lang or "", toxic))
                yield w

        score = list(_scores(model, docs()))
        counts = Counter((lang, round(x * STEPS), toxic) for x, (lang, toxic) in zip(score, of))
        keys = list(counts)
        toxic = [n if k[2] else 0 for k, n in counts.items()]
        clean = [0 if k[2] else n for k, n in counts.items()]
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "step", "toxic", "clean"])

    return run


def _set_thresholds(model: Model, rows: DataFrame) -> bool:
    """Thresholds from the scores of all ``rows``; False if none is toxic."""
    counts = rows.mapInArrow(lean(_score_counts(model)), "lang string, step int, toxic bigint, clean bigint")
    sums = [F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")]
    found = counts.groupBy("lang", "step").agg(*sums).toArrow()  # at most STEPS + 1 rows for a language
    langs = np.array(found.column("lang").to_pylist(), object)
    step, toxic, clean = (found.column(c).to_numpy() for c in ("step", "toxic", "clean"))
    if not toxic.sum():
        return False

    def best(at: np.ndarray) -> float:
        steps, back = np.unique(step[at], return_inverse=True)
        t, c = (np.bincount(back, x[at], len(steps)) for x in (toxic, clean))
        return best_threshold(steps / STEPS, t, c)

    model.overall = best(np.ones(len(step), bool))
    for lang in sorted(set(langs.tolist()) - {""}):
        own = langs == lang
        if toxic[own].sum() >= LEAST_TOXIC and clean[own].sum():
            model.thresholds[lang] = best(own)
    return True


def fit_shards(docs: DataFrame, marks: DataFrame, n: int, n_toxic: int, shard_rows: int) -> Model | None:
    """A model from all labelled documents, by shards of about ``shard_rows``."""
    rows = _labelled(docs, marks)
    shards = -(-n // shard_rows)
    pieces = max(8, shards // 8)
    state = State.fresh()
    for turn, epochs in enumerate(ROUNDS):
        run = _shard_run(state, epochs, turn, pieces, n, n_toxic)
        changes = _dealt(rows, shards, False).mapInArrow(lean(run), "piece int, shard int, n bigint, n_toxic bigint, change binary")
        changes = changes.repartitionById(pieces + 1, F.col("piece") + 1).sortWithinPartitions("piece", "shard")
        mean = {r.piece: r for r in changes.mapInArrow(lean(_mean_run), "piece int, n bigint, n_toxic bigint, change binary").collect()}
        if not mean or not 0 < mean[-1].n_toxic < mean[-1].n:
            return None
        table = np.concatenate([np.frombuffer(mean[k].change, np.float32).reshape(-1, DIM + 1) for k in range(pieces)])
        state.add(table, np.frombuffer(mean[-1].change, np.float64))
    if not _set_thresholds(state.model, _dealt(rows, shards, True)):
        _set_thresholds(state.model, _dealt(rows, shards, None))
    return state.model


def learn(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Model | None:
    """A model from all labelled documents."""
    marks = _marks(labels)
    counted = marks.join(pick(docs, doc_id="doc_id"), "doc_id", "left_semi")
    n, n_toxic = counted.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    if n <= shard_rows:
        return fit(training_sample(docs, labels))
    return fit_shards(docs, marks, n, n_toxic, shard_rows)


def _judge(model: Model | None, columns: list[str], inside: tuple[int, int] | None = None):
    """``inside``: the places of language and text in the struct ``row``, so that a text
    isn't sent twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, text = (b.column(c) for c in ("lang", "text")) if inside is None else map(b.column("row").field, inside)
            langs = lang.to_pylist()
            docs = map(words, texts(text))
            score = [None] * len(langs) if model is None else list(_scores(model, docs))
            verdict = [x is not None and x >= model.threshold(lang) for x, lang in zip(score, langs)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in columns], pa.array(score, pa.float64()), pa.array(verdict, pa.bool_())],
                [*columns, "score", "toxic"],
            )

    return run


def _scored(rows: DataFrame, model: Model | None, keep: list[str], inside: tuple[int, int] | None = None) -> DataFrame:
    schema = T.StructType(
        [*[rows.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    )
    return rows.mapInArrow(lean(_judge(model, keep, inside)), schema)


def classify(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, score, toxic) of every row, scored in one pass without a shuffle."""
    model = learn(docs, labels, shard_rows)
    return _scored(pick(docs, doc_id="doc_id", lang="lang", text="text"), model, ["doc_id", "lang"])


def drop_toxic(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` without the rows that are judged toxic."""
    model = learn(docs, labels, shard_rows)
    inside = position(docs, "lang"), position(docs, "text")
    return unpick(_scored(pick(docs, row=True), model, ["row"], inside).where(~F.col("toxic")), docs)
