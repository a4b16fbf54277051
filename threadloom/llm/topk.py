"""Exact top-k search by MaxScore.

Documents are tokenized once, for the terms of the queries only; what is stored
is one row of (term, frequency) per document.  Each task is a shard: it walks
its documents in blocks, holding the postings of a block by term.  For a query,
terms are ordered by their greatest score in the block; the longest prefix whose
bounds sum to less than the query's k-th score so far is non-essential.  Only
postings of essential terms are traversed; the others are probed from the
greatest bound down, and only for documents that can still compete.  The k best
of the shards are merged by one small window.

Scores are BM25 (k1 = 1.2, b = 0.75) with each term's part rounded to a
millionth and kept as an integer, so sums don't depend on the order of adding,
bounds are exact, and ties fall to the lesser id.

Defined cases: a null id or text is no document; a null query, or one without a
term, finds nothing; a repeated query row is answered again; a repeated document
row is another document; terms in no document score nothing; fewer than k
matches give fewer rows; an empty table on either side gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, pick, stored, texts

K = 10
K1, B = 1.2, 0.75
BLOCK_DOCS = 8192
#: Queries answered in one pass over the documents; more take more passes, so
#: what is sent to the tasks is bounded.
QUERIES_PER_PASS = 20_000
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, n_words, terms, counts): per document the query terms in it, as
    little-endian int32 bytes."""
    chosen = pick(docs, doc_id=id_col, text=text_col)
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            sizes, terms, counts = [], [], []
            for t in texts(b.column("text")):
                w = words(t)
                sizes.append(len(w))
                ids = np.array([i for i in map(get, w) if i is not None], np.int32)
                ids, n = np.unique(ids, return_counts=True)
                terms.append(ids.tobytes())
                counts.append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n_words", "terms", "counts"],
            )

    return chosen.mapInArrow(lean(run), f"doc_id {kind}, n_words bigint, terms binary, counts binary")


def document_frequencies(stored_postings: DataFrame, n_terms: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32)
            df += np.bincount(ids, minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    parts = stored_postings.select("terms").mapInArrow(lean(run), "term bigint, df bigint")
    out = np.zeros(n_terms, np.int64)
    for r in parts.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r[0]] = r[1]
    return out


class Best:
    """The k best (score, id) of a query so far; equal scores by lesser id."""

    __slots__ = ("k", "score", "doc")

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[order], doc[order]


class Block:
    """Postings of some documents by term, with impacts and their maxima."""

    def __init__(self, doc, n_words, terms, counts, sizes, idf, mean):
        self.doc = doc
        row = np.repeat(np.arange(len(doc)), sizes)
        tf = counts.astype(np.float64)
        norm = tf + K1 * (1 - B + B * n_words[row] / mean)
        impact = np.floor(idf[terms] * tf * (K1 + 1) / norm * 1000000 + 0.5).astype(np.int64)
        order = np.argsort(terms, kind="stable")
        self.rows, self.impact = row[order], impact[order]
        held, first = np.unique(terms[order], return_index=True)
        ends = np.append(first[1:], len(order))
        tops = np.maximum.reduceat(self.impact, first) if len(first) else first
        self.of = {t: (a, z, m) for t, a, z, m in zip(held.tolist(), first.tolist(), ends.tolist(), tops.tolist())}
        self.acc = np.zeros(len(doc), np.int64)

    def search(self, terms: list[int], best: Best) -> None:
        lists = sorted((self.of[t] for t in terms if t in self.of), key=lambda x: x[2])
        if not lists:
            return
        floor = best.floor()
        bounds = np.cumsum([x[2] for x in lists])
        split = int(np.searchsorted(bounds, floor))  # lists before it can't reach the floor together
        if split == len(lists):
            return
        acc = self.acc
        touched = []
        for a, z, _ in lists[split:]:
            acc[self.rows[a:z]] += self.impact[a:z]
            touched.append(self.rows[a:z])
        rows = np.unique(np.concatenate(touched)) if len(touched) > 1 else touched[0]
        score = acc[rows]
        acc[rows] = 0
        for i in range(split - 1, -1, -1):
            live = score + bounds[i] >= floor
            rows, score = rows[live], score[live]
            if not len(rows):
                return
            a, z, _ = lists[i]
            at = np.searchsorted(self.rows[a:z], rows)
            at = np.minimum(at, z - a - 1) + a
            score = score + np.where(self.rows[at] == rows, self.impact[at], 0)
        live = score >= floor
        if live.any():
            best.add(score[live], self.doc[rows[live]])


def _blocks(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < BLOCK_DOCS:
            continue
        yield _block(held, idf, mean)
        held = []
    if any(x.num_rows for x in held):
        yield _block(held, idf, mean)


def _block(held: list[pa.RecordBatch], idf: np.ndarray, mean: float) -> Block:
    t = pa.Table.from_batches(held)
    raw = t.column("terms").to_pylist()
    return Block(
        t.column("doc_id").to_numpy(),
        t.column("n_words").to_numpy(),
        np.frombuffer(b"".join(raw), np.int32),
        np.frombuffer(b"".join(t.column("counts").to_pylist()), np.int32),
        np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw)),
        idf,
        mean,
    )


def _pass(docs: DataFrame, id_col: str, text_col: str, queries: list[tuple[int, list[str]]], k: int) -> DataFrame | None:
    """(q, doc_id, score) from each shard for (number, words) queries."""
    vocabulary: dict[str, int] = {}
    wanted = []
    for q, w in queries:
        ids = sorted({vocabulary.setdefault(x, len(vocabulary)) for x in w})
        if ids:
            wanted.append((q, ids))
    if not wanted:
        return None
    post = stored(postings(docs, id_col, text_col, vocabulary), "topk-postings")
    n, total = post.agg(F.count("*"), F.sum("n_words")).first()
    if not n:
        return None
    df = document_frequencies(post, len(vocabulary)).astype(np.float64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = (total or 0) / n
    kind = post.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for block in _blocks(batches, idf, mean):
            for (_, terms), found in zip(wanted, best):
                block.search(terms, found)
        q = np.repeat([q for q, _ in wanted], [len(x.doc) for x in best])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(q, pa.int64()),
                pa.array(np.concatenate([x.doc for x in best])),
                pa.array(np.concatenate([x.score for x in best]), pa.int64()),
            ],
            ["q", "doc_id", "score"],
        )

    return post.mapInArrow(lean(run), f"q bigint, doc_id {kind}, score bigint")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """(query id, rank, doc_id, score) for every row of ``queries``."""
    spark = docs.sparkSession
    kind = pick(queries, q=query_id).schema["q"].dataType.simpleString()
    order = Window.orderBy("qid", "text")
    asked = pick(queries, qid=query_id, text=query_text)
    # numbering sorts the queries, not the documents
    asked = stored(asked.withColumn("q", F.row_number().over(order) - 1), "topk-queries")
    n = asked.count()
    out = None
    for start in range(0, n, QUERIES_PER_PASS):
        part = asked.where((F.col("q") >= start) & (F.col("q") < start + QUERIES_PER_PASS))
        found = _pass(docs, id_col, text_col, [(r["q"], words(r["text"])) for r in part.orderBy("q").collect()], k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        id_kind = pick(docs, q=id_col).schema["q"].dataType.simpleString()
        out = spark.createDataFrame([], f"q bigint, doc_id {id_kind}, score bigint")
    by = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id")
    merged = out.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
    named = merged.join(asked.select("q", "qid"), "q").select(
        F.col("qid").cast(kind).alias(query_id), "rank", "doc_id", "score"
    )
    return named.withColumnRenamed("doc_id", id_col)


ORACLE_SQL = f"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark),
    stats AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
    tf AS (
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d)
        WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    impact AS (
        SELECT tf.doc_id, tf.term, CAST(floor(
            ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({K1}::DOUBLE + 1)
            / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * len(w) / mean)) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS s
        FROM tf JOIN df USING (term) JOIN d USING (doc_id), stats),
    scored AS (
        SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score
        FROM q JOIN impact USING (term) GROUP BY item_id, doc_id HAVING sum(s) > 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}"""
