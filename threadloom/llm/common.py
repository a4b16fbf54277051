"""What the operators of this folder share: shared-folder tables, Arrow
streaming aligned on keys, word hashing and tokenizer loading."""

from __future__ import annotations

import atexit
import base64
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
PRETOKEN_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches, from ``spark.checkpoint.dir``.

    Only a session on one machine (a local master) may leave the setting empty;
    it gets a folder of its own.  On a cluster that folder would be another one on
    every machine, so there this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        _made.append((spark, root))
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has gone, and the folder is the cluster's
        pass


@atexit.register
def clean() -> None:
    """Deletes the tables that this session's operators wrote."""
    while _made:
        _remove(*_made.pop())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like ``stored`` for results.  At the end all else that was
    stored meanwhile is deleted, so only the results take up the shared folder."""
    mark, kept = len(_made), []

    def result(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        kept.append(_made[-1])
        return out

    yield result
    for at in _made[mark:]:
        if at not in kept and "/threadloom/" in at[1]:
            _remove(*at)
            _made.remove(at)


def discard(df: DataFrame) -> None:
    """Deletes the stored table that ``df`` reads, if it is one of this session."""
    files = df.inputFiles()
    for at in [m for m in _made if files and f"{m[1].split('://')[-1]}/" in files[0]]:
        _remove(*at)
        _made.remove(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, which cuts the
    lineage: a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def registered(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted at the end with the stored tables."""
    if (spark, path) not in _made:
        _made.append((spark, path))
    return path


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows: the check before a broadcast."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it
    is: Spark then joins by a shuffle."""
    return F.broadcast(df) if fits(df, most) else df


def position(docs: DataFrame, name: str) -> int:
    """Where the column ``name`` stands; one of that spelling comes before one
    that differs in case."""
    if name in docs.columns:
        return docs.columns.index(name)
    low = [c.lower() for c in docs.columns]
    if name.lower() not in low:
        raise ValueError(f"no column {name!r} among {docs.columns}")
    return low.index(name.lower())


def pick(docs: DataFrame, row: bool = False, **columns: str) -> DataFrame:
    """The chosen columns under new names, and with ``row`` a struct of all.
    Columns are taken by position, so their names may hold dots or backticks or
    differ in case only."""
    at = {new: position(docs, old) for new, old in columns.items()}
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    whole = [F.struct(*plain.columns).alias("row")] if row else []
    return plain.select(*[F.col(f"_{i}").alias(new) for new, i in at.items()], *whole)


def unpick(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` back from the ``row`` structs of ``pick``."""
    return rows.select("row.*").toDF(*docs.columns)


class WordHash(dict):
    """word -> 64-bit hash that is the same in every process.  The memo is
    emptied when it holds ``most`` words, so a worker's memory is bounded."""

    def __init__(self, most: int = 200_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array) -> Iterator[str | None]:
    """The strings of an Arrow column one at a time, so that a batch is never
    held twice."""
    for x in column:
        yield x.as_py()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` that gives memory back to the machine when its task ends: Python workers
    live on, and what one stage held isn't the next one's."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return go


def _release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def key_chunks(
    batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65_536
) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more from batches sorted by ``keys``;
    rows of equal keys are never in two tables."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        end = whole.num_rows
        new = np.zeros(end, bool)
        for k in keys:
            values = whole.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        count = end - cut
        rows = max(rows, 2 * count) if not cut else rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def encoder(name: str, folder: str = TOKENIZERS) -> Callable[[str], list[int]]:
    """Text to token ids by a public vocabulary file of ``folder``.  Special
    tokens are never recognised inside a text."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(
            name, pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def with_length(
    docs: DataFrame, text_col: str, tokenizer: str, folder: str, keep: dict[str, str]
) -> DataFrame:
    """``keep`` ({output name: column of docs}) and ``n_tokens``, the exact
    encoded length of ``text_col``: null for a null text, 0 for an empty one."""
    chosen = pick(docs, text=text_col, **keep)
    names = list(keep)
    schema = ", ".join([f"{n} {chosen.schema[n].dataType.simpleString()}" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder)
        for b in batches:
            lengths = [None if x is None else len(encode(x)) for x in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], pa.array(lengths, pa.int64())],
                [*names, "n_tokens"],
            )

    return chosen.mapInArrow(lean(run), f"{schema}{', ' if schema else ''}n_tokens bigint")
