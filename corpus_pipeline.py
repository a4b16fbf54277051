"""The training-data pipeline: filters, dedup and packing over documents.

Each stage works on every row of what the one before it kept, and all but the last
give the columns of ``documents`` in whatever names and order the table has them.
What null ids and texts, empty and very long texts, ties, repeated rows, an empty
table and other columns mean is said at each stage and tested for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from threadloom.llm.common import discard, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    A null or empty text is never toxic and stays; a null id or language stays or
    goes by its text; a score at the threshold goes; repeated rows share a fate; a
    very long text is judged whole; an empty table gives an empty one."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text.

    Null texts equal nothing and all stay; empty texts equal each other, so one
    stays; of equal texts that of the least id stays, null ids being last; of
    repeated rows one stays; very long texts are compared byte by byte; an empty
    table gives an empty one."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    A text that is null, empty or without a word stays; of a group the least id
    stays, null ids being last; of repeated rows one stays; a very long text counts
    with all its words; an empty table gives an empty one."""
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus.

    Null and short texts stay as they are; a document of which no word is left goes;
    the passage stays in the document of the least id (null ids last), and there at
    its first place; repeated rows are copies of each other; a very long text is cut
    like others; an empty table gives an empty one."""
    return suffix_dedup.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Context windows of what is left.

    Null and empty texts take no place; a text with a null id is packed as a segment
    with a null id; repeated rows each get a place; pieces of equal length rank by id;
    a very long text is cut into full windows first; an empty table gives no
    window."""
    return packing.pack(docs, unknown=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: The classifier, fingerprints and tokenizer can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared
    folder and read again.  What a stage stored on its way, and the table that it
    read, are deleted once its result is written, so that the folder holds two stages
    at most."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as result:
            after = result(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if n:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
