"""Exact length histogram.

Documents are aggregated by encoded length into a histogram, whose size is the
number of distinct lengths and not of documents.  Suffix sums over it answer,
for every context limit that is a length of the corpus and for the usual limits
(``LIMITS``, whether a document has that length or not), how many documents and
tokens fit, how many tokens truncation keeps, and the rank quantile there; and
for the shares of ``QUANTILES`` the least length that so many documents don't
exceed, with the same figures.

Defined cases: a null text has no length and is left out; an empty text has
length 0; ties and repeated rows each count; a very long text counts with its
whole length; a limit above the longest document truncates nothing; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZERS, stored, with_length

#: Lengths are grouped by their high bits for the suffix sums, so no single
#: task has to sort the histogram of a corpus with very long documents.
BLOCK = 4096
#: Context limits that are answered beside the lengths that occur.
LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16_384, 32_768, 65_536, 131_072, 262_144, 1_048_576)
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0)


def length_histogram(
    docs: DataFrame,
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k.tiktoken",
    folder: str = TOKENIZERS,
) -> DataFrame:
    """(length, n_docs): one shuffle of at most one row per length and task."""
    return (
        with_length(docs, text_col, tokenizer, folder, {})
        .where(F.col("n_tokens").isNotNull())
        .groupBy(F.col("n_tokens").alias("length"))
        .agg(F.count("*").alias("n_docs"))
    )


def context_limits(histogram: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """Per distinct length and per limit, taken as a context limit: documents of
    that length, documents and tokens in all, those longer, tokens that
    truncation at the limit keeps and loses, and ``docs_le`` with the share of
    documents no longer (the quantile)."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in sorted(set(limits))], "length bigint")
    if histogram.isEmpty():
        asked = asked.where("false")
    asked = asked.join(histogram, "length", "left_anti").withColumn("n_docs", F.lit(0).cast("long"))
    histogram = histogram.unionByName(asked)
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"))
    h = h.withColumn("block", F.floor(F.col("length") / BLOCK))
    inner = Window.partitionBy("block").orderBy(F.desc("length"))
    rest = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per block of lengths: a few hundred even with million-token documents
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(rest), F.lit(0)).alias("above_docs"),
        F.coalesce(F.sum("bt").over(rest), F.lit(0)).alias("above_tokens"),
        F.sum("bd").over(Window.partitionBy()).alias("total_docs"),
        F.sum("bt").over(Window.partitionBy()).alias("total_tokens"),
    )
    gt_docs = F.col("above_docs") + F.sum("n_docs").over(inner) - F.col("n_docs")
    gt_tokens = F.col("above_tokens") + F.sum("tokens").over(inner) - F.col("tokens")
    out = h.join(blocks, "block").select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "total_docs",
        "total_tokens",
        gt_docs.alias("docs_gt"),
        gt_tokens.alias("tokens_gt"),
    )
    kept = F.col("total_tokens") - F.col("tokens_gt") + F.col("context_limit") * F.col("docs_gt")
    return out.select(
        "context_limit",
        "n_docs",
        (F.col("total_docs") - F.col("docs_gt")).alias("docs_le"),
        "docs_gt",
        "total_docs",
        "total_tokens",
        kept.alias("truncated_tokens"),
        (F.col("total_tokens") - kept).alias("lost_tokens"),
        ((F.col("total_docs") - F.col("docs_gt")) / F.col("total_docs")).alias("quantile"),
    )


def quantiles(limits: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """(q, length): the least length that a share ``q`` of documents does not
    exceed, read from the suffix sums.  One aggregate for each ``q``: no join."""
    if not qs:
        return limits.sparkSession.createDataFrame([], "q double, length bigint")
    own = F.when(F.col("n_docs") > 0, F.col("context_limit"))
    least = [F.min(F.when(F.col("docs_le") >= F.lit(float(q)) * F.col("total_docs"), own)) for q in qs]
    one = limits.agg(F.array(*[F.struct(F.lit(float(q)).alias("q"), x.alias("length")) for q, x in zip(qs, least)]).alias("a"))
    return one.select(F.inline("a")).where("length IS NOT NULL")


def token_counts(
    docs: DataFrame, limits: tuple[int, ...] = LIMITS, qs: tuple[float, ...] = QUANTILES, **options
) -> DataFrame:
    """``context_limits`` of the corpus (``kind`` 'limit', null ``q``), and one
    row for each quantile (``kind`` 'quantile'), which repeats the figures of its
    length."""
    # read twice below: stored, so that texts are encoded once
    answers = stored(context_limits(stored(length_histogram(docs, **options), "length-histogram"), limits), "length-limits")
    named = quantiles(answers, qs).join(answers, F.col("length") == F.col("context_limit")).drop("length")
    plain = answers.select(F.lit("limit").alias("kind"), F.lit(None).cast("double").alias("q"), "*")
    return plain.unionByName(named.select(F.lit("quantile").alias("kind"), "*"))
