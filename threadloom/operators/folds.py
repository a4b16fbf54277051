"""Order-dependent folds of sessions, as windows and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["harness", "id", "source"]


def first_known(value: Column, order: Column) -> Column:
    """The first value that isn't null, an aggregate."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_known(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def carry_forward(df: DataFrame, key: list[str], order: str, column: str, out: str) -> DataFrame:
    """The last known value at or before each row."""
    by = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, True).over(by))


def runs(df: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """Rows numbered by runs of equal neighbours: adds ``run`` from 0."""
    by = Window.partitionBy(*key).orderBy(order)
    new = (~F.lag(column).over(by).eqNullSafe(F.col(column))).cast("int")
    marked = df.withColumn("_new", F.when(F.row_number().over(by) == 1, 0).otherwise(new))
    return marked.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def zip_ordinals(left: DataFrame, right: DataFrame, key: list[str], order: str) -> DataFrame:
    """The n-th row of one side beside the n-th of the other."""
    by = Window.partitionBy(*key).orderBy(order)
    a = left.withColumn("nth", F.row_number().over(by).cast("bigint"))
    b = right.withColumn("nth", F.row_number().over(by).cast("bigint"))
    drop = [c for c in b.columns if c not in key and c != "nth"]
    return a.join(b.select(*key, "nth", *[F.col(c).alias(f"r_{c}") for c in drop]), [*key, "nth"])


def first_appearance_ordinals(df: DataFrame, key: list[str], order: str, column: str, out: str) -> DataFrame:
    """Numbers from 1 in the order in which values first appear."""
    firsts = df.withColumn("_first", F.min(order).over(Window.partitionBy(*key, column)))
    return firsts.withColumn(out, F.dense_rank().over(Window.partitionBy(*key).orderBy("_first")).cast("bigint")).drop("_first")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _chunk_numbers(sizes: pd.Series, budget: pd.Series) -> pd.Series:
    out = []
    for row, most in zip(sizes, budget):
        numbers = np.zeros(len(row), np.int64)
        n = used = 0
        for i, size in enumerate(row.tolist()):
            if used > 0 and used + size > most:
                n, used = n + 1, 0
            used += size
            numbers[i] = n
        out.append(numbers)
    return pd.Series(out)


def greedy_chunks(sizes: DataFrame, key: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows with ``chunk`` from 0: a new chunk begins where the next row would
    pass the budget; a row larger than it stands alone.  One pass over the sizes of a
    session, which travel as an array."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(size).cast("bigint").alias("size"))))
    items = sizes.groupBy(*key).agg(listed.alias("_items"))
    numbers = _chunk_numbers(F.transform("_items", lambda x: x["size"]), F.lit(budget).cast("bigint"))
    pairs = items.select(*key, F.explode(F.arrays_zip(F.col("_items"), numbers.alias("c"))).alias("z"))
    return pairs.select(*key, F.col("z._items.ord").alias(order), F.col("z._items.size").alias(size), F.col("z.c").alias("chunk"))


def balanced_shards(df: DataFrame, key: list[str], order: str, size: str, shards: int) -> DataFrame:
    """Contiguous ranges of about equal total size: adds ``shard``."""
    all_ = Window.partitionBy(*key)
    before = F.sum(size).over(all_.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return df.withColumn("shard", F.floor(before * shards / F.greatest(F.sum(size).over(all_), F.lit(1))).cast("bigint"))


def active_path(nodes: DataFrame, leaves: DataFrame, key: list[str]) -> DataFrame:
    """Nodes on the way from each leaf to its root.  ``nodes`` has (key, node,
    parent), ``leaves`` (key, node); adds ``depth``, counted from the end.  A loop, a
    leaf or a parent that isn't there gives all nodes of the session, in their order.

    A session's nodes travel as arrays and are walked in one pass, however deep."""
    listed = F.sort_array(F.collect_list(F.struct("node", "parent")))
    per = nodes.groupBy(*key).agg(listed.alias("_nodes")).join(leaves.select(*key, F.col("node").alias("_leaf")), key)

    @F.pandas_udf(T.ArrayType(nodes.schema["node"].dataType))
    def walk(listed: pd.Series, leaf: pd.Series) -> pd.Series:
        out = []
        for rows, here in zip(listed, leaf):
            parents = {r["node"]: r["parent"] for r in rows}
            path: dict = {}
            while here is not None and here == here and here in parents and here not in path:
                path[here] = True
                here = parents[here]
            sound = path and (here is None or here != here)
            out.append(list(path) if sound else [r["node"] for r in rows][::-1])
        return pd.Series(out)

    found = per.select(*key, F.posexplode(walk("_nodes", "_leaf")).alias("depth", "node"))
    return found.select(*key, "node", F.col("depth").cast("bigint").alias("depth"))
