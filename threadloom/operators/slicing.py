"""Message ranges and the pairing of tool calls with their results."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_range(text: str) -> tuple[int | None, int | None] | None:
    """``N``, ``N-M``, ``N-`` or ``-M`` (1-based, inclusive), else None."""
    m = re.fullmatch(r"(\d*)(-?)(\d*)", text)
    if not m or not (m[1] or m[3]) or (m[3] and not m[2]):
        return None
    first = int(m[1]) if m[1] else None
    return first, (int(m[3]) if m[3] else None) if m[2] else first


def split_reference(ref: str) -> tuple[str, tuple[int | None, int | None] | None]:
    """Session reference and range after the last ``#``, if it is one."""
    head, mark, tail = ref.rpartition("#")
    span = parse_range(tail) if mark else None
    return (head, span) if span is not None else (ref, None)


def resolve_range(span: tuple[int | None, int | None], total: int) -> tuple[int, int]:
    """Half-open and 0-based; refuses 0, inverted and out-of-bounds ranges."""
    first, last = span[0] or (1 if span[0] is None else 0), total if span[1] is None else span[1]
    if first < 1 or last < 1:
        raise ValueError("messages are numbered from 1")
    if first > last:
        raise ValueError(f"range {first}-{last} is inverted")
    if last > total:
        raise ValueError(f"the session has {total} messages")
    return first - 1, last


def slice_messages(messages: DataFrame, start: int, end: int | None = None) -> DataFrame:
    rows = messages.where(F.col("msg_idx") >= start)
    return rows if end is None else rows.where(F.col("msg_idx") < end)


def tool_pairs(blocks: DataFrame, key: list[str]) -> DataFrame:
    """(key, call, use_pos, result_pos): each result with the latest use of its
    call before it.  One shuffle by the call; no join."""
    before = Window.partitionBy(*key, "call").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    use = F.max(F.when(F.col("kind") == "use", F.col("pos"))).over(before)
    rows = blocks.where(F.col("call").isNotNull()).withColumn("use_pos", use)
    return rows.where((F.col("kind") == "result") & F.col("use_pos").isNotNull()).select(
        *key, "call", "use_pos", F.col("pos").alias("result_pos")
    )


def cut_pairs(pairs: DataFrame, start: int, end: int) -> DataFrame:
    """Pairs of which just one side is in the range."""
    def inside(c: str):
        return (F.col(c) >= start) & (F.col(c) < end)
    return pairs.where(inside("use_pos") != inside("result_pos"))


def nearest_valid(sizes: DataFrame, pairs: DataFrame, key: list[str], start: int, end: int) -> DataFrame:
    """(key, start, end): the least outward expansion that cuts no pair.  A cut
    pair must come in whole, so it is the closure of the range, unique."""
    per = pairs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("use_pos", "result_pos"))).alias("pairs"))
    rows = sizes.where(F.col("n") >= end).join(per, key, "left")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            starts, ends = [], []
            for found in b["pairs"]:
                s, e = start, end
                todo = [(p["use_pos"], p["result_pos"]) for p in found] if found is not None else []
                while True:
                    cut = [(u, r) for u, r in todo if (s <= u < e) != (s <= r < e)]
                    if not cut:
                        break
                    s, e = min(s, *(u for u, _ in cut)), max(e, *(r + 1 for _, r in cut))
                starts.append(s)
                ends.append(e)
            yield b[key].assign(start=starts, end=ends)

    return rows.select(*key, "pairs").mapInPandas(close, f"{kinds}, start bigint, end bigint")


def dangling_uses(blocks: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Uses that no result answers."""
    done = pairs.select(*key, F.col("use_pos").alias("pos"))
    return blocks.where("kind = 'use'").join(done, [*key, "pos"], "left_anti")


def orphan_results(blocks: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """Results without a use before them."""
    done = pairs.select(*key, F.col("result_pos").alias("pos"))
    return blocks.where("kind = 'result'").join(done, [*key, "pos"], "left_anti")


def fifo_pairs(blocks: DataFrame, key: list[str]) -> DataFrame:
    """The n-th use goes with the n-th result, where results carry no id."""
    by = Window.partitionBy(*key, "kind").orderBy("pos")
    n = blocks.withColumn("nth", F.row_number().over(by).cast("bigint"))
    uses = n.where("kind = 'use'").select(*key, "nth", F.col("pos").alias("use_pos"))
    return uses.join(n.where("kind = 'result'").select(*key, "nth", F.col("pos").alias("result_pos")), [*key, "nth"])
