"""Plain-text projection of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["harness", "id", "source"]


def text_projection(messages: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(key, body): ``[role]`` sections in order; of a part of a session each
    section has a rule with its number in the whole session."""
    rows = messages
    part = start is not None or end is not None
    if start is not None:
        rows = rows.where(F.col("msg_idx") >= start)
    if end is not None:
        rows = rows.where(F.col("msg_idx") < end)
    section = F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.col("text"), F.lit("\n"))
    if part:
        section = F.concat(F.lit("── #"), (F.col("msg_idx") + 1).cast("string"), F.lit(" ──\n"), section)
    listed = F.sort_array(F.collect_list(F.struct("msg_idx", section.alias("s"))))
    return rows.groupBy(*KEY).agg(listed.alias("l")).select(*KEY, F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("body"))
