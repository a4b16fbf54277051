"""Extraction of searchable lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of, trim_end

KEY = ["harness", "id", "source"]


def meta_lines(sessions: DataFrame) -> DataFrame:
    """Title, folder and branch of a session, in this order."""
    fields = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("v")) for i, c in enumerate(("title", "cwd", "git_branch"))])
    rows = sessions.select(*KEY, "seq", F.explode(fields).alias("f")).where("f.v IS NOT NULL")
    rows = rows.select(*KEY, "seq", F.col("f.k").alias("field"), F.posexplode(lines_of(F.col("f.v"))).alias("line_no", "text"))
    return rows.select(
        *KEY, "seq", F.lit(0).cast("bigint").alias("msg_idx"), F.lit("meta").alias("origin"), F.lit(0).alias("part"), "field", "line_no", "text"
    )


def message_lines(messages: DataFrame) -> DataFrame:
    rows = messages.select(*KEY, "seq", "msg_idx", F.col("role").alias("origin"), F.posexplode(lines_of(F.col("text"))).alias("line_no", "text"))
    return rows.select(*KEY, "seq", "msg_idx", "origin", F.lit(1).alias("part"), F.lit(0).alias("field"), "line_no", "text")


def lines(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(key, seq, msg_idx, origin, line_seq, text): meta lines first, then those
    of the messages; ends are trimmed and blank lines left out."""
    rows = meta_lines(sessions).unionByName(message_lines(messages))
    rows = rows.withColumn("text", trim_end(F.col("text"))).where(F.col("text") != "")
    order = Window.partitionBy(*KEY).orderBy("part", "msg_idx", "field", "line_no")
    return rows.withColumn("line_seq", (F.row_number().over(order) - 1).cast("bigint")).drop("part", "field", "line_no")
