"""Canonical tables derived from the relational test tables.

The derivation is synthetic: it exercises the operators on tables that have no
transcripts in them, by rules that any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import title_of
from ..functions.vocab import HARNESSES

STORES = HARNESSES[:12]
KEY = ["harness", "id", "source"]


def _keys(df: DataFrame) -> DataFrame:
    """Adds the document key of ``conv_id``."""
    harness = F.element_at(F.array(*[F.lit(h) for h in STORES]), (F.col("conv_id") % len(STORES) + 1).cast("int"))
    df = df.withColumn("harness", harness).withColumn("id", F.concat(F.lit("conv-"), F.col("conv_id")))
    return df.withColumn("source", F.concat_ws("/", F.lit("/store"), "harness", "id"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(harness, id, source, seq, msg_idx, role, text); roles other than user
    and assistant contribute nothing."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.withColumn("role", F.lower(F.trim("role"))).where(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("msg_idx", (F.row_number().over(order) - 1).cast("bigint"))
    return _keys(rows).select(*KEY, F.col("conv_id").alias("seq"), "msg_idx", "role", "text")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(harness, id, source, seq, ts, cwd, git_branch, title); ``ts`` in epoch
    seconds, the title from the first user text."""
    first = (
        messages(spark, sf_dir)
        .groupBy(*KEY, "seq")
        .agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("msg_idx"))).alias("t"))
    )
    n = F.col("seq")
    return first.select(
        *KEY,
        "seq",
        (F.lit(1_780_000_000) + n * 10_000).alias("ts"),
        F.concat(F.lit("/work/repo-"), n % 7).alias("cwd"),
        F.when(n % 3 != 0, F.concat(F.lit("feat-"), n % 5)).alias("git_branch"),
        title_of(F.col("t")).alias("title"),
    )


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, kind, call, name, input): an event other than ``error`` is
    a tool use, an error the failed result of the latest use before it."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    is_use = F.col("event_type") != "error"
    rows = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
    latest = F.last(F.when(is_use, F.col("event_id")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "user_id",
        "pos",
        F.when(is_use, "use").otherwise("result").alias("kind"),
        F.when(is_use, F.col("event_id")).otherwise(latest).alias("call"),
        F.col("event_type").alias("name"),
        F.col("props").alias("input"),
    )



def _block(**given):
    """A block's struct; what isn't given is null."""
    from .stores import _BLOCK

    fields = [F.coalesce(given[f.name], F.lit(None).cast(f.dataType)).alias(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in _BLOCK.fields]
    return F.struct(*fields)


def _message(role, ts, content):
    from .stores import _MESSAGE

    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in _MESSAGE.fields}
    return F.struct(*[(none | {"role": role.alias("role"), "ts": ts.alias("ts"), "content": content.alias("content")})[f.name] for f in _MESSAGE.fields])


def _transcripts(heads: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Heads with the messages (key, pos, m) of each in order."""
    from .stores import SCHEMA

    nested = listed.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("messages"))
    joined = heads.join(nested, key)
    return joined.select(*[F.col(f.name).cast(f.dataType) if f.name in joined.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields])


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions with their messages as nested transcripts, one text each; a
    message is a minute after the one before."""
    heads = sessions(spark, sf_dir).withColumn("ts", F.timestamp_seconds("ts"))
    m = messages(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_780_000_000) + F.col("seq") * 10_000 + F.col("msg_idx") * 60)
    text = _block(type=F.lit("text"), text=F.col("text"), is_error=F.lit(False))
    listed = m.select(*KEY, F.col("msg_idx").alias("pos"), _message(F.col("role"), at, F.array(text)).alias("m"))
    return _transcripts(heads, listed, KEY)


def tool_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript for each user of the events: calls of the assistant's and
    failed results, in order, after an opening line."""
    e = tool_events(spark, sf_dir).where("kind = 'use' OR call IS NOT NULL")
    e = e.withColumn("id", F.concat(F.lit("user-"), F.col("user_id"))).withColumn("call", F.concat(F.lit("call-"), F.col("call")))
    use = F.col("kind") == "use"
    name = F.concat(F.lit("Do_"), F.col("name"))
    call = _block(
        type=F.lit("tool_use"), tool_use_id=F.col("call"), tool_kind=F.lit("Raw"), tool_name=name,
        tool_input_json=F.regexp_replace("input", " ", ""), is_error=F.lit(False),
    )
    failed = _block(type=F.lit("tool_result"), tool_use_id=F.col("call"), output_text=F.concat(F.lit("failed\nat "), F.col("pos")), is_error=F.lit(True))
    at = F.timestamp_seconds(F.lit(1_780_000_000) + F.col("pos") * 60)
    role = F.when(use, "assistant").otherwise("user")
    listed = e.select("id", "pos", _message(role, at, F.array(F.when(use, call).otherwise(failed))).alias("m"))
    users = e.select("id").distinct()
    opening = _block(type=F.lit("text"), text=F.concat(F.lit("I am "), F.col("id")), is_error=F.lit(False))
    first = users.select("id", F.lit(-1).cast("bigint").alias("pos"), _message(F.lit("user"), F.timestamp_seconds(F.lit(1_780_000_000)), F.array(opening)).alias("m"))
    heads = users.select(
        F.lit("simple").alias("harness"), "id", F.concat(F.lit("/tools/"), F.col("id")).alias("source"), F.timestamp_seconds(F.lit(1_780_000_000)).alias("ts"),
        F.lit("/work").alias("cwd"),
    )
    return _transcripts(heads, listed.unionByName(first), ["id"])
