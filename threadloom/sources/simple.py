"""The simple session document: one JSON object a file.

``{id?, timestamp?, cwd?, git_branch?, title?, cli_version?, model?,
messages: [{role, content: string | [block], timestamp?, model?, stop_reason?}]}``

Files are parsed with Spark's variant type, so documents of any shape are read;
what is opaque (tool inputs and outputs) stays JSON text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import uuid5

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "threadloom:simple")


def _text(v: Column, path: str) -> Column:
    """A string value, and null for any other type: nothing is coerced."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def _json(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, mtime, doc) of every ``*.json`` below ``path``; a file that isn't
    an object is dropped."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    meta = F.col("_metadata")
    rows = files.select(meta["file_path"].alias("source"), meta["file_modification_time"].alias("mtime"), F.try_parse_json("value").alias("doc"))
    return rows.where(F.schema_of_variant("doc").startswith("OBJECT"))


def sessions(docs: DataFrame) -> DataFrame:
    """A row per document; a missing id is the file's stem, a missing or
    malformed time the file's."""
    d = F.col("doc")
    stem = F.regexp_extract("source", r"([^/]+)\.json$", 1)
    return docs.select(
        F.lit("simple").alias("harness"),
        F.coalesce(F.when(_text(d, "$.id") != "", _text(d, "$.id")), stem).alias("id"),
        "source",
        F.coalesce(F.try_to_timestamp(_text(d, "$.timestamp")), F.col("mtime")).alias("ts"),
        *[_text(d, f"$.{k}").alias(k) for k in ("cwd", "git_branch", "title", "cli_version", "model")],
    )


def messages(docs: DataFrame) -> DataFrame:
    """(source, msg_idx, role, ts, model, stop_reason, content); entries of other
    roles contribute nothing, a missing time is the last known one."""
    entries = F.try_variant_get("doc", "$.messages", "array<variant>")
    rows = docs.select("source", "mtime", F.col("doc").alias("_d"), F.posexplode(entries).alias("entry", "m"))
    m = F.col("m")
    rows = rows.where(_text(m, "$.role").isin("user", "assistant"))
    order = Window.partitionBy("source").orderBy("entry")
    known = F.try_to_timestamp(_text(m, "$.timestamp"))
    head = F.coalesce(F.try_to_timestamp(_text(F.col("_d"), "$.timestamp")), F.col("mtime"))
    return rows.select(
        "source",
        (F.row_number().over(order) - 1).cast("bigint").alias("msg_idx"),
        _text(m, "$.role").alias("role"),
        F.coalesce(F.last(known, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), head).alias("ts"),
        _text(m, "$.model").alias("model"),
        _text(m, "$.stop_reason").alias("stop_reason"),
        F.try_variant_get(m, "$.content", "variant").alias("content"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """(source, msg_idx, block_idx, type, text, tool_use_id, tool_name,
    tool_input_json, output_text, output_json, is_error) from messages; content
    that is a string is one text block, and a call without an id gets one from
    its place."""
    c = F.col("content")
    single = F.schema_of_variant(c) == "STRING"
    parts = F.when(single, F.array(c)).otherwise(F.try_variant_get(c, "$", "array<variant>"))
    b = F.col("b")
    each = rows.select("source", "msg_idx", single.alias("plain"), F.posexplode(parts).alias("block_idx", "b"))
    kind = F.when(F.col("plain"), F.lit("text")).otherwise(_text(b, "$.type"))
    made = uuid5(NAMESPACE, F.concat_ws(":", "source", "msg_idx", "block_idx"))
    use_id = F.coalesce(_text(b, "$.id"), F.when(_text(b, "$.type") == "tool_use", made))
    return each.select(
        "source",
        "msg_idx",
        F.col("block_idx").cast("bigint").alias("block_idx"),
        kind.alias("type"),
        F.when(F.col("plain"), F.try_variant_get(b, "$", "string")).otherwise(F.coalesce(_text(b, "$.text"), _text(b, "$.thinking"))).alias("text"),
        F.coalesce(_text(b, "$.tool_use_id"), use_id).alias("tool_use_id"),
        _text(b, "$.name").alias("tool_name"),
        _json(b, "$.input").alias("tool_input_json"),
        _text(b, "$.content").alias("output_text"),
        F.when(_text(b, "$.content").isNull(), _json(b, "$.content")).alias("output_json"),
        F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)).alias("is_error"),
    ).where(F.col("type").isNotNull())


def render(sessions_: DataFrame, messages_: DataFrame) -> DataFrame:
    """(id, document): sessions with messages (id, msg_idx, role, text) as
    compact JSON with sorted keys; absent values are left out."""
    entry = F.struct(F.col("text").alias("content"), F.col("role").alias("role"))
    listed = F.sort_array(F.collect_list(F.struct("msg_idx", entry.alias("e"))))
    per = messages_.groupBy("id").agg(F.transform(listed, lambda x: x["e"]).alias("messages"))
    joined = sessions_.join(per, "id")
    kept = [c for c in ("cli_version", "cwd", "git_branch", "id", "messages", "model", "title") if c in joined.columns]
    return joined.select("id", F.to_json(F.struct(*kept)).alias("document"))
