"""Projections of transcripts (a row each, messages and blocks nested): rows of
messages and blocks, searchable lines, the text projection, pairs and counts.
All are expressions over the nested columns: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line

KEY = ["harness", "id", "source"]


def messages(rows: DataFrame) -> DataFrame:
    """(key, msg_idx, role, ts, model, stop_reason, usage, content)."""
    each = rows.select(*KEY, F.posexplode("messages").alias("n", "m"))
    return each.select(*KEY, F.col("n").cast("bigint").alias("msg_idx"), "m.*")


def blocks(rows: DataFrame) -> DataFrame:
    """(key, msg_idx, role, block_idx, type, ...), one row for each block."""
    each = messages(rows).select(*KEY, "msg_idx", "role", F.posexplode("content").alias("n", "b"))
    return each.select(*KEY, "msg_idx", "role", F.col("n").cast("bigint").alias("block_idx"), "b.*")


def tool_texts(kind: Column, name: Column, value: Column) -> Column:
    """What of a call can be searched: of a typed one its texts in order, else
    the name and the input's JSON."""

    def field(key: str) -> Column:
        return F.get_json_object(value, f"$.{key}")

    edits = F.from_json(field("edits"), "array<struct<old_string:string,new_string:string>>")
    pairs = F.flatten(F.transform(edits, lambda e: F.array(e["old_string"], e["new_string"])))
    out = (
        F.when(kind == "Command", F.array(name, field("args")))
        .when(kind == "Read", F.array(field("file_path")))
        .when(kind == "Write", F.array(field("file_path"), field("content")))
        .when(kind == "Edit", F.array(field("file_path"), field("old_string"), field("new_string")))
        .when(kind == "MultiEdit", F.concat(F.array(field("file_path")), pairs))
        .when(kind == "Bash", F.array(field("command"), field("description")))
        .otherwise(F.array(name, F.when(value != "null", value)))
    )
    return F.array_compact(out)


def block_texts(role: Column, b: Column) -> Column:
    """array of (origin, text) of a block; images have none."""
    kind = b["type"]

    def of(origin: Column | str, texts: Column) -> Column:
        o = F.lit(origin) if isinstance(origin, str) else origin
        return F.transform(texts, lambda t: F.struct(o.alias("origin"), t.alias("text")))

    shown = F.when(b["artifact"]["kind"] != "base64", b["artifact"]["value"])
    return (
        F.when(kind == "text", of(role, F.array(b["text"])))
        .when(kind == "thinking", of("thinking", F.array(b["text"])))
        .when(kind == "tool_use", of("tool_use", tool_texts(b["tool_kind"], b["tool_name"], b["tool_input_json"])))
        .when(kind == "tool_result", of("tool_result", F.array(F.coalesce(b["output_text"], b["output_json"]))))
        .when(kind == "artifact", of("assistant", F.array_compact(F.array(b["artifact"]["name"], shown))))
        .otherwise(F.array().cast("array<struct<origin:string,text:string>>"))
    )


def line_array() -> Column:
    """array of (m, b, o, t): message, block, origin and text of each searchable
    line of a transcript."""
    meta = F.array_compact(F.array("title", "cwd", "git_branch"))
    head = F.transform(meta, lambda t: F.struct(F.lit(0).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("b"), F.lit("meta").alias("o"), t.alias("t")))

    def of_block(m: Column, i: Column):
        def make(b: Column, j: Column) -> Column:
            return F.transform(
                block_texts(m["role"], b),
                lambda x: F.struct(i.cast("bigint").alias("m"), j.cast("bigint").alias("b"), x["origin"].alias("o"), x["text"].alias("t")),
            )

        return make

    body = F.flatten(F.flatten(F.transform("messages", lambda m, i: F.transform(m["content"], of_block(m, i)))))

    def cut(x: Column) -> Column:
        parts = F.transform(F.split(x["t"], "\r?\n"), lambda s: F.regexp_replace(s, r"(?U)\s+$", ""))
        return F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.struct(x["m"].alias("m"), x["b"].alias("b"), x["o"].alias("o"), s.alias("t")))

    return F.flatten(F.transform(F.concat(head, body), cut))


def lines(rows: DataFrame) -> DataFrame:
    """(key, msg_idx, block_idx, origin, line_seq, text): title, folder and branch
    first, then all blocks in order; ends are trimmed and blank lines left out."""
    each = rows.select(*KEY, F.posexplode(line_array()).alias("n", "x"))
    return each.select(
        *KEY, F.col("x.m").alias("msg_idx"), F.col("x.b").alias("block_idx"), F.col("x.o").alias("origin"),
        F.col("n").cast("bigint").alias("line_seq"), F.col("x.t").alias("text"),
    )


def _section(label: Column, text: Column) -> Column:
    end = F.when(text.endswith("\n"), "").otherwise("\n")
    return F.concat(F.lit("["), label, F.lit("]\n"), text, end)


def text(rows: DataFrame, start: int = 0, end: int | None = None, fragment: bool = False) -> DataFrame:
    """(key, body): the header, then a labelled section for each block of the
    messages ``start`` to ``end``; a blank line stands before a section unless the
    text ends with one.  Calls are numbered by their first appearance.  A
    ``fragment`` has a rule with each message's number and, if it isn't the whole,
    says which part it is.  Sessions without message ``start`` have no row."""
    total = F.size("messages")
    stop = total if end is None else F.least(F.lit(end), total)
    size = F.greatest(stop - start, F.lit(0))
    part = F.when(size > 0, F.slice("messages", start + 1, size)).otherwise(F.slice("messages", 1, 0))
    rows = rows.withColumn("_part", part)
    if fragment:
        rows = rows.where((total >= start) & (F.lit(True) if end is None else total >= end))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), one_line(value), F.lit("\n"))

    def optional(name: str, column: str) -> Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) == "", "").otherwise(field(name, F.col(column)))

    utc = F.to_utc_timestamp("ts", F.current_timezone())
    micros = F.when(F.date_format(utc, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.date_format(utc, "SSSSSS"), "000$", "")))
    started = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.lit("+00:00"))
    head = F.concat(F.lit("[session]\n"), field("id", F.col("id")), field("started", started), *[optional(n, c) for n, c in (("title", "title"), ("cwd", "cwd"), ("branch", "git_branch"), ("model", "model"))])
    if fragment:
        named = F.when(size == 1, F.concat(F.lit("#"), F.lit(start + 1))).otherwise(F.concat(F.lit(f"#{start + 1}-"), stop.cast("string")))
        partial = F.concat(F.lit("fragment="), named, F.lit("\nof="), total.cast("string"), F.lit("\n"))
        head = F.concat(head, F.when((F.lit(start) == 0) & (stop == total), "").otherwise(partial))
    called = F.array_distinct(F.flatten(F.transform("_part", lambda m: F.transform(F.filter(m["content"], lambda b: b["tool_use_id"].isNotNull()), lambda b: b["tool_use_id"]))))
    rows = rows.withColumn("_calls", called)

    def section(m: Column, b: Column) -> Column:
        kind, number = b["type"], F.array_position(F.col("_calls"), b["tool_use_id"]).cast("string")
        value, a = b["tool_input_json"], b["artifact"]
        shown = F.when(value.isin("null", "{}"), "").otherwise(value)
        place = F.when(a["kind"] == "base64", "binary data omitted").otherwise(a["value"])
        return (
            F.when(kind == "text", _section(m["role"], b["text"]))
            .when(kind == "thinking", _section(F.lit("thinking"), b["text"]))
            .when(kind == "tool_use", _section(F.concat(F.lit("tool "), number, F.lit(" "), one_line(b["tool_name"])), shown))
            .when(kind == "tool_result", _section(F.concat(F.lit("result "), number, F.when(b["is_error"], " error").otherwise("")), F.coalesce(b["output_text"], b["output_json"])))
            .when(kind == "image", _section(F.concat(F.lit("image "), one_line(b["image"]["media_type"]), F.lit(" omitted")), F.lit("")))
            .otherwise(_section(F.concat(F.lit("artifact "), one_line(a["name"])), place))
        )

    def of_message(m: Column, i: Column) -> Column:
        found = F.transform(m["content"], lambda b: F.struct(F.lit(True).alias("s"), section(m, b).alias("t")))
        if not fragment:
            return found
        rule = F.concat(F.lit("\n── #"), (i + start + 1).cast("string"), F.lit(" ──"))
        return F.concat(F.array(F.struct(F.lit(False).alias("s"), rule.alias("t"))), found)

    pieces = F.flatten(F.transform("_part", of_message))
    body = F.aggregate(pieces, head, lambda acc, x: F.concat(acc, F.when(x["s"] & ~acc.endswith("\n\n"), "\n").otherwise(""), x["t"]))
    return rows.select(*KEY, body.alias("body"))


def pairs(rows: DataFrame) -> DataFrame:
    """(key, use_idx, result_idx): messages of each result and of the latest call
    with its id before it."""
    b = blocks(rows).where(F.col("type").isin("tool_use", "tool_result")).select(*KEY, "msg_idx", "block_idx", "type", "tool_use_id")
    by = Window.partitionBy(*KEY, "tool_use_id").orderBy("msg_idx", "block_idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("type") == "tool_use", F.col("msg_idx")), True).over(by)
    return b.withColumn("use_idx", seen).where("type = 'tool_result' AND use_idx IS NOT NULL").select(*KEY, "use_idx", F.col("msg_idx").alias("result_idx"))


def counters(rows: DataFrame) -> DataFrame:
    """(documents, lines, chars) of all transcripts, in one pass."""
    per = rows.select(line_array().alias("l"))
    chars = F.aggregate("l", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["t"]))
    none = F.lit(0).cast("bigint")
    return per.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("l")), none).alias("lines"), F.coalesce(F.sum(chars), none).alias("chars"))


def roll_up(rows: DataFrame) -> DataFrame:
    """(key, n_messages, n_calls, n_failed, input_tokens, output_tokens,
    last_activity) of each transcript."""

    def total(name: str) -> Column:
        return F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.coalesce(m["usage"][name], F.lit(0)))

    every = F.flatten(F.transform("messages", lambda m: m["content"]))
    last = F.array_max(F.transform("messages", lambda m: m["ts"]))
    return rows.select(
        *KEY,
        F.size("messages").cast("bigint").alias("n_messages"),
        F.size(F.filter(every, lambda b: b["type"] == "tool_use")).cast("bigint").alias("n_calls"),
        F.size(F.filter(every, lambda b: (b["type"] == "tool_result") & b["is_error"])).cast("bigint").alias("n_failed"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.greatest(F.coalesce(last, F.col("ts")), F.col("ts")).alias("last_activity"),
    )


def sliced(rows: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Transcripts with messages ``start`` to ``end`` only; those that are shorter
    have no row."""
    total = F.size("messages")
    stop = total if end is None else F.lit(end)
    kept = rows.where((total >= start) & (total >= stop) & (stop >= start))
    part = F.when(stop > start, F.slice("messages", start + 1, stop - start)).otherwise(F.slice("messages", 1, 0))
    return kept.withColumn("messages", part)
