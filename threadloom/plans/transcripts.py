"""Queries over nested transcripts: conversion through each native format, blocks,
lines, text, stores and vocabularies, with SQL written apart from the code."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import tools
from ..operators import transcripts as R
from ..sources import bridge, stores
from .catalog import query

#: Formats that are read and written.
ROUND = [n for n in stores.FORMATS if n != "claude_chat"]


def _round(name: str):
    """Messages of all sessions after they went through a native format."""

    @query("SELECT '" + name + "' AS harness, source, msg_idx, role, text FROM messages")
    def run(spark, d):
        rows = R.blocks(stores.through(bridge.transcripts(spark, d), name)).where("type = 'text'")
        return rows.select("harness", "source", "msg_idx", "role", "text")

    return run


def _register() -> None:
    from . import catalog

    for name in ROUND:
        f = _round(name)
        for known in (catalog.QUERIES, catalog.ORACLES):
            known[f"convert_{name}"] = known.pop(f.__name__)


_register()

_TOOLS = """
    tool_rows AS (
        SELECT 'user-' || user_id AS id, user_id, pos, kind, 'call-' || call AS call, 'Do_' || name AS name, replace(input, ' ', '') AS input,
            row_number() OVER (PARTITION BY user_id ORDER BY pos) AS idx
        FROM blocks WHERE kind = 'use' OR call IS NOT NULL),
    users AS (SELECT DISTINCT id FROM tool_rows)"""
#: Formats whose results keep ids, outputs and failures one by one.
EXACT = ["claude_code", "pi", "campfire", "amp", "hermes", "grok", "cowork", "cursor", "simple"]


def tool_query(sql: str):
    return query(f", {_TOOLS.strip()} {sql}")


@tool_query(f"""SELECT harness, id, idx AS msg_idx, CASE WHEN kind = 'use' THEN 'tool_use' ELSE 'tool_result' END AS type, call AS tool_use_id,
        lower(CASE WHEN kind = 'use' THEN name END) AS tool_name, CASE WHEN kind = 'use' THEN input END AS tool_input_json,
        CASE WHEN kind = 'result' THEN 'failed' || chr(10) || 'at ' || pos END AS output, kind = 'result' AS is_error
    FROM tool_rows, (SELECT unnest({EXACT}) AS harness)""")
def convert_tools(spark, d):
    rows = bridge.tool_transcripts(spark, d)
    out = None
    for name in EXACT:
        b = R.blocks(stores.through(rows, name)).where("type <> 'text'")
        one = b.select(
            "harness", F.regexp_extract("source", "([^/]+)$", 1).alias("id"), "msg_idx", "type", "tool_use_id", F.lower("tool_name").alias("tool_name"),
            "tool_input_json", F.col("output_text").alias("output"), "is_error",
        )
        out = one if out is None else out.unionByName(one)
    return out


@tool_query("""SELECT id, idx AS msg_idx, 0::BIGINT AS block_idx, origin, row_number() OVER (PARTITION BY id ORDER BY idx, k) - 1 AS line_seq, text FROM (
        SELECT id, -1::BIGINT AS idx, 0 AS k, 'meta' AS origin, '/work' AS text FROM users UNION ALL
        SELECT id, 0, 0, 'user', 'I am ' || id FROM users UNION ALL
        SELECT id, idx, 0, 'tool_use', name FROM tool_rows WHERE kind = 'use' UNION ALL
        SELECT id, idx, 1, 'tool_use', input FROM tool_rows WHERE kind = 'use' UNION ALL
        SELECT id, idx, 0, 'tool_result', 'failed' FROM tool_rows WHERE kind = 'result' UNION ALL
        SELECT id, idx, 1, 'tool_result', 'at ' || pos FROM tool_rows WHERE kind = 'result')""".replace("idx AS msg_idx", "greatest(idx, 0) AS msg_idx"))
def lines_blocks(spark, d):
    return R.lines(bridge.tool_transcripts(spark, d)).select("id", "msg_idx", "block_idx", "origin", "line_seq", "text")


_NUMBERED = """, numbered AS (
        SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY first_idx) AS n FROM (
            SELECT *, min(idx) OVER (PARTITION BY id, call) AS first_idx FROM tool_rows{where})),
    sections AS (
        SELECT id, idx, CASE WHEN kind = 'use' THEN '[tool ' || n || ' ' || name || ']' || chr(10) || input || chr(10)
            ELSE '[result ' || n || ' error]' || chr(10) || 'failed' || chr(10) || 'at ' || pos || chr(10) END AS s FROM numbered)"""
_HEAD = "'[session]' || chr(10) || 'id=' || id || chr(10) || 'started=2026-05-28T20:26:40+00:00' || chr(10) || 'cwd=/work' || chr(10)"


@tool_query(_NUMBERED.format(where="") + f""" SELECT id, {_HEAD} || chr(10) || '[user]' || chr(10) || 'I am ' || id || chr(10)
        || string_agg(chr(10) || s, '' ORDER BY idx) AS body FROM sections GROUP BY id""")
def text_blocks(spark, d):
    return R.text(bridge.tool_transcripts(spark, d)).select("id", "body")


@tool_query(_NUMBERED.format(where=" WHERE idx BETWEEN 3 AND 9") + f""" SELECT id, {_HEAD} || 'fragment=#4-10' || chr(10) || 'of=' || any_value(total) || chr(10)
        || string_agg(chr(10) || '── #' || (idx + 1) || ' ──' || chr(10) || s, '' ORDER BY idx) AS body
    FROM sections JOIN (SELECT id, count(*) + 1 AS total FROM tool_rows GROUP BY id) USING (id) WHERE total >= 10 GROUP BY id""")
def text_fragment_blocks(spark, d):
    return R.text(bridge.tool_transcripts(spark, d), 3, 10, fragment=True).select("id", "body")


@tool_query("""SELECT id, count(*) + 1 AS n_messages, count(*) FILTER (kind = 'use') AS n_calls, count(*) FILTER (kind = 'result') AS n_failed,
        0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, epoch_us(make_timestamp((1780000000 + max(pos) * 60) * 1000000)) AS last_activity
    FROM tool_rows GROUP BY id""")
def roll_up_sessions(spark, d):
    return R.roll_up(bridge.tool_transcripts(spark, d)).drop("harness", "source").withColumn("last_activity", F.unix_micros("last_activity"))


@tool_query("""SELECT (SELECT count(*) FROM users) AS documents, count(*) AS lines, sum(n)::BIGINT AS chars FROM (
        SELECT 5 AS n FROM users UNION ALL SELECT length('I am ' || id) FROM users UNION ALL
        SELECT length(name) FROM tool_rows WHERE kind = 'use' UNION ALL SELECT length(input) FROM tool_rows WHERE kind = 'use' UNION ALL
        SELECT 6 FROM tool_rows WHERE kind = 'result' UNION ALL SELECT length('at ' || pos) FROM tool_rows WHERE kind = 'result')""")
def index_counters(spark, d):
    return R.counters(bridge.tool_transcripts(spark, d))


@tool_query("""SELECT id, use_idx, idx AS result_idx FROM (
        SELECT *, max(CASE WHEN kind = 'use' THEN idx END) OVER (PARTITION BY id, call ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS use_idx
        FROM tool_rows) WHERE kind = 'result' AND use_idx IS NOT NULL""")
def transcript_pairs(spark, d):
    return R.pairs(bridge.tool_transcripts(spark, d)).select("id", "use_idx", "result_idx")


@query("""SELECT id, string_agg(x, ',' ORDER BY k) AS document FROM (
        SELECT s.id, k, CASE k WHEN 0 THEN '"cwd":' || to_json(cwd) WHEN 1 THEN '"git_branch":' || to_json(git_branch) WHEN 2 THEN '"id":' || to_json(s.id)
            WHEN 3 THEN '"messages":[' || m.said || ']' ELSE '"title":' || to_json(title) END AS x
        FROM sessions s JOIN (SELECT id, string_agg('{"content":' || to_json(text) || ',"role":' || to_json(role) || '}', ',' ORDER BY msg_idx) AS said
            FROM messages GROUP BY id) m ON m.id = s.id, (SELECT unnest(range(5)) AS k))
    WHERE x IS NOT NULL AND NOT (x = '"git_branch":null' OR x = '"title":null') GROUP BY id""")
def export_documents(spark, d):
    """Simple documents without the times, as one line."""
    docs = stores.export(bridge.transcripts(spark, d))
    names = ("cwd", "git_branch", "id", "title")
    one = {k: F.get_json_object("document", f"$.{k}").alias(k) for k in names}
    said = F.from_json(F.get_json_object("document", "$.messages"), "array<struct<content:string,role:string>>").alias("messages")
    body = F.to_json(F.struct(one["cwd"], one["git_branch"], one["id"], said, one["title"]))
    return docs.select("id", F.regexp_replace(body, r"^\{|\}$", "").alias("document"))


#: name, input, kind: what the exact keys and types of each tool make of a call.
_CASES = [
    ("Read", '{"file_path":"a"}', "Read"), ("Read", '{"file_path":"a","offset":1,"limit":2}', "Read"), ("Read", '{"file_path":"a","offset":-1}', "Raw"),
    ("Read", '{"file_path":1}', "Raw"), ("Read", '{"path":"a"}', "Raw"), ("Read", '{"file_path":"a","offset":null}', "Read"), ("Read", '{"file_path":"a","limit":1.5}', "Raw"),
    ("Write", '{"content":"b","file_path":"a"}', "Write"), ("Write", '{"content":"b"}', "Raw"), ("Edit", '{"file_path":"a","new_string":"c","old_string":"b"}', "Edit"),
    ("Edit", '{"file_path":"a","new_string":"c","old_string":"b","replace_all":true}', "Edit"), ("Edit", '{"file_path":"a","new_string":"c","old_string":"b","replace_all":"x"}', "Raw"),
    ("MultiEdit", '{"edits":[{"new_string":"c","old_string":"b"}],"file_path":"a"}', "MultiEdit"), ("MultiEdit", '{"edits":[{"new_string":1,"old_string":"b"}],"file_path":"a"}', "Raw"),
    ("MultiEdit", '{"edits":[{"new_string":"c","old_string":"b","z":1}],"file_path":"a"}', "Raw"), ("MultiEdit", '{"edits":[],"file_path":"a"}', "MultiEdit"),
    ("Bash", '{"command":"x"}', "Bash"), ("Bash", '{"command":"x","timeout_ms":5,"workdir":"/"}', "Bash"), ("Bash", '{"command":"x","timeout":5}', "Raw"),
    ("Bash", '{"command":"x","description":"d","run_in_background":true}', "Bash"), ("/go", "{}", "Command"), ("/go", '{"args":"x"}', "Command"), ("/go", '{"x":1}', "Raw"),
    ("mcp__a__b", "{}", "Raw"), ("Bash", "[1]", "Raw"), ("Bash", "not json", "Raw"),
]
_VALUES = ", ".join(f"({i}, '{n}', '{j}', '{k}')" for i, (n, j, k) in enumerate(_CASES))


@query(f"SELECT event_id, c.name, c.kind FROM events JOIN (VALUES {_VALUES}) c(i, name, input, kind) ON c.i = event_id % {len(_CASES)}")
def tool_typing(spark, d):
    cases = F.broadcast(spark.createDataFrame([(i, n, j) for i, (n, j, _) in enumerate(_CASES)], "i int, name string, input string"))  # the list above
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % len(_CASES)).cast("int").alias("i"))
    return e.join(cases, "i").select("event_id", "name", tools.tool_kind(F.col("name"), F.col("input")).alias("kind"))


_STOP_SQL = {
    "claude_code": "end_turn=end_turn tool_use=tool_use max_tokens=max_tokens stop_sequence=stop_sequence stop=stop length=length aborted=aborted error=error",
    "opencode": "stop=end_turn length=max_tokens tool_use=tool_use tool-calls=tool_use tool_calls=tool_use error=error content-filter=content-filter end_turn=end_turn",
    "pi": "stop=end_turn length=max_tokens toolUse=tool_use error=error aborted=aborted tool_use=tool_use refusal=refusal",
    "campfire": "stop=end_turn length=max_tokens toolUse=tool_use error=error aborted=aborted tool_use=tool_use refusal=refusal",
    "grok": "end_turn=end_turn tool_use=tool_use max_tokens=max_tokens stop_sequence=stop_sequence cancelled=aborted error=error stop=stop",
    "hermes": "stop=end_turn end_turn=end_turn tool_calls=tool_use tool_use=tool_use length=max_tokens max_tokens=max_tokens stop_sequence=stop_sequence aborted=aborted cancelled=aborted error=error content_filter=content_filter",
    "amp": "end_turn=end_turn tool_use=tool_use max_tokens=max_tokens stop_sequence=stop_sequence error=error cancelled=cancelled",
    "claude_chat": "end_turn=end_turn stop=end_turn tool_use=tool_use max_tokens=max_tokens length=max_tokens stop_sequence=stop_sequence aborted=aborted cancelled=aborted error=error pause=pause",
}
_TOOL_SQL = {
    "codex": "exec_command=Bash shell=Bash apply_patch=apply_patch bash=bash",
    "opencode": "bash=Bash edit=Edit write=Write read=Read glob=Glob grep=Grep list=LS todowrite=TodoWrite todoread=TodoRead webfetch=WebFetch task=Task question=Question",
    "pi": "bash=Bash read=Read write=Write edit=Edit grep=Grep find=Glob ls=LS mcp__x=mcp__x",
    "campfire": "bash=Bash read=Read write=Write edit=Edit grep=Grep find=Glob ls=LS mcp__x=mcp__x",
    "grok": "Shell=Bash StrReplace=Edit Read=Read bash=bash", "hermes": "read_file=Read write_file=Write terminal=Bash patch=patch",
    "amp": "Bash=Bash shell_command=Bash Read=Read edit_file=Edit create_file=Write glob=Glob todo_write=TodoWrite todo_read=TodoRead read_web_page=WebFetch web_search=web_search",
    "claude_chat": "bash=Bash bash_tool=Bash shell=Bash shell_command=Bash run_terminal_cmd=Bash read_file=Read view=Read create_file=Write write_file=Write edit_file=Edit str_replace=Edit web=web",
}


def _rows(table: dict[str, str]) -> list[tuple[str, str, str]]:
    return [(h, *pair.split("=")) for h, pairs in table.items() for pair in pairs.split()]


def _vocabulary(table: dict[str, str], name: str) -> str:
    values = ", ".join(f"('{h}', '{n}', '{c}')" for h, n, c in _rows(table))
    return f"SELECT s.id, v.harness, v.native AS {name}, v.canonical FROM sessions s, (VALUES {values}) v(harness, native, canonical)"


def _every(spark, d, table: dict[str, str], known: list, name: str):
    """Every native word with each session: the words are few and fixed."""
    words = F.array(*[F.struct(F.lit(h).alias("harness"), F.lit(n).alias(name)) for h, n, _ in _rows(table)])
    rows = bridge.sessions(spark, d).select("id", F.inline(words))
    return vocab.normalise(rows, known, name, "canonical")


@query(_vocabulary(_STOP_SQL, "stop"))
def stop_reasons_all(spark, d):
    return _every(spark, d, _STOP_SQL, vocab.STOPS, "stop")


@query(_vocabulary(_TOOL_SQL, "tool"))
def tool_names_all(spark, d):
    return _every(spark, d, _TOOL_SQL, vocab.TOOLS, "tool")


#: Stores whose sessions are written by ``save``.
SAVED = [n for n in ("claude_code", "codex", "pi", "campfire", "grok", "cursor", "antigravity") if n in stores.FORMATS]


@query(f"""SELECT s.harness, s.id, ts, cwd, n AS n_messages, row_number() OVER (ORDER BY ts DESC, s.harness) AS pos
    FROM sessions s JOIN (SELECT id, count(*) AS n FROM messages GROUP BY id) USING (id) WHERE s.harness IN ({", ".join(f"'{n}'" for n in SAVED)})""")
def discover_stores(spark, d):
    """Sessions written into a store of each format, found again in all of them."""
    from pyspark.sql import Window

    root = f"{stores.shared_folder(spark)}/stores-{uuid.uuid4().hex}"
    rows = bridge.transcripts(spark, d)
    for name in SAVED:
        stores.save(rows.where(F.col("harness") == name), name, f"{root}/{name}").write.format("noop").mode("overwrite").save()
    heads = stores.discover(spark, {n: f"{root}/{n}" for n in SAVED}).withColumn("ts", F.unix_seconds("ts"))
    order = Window.orderBy(F.desc("ts"), "harness")  # numbers a listing for the comparison only
    return heads.select("harness", "id", "ts", "cwd", F.col("n_messages").cast("bigint").alias("n_messages"), F.row_number().over(order).cast("bigint").alias("pos"))


@query(""", e AS (
        SELECT *, 'c' || max(CASE WHEN event_type = 'signup' THEN event_id END) OVER before AS call,
            max(CASE WHEN event_type = 'view' THEN n END) OVER before AS turn
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        WINDOW before AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    v AS (SELECT user_id, n, event_id AS view_id FROM e WHERE event_type = 'view'),
    kept AS (
        SELECT e.*, view_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) - 1 AS msg_idx,
            event_type = 'click' AND e.n = max(CASE WHEN event_type = 'click' THEN e.n END) OVER (PARTITION BY e.user_id, turn)
                AND EXISTS (FROM v later WHERE later.user_id = e.user_id AND later.n > e.n) AND turn IS NOT NULL AS counted
        FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.n = e.turn
        WHERE event_type IN ('signup', 'click') OR (call IS NOT NULL AND (event_type = 'purchase' OR (event_type = 'error'
            AND NOT EXISTS (FROM e full_ WHERE full_.user_id = e.user_id AND full_.event_type = 'purchase' AND full_.call = e.call)))))
    SELECT 'user-' || user_id AS id, msg_idx, CASE event_type WHEN 'signup' THEN 'tool_use' WHEN 'click' THEN 'text' ELSE 'tool_result' END AS type,
        CASE WHEN event_type <> 'click' THEN call END AS call, CASE event_type WHEN 'click' THEN 'said ' || event_id WHEN 'error' THEN 'mirror'
            WHEN 'purchase' THEN 'full' END AS said,
        CASE WHEN event_type IN ('signup', 'click') THEN 'model-' || view_id % 5 END AS model, event_type = 'purchase' AND event_id % 2 = 1 AS is_error,
        CASE WHEN counted THEN event_id END AS input_tokens
    FROM kept""")
def codex_fold(spark, d):
    """Rollouts made of the events of each user: a view opens a turn (and ends the
    one before), a signup is a call, a purchase its full result, an error a result
    that only counts if there is no full one, a click is said and counted."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{d}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("n", F.row_number().over(order)).withColumn("call", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(before))
    e = e.withColumn("turn", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(before))

    def line(kind: str, **fields) -> Column:
        payload = F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).alias(k) for k, v in fields.items()])
        return F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))

    def named(letter: str, column: str) -> Column:
        return F.concat(F.lit(letter), F.col(column))

    said = F.array(F.struct(F.lit("output_text").alias("type"), F.concat(F.lit("said "), "event_id").alias("text")))
    count = F.struct(F.struct(F.col("event_id").alias("input_tokens"), F.lit(1).alias("output_tokens")).alias("last_token_usage"))
    made = (
        F.when(F.col("event_type") == "view", F.array(
            line("event_msg", type="task_complete", turn_id=named("t", "turn")),
            line("turn_context", turn_id=named("t", "event_id"), model=F.concat(F.lit("model-"), F.col("event_id") % 5)),
        ))
        .when(F.col("event_type") == "signup", F.array(line("response_item", type="function_call", name="Do", arguments=F.col("props"), call_id=named("c", "event_id"))))
        .when(F.col("event_type") == "purchase", F.array(line("event_msg", type="exec_command_end", call_id=named("c", "call"), aggregated_output="full", exit_code=F.col("event_id") % 2)))
        .when(F.col("event_type") == "error", F.array(line("response_item", type="function_call_output", call_id=named("c", "call"), output="mirror")))
        .otherwise(F.array(line("response_item", type="message", role="assistant", content=said), line("event_msg", type="token_count", info=count)))
    )
    per = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", made.alias("lines")))).alias("l"))
    body = F.array_join(F.flatten(F.transform("l", lambda x: x["lines"])), "\n")
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(named("user-", "user_id").alias("id")).alias("payload")))
    files = per.select(
        named("/events/", "user_id").alias("source"), F.timestamp_seconds(F.lit(0)).alias("mtime"), F.lit(None).cast("string").alias("fingerprint"),
        F.array(F.struct(F.lit("f").alias("name"), F.encode(F.concat(head, F.lit("\n"), body), "utf-8").alias("content"))).alias("files"),
    )
    each = R.messages(stores.parse(files, "codex")).withColumn("b", F.explode("content"))
    return each.select(
        "id", "msg_idx", F.col("b.type").alias("type"), F.col("b.tool_use_id").alias("call"), F.coalesce("b.text", "b.output_text").alias("said"),
        "model", F.col("b.is_error").alias("is_error"), F.col("usage.input_tokens").alias("input_tokens"),
    )


@query("""SELECT source, kind, count(*) AS n, min(line_no) AS first_line FROM (
        SELECT source, role AS kind, msg_idx + (titled)::INT AS line_no FROM (SELECT m.*, coalesce(title, '') <> '' AS titled FROM messages m JOIN sessions s USING (source))
        UNION ALL SELECT source, 'summary', 0 FROM sessions WHERE coalesce(title, '') <> '') GROUP BY ALL""")
def records_typed(spark, d):
    """Native lines by kind, straight from the files' bytes."""
    found = stores.records(stores.convert(bridge.transcripts(spark, d), "claude_code"))
    return found.groupBy("source", "kind").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
