"""Queries over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import folds, incremental, render, slicing, tools
from ..operators import search as S
from ..operators import sessions as L
from ..operators.lines import lines as extract_lines
from ..operators.lines import meta_lines
from ..operators.needles import needles_in
from ..sources import bridge, simple

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = ["harness", "id", "source"]
_STORES = ", ".join(f"'{h}'" for h in bridge.STORES)
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "threadloom:session")

CTES = f"""
keyed AS (
    SELECT conv_id, turn, lower(trim(role)) AS role, text,
        ([{_STORES}])[(conv_id % 12 + 1)::INT] AS harness, 'conv-' || conv_id AS id
    FROM conversations),
messages AS (
    SELECT harness, id, '/store/' || harness || '/' || id AS source, conv_id AS seq,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_idx, role, text
    FROM keyed WHERE role IN ('user', 'assistant')),
firsts AS (
    SELECT harness, id, source, seq,
        trim(regexp_replace(arg_min(text, msg_idx) FILTER (role = 'user'), '\\s+', ' ', 'g')) AS line
    FROM messages GROUP BY ALL),
sessions AS (
    SELECT harness, id, source, seq, 1780000000 + seq * 10000 AS ts, '/work/repo-' || seq % 7 AS cwd,
        CASE WHEN seq % 3 <> 0 THEN 'feat-' || seq % 5 END AS git_branch,
        CASE WHEN line = '' THEN NULL WHEN length(line) <= 80 THEN line ELSE left(line, 79) || '…' END AS title
    FROM firsts),
raw_lines AS (
    SELECT harness, id, source, seq, 0 AS msg_idx, 'meta' AS origin, 0 AS part, field, 0 AS n, text FROM (
        SELECT *, 0 AS field, title AS text FROM sessions UNION ALL
        SELECT *, 1, cwd FROM sessions UNION ALL SELECT *, 2, git_branch FROM sessions)
    UNION ALL
    SELECT harness, id, source, seq, msg_idx, role, 1, 0, unnest(range(len(parts))), unnest(parts) FROM (
        SELECT *, string_split_regex(text, '\\r?\\n') AS parts FROM messages)),
lines AS (
    SELECT harness, id, source, seq, msg_idx, origin, text,
        row_number() OVER (PARTITION BY harness, id, source ORDER BY part, msg_idx, field, n) - 1 AS line_seq
    FROM (SELECT * REPLACE (regexp_replace(text, '\\s+$', '') AS text) FROM raw_lines)
    WHERE text <> ''),
blocks AS (
    SELECT user_id, pos, kind, CASE WHEN kind = 'use' THEN event_id ELSE latest END AS call, event_type AS name, props AS input FROM (
        SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
            CASE WHEN event_type = 'error' THEN 'result' ELSE 'use' END AS kind
        FROM events)),
pairs AS (
    SELECT user_id, call, use_pos, pos AS result_pos FROM (
        SELECT *, max(CASE WHEN kind = 'use' THEN pos END) OVER (PARTITION BY user_id, call ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS use_pos FROM blocks WHERE call IS NOT NULL)
    WHERE kind = 'result' AND use_pos IS NOT NULL)"""


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {CTES.strip()} {sql}"
        return f

    return add


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return extract_lines(bridge.sessions(spark, d), bridge.messages(spark, d))


# Listing and resolving

_ROWS = "harness, id, source, seq, ts, cwd, git_branch, title"


@query(f"SELECT {_ROWS}, row_number() OVER (ORDER BY ts DESC, seq) AS pos FROM sessions")
def list_newest_first(spark, d):
    s = bridge.sessions(spark, d)
    return s.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("ts"), F.asc("seq"))).cast("bigint"))


@query(f"SELECT {_ROWS}, row_number() OVER (ORDER BY ts DESC, seq) AS pos, count(*) OVER () AS total FROM sessions ORDER BY ts DESC, seq LIMIT 10 OFFSET 5")
def list_page_total(spark, d):
    return L.page(bridge.sessions(spark, d), 10, 5)


@query(f"SELECT {_ROWS} FROM sessions WHERE ts BETWEEN 1780100000 AND 1780500000")
def list_since_until(spark, d):
    return L.filtered(bridge.sessions(spark, d), since=1780100000, until=1780500000)


@query(f"SELECT {_ROWS} FROM sessions WHERE harness = 'codex'")
def filter_harness(spark, d):
    return L.filtered(bridge.sessions(spark, d), harness="codex")


@query(f"SELECT {_ROWS} FROM sessions WHERE cwd = '/work/repo-3' OR starts_with(cwd, '/work/repo-3/')")
def filter_cwd_subtree(spark, d):
    return L.filtered(bridge.sessions(spark, d), cwd="/work/repo-3/")


@query(f"SELECT {_ROWS} FROM sessions WHERE id = 'conv-7' OR title = 'conv-7' ORDER BY ts DESC, seq LIMIT 1")
def resolve_exact(spark, d):
    return L.resolve_exact(bridge.sessions(spark, d), "conv-7")


def _prefix_sql(p: str) -> str:
    return f"""SELECT {_ROWS}, count(*) OVER () AS candidates FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM sessions WHERE starts_with(id, '{p}')) WHERE n = 1"""


@query(_prefix_sql("conv-19"))
def resolve_prefix(spark, d):
    return L.resolve_prefix(bridge.sessions(spark, d), "conv-19")


@query(_prefix_sql("conv-1"))
def resolve_ambiguous(spark, d):
    return L.resolve_prefix(bridge.sessions(spark, d), "conv-1")


@query(f"SELECT {_ROWS} FROM sessions")
def distinct_ids_first(spark, d):
    s = bridge.sessions(spark, d)
    later = s.withColumn("seq", F.col("seq") + 1_000_000).withColumn("source", F.lit("/copy"))
    return L.distinct_ids(s.unionByName(later))


@query("SELECT conv_id, CASE WHEN alias IN ('claude', 'cc') THEN 'claude_code' WHEN alias = 'codex' THEN 'codex' END AS harness FROM (SELECT DISTINCT conv_id, (['claude', 'cc', 'codex', 'nobody'])[(conv_id % 4 + 1)::INT] AS alias FROM conversations)")
def harness_alias(spark, d):
    names = F.array(*[F.lit(x) for x in (" Claude", "CC ", "codex", "nobody")])
    ids = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct()
    return ids.select("conv_id", vocab.harness_of(F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int"))).alias("harness"))


# Lines and search

@query("SELECT harness, id, source, seq, msg_idx, origin, line_seq, text FROM lines")
def lines_extract(spark, d):
    return _lines(spark, d)


@query("SELECT harness, id, source, seq, msg_idx, origin, field, text FROM raw_lines WHERE part = 0 AND text IS NOT NULL")
def lines_meta(spark, d):
    return meta_lines(bridge.sessions(spark, d)).drop("part", "line_no")


_HIT = "harness, id, source, seq, msg_idx, origin, line_seq, text"


def _hits_sql(where: str, needle: str, hay: str = "lower(text)", origins: str = "'user','assistant','meta'") -> str:
    at = f"instr({hay}, '{needle}')"
    return f"""SELECT {_HIT}, {16 * len(needle)} AS score, {at} - 1 AS hl_start, {at} - 1 + {len(needle)} AS hl_end
        FROM lines WHERE origin IN ({origins}) AND {at} > 0 AND ({where})"""


@query(_hits_sql("true", "and the"))
def search_substring_lines(spark, d):
    return S.one_shot(_lines(spark, d), S.Query.substring("and the"))


@query(_hits_sql("true", "The", "text"))
def search_smart_case(spark, d):
    return S.hits(_lines(spark, d), S.Query.substring("The"))


@query(_hits_sql("true", "the", "text"))
def search_case_sensitive(spark, d):
    return S.hits(_lines(spark, d), S.Query.substring("the", case="sensitive"))


@query(_hits_sql("true", "the", origins="'assistant'"))
def search_origin_filter(spark, d):
    return S.hits(_lines(spark, d), S.Query.substring("the", origins=("assistant",)))


@query(_hits_sql("harness IN ('codex', 'amp')", "the"))
def search_harness_filter(spark, d):
    return S.hits(_lines(spark, d), S.Query.substring("the", harnesses=("codex", "amp")))


@query("""SELECT h.harness, h.id, h.source, rank, best, h.msg_idx, h.origin, h.line_seq, h.text, h.score, h.hl_start, h.hl_end,
        row_number() OVER (PARTITION BY h.harness, h.id, h.source ORDER BY h.line_seq) AS hit_no FROM (
            SELECT *, 48 AS score, instr(lower(text), 'the') - 1 AS hl_start, instr(lower(text), 'the') + 2 AS hl_end,
                row_number() OVER (PARTITION BY harness, id, source ORDER BY line_seq) AS n
            FROM lines WHERE instr(lower(text), 'the') > 0) h
        JOIN (SELECT harness, id, source, 48 AS best, row_number() OVER (ORDER BY ts DESC, seq) AS rank FROM sessions s
            WHERE EXISTS (FROM lines l WHERE l.id = s.id AND instr(lower(l.text), 'the') > 0)) r
        USING (harness, id, source) WHERE rank <= 20 AND n <= 3""")
def search_substring_topk(spark, d):
    s = bridge.sessions(spark, d)
    found = S.search(_lines(spark, d), s, S.Query.substring("the", limit=20, hits_per_doc=3))
    return found.select(*KEY, "rank", "best", "msg_idx", "origin", "line_seq", "text", "score", "hl_start", "hl_end", "hit_no")


@query(f"SELECT {_HIT} FROM lines WHERE regexp_matches(lower(text), 't.*h.*r.*d', 's') AND regexp_matches(lower(text), 'e.*a.*o', 's')")
def search_fuzzy_match_set(spark, d):
    q = S.Query.fuzzy("thrd eao")
    return _lines(spark, d).where(S.matches(q, F.col("text")))


@query(f"SELECT {_HIT} FROM lines WHERE instr(lower(text), 'the') > 0 AND ends_with(lower(text), '.') AND NOT instr(lower(text), 'and') > 0 AND starts_with(lower(text), 't')")
def search_atoms_exact_prefix_suffix_not(spark, d):
    return _lines(spark, d).where(S.matches(S.Query.fuzzy("'the ^t .$ !and"), F.col("text")))


@query(f"SELECT {_HIT}, instr(lower(text), 'ther') > 0 AS literal FROM lines WHERE regexp_matches(lower(text), 't.*h.*e.*r', 's')")
def search_literal_tier(spark, d):
    found = S.hits(_lines(spark, d), S.Query.fuzzy("ther"))
    return found.select(*_HIT.split(", "), (F.col("score") >= S.LITERAL_BONUS).alias("literal"))


@query(None)
def search_fuzzy_ranked(spark, d):
    return S.search(_lines(spark, d), bridge.sessions(spark, d), S.Query.fuzzy("ther and", limit=20, hits_per_doc=3))


@query(f"SELECT {_ROWS} FROM sessions ORDER BY ts DESC, seq LIMIT 20")
def search_empty_newest(spark, d):
    return S.search(_lines(spark, d), bridge.sessions(spark, d), S.Query.fuzzy("  ", limit=20))


@query("""SELECT harness, id, source, rank, line_seq, row_number() OVER (ORDER BY rank, line_seq) AS pos FROM (
        SELECT l.*, rank, row_number() OVER (PARTITION BY harness, id, source ORDER BY line_seq) AS n FROM lines l
        JOIN (SELECT harness, id, source, row_number() OVER (ORDER BY ts DESC, seq) AS rank FROM sessions s
            WHERE EXISTS (FROM lines l WHERE l.id = s.id AND instr(lower(l.text), 'ing') > 0)) USING (harness, id, source)
        WHERE instr(lower(text), 'ing') > 0) WHERE n <= 8 ORDER BY rank, line_seq LIMIT 50""")
def picker_occurrence_rank(spark, d):
    found = S.search(_lines(spark, d), bridge.sessions(spark, d), S.Query.substring("ing"))
    top = found.orderBy(F.desc("score"), "rank", "line_seq").limit(50)
    pos = F.row_number().over(Window.orderBy(F.desc("score"), "rank", "line_seq")).cast("bigint")
    return top.select(*KEY, "rank", "line_seq", pos.alias("pos"))


@query("SELECT harness, id, source, seq, CASE WHEN seq % 4 = 0 THEN 2 ELSE 1 END AS version FROM sessions")
def index_upsert_last_wins(spark, d):
    s = bridge.sessions(spark, d).select(*KEY, "seq")
    old, new = s.withColumn("version", F.lit(1)), s.where("seq % 4 = 0").withColumn("version", F.lit(2))
    return S.upsert(old, new, "version")


@query("SELECT harness, id, source, seq FROM sessions WHERE seq % 5 <> 0")
def index_remove(spark, d):
    s = bridge.sessions(spark, d).select(*KEY, "seq")
    return S.remove(s, s.where("seq % 5 = 0"))


@query("SELECT count(DISTINCT id) AS documents, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM lines")
def index_stats(spark, d):
    return _lines(spark, d).agg(F.countDistinct("id").alias("documents"), F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


# Ranges and pairing

_MSG = "harness, id, source, seq, msg_idx, role, text"


def _slice(name: str, ref: str, where: str) -> None:
    def run(spark, d):
        first, last = slicing.split_reference(ref)[1]
        return slicing.slice_messages(bridge.messages(spark, d), (first or 1) - 1, last)

    run.__name__ = name
    query(f"SELECT {_MSG} FROM messages WHERE {where}")(run)


_slice("slice_range", "s#2-4", "msg_idx BETWEEN 1 AND 3")
_slice("slice_open_start", "s#-3", "msg_idx <= 2")
_slice("slice_open_end", "s#3-", "msg_idx >= 2")
_slice("slice_single", "s#2", "msg_idx = 1")


def _pairs(spark, d):
    return slicing.tool_pairs(bridge.tool_events(spark, d), ["user_id"])


@query("SELECT * FROM pairs")
def tool_pairs_asof(spark, d):
    return _pairs(spark, d)


_CUT = "(use_pos >= 10 AND use_pos < 20) <> (result_pos >= 10 AND result_pos < 20)"


@query(f"SELECT user_id FROM (SELECT DISTINCT user_id FROM blocks) u WHERE NOT EXISTS (FROM pairs p WHERE p.user_id = u.user_id AND {_CUT})")
def slice_pairing_valid(spark, d):
    users = bridge.tool_events(spark, d).select("user_id").distinct()
    return users.join(slicing.cut_pairs(_pairs(spark, d), 10, 20), "user_id", "left_anti")


@query("""SELECT user_id, s AS start, e AS "end" FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e - s, s DESC) AS n FROM (
            SELECT user_id, unnest(range(0, 11)) AS s, n AS size FROM (SELECT user_id, count(*) AS n FROM blocks GROUP BY 1) WHERE n >= 20) a,
            LATERAL (SELECT unnest(range(20, a.size + 1)) AS e)
        WHERE NOT EXISTS (FROM pairs p WHERE p.user_id = a.user_id
            AND (use_pos >= s AND use_pos < e) <> (result_pos >= s AND result_pos < e)))
    WHERE n = 1""")
def slice_nearest_valid(spark, d):
    b = bridge.tool_events(spark, d)
    sizes = b.groupBy("user_id").agg(F.count("*").alias("n"))
    return slicing.nearest_valid(sizes, _pairs(spark, d), ["user_id"], 10, 20)


_BLOCK = "user_id, pos, kind, call, name, input"


@query(f"SELECT {_BLOCK} FROM blocks b WHERE kind = 'use' AND NOT EXISTS (FROM pairs p WHERE p.user_id = b.user_id AND p.use_pos = b.pos)")
def dangling_tool_uses(spark, d):
    return slicing.dangling_uses(bridge.tool_events(spark, d), _pairs(spark, d), ["user_id"]).select(*_BLOCK.split(", "))


@query(f"SELECT {_BLOCK} FROM blocks b WHERE kind = 'result' AND NOT EXISTS (FROM pairs p WHERE p.user_id = b.user_id AND p.result_pos = b.pos)")
def orphan_results(spark, d):
    return slicing.orphan_results(bridge.tool_events(spark, d), _pairs(spark, d), ["user_id"]).select(*_BLOCK.split(", "))


@query("""SELECT user_id, nth, u.pos AS use_pos, r.pos AS result_pos
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS nth FROM blocks WHERE kind = 'use') u
    JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS nth FROM blocks WHERE kind = 'result') r USING (user_id, nth)""")
def fifo_pairing(spark, d):
    return slicing.fifo_pairs(bridge.tool_events(spark, d), ["user_id"])


@query("SELECT b.name, count(DISTINCT (b.user_id, b.pos)) AS uses, count(p.result_pos) AS failed FROM blocks b LEFT JOIN pairs p ON p.user_id = b.user_id AND p.use_pos = b.pos WHERE kind = 'use' GROUP BY 1")
def is_error_rate_by_tool(spark, d):
    uses = bridge.tool_events(spark, d).where("kind = 'use'")
    bad = _pairs(spark, d).groupBy("user_id", F.col("use_pos").alias("pos")).agg(F.count("*").alias("bad"))
    joined = uses.join(bad, ["user_id", "pos"], "left")
    return joined.groupBy("name").agg(F.count("*").alias("uses"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failed"))


# Folds

@query("SELECT user_id, pos, last_value(CASE WHEN kind = 'use' THEN call END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS carried FROM blocks")
def carry_forward_ts(spark, d):
    b = bridge.tool_events(spark, d).withColumn("known", F.when(F.col("kind") == "use", F.col("call")))
    return folds.carry_forward(b, ["user_id"], "pos", "known", "carried").select("user_id", "pos", "carried")


@query("""SELECT user_id, arg_min(name, pos) FILTER (kind = 'use') AS first_name, arg_max(name, pos) FILTER (kind = 'use') AS last_name,
    min(pos) FILTER (kind = 'use') AS first_pos FROM blocks GROUP BY 1""")
def meta_first_last_min(spark, d):
    name, pos = F.when(F.col("kind") == "use", F.col("name")), F.col("pos")
    return bridge.tool_events(spark, d).groupBy("user_id").agg(
        folds.first_known(name, pos).alias("first_name"), folds.last_known(name, pos).alias("last_name"), F.min(F.when(name.isNotNull(), pos)).alias("first_pos")
    )


@query("""SELECT id, msg_idx, CASE WHEN line = '' THEN NULL WHEN length(line) <= 80 THEN line ELSE left(line, 79) || '…' END AS title
    FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM messages)""")
def title_truncate80(spark, d):
    return bridge.messages(spark, d).select("id", "msg_idx", T.title_of(F.col("text")).alias("title"))


@query("""SELECT user_id, run, min(pos) AS first_pos, count(*) AS n FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM (
            SELECT *, CASE WHEN kind = coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY pos), kind) THEN 0 ELSE 1 END AS new FROM blocks))
    GROUP BY ALL""")
def role_runs_merge(spark, d):
    r = folds.runs(bridge.tool_events(spark, d), ["user_id"], "pos", "kind")
    return r.groupBy("user_id", "run").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


_PARENT = "CASE WHEN msg_idx = 0 THEN NULL WHEN msg_idx % 3 = 2 THEN msg_idx - 2 ELSE msg_idx - 1 END"


@query(f""", nodes AS (SELECT id, msg_idx AS node, {_PARENT} AS parent FROM messages),
    walk AS (SELECT id, max(node) AS node, 0 AS depth FROM nodes GROUP BY 1
        UNION ALL SELECT w.id, n.parent, depth + 1 FROM walk w JOIN nodes n ON n.id = w.id AND n.node = w.node WHERE n.parent IS NOT NULL)
    SELECT id, node, depth FROM walk""")
def active_path(spark, d):
    nodes = bridge.messages(spark, d).select("id", F.col("msg_idx").alias("node"), F.expr(_PARENT).alias("parent"))
    leaves = nodes.groupBy("id").agg(F.max("node").alias("node"))
    return folds.active_path(nodes, leaves, ["id"])


@query("""SELECT id, nth, u.msg_idx, a.msg_idx AS r_msg_idx
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY msg_idx) AS nth FROM messages WHERE role = 'user') u
    JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY msg_idx) AS nth FROM messages WHERE role = 'assistant') a USING (id, nth)""")
def positional_zip(spark, d):
    m = bridge.messages(spark, d)
    side = lambda r: m.where(F.col("role") == r).select("id", "msg_idx")
    return folds.zip_ordinals(side("user"), side("assistant"), ["id"], "msg_idx")


@query("""SELECT user_id, pos, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS short FROM (
        SELECT *, min(pos) OVER (PARTITION BY user_id, call) AS first FROM blocks WHERE call IS NOT NULL)""")
def short_tool_ids(spark, d):
    b = bridge.tool_events(spark, d).where("call IS NOT NULL")
    return folds.first_appearance_ordinals(b, ["user_id"], "pos", "call", "short").select("user_id", "pos", "short")


@query("SELECT harness, id, source, string_agg('[' || role || ']\n' || text || '\n', '\n' ORDER BY msg_idx) AS body FROM messages GROUP BY ALL")
def text_projection(spark, d):
    return render.text_projection(bridge.messages(spark, d))


@query("""SELECT harness, id, source, string_agg('── #' || (msg_idx + 1) || ' ──\n[' || role || ']\n' || text || '\n', '\n' ORDER BY msg_idx) AS body
    FROM messages WHERE msg_idx BETWEEN 1 AND 3 GROUP BY ALL""")
def text_fragment(spark, d):
    return render.text_projection(bridge.messages(spark, d), 1, 4)


@query(""", sized AS (SELECT id, msg_idx, octet_length(encode(text)) AS size FROM messages),
    packed AS (SELECT id, msg_idx, size, 0 AS chunk, size AS used FROM sized WHERE msg_idx = 0
        UNION ALL SELECT s.id, s.msg_idx, s.size, CASE WHEN used > 0 AND used + s.size > 1000 THEN chunk + 1 ELSE chunk END,
            CASE WHEN used > 0 AND used + s.size > 1000 THEN s.size ELSE used + s.size END
        FROM packed p JOIN sized s ON s.id = p.id AND s.msg_idx = p.msg_idx + 1)
    SELECT id, msg_idx, size, chunk FROM packed""")
def chunk_budget(spark, d):
    m = bridge.messages(spark, d).select("id", "msg_idx", F.octet_length("text").cast("bigint").alias("size"))
    return folds.greedy_chunks(m, ["id"], "msg_idx", "size", 1000)


@query("""SELECT id, msg_idx, floor((before - length(text)) * 4 / greatest(total, 1))::BIGINT AS shard FROM (
        SELECT *, sum(length(text)) OVER (PARTITION BY id ORDER BY msg_idx) AS before, sum(length(text)) OVER (PARTITION BY id) AS total FROM messages)""")
def shard_by_chars(spark, d):
    m = bridge.messages(spark, d).withColumn("n", F.length("text").cast("bigint"))
    return folds.balanced_shards(m, ["id"], "msg_idx", "n", 4).select("id", "msg_idx", "shard")


# Scalars, vocabularies and codecs

@query("SELECT event_id, json_keys(props) = ['k'] AS exact FROM events")
def tool_typing_exact_keys(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", tools.has_exact_keys(F.col("props"), ["k"]).alias("exact"))


@query(f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
        (['8','9','a','b'])[(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT id, sha1(unhex('{NAMESPACE.hex}') || encode(id)) AS h FROM sessions)""")
def uuid5_ids(spark, d):
    return bridge.sessions(spark, d).select("id", T.uuid5(NAMESPACE, F.col("id")).alias("uuid"))


@query("SELECT s.id, coalesce(max(msg_idx) FILTER (m.role = 'assistant'), 0) AS cursor FROM sessions s LEFT JOIN messages m USING (id) GROUP BY 1")
def fingerprint_max(spark, d):
    m = bridge.messages(spark, d)
    return incremental.latest_cursor(m.select("id").distinct(), m.where("role = 'assistant'"), "id", "msg_idx")


def _live_and_cache(spark, d):
    live = bridge.sessions(spark, d).select("id", "seq", F.when(F.col("seq") % 9 == 0, "").otherwise(F.col("ts").cast("string")).alias("cursor"))
    cache = live.where("seq % 4 <> 0").withColumn("cursor", F.when(F.col("seq") % 5 == 0, F.lit("old")).otherwise(F.col("cursor")))
    return live, cache


@query("SELECT id, NOT (seq % 4 <> 0 AND seq % 5 <> 0 AND seq % 9 <> 0) AS miss FROM sessions")
def cache_hit_miss(spark, d):
    live, cache = _live_and_cache(spark, d)
    hit = incremental.cache_hits(live, cache, ["id"]).select("id", F.lit(False).alias("miss"))
    return hit.unionByName(incremental.cache_misses(live, cache, ["id"]).select("id", F.lit(True).alias("miss")))


@query("SELECT id FROM sessions WHERE seq % 4 <> 0 AND seq % 2 = 0")
def cache_prune(spark, d):
    live, cache = _live_and_cache(spark, d)
    return incremental.cache_prune(cache, live.where("seq % 2 = 0"), ["id"]).select("id")


@query("""SELECT doc_id, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN age // 60 || 'm ago' WHEN age < 86400 THEN age // 3600 || 'h ago'
        WHEN age < 604800 THEN age // 86400 || 'd ago' ELSE strftime(make_timestamp((2000000000 - age) * 1000000), '%Y-%m-%d') END AS age
    FROM (SELECT doc_id, doc_id * 977 AS age FROM documents)""")
def format_when(spark, d):
    ts = F.lit(2_000_000_000) - F.col("doc_id") * 977
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.format_when(ts, F.lit(2_000_000_000)).alias("age"))


@query("SELECT doc_id, strlen(text) AS bytes, md5(text) AS md5, sha256(text) AS sha256, lower(hex(encode(left(text, 8)))) AS head FROM documents")
def artifact_hashes(spark, d):
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", F.octet_length(t).cast("bigint").alias("bytes"), F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), F.lower(F.hex(F.encode(F.substring(t, 1, 8), "utf-8"))).alias("head")
    )


@query("SELECT item_id, count(*) AS docs FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0 GROUP BY 1")
def artifact_literal_needles(spark, d):
    needles = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("text")
    return needles_in(docs, "text", needles).groupBy("item_id").agg(F.count("*").alias("docs"))


@query("""SELECT id, '{"cwd":' || to_json(cwd) || coalesce(',"git_branch":' || to_json(git_branch), '') || ',"id":' || to_json(id) || ',"messages":['
        || (SELECT string_agg('{"content":' || to_json(text) || ',"role":' || to_json(role) || '}', ',' ORDER BY msg_idx) FROM messages m WHERE m.id = s.id)
        || ']' || coalesce(',"title":' || to_json(title), '') || '}' AS document FROM sessions s""")
def export_simple(spark, d):
    return simple.render(bridge.sessions(spark, d), bridge.messages(spark, d))
