"""Operators of the engine on small cases, and every query against its SQL."""

import json
import uuid

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadloom.functions import text as T
from threadloom.operators import folds, slicing, tools
from threadloom.operators import search as S
from threadloom.plans import transcripts as _  # noqa: F401 - adds its queries
from threadloom.plans.catalog import ORACLES, QUERIES
from threadloom.sources import simple

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "events", "documents", "benchmark")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranges():
    assert slicing.split_reference("a#b#2-4") == ("a#b", (2, 4))
    assert slicing.split_reference("a#-") == ("a#-", None) and slicing.split_reference("a#top") == ("a#top", None)
    assert slicing.resolve_range((2, None), 5) == (1, 5) and slicing.resolve_range((None, 3), 5) == (0, 3)
    for bad in ((0, 2), (3, 2), (1, 9)):
        with pytest.raises(ValueError):
            slicing.resolve_range(bad, 5)


def test_pairs_take_the_latest_use(spark):
    rows = [(1, 0, "use", "a"), (1, 1, "use", "a"), (1, 2, "result", "a"), (1, 3, "result", "a"), (1, 4, "result", "b"), (1, 5, "use", "c")]
    b = spark.createDataFrame(rows, "k int, pos bigint, kind string, call string")
    p = slicing.tool_pairs(b, ["k"])
    assert sorted((r.use_pos, r.result_pos) for r in p.collect()) == [(1, 2), (1, 3)]
    assert [r.pos for r in slicing.orphan_results(b, p, ["k"]).collect()] == [4]
    assert sorted(r.pos for r in slicing.dangling_uses(b, p, ["k"]).collect()) == [0, 5]
    sizes = spark.createDataFrame([(1, 6)], "k int, n bigint")
    assert [tuple(r) for r in slicing.nearest_valid(sizes, p, ["k"], 2, 3).collect()] == [(1, 1, 4)]


def test_atoms():
    assert S.parse_atoms("ab 'cd ^ef gh$ !ij ^kl$") == [
        (False, "fuzzy", "ab"), (False, "exact", "cd"), (False, "prefix", "ef"), (False, "suffix", "gh"), (True, "exact", "ij"), (False, "equal", "kl"),
    ]
    assert S.Query.substring("The").sensitive and not S.Query.substring("the").sensitive


@given(st.text("abc ", max_size=12), st.text("abc", min_size=1, max_size=4))
def test_alignment_is_positive_for_subsequences_only(text, atom):
    it = iter(text)
    assert (S.alignment_score(text, atom) > 0) == all(c in it for c in atom)


def test_alignment_prefers_contiguous():
    assert S.alignment_score("xx needle", "needle") > S.alignment_score("n e e d l e", "needle")
    assert S.alignment_score("a needle", "needle") > S.alignment_score("a nee dle", "needle")


def test_tool_typing(spark):
    cases = [
        ("Edit", '{"file_path":"a","old_string":"b","new_string":"c"}', "Edit"),
        ("Edit", '{"file_path":"a","old_string":"b","new_string":"c","x":1}', "Raw"),
        ("Read", '{"file_path":1}', "Raw"),
        ("Read", '{"file_path":"a","limit":3}', "Read"),
        ("MultiEdit", '{"file_path":"a","edits":[{"old_string":"b","new_string":"c"}]}', "MultiEdit"),
        ("MultiEdit", '{"file_path":"a","edits":[{"old_string":"b","new_string":"c","z":1}]}', "Raw"),
        ("Bash", '{"command":"ls","timeout_ms":5,"workdir":"/"}', "Bash"),
        ("Bash", '{"command":"ls","timeout":5}', "Raw"),
        ("/clear", '{"x":1}', "Raw"),
        ("MultiEdit", '{"file_path":"a","edits":[{"old_string":1,"new_string":"c"}]}', "Raw"),
        ("Bash", "not json", "Raw"),
        ("/clear", "{}", "Command"),
        ("mcp__x", "{}", "Raw"),
    ]
    df = spark.createDataFrame(cases, "name string, input string, want string")
    bad = df.select("*", tools.tool_kind(F.col("name"), F.col("input")).alias("got")).where("got <> want").collect()
    assert bad == []


def test_scalars(spark):
    ns = uuid.uuid4()
    names = ["", "a", "é∂", "conv-12"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.uuid5(ns, F.col("n"))).collect()] == [str(uuid.uuid5(ns, n)) for n in names]
    one = spark.createDataFrame([("a  b\n", "/foo/barbaz", "tITLE x")], "a string, d string, t string")
    r = one.select(T.one_line(F.col("a")), T.under_dir(F.col("d"), "/foo/bar"), T.under_dir(F.col("d"), "/"), T.title_case(F.col("t"))).first()
    assert tuple(r) == ("a b", False, True, "TITLE x")


def test_greedy_chunks(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 20, 1, 9, 2])], "k string, i bigint, n bigint")
    got = folds.greedy_chunks(df, ["k"], "i", "n", 10).orderBy("i").collect()
    assert [r.chunk for r in got] == [0, 0, 1, 2, 2, 3]


def test_simple_documents(spark, tmp_path):
    doc = {
        "id": "sess-7", "timestamp": "2025-11-12T03:04:05Z", "cwd": "/w", "title": 5,
        "messages": [
            {"role": "user", "content": "hello"},
            {"role": "system", "content": "no"},
            {"role": "assistant", "timestamp": "bad", "content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]},
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "q", "content": {"a": 1}, "is_error": True}]},
        ],
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text('{"messages": []}')
    docs = simple.read_documents(spark, str(tmp_path))
    s = {r.id: r for r in simple.sessions(docs).collect()}
    assert set(s) == {"sess-7", "c"} and s["sess-7"].title is None and s["sess-7"].cwd == "/w"
    m = simple.messages(docs)
    assert [(r.msg_idx, r.role) for r in m.orderBy("msg_idx").collect()] == [(0, "user"), (1, "assistant"), (2, "user")]
    b = simple.blocks(m).orderBy("msg_idx", "block_idx").collect()
    assert [r.type for r in b] == ["text", "text", "tool_use", "tool_result"]
    assert b[2].tool_input_json == '{"command":"ls"}' and b[2].tool_use_id and b[3].output_json == '{"a":1}' and b[3].is_error
