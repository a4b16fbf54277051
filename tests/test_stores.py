"""Stores on disk, entry points, the cache, the stream, search and projections."""

import json
import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from threadloom import api
from threadloom.formats import FORMATS, Json, Meta, Session, Unsupported, base
from threadloom.functions import text as T
from threadloom.operators import folds, incremental
from threadloom.operators import search as S
from threadloom.operators import transcripts as R
from threadloom.operators.needles import needles_in
from threadloom.sources import stores
from threadloom.streaming import follow

T0 = datetime(2026, 3, 4, 5, 6, 7, tzinfo=UTC)


def talk(n, words="hello world"):
    return Session(
        Meta(f"id-{n}", T0 + timedelta(hours=n), f"/w/p{n % 2}", "main", f"Title {n}"),
        [
            base.message("user", [base.text(words)], T0 + timedelta(hours=n)),
            base.message("assistant", [base.thinking("let me see"), base.call("c", "Bash", {"command": "ls -l", "description": "list it"})], T0 + timedelta(hours=n, seconds=1), "m", "tool_use", base.usage(4, 5)),
            base.message("user", [base.result("c", "file one\nfile two", True)], T0 + timedelta(hours=n, seconds=2)),
            base.message("assistant", [base.text("answer " + words)], T0 + timedelta(hours=n, seconds=3), "m", "end_turn"),
        ],
    )


def frame(spark, *sessions, harness="simple"):
    from threadloom.formats import Unit

    rows = [stores.transcript_row(harness, Unit(f"/s/{s.meta.id}", {}, T0), "f", s.meta, s.messages) for s in sessions]
    return spark.createDataFrame(rows, stores.SCHEMA)


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stores")
    out = {}
    for n, name in enumerate(["claude_code", "codex", "pi", "grok", "cursor", "antigravity"]):
        out[name] = f"file://{root}/{name}"
        stores.save(frame(spark, talk(n), talk(n + 10, "needle in a stack")), name, out[name]).collect()
    os.makedirs(root / "codex" / "2026", exist_ok=True)
    (root / "codex" / "2026" / "rollout-broken.jsonl").write_bytes(b"\xff\xfe{")
    (root / "claude_code" / "x" / "subagents").mkdir(parents=True)
    (root / "claude_code" / "x" / "subagents" / "a.jsonl").write_text('{"type":"user","uuid":"u","message":{"content":"hidden"}}\n')
    (root / "cowork").mkdir()
    return out | {"campfire": f"file://{root}/none", "cowork": f"file://{root}/cowork"}


def test_discovery_spans_stores_and_skips_what_is_broken(spark, roots):
    heads = stores.discover(spark, roots).collect()
    assert len(heads) == 12 and [h.ts for h in heads] == sorted((h.ts for h in heads), reverse=True)
    assert {h.n_messages for h in heads} == {4, 5} and all(h.fingerprint for h in heads)
    assert {h.harness for h in stores.discover(spark, roots, "pi").collect()} == {"pi"}
    total, page = api.list_sessions(spark, roots, cwd="/w/p1", limit=2, offset=1)
    assert total == 6 and [r.id for r in page.collect()] == ["id-13", "id-11"]
    assert api.list_sessions(spark, roots, offset=99)[1].count() == 0


def test_reading_searching_and_slicing(spark, roots):
    where = next(h.source for h in stores.discover(spark, roots, "grok").collect() if h.id == "id-3")
    assert stores.read(spark, "grok", where).messages[0]["content"][0]["text"] == "hello world"
    (text,) = api.read_session(spark, roots, "id-2", "pi")
    assert text.startswith("[session]\nid=id-2\nstarted=2026-03-04T07:06:07+00:00\n") and "[result 1 error]\nfile one\nfile two\n" in text
    (part,) = api.read_session(spark, roots, "id-2#3-", "pi")
    assert "fragment=#3-4\nof=4\n" in part and "── #3 ──\n[result 1 error]" in part and "let me see" not in part
    assert len(api.read_session(spark, roots, "Title 0", "claude", budget=60)) > 3 and "".join(api.read_session(spark, roots, "id-2", "pi", budget=60)) == text
    for bad in ("id-", "zzz", ""):
        with pytest.raises(LookupError):
            api.read_session(spark, roots, bad)
    found = api.search_sessions(spark, roots, "needle stack", hits=1).collect()
    assert len(found) == 6 and all("needle" in r.text for r in found)
    assert [(m["start"], m["end"]) for m in found[0].marks] == [(found[0].text.index(w), found[0].text.index(w) + len(w)) for w in ("needle", "stack")]
    assert api.search_sessions(spark, roots, " ", limit=3).count() == 3


def test_saving_is_refused_where_it_has_to_be(spark, tmp_path):
    rows = frame(spark, talk(1))
    for name in ("claude_chat", "hermes", "amp", "simple", "opencode"):
        with pytest.raises(Unsupported):
            stores.save(rows, name, str(tmp_path))
    with pytest.raises(Exception, match="can't be part of a path"):
        bad = talk(1)
        bad.meta.id = "../up"
        stores.save(frame(spark, bad), "pi", str(tmp_path)).collect()


def test_deletion_stays_inside_the_store(spark, roots, tmp_path):
    outside = tmp_path / "a" / "b"
    outside.mkdir(parents=True)
    (outside / "updates.jsonl").write_text("")
    link = stores._local(roots["grok"]) + "/p"
    os.makedirs(link, exist_ok=True)
    os.symlink(outside, f"{link}/link")
    for where in (str(outside), f"{link}/link", stores._local(roots["grok"]), f"{link}/missing"):
        with pytest.raises(Unsupported):
            stores.delete("grok", where, roots["grok"])
    os.remove(f"{link}/link")
    os.rmdir(link)
    for name in ("grok", "codex", "antigravity"):
        stores.save(frame(spark, talk(50)), name, f"file://{tmp_path}/{name}").collect()
        (head,) = stores.discover(spark, {name: f"file://{tmp_path}/{name}"}).collect()
        stores.delete(name, head.source, f"file://{tmp_path}/{name}")
        assert stores.discover(spark, {name: f"file://{tmp_path}/{name}"}).count() == 0
    with pytest.raises(Unsupported):
        stores.delete("hermes", "x", "y")


def test_export_and_artifacts(spark, tmp_path):
    s = talk(1)
    s.messages[3]["content"] += [base.artifact("a", "re/port:1.txt", "text", "body"), base.artifact("b", "bad", "base64", "%%%"), base.artifact("c", "big", "text", "x" * 50)]
    doc = json.loads(stores.export(frame(spark, s), 3).first().document)
    assert len(doc["messages"]) == 1 and doc["messages"][0]["content"][1]["artifact"]["source"] == {"type": "text", "text": "body"}
    kept = stores.materialise(s, str(tmp_path / "files"), most=40).messages[3]["content"][1:]
    assert [x["kind"] for x in kept] == ["path", "base64", "text"] and open(kept[0]["value"]).read() == "body" and kept[0]["value"].endswith("re_port_1.txt")
    assert len(stores.safe_name("é" * 300).encode()) <= 180 and stores.safe_name("..") == "artifact"
    assert stores.fresh(s.meta, T0, "/here").id != s.meta.id


def test_projections_of_every_block(spark):
    s = Session(Meta("x", T0, None, None, "T\nwo", None, "mm"), [
        base.message("user", [base.text("a\n\n"), base.image("image/png", "QQ"), base.call("k", "/go", {})], T0),
        base.message("assistant", [base.call("t", "MultiEdit", {"file_path": "f", "edits": [{"old_string": "o", "new_string": "n"}]}), base.result("k", Json({"b": 1, "a": 2})), base.artifact("q", "n", "base64", "QQ")], T0),
    ])
    rows = frame(spark, s)
    assert R.text(rows).first().body == (
        "[session]\nid=x\nstarted=2026-03-04T05:06:07+00:00\ntitle=T wo\nmodel=mm\n\n[user]\na\n\n[image image/png omitted]\n\n[tool 1 /go]\n\n"
        '[tool 2 MultiEdit]\n{"edits":[{"new_string":"n","old_string":"o"}],"file_path":"f"}\n\n[result 1]\n{"a":2,"b":1}\n\n[artifact n]\nbinary data omitted\n'
    )
    got = [(r.msg_idx, r.block_idx, r.origin, r.text) for r in R.lines(rows).orderBy("line_seq").collect()]
    assert got == [(0, 0, "meta", "T"), (0, 0, "meta", "wo"), (0, 0, "user", "a"), (0, 2, "tool_use", "/go"), (1, 0, "tool_use", "f"), (1, 0, "tool_use", "o"), (1, 0, "tool_use", "n"), (1, 1, "tool_result", '{"a":2,"b":1}'), (1, 2, "assistant", "n")]
    assert R.sliced(rows, 1).select(F.size("messages")).first()[0] == 1 and R.sliced(rows, 3).count() == 0
    assert R.text(rows, 5, fragment=True).count() == 0
    roll = R.roll_up(frame(spark, talk(1))).first()
    assert (roll.n_messages, roll.n_calls, roll.n_failed, roll.input_tokens, roll.output_tokens) == (4, 1, 1, 4, 5)


def test_a_long_line_takes_no_longer_than_its_length(spark):
    line = "the " * 20_000
    df = spark.createDataFrame([(line,), ("the z",)], "text string")
    begin = time.time()
    assert [S.matches(S.Query.fuzzy("thez"), F.col("text"))] and df.where(S.matches(S.Query.fuzzy("thez"), F.col("text"))).count() == 1
    assert S.alignment_scores([line], "thee")[0] > 0 and time.time() - begin < 30
    for special in "^]\\-[.&$":
        assert df.select(F.lit(f"x{special}y").rlike(S.subsequence_pattern(f"{special}y"))).first()[0] and not df.select(F.lit("xy").rlike(S.subsequence_pattern(special))).first()[0]
    assert S.merge_spans([5, 1, 2, 2, 3]) == [(1, 4), (5, 6)]


def test_active_path_falls_back_to_all(spark):
    nodes = [("ok", 1, None), ("ok", 2, 1), ("ok", 3, 1), ("ok", 4, 3), ("loop", 1, 2), ("loop", 2, 1), ("gone", 1, 9), ("gone", 2, 1), ("leaf", 1, None)]
    df = spark.createDataFrame(nodes, "k string, node bigint, parent bigint")
    leaves = spark.createDataFrame([("ok", 4), ("loop", 2), ("gone", 2), ("leaf", 7)], "k string, node bigint")
    got = {}
    for r in folds.active_path(df, leaves, ["k"]).orderBy("k", F.desc("depth")).collect():
        got.setdefault(r.k, []).append(r.node)
    assert got == {"ok": [1, 3, 4], "loop": [1, 2], "gone": [1, 2], "leaf": [1]}
    deep = spark.range(30_000).select(F.lit("d").alias("k"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert folds.active_path(deep, spark.createDataFrame([("d", 29_999)], "k string, node bigint"), ["k"]).count() == 30_000


def test_cache_keeps_the_last_rows_of_its_version(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    cache = incremental.Cache(spark, folder, ["id"], "1")
    row = lambda *r: spark.createDataFrame(list(r), "id string, cursor string, line string")
    live = row(("a", "1", ""), ("b", "2", ""), ("c", "", "")).drop("line")
    assert cache.read() is None and cache.lookup(live)[1].count() == 3
    cache.upsert(row(("a", "1", "x"), ("a", "1", "y"), ("b", "1", "old"), ("c", "", "z")))
    hits, misses = cache.lookup(live)
    assert sorted(r.line for r in hits.collect()) == ["x", "y"] and sorted(r.id for r in misses.collect()) == ["b", "c"]
    cache.upsert(row(("b", "2", "new")))
    assert sorted(r.line for r in cache.lookup(live)[0].collect()) == ["new", "x", "y"]
    os.makedirs(f"{tmp_path}/cache/g00000009-dead")  # its writer was lost
    cache.compact(live.where("id <> 'a'"))
    assert sorted(r.line for r in cache.read().collect()) == ["new", "z"] and len(cache.generations()) == 1
    assert incremental.Cache(spark, folder, ["id"], "2").read().count() == 0


def test_a_store_is_followed(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    stores.save(frame(spark, talk(1), talk(2)), "pi", root).collect()
    cache = incremental.Cache(spark, f"file://{tmp_path}/cache", ["harness", "id"], "1")
    for n in (2, 3):
        follow.into_cache(follow.transcripts(spark, "pi", root), cache, f"file://{tmp_path}/at", lambda x: x.drop("messages"), once=True).awaitTermination()
        assert cache.read().count() == n
        stores.save(frame(spark, talk(9)), "pi", root).collect()
    with pytest.raises(Unsupported):
        follow.transcripts(spark, "grok", root)


def test_needles_by_one_automaton(spark, monkeypatch):
    rows = spark.createDataFrame([("abcab",), (None,), ("zab",)], "t string")
    needles = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "bca"), (4, ""), (5, None)], "item_id int, text string")
    want = [1, 1, 2, 2, 3]
    assert sorted(r.item_id for r in needles_in(rows, "t", needles).collect()) == want
    monkeypatch.setattr("threadloom.operators.needles.MOST_CHARS", 1)
    assert sorted(r.item_id for r in needles_in(rows, "t", needles).collect()) == want


def test_scalars_of_text(spark):
    df = spark.createDataFrame([("a\x00b\x1fc\x7f", "data:image/png;base64,QQ==", "data:x", 1.5, float("nan"))], "a string, u string, v string, x double, y double")
    r = df.select(T.scrub(F.col("a")), T.short_id(F.lit("0123456789")), T.data_url(F.col("u")), T.data_url(F.col("v")), F.unix_micros(T.epoch_seconds(F.col("x"))), T.epoch_seconds(F.col("y"))).first()
    assert tuple(r) == ("a b c ", "01234567", ("image/png", "QQ=="), None, 1_500_000, None)


def test_fingerprints_and_conversion_of_files(spark, roots, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    files = incremental.file_fingerprints(spark.read.option("wholetext", True).text(str(tmp_path)))
    assert files.first().cursor.endswith(":2")
    fmt = FORMATS["claude_code"]
    native = fmt.render(talk(1).meta, fmt.from_common(talk(1)))
    (out,) = api.convert(native, "/x/one.jsonl", "claude", "codex")
    assert next(iter(out)).startswith("2026/03/04/rollout-2026-03-04T06-06-07-id-1") and "antigravity" in api.harnesses()
    store = spark.createDataFrame([("simple", "1", "v")], "harness string, id string, writer_version string")
    assert incremental.cache_current(store, "v").count() == 1


def test_one_session_or_none(spark):
    from threadloom.operators.sessions import NotOne, find_session

    rows = spark.createDataFrame([("ab1", "T", 1, 0), ("ab1", "U", 5, 1), ("ab2", "ab1", 9, 2), ("cd", None, 3, 3)], "id string, title string, ts bigint, seq bigint")
    assert find_session(rows, "ab1").first().seq == 2 and find_session(rows, "c").first().id == "cd" and find_session(rows, "T").first().seq == 0
    for bad in ("", "ab", "zz"):
        with pytest.raises(NotOne):
            find_session(rows, bad)


def test_an_index_takes_and_gives_sessions(spark):
    index = api.Searcher(frame(spark, talk(1), talk(2)))
    index.insert(frame(spark, talk(2, "other words"), talk(3)))
    assert len(index) == 3 and {r.id for r in index.query(S.Query.substring("hello")).collect()} == {"id-1", "id-3"}
    index.remove(frame(spark, talk(1)))
    assert len(index) == 2 and [r.id for r in index.query(S.Query.fuzzy("'other words$")).collect()] == ["id-2", "id-2"]


def test_what_a_user_types():
    from threadloom.functions.driver import parse_when, resume_command, unified_diff

    assert parse_when("2026-01-02", "Europe/Berlin") == datetime(2026, 1, 1, 23, tzinfo=UTC)
    assert parse_when("2026-01-02", end=True) == datetime(2026, 1, 2, 23, 59, 59, tzinfo=UTC) and parse_when("2026-01-02T03:04:05+01:00").hour == 2
    for bad in ("yesterday", "2026-01-02T03:04:05"):
        with pytest.raises(ValueError):
            parse_when(bad)
    assert resume_command("run --id '{id}' x", "a b") == ["run", "--id", "a b", "x"]
    text, plus, minus = unified_diff("f", "a\nb\n", "a\nc\nd\n")
    assert (plus, minus) == (2, 1) and "-b\n+c" in text


def test_cursors_follow_what_changes(spark, roots):
    found = stores.cursors(spark, roots)
    assert found.where("cursor = ''").count() == 0 and found.count() == 12


def test_records_keep_lines_as_they_are(spark):
    text = '{"type":"a","x":1.0}\n\nnot json\r\n[1]\n{"type":5}\r\n{"y":2}'
    files = spark.createDataFrame([("s", None, None, [("f", bytearray(text.encode()))])], stores.FILES)
    assert [tuple(r) for r in stores.records(files).orderBy("line_no").collect()] == [("s", 0, '{"type":"a","x":1.0}', "a"), ("s", 4, '{"type":5}', None), ("s", 5, '{"y":2}', None)]


class Captured:
    """A frame that keeps the function given to ``mapInArrow``."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self


def peak(batches):
    """Batches that a generator gives, as they come, and the most MB of Python's and of
    one batch meanwhile."""
    import tracemalloc

    tracemalloc.start()
    rows, largest = 0, 0
    for x in batches:
        rows, largest = rows + x.num_rows, max(largest, x.nbytes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most / 1e6, largest / 1e6


def many(n, messages):
    """One batch of sessions, as Spark would give it."""
    one = talk(1, "some words " * 40)
    one.messages = (one.messages * messages)[:messages]
    rows = [stores.transcript_row("simple", base_unit(k), None, one.meta, one.messages) for k in range(n)]
    return stores._batch(rows, stores.SCHEMA)


def base_unit(k):
    from threadloom.formats import Unit

    return Unit(f"/s/{k}", {}, T0)


def test_tools_go_through_a_format_in_one_worker_a_task_and_a_piece_of_memory(spark):
    from threadloom.plans import transcripts as plans

    tools = plans.convert_tools(spark, "/root/testdata/sf0.001")
    assert tools._jdf.queryExecution().analyzed().toString().count("MapInArrow") == len(plans.EXACT)
    batch = many(150, 60)
    rows, python, _ = peak(stores.through(Captured(), "claude_code").run(iter([batch])))
    assert rows == 150 and python < 20


def test_through_a_format_as_written_and_read(spark):
    rows = frame(spark, *[talk(n, "x" * n) for n in range(5)])
    for name in ("claude_code", "codex", "antigravity", "cursor", "cowork"):
        apart = stores.parse(stores.convert(rows, name), name).collect()
        assert sorted(stores.through(rows, name).collect()) == sorted(apart) and len(apart) == 5


def test_databases_are_made_and_read_a_piece_at_a_time():
    made = list(stores.convert(Captured(), "antigravity").run(iter([many(200, 6)])))
    assert sum(x.num_rows for x in made) == 200 and max(x.nbytes for x in made) < 2 << 20
    import pyarrow as pa

    whole = pa.Table.from_batches(made).combine_chunks().to_batches()
    rows, python, largest = peak(stores.parse(Captured(), "antigravity").run(iter(whole)))
    assert len(whole) == 1 and rows == 200 and python < 8 and largest < 2


def test_rollouts_are_made_and_read_a_piece_at_a_time():
    rows, python, largest = peak(stores.convert(Captured(), "codex").run(iter([many(1_500, 6)])))
    assert rows == 1_500 and python < 12 and largest < 2
    rows, python, largest = peak(stores.through(Captured(), "codex").run(iter([many(1_500, 6)])))
    assert rows == 1_500 and python < 12 and largest < 2
