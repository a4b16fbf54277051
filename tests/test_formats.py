"""Native formats: what each reads, and that conversions keep what they can."""

import json
import sqlite3
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.formats import FORMATS, Json, Meta, Session, Unit, Unsupported, amp, base, claude_code, codex, get, grok, hermes, pi
from threadloom.sources import stores

T0 = datetime(2026, 3, 4, 5, 6, 7, 120_000, UTC)


def at(n):
    return T0 + timedelta(seconds=n)


def load(name, text, source="/store/one.json", mtime=T0):
    files = text if isinstance(text, dict) else {"f": text if isinstance(text, bytes) else text.encode()}
    found = FORMATS[name].sessions(Unit(source, files, mtime))
    return [(m, FORMATS[name].to_common(m, body)) for m, body in found]


def jsonl(*rows):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def shape(messages):
    return [(m["role"], [b["type"] for b in m["content"]]) for m in messages]


def sample():
    return Session(
        Meta("9d0c4e5a-0000-4000-8000-00000000abcd", T0, "/w/dir", "main", "A title", "1.2", "model-x"),
        [
            base.message("user", [base.text("please fix it")], at(0)),
            base.message("assistant", [base.text("looking")], at(1), "model-x"),
            base.message("assistant", [base.call("c1", "Edit", {"file_path": "a.py", "new_string": "yy", "old_string": "xx"})], at(1), "model-x", "tool_use", base.usage(10, 5)),
            base.message("user", [base.result("c1", "done")], at(2)),
            base.message("assistant", [base.call("c2", "Bash", {"command": "ls", "workdir": "/w"})], at(3), "model-x", "tool_use"),
            base.message("user", [base.result("c2", "no such file", True)], at(4)),
            base.message("assistant", [base.call("c3", "Custom_thing", {"k": [1, "z"]})], at(5), "model-x", "tool_use"),
            base.message("user", [base.result("c3", "ok")], at(6)),
            base.message("assistant", [base.text("all good")], at(7), "model-x", "end_turn", base.usage(3, 4)),
        ],
    )


# Base


def test_typing_needs_the_exact_keys_and_types():
    kind = base.tool_kind
    assert kind("Edit", {"file_path": "a", "old_string": "b", "new_string": "c"}) == "Edit"
    assert kind("Edit", {"file_path": "a", "old_string": "b", "new_string": "c", "x": 1}) == "Raw"
    assert kind("Bash", {"command": "x", "timeout_ms": 1, "workdir": "/"}) == "Bash" and kind("Bash", {"command": "x", "timeout": 1}) == "Raw"
    assert kind("Read", {"file_path": "a", "offset": -1}) == kind("Read", {"file_path": "a", "limit": 1.0}) == "Raw"
    assert kind("Read", {"file_path": "a", "offset": None}) == "Read" and kind("Edit", {"file_path": "a", "old_string": "", "new_string": "", "replace_all": None}) == "Raw"
    assert kind("/x", {}) == kind("/x", {"args": "y"}) == "Command" and kind("/x", {"x": 1}) == "Raw"
    assert kind("MultiEdit", {"file_path": "a", "edits": [{"old_string": "a", "new_string": 1}]}) == kind("mcp__q", {}) == "Raw"
    assert base.typed_input("Edit", {"file_path": "a", "old_string": "", "new_string": "", "replace_all": False}) == {"file_path": "a", "old_string": "", "new_string": ""}


def test_values_are_never_coerced():
    assert base.S({"a": 5}, "a") is None and base.N({"a": True}, "a") is None and base.N({"a": -1}, "a") is None
    assert base.loads("NaN", None) is None and base.loads('"\\ud800"', None) is None and base.loads('"\\ud83d\\ude00"') == "😀"
    assert base.when("2025-11-12T03:04:05") is None and base.when("2025-11-12T03:04:05+01:00").hour == 2
    assert base.from_seconds(float("nan")) is None and base.from_seconds(1.5) == base.EPOCH + timedelta(seconds=1.5)
    for bad in ("", ".", "..", "a/b", "a:b", "a\n"):
        with pytest.raises(Unsupported):
            base.safe_id("x", bad)


# claude_code


def entry(kind, uuid, content, parent=None, **more):
    m = {"role": kind, "content": content} | more.pop("message", {})
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "sessionId": "sess-7", "timestamp": "2025-11-12T03:04:05.500Z", "message": m} | more


def test_claude_code_reads_blocks_and_header():
    text = jsonl(
        {"type": "summary", "summary": "old", "leafUuid": "x"},
        "not json",
        {"type": "file-history-snapshot", "data": {}},
        entry("user", "u1", "hi", cwd="/w", gitBranch="dev", version="9"),
        entry("assistant", "a1", [
            {"type": "thinking", "thinking": "hm", "signature": "sig"},
            {"type": "tool_use", "id": "t1", "name": "Edit", "input": {"file_path": "f", "old_string": "a", "new_string": "b"}},
            {"type": "tool_use", "id": "t2", "name": "Artifact", "input": {"file_path": "/x/y.txt"}},
            {"type": "mystery"},
        ], message={"model": "m1", "stop_reason": "tool_use", "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_input_tokens": 3}}, timestamp="2025-11-12T03:04:04Z"),
        entry("user", "u2", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "ok"}], "is_error": True}]),
        entry("user", "u3", []),
        {"type": "user", "uuid": 7, "message": {"content": "bad uuid"}},
        {"type": "custom-title", "customTitle": "named"},
        {"type": "agent-name", "agentName": "ignored"},
    )
    ((meta, messages),) = load("claude_code", text)
    assert (meta.id, meta.cwd, meta.git_branch, meta.cli_version, meta.model, meta.title) == ("sess-7", "/w", "dev", "9", "m1", "named")
    assert meta.timestamp == datetime(2025, 11, 12, 3, 4, 4, tzinfo=UTC)
    assert shape(messages) == [("user", ["text"]), ("assistant", ["thinking", "tool_use", "artifact"]), ("user", ["tool_result"])]
    assert messages[1]["usage"]["cache_read_input_tokens"] == 3 and messages[1]["content"][2]["name"] == "y.txt"
    assert messages[2]["content"][0] == base.result("t1", Json([{"type": "text", "text": "ok"}]), True)


def test_claude_code_pairs_commands_with_their_output():
    name = "<command-name>/release</command-name>\n<command-message>release</command-message>\n<command-args> now </command-args>"
    text = jsonl(
        entry("user", "c1", name),
        {"type": "system", "uuid": "o1", "parentUuid": "c1", "content": "<local-command-stdout>\x1b[31mred\x1b[0m \x1b]8;;u\x07x</local-command-stdout>"},
        {"type": "system", "uuid": "o2", "parentUuid": "c1", "content": "<local-command-stdout>alone</local-command-stdout>"},
        entry("user", "k", "<local-command-caveat>boiler</local-command-caveat>"),
        entry("user", "q", "look: <command-name>/x</command-name>"),
        {"type": "system", "uuid": "z", "content": "turn took 3 s"},
    )
    ((_, m),) = load("claude_code", text)
    assert m[0]["content"][0] == base.call("c1", "/release", {"args": "now"})
    assert m[1]["content"][0] == base.result("c1", "red x") and m[2]["content"][0]["id"] == "o2"
    assert shape(m[3:]) == [("user", ["text"])]


@given(st.text("<>/\\abc-", max_size=30), st.text(alphabet="abc </>\\", min_size=1, max_size=12))
def test_claude_code_payloads_of_commands_survive(out, args):
    hostile = out + "</local-command-stdout>" + out
    s = Session(Meta("s", T0), [
        base.message("user", [base.call("c", "/do", {"args": "x" + args.strip() + "</command-args>y"})], T0),
        base.message("user", [base.result("c", hostile)], T0),
    ])
    lines = claude_code.to_lines(s)
    back = claude_code.to_messages(lines, T0)
    assert back[0]["content"][0]["input"] == s.messages[0]["content"][0]["input"]
    assert back[1]["content"][0]["output"] == hostile and back[1]["content"][0]["id"] == back[0]["content"][0]["id"]


# codex


def line(kind, **payload):
    return {"timestamp": "2025-11-12T03:04:05Z", "type": kind, "payload": payload}


def test_codex_folds_turns_searches_and_mirrored_results():
    text = jsonl(
        line("session_meta", id="r1", cwd="/w", git={"branch": "b"}, timestamp="2025-11-11T00:00:00Z"),
        line("response_item", type="message", role="user", content=[{"type": "input_text", "text": " <environment_context>x"}]),
        line("response_item", type="message", role="user", content=[{"type": "input_text", "text": "go"}, {"type": "input_image", "image_url": "data:image/png;base64,QQ=="}]),
        line("turn_context", turn_id="t1", model="gpt"),
        line("response_item", type="reasoning", summary=[{"type": "summary_text", "text": "a"}, {"type": "summary_text", "text": "b"}]),
        line("response_item", type="function_call", name="exec_command", call_id="c1", arguments=json.dumps({"cmd": ["bash", "-lc", "ls -l"], "workdir": "/q"})),
        line("event_msg", type="exec_command_end", call_id="c1", aggregated_output="files", exit_code=2),
        line("response_item", type="function_call_output", call_id="c1", output="mirror"),
        line("response_item", type="function_call_output", call_id="c9", output="kept"),
        line("response_item", type="custom_tool_call", name="apply_patch", call_id="p1", input="*** Begin Patch\n*** Update File: a.py\n@@\n-xx\n+yy\n z\n*** End Patch"),
        line("response_item", type="custom_tool_call_output", call_id="p1", output=json.dumps({"output": "Success", "metadata": {"exit_code": 0}})),
        line("event_msg", type="web_search_end", call_id="w1", query="cats", action={"type": "search", "queries": ["cats", "dogs"]}),
        line("response_item", type="web_search_call", action={"type": "search", "queries": ["cats", "dogs"]}),
        line("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "done"}]),
        line("event_msg", type="token_count", info={"last_token_usage": {"input_tokens": 7, "output_tokens": 8, "cached_input_tokens": 1}}),
        line("event_msg", type="task_complete", turn_id="t1"),
        {"type": 5, "payload": {}},
    )
    ((meta, m),) = load("codex", text)
    assert (meta.id, meta.cwd, meta.git_branch) == ("r1", "/w", "b")
    blocks = [b for x in m for b in x["content"]]
    assert [b["type"] for b in blocks] == ["text", "image", "thinking", "tool_use", "tool_result", "tool_result", "tool_use", "tool_result", "tool_result", "tool_use", "text"]
    assert blocks[2]["text"] == "a\n\nb" and blocks[3]["input"] == {"command": "ls -l", "workdir": "/q"}
    assert blocks[4] == base.result("c1", "files", True) and blocks[5] == base.result("c9", "kept")
    assert (blocks[6]["name"], blocks[6]["input"]) == ("Edit", {"file_path": "a.py", "new_string": "yy\nz", "old_string": "xx\nz"})
    assert blocks[7] == base.result("p1", "Success") and blocks[8]["output"] == "cats\ndogs" and blocks[9]["id"] == "w1"
    assert m[-1]["model"] == "gpt" and m[-1]["usage"] == base.usage(7, 8, 1)
    assert load("codex", jsonl(line("session_meta", cwd="/w"))) == []


def test_codex_search_that_ends_after_its_call():
    action = {"type": "open_page", "url": "http://x"}
    text = jsonl(line("session_meta", id="r"), line("response_item", type="web_search_call", action=action), line("event_msg", type="web_search_end", call_id="w", action=action))
    ((_, m),) = load("codex", text)
    assert [b["id"] for x in m for b in x["content"]] == ["w", "w"] and m[1]["content"][0]["output"] == "http://x"


@pytest.mark.parametrize(("patch", "want"), [
    ("*** Add File: n.txt\n+a\n+b", ("Write", {"file_path": "n.txt", "content": "a\nb"})),
    ("*** Update File: a\n@@\n-x\n+y\n@@\n-p\n+q", None), ("*** Add File: a\n+x\n*** Add File: b\n+y", None), ("*** Delete File: a", None), ("*** Update File: a\n*** Move to: b\n@@\n-x", None),
])
def test_codex_patches(patch, want):
    name, value = codex.patch_call(patch)
    assert (name, value) == want if want else name == "ApplyPatch" and value["patch"] == patch and value["files"]


# pi, opencode, amp, hermes, grok, cowork, claude_chat


def test_pi_reads_runs_and_edits():
    text = jsonl(
        {"type": "session", "version": 3, "id": "p1", "timestamp": "2025-11-12T03:04:05Z", "cwd": "/w"},
        {"type": "model_change", "modelId": "m2"}, {"type": "session_info", "name": " T "},
        {"type": "message", "id": "1", "message": {"role": "user", "content": "hi"}},
        {"type": "message", "id": "2", "message": {"role": "bashExecution", "command": "rm", "excludeFromContext": True}},
        {"type": "message", "id": "3", "message": {"role": "bashExecution", "command": "ls", "output": "o", "exitCode": 1}},
        {"type": "message", "id": "4", "message": {"role": "assistant", "model": "m", "stopReason": "toolUse", "usage": {"input": 0, "output": 0}, "content": [
            {"type": "toolCall", "id": "a", "name": "edit", "arguments": {"path": "f", "edits": [{"oldText": "x", "newText": "y"}]}},
            {"type": "toolCall", "id": "b", "name": "edit", "arguments": {"path": "f", "edits": [{"oldText": "x", "newText": "y"}, {"oldText": "p", "newText": "q"}]}},
            {"type": "toolCall", "id": "c", "name": "zap", "arguments": {}}]}},
        {"type": "message", "id": "5", "message": {"role": "toolResult", "toolCallId": "a", "content": [{"type": "text", "text": "1"}, {"type": "text", "text": "2"}]}},
        {"type": "custom_message", "content": "note"},
    )
    for name in ("pi", "campfire"):
        ((meta, m),) = load(name, text)
        assert (meta.id, meta.title, meta.model) == ("p1", "T", "m2")
        assert m[1]["content"][0] == base.call("bash_exec_2", "Bash", {"command": "ls"}) and m[2]["content"][0]["is_error"]
        assert [b["name"] for b in m[3]["content"]] == ["Edit", "MultiEdit", "Zap"] and m[3]["usage"] is None and m[3]["stop_reason"] == "tool_use"
        assert m[4]["content"][0]["output"] == "1\n2" and m[5]["content"][0]["text"] == "note"
    assert load("pi", jsonl({"type": "message", "id": "1", "message": {}})) == []
    assert pi.folder_name("/a/b:c") == "--a-b-c--"


def opencode_db():
    con = sqlite3.connect(":memory:")
    con.executescript("""CREATE TABLE session(id, directory, title, version, time_created INT, time_archived INT, model, slug, time_updated INT);
        CREATE TABLE message(id, session_id, time_created INT, data); CREATE TABLE part(id, message_id, session_id, data);""")
    con.executemany("INSERT INTO session VALUES (?,?,?,?,?,?,?,?,?)", [
        ("ses_1", "/w", "New session - 1", "v", 1000, None, '{"id":"mm"}', "s", None), ("ses_2", "/w", "T", "v", 2000, None, None, "s", 5), ("ses_3", "/w", "T", "v", 3000, 1, None, "s", 5)])
    con.executemany("INSERT INTO message VALUES (?,?,?,?)", [("m1", "ses_1", 1001, '{"role":"user"}'), ("m2", "ses_1", 1002, json.dumps({"role": "assistant", "modelID": "k", "finish": "tool_calls", "tokens": {"input": 1, "output": 2, "cache": {"read": 0, "write": 4}}}))])
    parts = [
        ("p1", "m1", {"type": "text", "text": "q"}), ("p2", "m1", {"type": "text", "text": "syn", "synthetic": True}), ("p3", "m2", {"type": "text", "text": "before"}),
        ("p4", "m2", {"type": "tool", "tool": "read", "callID": "c", "state": {"status": "error", "error": "no", "input": {"filePath": "f"}}}),
        ("p5", "m2", {"type": "tool", "tool": "bash", "callID": "d", "state": {"status": "running", "input": {"command": "x"}}}), ("p6", "m2", {"type": "reasoning", "text": "after"}),
    ]
    con.executemany("INSERT INTO part VALUES (?,?,?,?)", [(i, m, "ses_1", json.dumps(d)) for i, m, d in parts] + [("p9", "m2", "ses_1", "{broken")])
    return con.serialize()


def test_opencode_database():
    (newer, none), (meta, m) = load("opencode", opencode_db())
    assert (newer.id, newer.title, none) == ("ses_2", "T", []) and (meta.id, meta.title, meta.model) == ("ses_1", None, "mm")
    assert shape(m) == [("user", ["text"]), ("assistant", ["text"]), ("assistant", ["tool_use"]), ("user", ["tool_result"]), ("assistant", ["tool_use"]), ("assistant", ["thinking"])]
    assert m[2]["content"][0]["input"] == {"file_path": "f"} and m[3]["content"][0] == base.result("c", "no", True)
    assert [x["usage"] for x in m[:-1]] == [None] * 5 and m[-1]["usage"] == base.usage(1, 2, None, 4) and m[-1]["stop_reason"] == "tool_use"
    assert FORMATS["opencode"].cursors(Unit("x", {"f": opencode_db()})) == {"ses_1": "1002", "ses_2": "0", "ses_3": "0"}


def test_hermes_database():
    con = sqlite3.connect(":memory:")
    con.executescript("""CREATE TABLE sessions(id, source, model, started_at REAL, cwd, git_branch, title, archived INT);
        CREATE TABLE messages(id INTEGER, session_id, role, content, tool_call_id, tool_calls, tool_name, timestamp REAL, active INT, compacted INT, extra BLOB);
        INSERT INTO sessions VALUES ('h1', 's', 'mm', 1.5, '/w', NULL, '', 0), ('h2', 's', 'mm', 1.5, '/w', NULL, '', 1);""")
    calls = json.dumps([{"id": "c", "function": {"name": "terminal", "arguments": '{"command":"ls","timeout":3}'}}, {"call_id": "e", "function": {"name": "patch", "arguments": '{"mode":"other"}'}}])
    con.executemany("INSERT INTO messages VALUES (?,?,?,?,?,?,?,?,?,?,?)", [
        (1, "h1", "user", '\0json:[{"type":"text","text":"q"},{"odd":1}]', None, None, None, 2.0, 1, 0, b"\x01"), (2, "h1", "user", "hidden", None, None, None, 2.0, 0, 0, None),
        (3, "h1", "assistant", None, None, calls, None, 3.0, 1, 0, None), (4, "h1", "tool", '{"exit_code":1}', "c", None, None, 4.0, 1, 0, None), (5, "h1", "assistant", "x", None, "[bad", None, 5.0, 1, 0, None)])
    ((meta, m),) = load("hermes", con.serialize())
    assert (meta.id, meta.timestamp, meta.title) == ("h1", base.EPOCH + timedelta(seconds=1.5), None)
    assert [b["text"] for b in m[0]["content"]] == ["q", '{"odd":1}']
    assert [(b["name"], b["input"]) for b in m[1]["content"]] == [("Bash", {"command": "ls", "timeout_ms": 3000}), ("patch", {"mode": "other"})]
    assert m[2]["content"][0] == base.result("c", Json({"exit_code": 1}), True) and shape(m[3:]) == [("assistant", ["text"])]
    assert hermes.canonical_call("patch", {"mode": "replace", "path": "f", "old_string": "a", "new_string": "b"})[0] == "Edit"


def test_amp_results_ranges_and_clock():
    def run(status, **more):
        return {"type": "tool_result", "toolUseID": status, "run": {"status": status} | more}

    doc = {"id": "T-12345678", "created": 5000, "env": {"initial": {"trees": [{"uri": "file:///a%20b", "repository": {"ref": "refs/heads/x"}}], "tags": ["model:tagged"]}}, "messages": [
        {"role": "user", "content": [{"type": "text", "text": " "}], "meta": {"sentAt": 9000}},
        {"role": "assistant", "state": {"type": "cancelled"}, "content": [{"type": "tool_use", "id": "r", "name": "Read", "input": {"path": "f", "read_range": [3, 7]}}]},
        {"role": "user", "content": [run("done", result={"a": 1}), run("error", error={"message": "bad"}), run("cancelled"), run("rejected-by-user", reason="no"), run("odd")]},
    ]}
    ((meta, m),) = load("amp", json.dumps(doc))
    assert (meta.cwd, meta.git_branch, meta.model, meta.timestamp) == ("/a b", "x", "tagged", base.from_ms(5000))
    assert m[0]["timestamp"] == base.from_ms(9000) and m[0]["stop_reason"] == "aborted" and m[0]["content"][0]["input"] == {"file_path": "f", "offset": 3, "limit": 5}
    assert [(b["output"], b["is_error"]) for b in m[1]["content"]] == [(Json({"a": 1}), False), ("bad", True), ("cancelled", True), ("no", True), (Json({"status": "odd"}), False)]
    for path in ("/a b/ü", "C:\\Users\\x", "/plain"):
        assert amp.uri_to_path(amp.path_to_uri(path)) == path
    assert amp.range_to_offset({"read_range": [2, 1]}) == {"read_range": [2, 1]} and amp.native_call("Read", {"file_path": "f", "offset": 2})[1] == {"path": "f", "offset": 2}
    assert amp.thread_id("T-abc") != "T-abc" and amp.thread_id("T-abcdefgh") == "T-abcdefgh"


def test_grok_matches_the_logs_by_order():
    def up(ts, kind, **u):
        return {"timestamp": ts, "params": {"update": {"sessionUpdate": kind} | u}}

    chat = jsonl(
        {"type": "system", "content": "s"}, {"type": "user", "content": "<user_info>\nWorkspace Path: /ws\n</user_info>"},
        {"type": "user", "content": [{"type": "text", "text": "<user_query>\none\n</user_query>"}]},
        {"type": "reasoning", "summary": [{"type": "summary_text", "text": "t"}], "encrypted_content": "E"},
        {"type": "assistant", "content": "", "tool_calls": [{"id": "k", "name": "Shell", "arguments": '{"command":"x","block_until_ms":120000.0}'}], "model_id": "g"},
        {"type": "tool_result", "tool_call_id": "k", "content": "fail"}, {"type": "assistant", "content": "ans"},
        {"type": "user", "content": "two", "prior_turn_interrupt": "x"}, {"type": "assistant", "content": "end"},
    )
    updates = jsonl(
        up(10, "user_message_chunk", content={"type": "text"}, _meta={"promptIndex": 0}), up(11, "user_message_chunk", content={"type": "image", "data": "QQ", "mimeType": "image/png"}, _meta={"promptIndex": 0}),
        up(12, "agent_thought_chunk"), up(13, "tool_call", toolCallId="k"), up(14, "tool_call_update", toolCallId="k", status="failed"), up(15, "agent_message_chunk"),
        up(16, "turn_completed", stop_reason="cancelled"), up(20, "user_message_chunk", content={"type": "text"}, _meta={"promptIndex": 1 << 60}), up(21, "agent_message_chunk"),
    )
    ((meta, m),) = load("grok", {"chat_history.jsonl": chat.encode(), "updates.jsonl": updates.encode()}, "/g/%2Fws/s9")
    assert (meta.id, meta.cwd, meta.model) == ("s9", "/ws", "g") and meta.timestamp == base.from_seconds(10)
    assert shape(m) == [("user", ["text", "image"]), ("assistant", ["thinking"]), ("assistant", ["tool_use"]), ("user", ["tool_result"]), ("assistant", ["text"]), ("user", ["text"]), ("assistant", ["text"])]
    assert [x["timestamp"].second for x in m] == [10, 12, 13, 14, 15, 20, 21]
    assert m[2]["content"][0]["input"] == {"command": "x", "timeout_ms": 120000} and m[3]["content"][0]["is_error"] and m[4]["stop_reason"] == "aborted" and m[6]["stop_reason"] is None
    assert grok.canonical_call("Glob", {"glob_pattern": "*", "path": "p"})[1] == {"pattern": "*", "path": "p"}


def test_claude_chat_follows_the_active_branch():
    def msg(id_, parent, sender, *content, **more):
        return {"uuid": id_, "parent_message_uuid": parent, "sender": sender, "content": list(content)} | more

    doc = {"uuid": "v", "summary": "S", "created_at": "2025-11-11T00:00:00Z", "model": {"id": "mm"}, "current_leaf_message_uuid": "c", "$x_files": {"f1": {"data": "QQ==", "file_name": "a.bin"}}, "$x_images": {"i1": {"type": "base64", "media_type": "image/png", "data": "QQ"}}, "chat_messages": [
        msg("a", None, "human", {"type": "text", "text": "q"}, text="q", files=[{"uuid": "i1"}, {"id": "i1"}]),
        msg("x", "a", "assistant", {"type": "text", "text": "other branch"}),
        msg("c", "a", "assistant", {"type": "tool_use", "id": "t", "name": "view", "input": {"path": "f", "description": "d", "view_range": [1, 4]}},
            {"type": "tool_result", "content": [{"type": "local_resource", "uuid": "f1"}]}, {"type": "text", "text": "end"}, stop_reason="length"),
    ]}
    ((meta, m),) = load("claude_chat", json.dumps(doc))
    assert (meta.id, meta.title, meta.model) == ("v", "S", "mm")
    assert shape(m) == [("user", ["text", "image"]), ("assistant", ["tool_use"]), ("user", ["tool_result"]), ("assistant", ["artifact", "text"])]
    assert m[1]["content"][0]["input"] == {"file_path": "f", "offset": 1, "limit": 4} and m[2]["content"][0]["id"] == "t"
    assert m[3]["model"] == "mm" and m[3]["stop_reason"] == "max_tokens" and m[1]["model"] is None
    for broken in ({"current_leaf_message_uuid": "gone"}, {"chat_messages": [dict(doc["chat_messages"][0], parent_message_uuid="c"), *doc["chat_messages"][1:]]}):
        assert "other branch" in json.dumps(load("claude_chat", json.dumps(doc | broken))[0][1], default=str)
    assert load("claude_chat", "[]") == []
    with pytest.raises(Unsupported):
        FORMATS["claude_chat"].from_common(sample())


def test_cowork_takes_the_header_over_the_transcript():
    header = {"sessionId": "local_1", "cliSessionId": "cli", "createdAt": 5000.5, "title": "T", "model": " "}
    inner = jsonl(entry("user", "u", "hi", cwd="/in"), entry("assistant", "a", "yo", message={"model": "m"}))
    files = {"record": json.dumps(header).encode(), ".claude/projects/-in/cli.jsonl": inner.encode(), "audit.jsonl": b"{}\n"}
    ((meta, m),) = load("cowork", files)
    assert (meta.id, meta.title, meta.cwd, meta.model, meta.timestamp) == ("local_1", "T", "/in", "m", base.from_ms(5000)) and len(m) == 2
    assert load("cowork", {"record": json.dumps(header).encode()})[0][1] == [] and load("cowork", {"record": b'{"title":"x"}'}) == []


def test_simple_pairs_first_in_first_out():
    doc = {"messages": [
        {"role": "Assistant ", "content": [{"type": "tool_use", "name": "A", "input": {}}, {"type": "tool_use", "name": "B", "id": "b"}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "b"}, {"type": "tool_result", "content": {"x": 1}}, {"type": "tool_result"}]},
        {"role": "user", "content": "late", "timestamp": "broken"}, {"role": "system", "content": "no"},
        {"role": "user", "content": "x", "timestamp": "2025-11-12T03:04:05Z", "stop_reason": {"other": "end_turn"}}, {"role": "user", "content": "y"},
    ]}
    ((meta, m),) = load("simple", json.dumps(doc))
    assert meta.id == "one" and meta.timestamp == T0 and len(m) == 4
    calls, results = m[0]["content"], m[1]["content"]
    assert [r["id"] for r in results[:2]] == ["b", calls[0]["id"]] and results[2]["id"] not in ("b", calls[0]["id"]) and results[1]["output"] == Json({"x": 1})
    assert m[2]["stop_reason"] == "other:end_turn" and m[3]["timestamp"] == m[2]["timestamp"] != T0


def test_cursor_reads_blobs_and_both_headers():
    rows = [{"role": "system", "content": "s"}, {"role": "user", "content": "<user_info>\nWorkspace Path: /ws"}, {"role": "user", "content": [{"type": "text", "text": "<user_query>\nhi [REDACTED]\n</user_query>"}], "createdAt": 5000},
            {"role": "assistant", "content": [{"type": "redacted-reasoning", "data": "E"}, {"type": "tool-call", "toolName": "StrReplace", "args": {"path": "f", "oldString": "a", "newString": "b"}, "providerOptions": {"cursor": {"modelName": "mm"}}}]},
            {"role": "tool", "content": [{"type": "tool-result", "toolCallId": "x", "result": "Error: no"}, {"type": "tool-result", "toolCallId": "y", "result": "ran, exited with code 1", "isError": False}]}]
    from threadloom.formats.cursor import database

    blobs = [(str(i), json.dumps(r).encode()) for i, r in enumerate(rows)] + [("z", b"\x0a\x02graph")]
    for value in (json.dumps({"name": "N", "createdAt": 7000}), json.dumps({"name": "N", "createdAt": 7000}).encode().hex()):
        db = database({"blobs": ("id TEXT PRIMARY KEY, data BLOB", blobs), "meta": ("key TEXT PRIMARY KEY, value TEXT", [("0", value)])})
        ((meta, m),) = load("cursor", {"store.db": db, "meta.json": b'{"title":""}'}, "/c/ws/s7")
        assert (meta.id, meta.title, meta.cwd, meta.model, meta.timestamp) == ("s7", "hi", "/ws", "mm", base.from_ms(7000))
    assert shape(m) == [("user", ["text"]), ("assistant", ["thinking", "tool_use"]), ("user", ["tool_result", "tool_result"])]
    assert m[1]["content"][1]["input"] == {"file_path": "f", "old_string": "a", "new_string": "b"} and [x["is_error"] for x in m[2]["content"]] == [True, False]


def test_cursor_desktop_orders_bubbles_and_drops_drafts():
    from threadloom.formats.cursor import database

    def bubble(i, kind, **more):
        return f"bubbleId:c1:{i}", json.dumps({"bubbleId": i, "type": kind} | more)

    call = {"name": "read_file_v2", "toolCallId": "a\nb", "params": '{"targetFile":"f","x":1}', "status": "completed", "result": '{"n":1}'}
    kv = [bubble("b3", 2, text="after"), bubble("b2", 2, text="t", toolFormerData=call), bubble("b1", 1, text="q"), ("bubbleId:c1:bad", "{"), ("composerData:c1", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": x} for x in ("b1", "b2", "b3", "b1")], "modelConfig": {"modelName": "default"}})), ("composerData:c2", "{}")]
    heads = [("c1", None, 5000, 6000, 0, 0, 1, None, '{"name":" ","subtitle":"S"}'), ("c2", None, 1, 1, 0, 0, 2, None, "{}")]
    from threadloom.formats.cursor_desktop import _HEAD

    for tables in ({"composerHeaders": (_HEAD, heads)}, {}):
        db = database(tables | {"cursorDiskKV": ("key TEXT PRIMARY KEY, value BLOB", kv)})
        ((meta, m),) = load("cursor_desktop", db)
        assert shape(m) == [("user", ["text"]), ("assistant", ["text", "tool_use"]), ("user", ["tool_result"]), ("assistant", ["text"])]
        assert m[1]["content"][1] == base.call("a_b", "Read", {"file_path": "f"}) and m[2]["content"][0] == base.result("a_b", Json({"n": 1}))
        assert (meta.id, meta.title, meta.model) == ("c1", "S" if tables else None, None)


def test_antigravity_reads_steps_and_broken_payloads():
    from threadloom.formats import antigravity as ag
    from threadloom.formats import protobuf as pb

    s = sample()
    s.messages[-1]["stop_reason"] = "other:stop-77"
    back = hop(s, "antigravity")
    assert back.meta.cwd == "/w/dir" and back.meta.git_branch == "main" and back.meta.title == "please fix it" and back.messages[-1]["stop_reason"] == "other:stop-77"
    data = pb.encode([(1, 300), (2, "text"), (3, b"\x08\x01")])
    assert pb.fields(data) == [(1, 300), (2, b"text"), (3, b"\x08\x01")]
    for cut in range(len(data)):
        assert pb.fields(data[:cut]) == pb.fields(data)[: len(pb.fields(data[:cut]))]
    assert ag.canonical_call("run_command", {"CommandLine": "x", "WaitMsBeforeAsync": 2000, "toolAction": "y"}) == ("Bash", {"command": "x"})
    assert ag.canonical_call("run_command", {"CommandLine": "x", "WaitMsBeforeAsync": 1})[0] == "run_command"
    assert ag.canonical_call("view_file", {"AbsolutePath": "f", "StartLine": 5, "EndLine": 2})[0] == "view_file"
    assert ag.canonical_call("view_file", {"AbsolutePath": "f", "EndLine": 2})[1] == {"file_path": "f", "limit": 2}


# Conversions


def said(messages):
    """What every writable format keeps."""
    out = []
    for m in messages:
        for b in m["content"]:
            if b["type"] == "text":
                out.append((m["role"], "text", b["text"]))
            elif b["type"] == "tool_use":
                out.append((m["role"], "call", b["name"].lower(), base.compact(b["input"])))
            elif b["type"] == "tool_result":
                out.append((m["role"], "result", base.output_text(b["output"])))
    return out


def hop(session, name):
    fmt = FORMATS[name]
    body = fmt.from_common(session)
    if hasattr(fmt, "unit_files"):
        files = {f["name"]: f["content"] for f in fmt.unit_files(session.meta, body)}
    elif name == "hermes":
        files = {"f": base.compact(body).encode()}
    else:
        files = {f["name"]: f["content"] for f in stores._as_unit(fmt, fmt.render(session.meta, body))}
    if name == "antigravity":
        files = {n: v for n, v in files.items() if n.endswith(".db")}
    ((meta, body2),) = fmt.sessions(Unit(f"/s/{session.meta.id}", files, session.meta.timestamp))
    return Session(meta, fmt.to_common(meta, body2))


WRITABLE = [n for n in FORMATS if n != "claude_chat"]


@pytest.mark.parametrize("name", WRITABLE)
def test_a_format_keeps_the_conversation(name):
    s = sample()
    back = hop(s, name)
    assert said(back.messages) == said(s.messages)
    assert back.meta.timestamp == s.meta.timestamp
    again = hop(back, name)
    assert said(again.messages) == said(back.messages) and again.meta == back.meta


def test_a_chain_of_hops_keeps_the_conversation():
    s = sample()
    for name in [*WRITABLE, "claude_code", *reversed(WRITABLE)]:
        s = hop(s, name)
    assert said(s.messages) == said(sample().messages)


BLOCKS = st.one_of(
    st.builds(base.text, st.text("abc \n", min_size=1, max_size=9).filter(str.strip).map(str.strip)),
    st.builds(lambda n, v: base.call(n, "Custom_x", {"v": v}), st.uuids().map(str), st.integers(0, 99)),
)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(BLOCKS, st.booleans()), max_size=5))
def test_generated_conversations_survive(units):
    s = Session(Meta("g1", T0), [base.message("user", [base.text("start")], T0)])
    for n, (block, failed) in enumerate(units):
        s.messages.append(base.message("assistant", [block], at(n + 1), "m", "end_turn"))
        if block["type"] == "tool_use":
            s.messages.append(base.message("user", [base.result(block["id"], "out", failed)], at(n + 1)))
    for name in WRITABLE:
        assert said(hop(s, name).messages) == said(s.messages), name


def test_formats_are_known_by_other_names():
    assert get(" Claude-Code ").name == "claude_code" and get("ampcode").name == "amp"
    with pytest.raises(Unsupported):
        get("nope")
