"""A database a session, whose steps are protocol buffers."""

from __future__ import annotations

from datetime import timedelta
from typing import Any

from . import base as b
from . import protobuf as pb
from .base import Format, Json, Meta, N, S, Session, Unit
from .cursor import database
from .opencode import open_db

SPACE = b.namespace("antigravity")
USER, PLANNER, CHECKPOINT, CODE, GREP, VIEW, LIST, RUN, MCP, GENERIC = 14, 15, 23, 5, 7, 8, 9, 21, 38, 132
QUIET = {CHECKPOINT, 98, 101, 90}  # summaries, context markers, notices
#: Where a step's own message stands.
BODY = {VIEW: 14, LIST: 15, USER: 19, PLANNER: 20, RUN: 28, CHECKPOINT: 30, MCP: 47, CODE: 10, GREP: 13, GENERIC: 140}
PENDING, DONE, CANCELED, ERROR = 1, 3, 6, 7
STOPS = {2: "end_turn", 3: "max_tokens", 10: "tool_use", 13: "error", 16: "aborted"}
NAMES = {"run_command": "Bash", "view_file": "Read", "write_to_file": "Write", "replace_file_content": "Edit"}
SHOWN = {"toolAction", "toolSummary"}
_ROW = ("idx", "step_type", "status", "has_subtrajectory", "metadata", "error_details", "permissions", "task_details", "render_info", "step_payload", "step_format")


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    """A known tool is renamed only if nothing but what is shown beside it would
    be lost."""
    if name not in NAMES or not isinstance(value, dict):
        return name, value
    rest = {k: v for k, v in value.items() if k not in SHOWN}
    out: dict[str, Any] = {}

    def take(key: str, new: str) -> None:
        out[new] = S(rest.pop(key, None))

    if name == "run_command":
        take("CommandLine", "command")
        take("Cwd", "workdir")
        if rest.get("WaitMsBeforeAsync") == 2000:
            del rest["WaitMsBeforeAsync"]
    elif name == "view_file":
        take("AbsolutePath", "file_path")
        start, end = N(rest.pop("StartLine", None)), N(rest.pop("EndLine", None))
        if start is not None and end is not None and end < start:
            return name, value
        out |= {"offset": start, "limit": end if start is None or end is None else end - start + 1}
    else:
        take("TargetFile", "file_path")
        for key in ("Description", "Instruction"):
            rest.pop(key, None)
        if name == "write_to_file":
            take("CodeContent", "content")
            rest.pop("Overwrite", None)
        else:
            take("TargetContent", "old_string")
            take("ReplacementContent", "new_string")
            out["replace_all"] = rest.pop("AllowMultiple", None) is True or None
            for key in ("StartLine", "EndLine"):
                rest.pop(key, None)
    out = {k: v for k, v in out.items() if v is not None}
    kind = NAMES[name]
    return (kind, out) if not rest and b.tool_kind(kind, out) == kind else (name, value)


def native_call(name: str, value: Any) -> tuple[str, Any]:
    kind = b.tool_kind(name, value)
    if kind == "Bash":
        return "run_command", {"CommandLine": value["command"], "WaitMsBeforeAsync": 2000} | ({"Cwd": value["workdir"]} if "workdir" in value else {})
    if kind == "Read":
        start, count = value.get("offset"), value.get("limit")
        last = None if count is None else count if start is None else start + max(0, count - 1)
        out = {"AbsolutePath": value["file_path"], "StartLine": start, "EndLine": last}
        return "view_file", {k: v for k, v in out.items() if v is not None}
    if kind == "Write":
        return "write_to_file", {"TargetFile": value["file_path"], "CodeContent": value["content"], "Overwrite": True}
    if kind == "Edit":
        out = {"TargetFile": value["file_path"], "TargetContent": value["old_string"], "ReplacementContent": value["new_string"]}
        return "replace_file_content", out | ({"AllowMultiple": True} if value.get("replace_all") else {})
    return name, value


def _time(raw: bytes | None):
    m = pb.fields(raw or b"")
    seconds, nanos = pb.number(m, 1), pb.number(m, 2) or 0
    try:
        return None if seconds is None else b.EPOCH + timedelta(seconds=seconds, microseconds=nanos // 1000)
    except OverflowError:
        return None


def _path(uri: str | None) -> str:
    return (uri or "").removeprefix("file://")


def _uri(path: str) -> str:
    return path if path.startswith("file://") else f"file://{path}"


def _full(text: str | None) -> str | None:
    return text if text and text.strip() else None


def result_of(kind: int, payload: pb.Fields) -> tuple[str | Json, bool]:
    """What a tool's step gave, and whether that says it failed."""
    m = pb.inner(payload, BODY[kind]) if kind in BODY else []
    if kind == VIEW:
        text = pb.string(m, 4)
        return (pb.string(m, 9) or "" if text is None else text), False
    if kind == RUN:
        text = pb.string(m, 21, 1)
        return (pb.string(m, 4) or "" if text is None else text), (pb.number(m, 6) or 0) != 0
    if kind == LIST:
        entries = []
        for raw in pb.subs(m, 3):
            e = pb.fields(raw)
            if pb.string(e, 1) is not None:
                size = pb.number(e, 4)
                entries.append({"name": pb.string(e, 1)} | ({"is_dir": True} if pb.number(e, 2) == 1 else {}) | ({} if size is None else {"size_bytes": size}))
        return Json({"path": _path(pb.string(m, 1)), "entries": entries}), False
    if kind == GREP:
        failed = _full(pb.string(m, 5))
        return (failed, True) if failed else (pb.string(m, 3) or "", False)
    if kind == CODE:
        spec = pb.inner(m, 1)
        places = (pb.string(m, 2, 1, 8), pb.string(spec, 2, 2, 5), pb.string(spec, 1, 4, 5))
        place = next((p for p in places if p is not None), None)
        return Json({"file": _path(place), "created" if pb.sub(spec, 2) is not None else "edited": True}), False
    if kind == MCP:
        return pb.string(m, 3) or "", False
    if kind == GENERIC:
        text = pb.string(m, 2, 1) or ""
        value = b.loads(text, None)
        return (Json(value) if isinstance(value, (dict, list)) else text), False
    return "", False


def to_messages(body: dict, fallback) -> list[dict]:
    out = []
    for step in sorted(body["steps"], key=lambda s: s["idx"]):
        payload, kind = pb.fields(step["step_payload"]), step["step_type"]
        about = pb.inner(payload, 5)
        ts = _time(pb.sub(about, 1)) or fallback
        if kind == USER:
            m = pb.inner(payload, 19)
            texts = (pb.string(m, 2), *(pb.string(pb.fields(x), 1) for x in pb.subs(m, 3)), pb.string(m, 1))
            said = next((t for t in texts if _full(t)), None)
            blocks = [b.text(said)] if said else []
            for x in map(pb.fields, pb.subs(m, 5)):
                if pb.string(x, 1) is not None:
                    blocks.append(b.image(pb.string(x, 2) or "image/png", pb.string(x, 1)))
            out += [b.message("user", blocks, ts)] if blocks else []
        elif kind == PLANNER:
            m = pb.inner(payload, 20)
            blocks = [b.thinking(pb.string(m, 3), pb.string(m, 4) or None)] if _full(pb.string(m, 3)) else []
            blocks += [b.text(pb.string(m, 1))] if _full(pb.string(m, 1)) else []
            for c in map(pb.fields, pb.subs(m, 7)):
                if pb.string(c, 1) is not None and pb.string(c, 2) is not None:
                    raw = pb.string(c, 3)
                    blocks.append(b.call(pb.string(c, 1), *canonical_call(pb.string(c, 2), b.loads(raw, {}) if raw is not None else {})))
            u, model, why = pb.inner(about, 9), pb.number(about, 11), pb.number(m, 12)
            given, made = pb.number(u, 2) or 0, pb.number(u, 3) or 0
            counts = b.usage(given, made, pb.number(u, 5) or None, pb.number(u, 4) or None) if given or made else None
            reason = None if why is None else STOPS.get(why, f"other:stop-{why}")
            if blocks:
                out.append(b.message("assistant", blocks, ts, None if model is None else f"model-{model}", reason, counts))
        elif kind not in QUIET and pb.string(about, 4, 1) is not None and step["status"] in (DONE, ERROR, CANCELED):
            told = pb.fields(step["error_details"])
            words = next((t for n in (9, 1, 2) if (t := pb.string(told, n)) is not None), None)
            value, failed = result_of(kind, payload)
            words = _full(words)
            failed = failed or step["status"] != DONE or words is not None
            out.append(b.message("user", [b.result(pb.string(about, 4, 1), value if words is None else words, failed)], ts))
    return out


def meta_of(body: dict, fallback) -> Meta:
    """The latest title and model; the first user's words where there is no title."""
    main = pb.fields(next((d for i, d in body["blobs"] if i == "main"), b""))
    place, steps = pb.inner(main, 1), sorted(body["steps"], key=lambda s: s["idx"])
    parsed = [(s["step_type"], pb.fields(s["step_payload"])) for s in steps]
    times = (t for _, p in parsed if (t := _time(pb.sub(p, 5, 1))))
    titles = (t for k, p in reversed(parsed) if k == CHECKPOINT and (t := _full(pb.string(p, 30, 10)) or _full(pb.string(p, 30, 4))))
    firsts = (b.truncate(t) for k, p in parsed if k == USER and (t := _full(pb.string(p, 19, 2))))
    models = (n for k, p in reversed(parsed) if k == PLANNER and (n := pb.number(pb.inner(p, 5), 11)) is not None)
    cwd, model = pb.string(place, 1) if pb.string(place, 1) is not None else pb.string(main, 7), next(models, None)
    return Meta(
        (body["ids"][0][1] if body["ids"] else "") or pb.string(main, 6) or "", _time(pb.sub(main, 2)) or next(times, None) or fallback,
        _path(cwd) or None, pb.string(place, 4) or None, next(titles, None) or next(firsts, None), None, None if model is None else f"model-{model}",
    )


def _stamp(ts) -> bytes:
    us = (ts - b.EPOCH) // timedelta(microseconds=1)
    return pb.encode([(1, us // 1_000_000 or None), (2, us % 1_000_000 * 1000 or None)])


def _number(model: str | None) -> int | None:
    tail = (model or "").removeprefix("model-")
    return int(tail) if model and model.startswith("model-") and tail.isdigit() else None


def _step(kind: int, answer: dict | None, x: dict) -> tuple[int, bytes, int]:
    """(type, body, status) of the step that holds a call's result: of its own
    kind if that can hold it, else a generic one with the text."""
    text = None if answer is None else b.output_text(answer["output"])
    state, failed = (PENDING if answer is None else DONE), bool(answer and answer["is_error"])
    if kind == "Bash":
        value = x["input"]
        out = None if text is None else pb.encode([(1, text)])
        parts = [(2, value.get("workdir")), (6, None if answer is None else int(failed)), (11, 1), (12, 2000), (21, out), (23, value["command"]), (25, value["command"])]
        return RUN, pb.encode(parts), state
    if kind == "Read" and not failed:
        value = x["input"]
        start, last = value.get("offset"), native_call("Read", value)[1].get("EndLine")
        sizes = [] if text is None else [(11, len(text.splitlines())), (12, len(text.encode()))]
        return VIEW, pb.encode([(1, _uri(value["file_path"])), (2, start), (3, last), (4, text), *sizes]), state
    if kind in ("Write", "Edit"):
        word, value = ("created" if kind == "Write" else "edited"), x["input"]
        known = Json({"file": _path(value["file_path"]), word: True})
        if answer is None or not failed and answer["output"] == known:
            uri = _uri(value["file_path"])
            where = pb.encode([(5, uri)])
            if kind == "Write":
                spec = pb.encode([(2, pb.encode([(1, value["content"]), (2, where), (4, 1)]))])
                done = pb.encode([(8, uri), (11, 1)])
            else:
                chunk = pb.encode([(1, value["old_string"]), (2, value["new_string"]), (3, 1 if value.get("replace_all") else None)])
                spec = pb.encode([(1, pb.encode([(2, 1), (4, where), (8, 1), (9, chunk)]))])
                done = pb.encode([(8, uri), (10, value["old_string"])])
            return CODE, pb.encode([(1, spec), (2, None if answer is None else pb.encode([(1, done)])), (4, 1)]), state
    return GENERIC, b"" if text is None else pb.encode([(2, pb.encode([(1, text)]))]), ERROR if failed else state


def to_body(session: Session) -> dict:
    meta = session.meta
    sid = meta.id or b.made_id(SPACE, b.iso(meta.timestamp))
    path_id, steps, turn = b.made_id(SPACE, sid, "trajectory"), [], 0
    blocks = [(m, x) for m in session.messages for x in m["content"]]
    answers = {x["id"]: x | {"at": m["timestamp"]} for m, x in blocks if x["type"] == "tool_result"}
    called = {x["id"] for _, x in blocks if x["type"] == "tool_use"}

    def add(kind: int, data: bytes, ts, source: int, status: int = DONE, call: bytes | None = None, m: dict | None = None) -> None:
        model, u = _number(m and m["model"]), m and m["usage"]
        counts = u and pb.encode([(1, model), (2, u["input_tokens"]), (3, u["output_tokens"]), (4, u["cache_creation_input_tokens"]), (5, u["cache_read_input_tokens"])])
        place = pb.encode([(1, path_id), (2, len(steps) or None), (3, turn - 1 if turn else None), (4, sid)])
        about = pb.encode([(1, _stamp(ts)), (3, source), (4, call), (9, counts), (11, model), (12, b.made_id(SPACE, sid, turn, "run")), (20, place), (21, 1)])
        payload = pb.encode([(1, kind), (4, status), (5, about), (BODY[kind], data)])
        row = dict.fromkeys(_ROW, b"") | {"idx": len(steps), "step_type": kind, "status": status, "has_subtrajectory": 0, "step_format": 0}
        steps.append(row | {"metadata": about, "step_payload": payload})

    for m in session.messages:
        texts = [x["text"].strip() for x in m["content"] if x["type"] == "text" and x["text"].strip()]
        texts += [b.artifact_text(x) for x in m["content"] if x["type"] == "artifact"]
        if m["role"] == "user":
            texts += [x["text"].strip() for x in m["content"] if x["type"] == "thinking" and x["text"].strip()]
            lost = [x for x in m["content"] if x["type"] == "tool_result" and x["id"] not in called]
            texts += [f"Tool {'error' if x['is_error'] else 'result'} for {x['id']}:\n{b.output_text(x['output'])}" for x in lost]
            said = "\n\n".join(texts)
            pictures = [(5, pb.encode([(1, x["data"]), (2, x["media_type"])])) for x in m["content"] if x["type"] == "image"]
            if said or pictures:
                turn += 1
                add(USER, pb.encode([(2, said), (3, pb.encode([(1, said)]) if said else None), *pictures]), m["timestamp"], 4)
            continue
        said = "\n\n".join(texts + [f"[image: {x['media_type']}]" for x in m["content"] if x["type"] == "image"])
        thought = next((x for x in m["content"] if x["type"] == "thinking" and x["text"].strip()), None)
        uses = [x for x in m["content"] if x["type"] == "tool_use"]
        calls = []
        for x in uses:
            name, value = native_call(x["name"], x["input"])
            calls.append(pb.encode([(1, x["id"]), (2, name), (3, b.compact(value)), (9, name)]))
        why = {v: k for k, v in STOPS.items()} | {"stop_sequence": 2}
        other = (m["stop_reason"] or "").removeprefix("other:stop-")
        reason = why.get(m["stop_reason"], int(other) if other.isdigit() else None)
        parts = [(1, said), (3, thought and thought["text"]), (4, thought and thought["signature"]), (6, f"bot-{b.made_id(SPACE, sid, len(steps), 'msg')}")]
        add(PLANNER, pb.encode([*parts, *[(7, c) for c in calls], (8, said), (12, reason)]), m["timestamp"], 2, m=m)
        for x, c in zip(uses, calls):
            answer = answers.get(x["id"])
            kind, data, status = _step(b.tool_kind(x["name"], x["input"]), answer, x)
            add(kind, data, answer["at"] if answer else m["timestamp"], 2, status, c)
    place = pb.encode([(1, _uri(meta.cwd) if meta.cwd else None), (4, meta.git_branch)])
    main = pb.encode([(1, place or None), (2, _stamp(meta.timestamp)), (6, sid), (7, _uri(meta.cwd) if meta.cwd else None)])
    log = [{"step": s["idx"], "type": s["step_type"], "status": s["status"]} for s in steps]
    return {"ids": [(path_id, sid, 4, 17)], "steps": steps, "blobs": [("main", main)], "log": log, "indexed": {}}


_INDEXED = ("gen_metadata", "executor_metadata", "parent_references", "battle_mode_infos")


class Antigravity(Format):
    name = "antigravity"
    glob = "*.db"
    names = NAMES

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        con = open_db(next(iter(unit.files.values())))
        ids = con.execute("SELECT trajectory_id, cascade_id, trajectory_type, source FROM trajectory_meta ORDER BY trajectory_id").fetchall()
        steps = []
        for row in con.execute(f"SELECT {', '.join(_ROW)} FROM steps ORDER BY idx"):
            step = dict(zip(_ROW, row))
            steps.append(step | {k: step[k] or b"" for k in _ROW[4:10]} | {k: step[k] or 0 for k in ("has_subtrajectory", "step_format")})
        blobs = [(i, d or b"") for i, d in con.execute("SELECT id, data FROM trajectory_metadata_blob ORDER BY id")]
        indexed = {t: con.execute(f"SELECT * FROM {t} ORDER BY idx").fetchall() for t in _INDEXED}
        body = {"ids": ids, "steps": steps, "blobs": blobs, "log": [], "indexed": indexed}
        meta = meta_of(body, unit.mtime)
        meta.id = meta.id or unit.stem
        return [(meta, body)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_body(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        kinds = ["INTEGER PRIMARY KEY", *["INTEGER"] * 3, *["BLOB"] * 6, "INTEGER"]
        columns = ", ".join(f"{n} {k}" for n, k in zip(_ROW, kinds))
        rows = [tuple(s[k] for k in _ROW) for s in body["steps"]]
        tables = {
            "trajectory_meta": ("trajectory_id TEXT PRIMARY KEY, cascade_id TEXT, trajectory_type INTEGER, source INTEGER", body["ids"]),
            "steps": (columns, rows), "trajectory_metadata_blob": ("id TEXT PRIMARY KEY, data BLOB", body["blobs"]),
        }
        for t in _INDEXED:
            tables[t] = ("idx INTEGER PRIMARY KEY, data BLOB" + (", size INTEGER" if t == "gen_metadata" else ""), body["indexed"].get(t, []))
        id_ = b.safe_id(self.name, body["ids"][0][1] if body["ids"] else meta.id)
        logs = b.lines_text(body["log"])
        place = f"brain/{id_}/.system_generated/logs"
        return {f"conversations/{id_}.db": database(tables), f"{place}/transcript.jsonl": logs, f"{place}/transcript_full.jsonl": logs}
