"""The export document, and the database that it comes from."""

from __future__ import annotations

import sqlite3
from datetime import datetime
from typing import Any

from . import base as b
from .base import Format, I, Meta, S, Session, Unit

SPACE = b.namespace("opencode")
STOPS = {"stop": "end_turn", "length": "max_tokens", "tool_use": "tool_use", "tool-calls": "tool_use", "tool_calls": "tool_use", "error": "error"}
WORDS = {"max_tokens": "length", "tool_use": "tool_use", "error": "error"}
NAMES = {
    "bash": "Bash", "edit": "Edit", "write": "Write", "read": "Read", "glob": "Glob", "grep": "Grep", "list": "LS",
    "todowrite": "TodoWrite", "todoread": "TodoRead", "webfetch": "WebFetch", "task": "Task", "question": "Question",
}
_PATH = {"filePath": "file_path"}
KEYS = {"Read": _PATH, "Write": _PATH, "Edit": _PATH | {"oldString": "old_string", "newString": "new_string", "replaceAll": "replace_all"}}
PLACEHOLDER = "New session - "


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    name = NAMES.get(name) or b.title_case(name)
    return name, b.rename(value, KEYS.get(name, {}))


def native_call(name: str, value: Any) -> tuple[str, Any]:
    return b.inverse(NAMES).get(name) or name.lower(), b.rename(value, b.inverse(KEYS.get(name, {})))


def meta_of(info: Any, fallback: datetime) -> Meta:
    title = S(info, "title")
    title = title if title and title.strip() and not title.startswith(PLACEHOLDER) else None
    at = b.from_ms(I(info, "time", "created")) or fallback
    return Meta(S(info, "id") or "", at, S(info, "directory") or None, None, title, S(info, "version") or None, S(info, "model", "id") or None)


def _image(part: Any) -> dict | None:
    mime, (head, comma, data) = S(part, "mime") or "", (S(part, "url") or "").partition(",")
    return b.image(mime, data) if mime.startswith("image/") and comma and head.startswith("data:") else None


def _said(part: Any) -> str | None:
    found = S(part, "text")
    return found if found and found.strip() else None


def parse_tokens(v: Any) -> dict | None:
    """A cache count of 0 is none; no count at all is no usage."""
    given, made = b.N(v, "input") or 0, b.N(v, "output") or 0
    read, written = b.N(v, "cache", "read") or None, b.N(v, "cache", "write") or None
    return b.usage(given, made, read, written) if given or made or read or written else None


def tool_part(part: Any) -> list[tuple[str, dict]]:
    """The call, and its result once it has ended."""
    name, id_, state = S(part, "tool"), S(part, "callID") or "", b.at(part, "state")
    if name is None:
        return []
    raw = state.get("input", {}) if isinstance(state, dict) else {}
    out = [("assistant", b.call(id_, *canonical_call(name, raw)))]
    if S(state, "status") == "completed":
        out.append(("user", b.result(id_, b.as_output(state.get("output", "")))))
    elif S(state, "status") == "error":
        failed = S(state, "error")
        out.append(("user", b.result(id_, "Tool call failed" if failed is None else failed, True)))
    return out


def to_messages(body: Any, fallback: datetime) -> list[dict]:
    out: list[dict] = []
    for record in b.L(body, "messages"):
        info, parts = b.at(record, "info"), b.L(record, "parts")
        ts, role, model = b.from_ms(I(info, "time", "created")) or fallback, S(info, "role"), S(info, "modelID")
        mine: list[dict] = []
        pending: list[dict] = []

        def flush() -> None:
            if pending:
                mine.append(b.message(role, list(pending), ts, model if role == "assistant" else None))
                out.append(mine[-1])
                pending.clear()

        for part in parts if role in ("user", "assistant") else []:
            kind = S(part, "type")
            if kind == "text" and _said(part) and not b.B(part, "synthetic"):
                pending.append(b.text(part["text"]))
            elif kind == "file" and (found := _image(part)):
                pending.append(found)
            elif kind == "reasoning" and _said(part) and role == "assistant":
                pending.append(b.thinking(part["text"]))
            elif kind == "tool" and role == "assistant":
                flush()
                for who, block in tool_part(part):
                    out.append(b.message(who, [block], ts, model if who == "assistant" else None))
                    mine += [out[-1]] if who == "assistant" else []
        flush()
        if mine and role == "assistant":  # counts and reason are those of the whole turn
            mine[-1]["usage"], mine[-1]["stop_reason"] = parse_tokens(b.at(info, "tokens")), b.stop(S(info, "finish"), STOPS)
    return out


def to_export(session: Session) -> dict:
    meta, messages = session.meta, session.messages
    sid = meta.id if meta.id.startswith("ses") else "ses_" + (meta.id.replace("-", "") or b.made_id(SPACE, b.iso(meta.timestamp)).replace("-", ""))

    def hexed(i: int, j: int) -> str:
        return b.made_id(SPACE, sid, i, j).replace("-", "")

    out: list[dict] = []
    prompt, i = None, 0
    while i < len(messages):
        m, at, begin = messages[i], b.ms(messages[i]["timestamp"]), i
        mid, span, mine = f"msg_{hexed(i, 0)}", {"start": at, "end": at}, m["role"] == "assistant"
        model = m["model"] or meta.model or "unknown"
        parts: list[dict] = [{"type": "step-start", "id": f"prt_{hexed(i, 0)}"}] if mine else []
        for j, x in enumerate(m["content"]):
            kind, part = x["type"], None
            if kind in ("text", "artifact"):
                part = {"type": "text", "text": x["text"] if kind == "text" else b.artifact_text(x), "time": span}
            elif kind == "image":
                part = {"type": "file", "mime": x["media_type"], "url": b.image_url(x)} | ({"time": span} if mine else {})
            elif kind == "thinking" and mine:
                part = {"type": "reasoning", "text": x["text"], "time": span}
            elif kind == "tool_use" and mine:
                name, value = native_call(x["name"], x["input"])
                state = {"status": "completed", "input": value, "output": "", "title": name, "metadata": {}, "time": span}
                follows = messages[i + 1]["content"] if i + 1 < len(messages) and messages[i + 1]["role"] == "user" else []
                if len(follows) == 1 and follows[0]["type"] == "tool_result" and follows[0]["id"] == x["id"]:
                    said = b.output_text(follows[0]["output"])
                    state["output"] = said
                    if follows[0]["is_error"]:
                        state |= {"status": "error", "error": said}
                        del state["output"]
                    i += 1
                part = {"type": "tool", "tool": name, "callID": x["id"], "state": state}
            elif kind == "tool_result" and mine:
                part = {"type": "text", "text": b.output_text(x["output"]), "time": span}
            if part:
                parts.append(part | {"id": f"prt_{hexed(begin, j + (2 if mine else 1))}"})
        info: dict = {"id": mid, "sessionID": sid, "role": m["role"], "agent": "build", "time": {"created": at, "completed": at}}
        if mine:
            u = m["usage"] or b.usage(0, 0)
            cache = {"read": u["cache_read_input_tokens"] or 0, "write": u["cache_creation_input_tokens"] or 0}
            info |= {
                "modelID": model, "providerID": "anthropic", "mode": "build", "parentID": prompt or mid, "cost": 0.0,
                "path": {"cwd": meta.cwd or "", "root": meta.cwd or ""}, "finish": b.stop_word(m["stop_reason"], WORDS, "stop"),
                "tokens": {"input": u["input_tokens"], "output": u["output_tokens"], "reasoning": 0, "cache": cache},
            }
        else:
            prompt = mid
            info["model"] = {"providerID": "anthropic", "modelID": model}
        out.append({"info": info, "parts": [p | {"sessionID": sid, "messageID": mid} for p in parts]})
        i += 1
    at = b.ms(meta.timestamp)
    head = {
        "id": sid, "slug": f"threadloom-{hexed(0, 0)[:8]}", "directory": meta.cwd or "", "title": meta.title or "",
        "version": meta.cli_version or "", "time": {"created": at, "updated": at}, "model": {"id": meta.model or "", "providerID": "anthropic"},
    }
    return {"info": head, "messages": out}


def open_db(data: bytes) -> sqlite3.Connection:
    """A database from its bytes; nothing is written to a disk."""
    con = sqlite3.connect(":memory:")
    if data[18:20] == b"\x02\x02":  # write-ahead mode needs files beside it
        data = data[:18] + b"\x01\x01" + data[20:]
    con.deserialize(data)
    return con


def model_id(text: str | None) -> str | None:
    return S(b.loads(text, None) if text else None, "id") or None


class OpenCode(Format):
    name = "opencode"
    glob = "*.{db,json}"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        data = next(iter(unit.files.values()))
        if data.startswith(b"SQLite format 3\0"):
            return self._database(open_db(data), unit)
        body = b.loads(data, None)
        if not isinstance(b.at(body, "messages"), list) or "info" not in body:
            return []
        meta = meta_of(body["info"], unit.mtime)
        meta.id = meta.id or unit.stem
        return [(meta, body)]

    def _database(self, con: sqlite3.Connection, unit: Unit) -> list[tuple[Meta, Any]]:
        """Sessions that aren't archived, newest first."""
        heads = con.execute(
            "SELECT id, directory, title, version, time_created, model, slug, time_updated FROM session"
            " WHERE time_archived IS NULL ORDER BY time_created DESC"
        ).fetchall()
        parts: dict[str, list] = {}
        for mid, data in con.execute("SELECT message_id, data FROM part ORDER BY message_id, id"):
            value = b.loads(data, parts)
            if value is not parts:
                parts.setdefault(mid, []).append(value)
        records: dict[str, list] = {}
        for sid, mid, data, created in con.execute("SELECT session_id, id, data, time_created FROM message ORDER BY time_created, id"):
            info = b.loads(data, None)
            if isinstance(info, dict):
                info.setdefault("time", {"created": created, "completed": created})
            records.setdefault(sid, []).append({"info": info, "parts": parts.get(mid, [])})
        out = []
        for sid, folder, title, version, created, model, slug, updated in heads:
            info = {
                "id": sid, "slug": slug or "", "directory": folder or "", "title": title or "", "version": version or "",
                "time": {"created": created or 0, "updated": updated or created or 0},
            }
            meta = meta_of(info, unit.mtime)
            meta.model, meta.timestamp = model_id(model), b.from_ms(created) or unit.mtime
            out.append((meta, {"info": info, "messages": records.get(sid, [])}))
        return out

    def cursors(self, unit: Unit) -> dict[str, str]:
        """Session -> time of its latest message."""
        con = open_db(next(iter(unit.files.values())))
        latest = dict(con.execute("SELECT session_id, max(time_created) FROM message GROUP BY session_id"))
        return {sid: str(latest.get(sid) or 0) for (sid,) in con.execute("SELECT id FROM session")}

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_export(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        return {f"{b.safe_id(self.name, body['info']['id'])}.json": b.compact(body).encode()}
