"""The export document, and the database that it comes from."""

from __future__ import annotations

import sqlite3
import uuid
from typing import Any

from . import base as b
from .base import Format, I, Json, Meta, N, S, Session, Unit
from .opencode import open_db

STOPS = {
    "stop": "end_turn", "end_turn": "end_turn", "tool_calls": "tool_use", "tool_use": "tool_use", "length": "max_tokens",
    "max_tokens": "max_tokens", "stop_sequence": "stop_sequence", "aborted": "aborted", "cancelled": "aborted", "error": "error",
}
WORDS = {"max_tokens": "length", "stop_sequence": "stop_sequence", "aborted": "aborted", "error": "error", "tool_use": "tool_calls"}


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    if not isinstance(value, dict):
        return name, value
    if name in ("read_file", "write_file"):
        return ("Read" if name == "read_file" else "Write"), b.rename(value, {"path": "file_path"})
    if name == "patch" and value.get("mode") == "replace":
        return "Edit", b.rename({k: v for k, v in value.items() if k != "mode"}, {"path": "file_path"})
    if name == "terminal":
        value = b.rename(value, {"background": "run_in_background"})
        if N(value, "timeout") is not None:
            value["timeout_ms"] = min(value.pop("timeout") * 1000, (1 << 64) - 1)
        return "Bash", value
    return name, value


def native_call(name: str, value: Any) -> tuple[str, Any]:
    kind = b.tool_kind(name, value)
    if kind in ("Read", "Write", "Edit"):
        value = b.rename(value, {"file_path": "path"}) | ({"mode": "replace"} if kind == "Edit" else {})
        return {"Read": "read_file", "Write": "write_file", "Edit": "patch"}[kind], value
    if kind == "Bash":
        value = b.rename(value, {"run_in_background": "background"})
        if "timeout_ms" in value:
            value["timeout"] = value.pop("timeout_ms") // 1000
        return "terminal", value
    return name, value


def _shown(value: Any) -> str:
    return value if isinstance(value, str) else b.compact(value)


def part_block(part: Any) -> dict:
    """A part of an unknown kind is its JSON as text."""
    if S(part, "type") == "text" and S(part, "text") is not None:
        return b.text(part["text"])
    if S(part, "type") == "image_url" and (found := b.data_url(S(part, "image_url", "url"))):
        return found
    return b.text(_shown(part))


def content_blocks(value: Any) -> list[dict]:
    if value is None or isinstance(value, str):
        return [b.text(value)] if value and value.strip() else []
    parts = value if isinstance(value, list) else [value]
    return [part_block(p) for p in parts if S(p, "type") != "text" or S(p, "text") is not None]


def call_blocks(value: Any) -> list[dict]:
    value = b.loads(value, None) if isinstance(value, str) else value
    out = []
    for c in value if isinstance(value, list) else []:
        f = b.at(c, "function")
        if S(f, "name") is not None:
            raw = f.get("arguments", {})
            raw = b.loads(raw, raw) if isinstance(raw, str) else raw
            key = c["id"] if "id" in c else c.get("call_id")
            out.append(b.call(key if isinstance(key, str) else "", *canonical_call(f["name"], raw)))
    return out


def tool_output(row: dict) -> tuple[str | Json, bool]:
    value = row.get("content", "")
    if isinstance(value, str):
        found = b.loads(value, None)
        value = Json(found) if isinstance(found, (dict, list)) else value
    else:
        value = Json(value)
    v = value.value if isinstance(value, Json) else None
    failed = b.B(v, "success") is False or (I(v, "exit_code") or 0) != 0 or b.at(v, "error") is not None
    return value, failed or row.get("effect_disposition") == "denied"


def meta_of(body: Any, fallback) -> Meta:
    values = [S(body, k) or None for k in ("cwd", "git_branch", "title", "cli_version", "model")]
    return Meta(S(body, "id") or "", b.from_seconds(b.at(body, "started_at")) or b.EPOCH, *values)


def to_messages(body: Any, meta: Meta) -> list[dict]:
    out = []
    for row in b.L(body, "messages"):
        role, ts = S(row, "role"), b.from_seconds(b.at(row, "timestamp")) or meta.timestamp
        if b.at(row, "active") == 0:
            continue
        if role == "user" and (blocks := content_blocks(row.get("content"))):
            out.append(b.message(role, blocks, ts))
        elif role == "tool" and S(row, "tool_call_id") is not None:
            out.append(b.message("user", [b.result(row["tool_call_id"], *tool_output(row))], ts))
        elif role == "assistant":
            said = next((t for k in ("reasoning_content", "reasoning") if row.get(k) is not None and (t := _shown(row[k]))), None)
            said = said if said and said.strip() else None
            sealed = next((_shown(row[k]) for k in ("codex_reasoning_items", "reasoning_details") if row.get(k) is not None), None)
            blocks = [b.thinking(said or "", None, sealed)] if said is not None or sealed is not None else []
            blocks += content_blocks(row.get("content")) + call_blocks(row.get("tool_calls"))
            if blocks:
                out.append(b.message(role, blocks, ts, meta.model, b.stop(S(row, "finish_reason"), STOPS)))
    return out


def _content(blocks: list[dict]) -> Any:
    if any(x["type"] == "image" for x in blocks):
        parts = []
        for x in blocks:
            if x["type"] == "text":
                parts.append({"type": "text", "text": x["text"]})
            elif x["type"] == "image":
                parts.append({"type": "image_url", "image_url": {"url": f"data:{x['media_type']};base64,{x['data']}"}})
        return parts
    return "\n".join(x["text"] for x in blocks if x["type"] == "text") or None


def to_export(session: Session) -> dict:
    meta = session.meta
    sid = meta.id or f"{meta.timestamp:%Y%m%d_%H%M%S}_{b.made_id(b.namespace('hermes'), b.iso(meta.timestamp)).replace('-', '')}"
    rows: list[dict] = []

    def add(role: str, content: Any, ts, **more: Any) -> None:
        seconds = (ts - b.EPOCH).total_seconds()
        base = {"id": len(rows) + 1, "session_id": sid, "role": role, "content": content, "timestamp": seconds}
        rows.append(base | {"observed": 0, "active": 1, "compacted": 0} | more)

    for m in session.messages:
        blocks, ts = m["content"], m["timestamp"]
        if m["role"] == "user":
            for x in blocks:
                if x["type"] == "tool_result":
                    out, verdict = x["output"], "denied" if x["is_error"] else "allowed"
                    add("tool", out.value if isinstance(out, Json) else out, ts, tool_call_id=x["id"], effect_disposition=verdict)
            if (said := _content(blocks)) is not None:
                add("user", said, ts)
            continue
        more: dict = {}
        if thoughts := [x for x in blocks if x["type"] == "thinking"]:
            more["reasoning_content"] = "\n".join(x["text"] for x in thoughts)
            sealed = next((x["encrypted"] for x in thoughts if x["encrypted"] is not None), None)
            more |= {} if sealed is None else {"codex_reasoning_items": sealed}
        calls = []
        for x in blocks:
            if x["type"] == "tool_use":
                name, value = native_call(x["name"], x["input"])
                calls.append({"id": x["id"], "call_id": x["id"], "type": "function", "function": {"name": name, "arguments": b.compact(value)}})
        more |= {"tool_calls": calls} if calls else {}
        add("assistant", _content(blocks), ts, **more, finish_reason=b.stop_word(m["stop_reason"], WORDS, "tool_calls" if calls else "stop"))
    head = {"id": sid, "source": "threadloom", "model": meta.model, "started_at": (meta.timestamp - b.EPOCH).total_seconds()}
    head |= {"cwd": meta.cwd, "git_branch": meta.git_branch, "title": meta.title, "message_count": len(rows)}
    return head | {"tool_call_count": sum(len(r.get("tool_calls", [])) for r in rows), "messages": rows}


def stable_hash(value: Any) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, b.compact(value)).hex


def _value(x: Any) -> Any:
    return {"$blob_hex": x.hex()} if isinstance(x, bytes) else x


def _rows(con: sqlite3.Connection, sql: str, *args: Any) -> list[dict]:
    """Rows with whatever columns a version of the store has."""
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    found = con.execute(sql, args)
    names = [c[0] for c in found.description]
    return [dict(zip(names, map(_value, r))) for r in found]


def stored_row(row: dict) -> dict:
    """What the store packs into text: structured content and calls."""
    row = dict(row)
    text = row.get("content")
    if isinstance(text, str) and text.startswith("\0json:"):
        row["content"] = b.loads(text[6:], text)
    if isinstance(row.get("tool_calls"), str) and row["tool_calls"]:
        row["tool_calls"] = b.loads(row["tool_calls"], [])
    return row


class Hermes(Format):
    name = "hermes"
    glob = "*.{db,json}"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        data = next(iter(unit.files.values()))
        if not data.startswith(b"SQLite format 3\0"):
            body = b.loads(data, None)
            meta = meta_of(body, unit.mtime)
            return [(b.with_meta(meta, id=meta.id or unit.stem), body)] if isinstance(body, dict) else []
        con, out = open_db(data), []
        messages: dict[str, list] = {}
        for row in _rows(con, "SELECT * FROM messages WHERE active = 1 ORDER BY id"):
            messages.setdefault(row.get("session_id"), []).append(stored_row(row))
        for head in _rows(con, "SELECT * FROM sessions"):
            body = head | {"messages": messages.get(head.get("id"), [])}
            meta = meta_of(body, unit.mtime)
            if meta.id and head.get("archived") != 1:
                out.append((meta, body))
        return out

    def cursors(self, unit: Unit) -> dict[str, str]:
        """Session -> hash of all it holds."""
        return {meta.id: stable_hash(body) for meta, body in self.sessions(unit)}

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta)

    def from_common(self, session: Session) -> Any:
        return to_export(session)

    def unit_files(self, meta: Meta, body: Any) -> list[dict]:
        """The export document; the store itself is never written."""
        return [{"name": f"{meta.id or 'session'}.json", "content": b.compact(body).encode()}]
