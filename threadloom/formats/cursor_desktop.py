"""The editor's key-value database: a header and a document for each session, and
a bubble for each piece of what was said."""

from __future__ import annotations

import re
import sqlite3
from typing import Any

from . import base as b
from .base import Format, I, Json, Meta, N, S, Session, Unit
from .cursor import database
from .opencode import open_db

SPACE = b.namespace("cursor_desktop")
NAMES = {"run_terminal_command_v2": "Bash", "read_file_v2": "Read"}
NUMBERS = {"run_terminal_command_v2": 15, "read_file_v2": 40, "ripgrep_raw_search": 41, "glob_file_search": 42, "ask_question": 51}
_HEAD = "composerId TEXT PRIMARY KEY, workspaceId TEXT, createdAt INTEGER, lastUpdatedAt INTEGER, isArchived INTEGER, isSubagent INTEGER, recency INTEGER, checkpointAt INTEGER, value TEXT"


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    """Of the two tools that are known only what the common ones have is kept."""
    if name == "run_terminal_command_v2":
        limit = N(value, "options", "timeout")
        out = {"command": b.at(value, "command"), "workdir": S(value, "cwd") or None, "timeout_ms": limit}
        return "Bash", {k: v for k, v in out.items() if v is not None}
    if name == "read_file_v2":
        out = {"file_path": b.at(value, "targetFile"), "offset": N(value, "offset"), "limit": N(value, "limit")}
        return "Read", {k: v for k, v in out.items() if v is not None}
    return name, value


def native_call(name: str, value: Any) -> tuple[str, Any]:
    kind = b.tool_kind(name, value)
    if kind == "Bash":
        more = {"options": {"timeout": value["timeout_ms"]}} if "timeout_ms" in value else {}
        return "run_terminal_command_v2", {"command": value["command"], "cwd": value.get("workdir", "")} | more
    if kind == "Read":
        return "read_file_v2", b.rename(value, {"file_path": "targetFile"})
    return name, value


def call_id(raw: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", raw)


def ordered(body: dict) -> list[dict]:
    """Bubbles in the order that the document gives, else that of the database;
    each at most once."""
    found: dict[str, dict] = {}
    natural = []
    for key, raw in body["bubbles"]:
        v = b.loads(raw, None) if raw is not None else None
        if v is not None:
            id_ = S(v, "bubbleId")
            natural.append(key if id_ is None else id_)
            found[natural[-1]] = v
    doc = b.loads(body["composer_data"], None) if body["composer_data"] else None
    given = [h["bubbleId"] for h in b.L(doc, "fullConversationHeadersOnly") if S(h, "bubbleId") is not None]
    return [found.pop(i) for i in given or natural if i in found]


def _model(name: str | None) -> str | None:
    return name if name and name != "default" else None


def to_messages(body: dict, meta: Meta) -> list[dict]:
    """Bubbles of the assistant's are one message until the user speaks or a tool
    is called."""
    out: list[dict] = []
    held: dict | None = None

    def flush() -> None:
        nonlocal held
        if held and held["content"]:
            out.append(held)
        held = None

    for v in ordered(body):
        ts, kind, text = b.when(S(v, "createdAt")) or meta.timestamp, N(v, "type"), S(v, "text") or ""
        if kind == 1:
            flush()
            if text.strip():
                out.append(b.message("user", [b.text(text)], ts))
        elif kind == 2:
            held = held or b.message("assistant", [], ts)
            held["model"] = _model(S(v, "modelInfo", "modelName")) or held["model"]
            given, made = N(v, "tokenCount", "inputTokens") or 0, N(v, "tokenCount", "outputTokens") or 0
            held["usage"] = b.usage(given, made) if given or made else held["usage"]
            if (S(v, "thinking", "text") or "").strip():
                held["content"].append(b.thinking(v["thinking"]["text"], S(v, "thinking", "signature") or None))
            if text.strip():
                held["content"].append(b.text(text))
            c = b.at(v, "toolFormerData")
            if isinstance(c, dict):
                raw, told = S(c, "params"), S(c, "result") or ""
                id_ = call_id(S(c, "toolCallId") or "") or b.made_id(SPACE, meta.id, len(out), "call")
                held["content"].append(b.call(id_, *canonical_call(S(c, "name") or "", b.loads(raw, {}) if raw is not None else {})))
                flush()
                if S(c, "status") in ("completed", "error"):
                    value = b.loads(told, None)
                    out.append(b.message("user", [b.result(id_, told if value is None else Json(value), c["status"] == "error")], ts))
    flush()
    return out


def meta_of(body: dict, id_: str, fallback) -> Meta:
    head = b.loads(body["header"], None) if body["header"] else None
    doc = b.loads(body["composer_data"], None) if body["composer_data"] else None
    repos = b.L(head, "trackedGitRepos")
    places = [b.at(head, "workspaceIdentifier", "uri", "fsPath"), b.at(head, "agentLocation", "environment", "uri", "fsPath"), b.at(repos[0], "repoPath") if repos else None]
    place = next((p for p in places if p is not None), None)
    title = next((t.strip() for k in ("name", "subtitle") if (t := S(head, k)) and t.strip()), None)
    at = b.from_ms(body["created_at"]) if body["created_at"] else None
    return Meta(id_, at or fallback, place if isinstance(place, str) and place else None, None, title, None, _model(S(doc, "modelConfig", "modelName")))


def to_body(session: Session) -> dict:
    meta = session.meta
    cid = meta.id or b.made_id(SPACE, b.iso(meta.timestamp), meta.title or "")
    bubbles: list[dict] = []
    calls: dict[str, dict] = {}

    def bubble(i: int, j: int, kind: int, ts, **more: Any) -> dict:
        new = {"_v": 3, "type": kind, "bubbleId": b.made_id(SPACE, cid, i, j), "createdAt": b.iso(ts), "text": "", "richText": "", "tokenCount": {"inputTokens": 0, "outputTokens": 0}}
        bubbles.append(new | more)
        return bubbles[-1]

    for i, m in enumerate(session.messages):
        ts = m["timestamp"]
        if m["role"] == "user":
            for x in m["content"]:
                if x["type"] == "tool_result" and x["id"] in calls:
                    calls[x["id"]] |= {"result": b.output_text(x["output"]), "status": "error" if x["is_error"] else "completed"}
            if said := "\n\n".join(x["text"] for x in m["content"] if x["type"] == "text"):
                bubble(i, 0, 1, ts, text=said, modelInfo={"modelName": "default"})
            continue
        for j, x in enumerate(m["content"]):
            more: dict = {} if m["model"] is None else {"modelInfo": {"modelName": m["model"]}}
            if m["usage"]:
                more["tokenCount"] = {"inputTokens": m["usage"]["input_tokens"], "outputTokens": m["usage"]["output_tokens"]}
            if x["type"] == "text":
                more["text"] = x["text"]
            elif x["type"] == "thinking":
                more |= {"capabilityType": 30, "thinkingDurationMs": 0, "thinking": {"text": x["text"], "signature": x["signature"] or ""}}
            elif x["type"] == "tool_use":
                name, value = native_call(x["name"], x["input"])
                c = {"name": name, "toolCallId": x["id"], "params": b.compact(value), "rawArgs": "", "status": "started", "result": ""}
                calls[x["id"]] = c | ({"tool": NUMBERS[name]} if name in NUMBERS else {})
                more |= {"capabilityType": 15, "toolFormerData": calls[x["id"]]}
            else:
                continue
            bubble(i, j, 2, ts, **more)
    created, model = b.ms(meta.timestamp), meta.model or "default"
    name = meta.title or next((b.truncate(t) for t in [b.first_user_text(session.messages)] if t), "Imported session")
    head = {"type": "head", "composerId": cid, "name": name, "createdAt": created, "lastUpdatedAt": created}
    head |= {} if meta.cwd is None else {"workspaceIdentifier": {"id": b.made_id(SPACE, meta.cwd), "uri": {"fsPath": meta.cwd, "path": meta.cwd, "scheme": "file"}}}
    doc = {"_v": 17, "composerId": cid, "name": name, "createdAt": created, "lastUpdatedAt": created, "isDraft": False, "status": "none", "text": "", "richText": ""}
    doc |= {"modelConfig": {"maxMode": False, "modelName": model}, "fullConversationHeadersOnly": [{"bubbleId": v["bubbleId"], "type": v["type"]} for v in bubbles]}
    rows = [(f"bubbleId:{cid}:{v['bubbleId']}", b.compact(v)) for v in bubbles]
    return {"header": b.compact(head), "created_at": created, "updated_at": created, "composer_data": b.compact(doc), "bubbles": rows, "aux": [], "id": cid}


class CursorDesktop(Format):
    name = "cursor_desktop"
    glob = "*.vscdb"
    names = NAMES

    def _ids(self, con: sqlite3.Connection) -> list[str]:
        try:
            return [r[0] for r in con.execute("SELECT composerId FROM composerHeaders ORDER BY recency DESC")]
        except sqlite3.Error:  # databases from before the table
            return [k.split(":", 1)[1] for (k,) in con.execute("SELECT key FROM cursorDiskKV WHERE key LIKE 'composerData:%'")]

    def _body(self, con: sqlite3.Connection, cid: str) -> dict | None:
        try:
            row = con.execute("SELECT value, createdAt, lastUpdatedAt FROM composerHeaders WHERE composerId = ?", (cid,)).fetchone()
        except sqlite3.Error:
            row = None
        found = con.execute("SELECT CAST(value AS TEXT) FROM cursorDiskKV WHERE key = ?", (f"composerData:{cid}",)).fetchone()
        doc = found and found[0]
        if row is None:
            if doc is None:
                return None
            old = b.loads(doc, None)
            row = (b.compact({"type": "head", "composerId": cid}), I(old, "createdAt"), I(old, "lastUpdatedAt"))
        bubbles = con.execute("SELECT key, CAST(value AS TEXT) FROM cursorDiskKV WHERE key LIKE ? ORDER BY rowid", (f"bubbleId:{cid}:%",)).fetchall()
        other = "key LIKE ? AND key NOT LIKE ? AND key NOT LIKE 'composerData:%' AND key NOT LIKE 'agentKv:%'"
        aux = con.execute(f"SELECT key, CAST(value AS TEXT) FROM cursorDiskKV WHERE {other} ORDER BY rowid", (f"%{cid}%", f"bubbleId:{cid}:%")).fetchall()
        return {"header": row[0], "created_at": row[1] or 0, "updated_at": row[2] or 0, "composer_data": doc, "bubbles": bubbles, "aux": aux, "id": cid}

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        """Sessions with a bubble: others are drafts."""
        con, out = open_db(next(iter(unit.files.values()))), []
        for cid in self._ids(con):
            body = self._body(con, cid)
            if body and body["bubbles"]:
                out.append((meta_of(body, cid, unit.mtime), body))
        return out

    def cursors(self, unit: Unit) -> dict[str, str]:
        return {meta.id: str(body["updated_at"]) for meta, body in self.sessions(unit)}

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta)

    def from_common(self, session: Session) -> Any:
        return to_body(session)

    def unit_files(self, meta: Meta, body: Any) -> list[dict]:
        """A database with this session alone; the editor's own is never written."""
        head = [(body["id"], None, body["created_at"], body["updated_at"], 0, 0, body["created_at"], None, body["header"])]
        rows = [(f"composerData:{body['id']}", body["composer_data"]), *body["bubbles"], *body["aux"]]
        data = database({"composerHeaders": (_HEAD, head), "cursorDiskKV": ("key TEXT PRIMARY KEY, value BLOB", rows)})
        return [{"name": "state.vscdb", "content": data}]
