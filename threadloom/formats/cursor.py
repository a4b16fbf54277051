"""A folder a session with a database of blobs: messages as JSON, named by their
SHA-256, among blobs of the editor's own state.

Of that state, only the messages are written; the editor rebuilds the rest."""

from __future__ import annotations

import hashlib
import re
import sqlite3
from typing import Any

from . import base as b
from .base import Format, I, Json, Meta, S, Session, Unit
from .grok import unwrapped
from .opencode import open_db

SPACE = b.namespace("cursor")
NAMES = {"Shell": "Bash", "StrReplace": "Edit"}
_EVERY = {"path": "file_path", "filePath": "file_path"}
KEYS = {"Bash": {"cwd": "workdir"}, "Edit": {"oldString": "old_string", "newString": "new_string"}}


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    name = NAMES.get(name, name)
    keys = _EVERY | KEYS.get(name, {})
    return name, {keys.get(k, k): v for k, v in value.items()} if isinstance(value, dict) else value


def native_call(name: str, value: Any) -> tuple[str, Any]:
    keys = {"file_path": "path"} | ({"workdir": "cwd"} if name == "Bash" else {})
    value = {keys.get(k, k): v for k, v in value.items()} if isinstance(value, dict) else value
    return b.inverse(NAMES).get(name, name), value


def cleaned(text: str) -> str:
    return re.sub(r"\n\n\[REDACTED\]|\[REDACTED\]\n\n|\[REDACTED\]", "", text).strip()


def _strings(content: Any) -> list[str]:
    if isinstance(content, str):
        return [content]
    found = [v.get("text") if S(v, "text") is not None else S(v, "result") for v in content if isinstance(v, dict)] if isinstance(content, list) else []
    return [x for x in found if x is not None]


def injected(m: Any) -> bool:
    return any("<user_info>" in t for t in _strings(b.at(m, "content")))


def model_of(m: Any) -> str | None:
    own = S(m, "providerOptions", "cursor", "modelName")
    return own if own is not None else next((x for v in b.L(m, "content") if (x := model_of(v)) is not None), None)


def time_of(m: Any):
    raw = m["createdAt"] if "createdAt" in m else m.get("timestamp")
    return b.from_ms(I(raw)) or b.when(S(m, "timestamp"))


def _image(v: Any) -> dict | None:
    if S(v, "source", "media_type") is None or S(v, "source", "data") is None:
        return None
    return b.image(v["source"]["media_type"], v["source"]["data"], S(v, "source", "type") or "base64")


def user_blocks(m: Any) -> list[dict]:
    content, out = b.at(m, "content"), []
    for v in [{"type": "text", "text": content}] if isinstance(content, str) else b.L(m, "content"):
        if S(v, "type") == "text" and (t := cleaned(unwrapped(S(v, "text") or ""))):
            out.append(b.text(t))
        elif S(v, "type") == "image" and (found := _image(v)):
            out.append(found)
    return out


def assistant_blocks(m: Any, session: str, n: int) -> list[dict]:
    out = []
    for j, v in enumerate(b.L(m, "content")):
        kind = S(v, "type")
        if kind == "text" and (t := cleaned(S(v, "text") or "")):
            out.append(b.text(t))
        elif kind in ("reasoning", "thinking"):
            said = v["text"] if "text" in v else v.get("thinking")
            out.append(b.thinking(said if isinstance(said, str) else "", S(v, "signature"), S(v, "data")))
        elif kind == "redacted-reasoning":
            out.append(b.thinking("", None, S(v, "data")))
        elif kind == "tool-call" and S(v, "toolName") is not None:
            id_ = S(v, "toolCallId")
            out.append(b.call(b.made_id(SPACE, session, n, j, v["toolName"]) if id_ is None else id_, *canonical_call(v["toolName"], v.get("args", {}))))
        elif kind == "image" and (found := _image(v)):
            out.append(found)
    return out


def tool_blocks(m: Any) -> list[dict]:
    """Results; one that doesn't say whether it failed is judged by its words."""
    out = []
    for v in b.L(m, "content"):
        if S(v, "type") == "tool-result" and S(v, "toolCallId") is not None:
            value = b.as_output(v["result"]) if "result" in v else ""
            told = v["isError"] if "isError" in v else m.get("isError")
            words = isinstance(value, str) and (value.startswith("Error:") or " exited with code " in value)
            out.append(b.result(v["toolCallId"], value, told if isinstance(told, bool) else words))
    return out


def messages_of(body: dict) -> list[dict]:
    found = (b.loads(data, None) for _, data in body["blobs"])
    return [m for m in found if isinstance(m, dict)]


def to_messages(body: dict, meta: Meta) -> list[dict]:
    out: list[dict] = []
    for m in messages_of(body):
        role, model = S(m, "role"), None
        if role == "user" and not injected(m):
            blocks = user_blocks(m)
        elif role == "assistant":
            blocks, model = assistant_blocks(m, meta.id, len(out)), model_of(m) or meta.model
        elif role == "tool":
            role, blocks = "user", tool_blocks(m)
        else:
            continue
        if blocks:
            out.append(b.message(role, blocks, time_of(m) or meta.timestamp, model))
    return out


def table_value(rows: list) -> Any:
    """The value of key 0, as JSON or as hex of it."""
    raw = next((v for k, v in rows if k == "0"), None)
    if not isinstance(raw, str):
        return None
    found = b.loads(raw, None)
    return found if found is not None else b.loads(bytes.fromhex(raw) if re.fullmatch(r"([0-9a-fA-F]{2})+", raw) else b"", None)


def meta_of(body: dict, fallback) -> Meta:
    """The title is that of the sidecar or the table, else the first words of the
    user; a start of 0 is the file's time."""
    side, kept, said = body["session_meta"], table_value(body["meta"]), messages_of(body)
    created = I(side, "createdAtMs") if I(side, "createdAtMs") is not None else I(kept, "createdAt")
    places = (line.removeprefix("Workspace Path: ") for m in said for t in _strings(m.get("content")) for line in t.splitlines() if line.startswith("Workspace Path: "))
    title = S(side, "title") if S(side, "title") is not None else S(kept, "name")
    if not title:
        firsts = (x["text"] for m in said if S(m, "role") == "user" and not injected(m) for x in user_blocks(m) if x["type"] == "text")
        title = next((b.truncate(t) for t in firsts), title)
    cwd, model = S(kept, "workspacePath"), S(kept, "lastUsedModel")
    return Meta(
        S(kept, "agentId") or "", b.from_ms(created) if created else fallback, next(places, None) if cwd is None else cwd, None, title, None,
        next((x for m in said if (x := model_of(m)) is not None), None) if model is None else model,
    )


def to_body(session: Session) -> dict:
    meta, rows, names = session.meta, [], {}
    for m in session.messages:
        at, mine, content = b.ms(m["timestamp"]), m["role"] == "assistant", []
        for x in m["content"]:
            kind = x["type"]
            if kind == "tool_result":
                if not mine:
                    said = {"type": "tool-result", "toolCallId": x["id"], "toolName": names.get(x["id"], "tool"), "result": b.output_text(x["output"])}
                    rows.append({"role": "tool", "content": [said], "createdAt": at, "isError": x["is_error"]})
            elif kind == "image":
                content.append({"type": "image", "source": {"type": x["encoding"], "media_type": x["media_type"], "data": x["data"]}})
            elif kind == "tool_use" and mine:
                names[x["id"]], value = native_call(x["name"], x["input"])
                content.append({"type": "tool-call", "toolCallId": x["id"], "toolName": names[x["id"]], "args": value})
            elif kind == "thinking" and mine:
                sign = {} if x["signature"] is None else {"signature": x["signature"]}
                content.append({"type": "redacted-reasoning", "data": x["encrypted"]} if x["encrypted"] is not None else {"type": "reasoning", "text": x["text"]} | sign)
            else:
                text = {"text": lambda x=x: x["text"], "thinking": lambda x=x: x["text"], "artifact": lambda x=x: b.artifact_text(x), "tool_use": lambda x=x: f"{x['name']} {b.compact(x['input'])}"}[kind]()
                if kind == "text" and not mine and not text.lstrip().startswith("<user_query>"):
                    text = f"<user_query>\n{text}\n</user_query>"
                content.append({"type": "text", "text": text})
        if content:
            model = m["model"] or meta.model if mine else None
            rows.append({"role": m["role"], "content": content, "createdAt": at} | ({"providerOptions": {"cursor": {"modelName": model}}} if model else {}))
    blobs = [(hashlib.sha256(d).hexdigest(), d) for d in (b.compact(r).encode() for r in rows)]
    created, title = b.ms(meta.timestamp), meta.title or "Imported Session"
    last = b.ms(session.messages[-1]["timestamp"]) if session.messages else created
    kept = {"agentId": meta.id, "latestRootBlobId": blobs[-1][0] if blobs else "", "name": title, "createdAt": created, "mode": "default", "lastUsedModel": meta.model or "unknown"}
    kept |= {} if meta.cwd is None else {"workspacePath": meta.cwd}
    side = {"schemaVersion": 1, "createdAtMs": created, "hasConversation": bool(blobs), "title": title, "updatedAtMs": max(last, created)}
    return {"blobs": blobs, "meta": [("0", b.compact(kept).encode().hex())], "session_meta": side}


def database(tables: dict[str, tuple[str, list]]) -> bytes:
    """A database's bytes from name -> (columns, rows)."""
    con = sqlite3.connect(":memory:")
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT OR REPLACE INTO {name} VALUES ({','.join('?' * len(rows[0]))})", rows)
    con.commit()
    return con.serialize()


class Cursor(Format):
    name = "cursor"
    glob = "{store.db,meta.json}"
    units = "folder"
    names = NAMES

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        if "store.db" not in unit.files:
            return []
        con = open_db(unit.files["store.db"])
        raw = [(i, d.encode() if isinstance(d, str) else d or b"") for i, d in con.execute("SELECT id, data FROM blobs ORDER BY rowid")]
        try:
            kept = con.execute("SELECT key, value FROM meta ORDER BY key").fetchall()
        except sqlite3.Error:  # older stores have no such table
            kept = []
        body = {"blobs": raw, "meta": kept, "session_meta": b.loads(unit.files["meta.json"], None) if "meta.json" in unit.files else None}
        meta = meta_of(body, unit.mtime)
        # a session's id is its folder's name, and the copy inside only follows it
        return [(b.with_meta(meta, id=unit.source.rstrip("/").rsplit("/", 1)[-1] or meta.id), body)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta)

    def from_common(self, session: Session) -> Any:
        return to_body(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        kept = table_value(body["meta"])
        folder = f"{hashlib.md5((meta.cwd or '').encode()).hexdigest()}/{b.safe_id(self.name, meta.id or S(kept, 'agentId') or '')}"
        data = database({"blobs": ("id TEXT PRIMARY KEY, data BLOB", body["blobs"]), "meta": ("key TEXT PRIMARY KEY, value TEXT", body["meta"])})
        said = [x["text"] for m in to_messages(body, meta) if m["role"] == "user" for x in m["content"] if x["type"] == "text"]
        return {f"{folder}/store.db": data, f"{folder}/meta.json": b.compact(body["session_meta"]).encode(), f"{folder}/prompt_history.json": b.compact(said).encode()}
