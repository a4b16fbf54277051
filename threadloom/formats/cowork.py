"""A session record beside a folder with its transcript and audit log."""

from __future__ import annotations

import re
from typing import Any

from . import base as b
from . import claude_code
from .base import B, Format, Meta, S, Session, Unit

SPACE = b.namespace("cowork")


def session_id(id_: str, seed: str) -> str:
    return id_ if id_.startswith("local_") else f"local_{id_ or b.made_id(SPACE, seed)}"


def cli_id(id_: str) -> str:
    return b.made_id(SPACE, id_)


def _fits(header: Any) -> bool:
    texts = ("sessionId", "cliSessionId", "processName", "cwd", "model", "title")
    plain = isinstance(header, dict) and all(header.get(k) is None or S(header, k) is not None for k in texts)
    return plain and S(header, "sessionId") is not None and (header.get("isArchived") is None or B(header, "isArchived") is not None)


def meta_of(header: dict, inner: Meta) -> Meta:
    """The record; what it lacks from the transcript."""
    at = header.get("createdAt")
    known = isinstance(at, (int, float)) and not isinstance(at, bool) and abs(at) < 9e15
    own = {k: v for k in ("cwd", "title", "model") if (v := S(header, k)) and v.strip()}
    return b.with_meta(inner, id=header["sessionId"], timestamp=(b.from_ms(int(at)) if known else None) or inner.timestamp, **own)


def to_body(session: Session) -> dict:
    meta = session.meta
    sid = session_id(meta.id, b.iso(meta.timestamp))
    inner, created = cli_id(sid), b.ms(meta.timestamp)
    header = {"sessionId": sid, "cliSessionId": inner, "processName": f"threadloom-{inner[:8]}", "cwd": meta.cwd or "", "createdAt": created}
    header["lastActivityAt"] = max([created, *(b.ms(m["timestamp"]) for m in session.messages)])
    header |= {"isArchived": False, "hostLoopMode": True, "model": meta.model, "title": meta.title}
    first = next((m for m in session.messages if m["role"] == "user"), None)
    header["initialMessage"] = next((x["text"] for x in first["content"] if x["type"] == "text"), None) if first else None
    lines = claude_code.to_lines(Session(b.with_meta(meta, id=inner), session.messages))
    return {"header": {k: v for k, v in header.items() if v is not None}, "transcript": lines, "audit": []}


class Cowork(Format):
    name = "cowork"
    glob = "*.{json,jsonl}"
    units = "record"
    #: <organisation>/<account>/[agent/]local_<id>.json, the first two being UUIDs
    record = re.compile(r"/[0-9a-f-]{36}/[0-9a-f-]{36}/(?:agent/)?local_[^/]*\.json$", re.I)

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        """``files`` has the record as ``record`` and the paths below its folder."""
        header = b.loads(unit.files["record"], None)
        if not _fits(header):
            return []
        wanted = f"{S(header, 'cliSessionId')}.jsonl"
        found = [p for p in sorted(unit.files) if re.fullmatch(r"\.claude/projects/[^/]+/" + re.escape(wanted), p)]
        lines = b.json_lines(unit.files[found[0]].decode()) if found and S(header, "cliSessionId") else []
        body = {"header": header, "transcript": lines, "audit": b.json_lines(unit.files.get("audit.jsonl", b"").decode())}
        meta = meta_of(header, claude_code.meta_of(lines, unit.mtime))
        meta.id = meta.id or unit.stem
        return [(meta, body)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return claude_code.to_messages(body["transcript"], meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_body(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        """Below an account's folder."""
        h = body["header"]
        id_ = b.safe_id(self.name, S(h, "sessionId") or meta.id)
        inner = b.safe_id(self.name, S(h, "cliSessionId") or cli_id(id_))
        folder = claude_code.folder_name(S(h, "cwd") or meta.cwd or "/")
        out = {f"{id_}.json": b.compact(h).encode(), f"{id_}/.claude/projects/{folder}/{inner}.jsonl": b.lines_text(body["transcript"])}
        return out | ({f"{id_}/audit.jsonl": b.lines_text(body["audit"])} if body["audit"] else {})
