"""The simple document: one JSON object with a list of messages."""

from __future__ import annotations

import json
from typing import Any

from . import base as b
from .base import Format, Json, Meta, N, S, Session, Unit

SPACE = b.namespace("simple")
HEAD = ("cwd", "git_branch", "title", "cli_version", "model")
_SOURCES = {"text": "text", "base64": "data", "path": "path"}


def _stop(v: Any) -> tuple[bool, str | None]:
    """Whether it can be read, and the reason."""
    if v is None or isinstance(v, str):
        return v is None or v in b.STOPS, v
    return (True, f"other:{v['other']}") if isinstance(v, dict) and set(v) == {"other"} and S(v, "other") is not None else (False, None)


def _usage(v: Any) -> tuple[bool, dict | None]:
    if v is None:
        return True, None
    counts = [N(v, k) for k in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    optional = all(n is not None or b.at(v, k) is None for n, k in zip(counts[2:], ("cache_read_input_tokens", "cache_creation_input_tokens")))
    return None not in counts[:2] and optional, b.usage(*counts) if None not in counts[:2] else None


def entry(v: Any) -> dict | None:
    """A message as it is written, or None for one that is kept only natively: a
    broken time, content that is no text or list, other types."""
    if not isinstance(v, dict):
        return None
    role, content = v.get("role", ""), v.get("content", [])
    time = b.when(v["timestamp"]) if v.get("timestamp") is not None else None
    good_stop, why = _stop(v.get("stop_reason"))
    good_usage, counts = _usage(v.get("usage"))
    fits = isinstance(role, str) and isinstance(content, (str, list)) and (v.get("model") is None or S(v, "model") is not None)
    if not fits or not good_stop or not good_usage or (v.get("timestamp") is not None and time is None):
        return None
    return {"role": role.strip().lower(), "content": content, "timestamp": time, "model": v.get("model"), "stop_reason": why, "usage": counts}


def _artifact(v: Any) -> dict | None:
    kind = S(v, "source", "type")
    value = S(v, "source", _SOURCES.get(kind or "", ""))
    if S(v, "id") is None or S(v, "name") is None or value is None:
        return None
    return b.artifact(v["id"], v["name"], kind, value, S(v, "source", "media_type"))


def to_messages(doc: Any, meta: Meta) -> list[dict]:
    out, ts, open_calls = [], meta.timestamp, []
    for i, v in enumerate(b.L(doc, "messages")):
        e = entry(v)
        if e is None or e["role"] not in ("user", "assistant"):
            continue
        ts = e["timestamp"] or ts
        blocks = []
        for j, x in enumerate([{"type": "text", "text": e["content"]}] if isinstance(e["content"], str) else e["content"]):
            kind = S(x, "type")
            if kind == "text" and S(x, "text") is not None:
                blocks.append(b.text(x["text"]))
            elif kind == "thinking" and S(x, "text") is not None:
                blocks.append(b.thinking(x["text"], S(x, "signature"), S(x, "encrypted")))
            elif kind == "tool_use" and S(x, "name") is not None:
                id_ = S(x, "id")
                open_calls.append(b.made_id(SPACE, meta.id, i, j) if id_ is None else id_)
                blocks.append(b.call(open_calls[-1], x["name"], x.get("input")))
            elif kind == "tool_result":
                id_ = S(x, "tool_use_id")
                if id_ in open_calls:
                    open_calls.remove(id_)
                elif id_ is None:  # the oldest call without a result
                    id_ = open_calls.pop(0) if open_calls else b.made_id(SPACE, meta.id, i, j)
                blocks.append(b.result(id_, b.as_output(x["content"]) if "content" in x else "", b.B(x, "is_error") or False))
            elif kind == "image" and all(S(x, "source", k) is not None for k in ("type", "media_type", "data")):
                blocks.append(b.image(x["source"]["media_type"], x["source"]["data"], x["source"]["type"]))
            elif kind == "artifact" and (found := _artifact(x.get("artifact"))):
                blocks.append(found)
        out.append(b.message(e["role"], blocks, ts, e["model"], e["stop_reason"], e["usage"]))
    return out


def native_block(x: dict) -> dict:
    kind = x["type"]
    if kind == "thinking":
        return {k: v for k, v in x.items() if v is not None}
    if kind == "tool_use":
        return {"type": kind, "id": x["id"], "name": x["name"], "input": x["input"]}
    if kind == "tool_result":
        out = x["output"]
        value = out.value if isinstance(out, Json) else out
        return {"type": kind, "tool_use_id": x["id"], "content": value} | ({"is_error": True} if x["is_error"] else {})
    if kind == "image":
        return {"type": kind, "source": {"type": x["encoding"], "media_type": x["media_type"], "data": x["data"]}}
    if kind == "artifact":
        source = {"type": x["kind"], _SOURCES[x["kind"]]: x["value"]} | ({} if x["media_type"] is None else {"media_type": x["media_type"]})
        return {"type": kind, "artifact": {"id": x["id"], "name": x["name"], "source": source}}
    return dict(x)


def _time(t) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S") + (f".{t.microsecond:06d}".rstrip("0") if t.microsecond else "") + "Z"


def to_document(session: Session) -> dict:
    """A single text is written as a plain string, and absent values aren't."""
    meta, listed = session.meta, []
    for m in session.messages:
        plain = len(m["content"]) == 1 and m["content"][0]["type"] == "text"
        e = {"role": m["role"], "content": m["content"][0]["text"] if plain else [native_block(x) for x in m["content"]]}
        why, counts = m["stop_reason"], m["usage"]
        e |= {"timestamp": _time(m["timestamp"]), "model": m["model"]}
        e["stop_reason"] = {"other": why[6:]} if why and why.startswith("other:") else why
        e["usage"] = counts and {k: v for k, v in counts.items() if v is not None}
        listed.append({k: v for k, v in e.items() if v is not None})
    head = {"id": meta.id or None, "timestamp": _time(meta.timestamp)} | {k: getattr(meta, k) for k in HEAD}
    return {k: v for k, v in head.items() if v is not None} | {"messages": listed}


def document_text(doc: dict) -> str:
    return json.dumps(doc, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


class Simple(Format):
    name = "simple"
    glob = "*.json"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        doc = b.loads(unit.only, None)
        if not isinstance(b.at(doc, "messages"), list):
            return []
        meta = Meta(S(doc, "id") or unit.stem, b.when(S(doc, "timestamp")) or unit.mtime, *(S(doc, k) for k in HEAD))
        return [(meta, doc)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta)

    def from_common(self, session: Session) -> Any:
        return to_document(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        return {f"{b.safe_id(self.name, meta.id)}.json": document_text(body).encode()}
