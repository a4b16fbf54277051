"""JSONL with a session header first; the same lines in two stores."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from . import base as b
from .base import Format, I, Json, Meta, S, Session, Unit

SPACE = b.namespace("pi")
STOPS = {"stop": "end_turn", "length": "max_tokens", "toolUse": "tool_use", "error": "error", "aborted": "aborted"}
NAMES = {"bash": "Bash", "read": "Read", "write": "Write", "edit": "Edit", "grep": "Grep", "find": "Glob", "ls": "LS"}
_EDIT = {"oldText": "old_string", "newText": "new_string"}


def kind_of(line: dict) -> str:
    kind = line.get("type")
    plain = all(line.get(k) is None or isinstance(line[k], str) for k in ("parentId", "timestamp", "cwd"))
    has_id = isinstance(line.get("id"), str)
    fits = {
        "session": has_id,
        "message": has_id and "message" in line,
        "custom_message": (has_id or line.get("id") is None) and "content" in line,
    }
    return kind if isinstance(kind, str) and plain and fits.get(kind) else "other"


def meta_of(lines: list[dict], fallback: datetime) -> Meta:
    """The last header, model and name count; an empty name clears the title."""
    meta = Meta(timestamp=fallback)
    for line in lines:
        kind = kind_of(line)
        if kind == "session":
            meta.id, meta.cwd = line["id"], line.get("cwd")
            meta.timestamp = b.when(line.get("timestamp")) or meta.timestamp
        elif kind == "other" and line.get("type") == "model_change":
            meta.model = S(line, "modelId") or meta.model
        elif kind == "other" and line.get("type") == "session_info":
            meta.title = (S(line, "name") or "").strip() or None
    return meta


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    if name.startswith("mcp__"):
        return name, value
    if name in ("read", "write"):
        value = b.rename(value, {"path": "file_path"})
    if name == "edit" and isinstance(value, dict):
        value = dict(value)
        path = {"file_path": value.pop("path")} if "path" in value else {}
        edits = value.pop("edits", None)
        if not isinstance(edits, list):
            return "Edit", value | path
        edits = [b.rename(e, _EDIT) for e in edits]
        if len(edits) != 1:
            return "MultiEdit", path | {"edits": edits}
        return "Edit", path | {k: edits[0][k] for k in ("old_string", "new_string") if b.at(edits[0], k) is not None}
    return NAMES.get(name) or b.title_case(name), value


def native_call(name: str, value: Any) -> tuple[str, Any]:
    if name.startswith("mcp__"):
        return name, value
    if name in ("Read", "Write"):
        value = b.rename(value, {"file_path": "path"})
    if name in ("Edit", "MultiEdit"):
        if not isinstance(value, dict):
            return "edit", value
        edits = b.L(value, "edits") if name == "MultiEdit" else [{k: value.get(k) for k in ("old_string", "new_string")}]
        path = {"path": value["file_path"]} if "file_path" in value else {}
        return "edit", path | {"edits": [b.rename(e, b.inverse(_EDIT)) for e in edits]}
    return b.inverse(NAMES).get(name) or name.lower(), value


def _image(v: Any) -> dict | None:
    return b.image(S(v, "mimeType") or "image/png", v["data"]) if S(v, "data") is not None else None


def user_blocks(content: Any) -> list[dict]:
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    out = []
    for v in content if isinstance(content, list) else []:
        if S(v, "type") == "text" and (S(v, "text") or "").strip():
            out.append(b.text(v["text"]))
        elif S(v, "type") == "image" and (found := _image(v)):
            out.append(found)
    return out


def assistant_blocks(content: Any) -> list[dict]:
    out = []
    for v in content if isinstance(content, list) else []:
        kind = S(v, "type")
        if kind == "text" and (S(v, "text") or "").strip():
            out.append(b.text(v["text"]))
        elif kind == "thinking" and (S(v, "thinking") or "").strip():
            out.append(b.thinking(v["thinking"]))
        elif kind == "toolCall":
            out.append(b.call(S(v, "id") or "", *canonical_call(S(v, "name") or "tool", v.get("arguments", {}))))
    return out


def result_output(content: Any) -> str | Json:
    """Texts of a list joined; a list with an image stays a list."""
    if not isinstance(content, list):
        return b.as_output(content)
    if all(S(v, "type") != "image" for v in content):
        return "\n".join(v["text"] for v in content if S(v, "type") == "text" and S(v, "text") is not None)
    out = []
    for v in content:
        if S(v, "type") == "text" and S(v, "text") is not None:
            out.append({"type": "text", "text": v["text"]})
        elif S(v, "type") == "image" and (found := _image(v)):
            out.append({"type": "image", "source": {"type": "base64", "media_type": found["media_type"], "data": found["data"]}})
    return Json(out)


def parse_usage(v: Any) -> dict | None:
    given, made, read, written = (b.N(v, k) for k in ("input", "output", "cacheRead", "cacheWrite"))
    return b.usage(given or 0, made or 0, read, written) if given or made or read or written else None


def to_messages(lines: list[dict], fallback: datetime) -> list[dict]:
    out, runs = [], 0
    for line in lines:
        kind, ts = kind_of(line), b.when(S(line, "timestamp")) or fallback
        m = line.get("message")
        role = S(m, "role")
        if kind == "custom_message":
            blocks = user_blocks(line["content"])
            out += [b.message("user", blocks, ts)] if blocks else []
        if kind != "message":
            continue
        if role == "user" and (blocks := user_blocks(m.get("content"))):
            out.append(b.message("user", blocks, ts))
        elif role == "assistant" and (blocks := assistant_blocks(m.get("content"))):
            out.append(b.message("assistant", blocks, ts, S(m, "model"), b.stop(S(m, "stopReason"), STOPS), parse_usage(m.get("usage"))))
        elif role == "toolResult":
            failed = b.B(m, "isError") or False
            out.append(b.message("user", [b.result(S(m, "toolCallId") or "", result_output(m.get("content")), failed)], ts))
        elif role == "bashExecution":
            runs += 1  # also for runs that are left out
            if S(m, "command") and not b.B(m, "excludeFromContext"):
                out.append(b.message("assistant", [b.call(f"bash_exec_{runs}", "Bash", {"command": m["command"]})], ts))
                out.append(b.message("user", [b.result(f"bash_exec_{runs}", S(m, "output") or "", (I(m, "exitCode") or 0) != 0)], ts))
    return out


def provider(model: str) -> tuple[str, str]:
    m = model.lower()
    if m.startswith(("gpt", "o1", "o3")) or "codex" in m:
        return "openai", "openai-responses"
    return ("google", "google-generative-ai") if m.startswith("gemini") else ("anthropic", "anthropic-messages")


def to_lines(session: Session) -> list[dict]:
    meta = session.meta
    sid = meta.id or b.made_id(SPACE, b.iso(meta.timestamp))
    head = {"type": "session", "version": 3, "id": sid, "timestamp": b.iso(meta.timestamp), "cwd": meta.cwd}
    lines = [{k: v for k, v in head.items() if v is not None}]
    tools: dict[str, str] = {}
    parent = None
    for i, m in enumerate(session.messages):
        for j, payload in enumerate(_payloads(m, tools)):
            line = {"type": "message", "id": b.made_id(SPACE, sid, i, j)[:8], "parentId": parent, "timestamp": b.iso(m["timestamp"]), "message": payload}
            parent = line["id"]
            lines.append({k: v for k, v in line.items() if v is not None})
    return lines


def _payloads(m: dict, tools: dict[str, str]) -> list[dict]:
    """Native messages of one turn: results each by themselves, before what else
    a user said; what a turn of its kind can't hold is left out."""
    at, mine = b.ms(m["timestamp"]), m["role"] == "assistant"
    content, out = [], []
    for x in m["content"]:
        kind = x["type"]
        if kind in ("text", "artifact"):
            content.append({"type": "text", "text": x["text"] if kind == "text" else b.artifact_text(x)})
        elif kind == "image" and not mine:
            content.append({"type": "image", "data": x["data"], "mimeType": x["media_type"]})
        elif kind == "thinking" and mine:
            content.append({"type": "thinking", "thinking": x["text"]})
        elif kind == "tool_use" and mine:
            name, value = native_call(x["name"], x["input"])
            tools[x["id"]] = name
            content.append({"type": "toolCall", "id": x["id"], "name": name, "arguments": value})
        elif kind == "tool_result" and not mine:
            said = [{"type": "text", "text": b.output_text(x["output"])}]
            answer = {"role": "toolResult", "toolCallId": x["id"], "toolName": tools.get(x["id"], "tool")}
            out.append(answer | {"content": said, "isError": x["is_error"], "timestamp": at})
    if content and not mine:
        out.append({"role": "user", "content": content, "timestamp": at})
    elif content:
        model, u = m["model"] or "", m["usage"] or b.usage(0, 0)
        counts = {"input": u["input_tokens"], "output": u["output_tokens"]}
        counts |= {"cacheRead": u["cache_read_input_tokens"] or 0, "cacheWrite": u["cache_creation_input_tokens"] or 0}
        counts["totalTokens"] = counts["input"] + counts["output"]
        counts["cost"] = {k: 0.0 for k in ("input", "output", "cacheRead", "cacheWrite", "total")}
        who, api = provider(model)
        said = {"role": "assistant", "content": content, "model": model, "provider": who, "api": api, "usage": counts}
        out.append(said | {"stopReason": b.stop_word(m["stop_reason"], b.inverse(STOPS), "stop"), "timestamp": at})
    return out


def folder_name(cwd: str) -> str:
    return "--" + re.sub(r"[/\\:]", "-", cwd.lstrip("/\\")) + "--"


class Pi(Format):
    name = "pi"
    glob = "*.jsonl"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        lines = b.json_lines(unit.only)
        if not lines or kind_of(lines[0]) != "session":
            return []
        meta = meta_of(lines, unit.mtime)
        meta.id = meta.id or unit.stem
        return [(meta, lines)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_lines(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        at = re.sub("[:.]", "-", b.iso(meta.timestamp))
        return {f"{folder_name(meta.cwd or '')}/{at}_{b.safe_id(self.name, meta.id)}.jsonl": b.lines_text(body)}


class Campfire(Pi):
    name = "campfire"
