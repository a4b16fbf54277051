"""JSONL lines with a wrapped API message each; local commands as tagged text."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from . import base as b
from .base import Format, Json, Meta, S, Session, Unit

SPACE = b.namespace("claude_code")
STOPS = {x: x for x in ("end_turn", "tool_use", "max_tokens", "stop_sequence")}
RESULT_TAGS = {"text", "image", "document", "search_result", "tool_reference", "browser_state"}
COMMAND_TAGS = {"command-name", "command-message", "command-args"}
_TAG = re.compile(r"<([a-z-]+)>")
_CLOSERS = "|".join(sorted(COMMAND_TAGS | {"local-command-stdout", "local-command-caveat"}))
_ESCAPED = re.compile(rf"<(\\*)(/(?:{_CLOSERS})>)")
_ANSI = re.compile(r"\x1b(?:\[[^\x40-\x7e]*[\x40-\x7e]?|\](?:(?!\x07|\x1b\\).)*(?:\x07|\x1b\\|$)|.|$)", re.S)


def _strings(value: dict, *keys: str) -> bool:
    return all(value.get(k) is None or isinstance(value[k], str) for k in keys)


def kind_of(line: dict) -> str:
    """summary, user, assistant or other: a line of a known type whose fields
    have other types is other."""
    kind = line.get("type")
    if kind == "summary" and isinstance(line.get("summary"), str):
        return "summary"
    if kind in ("user", "assistant") and isinstance(line.get("uuid"), str):
        m = line.get("message")
        envelope = _strings(line, "parentUuid", "timestamp", "sessionId", "cwd", "gitBranch", "version")
        if envelope and isinstance(m, dict) and "content" in m and _strings(m, "role", "model", "stop_reason"):
            return kind
    return "other"


def strip_ansi(text: str) -> str:
    return _ANSI.sub("", text)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}\\{m[2]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1][1:]}{m[2]}", text)


def sections(text: str) -> list[tuple[str, str]]:
    """(tag, inner text) of a text that is nothing but tagged sections."""
    out, rest = [], text.strip()
    while rest:
        m = _TAG.match(rest)
        end = rest.find(f"</{m[1]}>", m.end()) if m else -1
        if end < 0:
            return []
        out.append((m[1], rest[m.end() : end]))
        rest = rest[end + len(m[1]) + 3 :].lstrip()
    return out


def envelope(text: str | None) -> tuple | None:
    """("command", name, args), ("stdout", text) or ("caveat",)."""
    found = sections(text) if text else []
    tags = dict(reversed(found))
    if "command-name" in tags:
        name = unescape(tags["command-name"].strip())
        if not set(tags) <= COMMAND_TAGS or not name:
            return None
        args = tags.get("command-args", "").strip()
        return "command", name if name.startswith("/") else f"/{name}", unescape(args) if args else None
    if len(found) == 1 and found[0][0] == "local-command-stdout":
        return "stdout", strip_ansi(unescape(found[0][1]))
    if len(found) == 1 and found[0][0] == "local-command-caveat":
        return ("caveat",)
    return None


def _body_text(content: Any) -> str | None:
    if isinstance(content, list) and len(content) == 1 and S(content[0], "type") == "text":
        content = S(content[0], "text")
    return content if isinstance(content, str) else None


class _Commands:
    """Pairs output with the command that is still open."""

    def __init__(self) -> None:
        self.open: str | None = None

    def blocks(self, found: tuple, uuid: str, parent: str | None) -> list[dict]:
        if found[0] == "command":
            self.open = uuid
            return [b.call(uuid, found[1], {} if found[2] is None else {"args": found[2]})]
        if found[0] == "stdout":
            owner = parent if parent is not None and parent == self.open else uuid
            self.open = None
            return [b.result(owner, found[1])]
        return []


def parse_block(v: Any) -> dict | None:
    kind = S(v, "type")
    if kind == "text" and S(v, "text") is not None:
        return b.text(v["text"])
    if kind == "thinking" and S(v, "thinking") is not None:
        return b.thinking(v["thinking"], S(v, "signature"))
    if kind == "tool_use" and S(v, "id") is not None and S(v, "name") is not None:
        given = v.get("input", {})
        if v["name"] != "Artifact":
            return b.call(v["id"], v["name"], given)
        path, label = S(given, "file_path"), S(given, "description")
        if path is None:
            return None
        return b.artifact(v["id"], label if label and label.strip() else re.split(r"[/\\]", path)[-1], "path", path)
    if kind == "tool_result" and S(v, "tool_use_id") is not None:
        return b.result(v["tool_use_id"], b.as_output(v["content"]) if "content" in v else "", b.B(v, "is_error") or False)
    source = b.at(v, "source")
    if kind == "image" and S(source, "media_type") is not None and S(source, "data") is not None:
        return b.image(source["media_type"], source["data"], S(source, "type") or "base64")
    if kind == "document" and S(source, "type") is not None and S(source, "data") is not None:
        form = "text" if source["type"] == "text" else "base64"
        return b.artifact(S(v, "id") or "", S(v, "title") or "document", form, source["data"], S(source, "media_type"))
    return None


def parse_blocks(content: Any) -> list[dict]:
    if isinstance(content, str):
        return [b.text(content)] if content else []
    return [x for x in map(parse_block, content if isinstance(content, list) else []) if x]


def parse_usage(v: Any) -> dict | None:
    given, made = b.N(v, "input_tokens"), b.N(v, "output_tokens")
    if given is None or made is None:
        return None
    return b.usage(given, made, b.N(v, "cache_read_input_tokens"), b.N(v, "cache_creation_input_tokens"))


def to_messages(lines: list[dict], fallback: datetime) -> list[dict]:
    out, commands = [], _Commands()
    for line in lines:
        kind = kind_of(line)
        if kind in ("user", "assistant"):
            m = line["message"]
            found = envelope(_body_text(m["content"]))
            content = commands.blocks(found, line["uuid"], line.get("parentUuid")) if found else parse_blocks(m["content"])
            if content:
                ts = b.when(line.get("timestamp")) or fallback
                out.append(b.message(kind, content, ts, m.get("model"), b.stop(m.get("stop_reason"), STOPS), parse_usage(m.get("usage"))))
        elif kind == "other" and line.get("type") == "system" and S(line, "uuid") is not None:
            found = envelope(S(line, "content"))
            content = commands.blocks(found, line["uuid"], S(line, "parentUuid")) if found else []
            if content:
                out.append(b.message("user", content, b.when(S(line, "timestamp")) or fallback))
    return out


def meta_of(lines: list[dict], fallback: datetime) -> Meta:
    """The header from lines of all kinds; contents aren't looked at."""
    meta = Meta(timestamp=fallback)
    summary = given = None
    times = []
    for line in lines:
        kind = kind_of(line)
        if kind == "user":
            meta.id = meta.id or line.get("sessionId") or ""
            for name, key in (("cwd", "cwd"), ("git_branch", "gitBranch"), ("cli_version", "version")):
                if getattr(meta, name) is None:
                    setattr(meta, name, line.get(key))
        if kind in ("user", "assistant"):
            times.append(b.when(line.get("timestamp")))
            if kind == "assistant" and meta.model is None:
                meta.model = line["message"].get("model")
        elif kind == "summary" and summary is None:
            summary = line["summary"]
        elif line.get("type") == "custom-title":
            given = S(line, "customTitle")
        elif line.get("type") == "agent-name" and given is None:
            given = S(line, "agentName")
    known = [t for t in times if t]
    meta.timestamp = min(known) if known else fallback
    meta.title = given if given is not None else summary
    return meta


def render_block(x: dict) -> dict:
    kind = x["type"]
    if kind == "text":
        return {"type": "text", "text": x["text"]}
    if kind == "thinking":
        sign = {} if x["signature"] is None else {"signature": x["signature"]}
        return {"type": "thinking", "thinking": x["text"], **sign}
    if kind == "tool_use":
        return {"type": "tool_use", "id": x["id"], "name": x["name"], "input": x["input"]}
    if kind == "tool_result":
        out = x["output"]
        if isinstance(out, Json):
            blocks = isinstance(out.value, list) and all(S(v, "type") in RESULT_TAGS for v in out.value)
            out = out.value if blocks else b.compact(out.value)
        return {"type": "tool_result", "tool_use_id": x["id"], "content": out, **({"is_error": True} if x["is_error"] else {})}
    if kind == "image":
        return {"type": "image", "source": {"type": x["encoding"], "media_type": x["media_type"], "data": x["data"]}}
    if x["kind"] == "path":
        return {"type": "tool_use", "id": x["id"], "name": "Artifact", "input": {"file_path": x["value"], "description": x["name"]}}
    default = "text/plain" if x["kind"] == "text" else "application/octet-stream"
    return {"type": "document", "source": {"type": x["kind"], "media_type": x["media_type"] or default, "data": x["value"]}}


def _lowered(messages: list[dict]) -> list[dict]:
    """Artifacts with a path become a call and, in a message of its own, its
    result."""
    out = []
    for m in messages:
        paths = [x for x in m["content"] if x["type"] == "artifact" and x["kind"] == "path"] if m["role"] == "assistant" else []
        if not paths:
            out.append(m)
            continue
        said = [b.call(x["id"], "Artifact", {"file_path": x["value"], "description": x["name"]}) if x in paths else x for x in m["content"]]
        out.append(m | {"content": said, "stop_reason": "tool_use"})
        out.append(b.message("user", [b.result(x["id"], f"Artifact available locally at {x['value']}") for x in paths], m["timestamp"]))
    return out


def to_lines(session: Session) -> list[dict]:
    meta, messages = session.meta, _lowered(session.messages)
    sid = meta.id or b.made_id(SPACE, b.iso(meta.timestamp))
    shared = {"cwd": meta.cwd, "gitBranch": meta.git_branch, "version": meta.cli_version}
    called = {x["id"] for m in messages for x in m["content"] if x["type"] == "tool_use"}
    commands: set[str] = set()
    lines: list[dict] = []
    parent = None
    for i, m in enumerate(messages):
        uuid, only = b.made_id(SPACE, sid, i), m["content"][0] if len(m["content"]) == 1 and m["role"] == "user" else None
        line = {"uuid": uuid, "parentUuid": parent, "timestamp": b.iso(m["timestamp"]), "sessionId": sid, **shared}
        parent = uuid
        if only and only["type"] == "tool_use" and b.tool_kind(only["name"], only["input"]) == "Command":
            commands.add(only["id"])
            parts = [("command-name", only["name"]), ("command-message", only["name"].lstrip("/"))]
            parts += [("command-args", only["input"]["args"])] if "args" in only["input"] else []
            said = "\n".join(f"<{t}>{escape(v)}</{t}>" for t, v in parts)
            line |= {"type": "user", "message": {"role": "user", "content": said}}
        elif only and only["type"] == "tool_result" and (only["id"] in commands or only["id"] not in called):
            said = escape(b.output_text(only["output"]))
            line |= {"type": "system", "subtype": "local_command", "level": "info", "isMeta": False}
            line["content"] = f"<local-command-stdout>{said}</local-command-stdout>"
        else:
            said = {"role": m["role"], "content": [render_block(x) for x in m["content"]], "model": m["model"]}
            said["stop_reason"] = b.stop_word(m["stop_reason"], {}, None)
            said["usage"] = m["usage"] and {k: v for k, v in m["usage"].items() if v is not None}
            line |= {"type": m["role"], "message": {k: v for k, v in said.items() if v is not None}}
        lines.append({k: v for k, v in line.items() if v is not None})
    leaf = [x["uuid"] for x in lines if x["type"] != "system"]
    if meta.title and leaf:
        lines.insert(0, {"type": "summary", "summary": meta.title, "leafUuid": leaf[-1]})
    return lines


def folder_name(cwd: str) -> str:
    return re.sub(r"[/.\\:]", "-", cwd)


class ClaudeCode(Format):
    name = "claude_code"
    glob = "*.jsonl"
    skip = r"/(subagents|tool-results)/"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        lines = b.json_lines(unit.only)
        meta = meta_of(lines, unit.mtime)
        meta.id = meta.id or unit.stem
        return [(meta, lines)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_lines(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        return {f"{folder_name(meta.cwd or '/')}/{b.safe_id(self.name, meta.id)}.jsonl": b.lines_text(body)}
