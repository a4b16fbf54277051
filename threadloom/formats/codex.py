"""Rollout JSONL: typed envelopes around protocol items and display events."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from . import base as b
from .base import Format, I, Json, Meta, S, Session, Unit

SETUP = re.compile(r"\s*<(environment_context|permissions instructions|collaboration_mode|sandbox_mode|approval_policy)>")
_FRAME = {"*** Begin Patch", "*** End Patch", "*** End of File"}
_FILE = re.compile(r"\*\*\* (Update|Add|Delete) File: (.*)")


def lines_of(text: str) -> list[dict]:
    rows = [r for r in b.json_lines(text) if isinstance(r.get("type"), str)]
    return [r for r in rows if r.get("timestamp") is None or isinstance(r["timestamp"], str)]


def meta_of(lines: list[dict], fallback: datetime) -> Meta:
    """Only the first session_meta names the session."""
    p = next((b.at(x, "payload") for x in lines if x["type"] == "session_meta"), None)
    model = b.at(p, "model") if b.at(p, "model") is not None else b.at(p, "model_name")
    return Meta(
        S(p, "id") or "", b.when(S(p, "timestamp")) or fallback, S(p, "cwd"), S(p, "git", "branch"), None,
        S(p, "cli_version"), model if isinstance(model, str) else None,
    )


def command_text(value: Any) -> str | None:
    """A command as a shell shows it: of ``bash -lc X`` the X."""
    if isinstance(value, str):
        return value
    words = [x if isinstance(x, str) else b.compact(x) for x in value if isinstance(x, (str, int, float, bool))] if isinstance(value, list) else []
    if len(words) >= 3 and words[0] in ("bash", "sh", "zsh") and words[1] in ("-lc", "-c"):
        return words[2]
    return " ".join(words) if words else None


def shell_input(value: Any) -> Any:
    if not isinstance(value, dict):
        return value
    command = command_text(value.get("cmd"))
    command = command_text(value.get("command")) if command is None else command
    folder = value["workdir"] if "workdir" in value else value.get("cwd")
    out = {"command": command, "workdir": folder if isinstance(folder, str) else None}
    return {k: v for k, v in out.items() if v is not None} or value


class _Patch:
    """One file of a patch: lines to add, or hunks of old and new lines."""

    def __init__(self, path: str, added: bool):
        self.path, self.added = path, added
        self.lines: list[str] = []
        self.hunks: list[tuple[list[str], list[str]]] = []

    def feed(self, line: str) -> None:
        if self.added:
            if line.startswith("+"):
                self.lines.append(line[1:])
        elif line.startswith("@@"):
            self.hunks.append(([], []))
        elif self.hunks and line[:1] in (" ", "-", "+"):
            for side, marks in zip(self.hunks[-1], (" -", " +")):
                if line[0] in marks:
                    side.append(line[1:])


def patch_call(value: Any) -> tuple[str, Any]:
    """A patch that adds one file is a Write, one that changes one place of one
    file an Edit; others stay whole, with the paths they touch."""
    if not isinstance(value, str):
        return "ApplyPatch", value
    rows = [x.removesuffix("\r") for x in value.split("\n")]
    kept: tuple[str, Any] = ("ApplyPatch", {"patch": value, "files": [m[2] for m in map(_FILE.fullmatch, rows) if m]})
    files: list[_Patch] = []
    for line in rows:
        m = _FILE.fullmatch(line)
        if line.startswith(("*** Delete File: ", "*** Move to: ")):
            return kept
        if m:
            files.append(_Patch(m[2], m[1] == "Add"))
        elif files and line not in _FRAME:
            files[-1].feed(line)
    if len(files) != 1 or not (files[0].added or len(files[0].hunks) == 1):
        return kept
    one = files[0]
    if one.added:
        return "Write", {"file_path": one.path, "content": "\n".join(one.lines)}
    old, new = ("\n".join(side) for side in one.hunks[0])
    return "Edit", {"file_path": one.path, "old_string": old, "new_string": new}


def native_call(name: str, value: Any, custom: bool) -> tuple[str, Any]:
    if custom:
        return patch_call(value) if name == "apply_patch" else (name, value)
    return ("Bash", shell_input(value)) if name in ("exec_command", "shell") else (name, value)


def content_blocks(content: Any) -> list[dict]:
    out = []
    for entry in content if isinstance(content, list) else []:
        kind = S(entry, "type")
        if kind in ("input_text", "output_text") and S(entry, "text"):
            out.append(b.text(entry["text"]))
        elif kind == "input_image" and (found := b.data_url(S(entry, "image_url"))):
            out.append(found)
    return out


def is_setup(content: Any) -> bool:
    """Whether all a message says is the harness's own setup."""
    if not isinstance(content, list) or not content:
        return False
    return all(S(e, "type") in ("input_text", "output_text") and SETUP.match(S(e, "text") or "") for e in content)


def reasoning(payload: Any) -> str | None:
    parts = [e["text"] for e in b.L(payload, "summary") if S(e, "type") == "summary_text" and S(e, "text") is not None]
    return "\n\n".join(parts) if parts else None


def exec_output(p: Any) -> str:
    whole = S(p, "aggregated_output")
    return whole if whole is not None else "\n".join(x for x in (S(p, "stdout"), S(p, "stderr")) if x)


def custom_output(raw: str) -> tuple[str | Json, bool]:
    value = b.loads(raw, raw)
    if not isinstance(value, dict):
        return b.as_output(value), False
    return (b.as_output(value["output"]) if "output" in value else raw), (I(value, "metadata", "exit_code") or 0) != 0


def search_output(p: Any) -> str:
    action, query = b.at(p, "action"), S(p, "query") or ""
    kind, url = S(action, "type"), S(action, "url")
    url = query if url is None else url
    if kind == "search":
        return "\n".join(q for q in b.L(action, "queries") if isinstance(q, str)) or query
    if kind == "open_page":
        return url
    if kind == "find_in_page":
        pattern = S(action, "pattern") or ""
        return f"Find `{pattern}` in {url}" if pattern and url else pattern or url
    return b.compact(action)


class _Fold:
    """What has been said so far: turns with their models and counts, web
    searches that wait for their call, results that other results repeat."""

    def __init__(self, fallback: datetime):
        self.fallback, self.out = fallback, []
        self.turn: str | None = None
        self.models: dict[str, str] = {}
        self.counts: dict[str, dict] = {}
        self.last_text: dict[str, dict] = {}
        self.seen: set[str] = set()  # calls with a full result
        self.ended: dict[str, list[str]] = {}
        self.waiting: dict[str, list[dict]] = {}

    def push(self, role: str, blocks: list[dict], ts: datetime, mirror: bool = False) -> dict:
        model = self.models.get(self.turn) if role == "assistant" and self.turn is not None else None
        m = b.message(role, blocks, ts, model)
        self.out.append((m, mirror))
        return m

    def answer(self, p: Any, output: Any, ts: datetime, failed: bool = False, mirror: bool = False) -> None:
        if S(p, "call_id") is not None:
            if not mirror:
                self.seen.add(p["call_id"])
            self.push("user", [b.result(p["call_id"], output, failed)], ts, mirror)

    def event(self, p: Any, ts: datetime) -> None:
        kind, turn = S(p, "type"), S(p, "turn_id")
        if kind == "task_started":
            self.turn = turn
        elif kind == "task_complete" and turn in self.last_text:
            m = self.last_text[turn]
            m["model"] = self.models.get(turn, m["model"])
            m["usage"] = self.counts.get(turn, m["usage"])
        elif kind == "token_count" and self.turn is not None:
            u = b.at(p, "info", "last_token_usage")
            given, made = b.N(u, "input_tokens"), b.N(u, "output_tokens")
            if given is not None and made is not None:
                self.counts[self.turn] = b.usage(given, made, b.N(u, "cached_input_tokens"))
        elif kind == "exec_command_end":
            self.answer(p, exec_output(p), ts, (I(p, "exit_code") or 0) != 0)
        elif kind == "web_search_end" and S(p, "call_id") is not None:
            key = b.compact(p["action"]) if "action" in p else ""
            self.ended.setdefault(key, []).append(p["call_id"])
            if self.waiting.get(key):
                self.waiting[key].pop()["id"] = p["call_id"]
            self.answer(p, search_output(p), ts)

    def item(self, p: Any, ts: datetime) -> None:
        kind = S(p, "type")
        if kind == "message" and "content" in p:
            role, blocks = S(p, "role"), content_blocks(p["content"])
            if role == "assistant" and blocks:
                m = self.push(role, blocks, ts)
                if self.turn is not None:
                    self.last_text[self.turn] = m
            elif role == "user" and blocks and not is_setup(p["content"]):
                self.push(role, blocks, ts)
        elif kind == "reasoning" and (said := reasoning(p)) is not None:
            self.push("assistant", [b.thinking(said)], ts)
        elif kind in ("function_call", "custom_tool_call") and S(p, "call_id") is not None:
            custom = kind == "custom_tool_call"
            raw = p.get("input", {}) if custom else S(p, "arguments")
            value = b.loads(raw, raw) if isinstance(raw, str) else {} if raw is None and not custom else raw
            name, value = native_call(S(p, "name") or ("custom_tool" if custom else "tool"), value, custom)
            self.push("assistant", [b.call(p["call_id"], name, value)], ts)
        elif kind == "function_call_output":
            self.answer(p, S(p, "output") or "", ts, mirror=True)
        elif kind == "custom_tool_call_output":
            self.answer(p, *custom_output(S(p, "output") or "")[:1], ts, custom_output(S(p, "output") or "")[1])
        elif kind == "web_search_call":
            action = p.get("action")
            key, known = b.compact(action), S(p, "call_id")
            if known is None and self.ended.get(key):
                known = self.ended[key].pop()
            m = self.push("assistant", [b.call(known or f"web_search:{len(self.out)}", "WebSearch", action)], ts)
            if m["content"][0]["id"].startswith("web_search:"):
                self.waiting.setdefault(key, []).append(m["content"][0])

    def messages(self) -> list[dict]:
        """Without results that only mirror a full one."""
        return [m for m, mirror in self.out if not (mirror and m["content"][0]["id"] in self.seen)]


def to_messages(lines: list[dict], fallback: datetime) -> list[dict]:
    fold = _Fold(fallback)
    for line in lines:
        ts, p = b.when(line.get("timestamp")) or fallback, line.get("payload")
        if line["type"] == "turn_context":
            fold.turn = S(p, "turn_id")
            if fold.turn is not None and S(p, "model") is not None:
                fold.models[fold.turn] = p["model"]
        elif line["type"] == "event_msg":
            fold.event(p, ts)
        elif line["type"] == "response_item" and isinstance(p, dict):
            fold.item(p, ts)
    return fold.messages()


def to_lines(session: Session) -> list[dict]:
    meta, lines = session.meta, []

    def add(kind: str, payload: dict, ts: datetime) -> None:
        lines.append({"timestamp": b.iso(ts), "type": kind, "payload": payload})

    head = {
        "id": meta.id, "timestamp": b.iso(meta.timestamp), "cwd": meta.cwd or "", "cli_version": meta.cli_version or "",
        "originator": "codex_cli_rs", "source": "cli", "model_provider": "openai", "base_instructions": None,
    }
    add("session_meta", head | ({"git": {"branch": meta.git_branch}} if meta.git_branch is not None else {}), meta.timestamp)
    for i, m in enumerate(session.messages):
        ts, mine, turn = m["timestamp"], m["role"] == "assistant", f"turn-{i}"
        if mine:
            add("turn_context", {"turn_id": turn} | ({"model": m["model"]} if m["model"] is not None else {}), ts)
        content, said = [], []
        for x in m["content"]:
            kind = x["type"]
            if kind == "image":
                content.append({"type": "input_image", "image_url": b.image_url(x)})
            elif kind in ("text", "artifact"):
                said.append(x["text"] if kind == "text" else b.artifact_text(x))
                content.append({"type": "output_text" if mine else "input_text", "text": said[-1]})
            elif kind == "thinking":
                summary = [{"type": "summary_text", "text": x["text"]}]
                add("response_item", {"type": "reasoning", "summary": summary, "encrypted_content": None}, ts)
                add("event_msg", {"type": "agent_reasoning", "text": x["text"]}, ts)
            elif kind == "tool_use":
                add("response_item", {"type": "function_call", "name": x["name"], "arguments": b.compact(x["input"]), "call_id": x["id"]}, ts)
            else:
                add("response_item", {"type": "function_call_output", "call_id": x["id"], "output": b.output_text(x["output"])}, ts)
        if content:
            add("response_item", {"type": "message", "role": m["role"], "content": content}, ts)
        if said:
            shown = {"type": "agent_message"} if mine else {"type": "user_message", "kind": "plain"}
            add("event_msg", shown | {"message": "\n\n".join(said)}, ts)
        if mine and m["usage"]:
            u = m["usage"]
            last = {"input_tokens": u["input_tokens"], "output_tokens": u["output_tokens"], "cached_input_tokens": u["cache_read_input_tokens"] or 0}
            add("event_msg", {"type": "token_count", "info": {"last_token_usage": last}}, ts)
            add("event_msg", {"type": "task_complete", "turn_id": turn}, ts)
    return lines


class Codex(Format):
    name = "codex"
    glob = "rollout-*.[jJ][sS][oO][nN][lL]"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        lines = lines_of(unit.only)
        if not any(x["type"] == "session_meta" and S(x, "payload", "id") is not None for x in lines):
            return []
        meta = meta_of(lines, unit.mtime)
        meta.id = meta.id or unit.stem
        return [(meta, lines)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_lines(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        t = meta.timestamp
        return {f"{t:%Y/%m/%d}/rollout-{t:%Y-%m-%dT%H-%M-%S}-{b.safe_id(self.name, meta.id)}.jsonl": b.lines_text(body)}
