"""Thread documents, one JSON file each."""

from __future__ import annotations

import json
import re
from typing import Any
from urllib.parse import quote

from . import base as b
from .base import Format, I, Json, Meta, N, S, Session, Unit

SPACE = b.namespace("amp")
STOPS = {x: x for x in ("end_turn", "tool_use", "max_tokens", "stop_sequence", "error")}
_PATH = {"path": "file_path"}
#: native -> canonical name and keys
TOOLS: dict[str, tuple[str, dict[str, str]]] = {
    "Bash": ("Bash", {"cmd": "command", "cwd": "workdir"}),
    "shell_command": ("Bash", {}),
    "Read": ("Read", _PATH),
    "edit_file": ("Edit", _PATH | {"old_str": "old_string", "new_str": "new_string"}),
    "create_file": ("Write", _PATH),
    "glob": ("Glob", {"filePattern": "pattern"}),
    "todo_write": ("TodoWrite", {}),
    "todo_read": ("TodoRead", {}),
    "read_web_page": ("WebFetch", {"objective": "prompt"}),
}
_BACK = {name: (native, b.inverse(keys)) for native, (name, keys) in TOOLS.items() if native != "shell_command"}


def range_to_offset(value: Any, key: str = "read_range") -> Any:
    """``[first, last]`` as offset and limit, unless those are there."""
    pair = b.at(value, key)
    if not isinstance(pair, list) or len(pair) != 2 or "offset" in value or "limit" in value:
        return value
    first, last = N(pair[0]), N(pair[1])
    if first is None or last is None or not 1 <= first <= last:
        return value
    return {k: v for k, v in value.items() if k != key} | {"offset": first, "limit": last - first + 1}


def offset_to_range(value: Any) -> Any:
    """The inverse, which needs both halves."""
    first, count = N(value, "offset"), N(value, "limit")
    if not first or not count:
        return value
    return {k: v for k, v in value.items() if k not in ("offset", "limit")} | {"read_range": [first, first + count - 1]}


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    known, keys = TOOLS.get(name, (name, {}))
    value = b.rename(value, keys)
    return known, range_to_offset(value) if name == "Read" else value


def native_call(name: str, value: Any) -> tuple[str, Any]:
    known, keys = _BACK.get(name, (name, {}))
    value = b.rename(value, keys)
    return known, offset_to_range(value) if name == "Read" else value


def uri_to_path(uri: str | None) -> str | None:
    """The path of a file URI; a drive's gets its backslashes."""
    if uri is None or not uri.startswith("file://"):
        return None
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), uri[7:].encode())
    path = raw.decode("utf-8", "replace")
    return path[1:].replace("/", "\\") if re.match(r"/[A-Za-z]:(/|$)", path) else path


def path_to_uri(path: str) -> str:
    if re.match(r"[A-Za-z]:", path):
        path = "/" + path.replace("\\", "/")
    return "file://" + quote(path, safe="/-._~")


def thread_id(id_: str, seed: str = "") -> str:
    """``T-`` and at least eight letters, digits or hyphens."""
    return id_ if re.fullmatch(r"T-[A-Za-z0-9-]{8,}", id_) else "T-" + b.made_id(SPACE, id_ or seed)


def meta_of(doc: Any, fallback) -> Meta:
    start = b.at(doc, "env", "initial")
    tree = (b.L(start, "trees") or [None])[0]
    sent = [t for m in b.L(doc, "messages") if (t := I(m, "meta", "sentAt")) is not None]
    models = [x for m in b.L(doc, "messages") if (x := S(m, "usage", "model")) is not None]
    models += [t[6:] for t in b.L(start, "tags") if isinstance(t, str) and t.startswith("model:")]
    created, title, branch = I(doc, "created"), S(doc, "title"), S(tree, "repository", "ref")
    created = min(sent, default=None) if created is None else created
    return Meta(
        S(doc, "id") or "", b.from_ms(created) or fallback, uri_to_path(S(tree, "uri")),
        branch and branch.removeprefix("refs/heads/"), title if title and title.strip() else None,
        S(start, "platform", "clientVersion"), models[0] if models else None,
    )


def _blocks(m: Any) -> list[dict]:
    mine, content = S(m, "role") == "assistant", b.at(m, "content")
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    out = []
    for v in content if isinstance(content, list) else []:
        kind, source = S(v, "type"), b.at(v, "source")
        if kind == "text" and (S(v, "text") or "").strip():
            out.append(b.text(v["text"]))
        elif kind == "image" and S(source, "mediaType") is not None and S(source, "data") is not None:
            out.append(b.image(source["mediaType"], source["data"], S(source, "type") or "base64"))
        elif kind == "thinking" and mine and (S(v, "thinking") or "").strip():
            out.append(b.thinking(v["thinking"], S(v, "signature")))
        elif kind == "tool_use" and mine and S(v, "id") is not None and S(v, "name") is not None:
            out.append(b.call(v["id"], *canonical_call(v["name"], v.get("input", {}))))
        elif kind == "tool_result" and not mine and S(v, "toolUseID") is not None and "run" in v:
            out.append(b.result(v["toolUseID"], *run_output(v["run"])))
    return out


def run_output(run: Any) -> tuple[str | Json, bool]:
    """What a run gave, and whether it failed; cancelled and rejected ones did."""
    status, why = S(run, "status"), S(run, "reason")
    if status == "done":
        return b.as_output(run.get("result")), False
    if status == "error":
        e = run.get("error")
        told = e if isinstance(e, str) else S(e, "message")
        return ("Tool call failed" if "error" not in run else b.compact(e)) if told is None else told, True
    if status in ("cancelled", "rejected-by-user"):
        return status.replace("-", " ") if why is None else why, True
    return Json(run), False


def parse_state(state: Any) -> str | None:
    if S(state, "type") == "complete":
        return b.stop(S(state, "stopReason"), STOPS)
    return "aborted" if S(state, "type") == "cancelled" else None


def parse_usage(u: Any) -> dict | None:
    counts = [N(u, f"{k}Tokens") for k in ("input", "output", "cacheReadInput", "cacheCreationInput")]
    return b.usage(counts[0] or 0, counts[1] or 0, *counts[2:]) if any(counts) else None


def to_messages(doc: Any, fallback) -> list[dict]:
    """A message without a time has that of the last one before it, also of one
    that says nothing."""
    out, ts = [], fallback
    for m in b.L(doc, "messages"):
        role = S(m, "role")
        if role == "user":
            ts = b.from_ms(I(m, "meta", "sentAt")) or ts
            extra: tuple = ()
        elif role == "assistant":
            ts = b.when(S(m, "usage", "timestamp")) or ts
            extra = S(m, "usage", "model"), parse_state(m.get("state")), parse_usage(m.get("usage"))
        else:
            continue
        if blocks := _blocks(m):
            out.append(b.message(role, blocks, ts, *extra))
    return out


def _native(x: dict, mine: bool) -> dict | None:
    kind = x["type"]
    if kind in ("text", "artifact"):
        return {"type": "text", "text": x["text"] if kind == "text" else b.artifact_text(x)}
    if kind == "image":
        return {"type": "image", "source": {"type": x["encoding"], "data": x["data"], "mediaType": x["media_type"]}}
    if kind == "thinking" and mine:
        return {"type": "thinking", "thinking": x["text"]} | ({"signature": x["signature"], "provider": "anthropic"} if x["signature"] else {})
    if kind == "tool_use" and mine:
        name, value = native_call(x["name"], x["input"])
        return {"type": "tool_use", "complete": True, "id": x["id"], "name": name, "input": value}
    if kind == "tool_result" and not mine:
        out = x["output"]
        failed = {"status": "error", "error": {"message": b.output_text(out)}}
        return {"type": "tool_result", "toolUseID": x["id"], "run": failed if x["is_error"] else {"status": "done", "result": out.value if isinstance(out, Json) else out}}
    return None


def to_thread(session: Session) -> dict:
    meta, listed = session.meta, []
    for i, m in enumerate(session.messages):
        mine = m["role"] == "assistant"
        said: dict = {"role": m["role"], "messageId": i, "content": [v for x in m["content"] if (v := _native(x, mine))]}
        if mine:
            u = m["usage"] or b.usage(0, 0)
            read, written, model = u["cache_read_input_tokens"], u["cache_creation_input_tokens"], m["model"] or meta.model
            counts = {"model": model, "timestamp": b.iso(m["timestamp"]), "inputTokens": u["input_tokens"], "outputTokens": u["output_tokens"]}
            counts |= {"cacheReadInputTokens": read, "cacheCreationInputTokens": written, "maxInputTokens": 168_000}
            counts["totalInputTokens"] = u["input_tokens"] + (read or 0) + (written or 0)
            said["usage"] = {k: v for k, v in counts.items() if v is not None}
            why = m["stop_reason"] or "end_turn"
            said["state"] = {"type": "cancelled"} if why == "aborted" else {"type": "complete", "stopReason": why.removeprefix("other:")}
        elif all(x["type"] != "tool_result" for x in m["content"]):
            said["meta"] = {"sentAt": b.ms(m["timestamp"])}
        listed.append(said)
    start: dict = {}
    if meta.cwd:
        tree: dict = {"uri": path_to_uri(meta.cwd), "displayName": re.split(r"[/\\]", meta.cwd)[-1]}
        if meta.git_branch:
            tree["repository"] = {"type": "git", "ref": f"refs/heads/{meta.git_branch}"}
        start["trees"] = [tree]
    if meta.cli_version:
        start["platform"] = {"client": "CLI", "clientType": "cli", "clientVersion": meta.cli_version}
    doc = {"v": 1, "id": thread_id(meta.id, b.iso(meta.timestamp)), "created": b.ms(meta.timestamp), "agentMode": "smart"}
    doc |= {"nextMessageId": len(listed), "messages": listed}
    return doc | ({"title": meta.title} if meta.title else {}) | ({"env": {"initial": start}} if start else {})


class Amp(Format):
    name = "amp"
    glob = "*.json"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        doc = b.loads(unit.only, None)
        if not isinstance(b.at(doc, "messages"), list):
            return []
        meta = meta_of(doc, unit.mtime)
        meta.id = meta.id or unit.stem
        return [(meta, doc)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_thread(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        return {f"{b.safe_id(self.name, body['id'])}.json": json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False).encode()}
