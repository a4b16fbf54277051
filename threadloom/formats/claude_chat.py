"""Saved conversation responses of the web application; read only."""

from __future__ import annotations

from typing import Any

from . import base as b
from .base import Format, Meta, N, S, Unit

SPACE = b.namespace("claude_chat")
STOPS = {
    "end_turn": "end_turn", "stop": "end_turn", "tool_use": "tool_use", "max_tokens": "max_tokens", "length": "max_tokens",
    "stop_sequence": "stop_sequence", "aborted": "aborted", "cancelled": "aborted", "error": "error",
}
NAMES = {n: "Bash" for n in ("bash", "bash_tool", "shell", "shell_command", "run_terminal_cmd")}
NAMES |= {"read_file": "Read", "view": "Read", "create_file": "Write", "write_file": "Write", "edit_file": "Edit", "str_replace": "Edit"}
KEYS = {
    "Bash": [("cmd", "command"), ("cwd", "workdir")],
    "Read": [("path", "file_path")],
    "Write": [("path", "file_path"), ("file_text", "content")],
    "Edit": [("path", "file_path"), ("old_str", "old_string"), ("oldText", "old_string"), ("new_str", "new_string"), ("newText", "new_string")],
}
DEPTH = 24


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    """A key is renamed only where its new name is free; what the page shows
    beside a file tool goes."""
    name = NAMES.get(name, name)
    if not isinstance(value, dict):
        return name, value
    value = dict(value)
    for old, new in KEYS.get(name, []):
        b.rename_free(value, old, new)
    if name in ("Read", "Write"):
        value.pop("description", None)
    if name == "Read":
        pair = value.pop("view_range", None)
        ends = [N(x) for x in pair[:2]] if isinstance(pair, list) and len(pair) > 1 else [None]
        if None not in ends:
            value.setdefault("offset", ends[0])
            value.setdefault("limit", max(0, ends[1] - ends[0]) + 1)
    return name, value


def _either(v: Any, *keys: str) -> Any:
    """The value of the first key that is there."""
    return next((v[k] for k in keys if isinstance(v, dict) and k in v), None)


def _full(v: Any) -> str | None:
    return v if isinstance(v, str) and v.strip() else None


def _model(v: Any) -> str | None:
    return v if isinstance(v, str) else S(v, "id")


def parse_usage(v: Any) -> dict | None:
    def count(*keys: str) -> int | None:
        return next((n for k in keys if (n := N(v, k)) is not None), None)

    given, made = count("input_tokens", "inputTokens"), count("output_tokens", "outputTokens")
    if given is None or made is None:
        return None
    return b.usage(given, made, count("cache_read_input_tokens", "cacheReadInputTokens"), count("cache_creation_input_tokens", "cacheCreationInputTokens"))


def active_path(doc: dict) -> list:
    """Messages from the root to the current leaf.  A loop or a missing message
    anywhere on the way gives all messages, in the server's order."""
    listed, leaf = b.L(doc, "chat_messages"), S(doc, "current_leaf_message_uuid")
    known = {m["uuid"]: m for m in listed if S(m, "uuid") is not None}
    path, seen, here = [], set(), leaf or None
    while here is not None:
        if here in seen or here not in known:
            return listed
        seen.add(here)
        path.append(known[here])
        here = S(known[here], "parent_message_uuid") or None
    return path[::-1] if path else listed


class _Reader:
    def __init__(self, doc: dict):
        self.doc = doc
        kept = {k.rsplit("_", 1)[-1]: v for k, v in doc.items() if k.startswith("$") and isinstance(v, dict)}
        self.images, self.files = kept.get("images", {}), kept.get("files", {})

    def made_id(self, m: Any, n: int, kind: str) -> str:
        return b.made_id(SPACE, S(self.doc, "uuid") or "unknown", S(m, "uuid") or "unknown", n, kind)

    def block(self, m: Any, v: Any, n: int, role: str, last_call: str | None) -> tuple[str, dict] | None:
        kind = S(v, "type")
        if kind == "text" and _full(v.get("text")):
            return role, b.text(v["text"])
        if kind in ("thinking", "reasoning") and _full(_either(v, "thinking", "text")):
            return "assistant", b.thinking(_either(v, "thinking", "text"), S(v, "signature"), S(v, "encrypted_content"))
        if kind == "tool_use" and S(v, "name") is not None:
            return "assistant", b.call(S(v, "id") or self.made_id(m, n, "call"), *canonical_call(v["name"], v.get("input", {})))
        if kind == "tool_result":
            told = _either(v, "tool_use_id", "toolUseID")
            id_ = (told if isinstance(told, str) else None) or last_call or self.made_id(m, n, "result")
            failed = _either(v, "is_error", "isError") is True or v.get("error") is not None or S(v, "status") in ("error", "failed")
            return "user", b.result(id_, b.as_output(_either(v, "content", "output", "result")), failed)
        if kind == "image":
            source = v.get("source", v)
            media = _either(source, "media_type", "mediaType")
            if isinstance(media, str) and S(source, "data") is not None:
                return role, b.image(media, source["data"], S(source, "type") or "base64")
        if kind in ("artifact", "document") and (found := self.artifact(m, v, n)):
            return "assistant", found
        return None

    def artifact(self, m: Any, v: dict, n: int) -> dict | None:
        id_, name = S(v, "id") or self.made_id(m, n, "artifact"), _full(_either(v, "title", "name")) or "artifact"
        source = v.get("source")
        media = next((x for x in (_either(source, "media_type", "mediaType"), _either(v, "media_type", "mime_type")) if x is not None), None)
        media = media if isinstance(media, str) else None
        if S(source, "data") is not None:
            return b.artifact(id_, name, "text" if S(source, "type") == "text" else "base64", source["data"], media)
        text = _either(v, "content", "text")
        return b.artifact(id_, name, "text", text, media or "text/plain") if isinstance(text, str) else None

    def presented(self, v: Any, seen: set[str], depth: int = 0) -> list[dict]:
        """Files that a result names and that were fetched beside it."""
        if depth > DEPTH or not isinstance(v, (dict, list)):
            return []
        out = []
        if isinstance(v, dict) and S(v, "type") == "local_resource" and (id_ := S(v, "uuid")) is not None and id_ not in seen:
            seen.add(id_)
            file = self.files.get(id_)
            if S(file, "data") is not None:
                named = next((x for x in (file.get("file_name"), v.get("name"), file.get("name")) if x is not None), None)
                media = next((x for x in (file.get("media_type"), v.get("mime_type"), v.get("media_type")) if x is not None), None)
                out.append(b.artifact(id_, _full(named) or "artifact", "base64", file["data"], media if isinstance(media, str) else None))
        for x in v.values() if isinstance(v, dict) else v:
            out += self.presented(x, seen, depth + 1)
        return out

    def pictures(self, m: Any) -> list[dict]:
        out, seen = [], set()
        for listed in ("files", "files_v2", "attachments"):
            for file in b.L(m, listed):
                for key in (S(file, k) for k in ("uuid", "id", "preview_url", "thumbnail_url")):
                    v = self.images.get(key) if key is not None else None
                    if all(S(v, k) is not None for k in ("type", "media_type", "data")):
                        if key not in seen:
                            out.append(b.image(v["media_type"], v["data"], v["type"]))
                        seen.add(key)
                        break
        return out

    def parts(self, m: Any, role: str) -> list[tuple[str, dict]]:
        """(role, block) of one native message."""
        out, said, last_call = [], set(), None
        for n, v in enumerate(b.L(m, "content")):
            if S(v, "type") == "text" and S(v, "text") is not None:
                said.add(v["text"].strip())
            found = self.block(m, v, n, role, last_call)
            if found:
                out.append(found)
                last_call = found[1]["id"] if found[1]["type"] == "tool_use" else last_call
            if S(v, "type") == "tool_result":
                value = _either(v, "content", "output", "result")
                value = b.loads(value, None) if isinstance(value, str) else value
                out += [("assistant", x) for x in self.presented(value, set())]
        text = _full(b.at(m, "text"))
        if text and text.strip() not in said:
            out.append((role, b.text(text)))
        return out + [(role, x) for x in self.pictures(m)]

    def messages(self, meta: Meta) -> list[dict]:
        out, ts = [], meta.timestamp
        for m in active_path(self.doc):
            role = {"human": "user", "user": "user", "assistant": "assistant"}.get(S(m, "sender") or "")
            if role is None:
                continue
            ts = b.when(S(m, "created_at")) or ts
            mine: list[dict] = []
            for who, block in self.parts(m, role):
                if not mine or mine[-1]["role"] != who:
                    mine.append(b.message(who, [], ts))
                mine[-1]["content"].append(block)
            last = next((x for x in reversed(mine) if x["role"] == "assistant"), None)
            if last:
                own, why = _model(m.get("model")), _either(m, "stop_reason", "stopReason")
                last["model"] = own if own is not None else _model(self.doc.get("model"))
                last["usage"], last["stop_reason"] = parse_usage(m.get("usage")), b.stop(why if isinstance(why, str) else None, STOPS)
            out += mine
        return out


def meta_of(doc: dict, fallback) -> Meta:
    at = b.when(S(doc, "created_at")) or b.when(S(doc, "updated_at")) or fallback
    return Meta(_full(doc.get("uuid")) or "", at, title=_full(doc.get("name")) or _full(doc.get("summary")), model=_model(doc.get("model")))


class ClaudeChat(Format):
    name = "claude_chat"
    glob = "*.json"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        doc = b.loads(unit.only, None)
        if not isinstance(b.at(doc, "chat_messages"), list) or S(doc, "uuid") is None:
            return []
        return [(meta_of(doc, unit.mtime), doc)]

    def cursors(self, unit: Unit) -> dict[str, str]:
        return {meta.id: S(doc, "updated_at") or "" for meta, doc in self.sessions(unit)}

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return _Reader(body).messages(meta)
