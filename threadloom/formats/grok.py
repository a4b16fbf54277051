"""A folder a session: the model's log, the display log, and sidecar files.

The model's log has what was said; times, images, failures and reasons are in the
display log, matched by order: the n-th prompt there is the n-th here."""

from __future__ import annotations

import json
from typing import Any
from urllib.parse import quote

from . import base as b
from .base import Format, I, Json, Meta, N, S, Session, Unit

SPACE = b.namespace("grok")
STOPS = {x: x for x in ("end_turn", "tool_use", "max_tokens", "stop_sequence", "error")} | {"cancelled": "aborted"}
NAMES = {"Shell": "Bash", "StrReplace": "Edit"}
_PATH = {"path": "file_path"}
KEYS = {
    "Read": _PATH, "Write": _PATH | {"contents": "content"}, "Edit": _PATH, "MultiEdit": _PATH, "Bash": {"block_until_ms": "timeout_ms"},
    "Glob": {"glob_pattern": "pattern", "target_directory": "path"},
}
LOGS = ("chat_history", "updates", "events", "rewind_points")
DOCS = ("summary", "prompt_context", "resources_state", "signals")


def whole(v: Any) -> int | None:
    """An integer, also one written with a fraction of 0."""
    if isinstance(v, float) and v.is_integer() and 0 <= v <= 1 << 53:
        return int(v)
    return N(v)


def _renamed(value: Any, keys: dict[str, str]) -> Any:
    """Keys renamed in one go, so a pair of names can be exchanged."""
    return {keys.get(k, k): v for k, v in value.items()} if isinstance(value, dict) else value


def canonical_call(name: str, value: Any) -> tuple[str, Any]:
    name = NAMES.get(name, name)
    keys = KEYS.get(name, {})
    if name == "Bash" and isinstance(value, dict) and "block_until_ms" in value:
        least = whole(value["block_until_ms"])
        keys = {} if least is None else keys
        value = value if least is None else value | {"block_until_ms": least}
    return name, _renamed(value, keys)


def native_call(name: str, value: Any) -> tuple[str, Any]:
    return b.inverse(NAMES).get(name, name), _renamed(value, b.inverse(KEYS.get(name, {})))


def user_texts(content: Any) -> list[str]:
    if isinstance(content, str):
        return [content]
    return [v["text"] for v in content if S(v, "text") is not None] if isinstance(content, list) else []


def unwrapped(text: str) -> str:
    t = text.strip()
    inner = t.startswith("<user_query>") and t.endswith("</user_query>")
    return t[12:-13].strip() if inner else text


def update_time(line: Any):
    at = b.from_ms(I(line, "params", "_meta", "agentTimestampMs"))
    seconds = I(line, "timestamp")
    return at or (None if seconds is None else b.from_seconds(seconds))


class _Display:
    """What the display log adds, in its order."""

    def __init__(self, updates: list):
        self.prompts: list[dict] = []
        self.thoughts: list = []
        self.answers: list = []
        self.calls: dict = {}
        self.results: dict = {}
        self.failed: set[str] = set()
        self.stops: list[str] = []
        for line in updates:
            u, ts = b.at(line, "params", "update"), update_time(line)
            if u is not None and ts is not None:
                self.add(u, ts, len(updates))

    def add(self, u: Any, ts, most: int) -> None:
        kind, id_, status = S(u, "sessionUpdate"), S(u, "toolCallId"), S(u, "status")
        if kind == "user_message_chunk":
            shown = b.at(u, "content")
            picture = S(shown, "type") == "image"
            slot = N(u, "_meta", "promptIndex")
            if slot is None or slot > most:  # no log has so many prompts
                slot = max(0, len(self.prompts) - 1) if picture else len(self.prompts)
            while len(self.prompts) <= slot:
                self.prompts.append({"ts": None, "images": []})
            prompt = self.prompts[slot]
            prompt["ts"] = prompt["ts"] or ts
            if picture and S(shown, "mimeType") is not None and S(shown, "data") is not None:
                prompt["images"].append(b.image(shown["mimeType"], shown["data"]))
        elif kind == "agent_thought_chunk":
            self.thoughts.append(ts)
        elif kind == "agent_message_chunk":
            self.answers.append(ts)
        elif kind == "tool_call" and id_ is not None:
            self.calls.setdefault(id_, ts)
        elif kind == "tool_call_update" and id_ is not None and status in ("completed", "failed"):
            self.results[id_] = ts
            self.failed |= {id_} if status == "failed" else set()
        elif kind == "turn_completed":
            why = S(u, "stop_reason")
            self.stops.append(b.stop("end_turn" if why is None else why, STOPS))


def line_kind(line: dict) -> str:
    """Lines of a known kind with fields of another type are other."""
    kind = line.get("type")
    plain = {"assistant": ("model_id", "model_fingerprint"), "reasoning": ("id", "encrypted_content", "status")}.get(kind, ())
    if kind == "tool_result" and S(line, "tool_call_id") is None or any(line.get(k) is not None and S(line, k) is None for k in plain):
        return "other"
    return kind if kind in ("system", "user", "assistant", "reasoning", "tool_result") else "other"


def _said(line: dict) -> tuple[list[dict], str | None]:
    content = line.get("content")
    blocks = [b.text(content)] if isinstance(content, str) and content.strip() else []
    first = None
    for c in b.L(line, "tool_calls"):
        if S(c, "id") is not None:
            first = first or c["id"]
            raw = c.get("arguments", {})
            raw = b.loads(raw, raw) if isinstance(raw, str) else raw
            blocks.append(b.call(c["id"], *canonical_call(S(c, "name") or "tool", raw)))
    return blocks, first


def to_messages(body: dict, fallback) -> list[dict]:
    shown = _Display(body["updates"])
    prompts, thoughts, answers = iter(shown.prompts), iter(shown.thoughts), iter(shown.answers)
    out: list[dict] = []
    turns: list[dict | None] = []  # the last answer of each turn
    broken: set[int] = set()
    last, in_turn = None, False
    for line in body["chat_history"]:
        kind, content = line_kind(line), line.get("content")
        if kind == "user" and not any("<user_info>" in t for t in user_texts(content)):
            if isinstance(content, list):
                texts = [S(v, "text") or "" for v in content if S(v, "type") == "text"]
            else:
                texts = user_texts(content)
            blocks = [b.text(t) for t in map(unwrapped, texts) if t.strip()]
            if not blocks:
                continue
            if in_turn:
                turns.append(last)
                last = None
            if line.get("prior_turn_interrupt") is not None and turns:
                broken.add(len(turns) - 1)
            in_turn, prompt = True, next(prompts, None)
            out.append(b.message("user", blocks + (prompt["images"] if prompt else []), (prompt and prompt["ts"]) or fallback))
        elif kind == "assistant":
            blocks, first = _said(line)
            if blocks:
                ts = next(answers, None) if blocks[0]["type"] == "text" else shown.calls.get(first)
                out.append(b.message("assistant", blocks, ts or fallback, line.get("model_id")))
                last = out[-1]
        elif kind == "reasoning":
            parts = [e["text"] for e in b.L(line, "summary") if S(e, "type") == "summary_text" and S(e, "text") is not None]
            if parts:
                thought = b.thinking("\n\n".join(parts), None, line.get("encrypted_content"))
                out.append(b.message("assistant", [thought], next(thoughts, None) or fallback))
        elif kind == "tool_result":
            id_, value = line["tool_call_id"], "" if content is None else b.as_output(content)
            out.append(b.message("user", [b.result(id_, value, id_ in shown.failed)], shown.results.get(id_) or fallback))
    if in_turn:
        turns.append(last)
    for n, m in enumerate(turns):
        if m is not None:
            m["stop_reason"] = shown.stops[n] if n < len(shown.stops) else "aborted" if n in broken else None
    return out


def meta_of(body: dict, fallback) -> Meta:
    """The summary; what it lacks from the logs."""
    s = body["summary"]
    texts = [t for x in body["chat_history"] if line_kind(x) == "user" for t in user_texts(x.get("content"))]
    places = (x.removeprefix("Workspace Path: ") for t in texts for x in t.splitlines() if x.startswith("Workspace Path: "))
    models = (x["model_id"] for x in body["chat_history"] if line_kind(x) == "assistant" and x.get("model_id") is not None)
    times = (t for x in body["updates"] if (t := update_time(x)))
    return Meta(
        S(s, "info", "id") or "", b.when(S(s, "created_at")) or next(times, None) or fallback,
        S(s, "info", "cwd") or next(places, None), S(s, "head_branch") or None,
        S(s, "generated_title") or S(s, "session_summary") or None, None, S(s, "current_model_id") or next(models, None),
    )


def flat(output: str | Json) -> str:
    """Blocks that are all text as their texts, else compact JSON."""
    v = output.value if isinstance(output, Json) else None
    if isinstance(v, list) and v and all(S(x, "type") == "text" and S(x, "text") is not None for x in v):
        return "\n\n".join(x["text"] for x in v)
    return b.output_text(output)


_KINDS = {"Read": "read", "Write": "edit", "StrReplace": "edit", "MultiEdit": "edit", "Shell": "execute", "Glob": "search", "Grep": "search"}
_TITLES = {"Read": ("Read `{}`", "path"), "Write": ("Edit `{}`", "path"), "StrReplace": ("Edit `{}`", "path"), "Shell": ("Execute `{}`", "command"),
           "Glob": ("Glob `{}`", "glob_pattern"), "Grep": ("{}", "pattern")}


def to_body(session: Session) -> dict:
    meta = session.meta
    sid = meta.id or b.made_id(SPACE, b.iso(meta.timestamp))
    chat: list[dict] = []
    log: list[dict] = []
    turn, is_open, why = 0, False, None

    def show(ts, event: str, method: str = "session/update", **more: Any) -> None:
        at = {"eventId": f"{sid}-{len(log)}", "agentTimestampMs": b.ms(ts)}
        params = {"sessionId": sid, "update": {"sessionUpdate": event} | more, "_meta": at}
        log.append({"timestamp": b.ms(ts) // 1000, "method": method, "params": params})

    def close(ts) -> None:
        nonlocal turn
        done = b.stop_word(why, b.inverse(STOPS), None) or "end_turn"
        show(ts, "turn_completed", "_x.ai/session/update", prompt_id=b.made_id(SPACE, sid, "prompt", turn), stop_reason=done)
        turn += 1

    for i, m in enumerate(session.messages):
        ts, mine = m["timestamp"], m["role"] == "assistant"
        said, pictures, calls = [], [], []
        for j, x in enumerate(m["content"]):
            kind = x["type"]
            if kind in ("text", "artifact"):
                said.append(x["text"] if kind == "text" else b.artifact_text(x))
            elif kind == "image" and not mine:
                pictures.append(x)
            elif kind == "tool_result" and not mine:
                text = flat(x["output"])
                chat.append({"type": "tool_result", "tool_call_id": x["id"], "content": text})
                shown = [{"type": "content", "content": {"type": "text", "text": text}}]
                show(ts, "tool_call_update", toolCallId=x["id"], status="failed" if x["is_error"] else "completed", content=shown)
            elif kind == "thinking" and mine:
                thought = {"type": "reasoning", "id": f"rs_{b.made_id(SPACE, sid, i, j)}", "status": "completed"}
                thought["summary"] = [{"type": "summary_text", "text": x["text"]}]
                chat.append(thought | ({} if x["encrypted"] is None else {"encrypted_content": x["encrypted"]}))
                show(ts, "agent_thought_chunk", content={"type": "text", "text": x["text"]})
            elif kind == "tool_use" and mine:
                calls.append((x["id"], *native_call(x["name"], x["input"])))
        if mine and (said or calls):
            line: dict = {"type": "assistant", "content": "\n\n".join(said)}
            if calls:
                line["tool_calls"] = [{"id": c, "name": n, "arguments": v if isinstance(v, str) else b.compact(v)} for c, n, v in calls]
            chat.append(line | ({} if m["model"] is None else {"model_id": m["model"]}))
            if line["content"]:
                show(ts, "agent_message_chunk", content={"type": "text", "text": line["content"]})
            for c, n, v in calls:
                form, key = _TITLES.get(n, ("{}", ""))
                named = form.format(v[key]) if S(v, key) is not None else n
                show(ts, "tool_call", toolCallId=c, title=named, kind=_KINDS.get(n, "other"), rawInput=v)
            why = m["stop_reason"]
        elif not mine and (said or pictures):
            if is_open:
                close(ts)
            text = "\n\n".join(said or ["[image]"])
            wrapped = text if text.lstrip().startswith("<user_query>") else f"<user_query>\n{text}\n</user_query>"
            chat.append({"type": "user", "content": [{"type": "text", "text": wrapped}]} | ({"prior_turn_interrupt": "mid_turn_abort"} if is_open and why == "aborted" else {}))
            is_open, why = True, None
            about = ({} if meta.model is None else {"modelId": meta.model}) | {"promptIndex": turn}
            show(ts, "user_message_chunk", content={"type": "text", "text": text}, _meta=about)
            for p in pictures:
                show(ts, "user_message_chunk", content={"type": "image", "data": p["data"], "mimeType": p["media_type"]}, _meta=about)
    if is_open:
        close(session.messages[-1]["timestamp"])
    at = meta.timestamp.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    summary = {"info": {"id": sid, "cwd": meta.cwd or ""}, "session_summary": meta.title or "", "generated_title": meta.title or ""}
    summary |= {"created_at": at, "updated_at": at, "num_messages": len(log), "num_chat_messages": len(chat), "chat_format_version": 1}
    summary |= {"current_model_id": meta.model or ""} | ({} if meta.git_branch is None else {"head_branch": meta.git_branch})
    return dict.fromkeys(DOCS) | {"chat_history": chat, "updates": log, "events": [], "rewind_points": [], "system_prompt": None, "summary": summary}


class Grok(Format):
    name = "grok"
    glob = "*.{jsonl,json,txt}"
    units = "folder"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        if not {"updates.jsonl", "chat_history.jsonl"} & set(unit.files):
            return []
        body: dict = {n: b.json_lines(unit.files.get(f"{n}.jsonl", b"").decode()) for n in LOGS}
        body |= {n: b.loads(unit.files[f"{n}.json"], None) if f"{n}.json" in unit.files else None for n in DOCS}
        prompt = unit.files.get("system_prompt.txt")
        body["system_prompt"] = prompt and prompt.decode()
        meta = meta_of(body, unit.mtime)
        meta.id = meta.id or unit.source.rstrip("/").rsplit("/", 1)[-1]
        return [(meta, body)]

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        return to_messages(body, meta.timestamp)

    def from_common(self, session: Session) -> Any:
        return to_body(session)

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        id_ = S(body["summary"], "info", "id") or meta.id
        folder = f"{quote(meta.cwd or '', safe='-._~')}/{b.safe_id(self.name, id_)}"
        out = {f"{folder}/{n}.jsonl": b.lines_text(body[n]) for n in LOGS if body[n] or n in LOGS[:2]}
        out |= {f"{folder}/{n}.json": json.dumps(body[n], indent=2, sort_keys=True).encode() for n in DOCS if body[n] is not None}
        return out | ({f"{folder}/system_prompt.txt": body["system_prompt"].encode()} if body["system_prompt"] is not None else {})
