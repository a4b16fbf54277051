"""The canonical conversation, and what all formats share.

A message is a dict: ``role`` (user or assistant), ``content`` (blocks),
``timestamp`` (UTC), ``model``, ``stop_reason``, ``usage``; the last three may be
None.  A block has a ``type``:

* ``text``: text
* ``thinking``: text, signature, encrypted
* ``tool_use``: id, name, input (canonical name and keys)
* ``tool_result``: id, output (a string, or ``Json`` around another value), is_error
* ``image``: media_type, data, encoding
* ``artifact``: id, name, kind (text, base64, path), value, media_type

A stop reason outside the canonical ones is ``other:`` and the native word, so a
native "end_turn" of another meaning isn't taken for the canonical one.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from typing import Any

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
STOPS = ("end_turn", "tool_use", "max_tokens", "stop_sequence", "aborted", "error")


class Unsupported(ValueError):
    """The format can't hold, or can't be asked for, what was wanted."""


@dataclass(frozen=True)
class Json:
    """A tool's output that isn't plain text."""

    value: Any


@dataclass
class Meta:
    id: str = ""
    timestamp: datetime = EPOCH
    cwd: str | None = None
    git_branch: str | None = None
    title: str | None = None
    cli_version: str | None = None
    model: str | None = None


@dataclass
class Session:
    """A conversation with its header, in canonical form."""

    meta: Meta
    messages: list[dict] = field(default_factory=list)


class Format:
    """One native format.  ``units`` says which files make a session: each by
    itself, those of one folder, or a database with many sessions."""

    name = ""
    glob = "*.json"
    units = "file"

    def sessions(self, unit: Unit) -> list[tuple[Meta, Any]]:
        """Header and native body of each session of a unit."""
        raise NotImplementedError

    def to_common(self, meta: Meta, body: Any) -> list[dict]:
        raise NotImplementedError

    def from_common(self, session: Session) -> Any:
        raise Unsupported(f"{self.name} can't be written")

    def render(self, meta: Meta, body: Any) -> dict[str, bytes]:
        """Files of a native session, by path below the store's root."""
        raise Unsupported(f"{self.name} can't be written")


@dataclass
class Unit:
    """Files that are read together: name -> bytes, with their place and time."""

    source: str
    files: dict[str, bytes]
    mtime: datetime = EPOCH

    @property
    def stem(self) -> str:
        return self.source.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    @property
    def only(self) -> str:
        return next(iter(self.files.values())).decode("utf-8")


# Values without coercion: None for another type.


def S(v: Any, *path: str) -> str | None:
    v = at(v, *path)
    return v if isinstance(v, str) else None


def N(v: Any, *path: str) -> int | None:
    """An integer that isn't negative."""
    v = at(v, *path)
    return v if isinstance(v, int) and not isinstance(v, bool) and 0 <= v < 1 << 64 else None


def I(v: Any, *path: str) -> int | None:  # noqa: E743
    v = at(v, *path)
    return v if isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63 else None


def B(v: Any, *path: str) -> bool | None:
    v = at(v, *path)
    return v if isinstance(v, bool) else None


def L(v: Any, *path: str) -> list:
    v = at(v, *path)
    return v if isinstance(v, list) else []


def at(v: Any, *path: str) -> Any:
    for k in path:
        v = v.get(k) if isinstance(v, dict) else None
    return v


def _constant(name: str) -> Any:
    raise ValueError(name)


_MISSING = object()


def loads(text: str | bytes, default: Any = _MISSING) -> Any:
    """Strict JSON; ``default`` (if given) instead of an error."""
    try:
        value = json.loads(text, parse_constant=_constant)
        if "\\ud" in text.lower() if isinstance(text, str) else b"\\ud" in text.lower():
            json.dumps(value, ensure_ascii=False).encode("utf-8")  # half a surrogate pair isn't text
        return value
    except (ValueError, RecursionError):
        if default is _MISSING:
            raise
        return default


def compact(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def json_lines(text: str) -> list[dict]:
    """Objects of a text with one to a line; blank and broken lines are skipped."""
    rows = (loads(line, None) for line in text.split("\n") if line.strip())
    return [r for r in rows if isinstance(r, dict)]


def lines_text(rows: list[dict]) -> bytes:
    return "".join(compact(r) + "\n" for r in rows).encode()


_TS = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)")


def when(text: str | None) -> datetime | None:
    """A time with its zone, or None."""
    if not isinstance(text, str) or not _TS.fullmatch(text.strip()):
        return None
    try:
        return datetime.fromisoformat(text.strip().upper()).astimezone(UTC)
    except (ValueError, OverflowError):
        return None


def from_ms(ms: int | None) -> datetime | None:
    try:
        return None if ms is None else EPOCH + timedelta(milliseconds=ms)
    except OverflowError:
        return None


def from_seconds(x: Any) -> datetime | None:
    """A time from seconds with a fraction, rounded to a microsecond; nothing
    from what isn't finite."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return None
    try:
        return EPOCH + timedelta(microseconds=round(x * 1e6))
    except (OverflowError, ValueError):
        return None


def ms(t: datetime) -> int:
    return (t - EPOCH) // timedelta(milliseconds=1)


def iso(t: datetime) -> str:
    """To the millisecond, as most formats write it."""
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def namespace(name: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"threadloom:{name}")


def made_id(space: uuid.UUID, *parts: Any) -> str:
    return str(uuid.uuid5(space, ":".join(map(str, parts))))


def message(role: str, content: list[dict], timestamp: datetime, model=None, stop_reason=None, usage=None) -> dict:
    return {"role": role, "content": content, "timestamp": timestamp, "model": model, "stop_reason": stop_reason, "usage": usage}


def text(value: str) -> dict:
    return {"type": "text", "text": value}


def thinking(value: str, signature: str | None = None, encrypted: str | None = None) -> dict:
    return {"type": "thinking", "text": value, "signature": signature, "encrypted": encrypted}


def image(media_type: str, data: str, encoding: str = "base64") -> dict:
    return {"type": "image", "media_type": media_type, "data": data, "encoding": encoding}


def artifact(id_: str, name: str, kind: str, value: str, media_type: str | None = None) -> dict:
    return {"type": "artifact", "id": id_, "name": name, "kind": kind, "value": value, "media_type": media_type}


def result(id_: str, output: str | Json, is_error: bool = False) -> dict:
    return {"type": "tool_result", "id": id_, "output": output, "is_error": is_error}


def call(id_: str, name: str, value: Any) -> dict:
    return {"type": "tool_use", "id": id_, "name": name, "input": typed_input(name, value)}


#: kind -> {key: (type, whether it must be there)}
_EDIT = {"old_string": ("str", True), "new_string": ("str", True), "replace_all": ("flag", False)}
SHAPES: dict[str, dict[str, tuple[str, bool]]] = {
    "Command": {"args": ("str", False)},
    "Read": {"file_path": ("str", True), "offset": ("count", False), "limit": ("count", False)},
    "Write": {"content": ("str", True), "file_path": ("str", True)},
    "Edit": {"file_path": ("str", True), **_EDIT},
    "MultiEdit": {"edits": ("edits", True), "file_path": ("str", True)},
    "Bash": {
        "command": ("str", True), "description": ("str", False), "run_in_background": ("flag", False),
        "timeout_ms": ("count", False), "workdir": ("str", False),
    },
}


def _fits(value: Any, shape: dict[str, tuple[str, bool]]) -> bool:
    if not isinstance(value, dict) or any(k not in shape for k in value):
        return False
    for key, (kind, needed) in shape.items():
        x = value.get(key)
        if x is None and not (kind == "flag" and key in value):
            if needed:
                return False
        elif kind == "str" and not isinstance(x, str):
            return False
        elif kind == "count" and N(x) is None:
            return False
        elif kind == "flag" and not isinstance(x, bool):
            return False
        elif kind == "edits" and not (isinstance(x, list) and all(_fits(e, _EDIT) for e in x)):
            return False
    return True


def tool_kind(name: str, value: Any) -> str:
    """The typed tool that a call is, if its input has the keys and types of it
    and no others; else Raw.  A name that begins with a slash is a command."""
    kind = "Command" if name.startswith("/") else name
    return kind if kind in SHAPES and _fits(value, SHAPES[kind]) and (kind != "Command" or name.startswith("/")) else "Raw"


def typed_input(name: str, value: Any) -> Any:
    """The input as its type writes it: no absent values, no flags that are off."""
    if tool_kind(name, value) == "Raw":
        return value

    def lean(d: dict) -> dict:
        return {k: [lean(e) for e in x] if k == "edits" else x for k, x in d.items() if x is not None and x is not False}

    return lean(value)


def rename(value: Any, names: dict[str, str]) -> Any:
    """Keys renamed; a key that has the new name is overwritten."""
    if not isinstance(value, dict):
        return value
    value = dict(value)
    for old, new in names.items():
        if old in value:
            value[new] = value.pop(old)
    return value


def rename_free(value: dict, old: str, new: str) -> None:
    """Renames a key unless the new name is taken."""
    if old in value and new not in value:
        value[new] = value.pop(old)


def inverse(names: dict[str, str]) -> dict[str, str]:
    return {b: a for a, b in names.items()}


def title_case(name: str) -> str:
    return name[:1].upper() + name[1:]


def output_text(output: str | Json) -> str:
    return output if isinstance(output, str) else compact(output.value)


def as_output(value: Any) -> str | Json:
    return value if isinstance(value, str) else Json(value)


def artifact_text(block: dict) -> str:
    """What stands for an artifact in formats without one."""
    head = f"[artifact: {block['name']}]"
    return {"text": f"{head}\n{block['value']}", "path": f"{head} {block['value']}"}.get(block["kind"], head)


def data_url(url: str | None) -> dict | None:
    """An image block from ``data:<type>;base64,<data>``."""
    head, comma, data = (url or "").partition(",")
    if not comma or not head.startswith("data:") or not head.endswith(";base64"):
        return None
    return image(head[5:-7], data)


def image_url(block: dict) -> str:
    return f"data:{block['media_type']};{block['encoding']},{block['data']}"


def usage(given: int, made: int, read: int | None = None, written: int | None = None) -> dict:
    return {"input_tokens": given, "output_tokens": made, "cache_read_input_tokens": read, "cache_creation_input_tokens": written}


def stop(native: str | None, known: dict[str, str]) -> str | None:
    return None if native is None else known.get(native, f"other:{native}")


def stop_word(reason: str | None, known: dict[str, str], default: str | None) -> str | None:
    """The native word of a canonical reason; others keep theirs if there is no
    default for them."""
    if reason in known:
        return known[reason]
    if reason is not None and default is None:
        return reason.removeprefix("other:")
    return default


def truncate(value: str, most: int = 80) -> str:
    """One line of at most ``most`` characters."""
    line = " ".join(value.split())
    return line if len(line) <= most else line[: most - 1] + "…"


def first_user_text(messages: list[dict]) -> str | None:
    for m in messages:
        for b in m["content"] if m["role"] == "user" else ():
            if b["type"] == "text" and b["text"].strip():
                return b["text"]
    return None


def safe_id(name: str, id_: str) -> str:
    """``id_`` if it can be part of a path."""
    if not id_ or id_ in (".", "..") or re.search(r"[/\\:\x00-\x1f\x7f]", id_):
        raise Unsupported(f"{name}: {id_!r} can't be part of a path")
    return id_


def with_meta(meta: Meta, **changes: Any) -> Meta:
    return replace(meta, **changes)
