"""Functions for the driver: what a user types, and what is shown of an edit."""

from __future__ import annotations

import difflib
import shlex
from datetime import UTC, date, datetime, time
from zoneinfo import ZoneInfo


def parse_when(text: str, zone: str = "UTC", end: bool = False) -> datetime:
    """A time with its zone, or a day: its first second, with ``end`` its last, in
    ``zone``."""
    text = text.strip()
    try:
        day = date.fromisoformat(text) if len(text) == 10 else None
        if day is not None:
            return datetime.combine(day, time(23, 59, 59) if end else time(), ZoneInfo(zone)).astimezone(UTC)
        found = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"{text!r} is neither a day nor a time with a zone") from e
    if found.tzinfo is None:
        raise ValueError(f"{text!r} has no zone")
    return found.astimezone(UTC)


def resume_command(template: str, id_: str) -> list[str]:
    """The words of a command with ``{id}`` put in afterwards, so that an id is never
    more than part of one word."""
    return [word.replace("{id}", id_) for word in shlex.split(template)]


def unified_diff(path: str, old: str, new: str) -> tuple[str, int, int]:
    """An edit as a diff, and how many lines it adds and takes."""
    rows = list(difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{path}", f"b/{path}", lineterm=""))
    body = rows[2:]
    return "\n".join(rows), sum(r.startswith("+") for r in body), sum(r.startswith("-") for r in body)
