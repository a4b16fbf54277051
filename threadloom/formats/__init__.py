"""Native conversation formats and their common form, by name."""

from __future__ import annotations

from .amp import Amp
from .antigravity import Antigravity
from .base import Format, Json, Meta, Session, Unit, Unsupported
from .claude_chat import ClaudeChat
from .claude_code import ClaudeCode
from .codex import Codex
from .cowork import Cowork
from .cursor import Cursor
from .cursor_desktop import CursorDesktop
from .grok import Grok
from .hermes import Hermes
from .opencode import OpenCode
from .pi import Campfire, Pi
from .simple import Simple

FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        ClaudeCode(), ClaudeChat(), Cowork(), Codex(), OpenCode(), Pi(), Campfire(), Cursor(), CursorDesktop(), Grok(), Hermes(), Amp(), Antigravity(), Simple(),
    )
}

__all__ = ["FORMATS", "Format", "Json", "Meta", "Session", "Unit", "Unsupported", "convert", "get"]


def get(name: str) -> Format:
    """A format by its name or one of its other names."""
    from ..functions.vocab import HARNESS_ALIASES

    key = name.strip().lower()
    key = HARNESS_ALIASES.get(key, key)
    if key not in FORMATS:
        raise Unsupported(f"unknown format {name!r}")
    return FORMATS[key]


def convert(session: Session, to: str):
    """The native body of a conversation in another format."""
    return get(to).from_common(session)
