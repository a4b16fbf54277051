"""Vocabularies of the session formats, as literal maps and dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HARNESSES = (
    "claude_code", "codex", "opencode", "pi", "campfire", "cursor", "cursor_desktop",
    "grok", "hermes", "amp", "antigravity", "simple", "cowork", "claude_chat",
)

_MORE = {
    "claude_code": "claude claude-code claudecode cc", "claude_chat": "claude-chat claude_web claude-web", "opencode": "open_code open-code",
    "cursor": "cursor_cli cursor-cli cursorcli", "cursor_desktop": "cursor-desktop cursordesktop cursor_ide cursor-ide",
    "grok": "grok_cli grok-cli grokcli grok_build grok-build", "hermes": "hermes_agent hermes-agent hermesagent", "amp": "ampcode amp_code amp-code",
    "antigravity": "agy antigravity_cli antigravity-cli anti-gravity", "simple": "simple_json simple-json",
    "cowork": "claude_cowork claude-cowork claude_desktop claude-desktop",
}
ALIASES = {h: h for h in HARNESSES} | {a: h for h, more in _MORE.items() for a in more.split()}
HARNESS_ALIASES = ALIASES


def _tools() -> list[tuple[str, str, str]]:
    """(format, native tool, canonical tool) of tools that are renamed whatever
    their input; other names pass through."""
    from ..formats import FORMATS, amp, claude_chat, grok, opencode, pi

    maps = {"opencode": opencode.NAMES, "pi": pi.NAMES, "campfire": pi.NAMES, "grok": grok.NAMES, "claude_chat": claude_chat.NAMES}
    maps["amp"] = {n: c for n, (c, _) in amp.TOOLS.items()}
    maps["codex"] = {"exec_command": "Bash", "shell": "Bash"}
    maps["hermes"] = {"read_file": "Read", "write_file": "Write", "terminal": "Bash"}
    maps |= {h: FORMATS[h].names for h in FORMATS if hasattr(FORMATS[h], "names")}
    return [(h, n, c) for h, names in maps.items() for n, c in names.items()]


def _stops() -> list[tuple[str, str, str]]:
    """(format, native reason, canonical reason)."""
    from ..formats import amp, claude_chat, claude_code, grok, hermes, opencode, pi

    maps = {"claude_code": claude_code, "cowork": claude_code, "opencode": opencode, "pi": pi, "campfire": pi, "grok": grok, "hermes": hermes, "amp": amp, "claude_chat": claude_chat}
    return [(h, n, c) for h, m in maps.items() for n, c in m.STOPS.items()]


TOOLS = _tools()
STOPS = _stops()


def dimension(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A vocabulary as a table; a few dozen rows fixed in code, so a broadcast
    of it never grows with data."""
    return F.broadcast(spark.createDataFrame(rows, "harness string, native string, canonical string"))


def harness_of(c: Column) -> Column:
    """Canonical name of a format or alias, null if unknown."""
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(c)))


def normalise(df: DataFrame, rows: list[tuple[str, str, str]], name: str, out: str) -> DataFrame:
    """``df`` (with ``harness``) and ``out``, the canonical name or the native
    one where the vocabulary has none."""
    dim = dimension(df.sparkSession, rows).select(
        F.col("harness").alias("_h"), F.col("native").alias("_n"), F.col("canonical").alias("_c")
    )
    joined = df.join(dim, (df["harness"] == F.col("_h")) & (df[name] == F.col("_n")), "left")
    return joined.withColumn(out, F.coalesce("_c", df[name])).drop("_h", "_n", "_c")
