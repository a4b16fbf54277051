"""Exact-key typing of tool calls from their JSON input, without coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind -> (required, optional) keys with their JSON types.
SHAPES: dict[str, tuple[dict[str, str], dict[str, str]]] = {
    "Read": ({"file_path": "str"}, {"offset": "int", "limit": "int"}),
    "Write": ({"file_path": "str", "content": "str"}, {}),
    "Edit": ({"file_path": "str", "old_string": "str", "new_string": "str"}, {"replace_all": "bool"}),
    "MultiEdit": ({"file_path": "str", "edits": "array"}, {}),
    "Bash": ({"command": "str"}, {"workdir": "str", "timeout_ms": "int", "description": "str", "run_in_background": "bool"}),
}
COMMAND: dict[str, str] = {"args": "str"}
_SCHEMAS = {"str": "STRING", "int": "BIGINT", "bool": "BOOLEAN"}


def has_exact_keys(json: Column, required: list[str], optional: list[str] | None = None) -> Column:
    """Whether an object has all the required keys and none but the allowed."""
    keys = F.json_object_keys(json)
    allowed = F.array(*[F.lit(k) for k in [*required, *(optional or [])]])
    need = F.array(*[F.lit(k) for k in required])
    exact = (F.size(F.array_except(keys, allowed)) == 0) & (F.size(F.array_except(need, keys)) == 0)
    return F.coalesce(keys.isNotNull() & exact, F.lit(False))


def _is(json: Column, key: str, kind: str) -> Column:
    """Whether the value has the type; counts aren't negative."""
    v = F.try_parse_json(json)
    got = F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant"))
    if kind == "array":
        return got.startswith("ARRAY")
    fits = got == _SCHEMAS[kind]
    return fits & (F.try_variant_get(v, f"$.{key}", "bigint") >= 0) if kind == "int" else fits


def fits(json: Column, required: dict[str, str], optional: dict[str, str]) -> Column:
    """Whether an object has the required keys, none beside the optional ones, and
    each of its type.  An optional key may be null, a flag may not."""
    ok = has_exact_keys(json, list(required), list(optional))
    for k, t in required.items():
        ok = ok & _is(json, k, t)
    here = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    for k, t in optional.items():
        absent = ~F.array_contains(here, k)
        if t != "bool":
            got = F.schema_of_variant(F.variant_get(F.try_parse_json(json), f"$.{k}", "variant"))
            absent = absent | (got == "VOID")
        ok = ok & (absent | F.coalesce(_is(json, k, t), F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def tool_kind(name: Column, json: Column) -> Column:
    """Command, Read, Write, Edit, MultiEdit, Bash or Raw."""
    out = F.when(name.startswith("/") & fits(json, {}, COMMAND), F.lit("Command"))
    for kind, (required, optional) in SHAPES.items():
        ok = fits(json, required, optional)
        if kind == "MultiEdit":
            edits = F.from_json(F.get_json_object(json, "$.edits"), "array<string>")
            required_e, optional_e = SHAPES["Edit"]
            needed = {k: t for k, t in required_e.items() if k != "file_path"}
            ok = ok & F.coalesce(F.forall(edits, lambda e: fits(e, needed, optional_e)), F.lit(False))
        out = out.when((name == kind) & ok, F.lit(kind))
    return out.otherwise(F.lit("Raw"))
