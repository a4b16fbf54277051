"""Scalar functions on text as Column expressions that stay inside codegen."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(c: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int = 80) -> Column:
    """At most ``most`` characters, the last being an ellipsis if any went."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def title_of(c: Column) -> Column:
    """One line of at most 80 characters; null for blank text."""
    line = one_line(c)
    return F.when(line != "", truncate(line))


def title_case(c: Column) -> Column:
    """Only the first character is raised, unlike ``initcap``."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lines_of(c: Column) -> Column:
    """Lines without their ends; the text after a last newline counts if any."""
    return F.split(c, "\r?\n")


def scrub(c: Column) -> Column:
    """Every control character becomes a space."""
    return F.regexp_replace(c, r"\p{Cntrl}", " ")


def short_id(c: Column, n: int = 8) -> Column:
    return F.substring(c, 1, n)


def data_url(c: Column) -> Column:
    """struct(mime, data) of a base64 data URL, else null."""
    pattern = r"^data:([^;,]+);base64,(.*)$"
    return F.when(
        c.rlike(pattern),
        F.struct(F.regexp_extract(c, pattern, 1).alias("mime"), F.regexp_extract(c, pattern, 2).alias("data")),
    )


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5, equal to Python's ``uuid.uuid5``."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.lower(F.hex(digit)), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def format_when(ts: Column, now: Column) -> Column:
    """Age of an epoch second: just now, Nm, Nh or Nd ago, then the date."""
    age = now - ts
    day = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")
    return (
        F.when(age < 60, "just now")
        .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit("m ago")))
        .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit("h ago")))
        .when(age < 7 * 86400, F.concat(F.floor(age / 86400).cast("string"), F.lit("d ago")))
        .otherwise(day)
    )


def under_dir(cwd: Column, folder: str) -> Column:
    """Whether ``cwd`` is the folder or below it, by whole path components."""
    base = folder.rstrip("/")
    return cwd.startswith("/") if not base else (cwd == base) | cwd.startswith(base + "/")


def epoch_seconds(c: Column) -> Column:
    """Float seconds to a timestamp; null unless finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e12)
    return F.when(finite, F.timestamp_micros(F.round(c * 1_000_000).cast("bigint")))
