"""Listing, filtering, paging and resolving sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import under_dir

KEY = ["harness", "id", "source"]


def newest_first(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("ts"), F.asc("seq"))


def filtered(
    sessions: DataFrame, harness: str | None = None, cwd: str | None = None, since: int | None = None, until: int | None = None
) -> DataFrame:
    """All given conditions hold; bounds are inclusive epoch seconds and a
    session without a folder is in none."""
    if harness is not None:
        sessions = sessions.where(F.col("harness") == harness)
    if cwd is not None:
        sessions = sessions.where(under_dir(F.col("cwd"), cwd))
    if since is not None:
        sessions = sessions.where(F.col("ts") >= since)
    if until is not None:
        sessions = sessions.where(F.col("ts") <= until)
    return sessions


def page(sessions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page, newest first, with ``total`` before paging and ``pos``.  The
    total is one number, counted first, so no window holds all rows."""
    total = sessions.count()
    rows = newest_first(sessions).offset(offset).limit(limit)
    pos = F.row_number().over(Window.orderBy(F.desc("ts"), F.asc("seq"))) + offset
    return rows.withColumn("pos", pos.cast("bigint")).withColumn("total", F.lit(total).cast("bigint"))


def resolve_exact(sessions: DataFrame, needle: str) -> DataFrame:
    """The newest session of this id or title."""
    return newest_first(sessions.where((F.col("id") == needle) | (F.col("title") == needle))).limit(1)


def distinct_ids(sessions: DataFrame) -> DataFrame:
    """The first found session of every id."""
    by = Window.partitionBy("id").orderBy("seq")
    return sessions.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def resolve_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """Matches of an id prefix with ``candidates``, the number of distinct ids:
    the prefix is resolved if that is 1."""
    if not prefix:
        return distinct_ids(sessions.where(F.lit(False))).withColumn("candidates", F.lit(0).cast("bigint"))
    found = distinct_ids(sessions.where(F.col("id").startswith(prefix)))
    return found.withColumn("candidates", F.lit(found.count()).cast("bigint"))


class NotOne(LookupError):
    """A reference names no session, or several."""


def find_session(sessions: DataFrame, needle: str) -> DataFrame:
    """The one session that ``needle`` names: the newest whose id or title it is,
    else the newest of the only id that it begins.  An empty one names none.
    ``sessions`` has (id, title, ts) and perhaps ``seq``, the order among equals."""
    if not needle:
        raise NotOne("an empty reference names no session")
    last = [F.desc("ts"), *([F.asc("seq")] if "seq" in sessions.columns else [F.asc("source")])]
    exact = sessions.where((F.col("id") == needle) | (F.col("title") == needle))
    if not exact.isEmpty():
        return exact.orderBy(*last).limit(1)
    ids = sorted(r[0] for r in sessions.where(F.col("id").startswith(needle)).select("id").distinct().limit(9).collect())
    if len(ids) != 1:
        raise NotOne(f"{needle!r} names {'sessions ' + ', '.join(ids) if ids else 'no session'}")
    return sessions.where(F.col("id") == ids[0]).orderBy(*last).limit(1)
