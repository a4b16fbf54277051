"""What a user of the library asks for: sessions of all stores listed, searched and
read.  ``roots`` maps each format to the folder of its store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import FORMATS, Session, Unit, get
from .functions.text import under_dir
from .operators import search as S
from .operators import slicing
from .operators.sessions import find_session
from .operators import transcripts as R
from .sources import stores

READ_BUDGET = 100_000


def harnesses() -> list[str]:
    return sorted(FORMATS)


def convert(files: dict[str, bytes], source: str, of: str, to: str) -> list[dict[str, bytes]]:
    """Native files of sessions in another format, one dict for each session."""
    a, z = get(of), get(to)
    out = []
    for meta, body in a.sessions(Unit(source, files)):
        session = Session(meta, a.to_common(meta, body))
        native = z.from_common(session)
        out.append({f["name"]: f["content"] for f in z.unit_files(meta, native)} if hasattr(z, "unit_files") else z.render(meta, native))
    return out


def _scope(rows: DataFrame, cwd: str | None) -> DataFrame:
    return rows if cwd is None else rows.where(under_dir(F.col("cwd"), cwd))


def _transcripts(spark: SparkSession, roots: dict[str, str], harness: str | None) -> DataFrame:
    out = spark.createDataFrame([], stores.SCHEMA)
    for h, root in roots.items():
        if (harness is None or get(h).name == get(harness).name) and stores._exists(spark, root):
            out = out.unionByName(stores.transcripts(spark, h, root))
    return out


def list_sessions(
    spark: SparkSession, roots: dict[str, str], harness: str | None = None, cwd: str | None = None, limit: int = 50, offset: int = 0
) -> tuple[int, DataFrame]:
    """How many there are, and a page of their headers, newest first; an offset
    beyond the end gives an empty page."""
    heads = _scope(stores.discover(spark, roots, harness), cwd)
    return heads.count(), heads.offset(max(0, offset)).limit(max(0, limit))


def search_sessions(
    spark: SparkSession, roots: dict[str, str], pattern: str, harness: str | None = None, cwd: str | None = None, limit: int = 20, hits: int = 3
) -> DataFrame:
    """(key, rank, best, hit_no, msg_idx, origin, text, marks): the best sessions
    with their best lines, each with the stretches that match."""
    rows = _scope(_transcripts(spark, roots, harness), cwd)
    # equal times and scores go by harness, place and id: no global numbering
    heads = rows.select(*R.KEY, F.unix_micros("ts").alias("ts"), F.xxhash64("harness", "source", "id").alias("seq"))
    query = S.Query.fuzzy(pattern, limit=limit, hits_per_doc=hits)
    lines = R.lines(rows).join(heads.select(*R.KEY, "seq"), R.KEY)
    found = S.search(lines, heads, query)
    return found if query.blank else found.withColumn("marks", S.highlights(query, F.col("text")))


def read_session(spark: SparkSession, roots: dict[str, str], ref: str, harness: str | None = None, budget: int = READ_BUDGET) -> list[str]:
    """The text of one session, or of messages N to M with ``id#N-M``, in pieces of at
    most ``budget`` bytes where its sections allow.  ``ref`` is an id, a title, or the
    start of one id only."""
    name, span = slicing.split_reference(ref)
    exact = find_session(_transcripts(spark, roots, harness), name)
    if span is None:
        body = R.text(exact).first()["body"]
    else:
        total = exact.select(F.size("messages")).first()[0]
        start, end = slicing.resolve_range(span, total)
        body = R.text(exact, start, end, fragment=True).first()["body"]
    return pieces(body, budget)


def pieces(body: str, budget: int) -> list[str]:
    """Sections put together up to the budget; a larger section stands alone."""
    import re

    parts = re.split(r"(?m)^(?=\[|── #)", body)
    out: list[str] = []
    for p in filter(None, parts):
        if out and len((out[-1] + p).encode()) <= budget:
            out[-1] += p
        else:
            out.append(p)
    return out


class Searcher:
    """An index of transcripts to which sessions are added and from which they are
    taken; the last one added under a key counts, in the place of the first."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def insert(self, rows: DataFrame) -> None:
        self.rows = self.rows.join(rows.select(*R.KEY), R.KEY, "left_anti").unionByName(rows)

    def remove(self, keys: DataFrame) -> None:
        self.rows = self.rows.join(keys.select(*R.KEY), R.KEY, "left_anti")

    def __len__(self) -> int:
        return self.rows.count()

    def query(self, query: S.Query) -> DataFrame:
        heads = self.rows.select(*R.KEY, F.unix_micros("ts").alias("ts"), F.xxhash64("harness", "source", "id").alias("seq"))
        return S.search(R.lines(self.rows).join(heads.select(*R.KEY, "seq"), R.KEY), heads, query)


__all__ = ["Searcher", "convert", "harnesses", "list_sessions", "pieces", "read_session", "search_sessions"]
