"""Stores of native sessions as DataFrames.

A transcript is a row: the session's header and its messages, each with blocks,
as nested columns.  Files are parsed where they are read, one unit (a file, a
folder or a database) at a time, so nothing is shuffled except to bring the files
of a folder together; projections and lines are Spark expressions over the nested
columns (``operators.transcripts``).

A unit that can't be read contributes nothing, so one broken file doesn't end a
scan; ``read`` of a single session raises instead.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..formats import FORMATS, Json, Meta, Session, Unit, Unsupported, get
from ..formats import base as b

_KINDS = {"s": T.StringType(), "t": T.TimestampType(), "l": T.LongType(), "b": T.BooleanType(), "x": T.BinaryType()}


def _struct(**fields: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k] if isinstance(k, str) else k) for n, k in fields.items()])


_BLOCK = _struct(
    type="s", text="s", signature="s", encrypted="s", tool_use_id="s", tool_kind="s", tool_name="s", tool_input_json="s",
    output_text="s", output_json="s", is_error="b", image=_struct(media_type="s", data="s", encoding="s"),
    artifact=_struct(id="s", name="s", kind="s", value="s", media_type="s"),
)
_USAGE = _struct(input_tokens="l", output_tokens="l", cache_read_input_tokens="l", cache_creation_input_tokens="l")
_MESSAGE = _struct(role="s", ts="t", model="s", stop_reason="s", usage=_USAGE, content=T.ArrayType(_BLOCK))
SCHEMA = _struct(
    harness="s", source="s", id="s", ts="t", cwd="s", git_branch="s", title="s", cli_version="s", model="s",
    updated_at="t", fingerprint="s", messages=T.ArrayType(_MESSAGE),
)
FILES = _struct(source="s", mtime="t", fingerprint="s", files=T.ArrayType(_struct(name="s", content="x")))
DOCUMENT = _struct(harness="s", source="s", id="s", document="s")
#: What a broken file or database may raise.
BROKEN = (ValueError, KeyError, TypeError, AttributeError, sqlite3.Error, RecursionError, OverflowError)


def block_row(x: dict) -> dict:
    kind = x["type"]
    row: dict = {"type": kind, "is_error": False}
    if kind in ("text", "thinking"):
        row |= {k: x.get(k) for k in ("text", "signature", "encrypted")}
    elif kind == "tool_use":
        named = {"tool_kind": b.tool_kind(x["name"], x["input"]), "tool_name": x["name"]}
        row |= {"tool_use_id": x["id"], "tool_input_json": b.compact(x["input"])} | named
    elif kind == "tool_result":
        out = x["output"]
        told = {"output_json": b.compact(out.value)} if isinstance(out, Json) else {"output_text": out}
        row |= {"tool_use_id": x["id"], "is_error": x["is_error"]} | told
    else:
        row[kind] = {k: v for k, v in x.items() if k != "type"}
    return row


def row_block(r: Any) -> dict:
    """The inverse of ``block_row``."""
    kind = r["type"]
    if kind == "text":
        return b.text(r["text"])
    if kind == "thinking":
        return b.thinking(r["text"], r["signature"], r["encrypted"])
    if kind == "tool_use":
        return b.call(r["tool_use_id"], r["tool_name"], b.loads(r["tool_input_json"] or "null"))
    if kind == "tool_result":
        out = Json(b.loads(r["output_json"])) if r["output_json"] is not None else r["output_text"] or ""
        return b.result(r["tool_use_id"], out, bool(r["is_error"]))
    return {"type": kind} | dict(r[kind])


def transcript_row(harness: str, unit: Unit, fingerprint: str | None, meta: Meta, messages: list[dict]) -> dict:
    head = {k: getattr(meta, k) for k in ("id", "cwd", "git_branch", "title", "cli_version", "model")}
    listed = [{k: m[k] for k in ("role", "model", "stop_reason", "usage")} | {"ts": m["timestamp"], "content": [block_row(x) for x in m["content"]]} for m in messages]
    return head | {"harness": harness, "source": unit.source, "ts": meta.timestamp, "updated_at": unit.mtime, "fingerprint": fingerprint, "messages": listed}


def _utc(t: datetime | None) -> datetime | None:
    """Times come in the session's zone."""
    return t and (t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC))


def row_session(r: dict) -> Session:
    meta = Meta(r["id"] or "", _utc(r["ts"]) or b.EPOCH, *(r.get(k) for k in ("cwd", "git_branch", "title", "cli_version", "model")))
    messages = []
    for m in r["messages"] or []:
        blocks = [row_block(x) for x in m["content"] or []]
        messages.append(b.message(m["role"], blocks, _utc(m["ts"]) or meta.timestamp, m["model"], m["stop_reason"], m["usage"]))
    return Session(meta, messages)


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


#: Bytes of rows that are Python objects at a time, unless one row has more.
PIECE = 1 << 20


def _values(a: pa.Array) -> list:
    """``a.to_pylist()`` by columns, as most fields of a block are null."""
    if a.null_count == len(a):
        return [None] * len(a)
    if pa.types.is_struct(a.type):
        names = [f.name for f in a.type]
        made: list = [dict(zip(names, x)) for x in zip(*map(_values, a.flatten()))]
    elif pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        items, made, at = _values(a.flatten()), [], 0
        for n in a.value_lengths().fill_null(0).to_pylist():
            made.append(items[at : at + n])
            at += n
    else:
        return a.to_pylist()
    return [x if ok else None for x, ok in zip(made, a.is_valid().to_pylist())] if a.null_count else made


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches.  Spark's have up to 10,000 rows or 64 MB, which would be many times
    that as objects, so they become objects a piece at a time."""
    for batch in batches:
        todo = [batch] if batch.num_rows else []
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > PIECE:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield from (dict(zip(part.schema.names, x)) for x in zip(*map(_values, part.columns)))


def _batches(rows: Iterable[tuple[dict, int]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows, each with its bytes, in batches that end with the row that fills a piece."""
    held: list[dict] = []
    size = 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= PIECE:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def units(spark: SparkSession, harness: str, root: str) -> DataFrame:
    """(source, mtime, fingerprint, files) of the store below ``root``."""
    fmt = get(harness)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", fmt.glob).load(root)
    stamp = F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("fingerprint")
    rows = files.select("path", F.col("modificationTime").alias("mtime"), stamp, "content")
    skip = getattr(fmt, "skip", None)
    if skip:
        rows = rows.where(~F.col("path").rlike(skip))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    if fmt.units == "file":
        return rows.select(F.col("path").alias("source"), "mtime", "fingerprint", F.array(F.struct(name.alias("name"), "content")).alias("files"))
    if fmt.units == "folder":
        rows = rows.withColumn("source", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("name", name)
        order = F.when(F.col("name").isin("updates.jsonl", "store.db"), 0).when(F.col("name") == "chat_history.jsonl", 1).otherwise(2)
    else:  # a record beside a folder of its name
        own = F.col("path").rlike(fmt.record.pattern.replace("(?:", "("))
        place = F.when(own, F.regexp_replace("path", r"\.json$", "")).otherwise(F.regexp_extract("path", r"^(.*?/local_[^/]*)/", 1))
        rows = rows.withColumn("source", place).where("source <> ''")
        below = F.expr("substring(path, length(source) + 2)")
        rows = rows.withColumn("name", F.when(own, F.lit("record")).otherwise(below))
        order = F.when(F.col("name").startswith(".claude/projects/"), 0).otherwise(F.when(F.col("name") == "record", 1).otherwise(2))
    first = F.min_by("fingerprint", F.struct(order, F.col("name")))
    # a folder is one session: its files are few
    grouped = rows.groupBy("source").agg(F.max("mtime").alias("mtime"), first.alias("fingerprint"), F.collect_list(F.struct("name", "content")).alias("files"))
    return grouped if fmt.units == "folder" else grouped.where(F.exists("files", lambda f: f["name"] == "record"))


def records(files: DataFrame) -> DataFrame:
    """(source, line_no, raw, kind) of units that hold one JSON object to a line; blank
    and broken lines are left out, and ``raw`` is the line as it stands."""
    each = files.select("source", F.posexplode(F.split(F.decode(F.col("files")[0]["content"], "utf-8"), "\r?\n")).alias("line_no", "raw"))
    known = each.where((F.trim("raw") != "") & F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"))
    kind = F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.type", "variant")) == "STRING", F.get_json_object("raw", "$.type"))
    return known.select("source", F.col("line_no").cast("bigint").alias("line_no"), "raw", kind.alias("kind"))


def parse(files: DataFrame, harness: str, strict: bool = False) -> DataFrame:
    """Transcripts of units (source, mtime, fingerprint, files); other columns of
    ``files`` are left out.  ``strict`` raises where a unit can't be read."""
    name = get(harness).name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_parsed(_rows(batches), name, strict), SCHEMA)

    return files.select("source", "mtime", "fingerprint", "files").mapInArrow(run, SCHEMA)


def _parsed(units: Iterable[dict], name: str, strict: bool = False) -> Iterator[tuple[dict, int]]:
    """Transcripts of units, each with the bytes that it took."""
    fmt = FORMATS[name]
    for r in units:
        unit = Unit(r["source"], {f["name"]: f["content"] for f in r["files"]}, _utc(r["mtime"]) or b.EPOCH)
        try:
            cursors = fmt.cursors(unit) if hasattr(fmt, "cursors") and _many(unit) else {}
            found = [transcript_row(name, unit, cursors.get(m.id, r["fingerprint"]), m, fmt.to_common(m, body)) for m, body in fmt.sessions(unit)]
        except BROKEN:
            if strict:
                raise
            continue
        size = sum(map(len, unit.files.values()))
        yield from ((row, size // len(found)) for row in found)


def _many(unit: Unit) -> bool:
    return next(iter(unit.files.values())).startswith(b"SQLite format 3\0")


def transcripts(spark: SparkSession, harness: str, root: str) -> DataFrame:
    return parse(units(spark, harness, root), harness)


def discover(spark: SparkSession, roots: dict[str, str], harness: str | None = None) -> DataFrame:
    """Headers of all stores, newest first; ``seq`` is the order among equals.
    Only the stores asked for are scanned.  A store whose folder doesn't exist has
    no sessions."""
    chosen = {h: r for h, r in roots.items() if harness is None or get(h).name == get(harness).name}
    out = spark.createDataFrame([], SCHEMA)
    for h, root in chosen.items():
        if _exists(spark, root):
            out = out.unionByName(transcripts(spark, h, root))
    heads = out.select("harness", "source", "id", "ts", "cwd", "git_branch", "title", "cli_version", "model", "updated_at", "fingerprint", F.size("messages").alias("n_messages"))
    return heads.orderBy(F.desc("ts"), "harness", "source", "id")


def cursors(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(harness, source, id, cursor) of every session: what changes when the session
    does.  A file's time and size, that of a folder's log or a record's transcript,
    and where a database holds many sessions what the store itself counts up; '' where
    nothing is known, so that such a session is always read."""
    heads = discover(spark, roots)
    return heads.select("harness", "source", "id", F.coalesce("fingerprint", F.lit("")).alias("cursor"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, harness: str, source: str, id_: str | None = None) -> Session:
    """One session by its place, and by its id where a place has many."""
    fmt = get(harness)
    base = source if fmt.units != "record" or not source.endswith(".json") else source[:-5]
    root = base if fmt.units == "file" else base.rsplit("/", 1)[0]
    rows = parse(units(spark, harness, root).where(F.col("source").endswith(base.split("://")[-1].removeprefix("file:"))), harness, strict=True)
    found = rows.where(F.col("id") == id_) if id_ is not None else rows
    got = found.limit(2).toArrow().to_pylist()
    if len(got) != 1:
        raise Unsupported(f"{'no' if not got else 'more than one'} session {id_ or ''} in {source}")
    return row_session(got[0])


# Writing


def convert(rows: DataFrame, to: str) -> DataFrame:
    """(source, mtime, fingerprint, files) of transcripts in another format; one
    row for each, in the form that ``parse`` reads."""
    name = get(to).name
    _writable(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _converted(_rows(batches), name)
        yield from _batches(((u, sum(len(f["content"]) for f in u["files"])) for u in made), FILES)

    return rows.mapInArrow(run, FILES)


def _converted(rows: Iterable[dict], name: str) -> Iterator[dict]:
    """Units of transcripts."""
    fmt = FORMATS[name]
    for r in rows:
        session = row_session(r)
        body = fmt.from_common(session)
        files = fmt.unit_files(session.meta, body) if hasattr(fmt, "unit_files") else _as_unit(fmt, fmt.render(session.meta, body))
        yield {"source": r["source"], "mtime": session.meta.timestamp, "fingerprint": None, "files": files}


def through(rows: DataFrame, to: str) -> DataFrame:
    """Transcripts that are written in another format and read again: ``parse`` of
    ``convert`` by one worker a task, which hands the files on one session at a time."""
    name = get(to).name
    _writable(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_parsed(_converted(_rows(batches), name), name), SCHEMA)

    return rows.mapInArrow(run, SCHEMA)


def _as_unit(fmt, rendered: dict[str, bytes]) -> list[dict]:
    """Rendered files under the names that the format's reader expects."""
    if fmt.units == "record":
        record = min(rendered, key=len)
        return [{"name": "record" if p == record else p[len(record) - 4 :], "content": v} for p, v in rendered.items()]
    return [{"name": p.rsplit("/", 1)[-1], "content": v} for p, v in rendered.items()]


#: Formats whose stores belong to a running application or service.
REFUSED = {"claude_chat", "hermes", "amp", "simple"}


def _writable(name: str) -> None:
    if name == "claude_chat":
        raise Unsupported(f"{name} is read only")


def save(rows: DataFrame, to: str, root: str) -> DataFrame:
    """Writes transcripts into a store below ``root``, a folder that all machines
    reach: (id, location) of each.  Some stores are never written to."""
    name = get(to).name
    if name in REFUSED or name == "opencode":
        raise Unsupported(f"sessions aren't written into a {name} store; use convert or export")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        fmt = FORMATS[name]
        system, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            ids, places = [], []
            for r in _rows([batch]):
                session = row_session(r)
                files = fmt.render(session.meta, fmt.from_common(session))
                for path, data in files.items():
                    place = f"{base}/{path}"
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(place) as out:
                        out.write(data)
                ids.append(session.meta.id)
                places.append(f"{base}/{min(files, key=len)}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(places, pa.string())], ["id", "location"])

    return rows.mapInArrow(run, "id string, location string")


def export(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(harness, source, id, document): sessions, or messages ``start`` to ``end``
    of each, as simple documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..formats.simple import document_text, to_document

        def documents() -> Iterator[tuple[dict, int]]:
            for r in _rows(batches):
                s = row_session(r)
                s.messages = s.messages[start:end]
                text = document_text(to_document(s))
                yield {k: r[k] for k in ("harness", "source", "id")} | {"document": text}, len(text)

        yield from _batches(documents(), DOCUMENT)

    return rows.mapInArrow(run, DOCUMENT)


def delete(harness: str, source: str, root: str) -> None:
    """Deletes a session of a store of files.  What isn't a session of that store,
    or lies outside ``root`` once links are followed, is refused."""
    import os
    import shutil

    fmt = get(harness)
    if fmt.name in ("claude_chat", "hermes", "opencode", "simple", "cursor_desktop"):
        raise Unsupported(f"sessions of {fmt.name} aren't deleted as files")
    place, top = (os.path.realpath(_local(p)) for p in (source, root))
    depth = len(os.path.relpath(place, top).split(os.sep))
    inside = os.path.commonpath([place, top]) == top and place != top
    if not inside or not os.path.exists(place):
        raise Unsupported(f"{source} isn't in {root}")
    if fmt.units == "folder":
        logs = {"grok": ("updates.jsonl", "chat_history.jsonl"), "cursor": ("store.db",)}[fmt.name]
        if depth != 2 or not any(os.path.isfile(os.path.join(place, n)) for n in logs):
            raise Unsupported(f"{source} isn't a session folder")
        shutil.rmtree(place)
    elif fmt.units == "record":
        if not re.search(r"/local_[^/]*\.json$", place) or not (depth == 3 or depth == 4 and os.path.basename(os.path.dirname(place)) == "agent"):
            raise Unsupported(f"{source} isn't a session record")
        shutil.rmtree(place[:-5], ignore_errors=True)
        os.remove(place)
    else:
        if not os.path.isfile(place):
            raise Unsupported(f"{source} isn't a file")
        for extra in (f"{place}-wal", f"{place}-shm"):
            if os.path.exists(extra):
                os.remove(extra)
        os.remove(place)


def _local(path: str) -> str:
    """Spark gives paths with their scheme and without percent-encoding."""
    m = re.fullmatch(r"(?:(\w+):(?://)?)?(/.*)", path)
    if m is None or m[1] not in (None, "file"):
        raise Unsupported(f"{path} isn't a local file")
    return m[2]


def materialise(session: Session, folder: str, most: int = 64 << 20) -> Session:
    """Artifacts that are held as text or base64 become files in ``folder``; one
    of more than ``most`` bytes stays as it is."""
    import base64
    import os

    os.makedirs(folder, exist_ok=True)
    out = []
    for m in session.messages:
        blocks = []
        for x in m["content"]:
            if x["type"] == "artifact" and x["kind"] != "path":
                try:
                    data = x["value"].encode() if x["kind"] == "text" else base64.b64decode(x["value"], validate=True)
                except ValueError:
                    data = None
                if data is not None and len(data) <= most:
                    path = os.path.join(folder, f"{b.made_id(b.namespace('artifact'), x['id'], x['name'])[:8]}-{safe_name(x['name'])}")
                    with open(path, "wb") as f:
                        f.write(data)
                    x = b.artifact(x["id"], x["name"], "path", path, x["media_type"])
            blocks.append(x)
        out.append(m | {"content": blocks})
    return Session(session.meta, out)


def safe_name(name: str, most: int = 180) -> str:
    """A name that can be a file's: at most ``most`` bytes, no separators or
    control characters."""
    clean = re.sub(r"[\x00-\x1f\x7f-\x9f/\\`:]", "_", name).strip() or "artifact"
    clean = "artifact" if clean in (".", "..") else clean
    return clean.encode()[:most].decode("utf-8", "ignore")


def fresh(meta: Meta, now: datetime, cwd: str | None = None) -> Meta:
    """The header of a copy: a new id, the time ``now``, and a folder where the
    session has none."""
    import uuid

    return b.with_meta(meta, id=str(uuid.uuid4()), timestamp=now, cwd=meta.cwd or cwd)


def numbered(heads: DataFrame) -> DataFrame:
    """``discover``'s rows with ``seq`` by harness: their order in the store."""
    return heads.withColumn("seq", F.row_number().over(Window.partitionBy("harness").orderBy(F.desc("ts"), "source", "id")) - 1)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all machines reach, from ``spark.checkpoint.dir``; on one
    machine (a local master) without that setting, a folder of its own."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="threadloom-stores-")
    return root.rstrip("/")
