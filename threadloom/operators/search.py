"""Search over lines: a query is compiled to Column expressions, documents are
ranked by their best line, and hits are read back for the ranked ones only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["harness", "id", "source"]
DEFAULT_ORIGINS = ("user", "assistant", "thinking", "tool_use", "meta")
#: Added to the score of a line that has the whole pattern literally.
LITERAL_BONUS = 65_536
#: Letters whose lower case is longer than they are; left as they are.
_LONG_FOLDS = "İ"


@dataclass(frozen=True)
class Query:
    pattern: str
    mode: str = "fuzzy"
    case: str = "smart"
    origins: tuple[str, ...] = DEFAULT_ORIGINS
    harnesses: tuple[str, ...] | None = None
    limit: int | None = None
    hits_per_doc: int = 8

    @classmethod
    def fuzzy(cls, pattern: str, **kw) -> Query:
        return cls(pattern, "fuzzy", **kw)

    @classmethod
    def substring(cls, pattern: str, **kw) -> Query:
        return cls(pattern, "substring", **kw)

    @property
    def sensitive(self) -> bool:
        return self.case == "sensitive" or (self.case == "smart" and any(c.isupper() for c in self.pattern))

    @property
    def needle(self) -> str:
        text = self.pattern if self.mode == "substring" else self.pattern.strip()
        return text if self.sensitive else _fold(text)

    @property
    def blank(self) -> bool:
        return not self.pattern.strip()


def _fold(text: str) -> str:
    return "".join(c if c in _LONG_FOLDS else c.lower() for c in text)


def fold(c: Column) -> Column:
    """Lower case, one character for each, so places keep their numbers."""
    kept = F.translate(c, _LONG_FOLDS, "")
    return F.translate(F.lower(kept), "", _LONG_FOLDS)


def parse_atoms(pattern: str) -> list[tuple[bool, str, str]]:
    """(negated, kind, text) of each atom between white space; kinds: fuzzy,
    exact ('x), prefix (^x), suffix (x$) and equal (^x$)."""
    atoms = []
    for raw in pattern.split():
        negated, kind = raw.startswith("!"), "fuzzy"
        text = raw[1:] if negated else raw
        if text.startswith("'"):
            kind, text = "exact", text[1:]
        elif text.startswith("^"):
            kind, text = "prefix", text[1:]
        if text.endswith("$") and len(text) > 1:
            kind, text = {"prefix": "equal"}.get(kind, "suffix"), text[:-1]
        if negated and kind == "fuzzy":
            kind = "exact"
        if text:
            atoms.append((negated, kind, text))
    return atoms


def subsequence_pattern(atom: str) -> str:
    """Matches texts that hold the letters in this order.  Each step runs up to the
    next letter and never goes back, so a long line takes linear time."""
    steps = [f"[^{re.escape(c) if c != '^' else chr(92) + c}]*+{re.escape(c)}" for c in atom]
    return "(?s)^" + "".join(steps)


def atom_match(text: Column, kind: str, atom: str) -> Column:
    if kind == "fuzzy":
        return text.rlike(subsequence_pattern(atom))
    return {
        "exact": F.instr(text, atom) > 0,
        "prefix": text.startswith(atom),
        "suffix": text.endswith(atom),
        "equal": text == F.lit(atom),
    }[kind]


def matches(query: Query, text: Column) -> Column:
    """Whether a line matches; inside codegen."""
    hay = text if query.sensitive else fold(text)
    if query.mode == "substring":
        return F.instr(hay, query.needle) > 0
    out = F.lit(True)
    for negated, kind, atom in parse_atoms(query.pattern):
        hit = atom_match(hay, kind, atom if query.sensitive else _fold(atom))
        out = out & (~hit if negated else hit)
    return out


_LOW = -(1 << 40)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in a row, an end mark (0) after each; starts of the
    texts; and 6 where a word begins, else 0."""
    flat = "\0".join(texts) + "\0"
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    kinds, back = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalnum() for c in kinds.tolist()], bool)[back]
    begins = np.append(True, ~letter[:-1])
    begins[starts] = True
    return codes, starts, np.where(begins, 6, 0).astype(np.int64)


def _tables(texts: list[str], atom: str) -> tuple[list[np.ndarray], np.ndarray]:
    """For each letter of the atom the best score of an alignment that puts it at
    each place.  A gap costs 3 and 1 for each further letter, so the best start of
    a gap is a running maximum of score + place, kept apart by text."""
    codes, starts, bonus = _codes(texts)
    n = len(codes)
    place = np.arange(n)
    text_no = np.zeros(n, np.int64)
    text_no[starts[1:]] = 1
    apart = np.cumsum(text_no) << 42
    first = np.zeros(n, bool)
    first[starts] = True
    best, out = None, []
    for c in atom:
        here = codes == ord(c)
        if best is None:
            base = np.zeros(n, np.int64)
        else:
            before = np.append(_LOW, best[:-1])
            before[first] = _LOW
            reach = np.maximum.accumulate(np.maximum(before, _LOW) + place + apart) - apart
            gap = np.append(_LOW, reach[:-1]) - 2 - place
            gap[first] = _LOW
            base = np.maximum(before + 8, gap)
        best = np.where(here & (base > _LOW // 2), base + 16 + bonus, _LOW)
        out.append(best)
    return out, starts


def alignment_scores(texts: list[str], atom: str) -> np.ndarray:
    """Best score of ``atom`` as a subsequence of each text: 16 a letter, 8 more
    after the one before, 6 more at the start of a word, a gap costs 3 and then 1
    a letter (affine gaps, so whole matches beat scattered ones); 0 for none."""
    if not atom or not texts:
        return np.zeros(len(texts), np.int64)
    tables, starts = _tables(texts, atom)
    return np.maximum(np.maximum.reduceat(tables[-1], starts), 0)


def alignment_score(text: str, atom: str) -> int:
    return int(alignment_scores([text], atom)[0])


def alignment_places(text: str, atom: str) -> list[int]:
    """Places of the letters in a best alignment, none if there is none."""
    if not atom:
        return []
    tables, _ = _tables([text], atom)
    _, _, bonus = _codes([text])
    if tables[-1].max() <= 0:
        return []
    at = int(tables[-1].argmax())
    out = [at]
    for i in range(len(atom) - 1, 0, -1):
        want = tables[i][at] - 16 - bonus[at]
        before = tables[i - 1][:at]
        cost = np.where(np.arange(at) == at - 1, -8, at - np.arange(at) + 1)
        at = int(np.flatnonzero(before - cost == want)[-1])
        out.append(at)
    return out[::-1]


def merge_spans(places: list[int]) -> list[tuple[int, int]]:
    """Sorted places as stretches, half open."""
    out: list[list[int]] = []
    for p in sorted(set(places)):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(a, b) for a, b in out]


def fuzzy_scores(query: Query, text: Column) -> Column:
    """In-tier score; only matched lines should get here."""
    atoms = [a if query.sensitive else _fold(a) for neg, kind, a in parse_atoms(query.pattern) if not neg]
    sensitive = query.sensitive

    @F.pandas_udf("bigint")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts, back = np.unique(s.to_numpy(dtype=object).astype(str), return_inverse=True)
            hay = [str(t) if sensitive else _fold(str(t)) for t in texts]
            total = sum((alignment_scores(hay, a) for a in atoms), np.zeros(len(hay), np.int64))
            yield pd.Series(total[back], dtype="int64")

    return score(text)


def highlights(query: Query, text: Column) -> Column:
    """Stretches of a hit's letters: the literal occurrence if there is one, else
    those of the best alignment of each atom.  For hits that are shown only."""
    sensitive, needle, substring = query.sensitive, query.needle, query.mode == "substring"
    atoms = [a if sensitive else _fold(a) for neg, kind, a in parse_atoms(query.pattern) if not neg]

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def mark(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            hay = t if sensitive else _fold(t)
            at = hay.find(needle)
            if at >= 0:
                places = list(range(at, at + len(needle)))
            else:
                places = [] if substring else [p for a in atoms for p in alignment_places(hay, a)]
            out.append([{"start": a, "end": b} for a, b in merge_spans(places)])
        return pd.Series(out)

    return mark(text)


def hits(lines: DataFrame, query: Query) -> DataFrame:
    """Matching lines with ``score``, ``hl_start`` and ``hl_end`` (the literal
    occurrence in characters, null if there is none)."""
    if query.blank:
        return lines.where(F.lit(False)).select("*", F.lit(0).cast("bigint").alias("score"), F.lit(0).cast("bigint").alias("hl_start"), F.lit(0).cast("bigint").alias("hl_end"))
    rows = lines.where(F.col("origin").isin(*query.origins))
    if query.harnesses is not None:
        rows = rows.where(F.col("harness").isin(*query.harnesses))
    rows = rows.where(matches(query, F.col("text")))
    hay = F.col("text") if query.sensitive else fold(F.col("text"))
    at = F.instr(hay, query.needle).cast("bigint")
    if query.mode == "substring":
        score = F.lit(16 * len(query.needle)).cast("bigint")
    else:
        score = fuzzy_scores(query, F.col("text")) + F.when(at > 0, F.lit(LITERAL_BONUS)).otherwise(0)
    return rows.select(
        "*", score.alias("score"), F.when(at > 0, at - 1).alias("hl_start"), F.when(at > 0, at - 1 + len(query.needle)).alias("hl_end")
    )


def one_shot(lines: DataFrame, query: Query) -> DataFrame:
    """Hits in transcript order; the limit caps hits.  Stores and the number of
    hits of a document don't count here."""
    found = hits(lines, Query(query.pattern, query.mode, query.case, query.origins)).orderBy("seq", "line_seq")
    return found.limit(query.limit) if query.limit is not None else found


def rank_documents(found: DataFrame, sessions: DataFrame, limit: int | None) -> DataFrame:
    """(key, ts, best, rank): best line first, then newest, then first found.
    With a limit this is a take-ordered and no global sort."""
    best = found.groupBy(*KEY).agg(F.max("score").alias("best"))
    docs = best.join(sessions.select(*KEY, "seq", "ts"), KEY)
    order = [F.desc("best"), F.desc("ts"), F.asc("seq")]
    if limit is not None:
        docs = docs.orderBy(*order).limit(limit)
    return docs.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def search(lines: DataFrame, sessions: DataFrame, query: Query) -> DataFrame:
    """(key, rank, best, hit_no, msg_idx, origin, line_seq, text, hl_start,
    hl_end).  A blank pattern lists all chosen sessions, newest first, as rows
    without a hit."""
    if query.blank:
        docs = sessions if query.harnesses is None else sessions.where(F.col("harness").isin(*query.harnesses))
        docs = docs.orderBy(F.desc("ts"), "seq")
        return docs.limit(query.limit) if query.limit is not None else docs
    found = hits(lines, query)
    by = Window.partitionBy(*KEY).orderBy(F.desc("score"), "line_seq")
    top = found.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= query.hits_per_doc)
    # a document's hits travel with it from here, so lines are matched and scored once
    fields = [c for c in found.columns if c not in (*KEY, "seq")]
    docs = top.groupBy(*KEY).agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct("line_seq", F.struct(*fields).alias("h")))).alias("hits"))
    docs = docs.join(sessions.select(*KEY, "seq", "ts"), KEY)
    order = [F.desc("best"), F.desc("ts"), F.asc("seq")]
    if query.limit is not None:
        docs = docs.orderBy(*order).limit(query.limit)
    docs = docs.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    rows = docs.select(*KEY, "rank", "best", F.posexplode("hits").alias("n", "x"))
    return rows.select(*KEY, "rank", "best", (F.col("n") + 1).cast("bigint").alias("hit_no"), "x.h.*")


def upsert(index: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """The last version of every key."""
    by = Window.partitionBy(*KEY).orderBy(F.desc(version))
    both = index.unionByName(changes)
    return both.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def remove(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys, KEY, "left_anti")
