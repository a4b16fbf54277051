"""URL filter by a weighted vocabulary.

The vocabulary is a table of terms and weights: ``url_terms.tsv`` beside this file,
or any other list.  A term whose weight reaches ``limit`` is strict and rejects
alone; the others are soft, and a URL goes if the weights of its distinct soft
terms reach ``limit`` together.  Aho-Corasick finds every term in the lower-cased
URL in one pass, however many terms there are.  A hit counts only between
boundaries (neither neighbour is a letter or digit).

Defined cases: a null URL has no hits and is kept; an empty one too; a very long one
is searched whole; repeated hits of one soft term count once; of a term that is
listed twice the larger weight counts (a tie is no matter); rows are judged one by
one, so repeated rows each get a verdict; an empty table gives an empty one, an empty
vocabulary rejects nothing; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, pick

Terms = Iterable[tuple[str, float]]
TERMS_FILE = Path(__file__).with_name("url_terms.tsv")
LIMIT = 2.0


def load_terms(path: str | Path = TERMS_FILE) -> list[tuple[str, float]]:
    """(term, weight) lines of a file with a heading."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()[1:]
    return [(t.lower(), float(w)) for t, w in (line.split("\t") for line in lines if line.strip())]


TERMS = load_terms()


def automaton(terms: Terms):
    import ahocorasick

    a = ahocorasick.Automaton()
    weights: dict[str, float] = {}
    for term, weight in terms:
        if term:
            weights[term.lower()] = max(weight, weights.get(term.lower(), weight))
    for term, weight in weights.items():
        a.add_word(term, (term, weight))
    if len(a):
        a.make_automaton()
    return a


def hits(a, url: str | None) -> dict[str, float]:
    """Distinct terms of ``url`` between boundaries, with their weights."""
    found: dict[str, float] = {}
    if not url or not len(a):
        return found
    low = url.lower()
    n = len(low)
    for end, (term, weight) in a.iter(low):
        start = end - len(term) + 1
        if (start and low[start - 1].isalnum()) or (end + 1 < n and low[end + 1].isalnum()):
            continue
        found[term] = weight
    return found


def filter_urls(
    pages: DataFrame, url_col: str = "url", id_col: str = "page_id", terms: Terms = TERMS, limit: float = LIMIT
) -> DataFrame:
    """(id, url, strict_hits, soft_hits, rejected) of every row.  One pass with
    no shuffle, and the scan reads the two columns only.  The terms go to the tasks
    with the function, so they have to fit in memory, as an automaton must."""
    chosen = pick(pages, id=id_col, url=url_col)
    kind = chosen.schema["id"].dataType.simpleString()
    terms = tuple(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(terms)
        for b in batches:
            strict, soft, gone = [], [], []
            for u in b.column("url").to_pylist():
                found = hits(a, u).values()
                low = [w for w in found if w < limit]
                strict.append(len(found) - len(low))
                soft.append(len(low))
                gone.append(strict[-1] > 0 or (bool(low) and sum(low) >= limit))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("url"), pa.array(strict, pa.int64()), pa.array(soft, pa.int64()), pa.array(gone, pa.bool_())],
                ["id", "url", "strict_hits", "soft_hits", "rejected"],
            )

    out = chosen.mapInArrow(lean(run), f"id {kind}, url string, strict_hits bigint, soft_hits bigint, rejected boolean")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def oracle(terms: Terms = TERMS, limit: float = LIMIT) -> str:
    rows = ", ".join(f"('{t}', {w})" for t, w in terms)
    return f"""
        WITH terms(term, weight) AS (VALUES {rows}),
        urls AS (
            SELECT DISTINCT url, lower(url) AS low FROM pages WHERE url IS NOT NULL),
        found AS (
            SELECT u.url, count(*) FILTER (weight >= {limit}) AS strict_hits, count(*) FILTER (weight < {limit}) AS soft_hits,
                   sum(weight) FILTER (weight < {limit}) AS soft_weight
            FROM urls u JOIN terms t ON contains(u.low, t.term)
             AND regexp_matches(u.low, '(^|[^\\p{{L}}\\p{{N}}])' || t.term || '([^\\p{{L}}\\p{{N}}]|$)')
            GROUP BY u.url)
        SELECT p.page_id, p.url,
               CAST(coalesce(strict_hits, 0) AS BIGINT) AS strict_hits,
               CAST(coalesce(soft_hits, 0) AS BIGINT) AS soft_hits,
               coalesce(strict_hits, 0) > 0 OR coalesce(soft_weight, 0) >= {limit} AS rejected
        FROM pages p LEFT JOIN found USING (url)"""
