"""Which of many literal texts stand in each row, by one automaton over all."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of needles that a task's automaton may hold; beyond, a join tests
#: them one by one.
MOST_CHARS = 20_000_000


def needles_in(rows: DataFrame, column: str, needles: DataFrame) -> DataFrame:
    """(item_id) for each row and each needle in it; ``needles`` has (item_id,
    text).  Empty and null needles are in nothing."""
    known = needles.where("text <> ''").select("item_id", "text")
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    hay = rows.select(F.col(column).alias("hay")).where("hay IS NOT NULL")
    if size > MOST_CHARS:
        return hay.join(known, F.expr("instr(hay, text) > 0")).select("item_id")
    found = [(r["text"], r["item_id"]) for r in known.collect()]  # bounded by MOST_CHARS
    kind = needles.schema["item_id"].dataType.simpleString()
    arrow = known.limit(0).toArrow().schema.field("item_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for text, item in found:
            a.add_word(text, a.get(text, ()) + (item,))
        if len(a):
            a.make_automaton()
        for b in batches:
            items = []
            for t in b.column("hay").to_pylist() if len(a) else []:
                seen = {words for _, words in a.iter(t)}
                items += [i for words in seen for i in words]
            yield pa.RecordBatch.from_arrays([pa.array(items, arrow)], ["item_id"])

    return hay.mapInArrow(run, f"item_id {kind}")
