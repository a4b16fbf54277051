"""Queries of the folder against their SQL, and the pipeline end to end."""

import itertools
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import exact_dedup, packing, queries, simhash, suffix_dedup, toxicity
from threadloom.llm.common import encoder, table

SF = "/root/testdata/sf0.001"


def canon(x):
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([canon(r[c]) for c in columns] for r in got.collect()) == sorted([canon(r[i]) for i in at] for r in want.fetchall())


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]


def windows(rows):
    """What windows hold, and which documents: those without an order among equals."""
    return sorted((r.used, r.n_docs) for r in rows), Counter((s.doc_id, s.start, s.len) for r in rows for s in r.segments)


def test_pipeline_is_its_stages(spark):
    docs = table(spark, SF, "documents")
    by_hand = toxicity.drop_toxic(docs, table(spark, SF, "labels"))
    by_hand = simhash.drop_near_duplicates(exact_dedup.drop_duplicates(by_hand))
    by_hand = suffix_dedup.cut_repeats(by_hand)
    assert by_hand.columns == docs.columns
    want = windows(packing.pack(by_hand, unknown=True).collect())
    got = windows(corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_brute_force(spark):
    """Every stage again in plain Python, but for the classifier's verdicts."""
    docs = table(spark, SF, "documents")
    verdict = {r.doc_id: r.toxic for r in toxicity.classify(docs, table(spark, SF, "labels")).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if not verdict[r.doc_id] and r.text is not None)
    first = {}
    rows = [(i, t) for i, t in rows if first.setdefault(t, i) == i]
    make = simhash.Fingerprints()
    fps = [(i, f) for i, f in ((i, make.of(t)) for i, t in rows) if f is not None]
    words = np.frombuffer(b"".join(f for _, f in fps), np.uint64).reshape(len(fps), -1)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in np.flatnonzero(simhash.distance(words[:a], words[a]) <= simhash.MAX_DISTANCE).tolist():
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    near = {fps[n][0] for n in range(len(fps)) if find(n) != n}
    rows = [(i, t) for i, t in rows if i not in near]
    seen, cut = set(), []
    for i, t in rows:
        w = t.split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            gone[p : p + 50] |= k in seen
            seen.add(k)
        spans, p = [], 0
        for on, run in itertools.groupby(gone):
            n = len(list(run))
            spans += [(p, p + n)] if on else []
            p += n
        t = suffix_dedup._without(t, spans) if spans else t
        cut += [(i, t)] if t else []
    encode = encoder("byte_bpe_50k.tiktoken")
    lengths = {i: len(encode(t)) for i, t in cut}
    got = corpus_pipeline.run(spark, SF).collect()
    held = Counter()
    for r in got:
        assert r.used == sum(s.len for s in r.segments) <= packing.WINDOW
        for s in r.segments:
            held[s.doc_id] += s.len
    assert dict(held) == {i: n for i, n in lengths.items() if n}
    rooms = []
    for n in sorted((n % packing.WINDOW for n in lengths.values() if n % packing.WINDOW), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(packing.WINDOW - n)
    assert sorted(r.used for r in got if r.window_id >= 0) == sorted(packing.WINDOW - x for x in rooms)


def test_pipeline_drops_near_copies_without_a_common_block(spark):
    """Pairs of texts within the distance that the blocks of the first pass don't bring
    together."""
    r, make, rows = np.random.default_rng(31), simhash.Fingerprints(), []
    for n in range(6000):
        words = [f"word{x}" for x in r.choice(10**6, 60, False)]
        other = words[:-7] + [f"else{x}" for x in r.choice(10**6, 7, False)]
        texts = [" ".join(w) for w in (words, other)]
        fps = np.frombuffer(b"".join(map(make.of, texts)), np.uint8).reshape(2, -1)
        if not 70 <= simhash.distance(*fps) <= simhash.MAX_DISTANCE:
            continue
        bits, keys = np.unpackbits(fps, axis=1), simhash.table_keys(fps)
        tables = np.flatnonzero(keys[0] == keys[1])
        if not (bits[0] == bits[1])[simhash.set_bits(simhash.SET_BITS)[tables]].all(axis=2).any():
            rows += [(2 * n, texts[0]), (2 * n + 1, texts[1])]
    assert len(rows) >= 4
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [x.doc_id for x in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SF).collect()]
    assert sorted(kept) == sorted(i for i, _ in rows[::2])


AWKWARD = [
    (1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, None, None), (3, "", "en"), (None, "lost words stay here", "de"),
    (None, None, None), (4, " ".join(f"w{n % 977}" for n in range(30_000)), "en"),
]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_pipeline_stages_take_odd_rows(spark, stage):
    rows = [(i, t, g, 1.5, "x", i) for i, t, g in AWKWARD]
    names = ["doc_id", "text", "lang", "meta.x", "a`b", "Text"]
    docs = spark.createDataFrame(rows, "a bigint, b string, c string, d double, e string, f bigint").toDF(*names)
    name, f = stage
    out = f(spark, docs, SF)
    if name == "packing":
        got = Counter(s.doc_id for r in out.collect() for s in r.segments)
        assert got[1] == 2 and got[None] == 1 and got[4] > 10 and set(got) == {1, None, 4}
        return
    got = out.collect()
    assert out.columns == names and all(r[3] == 1.5 and r[4] == "x" and r[5] == r[0] for r in got)
    ids = Counter(r[0] for r in got)
    assert ids == Counter({1: 2 if name in ("toxicity", "suffix_dedup") else 1, 2: 1, 3: 1, None: 2, 4: 1})


def test_scratch_keeps_results_only(spark):
    from threadloom.llm import common

    with common.scratch() as result:
        a = common.stored(spark.range(5), "a")
        b = result(a.where("id > 2"), "b")
    assert b.count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(a.inputFiles()[0].rsplit("/", 1)[0]).count()
    common.discard(b)


def test_pipeline_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
