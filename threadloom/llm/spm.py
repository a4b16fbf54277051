"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

For each batch the texts' units that are not yet known are concatenated and
their suffixes sorted by prefix doubling, as far as the longest piece reaches.
Every piece of the vocabulary is binary-searched, all at once, for its range of
occurrences; the ranges give the edges (start, end, piece) of the lattice.
Edges are sorted by where they end in their unit, and positions are relaxed in
that order, in step for all units.

In a BPE model the edge to relax a position with is not the one of best score
but the one that merging would leave there: the prefix's last piece is the only
piece that is compatible with the last piece at its start, two neighbours being
compatible if merging their joined text gives just them.  That makes the result
equal to the library's, token for token.

A unit is a stretch that no piece crosses the border of: text is cut before
spaces that follow a non-space, and around newlines (if the vocabulary has no
piece across, which is checked).  Units with runs of spaces have pieces of
equal score and are merged directly.

Defined cases: a null text has null ids; an empty one has none; U+2581 in a text
is a space, as it is for the library; characters outside the vocabulary become byte pieces; repeated rows are encoded alike; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, lean, pick, texts

SPACE = "▁"
#: Characters of text whose units are collected before they are matched.
BATCH_CHARS = 1_500_000
#: Units a worker remembers.
CACHE_UNITS = 300_000
_CACHE_BITS = 21


class PieceModel:
    """Vocabulary and merge structure of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a model that leaves texts as they are is needed")
        self.prefix = " " if norm.add_dummy_prefix else ""
        pieces = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        self.n = len(proto.pieces)
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.id_of = {p.replace(SPACE, " "): i for i, p, _ in pieces}
        # best score first; equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({s for _, p, s in pieces if len(p) > 1}, reverse=True))}
        self.rank_of = {p.replace(SPACE, " "): order[s] for _, p, s in pieces if len(p) > 1}
        inner = [p for p in self.rank_of if " " in p.lstrip(" ")]
        mixed = [p for p in self.rank_of if p.startswith("  ") and p.strip(" ")]
        self.splits_at_spaces = not inner and not mixed
        self.splits_at_newlines = "\n" not in self.id_of and not any("\n" in p for p in self.rank_of)
        self.decoded = [b""] * self.n
        for i, p, _ in pieces:
            self.decoded[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.decoded[i] = bytes([b])
        self._structure()

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merging by score, leftmost first among equals; the last merge too."""
        parts: list[str | None] = list(text)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, int, str]] = []
        rank = self.rank_of

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                r = rank.get(both)
                if r is not None:
                    heapq.heappush(heap, (r, i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or nxt[i] != j or parts[i] + parts[j] != both:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            nxt[i] = nxt[j]
            if nxt[j] < len(parts):
                prv[nxt[j]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [p for p in parts if p is not None], last

    def _structure(self) -> None:
        """Rank and the two halves of each piece by id; characters have rank
        -1, and id ``n`` stands for a character outside the vocabulary."""
        self.rank = np.full(self.n + 1, -1, np.int64)
        self.left = np.arange(self.n + 1)
        self.right = np.arange(self.n + 1)
        match: list[tuple[bytes, int, int]] = []
        keys, ranks = [], []
        for p, i in self.id_of.items():
            if len(p) > 1:
                if p.startswith("  "):
                    continue  # of equal score; units that hold them are merged directly
                got, last = self.merged(p)
                if got != [p]:
                    continue  # merging never makes it
                a, b = (self.id_of[x] for x in last)
                self.rank[i], self.left[i], self.right[i] = self.rank_of[p], a, b
                keys.append(a * (self.n + 1) + b)
                ranks.append(self.rank_of[p])
            match.append((p.encode(), i, len(p)))
        order = np.argsort(keys)
        self.pair_key = np.array(keys, np.int64)[order]
        self.pair_rank = np.array(ranks, np.int64)[order]
        self.match_id = np.array([i for _, i, _ in match], np.int64)
        self.match_len = np.array([len(b) for b, _, _ in match], np.int64)
        self.match_chars = np.array([c for _, _, c in match], np.int64)
        self.blocks = -(-int(self.match_len.max()) // 8)
        raw = np.zeros((len(match), 8 * self.blocks), np.uint8)
        for k, (b, _, _) in enumerate(match):
            raw[k, : len(b)] = np.frombuffer(b, np.uint8)
        self.match_key = raw.view(">u8").astype(np.uint64)
        high = raw.copy()
        for k, (b, _, _) in enumerate(match):
            high[k, len(b) :] = 255
        self.match_high = high.view(">u8").astype(np.uint64)
        self._seen = np.zeros(1 << _CACHE_BITS, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of pieces a, b would leave just a, b."""
        key = a * (self.n + 1) + b + 1
        slot = (key * 0x9E3779B1) & ((1 << _CACHE_BITS) - 1)
        held = self._seen[slot]
        out = held == key * 2 + 1
        todo = np.flatnonzero(~out & (held != key * 2))
        if len(todo):
            _, first, back = np.unique(key[todo], return_index=True, return_inverse=True)
            pick = todo[first]
            good = self._compatible(a[pick], b[pick])
            self._seen[slot[pick]] = key[pick] * 2 + good
            out[todo] = good[back]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 60)
        while len(live):
            key = a * (self.n + 1) + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            stays = ~((self.pair_key[at] == key) & (self.pair_rank[at] < limit))
            ra, rb = self.rank[a], self.rank[b]
            done = stays & (ra < 0) & (rb < 0)
            out[live[done]] = True
            go = stays & ~done
            a, b, ra, rb, live = a[go], b[go], ra[go], rb[go], live[go]
            undo_a = ra > rb
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out


def suffix_order(text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (bytes) sorted by their first ``reach`` bytes at
    least, by prefix doubling from 8-byte keys; and the key at each position."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    first = key
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        if width >= reach:
            return order, first
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])).astype(np.uint64) + np.uint64(1)
        follow = np.zeros(n, np.uint64)
        follow[: max(0, n - width)] = rank[width:]
        key = (rank << np.uint64(32)) | follow
        width *= 2


def occurrences(model: PieceModel, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order, and of each piece the range of it that starts so."""
    order, key = suffix_order(text, 8 * model.blocks)
    ordered = key[order]
    lo = np.searchsorted(ordered, model.match_key[:, 0], side="left")
    hi = np.searchsorted(ordered, model.match_high[:, 0], side="right")
    # pieces of more than 8 bytes: on within the range of their first 8
    long = np.flatnonzero((model.match_len > 8) & (lo < hi))
    key = np.concatenate([key, np.zeros(8 * model.blocks, np.uint64)])

    def search(goal: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid]
            less = np.zeros(len(open_), bool)
            same = np.ones(len(open_), bool)
            for b in range(model.blocks):
                x, y = key[at + 8 * b], goal[open_, b]
                less |= same & (x < y)
                same &= x == y
            if after:
                less |= same
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    first = search(model.match_key[long], lo[long], hi[long], False)
    last = search(model.match_high[long], lo[long], hi[long], True)
    lo[long], hi[long] = first, last
    return order, lo, hi


def encode_units(model: PieceModel, units: list[str]) -> list[bytes]:
    """Ids (little-endian int32 bytes) of units without runs of spaces."""
    raw = [u.encode() for u in units]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    text = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    order, lo, hi = occurrences(model, text)
    count = hi - lo
    piece = np.repeat(np.arange(len(lo)), count)
    start = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    known = np.zeros(len(text), bool)
    known[start[model.match_chars[piece] == 1]] = True
    # characters outside the vocabulary: an edge of their own
    head = np.flatnonzero(((text & 0xC0) != 0x80) & (text != 0) & ~known)
    width = np.where(text[head] < 0x80, 1, np.where(text[head] < 0xE0, 2, np.where(text[head] < 0xF0, 3, 4)))
    end = np.concatenate([start + model.match_len[piece], head + width]).astype(np.int32)
    ids = np.concatenate([model.match_id[piece], np.full(len(head), model.n)])
    start = np.concatenate([start, head]).astype(np.int32)
    del piece, known
    unit_of = np.repeat(np.arange(len(raw)), lengths + 1)
    offset = (end - begin[unit_of[start]]).astype(np.int32)
    by_end = np.argsort(offset.astype(np.uint16) if len(offset) and offset.max() < 1 << 16 else offset, kind="stable")
    start, end, ids, offset = start[by_end], end[by_end], ids[by_end], offset[by_end]
    cuts = np.flatnonzero(np.diff(offset)) + 1
    bounds = np.concatenate([[0], cuts, [len(offset)]])
    last = np.full(len(text) + 1, -1, np.int64)
    back = np.zeros(len(text) + 1, np.int64)
    at_start = np.zeros(len(text) + 1, bool)
    at_start[begin] = True
    for s, e in zip(bounds[:-1], bounds[1:]):
        a, i = start[s:e], ids[s:e]
        free = at_start[a]
        good = free.copy()
        k = np.flatnonzero(~free & (last[a] >= 0))
        good[k] = model.compatible(last[a[k]], i[k])
        to = end[s:e][good]
        last[to] = i[good]
        back[to] = a[good]
    # walk back from the ends, in step
    at = begin + lengths
    live = np.flatnonzero(lengths > 0)
    steps_u, steps_t, steps_p = [], [], []
    while len(live):
        t = last[at[live]]
        if (t < 0).any():
            raise AssertionError("a position was not reached")
        steps_u.append(live)
        steps_t.append(t)
        at[live] = back[at[live]]
        steps_p.append(at[live])
        live = live[at[live] > begin[live]]
    if not steps_u:
        return [b""] * len(raw)
    u = np.concatenate(steps_u[::-1])
    t = np.concatenate(steps_t[::-1])
    p = np.concatenate(steps_p[::-1])
    by_unit = np.argsort(u, kind="stable")
    u, t, p = u[by_unit], t[by_unit], p[by_unit]
    out_of = t == model.n
    flat = t.astype(np.int32)
    sizes = np.bincount(u, minlength=len(raw))
    stop = np.cumsum(sizes)
    data = flat.tobytes()
    out = [data[4 * (b - c) : 4 * b] for b, c in zip(stop.tolist(), sizes.tolist())]
    for k in np.unique(u[out_of]).tolist():  # byte pieces in place of the character
        ids_k: list[int] = []
        for x, q in zip(t[stop[k] - sizes[k] : stop[k]].tolist(), p[stop[k] - sizes[k] : stop[k]].tolist()):
            if x != model.n:
                ids_k.append(x)
                continue
            c = int(text[q])
            for byte in text[q : q + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)]:
                ids_k.append(model.byte_id[int(byte)])
        out[k] = np.array(ids_k, np.int32).tobytes()
    return out


class Encoder:
    """Whole texts to ids, remembering units."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.cache: dict[str, bytes] = {}
        m = self.model
        self._unit = re.compile(r" *[^ ]+| +") if m.splits_at_spaces else re.compile(r"(?s).+")
        self.newline = b"".join(np.int32(m.byte_id[b]).tobytes() for b in b"\n")

    def units(self, text: str) -> list[str]:
        m = self.model
        if not text:
            return []
        text = m.prefix + text.replace(SPACE, " ")
        out: list[str] = []
        lines = text.split("\n") if m.splits_at_newlines else [text]
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            if "  " in line or not m.splits_at_spaces:
                out += self._unit.findall(line)
            elif line:
                parts = line.split(" ")
                if parts[0]:
                    out.append(parts[0])
                out += [" " + p for p in parts[1:]]
        return out

    def learn(self, units: set[str]) -> None:
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        new = [u for u in units if u not in cache]
        plain = [u for u in new if "  " not in u and "\0" not in u]
        for u, ids in zip(plain, encode_units(self.model, plain) if plain else []):
            cache[u] = ids
        for u in new:
            if u not in cache:
                cache[u] = self.merge_ids(u)

    def merge_ids(self, unit: str) -> bytes:
        m = self.model
        ids: list[int] = []
        for p in m.merged(unit)[0]:
            i = m.id_of.get(p)
            ids += [i] if i is not None else [m.byte_id[b] for b in p.encode()]
        return np.array(ids, np.int32).tobytes()

    def encode_batch(self, batch: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if x is None else self.units(x) for x in batch]
        self.learn({u for c in cut if c is not None for u in c})
        get = self.cache.__getitem__
        return [None if c is None else np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]


def decode_ids(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids: byte pieces are joined, invalid bytes replaced, and the
    space that encoding puts before a text is taken off again."""
    text = b"".join(map(model.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(column: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for x in texts(column):
        held.append(x)
        size += len(x or "")
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str = "piece_bpe_32k.model",
    folder: str = TOKENIZERS,
    check: bool = False,
) -> DataFrame:
    """(id, token_ids, n_tokens) of every row, in one pass with no shuffle.
    ``check`` adds ``round_trip``: whether decoding the ids gives the text."""
    path = os.path.join(folder, model)
    kind = pick(docs, id=id_col).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path)
        for b in batches:
            done = 0
            for part in _pieces(b.column("text")):
                ids = e.encode_batch(part)
                sizes = [0 if x is None else len(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                missing = pa.array([x is None for x in ids] + [False])
                column = pa.ListArray.from_arrays(
                    pa.array(offsets, mask=missing.to_numpy(zero_copy_only=False)), pa.array(values)
                )
                columns = [
                    b.column("id").slice(done, len(part)),
                    column,
                    pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                ]
                names = ["id", "token_ids", "n_tokens"]
                if check:
                    columns.append(
                        pa.array([None if x is None else decode_ids(e.model, x) == t for x, t in zip(ids, part)], pa.bool_())
                    )
                    names.append("round_trip")
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, token_ids array<int>, n_tokens bigint" + (", round_trip boolean" if check else "")
    chosen = pick(docs, id=id_col, text=text_col)
    return chosen.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def decode(
    tokens: DataFrame,
    id_col: str = "doc_id",
    ids_col: str = "token_ids",
    model: str = "piece_bpe_32k.model",
    folder: str = TOKENIZERS,
) -> DataFrame:
    """(id, text); null ids give a null text, an empty list an empty one."""
    path = os.path.join(folder, model)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _encoder(path).model
        for b in batches:
            out = [None if x is None else decode_ids(m, np.asarray(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "text"])

    chosen = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(lean(run), f"id {kind}, text string").withColumnRenamed("id", id_col)
