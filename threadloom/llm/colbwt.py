"""Burrows-Wheeler transform and common prefixes of many strings, built column
by column.

Round ``j`` inserts the suffix of length ``j`` of every string that has one: a
sequential pass ranks the symbols before the places of the last insertions,
which gives the new places, and a second one writes the new files with the
insertions in them.  Beside each symbol of the transform lie the common prefix
with the suffix before and the suffix itself, as string number and length.  Common
prefixes have one byte if no string has more than 254 symbols, else four.  Common prefixes are updated in the ranking pass: two suffixes that
begin alike share one symbol more than the stretch between the places of their
rests.

A column is a sequential file.  It stays in memory while it has at most
``spool`` bytes, and is otherwise in the folder that the cluster shares.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Symbols that a pass holds at once.
BLOCK = 1 << 17
SPOOL = 1 << 20
END = 0


class Column:
    """One sequential file of numbers."""

    def __init__(self, dtype, folder: str | None, spool: int = SPOOL):
        self.dtype, self.folder, self.spool = np.dtype(dtype), folder, spool
        self.parts: list[np.ndarray] = []
        self.held = 0
        self.fs = self.path = self.out = None

    def append(self, x: np.ndarray) -> None:
        x = np.ascontiguousarray(x, self.dtype)
        if self.out is not None:
            self.out.write(x)
            return
        self.parts.append(x)
        self.held += x.nbytes
        if self.folder is not None and self.held > self.spool:
            from pyarrow import fs

            self.fs, root = fs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(root, recursive=True)
            self.path = f"{root}/{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.path)
            for p in self.parts:
                self.out.write(p)
            self.parts = []

    def read(self, size: int = BLOCK) -> Iterator[np.ndarray]:
        if self.out is None:
            for p in self.parts:
                for s in range(0, len(p), size):
                    yield p[s : s + size]
            return
        if not self.out.closed:
            self.out.close()
        with self.fs.open_input_stream(self.path, buffer_size=1 << 20) as f:
            while raw := f.read(size * self.dtype.itemsize):
                yield np.frombuffer(raw, self.dtype)

    def drop(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.delete_file(self.path)
        self.parts = []


def _columns(kinds, folder, spool) -> list[Column]:
    return [Column(k, folder, spool) for k in kinds]


def _blocks(columns: list[Column]) -> Iterator[list[np.ndarray]]:
    """Blocks of several columns of equal length, cut at the same places."""
    readers = [c.read() for c in columns]
    rest: list[np.ndarray] = [np.empty(0, c.dtype) for c in columns]
    while True:
        for k, r in enumerate(readers):
            if not len(rest[k]):
                rest[k] = next(r, rest[k])
        n = min(map(len, rest))
        if not n:
            return
        yield [x[:n] for x in rest]
        rest = [x[n:] for x in rest]


def _rank(bwt: Column, lcp: Column, at: np.ndarray, start: np.ndarray, n_symbols: int):
    """The ranking pass.  ``at`` are sorted places whose symbol moves to the
    front.  Returns the new place of each, and (places, common prefixes) of the
    suffixes that come in and of those just behind them."""
    kind = lcp.dtype
    top = np.iinfo(kind).max  # more than any common prefix
    place = np.empty(len(at), np.int64)
    seen = np.zeros(n_symbols, np.int64)
    since = np.full(n_symbols, top, kind)  # least common prefix since the last of the symbol
    behind = np.zeros(n_symbols, bool)  # the next one of the symbol stands behind an insertion
    places, values = [], []
    base = done = 0
    for s, common in _blocks([bwt, lcp]):
        n = len(s)
        end = int(np.searchsorted(at, base + n))
        here = at[done:end] - base
        order = np.argsort(s, kind="stable")
        sym = s[order]
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(sym[1:], sym[:-1], out=first[1:])
        heads = np.flatnonzero(first)
        symbols = sym[heads].astype(np.int64)
        sizes = np.diff(np.append(heads, n))
        rank = np.arange(n) - np.repeat(heads - seen[symbols], sizes)  # along ``order``
        slot = np.empty(n, np.int64)
        slot[order] = np.arange(n)
        mine = slot[here]
        place[done:end] = start[s[here]] + rank[mine]
        # whose common prefix is wanted: insertions, and the next of their symbol
        want = np.zeros(n + 1, bool)
        want[mine] = True
        nxt = mine + 1
        inside = nxt < n
        inside[inside] = ~first[nxt[inside]]
        want[nxt[inside]] = True
        want[heads[behind[symbols]]] = True
        want = want[:n]
        want[: int(sizes[0]) if sym[0] == END else 0] = False
        behind[symbols] = False
        behind[s[here[~inside]]] = True
        w = np.flatnonzero(want)
        q = order[w].astype(np.int64)
        head = first[w]
        value = np.empty(len(w), np.int64)
        down = np.minimum.accumulate(common)
        hs = sym[w[head]]
        known = seen[hs] > 0
        value[head] = np.where(known, 1 + np.minimum(since[hs], down[q[head]]).astype(np.int64), 0)
        b, a = q[~head] + 1, order[w[~head] - 1].astype(np.int64) + 1
        if len(a):
            by = np.argsort(a, kind="stable")
            pairs = np.empty(2 * len(a), np.int64)
            pairs[0::2], pairs[1::2] = a[by], b[by]
            padded = np.append(common, kind.type(top))
            least = np.empty(len(a), np.int64)
            least[by] = np.minimum.reduceat(padded, pairs)[0::2]
            value[~head] = 1 + least
        places.append(start[sym[w]] + rank[w])
        values.append(value)
        # what the next block needs
        up = np.minimum.accumulate(common[::-1])[::-1]
        since = np.minimum(since, up[0])
        last = order[heads + sizes - 1]
        since[symbols] = np.where(last + 1 < n, up[np.minimum(last + 1, n - 1)], top)
        seen[symbols] += sizes
        base += n
        done = end
    return place, np.concatenate(places), np.concatenate(values)


def build(
    strings: list[np.ndarray], n_symbols: int, folder: str | None = None, spool: int = SPOOL
) -> tuple[Column, Column, Column]:
    """(transform, common prefixes, suffixes) of strings of symbols from 1 to
    ``n_symbols`` - 1; a suffix is string number << 32 | length.  End marks are
    symbol 0, each distinct and less than all others, in the strings' order."""
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    prefix = np.uint8 if not m or sizes.max() < 255 else np.uint32
    kinds = (np.uint16 if n_symbols <= 1 << 16 else np.uint32, prefix, np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *strings]).astype(np.int64)
    ends = np.cumsum(sizes)

    def symbol(i: np.ndarray, j: int) -> np.ndarray:
        """Of strings ``i`` the one before the suffix of length ``j``."""
        has = sizes[i] > j
        return np.where(has, flat[np.where(has, ends[i] - 1 - j, 0)] if len(flat) else 0, END)

    now = _columns(kinds, folder, spool)
    active = np.arange(m)
    new = symbol(active, 0)
    for c, x in zip(now, (new, np.zeros(m), active << 32)):
        c.append(x)
    counts = np.bincount(new, minlength=n_symbols)
    at = np.arange(m)
    keep = new != END
    active, at, new = active[keep], at[keep], new[keep]
    j = 0
    while len(active):
        j += 1
        start = np.zeros(n_symbols, np.int64)
        start[1:] = m + np.concatenate([[0], np.cumsum(counts[1:])[:-1]])
        place, changed, values = _rank(now[0], now[1], at, start, n_symbols)
        order = np.argsort(place)
        active, place = active[order], place[order]
        new = symbol(active, j)
        by = np.argsort(changed)
        changed, values = changed[by], values[by]
        old_at = place - np.arange(len(place))  # where in the old file each goes in
        after = _columns(kinds, folder, spool)
        suffix = (active << 32) | j
        base = done = shift = set_ = 0
        # an insertion at the very end follows the last block
        for b, l, s in _blocks(now):
            n = len(b)
            end = int(np.searchsorted(old_at, base + n))
            k = old_at[done:end] - base
            out = [np.insert(x, k, y[done:end]) for x, y in ((b, new), (s, suffix))]
            common = np.insert(l, k, 0)
            upto = int(np.searchsorted(changed, base + shift + len(common)))
            common[changed[set_:upto] - base - shift] = values[set_:upto]
            for c, x in zip(after, (out[0], common, out[1])):
                c.append(x)
            base, done, shift, set_ = base + n, end, shift + end - done, upto
        if done < len(place):
            common = np.zeros(len(place) - done, prefix)
            common[changed[set_:] - base - shift] = values[set_:]
            for c, x in zip(after, (new[done:], common, suffix[done:])):
                c.append(x)
        for c in now:
            c.drop()
        now = after
        counts += np.bincount(new, minlength=n_symbols)
        keep = new != END
        active, at, new = active[keep], place[keep], new[keep]
    return now[0], now[1], now[2]


def repeats(
    strings: list[np.ndarray], n_symbols: int, least: int, folder: str | None = None, spool: int = SPOOL
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, group numbers): the suffixes that share their first ``least``
    symbols with another, in sorted order; a group may go on in
    the next block."""
    columns = build(strings, n_symbols, folder, spool)
    group, before = 0, None
    for _, common, suffix in _blocks(list(columns)):
        joined = common >= least
        number = group + np.cumsum(~joined)
        follows = np.append(joined[1:], True)  # the block's last may be joined by the next
        hold = joined | follows
        if before is not None and joined[0]:
            yield before
        pick = np.flatnonzero(hold)
        if len(pick) and pick[-1] == len(joined) - 1 and not joined[-1]:
            before = (suffix[-1:].copy(), number[-1:].copy())
            pick = pick[:-1]
        else:
            before = None
        yield suffix[pick], number[pick]
        group = int(number[-1])
    for c in columns:
        c.drop()
