"""Runs of periodic words, by a harmonic grid of common-extension queries.

A stretch of words with period p that is at least three periods long holds three
neighbouring multiples of p.  So for each p the grid 0, p, 2p, ... is asked how
far the words from jp and (j+1)p on agree, and how far those before: the forward
answer is a range minimum over the LCP array of the suffix array, the backward
one the same over the reversed words.  Both together are the stretch that keeps
period p.  Grid points whose words differ agree in no word, and need no lookup;
over all p the grid has n log n points.

Documents are taken together, many at a time and each whole, within the task
that reads them: nothing is shuffled.  Suffixes end with their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.llm import splitting
from loomline.llm.common import merge_spans

#: A run has at least so many words, and at least so many periods; the grid needs three.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the documents that are taken together, and grid pairs that are looked up together.
GATHER, PAIRS = 1 << 19, 1 << 18
#: Entries of a block of the range minima.
BLOCK = 16
#: Words that are compared pair by pair for all pairs at once before long agreements are measured one by one.
SHORT = 8


class Minima:
    """Minima of ranges of an array: within blocks by running minima, over blocks by a sparse table; linear in size."""

    def __init__(self, values: np.ndarray) -> None:
        blocks = np.pad(values, (0, -len(values) % BLOCK), constant_values=np.iinfo(values.dtype).max).reshape(-1, BLOCK)
        self.blocks = blocks
        self.left = np.minimum.accumulate(blocks, axis=1).ravel()
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << (k := len(self.table) - 1) <= len(blocks):
            self.table.append(np.minimum(self.table[-1][: -1 << k], self.table[-1][1 << k :]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest of values[lo] to values[hi], hi included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.right[lo], self.left[hi])
        one = np.flatnonzero(a == b)
        if len(one):
            at = np.arange(BLOCK)
            among = (at >= (lo[one] % BLOCK)[:, None]) & (at <= (hi[one] % BLOCK)[:, None])
            out[one] = np.where(among, self.blocks[a[one]], np.iinfo(self.blocks.dtype).max).min(axis=1)
        many = np.flatnonzero(b - a > 1)
        level = np.frexp((b - a - 1)[many])[1] - 1
        for k in np.unique(level).tolist():
            i = many[level == k]
            out[i] = np.minimum(out[i], np.minimum(self.table[k][a[i] + 1], self.table[k][b[i] - (1 << k)]))
        return out


def suffix_array(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, the place of each), document by document, by prefix doubling of those that still tie.

    words are numbers from 0 on, doc is that of each word and ascends, ends is
    where each document ends.  A suffix that ends sorts before one that goes on.
    """
    n = len(words)
    key = doc * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    place, slots, h = np.empty(n, np.int64), np.arange(n), 1
    key = key[order]
    while True:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        place[order[slots]] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order, place
        a = order[slots]
        follows = np.where(a + h < ends[doc[a]], place[np.minimum(a + h, n - 1)] + 1, 0)
        key = place[a] * (n + 1) + follows
        now = np.argsort(key, kind="stable")
        key, order[slots] = key[now], a[now]
        h *= 2


def _agreement(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from a and from b on are equal, ``most`` at most."""
    n, step = 0, 64
    while n < most:
        m = min(step, most - n)
        unlike = words[a + n : a + n + m] != words[b + n : b + n + m]
        at = int(unlike.argmax())
        if unlike[at]:
            return n + at
        n, step = n + m, 2 * step
    return n


def lcp_array(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many words each suffix in order shares with the one before it.

    In the order of the text, an entry is one less than the one before it where
    the words before both suffixes are equal.  Only the others are measured;
    together they have n log n words.
    """
    n, at = len(words), np.arange(len(words))
    before = np.full(n, -1)
    same = doc[order[1:]] == doc[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    first = starts[doc]
    derived = (before > first) & (at > first) & (words[before - 1] == words[at - 1])
    measured = np.zeros(n, np.int64)
    a = np.flatnonzero(~derived & (before >= 0))
    b, end = before[a], ends[doc[a]]
    for k in range(SHORT):
        on = np.maximum(a, b) + k < end
        a, b, end = a[on], b[on], end[on]
        on = words[a + k] == words[b + k]
        a, b, end = a[on], b[on], end[on]
        measured[a] += 1
    for x, y, e in zip(a.tolist(), b.tolist(), end.tolist(), strict=True):
        measured[x] += _agreement(words, x + SHORT, y + SHORT, e - max(x, y) - SHORT)
    last = np.maximum.accumulate(np.where(derived, 0, at))
    return (measured[last] - (at - last))[order]


class Extensions:
    """How many words two places of a document have in common from there on."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        order, self.place = suffix_array(words, doc, ends)
        self.minima = Minima(lcp_array(words, doc, starts, ends, order))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.place[a], self.place[b]
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b))


def _grid(words: np.ndarray, doc: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid pairs whose words agree, and agree with those a period on, PAIRS or so at a time."""
    key = doc * (int(words.max()) + 1) + words
    places, periods, n = [], [], 0
    for p in range(1, longest // LEAST_PERIODS + 1):
        grid = key[::p]
        same = grid[1:] == grid[:-1]
        j = np.flatnonzero(same[1:] & same[:-1])
        if len(j):
            places.append(j * p)
            periods.append(np.full(len(j), p))
            n += len(j)
            if n >= PAIRS:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, n = [], [], 0
    if n:
        yield np.concatenate(places), np.concatenate(periods)


def _least(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each (start, end), with its smallest period; a multiple of a run's period spans the same words."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.zeros(0, bool)
    return start[new], end[new], period[new]


def find(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of documents laid end to end, sorted; counts are their numbers of words."""
    none = (np.zeros(0, np.int64),) * 3
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(words):
        return none
    pairs = _grid(words, doc, int(counts.max()))
    ahead = next(pairs, None)
    if ahead is None:
        return none
    # the arrays are made of the documents that any pair has been found in, unless there may be more pairs to come
    hit = np.zeros(len(counts), bool)
    hit[doc[ahead[0]]] = True
    second = next(pairs, None)
    if second is not None:
        hit[:] = True
    kept = hit[doc]
    words, doc, shift = words[kept], (np.cumsum(hit) - 1)[doc[kept]], np.flatnonzero(kept)
    back = np.cumsum(kept) - 1
    ends = np.cumsum(counts[hit])
    starts, n = ends - counts[hit], len(words)
    forward = Extensions(words, doc, starts, ends)
    backward = Extensions(words[::-1], len(starts) - 1 - doc[::-1], (n - ends)[::-1], (n - starts)[::-1])
    found = []
    for place, period in _chained(ahead, second, pairs):
        place = back[place]
        on = forward(place, place + period)
        prior = np.zeros(len(place), np.int64)
        inner = np.flatnonzero(place > starts[doc[place]])
        prior[inner] = backward(n - place[inner], n - place[inner] - period[inner])
        long = prior + period + on >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        place, period, on, prior = place[long], period[long], on[long], prior[long]
        found.append(_least(place - prior, place + period + on, period))
    start, end, period = _least(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return (shift[start], shift[end - 1] + 1, period) if len(start) else none


def _chained(first, second, rest):
    yield first
    if second is not None:
        yield second
        yield from rest


def _kept(text: bytes, lo: np.ndarray, hi: np.ndarray, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text but those that a run contains after its first period, joined by one space; word i lies from lo[i] to hi[i]."""
    a, b = merge_spans(np.array([s + q for s, _, q in runs]), np.array([e for _, e, _ in runs]))
    out, at = [], 0
    for s, e in zip([*a.tolist(), len(lo)], [*b.tolist(), len(lo)], strict=True):
        if s > at:
            out.append(splitting.spaced(text[lo[at] : hi[s - 1]]))
        at = e
    return b" ".join(out)


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Runs of each text: stretches of words, 24 and three periods or more, that repeat with a smallest period and can't be longer.

    Words lie between ASCII white space.  Returns the columns ``keep`` and
    n_words, ``runs`` (start, length, period; by start, then period), ``top``
    (the run of the greatest length over period, exactly; of equals the first),
    and ``collapsed``, the text without the words that a run contains after its
    first period, joined by one space.

    Null and empty texts have no words, no run and an empty ``collapsed``.
    Repeated rows are answered each; long texts are whole; an empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    schema = ", ".join([*fields, "n_words long, runs array<struct<start:long,length:long,period:long>>, top struct<start:long,length:long,period:long>, collapsed string"])

    def answered(kept: list[list], texts: list[bytes]) -> pa.RecordBatch:
        words, counts, lo, hi = splitting.split(texts, splitting.BETWEEN_SPACES)
        start, end, period = find(splitting.numbered(words)[0].astype(np.int64), counts)
        first = np.cumsum(counts) - counts
        of = np.searchsorted(np.cumsum(counts), start, side="right")
        cuts = np.searchsorted(of, np.arange(len(counts) + 1)).tolist()
        ahead = 0
        runs, tops, collapsed = [], [], []
        for d, text in enumerate(texts):
            mine = slice(cuts[d], cuts[d + 1])
            each = sorted(zip((start[mine] - first[d]).tolist(), (end[mine] - first[d]).tolist(), period[mine].tolist(), strict=True), key=lambda r: (r[0], r[2]))
            runs.append([(s, e - s, q) for s, e, q in each])
            tops.append(min(runs[-1], key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None))
            at = slice(first[d], first[d] + counts[d])
            collapsed.append(_kept(text, lo[at] - ahead, hi[at] - ahead, each) if each else splitting.spaced(text))
            ahead += len(text) + 1
        named = [[None if r is None else dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in (*runs, tops)]
        columns = [*(pa.array(c, docs_types[i]) for i, c in enumerate(kept)), pa.array(counts, pa.int64()), pa.array(named[:-1], pa.list_(run_type)), pa.array(named[-1], run_type), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "runs", "top", "collapsed"])

    docs_types: list[pa.DataType] = []

    def run(batches):
        kept, texts, size = [[] for _ in keep], [], 0
        for batch in batches:
            docs_types[:] = [batch.column(c).type for c in keep]
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for held, c in zip(kept, keep, strict=True):
                    held += part.column(c).to_pylist()
                texts += splitting.parts(part.column("text"))
                size += part.column("text").nbytes
                if size >= 6 * GATHER:
                    yield answered(kept, texts)
                    kept, texts, size = [[] for _ in keep], [], 0
        if texts:
            yield answered(kept, texts)

    return docs.select(*keep, "text").mapInArrow(run, schema)
