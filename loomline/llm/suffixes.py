"""Equality classes of suffixes by their first ``length`` bytes, with a difference cover for long ties.

A perfect difference set D modulo v has, for any two positions, exactly one
shift below v that brings both onto positions whose remainder lies in D.  So
sorting only the sample, the strings of length - v bytes at those positions,
settles the middle of every pair of suffixes: two suffixes agree in ``length``
bytes if they agree in the first v, in the last v, and in the rank of the sample
at that one shift.
"""

from __future__ import annotations

import functools

import numpy as np

from loomline.llm.rolling import Rolling

_U = np.uint64
#: Perfect difference sets: period, and the remainders that are sampled.  Fixed values.
COVERS: dict[int, tuple[int, ...]] = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
#: Bytes of a rank as it is kept and compared.
RANK_BYTES = 6


class Cover:
    """The cover of the largest period that leaves a sample of at least half of ``length`` bytes."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.period = v = max(p for p in COVERS if 2 * p <= length)
        self.span = length - v
        self.marks = np.array(COVERS[v])
        self.width = k = len(self.marks)
        sampled = np.zeros(v, bool)
        sampled[self.marks] = True
        self.sampled = sampled
        #: How many sample positions of a period lie before a remainder.
        self.before = np.concatenate([[0], np.cumsum(sampled)[:-1]])
        shifts = np.sort((self.marks[None, :] - np.arange(v)[:, None]) % v, axis=1)
        #: slot[a, b]: which of the k samples after a position of remainder a is the one that suits b as well.
        self.slot = np.zeros((v, v), np.int8)
        at = np.full((v, v), -1)
        at[np.arange(v)[:, None], shifts] = np.arange(k)
        for a in range(v):
            hit = at[:, shifts[a]] >= 0  # which shifts of a each b has
            self.slot[a] = hit.argmax(axis=1)

    def index(self, position: np.ndarray | int):
        """Number of sample positions before a position."""
        return position // self.period * self.width + self.before[position % self.period]

    def positions(self, n: int) -> np.ndarray:
        """Sample positions of a text of n bytes whose strings fit."""
        whole = np.arange(0, max(0, n - self.span + 1), self.period)
        out = (whole[:, None] + self.marks).ravel()
        return out[out <= n - self.span]


@functools.lru_cache(8)
def cover(length: int) -> Cover:
    return Cover(length)


def _dense(*columns: np.ndarray) -> np.ndarray:
    """The number of each row among the distinct rows, in sorted order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def classes(c: Cover, head: np.ndarray, tail: np.ndarray, position: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """A label for each suffix, equal for those that agree in their first ``length`` bytes.

    head and tail are digests of the first and last v of these bytes, position
    is where the suffix starts in its text, and row i of ranks has the ranks of
    the samples from there on, 0 for those that occur once.

    Suffixes are sorted by head and tail.  Within a tie, those of one remainder
    compare by their first sample; then the suffixes of the tie's first
    remainder are matched with all others by the sample that both have, those
    matched leave, and so on: at most v rounds, in each of which all ties take
    part at once.
    """
    n = len(head)
    if not n:
        return np.zeros(0, np.int64)
    tie = _dense(head, tail)
    rest = position % c.period
    # suffixes that agree in tie, remainder and a repeated first sample are one; without that they stay alone
    alone = np.where(ranks[:, 0] == 0, np.arange(1, n + 1), 0)
    label = _dense(tie, rest, ranks[:, 0], alone)
    _, first = np.unique(label, return_index=True)
    parent = np.arange(len(first))
    tie, rest, ranks = tie[first], rest[first], ranks[first]
    open_ = np.flatnonzero(np.bincount(tie)[tie] > 1)
    while len(open_):
        t, r = tie[open_], rest[open_]
        order = np.lexsort((r, t))
        start = np.concatenate([[True], t[order][1:] != t[order][:-1]])
        lead = np.empty(len(open_), r.dtype)
        lead[order] = r[order][start][np.cumsum(start) - 1]
        leads, others = open_[r == lead], open_[r != lead]
        if not len(others):
            break
        a = lead[r != lead]
        slots, mine = c.slot[a, rest[others]], c.slot[rest[others], a]
        # leads offer each of their samples, others ask for the one they share
        keys = (
            np.concatenate([np.repeat(tie[leads], c.width), tie[others]]),
            np.concatenate([np.tile(np.arange(c.width), len(leads)), slots]),
            np.concatenate([ranks[leads].ravel(), ranks[others, mine]]),
        )
        same = _dense(*keys)
        offer = np.full(same.max() + 1, -1)
        offer[same[: len(leads) * c.width]] = np.repeat(leads, c.width)
        found = np.where(keys[2][len(leads) * c.width :] != 0, offer[same[len(leads) * c.width :]], -1)
        hit = found >= 0
        parent[others[hit]] = found[hit]
        open_ = others[~hit]
        open_ = open_[np.bincount(tie[open_])[tie[open_]] > 1] if len(open_) else open_
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent[label]


def verified(c: Cover, label: np.ndarray, head: np.ndarray, tail: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Labels that are equal for equal bytes alone; suffix i is data[at[i]:][:length].

    Digests can agree where bytes do not.  So each suffix is held against the
    first of its class, neighbours that go on side by side once for every
    ``length`` bytes, and a tie with any that differ is told apart by its bytes.
    """
    n = len(label)
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    like = at[first[of]]
    new = np.ones(n, bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(like) != 1)
    stretch = np.cumsum(new) - 1
    step = np.arange(n) - np.flatnonzero(new)[stretch]
    asked = np.flatnonzero((like != at) & ((step % c.length == 0) | np.append(new[1:], True)))
    strings = np.lib.stride_tricks.sliding_window_view(data, c.length)
    differ = [asked[k : k + 4096][(strings[at[asked[k : k + 4096]]] != strings[like[asked[k : k + 4096]]]).any(axis=1)] for k in range(0, len(asked), 4096)]
    wrong = np.concatenate([np.zeros(0, np.int64), *differ])
    if not len(wrong):
        return label
    tie, label = _dense(head, tail), label.copy()
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(np.isin(tie, tie[np.isin(stretch, stretch[wrong])])).tolist():
        label[i] = seen.setdefault(strings[at[i]].tobytes(), n + i)
    return label


class Runs:
    """Runs of consecutive suffixes with the bytes and the sample ranks that they need."""

    def __init__(self, c: Cover, rolling: Rolling) -> None:
        self.cover, self.rolling = c, rolling

    def expand(self, firsts: np.ndarray, counts: np.ndarray, data: np.ndarray, ranks: np.ndarray):
        """(run, position, head, tail, ranks) of every suffix.

        Run i has counts[i] suffixes from position firsts[i] on; data holds the
        bytes of all runs one after the other, counts[i] - 1 + length each, and
        ranks those of the samples from its first suffix to its last one's end.
        """
        c, n = self.cover, int(counts.sum())
        run = np.repeat(np.arange(len(counts)), counts)
        ahead = np.concatenate([[0], np.cumsum(counts)[:-1]])
        step = np.arange(n) - ahead[run]
        position = firsts[run] + step
        offset = np.concatenate([[0], np.cumsum(counts - 1 + c.length)[:-1]])
        at = offset[run] + step
        prefix = self.rolling.prefix(data)
        head = self.rolling.strings(prefix, at, c.period)
        tail = self.rolling.strings(prefix, at + c.length - c.period, c.period)
        sizes = self.samples(firsts, counts)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        i = begin[run] + c.index(position) - c.index(firsts)[run]
        return run, position, head, tail, np.lib.stride_tricks.sliding_window_view(ranks, c.width)[i]

    def samples(self, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many ranks each run carries."""
        c = self.cover
        return c.index(firsts + counts - 1) - c.index(firsts) + c.width


def pack_ranks(ranks: np.ndarray) -> bytes:
    return ranks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :RANK_BYTES].tobytes()


def unpack_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks from the bytes of pack_ranks(), laid end to end."""
    out = np.zeros((len(data) // RANK_BYTES, 8), np.uint8)
    out[:, :RANK_BYTES] = data.reshape(-1, RANK_BYTES)
    return out.view("<u8").ravel().astype(_U)
