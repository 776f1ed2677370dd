"""Vectorised rolling hashes over the bytes of one text.

Polynomial hashes modulo 2**64 with an odd base: a prefix sum of
``table[byte] * base**position`` gives the hash of any substring in constant
time after a multiplication by the inverse power.  Bytes pass through a table
of random 64-bit words first, so that hashes of structured text don't cancel.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Texts are walked in blocks of this many bytes, so working arrays stay small.
BLOCK = 1 << 22


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, self.base, _U))])
            self.down = np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, self.inverse, _U))])
        return self.up, self.down


class Rolling:
    """Hashes of substrings of one block of bytes; ``family`` picks the function."""

    FAMILIES = ((0x9E3779B97F4A7C15, 11), (0xD6E8FEB86659FD93, 23))

    def __init__(self, family: int) -> None:
        base, seed = self.FAMILIES[family]
        self.powers, self.table = Powers(base), _table(seed)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        up, _ = self.powers.get(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * up[: len(data)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of every substring of k bytes."""
        m = len(prefix) - k
        _, down = self.powers.get(m)
        return mix((prefix[k:] - prefix[:m]) * down[:m])

    def strings(self, prefix: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Hash of the substrings of k bytes at some positions."""
        _, down = self.powers.get(len(prefix))
        return mix((prefix[at + k] - prefix[at]) * down[at])

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of each substring [lo, hi), its length mixed in."""
        _, down = self.powers.get(len(prefix))
        return mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(_U) * _U(0xA24BAED4963EE407))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of values[p : p + w] for each p, the leftmost on ties of the upper 40 bits."""
    n = len(values)
    m = n - w + 1
    assert n < 1 << 24
    key = (values & ~_U((1 << 24) - 1)) | np.arange(n, dtype=_U)
    pad = -n % w
    if pad:
        key = np.concatenate([key, np.full(pad, np.iinfo(_U).max, _U)])
    blocks = key.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & _U((1 << 24) - 1)).astype(np.int64)
