"""Words of many texts at once, as Arrow strings: bytes are told apart by a table, and no word is a Python object."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: Bytes of a word where words lie between ASCII white space.
BETWEEN_SPACES = (_BYTES != 0x20) & ~((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: Bytes of a word of digits, ASCII letters and whatever isn't ASCII.
LETTERS = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: Each byte with A-Z lower-cased.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def split(texts: Sequence[bytes], inside: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, lo, hi): the words of all texts, how many each text has, and where each lies in the texts joined by a space.

    inside tells the bytes of a word; a space is never one.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    held = inside[data]
    edges = np.flatnonzero(held[1:] != held[:-1]) + 1
    edges = np.concatenate([[0], edges]) if held[0] else edges
    lo, hi = edges[::2], edges[1::2]
    packed = data[held]
    packed = LOWER[packed] if lower else packed
    offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words, np.diff(np.searchsorted(lo, ends), prepend=0), lo, hi


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words): equal words, byte by byte, have equal codes."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def values(words: pa.Array) -> list[bytes]:
    """The words of an array without nulls."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    held = data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in itertools.pairwise(at)]


def parts(column: pa.Array) -> list[bytes]:
    """The bytes of a string column's values; null is empty."""
    return [b"" if (b := x.as_buffer()) is None else b.to_pybytes() for x in column]


def spaced(text: bytes) -> bytes:
    """The words between ASCII white space, joined by one space."""
    out = text.translate(_SPACES).strip(b" ")
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


_SPACES = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
