"""Packing by powers of two: each document falls into pieces of binary lengths, and each piece is a sequence of its own.

A document of n tokens is cut into as many pieces of the full length as it has,
then into one piece for each bit of the rest, the longest first.  Pieces of one
length form a bucket, from which batches of equal shape are drawn, so nothing is
padded and no sequence holds tokens of two documents.

Words are looked up in a table that each worker fills as it meets them: the
tokenizer splits between them in any case, so a text's tokens are those of its
words.  Nothing is shuffled.
"""

from __future__ import annotations

import functools
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import splitting

FULL = 2048
#: The token that ends a document.
END = 1
#: Bytes of text that are taken together, and of words and tokens that a task's table may hold; a full table is begun anew.
GATHER, TABLE_BYTES = 1 << 22, 160 << 20
#: Sequences of a bucket that one task can number.
_PER_TASK = 1 << 32
_END = END.to_bytes(4, "little")
#: A sign of its own that stands between words that are encoded together, and how many are.
_BETWEEN, _BETWEEN_BYTE, _APART, _TOGETHER = "~", b"~", b" ~ ", 100
#: A byte that no text has, between texts.
_NEXT = b"\xff"
_LETTER, _SIGN, _OTHER = range(3)
#: Printable ASCII other than letters and the apostrophe, which may begin a shortened word, is a sign.
_KINDS = bytes(_LETTER if chr(b) in string.ascii_letters else _SIGN if 0x20 < b < 0x7F and b != 0x27 else _OTHER for b in range(256))
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Vocabulary:
    """The tokens of words, each looked up once.

    For tokenizers that split at white space, and between ASCII letters and
    ASCII signs or digits, apostrophes apart, and that lower-case.
    """

    def __init__(self, tokenizer: str, table_bytes: int = TABLE_BYTES) -> None:
        self.tokenizer, self.table_bytes = Tokenizer.from_str(tokenizer), table_bytes
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}
        self.bytes = 0

    def apart(self, texts: list[bytes]) -> list[bytes]:
        """Texts, lower-cased as far as that is safe, with white space wherever the tokenizer splits between a letter and a sign."""
        joined = _NEXT.join(texts)
        lower = joined.translate(_LOWER)
        if any(s in lower for s in self.specials):
            return texts
        data, small = np.frombuffer(joined, np.uint8), np.frombuffer(lower, np.uint8).copy()
        capital = np.flatnonzero((data[:-1] != small[:-1]) & (data[1:] >= 0x80))
        small[capital] = data[capital]  # a letter before another script's byte may be about to join an accent
        kind = np.frombuffer(lower.translate(_KINDS), np.uint8)
        accented = (small[:-1] == 0xC3) & (small[1:] >= 0x80) & (small[1:] != 0x97) & (small[1:] != 0xB7)  # the letters of Latin-1
        ends, begins = kind.copy(), kind.copy()
        ends[1:][accented] = _LETTER
        begins[:-1][accented] = _LETTER
        cut = np.flatnonzero((ends[:-1] == _LETTER) & (kind[1:] == _SIGN) | (kind[:-1] == _SIGN) & (begins[1:] == _LETTER)) + 1
        return np.insert(small, cut, 0x20).tobytes().split(_NEXT)

    def learn(self, new: list[bytes]) -> None:
        """Look words up: many at a time with a sign between that none of them has, the others by themselves."""
        plain, odd, mark = [], [], self.between[0]
        for w in new:
            (odd if _BETWEEN_BYTE in w else plain).append(w)
        joined = [_APART.join(plain[k : k + _TOGETHER]).decode() for k in range(0, len(plain), _TOGETHER)]
        packed: list[bytes] = []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for end in (4 * np.flatnonzero(ids == mark)).tolist():
                packed.append(data[at:end])
                at = end + 4
            packed.append(data[at:])
        if len(packed) != len(plain):
            raise ValueError("the tokenizer doesn't split at white space")
        packed += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)]
        self.known |= zip(plain + odd, packed, strict=True)
        self.bytes += sum(map(len, packed)) + sum(map(len, new)) + 150 * len(new)

    def tokens(self, texts: list[bytes]) -> list[bytes]:
        """The tokens of each text, ended by END, as little-endian words of 32 bits."""
        if self.bytes > self.table_bytes:
            self.known, self.bytes = {}, 0
        words, counts, _, _ = splitting.split(self.apart(texts), splitting.BETWEEN_SPACES)
        codes, distinct = splitting.numbered(words)
        distinct = splitting.values(distinct)
        found = list(map(self.known.get, distinct))
        if None in found:
            self.learn([w for w, f in zip(distinct, found, strict=True) if f is None])
            found = list(map(self.known.get, distinct))
        each = list(map(found.__getitem__, codes.tolist()))
        ends = np.cumsum(counts)
        return [b"".join(each[a:b]) + _END for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


@functools.lru_cache(1)
def vocabulary(tokenizer: str) -> Vocabulary:
    """The worker's table, which its tasks share."""
    return Vocabulary(tokenizer)


def cuts(n: np.ndarray, full: int = FULL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, start, length) of the pieces of documents of n tokens: full ones, then a power of two for each bit of the rest."""
    bits = full.bit_length() - 1
    whole = n // full
    sizes = 1 << np.arange(bits - 1, -1, -1)
    has = (n % full)[:, None] & sizes > 0
    pieces = whole + has.sum(axis=1)
    which = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.full(len(which), full, np.int64)
    length[nth >= whole[which]] = np.broadcast_to(sizes, has.shape)[has]
    ends = np.cumsum(length)
    start = ends - length - np.repeat(np.cumsum(n) - n, pieces)
    return which, start, length


def pack(docs: DataFrame, tokenizer: str, keep: tuple[str, ...] = ("doc_id",), full: int = FULL) -> DataFrame:
    """Pieces of documents as sequences of at most ``full`` tokens, a power of two.

    tokenizer is the text of a tokenizer's JSON file.  Returns the columns
    ``keep`` and start (the document's tokens before the piece), length, ids
    (bytes: little-endian words of 32 bits), doc_tokens, sequence_id and offset,
    which is 0, as a sequence is one piece; it is never padded.

    sequence_id is the bucket (the length's logarithm), then the task, then a
    running number, so the sequences of one length are one range of ids; see
    buckets().  A task that is run again gives the same.

    Each document's tokens end with token 1; null and empty texts have that one
    alone.  Repeated rows are packed each; long texts are whole; an empty table
    gives an empty result; other columns, whatever their names, are ignored.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("full must be a power of two")
    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        table = vocabulary(tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(full.bit_length(), np.int64)

        def packed(part: pa.RecordBatch, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            tokens = table.tokens(texts)
            n = np.array([len(t) // 4 for t in tokens])
            which, start, length = cuts(n, full)
            bucket = np.frexp(length)[1] - 1
            order = np.argsort(bucket, kind="stable")
            nth = np.empty(len(order), np.int64)
            held = np.bincount(bucket, minlength=len(seen))
            nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held) + np.repeat(seen, held)
            seen[:] += held
            sequence = (bucket.astype(np.int64) << 58) | (task * _PER_TASK + nth)
            offsets = 4 * np.concatenate([[0], np.cumsum(length)])
            ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"".join(tokens))])
            rows = [part.column(c).take(pa.array(which)) for c in keep]
            rows += [pa.array(start), pa.array(length), ids, pa.array(n[which]), pa.array(sequence), pa.array(np.zeros(len(length), np.int64))]
            yield pa.RecordBatch.from_arrays(rows, [*keep, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, size = [], 0
                while begin + len(texts) < batch.num_rows and size < GATHER:
                    texts += splitting.parts(batch.column("text").slice(begin + len(texts), 1))
                    size += len(texts[-1])
                yield from packed(batch.slice(begin, len(texts)), texts)
                begin += len(texts)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences as Parquet, a folder for each length: a batch of one shape is read from one folder, without padding."""
    pieces.write.partitionBy("length").parquet(path)


def batches(pieces: DataFrame, tokens: int) -> DataFrame:
    """(length, batch, sequences, ids): sequences of one length and one range of ids, so many that a batch has at most ``tokens`` tokens.

    Batches are told by sequence_id alone; the last of each task and length may hold fewer sequences.
    """
    per = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length")).cast("long"))
    keyed = pieces.withColumn("batch", F.col("sequence_id") - F.pmod(F.col("sequence_id").bitwiseAND(_PER_TASK - 1), per))
    each = keyed.groupBy("length", "batch").agg(F.array_sort(F.collect_list(F.struct("sequence_id", "ids"))).alias("s"))
    return each.select("length", "batch", F.size("s").alias("sequences"), F.transform("s", lambda x: x["ids"]).alias("ids"))
