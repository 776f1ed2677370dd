"""A positional inverted index of whole texts as a table: a row a term and segment, with the places of the term.

A segment is a run of whole documents of some two million words.  Its words are
numbered through, with one number left out between documents, so consecutive
numbers are consecutive words of one document.  The places of a term in a
segment are its posting list, ascending; the documents' rows say which numbers
are theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import splitting
from loomline.llm.common import materialise

#: Words of a segment, if its documents allow; a document is never split.
SEGMENT_WORDS = 1 << 21
#: Bytes of text that are taken apart at a time, and rows that are passed on at a time.
BLOCK_BYTES, BATCH_ROWS = 1 << 20, 1 << 16

#: Bytes that are no word: ASCII other than digits and letters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A posting list has a term; a document's row has an ordinal; the one row with neither has the first numbers of all documents.
SCHEMA = "segment long, term binary, ordinal int, n long, places array<int>, doc_id long, r1 long, r2 long"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of a text; a null text has none."""
    return _WORD.findall(text.encode().lower()) if text else []


class _Segment:
    """Documents gathered in a task, taken apart block by block."""

    def __init__(self, block_bytes: int, batch_rows: int) -> None:
        self.block_bytes, self.batch_rows = block_bytes, batch_rows
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple] = []
        self.counts: list[np.ndarray] = []
        self.waiting: list[bytes] = []
        self.held = self.words = 0
        self.terms: list[pa.Array] = []

    def add(self, keys: tuple, text: bytes) -> None:
        self.docs.append(keys)
        self.waiting.append(text)
        self.held += len(text) + 1
        if self.held >= self.block_bytes:
            self.take()

    def take(self) -> None:
        """The words of the documents that wait."""
        if not self.waiting:
            return
        terms, counts, _, _ = splitting.split(self.waiting, splitting.LETTERS, lower=True)
        self.waiting, self.held = [], 0
        self.counts.append(counts)
        self.terms.append(terms)
        self.words += len(terms)

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        self.take()
        counts = np.concatenate(self.counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]) + np.arange(len(counts))
        ids = list(zip(*self.docs, strict=True))
        yield _rows(segment, len(counts), ordinal=pa.array(np.arange(len(counts)), pa.int32()), n=pa.array(counts), doc_id=pa.array(ids[0], pa.int64()), r1=pa.array(ids[1], pa.int64()), r2=pa.array(ids[2], pa.int64()))
        yield _rows(segment, 1, n=pa.array([self.words]), places=_lists(np.array([0, len(first)]), first.astype(np.int32)))
        if not self.words:
            return
        codes, terms = splitting.numbered(pa.concat_arrays(self.terms))  # terms are told apart by their bytes
        place = (np.arange(self.words) + np.repeat(np.arange(len(counts)), counts)).astype(np.int32)[np.argsort(codes, kind="stable")]
        size = np.bincount(codes, minlength=len(terms))
        ends = np.cumsum(size)
        for k in range(0, len(terms), self.batch_rows):
            part = slice(k, k + self.batch_rows)
            a, b = (ends - size)[part], ends[part]
            yield _rows(segment, len(a), term=terms[part].cast(pa.binary()), n=pa.array(size[part]), places=_lists(np.concatenate([a, b[-1:]]) - a[0], place[a[0] : b[-1]]))


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _rows(segment: int, n_rows: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
    given["segment"] = pa.array(np.full(n_rows, segment))
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n_rows, k) for c, k in zip(_NAMES, kinds, strict=True)], _NAMES)


def build(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, r1, r2, text): every word of every text; null texts have none.  Needs some 30 bytes a word of a segment."""

    def run(batches):
        held = _Segment(BLOCK_BYTES, BATCH_ROWS)
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for *keys, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "r1", "r2")), batch.column("text"), strict=True):
                data = text.as_buffer()
                held.add(tuple(keys), data.to_pybytes() if data is not None else b"")
                if held.words >= SEGMENT_WORDS:
                    yield from held.rows(segment)
                    held.clear()
                    segment += 1
        if held.docs:
            yield from held.rows(segment)

    return materialise(docs.select("doc_id", "r1", "r2", "text").mapInArrow(run, SCHEMA), "postings", compression="zstd")


def documents(index: DataFrame) -> DataFrame:
    """(segment, ordinal, doc_id, r1, r2, n_words): a row a document."""
    return index.where("ordinal is not null").select("segment", "ordinal", "doc_id", "r1", "r2", F.col("n").alias("n_words"))


def lookup(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(segment, t, n, places): the posting lists of terms (term, t), and with t = -1 the first numbers of the documents of each segment."""
    lists = index.where("term is not null").select("segment", "term", "n", "places").join(F.broadcast(terms), "term").select("segment", "t", "n", "places")
    return lists.unionByName(index.where("term is null and ordinal is null").select("segment", F.lit(-1).alias("t"), "n", "places"))


def segments(found: DataFrame, answer, schema: str) -> DataFrame:
    """answer(segment, firsts, t, begin, size, places) of each segment of lookup(), a record batch or None; list i is places[begin[i] : begin[i] + size[i]] of term t[i]."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def answered():
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            t, lists = table.column("t").to_numpy(), table.column("places").combine_chunks()
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            frame = int(np.flatnonzero(t < 0)[0])
            keep = t >= 0
            firsts = values[offsets[frame] : offsets[frame + 1]]
            return answer(table.column("segment")[0].as_py(), firsts, t[keep], offsets[:-1][keep], np.diff(offsets)[keep], values)

        for batch in batches:
            segment = batch.column("segment").to_numpy()
            cuts = np.flatnonzero(segment[1:] != segment[:-1]) + 1
            begin = 0
            for cut in [*cuts.tolist(), batch.num_rows]:
                if held and held[0].column("segment")[0].as_py() != segment[begin]:
                    out = answered()
                    if out is not None:
                        yield out
                held.append(batch.slice(begin, cut - begin))
                begin = cut
        if held:
            out = answered()
            if out is not None:
                yield out

    return found.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, schema)
