"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; where its upper bits are zero a chunk ends.
Boundaries depend on the 32 bytes before them only, so an insertion changes the
chunks around it and no others.  Chunks are deduplicated by digests of 128 bits:
the first occurrence, by doc_id, stays, and every later one goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut_spans, discard, materialise, row_key
from loomline.llm.rolling import BLOCK, Rolling

WINDOW = 32
BITS = 5
SHORTEST, LONGEST = 32, 512

_GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: the sum over the last 32 bytes of gear[byte] << age, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text, at starts of UTF-8 characters; the last is its length."""
    n = len(data)
    cuts = []
    for begin in range(0, n, BLOCK):
        head = min(begin, WINDOW)
        part = gear(data[begin - head : begin + BLOCK])[head:]
        cuts.append(np.flatnonzero(part >> np.uint32(32 - BITS) == 0) + 1 + begin)
    cuts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    for _ in range(3):
        inside = cuts[cuts < n]
        cuts = np.concatenate([inside + ((data[inside] & 0xC0) == 0x80), cuts[cuts >= n]])
    out, at = [], 0
    for c in cuts.tolist():
        if c - at < SHORTEST:
            continue
        while c - at > LONGEST:
            at = _aligned(data, at + LONGEST, n)
            out.append(at)
        if c - at >= SHORTEST:
            out.append(c)
            at = c
    while n - at > LONGEST:
        at = _aligned(data, at + LONGEST, n)
        out.append(at)
    if n > at:
        out.append(n)
    return np.array(out, np.int64)


def _aligned(data: np.ndarray, at: int, n: int) -> int:
    while at < n and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_table(docs: DataFrame) -> DataFrame:
    """(d, e, doc_id, _r1, _r2, lo, hi): every chunk with two hashes of its bytes."""
    families = Rolling(0), Rolling(1)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), text), F.encode(text, "UTF-8").alias("text"))

    def run(batches):
        for batch in batches:
            d, sizes, los, his = ([], []), np.zeros(batch.num_rows, np.int64), [], []
            for i, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                hi = boundaries(data)
                if len(hi):
                    lo = np.concatenate([[0], hi[:-1]])
                    sizes[i] = len(hi)
                    for out, rolling in zip(d, families, strict=True):
                        out.append(rolling.spans(rolling.prefix(data), lo, hi).view(np.int64))
                    los.append(lo)
                    his.append(hi)
            if los:
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
                keys = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("_r1", "_r2")]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in d), ids, *keys, pa.array(np.concatenate(los)), pa.array(np.concatenate(his))], ["d", "e", "doc_id", "_r1", "_r2", "lo", "hi"])

    return keyed.mapInArrow(run, "d long, e long, doc_id long, _r1 long, _r2 long, lo long, hi long")


def chunk_dedup(docs: DataFrame, min_run: int = 0, with_text: bool = False) -> DataFrame:
    """Remove chunks that occurred before; min_run keeps runs of them that have fewer bytes.

    The occurrence that stays is the one of the smallest doc_id (null first),
    then of the row's hash, then of the position.  Rows equal in doc_id and text
    count as one row: each keeps what the first would.  Null and empty texts
    have no chunks.  Extra columns are ignored; an empty table gives an empty
    result.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds
    the remaining bytes as ``kept``.
    """
    chunks = materialise(chunk_table(docs), "chunks")
    first = materialise(
        chunks.groupBy("d", "e").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "_r1", "_r2", "lo")).alias("f")).where("k > 1").select("d", "e", F.col("f._r1").alias("f1"), F.col("f._r2").alias("f2"), F.col("f.lo").alias("flo")),
        "first_chunks",
    )
    later = chunks.join(first, ["d", "e"]).where("not (_r1 = f1 and _r2 = f2 and lo = flo)").select("_r1", "_r2", "lo", "hi")
    spans = materialise(later.groupBy("_r1", "_r2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "chunk_spans")
    discard(chunks, first)
    return cut_spans(docs, spans, min_run, with_text)
