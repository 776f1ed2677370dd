"""Benchmark decontamination by a distributed positional inverted index.

The index (see postings.py) is a table of the posting lists of every training
token, keyed by term.  A benchmark's terms are joined to it, and the lists of a
segment meet in one place.  A phrase is looked up from its rarest term by
occurrences in the corpus: each place of it is a candidate start, and the lists
of the other terms, shifted by their offsets, are intersected with the
candidates in the order of their frequency.  Proximity queries ask the same
lists for all words within a span; see proximity().  The index is built once,
however large the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import postings
from loomline.llm.common import discard, materialise, row_key, slices
from loomline.llm.postings import words

WINDOW = 10
#: Benchmark text that is asked for at a time; a larger benchmark is taken in blocks, against the same index.
BLOCK_BYTES = 1 << 20
#: Candidate starts that a task looks at together, about.
CANDIDATES = 1 << 21

_HITS = "segment long, ordinal int, spans array<struct<lo:int,hi:int>>, items array<string>"


def windows(tokens: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text, unless empty, is one."""
    return [tuple(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))] if tokens else []


def _indexed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    r1, r2 = row_key(F.col("doc_id"), text)
    return postings.build(docs.select(F.col("doc_id").cast("long").alias("doc_id"), r1.alias("r1"), r2.alias("r2"), "text"))


def _asked(questions: DataFrame) -> DataFrame:
    """(item_id, text) of a benchmark or of queries; null ids are the empty string, null texts go."""
    return questions.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")


def _blocks(questions: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Questions in parts of about BLOCK_BYTES, by way of the driver, one at a time."""
    size = questions.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES) or 1
    for i in range(n):
        part = questions.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else questions
        yield [(r["item_id"], r["text"]) for r in part.toLocalIterator()]


def _terms(index: DataFrame, vocabulary: list[bytes]) -> tuple[DataFrame, np.ndarray]:
    """Terms with their numbers, and the occurrences of each in the corpus."""
    table = index.sparkSession.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.binary()), "t": pa.array(range(len(vocabulary)), pa.int32())}))
    counts = np.zeros(len(vocabulary), np.int64)
    for r in postings.lookup(index, table).where("t >= 0").groupBy("t").agg(F.sum("n").alias("n")).collect():
        counts[r["t"]] = r["n"]
    return table, counts


def _phrases(items: list[tuple[str, str]], size: int, numbers: dict[bytes, int], counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, list[list[str]]]]:
    """For each length of phrase: the terms of its phrases, their offsets, the rarest first, and the items of each."""
    owners: dict[tuple, set[str]] = {}
    for item, text in items:
        for w in windows(words(text), size):
            owners.setdefault(w, set()).add(item)
    out = []
    for length in sorted({len(w) for w in owners}):
        phrases = [w for w in owners if len(w) == length]
        terms = np.array([[numbers[x] for x in w] for w in phrases], np.int32)
        known = (counts[terms] > 0).all(1)  # a word that no document has rules a phrase out
        terms, phrases = terms[known], [w for w, k in zip(phrases, known.tolist(), strict=True) if k]
        if phrases:
            out.append((terms, np.argsort(counts[terms], axis=1, kind="stable"), [sorted(owners[w]) for w in phrases]))
    return out


def phrase_starts(terms: np.ndarray, order: np.ndarray, t: np.ndarray, begin: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every occurrence in a segment, of phrases of one length.

    Candidates are the places of each phrase's first term in ``order``, shifted
    by its offset.  The segment's lists are laid out by place, so that one look
    per candidate tells whether the next list, shifted, holds it.
    """
    n_terms = int(max(terms.max(), t.max() if len(t) else 0)) + 1
    at_list = np.full(n_terms, -1)
    at_list[t] = np.arange(len(t))
    phrase = np.flatnonzero((at_list[terms] >= 0).all(1))
    none = np.zeros(0, np.int64)
    if not len(phrase):
        return none, none
    top = int(places.max())
    term_at = np.full(top + 2, -1, np.int32)
    for_each = np.repeat(np.arange(len(t)), size)
    flat = np.arange(len(for_each)) - np.repeat(np.cumsum(size) - size, size) + begin[for_each]
    term_at[places[flat]] = t[for_each]
    lead = at_list[terms[phrase, order[phrase, 0]]]
    n = size[lead]
    found = []
    # frequent first terms give many candidates: so many phrases at a time that these stay few
    turn = np.cumsum(n) // CANDIDATES
    for chosen in np.split(np.arange(len(phrase)), np.flatnonzero(turn[1:] != turn[:-1]) + 1):
        m = n[chosen]
        which = np.repeat(phrase[chosen], m)
        start = places[np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[lead[chosen]], m)].astype(np.int64) - order[which, 0]
        which, start = which[start >= 0], start[start >= 0]
        for k in range(1, terms.shape[1]):
            offset = order[which, k]
            held = term_at[np.minimum(start + offset, top + 1)] == terms[which, offset]
            which, start = which[held], start[held]
            if not len(which):
                break
        found.append((which, start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matched(index: DataFrame, terms: DataFrame, phrases: list) -> DataFrame:
    """Hit spans and items of each document with any."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def answer(segment, firsts, t, begin, size, places):
        hits: dict[int, tuple[list, set]] = {}
        for wanted, order, items in shared.value:
            which, start = phrase_starts(wanted, order, t, begin, size, places)
            doc = np.searchsorted(firsts, start, side="right") - 1
            lo = start - firsts[doc]
            for d, p, a in zip(doc.tolist(), which.tolist(), lo.tolist(), strict=True):
                spans, found = hits.setdefault(d, ([], set()))
                spans.append({"lo": a, "hi": a + wanted.shape[1]})
                found.update(items[p])
        if not hits:
            return None
        docs = sorted(hits)
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([segment] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array([hits[d][0] for d in docs], kind), pa.array([sorted(hits[d][1]) for d in docs], pa.list_(pa.string()))], ["segment", "ordinal", "spans", "items"])

    return postings.segments(postings.lookup(index, terms), answer, _HITS)


def _merged(hits: DataFrame) -> DataFrame:
    """(segment, ordinal, n_hit, items, items_sha256); spans are united in word positions."""

    def run(batches):
        for batch in slices(batches):
            hit = []
            for spans in batch.column("spans").to_pylist():
                at = n = 0
                for s in sorted((x["lo"], x["hi"]) for x in spans):
                    n += max(0, s[1] - max(at, s[0]))
                    at = max(at, s[1])
                hit.append(n)
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("ordinal"), pa.array(hit, pa.int64()), batch.column("items"), pa.array(digest)], ["segment", "ordinal", "n_hit", "items", "items_sha256"])

    return hits.mapInArrow(run, "segment long, ordinal int, n_hit long, items array<string>, items_sha256 string")


def hits(index: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(segment, ordinal, n_hit, items, items_sha256) of the documents of an index that hold a window of the benchmark."""
    parts = []
    for items in _blocks(_asked(benchmark)):
        vocabulary = sorted({w for _, text in items for w in words(text)})
        terms, counts = _terms(index, vocabulary)
        phrases = _phrases(items, size, {w: k for k, w in enumerate(vocabulary)}, counts)
        if phrases:
            parts.append(materialise(_matched(index, terms, phrases), "hits"))
    if not parts:
        return index.sparkSession.createDataFrame([], "segment long, ordinal int, n_hit long, items array<string>, items_sha256 string")
    both = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            both = both.unionByName(p)
        both = both.groupBy("segment", "ordinal").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = materialise(_merged(both), "merged_hits")
    discard(*parts)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Items with equal ids count once; a null item_id is the empty string.  Null
    texts on either side have no words, and items without words no windows.
    Repeated rows of docs are answered each.  Long texts are whole, in one
    segment of the index.  Empty tables give an empty result, or one without
    hits.  Extra columns are ignored.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the
    item ids as ``items``.
    """
    index = _indexed(docs)
    found = hits(index, benchmark, size)
    rows = materialise(postings.documents(index).select("segment", "ordinal", "doc_id", "n_words"), "indexed")
    discard(index)
    none = F.array().cast("array<string>")
    out = rows.join(found, ["segment", "ordinal"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(hashlib.sha256().hexdigest())).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def near(lists: list[np.ndarray], firsts: np.ndarray, span: int) -> np.ndarray:
    """Places of the first list with one of every other list fewer than ``span`` words away, in the same document."""
    at = lists[0]
    for other in lists[1:]:
        doc = np.searchsorted(firsts, at, side="right") - 1
        # a document's numbers end one before the next one's first
        upto = np.concatenate([firsts[1:], [np.iinfo(np.int32).max]])[doc]
        i = np.searchsorted(other, np.maximum(at - span + 1, firsts[doc]))
        close = other[np.minimum(i, len(other) - 1)]
        at = at[(i < len(other)) & (close < at + span) & (close < upto)]
        if not len(at):
            break
    return at


def proximity(docs: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """Where documents have all words of a query close together, in any order.

    queries has item_id and text; the words of a text are its terms.  A position
    is that of the query's rarest term, by occurrences in docs, then in byte
    order, with each other term fewer than span words before or after it.
    Queries without words have no answers; of equal queries one is answered; a
    null item_id is the empty string.  Repeated rows of docs are answered each.

    Returns doc_id, item_id and positions, ascending, a row for each document
    and query with any.
    """
    index, out = _indexed(docs), None
    for block in _blocks(_asked(queries).distinct()):
        vocabulary = sorted({w for _, text in block for w in words(text)})
        numbers = {w: k for k, w in enumerate(vocabulary)}
        terms, counts = _terms(index, vocabulary)
        asked = [(item, sorted({numbers[w] for w in words(text)}, key=lambda k: (counts[k], k))) for item, text in block]
        shared = docs.sparkSession.sparkContext.broadcast([(i, t) for i, t in asked if t and counts[t].all()])

        def answer(segment, firsts, t, begin, size, places, shared=shared):
            lists = {k: places[b : b + n].astype(np.int64) for k, b, n in zip(t.tolist(), begin.tolist(), size.tolist(), strict=True)}
            rows = []
            for item, wanted in shared.value:
                if all(k in lists for k in wanted):
                    at = near([lists[k] for k in wanted], firsts, span)
                    doc = np.searchsorted(firsts, at, side="right") - 1
                    cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
                    rows += [(segment, int(firsts_of[0]), item, p.tolist()) for firsts_of, p in zip(np.split(doc, cuts), np.split(at - firsts[doc], cuts), strict=True) if len(p)]
            if not rows:
                return None
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["segment", "ordinal", "item_id", "positions"])

        found = postings.segments(postings.lookup(index, terms), answer, "segment long, ordinal int, item_id string, positions array<int>")
        out = found if out is None else out.unionByName(found)
    return out.join(postings.documents(index).select("segment", "ordinal", "doc_id"), ["segment", "ordinal"]).select("doc_id", "item_id", "positions")


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of docs without a benchmark window, all their columns, whatever their names.

    Rows equal in doc_id and text share their fate and stay each; null and empty
    texts stay.  An empty table stays empty.
    """
    index = _indexed(docs)
    found = hits(index, benchmark, size)
    gone = postings.documents(index).join(found, ["segment", "ordinal"], "left_semi").select(F.col("r1").alias("_g1"), F.col("r2").alias("_g2")).distinct()
    gone = materialise(gone, "contaminated")
    discard(index)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *row_key(F.col("doc_id"), text))
    return rows.join(gone, (F.col("_r1") == F.col("_g1")) & (F.col("_r2") == F.col("_g2")), "left_anti").select("_row.*")
