"""Ranked lexical search: an inverted index by shards of documents, and WAND over each shard.

A shard is a run of whole documents of some two million words.  For each of its
terms the index has a posting list (the documents, and how often each has the
term) and the list's peaks: for each frequency the fewest words of a document
that has it.  A document's share of a score grows with the frequency and falls
with the words, so whatever the corpus-wide statistics turn out to be, the
largest share of a list is that of one of its peaks.

Search keeps the best k documents of each query.  Documents are walked a window
at a time.  Lists are in the order of their largest shares; those whose shares,
taken together with all smaller ones, can't beat the worst of the k bring forth
no pivot and are only probed.  A document is a pivot if the largest shares of
the lists that hold it could beat the worst of the k; only pivots are scored.
What a task's earlier shards have found is the bar for its later ones, and the
best of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm import splitting
from loomline.llm.common import discard, lower_ascii, materialise

#: Words of a shard, if its documents allow; a document is never split.
SHARD_WORDS = 1 << 21
#: Bytes of text that are taken apart at a time, and terms that are passed on at a time.
GATHER, TERMS = 1 << 21, 1 << 15
#: Documents of a window, and bytes of query texts that are asked together.
WINDOW, BLOCK_BYTES = 2048, 1 << 20
K = 20
#: Terms of a text, as in splitting.LETTERS.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: A posting list has a term, its documents (n; ordinals), the term's count in each, and peaks (count, words, count, words, ...).
#: A shard's own row has none; n is its documents with a term, words theirs, ordinals their ids, counts their words, peaks which ids are there.
SCHEMA = "shard long, term binary, n long, words long, ordinals binary, counts binary, peaks binary"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of an array, each as its bytes."""
    at = (offsets * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _rows(shard: int, **given: pa.Array) -> pa.RecordBatch:
    n = len(given["n"])
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    given["shard"] = pa.array(np.full(n, shard))
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, k) for c, k in zip(_NAMES, kinds, strict=True)], _NAMES)


def _shard(shard: int, ids: list, chunks: list[pa.Array], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard."""
    sizes = np.concatenate(counts).astype(np.int32)
    codes, terms = splitting.numbered(pa.concat_arrays(chunks))
    one = np.array([0, len(ids)])
    valid = np.array([i is not None for i in ids])
    named = np.array([0 if i is None else i for i in ids], np.int64)
    yield _rows(shard, n=pa.array([int((sizes > 0).sum())]), words=pa.array([int(sizes.sum())]), ordinals=_packed(named, one), counts=_packed(sizes, one), peaks=_packed(valid, one))
    if not len(codes):
        return
    doc = np.repeat(np.arange(len(sizes)), sizes)
    key = np.sort(codes.astype(np.int64) * len(sizes) + doc)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([new, [len(key)]])).astype(np.int32)
    term, doc = key[new] // len(sizes), (key[new] % len(sizes)).astype(np.int32)
    offsets = np.searchsorted(term, np.arange(len(terms) + 1))
    # the fewest words of each term and count
    most = int(count.max()) + 1
    level = term * most + count
    order = np.argsort(level, kind="stable")
    level, words = level[order], sizes[doc[order]]
    first = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
    peaks = np.stack([level[first] % most, np.minimum.reduceat(words, first)], axis=1).astype(np.int32).ravel()
    peak_at = 2 * np.searchsorted(level[first] // most, np.arange(len(terms) + 1))
    for k in range(0, len(terms), TERMS):
        at = slice(k, min(k + TERMS, len(terms)) + 1)
        yield _rows(shard, term=terms[k : k + TERMS].cast(pa.binary()), n=pa.array(np.diff(offsets[at])), ordinals=_packed(doc, offsets[at]), counts=_packed(count, offsets[at]), peaks=_packed(peaks, peak_at[at]))


def index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text) as a table in the shared folder; null texts have no terms."""

    def run(batches):
        ids, chunks, counts, words = [], [], [], 0
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, size = [], 0
                while begin + len(texts) < batch.num_rows and size < GATHER:
                    texts += splitting.parts(batch.column("text").slice(begin + len(texts), 1))
                    size += len(texts[-1])
                split = splitting.split(texts, splitting.LETTERS, lower=True)
                ids += batch.column("doc_id").slice(begin, len(texts)).to_pylist()
                chunks.append(split[0])
                counts.append(split[1])
                words += len(split[0])
                begin += len(texts)
                if words >= SHARD_WORDS:
                    yield from _shard(shard, ids, chunks, counts)
                    ids, chunks, counts, words = [], [], [], 0
                    shard += 1
        if ids:
            yield from _shard(shard, ids, chunks, counts)

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA), "ranking", compression="zstd")


def share(weight: np.ndarray | int, count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What a term of some weight adds to the score of a document that has it ``count`` times; size is the document's m."""
    return weight * ((1_000_000_000 * count) // (1000 * count + 12 * size))


def sizes(words: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of some words: 100 for the mean."""
    return 75 + (25 * words * n_docs) // n_words


class Best:
    """The k best documents of a query so far, by score, then by id; null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.doc, self.valid = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def bar(self) -> int:
        """The least score that counts: that of the worst, whose id may yet be beaten, and 1 while there is room."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, valid: np.ndarray) -> None:
        score, doc, valid = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.valid, valid])
        order = np.lexsort((doc, ~valid, -score))[: self.k]
        self.score, self.doc, self.valid = score[order], doc[order], valid[order]


class Lists:
    """The posting lists of a shard, with the largest share of each and where its windows begin."""

    def __init__(self, ids: np.ndarray, valid: np.ndarray, words: np.ndarray, n_docs: int, n_words: int) -> None:
        self.ids, self.valid, self.totals = ids, valid, (n_docs, n_words)
        self.sizes = sizes(words.astype(np.int64), n_docs, max(n_words, 1))
        self.edges = np.arange(0, len(ids) + WINDOW, WINDOW)
        self.each: list[tuple] = []

    def add(self, weight: int, docs: np.ndarray, counts: np.ndarray, peaks: np.ndarray) -> None:
        peaks = peaks.reshape(-1, 2).astype(np.int64)
        most = int(share(weight, peaks[:, 0], sizes(peaks[:, 1], *self.totals)).max())
        self.each.append((weight, docs, counts, most, np.searchsorted(docs, self.edges)))

    def search(self, wanted: list[tuple[int, int]], best: Best) -> int:
        """Bring ``best`` up to date with this shard, for a query of lists and how often it has each; how many documents were scored."""
        wanted = sorted(wanted, key=lambda x: -x[1] * self.each[x[0]][3])
        lists = [(times, *self.each[i]) for i, times in wanted]
        largest = np.array([times * most for times, _, _, _, most, _ in lists], np.int64)
        left = np.append(np.cumsum(largest[::-1])[::-1], 0)  # what a list and all smaller ones can add
        scored = 0
        for w in range(len(self.edges) - 1):
            bar, begin = best.bar, int(self.edges[w])
            inside = [docs[at[w] : at[w + 1]] - begin for _, _, docs, _, _, at in lists]
            if sum(int(x) for x, d in zip(largest, inside, strict=True) if len(d)) < bar:
                continue
            leading = int((left[:-1] >= bar).sum())
            upper = np.zeros(WINDOW, np.int64)
            for x, d in zip(largest[:leading], inside, strict=False):
                upper[d] += x
            pivots = np.flatnonzero((upper > 0) & (upper + left[leading] >= bar))
            for i in range(leading, len(lists)):
                if not len(pivots):
                    break
                upper[pivots[_among(inside[i], pivots)[1]]] += largest[i]
                pivots = pivots[upper[pivots] + left[i + 1] >= bar]
            if not len(pivots):
                continue
            score, size = np.zeros(len(pivots), np.int64), self.sizes[begin + pivots]
            for (times, weight, _, counts, _, at), d in zip(lists, inside, strict=True):
                place, held = _among(d, pivots)
                score[held] += times * share(weight, counts[at[w] + place].astype(np.int64), size[held])
            scored += len(pivots)
            good = score >= bar
            best.add(score[good], self.ids[begin + pivots[good]], self.valid[begin + pivots[good]])
        return scored


def _among(docs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in docs, places in wanted) of the documents that both have; both ascend."""
    at = np.searchsorted(docs, wanted)
    held = np.flatnonzero(at < len(docs))
    held = held[docs[at[held]] == wanted[held]]
    return at[held], held


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with a number q and a block, their terms by block: which queries use each, and how often)."""
    rows = queries.select("item_id", F.col("text").alias("query")).where("query is not null").distinct()
    numbered = materialise(rows.select("item_id", "query", F.monotonically_increasing_id().alias("q")), "queries")
    total = numbered.agg(F.sum(F.octet_length("query"))).first()[0] or 0
    block = F.pmod(F.xxhash64("q"), F.lit(-(-total // BLOCK_BYTES) or 1)).cast("int").alias("block")
    terms = numbered.select("q", block, F.explode(F.regexp_extract_all("query", F.lit(_TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("block", F.encode(lower_ascii(F.col("term")), "UTF-8").alias("term"), "q").agg(F.count("*").alias("times"))
    return numbered, materialise(counted.groupBy("block", "term").agg(F.collect_list(F.struct("q", "times")).alias("uses")), "terms")


_FOUND = "q long, doc_id long, score long"


def _searched(lists: DataFrame, n_docs: int, n_words: int, k: int) -> DataFrame:
    """(q, doc_id, score): the k best of each task; lists has a shard's own row, then its posting lists, block by block."""

    def answered(best: dict[int, Best]) -> pa.RecordBatch:
        each = [(np.full(len(b.score), q), b) for q, b in best.items()]
        doc = pa.array(np.concatenate([b.doc for _, b in each]), mask=~np.concatenate([b.valid for _, b in each]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([q for q, _ in each])), doc, pa.array(np.concatenate([b.score for _, b in each]))], ["q", "doc_id", "score"])

    def run(batches):
        best: dict[int, Best] = {}
        held, queries, here = None, {}, None

        def searched():
            for q, wanted in queries.items():
                held.search(wanted, best.setdefault(q, Best(k)))

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns = [part.column(c) for c in ("block", "shard", "weight", "uses", "ordinals", "counts", "peaks")]
                for block, shard, weight, uses, ordinals, counts, peaks in zip(*(c.to_pylist() for c in columns[:4]), *columns[4:], strict=True):
                    words = [np.frombuffer(x.as_buffer(), kind) for x, kind in ((counts, np.int32), (ordinals, np.int32 if weight is not None else np.int64), (peaks, np.int32 if weight is not None else bool))]
                    if here != (block, shard):
                        if held is not None:
                            searched()
                        if here is not None and here[0] != block and best:
                            yield answered(best)
                            best.clear()
                        here, queries = (block, shard), {}
                        held = Lists(words[1], words[2], words[0], n_docs, n_words)
                        continue
                    for use in uses:
                        queries.setdefault(use["q"], []).append((len(held.each), use["times"]))
                    held.add(weight, words[1], words[0], words[2])
        if held is not None:
            searched()
        if best:
            yield answered(best)

    return lists.repartition("block", "shard").sortWithinPartitions("block", "shard", F.col("weight").isNotNull()).mapInArrow(run, _FOUND)


def search(table: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k documents of an index with the highest score above 0 for each query (item_id, text).

    A score is the sum over the query's terms, repeats included, of the term's
    weight times what its count in the document comes to; see share().  Equal
    scores stand by doc_id, null ids last.

    Returns item_id, rank, doc_id and score.  A null text asks for nothing, and
    so does one without a term; of rows equal in id and text one is answered.  A
    null item_id is an id.  Repeated documents are ranked each.
    """
    numbered, terms = _asked(queries)
    found = table.where("term is not null").join(terms.select("block", "term"), "term").select("block", "shard", "term", "n", "ordinals", "counts", "peaks")
    found = materialise(found, "lists", compression="zstd")
    totals = table.where("term is null").agg(F.sum("n"), F.sum("words")).first()
    n_docs, n_words = totals[0] or 0, totals[1] or 0
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.sum("n") + 1))).cast("long").alias("weight")
    weights = found.groupBy("block", "term").agg(weight).join(terms, ["block", "term"])
    lists = found.join(weights, ["block", "term"]).select("block", "shard", "weight", "uses", "ordinals", "counts", "peaks")
    last = terms.agg(F.max("block")).first()[0] or 0
    own = table.where("term is null").select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), "shard", "ordinals", "counts", "peaks")
    rows = lists.unionByName(own, allowMissingColumns=True)
    tops = materialise(_searched(rows, n_docs, n_words, k), "tops")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = tops.withColumn("rank", rank).where(F.col("rank") <= k)
    out = materialise(best.join(numbered, "q").select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(numbered, terms, found, tops)
    return out


def rank(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """search() over all docs, whose index is built and deleted; see there.

    Null and empty texts are in no list; long texts are whole, in one shard;
    other columns, whatever their names, are ignored; empty tables give an empty
    result.
    """
    table = index(docs)
    out = search(table, queries, k)
    discard(table)
    return out
