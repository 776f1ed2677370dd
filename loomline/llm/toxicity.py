"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has a character model of order 5 over the words
of its labelled documents, with absolute discounting.  Both back off to the same
Kneser-Ney continuation counts of all labelled text, so an expression that
neither class has seen costs both alike, and the inflections of a rare toxic
expression share what its parts have gathered.

A word's evidence is the difference of its two log-likelihoods.  A document is
compared after normalising by length: the mean over all its words, and the means
over its strongest one and three words, which stay comparable however much
ordinary text surrounds them.  A logistic fit on labelled rows that the counts
have not seen turns these into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise, row_key, slices

ORDER = 5
DISCOUNT = 0.75
#: Pseudo-count of the shared distribution in each context of a class.
PRIOR = 5.0
#: Rows the logistic fit uses at most, the smallest by hash.  Counts use all rows.
CALIBRATION_ROWS = 20_000
#: Bits of a symbol of the model, and the first code point that takes two symbols.
BITS, WIDE = 12, 1980
#: Models up to this many n-grams are broadcast; larger ones stay in tables, and words are joined to them.
BROADCAST_GRAMS = 4_000_000
#: Labels up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
MEMO_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_memo: dict = {}


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of n-grams (packed symbols), of contexts for n-grams not seen, and the logistic fit."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray
    weights: np.ndarray
    tag: int = 0


@dataclass(frozen=True)
class Tables:
    """A model of any size: (gram, ratio), (context, unseen) and the logistic fit."""

    grams: DataFrame
    contexts: DataFrame
    weights: np.ndarray


def symbols(word: str) -> list[int]:
    """Symbols of a word, unlike for unlike words: one for code points below WIDE, a leading and a trailing one for those above."""
    codes = list(map(ord, word))
    if max(codes, default=0) < WIDE:
        return [c + 2 for c in codes]
    out = []
    for c in codes:
        out += [c + 2] if c < WIDE else [WIDE + 2 + (c >> 10), WIDE + 2 + (0x110000 >> 10) + (c & 1023)]
    return out


def pack(word: str) -> list[int]:
    """Packed n-grams of a word between its boundary symbols 0 and 1."""
    mask, g, out = (1 << BITS * ORDER) - 1, 0, []
    for x in symbols(word):
        g = (g << BITS | x) & mask
        out.append(g)
    out.append((g << BITS | 1) & mask)
    return out


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """pack() of many words, end to end, and how many n-grams each has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), "<u4").astype(np.int64)
    ends = codes == 0  # words are letters
    x = np.where(ends, 1, codes + 2)
    wide = codes >= WIDE
    if wide.any():
        at = np.cumsum(1 + wide) - 1  # where the last symbol of each code point goes
        out = np.zeros(at[-1] + 1, np.int64)
        out[at] = np.where(wide, WIDE + 2 + (0x110000 >> 10) + (codes & 1023), x)
        out[at[wide] - 1] = WIDE + 2 + (codes[wide] >> 10)
        last = np.zeros(len(out), bool)
        last[at[ends]] = True
        x, ends = out, last
    cuts = np.flatnonzero(ends)
    sizes = np.diff(np.concatenate([[-1], cuts]))
    into = np.arange(len(x)) - np.repeat(cuts - sizes + 1, sizes)
    g = x.copy()
    for k in range(1, ORDER):
        g[k:] |= np.where(into[k:] >= k, x[:-k], 0) << BITS * k
    return g, sizes


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5, F.lit(0).cast("long"))


def labelled(docs: DataFrame, labels: DataFrame, folds: list[int]) -> DataFrame:
    """Rows of docs with a label, of the given remainders.  Conflicting labels of an id count as the larger."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    labels = labels.where(held_out(F.col("_id")).isin(folds))
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "text").join(labels, "_id")


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, n0, n1, m0, m1): occurrences in ordinary and in toxic text, over all rows; m: in rows for calibration."""

    def count(batches):
        for batch in batches:
            words: tuple[dict, ...] = ({}, {}, {}, {})
            for part in slices([batch]):  # counts combine over the whole batch
                for text, toxic, later in zip(*(part.column(c).to_pylist() for c in ("text", "_toxic", "_later")), strict=True):
                    seen = words[(toxic > 0) + 2 * later]
                    for w in _WORD.findall(text.lower()):
                        seen[w] = seen.get(w, 0) + 1
            made = [grams_of(list(w)) for w in words]
            grams, at = np.unique(np.concatenate([g for g, _ in made]), return_inverse=True)
            sums, begin = [], 0
            for w, (g, sizes) in zip(words, made, strict=True):
                each = np.repeat(np.fromiter(w.values(), np.int64, len(w)), sizes)
                sums.append(np.bincount(at[begin : begin + len(g)], each, len(grams)).astype(np.int64))
                begin += len(g)
            yield pa.RecordBatch.from_arrays([pa.array(grams), *map(pa.array, sums)], ["gram", *_SUMS])

    slim = rows.select("text", "_toxic", (held_out(F.col("_id")) == 4).cast("int").alias("_later"))
    return _summed(slim.mapInArrow(count, "gram long, n0 long, n1 long, m0 long, m1 long"), "gram")


_SUMS = ("n0", "n1", "m0", "m1")


def _summed(counts: DataFrame, gram: str | Column) -> DataFrame:
    return counts.groupBy(gram).agg(*(F.sum(c).alias(c) for c in _SUMS))


def _by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, *(np.bincount(at, v, len(keys)) for v in values), at


def estimate(counts: np.ndarray) -> Model:
    """Kneser-Ney estimates as log-likelihood ratios, from (gram, n0, n1) as rows; the shortest backoff is uniform over the symbols seen."""
    counts = counts[:, counts[1:].any(0)]
    order = np.argsort(counts[0])
    grams, n = counts[0][order], counts[1:, order].astype(float)
    # shared backoff: continuation counts of every lower order, from the distinct n-grams of both classes
    below, suffixes = {}, grams
    for k in range(ORDER - 1, 0, -1):
        suffixes, left = np.unique(suffixes & ((1 << BITS * k) - 1), return_counts=True)
        below[k] = (suffixes, left.astype(float))
    p = np.full(len(grams), 1 / max(1, len(below[1][0])))
    for k in range(1, ORDER):
        keys, left = below[k]
        _, total, types, at = _by_key(keys >> BITS, left, np.ones(len(keys)))
        i = np.searchsorted(keys, grams & ((1 << BITS * k) - 1))
        p = np.maximum(left[i] - DISCOUNT, 0) / total[at[i]] + DISCOUNT * types[at[i]] / total[at[i]] * p
    contexts, t0, t1, y0, y1, at = _by_key(grams >> BITS, n[0], n[1], (n[0] > 0) * 1.0, (n[1] > 0) * 1.0)
    total, types = np.stack([t0, t1]), np.stack([y0, y1])
    kept = (DISCOUNT * types + PRIOR) / (total + PRIOR)
    q = np.maximum(n - DISCOUNT, 0) / (total + PRIOR)[:, at] + kept[:, at] * p
    return Model(grams, np.log(q[1] / q[0]), contexts, np.log(kept[1] / kept[0]), np.zeros(5))


def estimate_tables(counts: DataFrame, weights: np.ndarray) -> Tables:
    """estimate() by grouped sums over a table (gram, n0, n1), for any number of n-grams."""

    def suffix(k: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1).cast("long"))

    context = F.shiftright("gram", BITS).alias("context")
    counts = counts.where("n0 > 0 or n1 > 0")
    below, longer = {}, counts
    for k in range(ORDER - 1, 0, -1):
        longer = below[k] = materialise(longer.groupBy(suffix(k).alias("gram")).agg(F.count("*").alias("left")), f"below{k}")
    shared, n_symbols = None, max(1, below[1].count())
    for k in range(1, ORDER):
        sums = below[k].groupBy(context).agg(F.sum("left").alias("total"), F.count("*").alias("types"))
        now = below[k].withColumn("context", context).join(sums, "context")
        now = now.withColumn("p", F.lit(1 / n_symbols)) if shared is None else now.join(shared, suffix(k - 1) == F.col("suffix"))
        p = F.greatest(F.col("left") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("types") / F.col("total") * F.col("p")
        before, shared = shared, materialise(now.select(F.col("gram").alias("suffix"), p.alias("p")), f"shared{k}")
        discard(below[k], *([before] if before is not None else []))
    sums = counts.groupBy(context).agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in (0, 1)), *(F.count_if(F.col(f"n{i}") > 0).alias(f"y{i}") for i in (0, 1)))
    kept = [((DISCOUNT * F.col(f"y{i}") + PRIOR) / (F.col(f"t{i}") + PRIOR)).alias(f"kept{i}") for i in (0, 1)]
    contexts = materialise(sums.select("context", "t0", "t1", *kept).withColumn("unseen", F.log(F.col("kept1") / F.col("kept0"))), "contexts")
    q = [F.greatest(F.col(f"n{i}") - DISCOUNT, F.lit(0.0)) / (F.col(f"t{i}") + PRIOR) + F.col(f"kept{i}") * F.col("p") for i in (0, 1)]
    rows = counts.withColumn("context", context).join(contexts, "context").join(shared, suffix(ORDER - 1) == F.col("suffix"))
    ratios = materialise(rows.select("gram", F.log(q[1] / q[0]).alias("ratio")), "ratios")
    discard(shared)
    return Tables(ratios, contexts.select("context", "unseen"), weights)


def word_ratio(model: Model, word: str) -> float:
    g = np.array(pack(word), np.int64)
    if not len(model.grams):
        return 0.0
    i = np.minimum(np.searchsorted(model.grams, g), len(model.grams) - 1)
    j = np.minimum(np.searchsorted(model.contexts, g >> BITS), len(model.contexts) - 1)
    unseen = np.where(model.contexts[j] == g >> BITS, model.unseen[j], 0.0)
    return float(np.where(model.grams[i] == g, model.ratios[i], unseen).sum())


def _fill(model: Model, memo: dict, words: list[str]) -> None:
    """word_ratio of many words at once."""
    if not len(model.grams):
        memo.update(dict.fromkeys(words, 0.0))
        return
    g, sizes = grams_of(words)
    i = np.minimum(np.searchsorted(model.grams, g), len(model.grams) - 1)
    j = np.minimum(np.searchsorted(model.contexts, g >> BITS), len(model.contexts) - 1)
    unseen = np.where(model.contexts[j] == g >> BITS, model.unseen[j], 0.0)
    v = np.where(model.grams[i] == g, model.ratios[i], unseen)
    memo.update(zip(words, np.add.reduceat(v, np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist(), strict=True))


def features(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean ratio over the words, over the strongest one and three, and the log of their number."""
    memo = _memo.setdefault(model.tag, {})
    for tag in [t for t in _memo if t != model.tag]:
        del _memo[tag]
    out = np.zeros((len(texts), 4))
    said = [_WORD.findall((text or "").lower()) for text in texts]
    new = {w for words in said for w in words if w not in memo}
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = {w for words in said for w in words}
    if new:
        _fill(model, memo, list(new))
    for k, words in enumerate(said):
        if words:
            v = np.fromiter(map(memo.__getitem__, words), float, len(words))
            top = np.sort(v[np.argpartition(v, -3)[-3:]] if len(v) > 3 else v)[::-1]
            out[k] = v.mean(), top[0], top.mean(), np.log(len(v))
    return out


def _word_rows(batches):
    """(_r1, _r2, word, n): the distinct words of each text."""
    rows: list[tuple] = []

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["_r1", "_r2", "word", "n"])
        rows.clear()
        return out

    for batch in slices(batches):
        for r1, r2, text in zip(*(batch.column(c) for c in ("_r1", "_r2", "text")), strict=True):
            seen: dict[str, int] = {}
            for w in _WORD.findall((text.as_py() or "").lower()):
                seen[w] = seen.get(w, 0) + 1
            rows += ((r1.as_py(), r2.as_py(), w, n) for w, n in seen.items())
            if len(rows) > 20_000:
                yield flushed()
    if rows:
        yield flushed()


def _gram_rows(batches):
    """(_w1, _w2, gram): the n-grams of words, each as often as it occurs."""
    for batch in slices(batches):
        g, sizes = grams_of(batch.column("word").to_pylist())
        at = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([batch.column("_w1").take(at), batch.column("_w2").take(at), pa.array(g)], ["_w1", "_w2", "gram"])


def with_features(rows: DataFrame, doc_id: str, model: Tables) -> DataFrame:
    """rows with their features() as a, b, c and d, by joins of distinct words to the tables."""
    text = F.coalesce("text", F.lit(""))
    keyed = rows.withColumns(dict(zip(("_r1", "_r2"), row_key(F.col(doc_id), text), strict=True)))
    word_key = dict(zip(("_w1", "_w2"), row_key(F.length("word"), F.col("word")), strict=True))
    found = materialise(keyed.select("_r1", "_r2", "text").mapInArrow(_word_rows, "_r1 long, _r2 long, word string, n long").withColumns(word_key), "words")
    grams = found.groupBy("_w1", "_w2").agg(F.first("word").alias("word")).mapInArrow(_gram_rows, "_w1 long, _w2 long, gram long")
    known = grams.withColumn("context", F.shiftright("gram", BITS)).join(model.grams, "gram", "left").join(model.contexts, "context", "left")
    values = materialise(known.groupBy("_w1", "_w2").agg(F.sum(F.coalesce("ratio", "unseen", F.lit(0.0))).alias("v")), "word_values")
    # equal rows share a key and have equal words, so a set has them once
    sets = found.join(values, ["_w1", "_w2"]).groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set(F.struct("v", "n", "_w1", "_w2")), False).alias("x"))
    n = F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["v"] * x["n"])
    top = F.slice(F.flatten(F.transform(F.slice("x", 1, 3), lambda x: F.array_repeat(x["v"], F.least(x["n"], F.lit(3)).cast("int")))), 1, 3)
    x = sets.select(F.col("_r1").alias("_f1"), F.col("_r2").alias("_f2"), n.alias("_n"), total.alias("_total"), top.alias("_top"))
    x = x.select("_f1", "_f2", (F.col("_total") / F.col("_n")).alias("a"), F.col("_top")[0].alias("b"), (F.aggregate("_top", F.lit(0.0), lambda s, v: s + v) / F.size("_top")).alias("c"), F.log(F.col("_n").cast("double")).alias("d"))
    out = keyed.join(x, (F.col("_r1") == F.col("_f1")) & (F.col("_r2") == F.col("_f2")), "left").drop("_r1", "_r2", "_f1", "_f2")
    return out.fillna(0.0, ["a", "b", "c", "d"])


def _evidence(weights: np.ndarray) -> Column:
    """The logistic fit's linear term of the features a, b, c and d."""
    out = F.lit(float(weights[0]))
    for name, w in zip("abcd", weights[1:].tolist(), strict=True):
        out = out + F.col(name) * w
    return out


def _batches(frame: DataFrame, model: Model, keep: list[str], schema: str, finish) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            x = features(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *finish(shared.value, x)], [f.split()[0] for f in schema.split(", ")])

    return frame.mapInArrow(run, schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights, the bias first, of a ridge-regularised logistic fit; the rarer class counts by the root of the imbalance."""
    rate = y.mean()
    each = np.where(y > 0, np.sqrt(max(1, (1 - rate) / rate)), np.sqrt(max(1, rate / (1 - rate))))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, penalty = np.zeros(z.shape[1]), ridge * np.diag([1e-3, *[1.0] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (each * (p - y)) + penalty @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale])


def train(docs: DataFrame, labels: DataFrame) -> Model | Tables:
    """Fit the score on rows of the remainder 4 by counts of the remainders 1 to 3, then count all four.

    Both kinds of model give the same scores, up to rounding; only where the ratios lie differs.
    """
    table = materialise(count_grams(labelled(docs, labels, [1, 2, 3, 4])), "grams")
    small = table.count() <= BROADCAST_GRAMS
    rows = labelled(docs, labels, [4]).select("_id", "text", "_toxic")
    if small:
        t = table.toArrow()
        counts = np.stack([t.column(c).to_numpy() for c in ("gram", *_SUMS)]) if t.num_rows else np.zeros((5, 0), np.int64)
        rows = _batches(rows, estimate(counts[:3]), ["_id", "_toxic"], "_id long, toxic int, a double, b double, c double, d double", lambda m, x: [pa.array(c) for c in x.T])
    else:
        rows = with_features(rows, "_id", estimate_tables(table.select("gram", "n0", "n1"), np.zeros(5))).select("_id", F.col("_toxic").alias("toxic"), *"abcd")
    fit = rows.orderBy(F.xxhash64("_id"), "_id", "toxic", "a").limit(CALIBRATION_ROWS).toArrow()
    y = fit.column("toxic").to_numpy() > 0
    if not len(y) or y.all() or not y.any():  # one class only: its rate, and the evidence as it is
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        weights = np.array([np.log(rate / (1 - rate)) - 4, 0.0, 0.5, 0.0, 0.0]) if not small or counts.shape[1] else np.array([-4.0, 0, 0, 0, 0])
    else:
        weights = logistic(np.stack([fit.column(c).to_numpy() for c in "abcd"], axis=1), y * 1.0)
    if not small:
        return estimate_tables(table.select("gram", (F.col("n0") + F.col("m0")).alias("n0"), (F.col("n1") + F.col("m1")).alias("n1")), weights)
    model = estimate(np.stack([counts[0], counts[1] + counts[3], counts[2] + counts[4]]))
    tag = hash((counts.tobytes(), weights.tobytes()))
    return Model(model.grams, model.ratios.astype(np.float32), model.contexts, model.unseen.astype(np.float32), weights, tag)


def score(docs: DataFrame, model: Model | Tables) -> DataFrame:
    """Score whole texts: doc_id, held_out, score, predicted.

    Null and empty texts, and texts without letters, have no evidence and get
    the score of features that are all zero; very long texts are read whole.  A null doc_id counts as held out.
    Repeated rows are scored each; extra columns are ignored.  Only the text
    enters the score.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (held_out(F.col("doc_id")) == 0).alias("held_out"), "text")
    if isinstance(model, Tables):
        s = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _evidence(model.weights)))))
        return with_features(slim, "doc_id", model).select("doc_id", "held_out", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))

    def finish(m, x):
        s = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30)))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return _batches(slim, model, ["doc_id", "held_out"], "doc_id long, held_out boolean, score double, predicted int", finish)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows of docs and score every row."""
    return score(docs, train(docs, labels))


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that are not predicted toxic, all their columns, whatever their names.

    Null and empty texts get the score of score(); repeated rows share their
    fate and stay each.  An empty table stays empty.
    """
    model = train(docs, labels)
    names = docs.columns
    if isinstance(model, Tables):
        slim = docs.select("text", F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
        return with_features(slim, "_id", model).where(_evidence(model.weights) < 0).select("_row.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def run(batches):
        for batch in slices(batches):
            m = shared.value
            x = features(m, batch.column(at).to_pylist())
            yield batch.filter(pa.array(m.weights[0] + x @ m.weights[1:] < 0))

    return docs.mapInArrow(run, docs.schema)
