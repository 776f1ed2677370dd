"""Near-duplicates by SimHash, found with a generalised pigeonhole.

Bits that vary together are put into the same partition.  If two fingerprints
differ in at most t bits and partition i is given the threshold t_i, then some
partition differs in at most t_i bits as long as the sum of (t_i + 1) exceeds t.
The number of partitions and their unequal thresholds are chosen by dynamic
programming on the probes and candidates that each costs, estimated from how
often bits differ among all distinct fingerprints; a threshold of -1 leaves a
partition out.  Fingerprints that meet in a probe are verified by their distance.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise, parallelism, row_key, slices
from loomline.llm.components import stars

SHINGLE = 3
DISTANCE = 3
BITS = 64
#: Fingerprints verified against each other at a time; larger groups are split into blocks, and pairs of blocks are groups.
BLOCK = 2048
#: Keys of split groups that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 100_000
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is in more than half of the shingle hashes (XXH64, seed 42); 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, n, _CHUNK):
        part = words[begin : begin + _CHUNK + shingle - 1]
        columns = [part[i : len(part) - shingle + 1 + i] for i in range(shingle)] if len(words) >= shingle else []
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in (zip(*columns, strict=True) if columns else [part])]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column fp instead of text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp)], [*rest, "fp"])

    return docs.mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest) + ", fp long")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and in how many of them bits i and j are both set, over all rows."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype("<i8")
            for part in np.array_split(fp, -(-len(fp) // 8192) or 1):
                x = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
            n += len(fp)
        i, j = np.indices((BITS, BITS)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i], pa.int32()), pa.array(np.r_[-1, j], pa.int32()), pa.array(np.r_[n, both.ravel()].astype(np.int64))], ["i", "j", "n"])

    both, n = np.zeros((BITS, BITS)), 0
    for r in distinct.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows from a bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        width = -(-len(free) // (m - k))
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            free.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def near_chance(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two random fingerprints differ in at most 0..most of the bits with set rates p."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for d in 2 * p * (1 - p):
        chance = chance * (1 - d) + np.r_[0, chance[:-1]] * d
    return chance.cumsum()


def allocate(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, those of -1 left out, of the least estimated cost."""
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, distance + 4):
        parts = partition_bits(n, both, m)
        cost = []
        for bits in parts:
            near = near_chance(p[bits], distance)
            probes = np.cumsum([math.comb(len(bits), t) for t in range(distance + 1)])
            cost.append([0.0, *(20.0 * n * probes[t] + n * n / 2 * near[t] for t in range(distance + 1))])
        # sum of (t + 1) over partitions must reach distance + 1; state: that sum so far
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            grown: dict[int, tuple[float, list[int]]] = {}
            for have, (spent, chosen) in state.items():
                for t1, extra in enumerate(c):
                    to = min(distance + 1, have + t1)
                    if to not in grown or spent + extra < grown[to][0]:
                        grown[to] = (spent + extra, [*chosen, t1 - 1])
            state = grown
        spent, chosen = state[distance + 1]
        if spent < best[0]:
            best = (spent, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def probes(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): each fingerprint under its bits of each partition and under all values within the threshold."""
    flips = []
    for bits, t in plan:
        flips.append(np.array([sum(1 << b for b in c) for k in range(t + 1) for c in itertools.combinations(range(len(bits)), k)], np.uint64))

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            u = fp.view(np.uint64)
            for part, (bits, _) in enumerate(plan):
                key = np.zeros(len(u), np.uint64)
                for k, b in enumerate(bits):
                    key |= (u >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
                for flip in np.array_split(flips[part], -(-len(flips[part]) // 64)):
                    keys = (key[:, None] ^ flip).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(fp, len(flip)))], ["part", "key", "fp"])

    return distinct.select("fp").mapInArrow(run, "part int, key long, fp long")


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of trees that span the components of fingerprints within the distance; not all pairs."""
    left = np.unique(fp).view(np.uint64)
    edges = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(left ^ x) <= distance
            if close.any():
                found = left[close]
                left = left[~close]
                edges += [(y, x) for y in found]
                queue += list(found)
    return edges


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) within the distance that connect what all such pairs would."""
    spark = distinct.sparkSession
    rows = probes(distinct, plan)
    hot = materialise(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot_keys")
    n_hot = hot.count()
    if n_hot:
        many = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
        hot = hot.select("part", "key", many.alias("many"))
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, ["part", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("many")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda j: F.least(own, j) * F.col("many") + F.greatest(own, j))
        rows = rows.select("part", "key", "fp", F.explode(F.coalesce(F.when(F.col("many") > 1, pair), F.array(F.lit(0)))).alias("pair"))
    else:
        rows = rows.withColumn("pair", F.lit(0))
    names = ["part", "key", "pair"]

    def run(batches):
        rest = None  # rows of the last group so far
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [batch.column(c).to_numpy() for c in (*names, "fp")]
                rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rest[:3]], axis=0)) + 1
            ends = change if batch is not None else np.r_[change, len(rest[0])]
            begins = np.r_[0, ends[:-1]] if len(ends) else ends
            a, b = [], []
            for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
                if hi - lo > 1:
                    for y, x in forest(rest[3][lo:hi], distance):
                        a.append(y)
                        b.append(x)
            if len(ends):
                rest = [x[ends[-1] :] for x in rest]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    return rows.repartition(parallelism(spark), *names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) for each distinct fp of prints (doc_id, fp); root stands for the component."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    n, both = bit_counts(distinct)
    roots = stars(links(distinct, allocate(n, both, distance), distance))
    rooted = materialise(distinct.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    lows = materialise(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    out = materialise(rooted.join(lows, "root").select("fp", "root", "component_id"), "classes")
    discard(distinct, rooted, lows)
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Components of documents linked by fingerprints that differ in at most ``distance`` bits.

    Null texts and texts without words have the fingerprint 0 and are linked
    like any other.  Equal texts share a fingerprint, so copies are never
    paired up.  component_id is the smallest doc_id of the component, null only
    if all its ids are null.  Repeated rows come back each; extra columns are
    ignored; an empty table gives an empty result.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id.
    """
    prints = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "prints")
    found = classes(prints, distance)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component, all columns, whatever their names: that of the smallest doc_id (nulls last), then of the smallest hash.

    Null texts and texts without words are one component.  Of rows equal in
    doc_id and text one stays.  Very long texts are read whole.  An empty table
    stays empty.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *row_key(F.col("doc_id"), text))
    prints = materialise(fingerprints(keyed.select("doc_id", "_r1", "_r2", "text"), shingle), "prints")
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_r1", "_r2")).alias("best"))
    kept = best.join(classes(prints, distance), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = materialise(kept.select(F.col("best._r1").alias("_k1"), F.col("best._r2").alias("_k2")), "kept")
    discard(prints)
    rows = keyed.select("_row", "_r1", "_r2").join(kept, (F.col("_r1") == F.col("_k1")) & (F.col("_r2") == F.col("_k2")), "left_semi")
    return rows.dropDuplicates(["_r1", "_r2"]).select("_row.*")
