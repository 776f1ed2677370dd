"""Exact removal of long repeated byte strings, by suffixes sorted a bucket at a time with a difference cover.

Every byte under a string of ``length`` bytes that also starts elsewhere goes.
Such strings are prefixes of suffixes, so those that repeat stand next to each
other in sorted order.  The order need not be that of the bytes: any in which
equal prefixes meet will do, and that of digests can be sorted without moving
the bytes of every suffix.

* texts: equal texts are one, with the number of their copies;
* sample ranks: the strings of length - v bytes at the positions of a difference
  cover modulo v (see suffixes.py) are sorted, and those that repeat get ranks.
  A suffix can repeat only if a sample in its first v positions does, so the
  others are never written down;
* buckets: the suffixes that are left fall into buckets by their prefix, namely
  by the smallest hash among the strings of ``anchor`` bytes inside.  Neighbours
  mostly share it, so a bucket gets runs of suffixes as one piece of text;
* a task takes its buckets one at a time: it spells out the suffixes of a bucket,
  sorts them, resolves ties by the ranks of the cover sample, holds those that
  come out equal against each other's bytes, and frees them before it reads the
  next.  What a task holds is bounded by HOT suffixes; larger
  buckets are dealt out again by suffix.

Names and runs that repeat inside a task are settled there, and one of each goes
on, so a passage that a third of all rows hold is a few rows by the time it is
shuffled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut_rows, discard, materialise, parallelism
from loomline.llm.rolling import BLOCK, Rolling, mix, sliding_argmin
from loomline.llm.suffixes import RANK_BYTES, Cover, Runs, classes, cover, pack_ranks, unpack_ranks, verified

LENGTH = 400
ANCHOR = 100
#: Sample names, or suffixes, that a task gathers before it sorts them.
GATHER = 1 << 17
#: Samples of a bucket.
BUCKET = 1 << 17
#: Suffixes of a bucket beyond which it is dealt out by suffix.
HOT = 1 << 18
#: Keys of hot buckets that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 100_000

#: States of a row: not seen twice yet; stands for several or for a repeated text; settled.
SINGLE, KNOWN, DONE = 0, 1, 2


def _digest(text):
    return F.sha2(text, 256)


def distinct_texts(docs: DataFrame, length: int) -> DataFrame:
    """(digest, text, copies, n, tid): the distinct texts of at least ``length`` bytes."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(text.alias("text")).where(F.octet_length("text") >= length)
    out = rows.groupBy(_digest(F.col("text")).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return materialise(out.select("digest", "text", "copies", F.octet_length("text").alias("n"), F.monotonically_increasing_id().alias("tid")), "texts", compression="zstd")


def _planes(values: np.ndarray) -> bytes:
    """64-bit words byte by byte, all first bytes first: most of these repeat, and compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _words(column: pa.Array) -> np.ndarray:
    """The words of all rows of _planes()."""
    rows = [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T for x in column]
    return np.ascontiguousarray(np.concatenate(rows)).view(np.int64).ravel()


_SAMPLE = "bucket long, done boolean, known binary, names binary, tids binary, places binary"


def _sample_rows(buckets: list[int], parts: list[tuple], done: bool) -> pa.RecordBatch:
    columns = [pa.array(buckets, pa.int64()), pa.array([done] * len(buckets)), pa.array([p[0].tobytes() for p in parts], pa.binary())]
    columns += [pa.array([_planes(p[i]) for p in parts], pa.binary()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SAMPLE.split(", ")])


def bucket_bits(texts: DataFrame, c: Cover) -> int:
    """Bits of a name that tell its bucket: buckets of about BUCKET samples, and enough of them for all tasks."""
    n = (texts.agg(F.sum("n")).first()[0] or 0) * c.width // c.period
    return max(n // BUCKET, 2 * parallelism(texts.sparkSession)).bit_length()


def samples(texts: DataFrame, c: Cover, bits: int) -> DataFrame:
    """The cover's samples, many to a row, dealt out by the first bits of their names; of names that a task meets twice, one goes on."""
    rolling = Rolling(0)

    def settled(held: list[list]):
        name, tid, at = (np.concatenate(x) for x in held)
        order = np.argsort(name)
        name, tid, at = name[order], tid[order], at[order]
        new = np.concatenate([[True], name[1:] != name[:-1]])
        many = np.diff(np.concatenate([np.flatnonzero(new), [len(name)]])) > 1
        every = many[np.cumsum(new) - 1]
        if every.any():
            spread = mix(name[every][:1])[0] >> np.uint64(64 - bits) if bits else 0  # settled rows go anywhere, but not all to the smallest names
            yield _sample_rows([int(spread)], [(many[:0], name[every], tid[every], at[every])], True)
        name, tid, at = name[new], tid[new], at[new]
        bucket = name >> np.uint64(64 - bits) if bits else np.zeros(len(name), np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(name)]]).tolist()
        for k in range(0, len(cuts) - 1, 4096):
            part = [slice(x, y) for x, y in itertools.pairwise(cuts[k : k + 4097])]
            yield _sample_rows([int(bucket[x.start]) for x in part], [(many[x], name[x], tid[x], at[x]) for x in part], False)

    def run(batches):
        held: list[list] = [[], [], []]
        n = 0
        for batch in batches:
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                wanted = c.positions(len(data))
                for begin in range(0, len(data) - c.span + 1, BLOCK):
                    at = wanted[np.searchsorted(wanted, begin) : np.searchsorted(wanted, begin + BLOCK)]
                    prefix = rolling.prefix(data[begin : begin + BLOCK + c.span - 1])
                    name = np.maximum(rolling.strings(prefix, at - begin, c.span), np.uint64(1))
                    for h, x in zip(held, (name, np.full(len(at), tid), at), strict=True):
                        h.append(x)
                    n += len(at)
                    if n >= GATHER:
                        yield from settled(held)
                        held, n = [[], [], []], 0
        if n:
            yield from settled(held)

    return texts.select("tid", "text").mapInArrow(run, _SAMPLE)


def _lots(batches: Iterable[pa.RecordBatch], weight, most: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column, cut anew into lots of whole keys that weigh about ``most``; weight(batch) is that of each row."""
    held: list[pa.RecordBatch] = []
    load, last = 0, None

    def lot():
        out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        return out

    for batch in batches:
        key = batch.column(0).to_numpy()
        total = np.concatenate([[0], np.cumsum(weight(batch))])
        starts = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
        begin = 0
        for at in starts.tolist():
            if load + total[at] - total[begin] >= most:
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                yield lot()
                begin, load = at, 0
        held.append(batch.slice(begin))
        load += int(total[-1] - total[begin])
        last = key[-1]
    if held:
        yield lot()


def repeated_samples(rows: DataFrame) -> DataFrame:
    """(tid, at, rank) of the samples whose name occurs twice; a task sorts one bucket of names at a time, and ranks are in their order."""

    def spelled(tid, at, rank):
        return pa.RecordBatch.from_arrays([pa.array(tid), pa.array(at), pa.array(rank)], ["tid", "at", "rank"])

    def run(batches):
        def open_rows():
            for batch in batches:
                done = batch.column("done").to_numpy(zero_copy_only=False)
                if done.any():
                    part = batch.filter(pa.array(done))
                    settled.append(spelled(*(_words(part.column(x)) for x in ("tids", "places", "names"))))
                if not done.all():
                    yield batch.filter(pa.array(~done))

        settled: list = []
        for part in _lots(open_rows(), lambda b: pc.binary_length(b.column("known")).to_numpy(), GATHER):
            yield from settled
            settled.clear()
            name, tid, at = (_words(part.column(x)) for x in ("names", "tids", "places"))
            known = np.concatenate([np.frombuffer(x.as_buffer(), np.bool_) for x in part.column("known")])
            order = np.argsort(name)
            new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
            size = np.diff(np.concatenate([np.flatnonzero(new), [len(name)]]))
            take = order[(size > 1)[np.cumsum(new) - 1]]
            take = take[~known[take]]
            if len(take):
                yield spelled(tid[take], at[take], name[take])
        yield from settled

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "tid long, at long, rank long")


def suspects(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Texts with repeated samples, and where these are."""
    each = materialise(repeated.groupBy(F.col("tid").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).alias("s")), "ranks")
    joined = texts.join(each, F.col("tid") == F.col("_t")).select("tid", "digest", "copies", "text", "s.at", "s.rank")
    found = materialise(joined, "suspects", compression="zstd")
    discard(each)
    return found


_RUN = "key long, tid long, at long, n long, state byte, data binary, ranks binary"
_RUN_NAMES = [f.split()[0] for f in _RUN.split(", ")]


class _Piece:
    """Runs gathered in a task: equal ones are settled, and one of them goes on."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.open: dict[tuple, list] = {}
        self.done: list[tuple] = []
        self.n = 0

    def add(self, key: int, same: tuple, tid: int, at: int, n: int, state: int, data: bytes, ranks: bytes) -> None:
        held = self.open.get((key, same))
        if held is not None and held[5] != data:  # one digest, other bytes
            same = (*same, data)
            held = self.open.get((key, same))
        if held is None:
            self.open[key, same] = [key, tid, at, n, state, data, ranks]
            self.n += n
            return
        if held[4] == SINGLE:
            self.done.append((held[1], held[2], held[3]))
            held[4] = KNOWN
        if state == SINGLE:
            self.done.append((tid, at, n))

    def batch(self) -> pa.RecordBatch:
        rows = list(self.open.values())
        key = mix(np.array([d[0] for d in self.done], np.int64).view(np.uint64)).view(np.int64).tolist()
        rows += [[k, *d, DONE, None, None] for k, d in zip(key, self.done, strict=True)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.binary()]
        out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _RUN_NAMES)
        self.clear()
        return out


def windows(at: np.ndarray, n: int, c: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [lo, hi) of suffixes with one of the samples in their first v positions."""
    lo, hi = np.maximum(at - c.period + 1, 0), np.minimum(at + 1, n - c.length + 1)
    fits = hi > lo
    lo, hi = lo[fits], hi[fits]
    start = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, bool)
    return lo[start], hi[np.concatenate([start[1:], [True]])] if len(lo) else hi


def runs(found: DataFrame, c: Cover, anchor: int) -> DataFrame:
    """Runs of suffixes that may repeat, keyed by bucket."""
    rolling = Rolling(1)

    def run(batches):
        piece = _Piece()
        for batch in batches:
            for tid, copies, text, at, rank in zip(*(batch.column(x) for x in ("tid", "copies", "text", "at", "rank")), strict=True):
                data, tid = np.frombuffer(text.as_buffer(), np.uint8), tid.as_py()
                at, rank = at.values.to_numpy(), rank.values.to_numpy()
                state = KNOWN if copies.as_py() > 1 else SINGLE
                ranks = np.zeros(c.index(len(data)) + c.width, np.uint64)
                ranks[c.index(at)] = rank.view(np.uint64) & np.uint64((1 << 8 * RANK_BYTES) - 1) | np.uint64(1)
                for lo, hi in zip(*(x.tolist() for x in windows(at, len(data), c)), strict=True):
                    for begin in range(lo, hi, BLOCK):
                        part = data[begin : min(hi, begin + BLOCK) - 1 + c.length]
                        prefix = rolling.prefix(part)
                        names = rolling.windows(prefix, anchor)
                        least = sliding_argmin(names, c.length - anchor + 1)
                        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                        size = np.diff(np.concatenate([first, [len(least)]]))
                        whole = rolling.spans(prefix, first, first + size - 1 + c.length)
                        i = c.index(first + begin)
                        j = c.index(first + begin + size - 1) + c.width
                        for key, same, f, m, a, b in zip(names[least[first]].view(np.int64).tolist(), whole.tolist(), first.tolist(), size.tolist(), i.tolist(), j.tolist(), strict=True):
                            piece.add(key, (same, m), tid, begin + f, m, state, part[f : f + m - 1 + c.length].tobytes(), pack_ranks(ranks[a:b]))
                        if piece.n >= GATHER:
                            yield piece.batch()
        if piece.open:
            yield piece.batch()

    return found.mapInArrow(run, _RUN)


def _expanded(batch: pa.RecordBatch, spelled: Runs):
    """What Runs.expand() gives, then the bytes of all runs and where in them each suffix starts."""
    at, n = (batch.column(x).to_numpy() for x in ("at", "n"))
    data, ranks = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8) for x in ("data", "ranks"))
    out = spelled.expand(at, n, data, unpack_ranks(ranks))
    offset = np.cumsum(n - 1 + spelled.cover.length) - (n - 1 + spelled.cover.length)
    return *out, data, (offset - at)[out[0]] + out[1]


def by_suffix(rows: DataFrame, c: Cover) -> DataFrame:
    """Runs cut to single suffixes, whose bucket is that of their own bytes."""
    spelled = Runs(c, Rolling(0))

    def run(batches):
        piece = _Piece()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                run, position, head, tail, ranks, *_ = _expanded(part, spelled)
                tid, at, state, data = (part.column(x) for x in ("tid", "at", "state", "data"))
                tid, at, state, data = tid.to_numpy()[run].tolist(), at.to_numpy()[run], state.to_numpy()[run].tolist(), data.to_pylist()
                key = mix(head + mix(tail)).view(np.int64).tolist()
                for i, (r, p, o) in enumerate(zip(run.tolist(), position.tolist(), (position - at).tolist(), strict=True)):
                    text = data[r][o : o + c.length]
                    piece.add(key[i], (text,), tid[i], p, 1, state[i], text, pack_ranks(ranks[i]))
                if piece.n * c.length >= GATHER * 16:
                    yield piece.batch()
        if piece.open:
            yield piece.batch()

    return rows.mapInArrow(run, _RUN)


def resolve(rows: DataFrame, c: Cover) -> DataFrame:
    """(tid, lo, hi): spans under repeated strings.  Each task sorts one lot of whole buckets at a time."""
    spelled = Runs(c, Rolling(0))

    def spans(tid, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(tid), pa.array(lo), pa.array(hi)], ["tid", "lo", "hi"])

    def answers(part):
        """Spans of the suffixes of a lot that repeat, run by run."""
        run, position, head, tail, ranks, data, where = _expanded(part, spelled)
        label = verified(c, classes(c, head, tail, position, ranks), head, tail, data, where)
        state = part.column("state").to_numpy()
        size = np.bincount(label) + np.bincount(label, state[run] == KNOWN)
        take = (size[label] > 1) & (state[run] == SINGLE)
        run, position = run[take], position[take]
        if not len(run):
            return None
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (position[1:] > position[:-1] + c.length)])
        last = np.concatenate([new[1:], [True]])
        return spans(part.column("tid").to_numpy()[run[new]], position[new], position[last] + c.length)

    def run(batches):
        done: list = []

        def open_rows():
            for batch in batches:
                state = batch.column("state").to_numpy()
                settled = batch.filter(pa.array(state == DONE))
                if settled.num_rows:
                    tid, at, n = (settled.column(x).to_numpy() for x in ("tid", "at", "n"))
                    done.append(spans(tid, at, at + n - 1 + c.length))
                left = batch.filter(pa.array(state != DONE))
                if left.num_rows:
                    yield left

        for lot in _lots(open_rows(), lambda b: b.column("n").to_numpy(), GATHER):
            yield from done
            done.clear()
            found = answers(lot)
            if found is not None:
                yield found
        yield from done

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "tid long, lo long, hi long")


def repeated_spans(found: DataFrame, c: Cover, anchor: int) -> DataFrame:
    """(tid, lo, hi): spans of the texts of suspects() under repeated strings, not merged yet."""
    rows = materialise(runs(found, c, anchor), "runs", compression="zstd")
    hot = materialise(rows.where(F.col("state") != DONE).groupBy(F.col("key").alias("_k")).agg(F.sum("n").alias("m")).where(F.col("m") > HOT).select("_k"), "hot_buckets")
    n_hot = hot.count()
    if n_hot:
        keys = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        large = (F.col("key") == F.col("_k")) & (F.col("state") != DONE)
        rows = rows.join(keys, large, "left_anti").unionByName(by_suffix(rows.join(keys, large, "left_semi"), c))
    return materialise(resolve(rows, c), "spans")


def substring_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are bytes of UTF-8; a null text is empty.  Matches don't cross texts;
    they may overlap within one.  Strings are judged on the input.  Equal texts
    repeat each other, whatever their ids, so all of a repeated text of at least
    ``length`` bytes goes, in each of its rows.  Texts of any length are walked
    in blocks.  An empty table gives an empty result, and extra columns are
    ignored.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256; with_text adds
    the remaining bytes as ``kept``.
    """
    if not 8 <= anchor <= length:
        raise ValueError("anchor must lie between 8 and length")
    c = cover(length)
    texts = distinct_texts(docs, length)
    copied = materialise(texts.where("copies > 1").select("digest", F.col("n").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("sha"), *([F.lit(b"").alias("left")] if with_text else [])), "copied")
    found = suspects(texts, repeated_samples(samples(texts, c, bucket_bits(texts, c))))
    discard(texts)
    spans = repeated_spans(found, c, anchor)
    each = spans.groupBy(F.col("tid").alias("_t")).agg(F.collect_set(F.struct("lo", "hi")).alias("x"))
    hit = found.where("copies = 1").join(each, F.col("tid") == F.col("_t")).select("digest", "text", "x.lo", "x.hi")
    cut = cut_rows(hit, ["digest"], 0, with_text).withColumnsRenamed({"kept_sha256": "sha", "kept": "left"}).drop("n_bytes")
    cut = materialise(cut.unionByName(copied).withColumnRenamed("digest", "_d"), "cut")
    discard(found, spans)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _digest(text).alias("_digest"), *([text.alias("_text")] if with_text else []))
    out = slim.join(cut, F.col("_digest") == F.col("_d"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "_digest").alias("kept_sha256"), *([F.coalesce("left", "_text").alias("kept")] if with_text else []))
