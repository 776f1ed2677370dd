"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text is cut into paragraphs, long ones at sentence ends; each distinct piece
has a digest of 64 bits.  A sketch has three subtables; a digest goes to one cell
of each, which keeps a count, the XOR of its digests and the XOR of their
checks.  The fingerprint of a text is its sketch of 3 x CELLS cells, whatever its
length.

Fingerprints of two versions subtract cell by cell; what is left holds the
pieces in which they differ, and peeling cells that hold one digest recovers
them.  If peeling gets stuck, both texts get sketches GROWTH times larger, which
are subtracted and peeled in turn, until none is stuck.

All of it is DataFrame expressions: cells are rows, subtraction is a grouped sum
and XOR, and a peeling round is an explode and another grouped sum.  Rows are
dealt out once, by ranges of doc_id; every later grouping contains that range,
so no cell moves again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import joined_in_place, materialise

#: Cells of each subtable of the fingerprint, and how much larger the next attempt is.
CELLS, GROWTH = 8, 16
#: Rows a range holds about, and ranges at most: their bounds are part of the plan.
RANGE_ROWS, MAX_RANGES = 500, 20_000
#: Peeling passes over the three subtables; what takes more is tried larger, where cells hold few digests.
PASSES = 2
_PIECE = r"\n+|(?<=[.!?]) +"
_AT = ["range", "row"]
_TABLES = 3


def check(digest: Column) -> Column:
    """32 bits that tell a digest from the XOR of several."""
    return F.xxhash64(digest, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def digests(text: Column) -> Column:
    """Sorted distinct digests of the pieces of a text."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, _PIECE), lambda p: F.length(p) > 0), lambda p: F.xxhash64(p))))


def place(digest: Column, table: int, cells: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(table + _TABLES * seed)), cells).cast("int") + F.lit(table) * cells


def _bounds(keys: DataFrame) -> list[tuple[int, int]]:
    """(order, hash) of some rows, ascending, the last of all among them: the rows of the smallest hashes, so that ranges are about even."""
    n = keys.count()
    wanted = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    if not n:
        return [(0, 0)]
    share = F.lit(min(1.0, wanted / n) * 2.0**63)
    chosen = keys.where(F.abs(F.xxhash64("o", "h", F.lit(17)).cast("double")) <= share).distinct()
    top = keys.agg(F.max(F.struct("o", "h")).alias("t")).select("t.*")
    return sorted({(r["o"], r["h"]) for r in chosen.unionByName(top).collect()})


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document with the text and digests of the next one in descending doc_id (null last), after the last: the first.

    Equal ids follow in descending order of their text's hash.  Bounds that
    exist as (id, hash) cut the order into ranges, so that neither null nor
    repeated ids make a large one; the rows at a bound are also sent, as
    followers only, to the range above it.
    """
    text = F.coalesce("text", F.lit(""))
    order, hashed = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), F.xxhash64(text)
    bounds = _bounds(docs.select(order.alias("o"), hashed.alias("h")))
    kind, step = "array<struct<o:bigint,h:bigint>>", 128

    def listed(part: list[tuple[int, int]]) -> Column:  # one literal, however many bounds there are
        return F.from_json(F.lit(json.dumps([{"o": o, "h": h} for o, h in part])), kind)

    coarse, fine = listed(bounds[step - 1 :: step]), listed(bounds)
    block = F.size(F.filter(coarse, lambda q: q < F.col("_key"))) * step
    at = block + F.size(F.filter(F.slice(fine, block + 1, step), lambda q: q < F.col("_key")))
    above = F.when(F.col("_at") + 1 < len(bounds), F.col("_at") + 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(order.alias("o"), hashed.alias("h")).alias("_key"), text.alias("text"), digests(text).alias("own"))
    rows = rows.withColumn("_at", at.cast("int")).withColumn("_bound", F.element_at(fine, F.col("_at") + 1) == F.col("_key"))
    sent = F.array_compact(F.array(F.struct(F.col("_at").alias("range"), F.lit(0).alias("follower")), F.when(F.col("_bound"), F.struct(above.alias("range"), F.lit(1).alias("follower")))))
    rows = rows.withColumn("_to", F.explode(sent)).select(F.struct("doc_id", "text", "own").alias("d"), "_key", "_to.range", "_to.follower")
    w = Window.partitionBy("range").orderBy("follower", F.desc("_key"), F.desc("d.text"))
    # one column, read whole by the window: all that is derived from it shares one exchange
    rows = rows.repartition(len(bounds), "range").withColumns({"row": F.row_number().over(w), "n": F.lead("d").over(w)})
    return rows.where("follower = 0").select("range", "row", "d.doc_id", "d.text", "d.own", F.col("n.text").alias("next_text"), F.col("n.own").alias("next"))


def versions(docs: DataFrame) -> DataFrame:
    """Documents with the text and digests of their edited version."""
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", (F.char_length("text") - half)), F.left("next_text", half))
    return neighbours(docs).select(*_AT, "doc_id", n.alias("n_chars"), edited.alias("edited_text"), "own", "next").withColumn("edited", digests(F.col("edited_text")))


def sketches(v: DataFrame, texts: list[str], cells: int, seed: int = 0) -> DataFrame:
    """(range, row, kind, cell, n, d, c): the cells in use of the sketch of each of some columns of digests; kind is the column's number."""

    def entry(kind: int):
        return lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("d"))

    rows = v.select(*_AT, F.inline(F.concat(*(F.transform(t, entry(k)) for k, t in enumerate(texts)))))
    rows = rows.select(*_AT, "kind", "d", F.explode(F.array(*(place(F.col("d"), t, F.lit(cells), seed) for t in range(_TABLES)))).alias("cell"))
    return rows.groupBy(*_AT, "kind", "cell").agg(F.count("*").cast("int").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor(check(F.col("d"))).alias("c"))


def fingerprints(v: DataFrame) -> DataFrame:
    """(range, row, fingerprint, edited_fingerprint): the sketches of 3 x CELLS cells as cell:count:digests:checks of the cells in use."""
    lists = sketches(v, ["own", "edited"], CELLS).groupBy(*_AT).agg(F.collect_list(F.struct("kind", "cell", "n", "d", "c")).alias("cells"))

    def text(kind: int) -> Column:
        own = F.array_sort(F.filter("cells", lambda c: c["kind"] == kind))
        return F.concat_ws(",", F.transform(own, lambda c: F.concat_ws(":", c["cell"].cast("string"), c["n"].cast("string"), F.lower(F.hex(c["d"])), F.lower(F.hex(c["c"])))))

    return lists.select(*_AT, text(0).alias("fingerprint"), text(1).alias("edited_fingerprint"))


def subtracted(cells: DataFrame) -> DataFrame:
    """(range, row, pair, cell, n, d, c): the sketch of kind 0 less that of kind 1 (pair 0) and less that of kind 2 (pair 1)."""
    first = F.array(*(F.struct(F.lit(p).alias("pair"), F.col("n").alias("m")) for p in (0, 1)))
    other = F.array(F.struct((F.col("kind") - 1).alias("pair"), (-F.col("n")).alias("m")))
    both = cells.select(*_AT, "cell", "d", "c", F.inline(F.when(F.col("kind") == 0, first).otherwise(other)))
    return _summed(both.withColumnRenamed("m", "n"), [*_AT, "pair"])


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c")).where("n <> 0 or d <> 0 or c <> 0")


def peeled(difference: DataFrame, cells: int, seed: int = 0, keep: bool = False) -> DataFrame:
    """(range, row, found0, stuck0, found1, stuck1) of the pairs of subtracted(): pieces recovered and cells left over; keep adds the pieces as differs0 and differs1.

    A cell holds one digest if its count is 1 or -1, its check is that of its
    XOR, and the digest's place is that cell.
    """
    keys = [*_AT, "pair", *(["piece"] if keep else [])]
    none = [F.lit(None).cast("long").alias("piece")] if keep else []
    rows = difference.select("*", *none)
    d, n, c = F.col("d"), F.col("n"), F.col("c")
    for turn in range(_TABLES * PASSES):
        t = turn % _TABLES
        pure = (F.col("cell") >= t * cells) & (F.col("cell") < (t + 1) * cells) & (F.abs(n) == 1) & (check(d) == c) & (place(d, t, F.lit(cells), seed) == F.col("cell"))
        # a recovered digest leaves its other cells and is counted in cell -1, with keep in a row of its own
        away = [F.struct(place(d, o, F.lit(cells), seed).alias("cell"), (-n).alias("n"), d.alias("d"), c.alias("c"), *none) for o in range(_TABLES) if o != t]
        zero = F.lit(0).cast("long")
        done = F.struct(F.lit(-1).alias("cell"), (n if keep else F.lit(1)).alias("n"), zero.alias("d"), zero.alias("c"), *([d.alias("piece")] if keep else []))
        stay = F.struct("cell", n.alias("n"), d.alias("d"), c.alias("c"), *(["piece"] if keep else []))
        rows = _summed(rows.select(*_AT, "pair", F.inline(F.when(pure, F.array(*away, done)).otherwise(F.array(stay)))), keys)
    out = []
    for p in (0, 1):
        mine, recovered = F.col("pair") == p, F.col("cell") < 0
        out.append(F.sum(F.when(mine & recovered, F.lit(1) if keep else n).otherwise(0)).alias(f"found{p}"))
        out.append(F.count_if(mine & ~recovered).alias(f"stuck{p}"))
        if keep:
            out.append(F.collect_list(F.when(mine & recovered, F.struct(F.col("piece").alias("digest"), n.alias("sign")))).alias(f"differs{p}"))
    return rows.groupBy(*_AT).agg(*out)


def fingerprint_documents(docs: DataFrame, with_digests: bool = False) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many, or all, of the next document.  The document's fingerprint less the
    other one is peeled; where that gets stuck, larger sketches are.  Likeness is
    one less the share of pieces found to differ, 1 for two texts without pieces.
    Null texts are empty.  Very long texts have more pieces, and larger sketches
    where they differ in many.  Repeated rows are neighbours of each other and
    come back each; rows equal in doc_id and text are in one range, however many.
    Extra columns are ignored; an empty table gives an empty result.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next; with_digests adds edited_differs and next_differs,
    the recovered digests with sign 1 for the document's own pieces and -1 for
    the other's.
    """
    sets = ["own", "edited", "next"]
    names = [f"{c}{p}" for p in (0, 1) for c in ("found", "stuck", *(["differs"] if with_digests else []))]
    # from here on digests stand for the texts
    v = versions(docs).withColumn("edited_sha256", F.sha2(F.encode("edited_text", "UTF-8"), 256))
    v = materialise(v.select(*_AT, "doc_id", "n_chars", "edited_sha256", *sets), "versions", compression="zstd")
    prints = materialise(fingerprints(v.select(*_AT, "own", "edited").repartition(*_AT)), "fingerprints", compression="zstd")
    stuck = F.coalesce(F.greatest("stuck0", "stuck1"), F.lit(0)) > 0
    left, cells, attempt, every = v.select(*_AT, *sets), CELLS, 0, None
    while attempt == 0 or left.limit(1).count():
        dealt = left.repartition(*_AT)
        with joined_in_place(docs.sparkSession):
            again = dealt.join(peeled(subtracted(sketches(dealt, sets, cells, attempt)), cells, attempt, with_digests), _AT, "left")
            now = materialise(again.select(*_AT, *names, *(F.when(stuck, F.col(c)).alias(c) for c in sets)), f"attempt{attempt}", compression="zstd")
        done, left = now.where(~stuck).select(*_AT, *names), now.where(stuck).select(*_AT, *sets)
        every = done if every is None else every.unionByName(done)
        cells, attempt = cells * GROWTH, attempt + 1
    both = F.size("own") + F.size("edited"), F.size("own") + F.size("next")
    facts = v.select(*_AT, "doc_id", "n_chars", "edited_sha256", *(b.alias(f"both{i}") for i, b in enumerate(both)), F.size("own").alias("pieces"), F.size("edited").alias("edited_pieces"))
    out = facts.join(prints, _AT, "left").join(every, _AT)

    def near(p: int) -> Column:
        return F.when(F.col(f"both{p}") == 0, F.lit(1.0)).otherwise(1 - F.coalesce(f"found{p}", F.lit(0)) / F.col(f"both{p}"))

    def named(pieces: str, cells: str) -> Column:
        return F.concat(F.col(pieces).cast("string"), F.lit("|"), F.coalesce(cells, F.lit("")))

    differs = [F.array_sort(F.coalesce(f"differs{p}", F.array().cast("array<struct<digest:bigint,sign:int>>"))).alias(c) for p, c in enumerate(("edited_differs", "next_differs"))] if with_digests else []
    return out.select("doc_id", "n_chars", "edited_sha256", named("pieces", "fingerprint").alias("fingerprint"), named("edited_pieces", "edited_fingerprint").alias("edited_fingerprint"), near(0).alias("near_edited"), near(1).alias("near_next"), *differs)
