"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows hash onto a ring of fixed resolution; each shard owns the arcs that end at
its virtual nodes (clockwise).  A shard takes the keys of its own arcs first, in
ring order, up to its capacity.  Keys beyond that continue clockwise to the next
virtual node whose shard has room.  So only keys of overfull shards move.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import materialise

#: Ring resolution in bits.  The plan has a row for each cell, or a few: its size is bounded by this alone.
CELL_BITS = 13
VIRTUAL_NODES = 128
#: Rows of a cell that are ranked at a time.
HOT = 1_000_000


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the virtual nodes.  Nodes of a shard don't depend on how many shards there are."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") >> (64 - CELL_BITS)
            points.setdefault(cell, shard)
    return sorted(points.items())


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Without slack, shares at most one apart that add up to total; with slack, each up to (1 + slack) of the mean."""
    if slack > 0:
        return [-(-int(total * (1 + slack)) // n_shards) + 1] * n_shards
    return [total // n_shards + (i < total % n_shards) for i in range(n_shards)]


def plan(counts: dict[int, int], n_shards: int, slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, home, first rank, end rank, shard, slot of the first) for each run of rows of a cell that go to one shard."""
    points = ring(n_shards, virtual_nodes)
    at = [cell for cell, _ in points]
    room = capacities(sum(counts.values()), n_shards, slack)
    runs, left, used = [], [], [0] * n_shards
    for cell in sorted(counts):
        node = bisect.bisect_left(at, cell) % len(points)
        home = points[node][1]
        take = min(counts[cell], room[home] - used[home])
        if take:
            runs.append((cell, home, 0, take, home, used[home]))
            used[home] += take
        if take < counts[cell]:
            left.append((cell, home, take, node))
    for cell, home, rank, node in left:
        while rank < counts[cell]:
            shard = points[node][1]
            take = min(counts[cell] - rank, room[shard] - used[shard])
            if take:
                runs.append((cell, home, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
            node = (node + 1) % len(points)
    return runs


def _ranked_by_range(work: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Rows with _rank, their place from 0 in their _cell, without a task that has a whole cell.

    Rows are cut into ranges of cell and order, equal ones by a number that they
    get once, so that a task that runs again deals them alike.
    """
    numbered = materialise(work.withColumn("_salt", F.monotonically_increasing_id()), "hot")
    cut = numbered.repartitionByRange(parts, "_cell", *order, "_salt").sortWithinPartitions("_cell", *order, "_salt")
    cut = materialise(cut.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(F.col("_cell").alias("_c0"), F.col("_range").alias("_p0")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n0"))  # a row for each range and cell that meet
    before = Window.partitionBy("_c0").orderBy("_p0").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n0").over(before), F.lit(0)))
    both = cut.join(sizes, (F.col("_cell") == F.col("_c0")) & (F.col("_range") == F.col("_p0")))
    return both.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_c0", "_p0", "_first", "_n0", "_before")


def shard_rows(rows: DataFrame, n_shards: int = 8, key: str = "doc_id", tie: str | None = None, slack: float = 0.0) -> DataFrame:
    """Add home_shard, shard and slot (gapless from 0 in each shard) to rows, in the place of columns of these names.

    Rows hash by ``key``; rows of one cell are ranked by the hash, the key and
    ``tie``, so rows that differ in none of these are interchangeable.  A null
    key is a key like any other.  Without slack, shard sizes are at most one
    apart.  An empty table stays empty.

    The counts of cells that reach the driver are bounded by the ring's
    resolution, as is the plan that comes back as a join.  Cells of more than
    HOT rows are ranked in ranges of about as many, by the same order: where a
    row goes depends neither on that bound nor on how the input is split.
    """
    spark = rows.sparkSession
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    new = ("home_shard", "shard", "slot")
    place = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null")))
    cell = F.shiftrightunsigned(place, 64 - CELL_BITS).cast("int")
    work = rows.select(F.struct(*(c for c in rows.columns if c not in new)).alias("_row"), place.alias("_place"), cell.alias("_cell"), F.col(key).alias("_key"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"))
    counts = {r["_cell"]: r["n"] for r in work.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    hot = sorted(c for c, n in counts.items() if n > HOT)
    runs = plan(counts, n_shards, slack)
    moves = spark.createDataFrame(runs or [(0, 0, 0, 0, 0, 0)], "_c int, home_shard int, _from long, _to long, shard int, _slot long")
    order = ["_place", "_key", "_tie"]
    cold = work.where(~F.col("_cell").isin(hot)) if hot else work
    ranked = cold.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1)
    if hot:
        ranked = ranked.unionByName(_ranked_by_range(work.where(F.col("_cell").isin(hot)), order, -(-sum(counts[c] for c in hot) // HOT)))
    placed = ranked.join(F.broadcast(moves), (F.col("_cell") == F.col("_c")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select("_row.*", "home_shard", "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shard documents by doc_id under the law ``rows``: shard counts at most one apart.

    Returns doc_id, size (UTF-8 bytes plus 1, null text: 1), text_crc32 (null
    text: that of the empty string), law, shard, slot, grown_shard (null under
    this law) and home_shard, the shard that owns the key's arc of the ring.
    Extra columns of docs are ignored.  Texts, however long, are read once and
    never moved.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    slim = materialise(slim, "shard_keys")
    out = shard_rows(slim, n_shards, "doc_id", "text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def deal_out(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Documents with all their columns and home_shard, shard and slot, under the law of shard_documents().

    Rows move once, to the cell in which they are ranked.  Null and empty texts,
    long ones and repeated rows go to shards like any other; columns of the three
    names are replaced.  An empty table stays empty.
    """
    new = ("home_shard", "shard", "slot")
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*kept).alias("_doc"), F.col("doc_id").alias("_id"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"))
    return shard_rows(rows, n_shards, "_id", "_crc").select("_doc.*", *new)
