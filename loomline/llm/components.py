"""Connected components of a graph given as edges, by alternating large and small stars.

Each round hangs neighbours under the smallest node they know.  Nothing is
collected: the tables of a round lie in the shared folder, and only a count and
a checksum reach the driver.  Minima combine before they are shuffled, and they
are joined back from a table, so a hub's edges can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise


def _hang(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) with the smallest v of each u, at most u itself, as m; and the table that this reads."""
    least = materialise(edges.groupBy(F.col("u").alias("_u")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m"), least


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, root) for every node of the edges (a, b) but the roots; root is the smallest node of v's component.

    The tables of a round are deleted when the next no longer reads them.  The
    rounds needed grow with the logarithm of the nodes; if 60 don't settle the
    components, which no graph that fits a disk needs, it raises.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung, least = _hang(both)
        large = materialise(hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(e, least)
        hung, least = _hang(large)
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        e = materialise(small.distinct(), "small")
        discard(large, least)
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
