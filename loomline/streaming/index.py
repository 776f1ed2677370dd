"""Counts of files kept up to date: what a changed file added is taken back and added anew, and no other file is read.

The index is one keyed table.  A row of kind ``file`` holds a file's time, size
and counts by key as they were last read; one of kind ``total`` the sum of a key
over all files.  Both change in one upsert, so a step that fails leaves the
index as it was, and the next one does its work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sinks import keyed
from loomline.sources import files
from loomline.streaming import ingest

SCHEMA = "kind string, name string, mtime long, size long, counts map<string,bigint>"
_KEYS = ["kind", "name"]


def known(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size) of the files in the index."""
    return keyed.current(spark, root, SCHEMA).where("kind = 'file'").select(F.col("name").alias("path"), "mtime", "size")


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(key, n) over all files; keys that no file counts any more are gone."""
    return keyed.current(spark, root, SCHEMA).where("kind = 'total'").select(F.col("name").alias("key"), F.col("counts")[""].alias("n"))


def by_file(spark: SparkSession, root: str) -> DataFrame:
    """(path, key, n) as files were last read."""
    return keyed.current(spark, root, SCHEMA).where("kind = 'file'").select(F.col("name").alias("path"), F.explode("counts").alias("key", "n"))


def refresh(spark: SparkSession, root: str, listing: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> tuple[int, int]:
    """Bring the index at ``root`` to a listing (path, mtime, size); how many files were read, and how many went.

    ``measure`` gets the changed files (path, size) and returns (path, key, n), any
    number of rows a key; null keys and zeros don't count.  A file's counts are
    one row of the index: files are bounded, as they are rotated.
    """
    state, step = known(spark, root), f"{root}/_step-{uuid.uuid4().hex}"
    changed = ingest.changed_files(listing.select("path", "mtime", "size"), state)
    changed.write.parquet(f"{step}/changed")
    changed = spark.read.schema("path string, mtime long, size long").parquet(f"{step}/changed")
    gone = ingest.gone_files(state, listing).select("path")
    gone.write.parquet(f"{step}/gone")
    gone = spark.read.schema("path string").parquet(f"{step}/gone")
    read, went = changed.count(), gone.count()
    if read or went:
        # files are read once: what is added to the totals is what their rows say
        new = measure(changed.select("path", "size")).where("key is not null").groupBy("path", "key").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")
        new.write.parquet(f"{step}/new")
        new = spark.read.schema("path string, key string, n long").parquet(f"{step}/new")
        touched = changed.select("path").unionByName(gone).select(F.lit("file").alias("kind"), F.col("path").alias("name"))
        old = keyed.lookup(spark, root, SCHEMA, touched).select(F.explode("counts").alias("key", "n"))
        moved = new.select("key", "n").unionByName(old.select("key", (-F.col("n")).alias("n"))).groupBy("key").agg(F.sum("n").alias("d")).where("d <> 0")
        moved.write.parquet(f"{step}/moved")
        moved = spark.read.schema("key string, d long").parquet(f"{step}/moved")
        held = keyed.lookup(spark, root, SCHEMA, moved.select(F.lit("total").alias("kind"), F.col("key").alias("name")))
        held = held.select(F.col("name").alias("key"), F.col("counts")[""].alias("n"))
        n = F.coalesce("n", F.lit(0)) + F.col("d")
        none = F.lit(None).cast("long")
        sums = moved.join(held, "key", "left").select(F.lit("total").alias("kind"), F.col("key").alias("name"), none.alias("mtime"), none.alias("size"), F.create_map(F.lit(""), n).alias("counts"), (n == 0).alias("_out"))
        each = new.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("counts"))
        now = changed.join(each, "path", "left").select(F.lit("file").alias("kind"), F.col("path").alias("name"), "mtime", "size", F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"), F.lit(False).alias("_out"))
        out = gone.select(F.lit("file").alias("kind"), F.col("path").alias("name"), none.alias("mtime"), none.alias("size"), F.lit(None).cast("map<string,bigint>").alias("counts"), F.lit(True).alias("_out"))
        rows = sums.unionByName(now).unionByName(out)
        rows.write.parquet(f"{step}/rows")
        rows = spark.read.schema(f"{SCHEMA}, _out boolean").parquet(f"{step}/rows")
        keyed.replace(spark, root, rows, _KEYS, "_out")
    files.remove(step)
    return read, went
