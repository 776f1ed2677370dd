"""Keyed tables merged on read: upserts and deletions are written beside what is there, by buckets of keys.

A table is a folder of parts and a small file that names the parts in force.
A part holds rows by bucket, a hash of the key.  An upsert writes one part with
the buckets of its own rows; nothing else is read or written.  Readers take the
latest row of each key, and only buckets that several parts hold need a shuffle.
A bucket that too many parts hold is merged into one, by itself.

One writer at a time; readers see the table before an upsert or after it.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.text import latest
from loomline.sources import files

#: Buckets of a new table, and parts that a bucket may lie in before it is merged.
BUCKETS, MOST_PARTS = 64, 8
_BUCKET, _GONE, _AT = "_bucket", "_gone", "_at"


def _manifest(root: str) -> dict | None:
    try:
        return json.loads(b"".join(files.read_from(f"{root}/_current", 0)))
    except FileNotFoundError:
        return None


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _schema(columns: list) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)


def _read(spark: SparkSession, root: str, schema: str, table: dict, wanted: set[int] | None = None) -> DataFrame:
    """The rows in force of some buckets, with their bucket."""
    held: dict[int, int] = {}
    for part in table["parts"]:
        for b in part["buckets"]:
            held[b] = held.get(b, 0) + 1
    wanted = set(held) if wanted is None else wanted & set(held)
    single = {b for b in wanted if held[b] == 1}

    def parts(buckets: set[int]) -> list[DataFrame]:
        out = []
        for part in table["parts"]:
            mine = sorted(buckets & set(part["buckets"]))
            if mine:
                rows = spark.read.schema(f"{schema}, {_GONE} boolean, {_BUCKET} int").parquet(f"{root}/{part['path']}")
                out.append(rows.where(F.col(_BUCKET).isin(mine)).withColumn(_AT, F.lit(part["at"])))
        return out

    found = parts(single)
    several = parts(wanted - single)
    if several:
        w = Window.partitionBy(_BUCKET, *table["keys"]).orderBy(F.desc(_AT))
        merged = functools.reduce(DataFrame.unionByName, several).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
        found.append(merged)
    if not found:
        return spark.createDataFrame([], f"{schema}, {_BUCKET} int")
    return functools.reduce(DataFrame.unionByName, found).where(f"not {_GONE}").drop(_GONE, _AT)


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """A keyed table as it was last upserted; empty where there is none."""
    table = _manifest(root)
    return spark.createDataFrame([], schema) if table is None else _read(spark, root, schema, table).drop(_BUCKET)


def _write(rows: DataFrame, root: str, at: int) -> dict:
    """A part of rows that have their bucket."""
    path = f"p-{at}-{uuid.uuid4().hex}"
    rows.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/{path}")
    names = files.folders(f"{root}/{path}")
    return {"path": path, "at": at, "buckets": sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{_BUCKET}="))}


def _changed(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], schema: str, buckets: int) -> DataFrame:
    table = _manifest(root) or {"keys": keys, "buckets": buckets, "parts": [], "retired": [], "next": 0}
    if table["keys"] != keys:
        raise ValueError(f"the table's keys are {table['keys']}")
    part = _write(rows.withColumn(_BUCKET, _bucket(keys, table["buckets"])), root, table["next"])
    table["next"] += 1
    if part["buckets"]:
        table["parts"].append(part)
    held = [b for p in table["parts"] for b in p["buckets"]]
    full = {b for b in part["buckets"] if held.count(b) > MOST_PARTS}
    if full:
        merged = _write(_read(spark, root, schema, table, full).withColumn(_GONE, F.lit(False)), root, table["next"])
        table["next"] += 1
        for p in table["parts"]:
            p["buckets"] = [b for b in p["buckets"] if b not in full]
        out = [p["path"] for p in table["parts"] if not p["buckets"]]
        table["parts"] = [p for p in table["parts"] if p["buckets"]] + [merged] * bool(merged["buckets"])
        old, table["retired"] = table["retired"], out  # readers may still be on what goes out of force now
    else:
        old = []
    files.write_whole(f"{root}/_current", json.dumps(table).encode(), uuid.uuid4().hex)
    for path in old:
        files.remove(f"{root}/{path}")
    return current(spark, root, schema)


def upsert(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Insert rows, or overwrite those of the same key; of several new rows of a key the last by ``order`` counts.

    Null keys are keys.  ``buckets`` is that of a new table: choose so many that
    one can be merged by a few tasks.
    """
    new = latest(rows, keys, order) if order else rows.dropDuplicates(keys)
    return _changed(spark, root, new.withColumn(_GONE, F.lit(False)), keys, _schema(rows.schema.fields), buckets)


def replace(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], gone: str, buckets: int = BUCKETS) -> DataFrame:
    """Upsert rows and take out those whose boolean column ``gone`` holds, at once: readers see all of it or nothing.  Keys must differ."""
    return _changed(spark, root, rows.withColumnRenamed(gone, _GONE), keys, _schema([f for f in rows.schema.fields if f.name != gone]), buckets)


def lookup(spark: SparkSession, root: str, schema: str, wanted: DataFrame) -> DataFrame:
    """The rows in force of some keys, none of them null; wanted has the key columns.  No other buckets than theirs are read."""
    table = _manifest(root)
    if table is None:
        return spark.createDataFrame([], schema)
    keys = wanted.select(*table["keys"])
    mine = {r[0] for r in keys.select(_bucket(table["keys"], table["buckets"])).distinct().collect()}  # as many as buckets at most
    return _read(spark, root, schema, table, mine).drop(_BUCKET).join(keys.distinct(), table["keys"], "left_semi")


def delete(spark: SparkSession, root: str, gone: DataFrame, schema: str) -> DataFrame:
    """Take the rows of some keys out; gone has the key columns."""
    table = _manifest(root)
    if table is None:
        return spark.createDataFrame([], schema)
    like = spark.createDataFrame([], schema)
    marks = gone.select(*table["keys"]).dropDuplicates()
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name not in table["keys"]]
    return _changed(spark, root, marks.select(*table["keys"], *rest).select(*like.columns, F.lit(True).alias(_GONE)), table["keys"], schema, table["buckets"])
