"""Catalog and host-metric analytics."""

from __future__ import annotations

import base64
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def host_series(metrics: DataFrame, part: Column, total: Column, points: int = 60) -> DataFrame:
    """The last points of each host with ``part`` as a percentage of ``total``; points without a total, and hosts left with one point, go."""
    known = metrics.withColumn("pct", F.when(total > 0, 100.0 * part / total)).where(F.col("pct").isNotNull())
    w = Window.partitionBy("host").orderBy(F.desc("ts"), F.desc("id"))
    last = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= points)
    n = F.count("*").over(Window.partitionBy("host"))
    return last.withColumn("_c", n).where("_c >= 2").drop("_n", "_c")


def fleet(metrics: DataFrame) -> DataFrame:
    """Hosts, projects, the latest snapshot and the processors of all hosts by their latest snapshots."""
    each = metrics.groupBy("host").agg(F.max_by("cpus", F.struct("ts", "id")).alias("cpus"), F.max(F.struct("ts", "id")).alias("last"))
    projects = metrics.agg(F.count_distinct("project")).first()[0]  # a number
    return each.agg(F.count("host").alias("hosts"), F.lit(projects).cast("long").alias("projects"), F.max("last")["id"].alias("latest"), F.coalesce(F.sum("cpus"), F.lit(0)).cast("long").alias("cpus"))


def latest_per_host(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("host").agg(F.max_by(F.struct("id", "ts", "value"), F.struct("ts", "id")).alias("m")).select("host", "m.*")


def _tenths(x: Column) -> Column:
    """x in tenths, rounded as the exact value of the binary number lies, a half up.

    A tenth and a half is never a double, so x is compared with it by 20 x =
    16 x + 4 x, the error of that sum added back.
    """
    low = F.floor(x * 10)
    a, b = x * 16, x * 4
    total = a + b
    part = total - a
    error = (a - (total - part)) + (b - part)
    return low + F.when((total - (2 * low + 1)) + error >= 0, 1).otherwise(0)


def format_bytes(n: Column) -> Column:
    """Decimal units, one digit after the point above bytes; a dash for null."""
    size = F.abs(n)
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB", "EB"), 1):
        tenths = _tenths(size / 1000.0**k)
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= 1000.0**k, shown).otherwise(out)
    return F.when(n.isNull(), "\u2014").when(n < 0, F.concat(F.lit("-"), out)).otherwise(out)


def decode_cursor(cursor: str | None) -> int:
    try:
        return max(0, int(base64.urlsafe_b64decode((cursor or "").encode()).decode()))
    except ValueError:
        return 0


def encode_cursor(at: int) -> str:
    return base64.urlsafe_b64encode(str(at).encode()).decode()


def paginate(rows: DataFrame, order: list[Column], cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """A page in a total order with next_cursor (null on the last page), has_more and the total; 25 rows by default, 100 at most."""
    limit = max(1, min(100, limit or 25))
    at, total = decode_cursor(cursor), rows.count()
    more = at + limit < total
    page = rows.orderBy(*order).offset(at).limit(limit)
    return page.select("*", F.lit(encode_cursor(at + limit) if more else None).cast("string").alias("next_cursor"), F.lit(more).alias("has_more"), F.lit(total).cast("long").alias("total"))


def pages(rows: DataFrame, order: list[Column], limit: int | None = None) -> Iterator[DataFrame]:
    """All pages, cursor by cursor, until there is no next."""
    cursor, limit = None, max(1, min(100, limit or 25))
    total = rows.count()
    for at in range(0, total, limit):
        yield paginate(rows, order, cursor, limit)
        cursor = encode_cursor(at + limit)


def index_order(rows: DataFrame, order: list[Column], root: str, parts: int = 256) -> None:
    """Write rows in a total order to ``root``, in ranges, with the number of rows before each.

    A page then reads its own rows, and nothing is counted or sorted again.  The
    order should tell all rows apart; equal ones keep the place they get here.
    The index of ranges has a row for each, ``parts`` at most.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.select(F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at"), "*").write.partitionBy("_range").parquet(f"{root}/rows")
    sizes = spark.read.schema("_at long, _range int").parquet(f"{root}/rows").groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes.select("n", "first", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(f"{root}/ranges")


def indexed_page(spark: SparkSession, root: str, schema: str, cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """What paginate() gives of rows that index_order() wrote; schema is theirs.

    Rows of a range are numbered in its order, so the page is a filter on the
    range's folder and the number, which the scan skips by.
    """
    limit = max(1, min(100, limit or 25))
    at = decode_cursor(cursor)
    ranges = spark.read.schema("n long, first long, _range int, before long").parquet(f"{root}/ranges").collect()  # a row for each range
    total, mine = sum(r["n"] for r in ranges), F.lit(False)
    for r in ranges:
        low, high = max(at - r["before"], 0), min(at + limit - r["before"], r["n"])
        if low < high:
            mine |= (F.col("_range") == r["_range"]) & F.col("_at").between(r["first"] + low, r["first"] + high - 1)
    rows = spark.read.schema(f"{schema}, _at long, _range int").parquet(f"{root}/rows").where(mine)
    more = at + limit < total
    page = rows.orderBy("_range", "_at").drop("_range", "_at")
    return page.select("*", F.lit(encode_cursor(at + limit) if more else None).cast("string").alias("next_cursor"), F.lit(more).alias("has_more"), F.lit(total).cast("long").alias("total"))


def active_products(products: DataFrame) -> DataFrame:
    """Products that are not revoked, without their key's hash."""
    return products.where(~F.coalesce("revoked", F.lit(False))).drop("api_key_hash", "api_key")


def registry_entry(registry: DataFrame, name: str) -> DataFrame:
    """Versions of a dataset or model, newest first; an unknown name raises."""
    found = registry.where(F.col("name") == name).orderBy(F.desc("version"))
    if not found.limit(1).count():
        raise LookupError(name)
    return found


def first_shard(shards: DataFrame) -> DataFrame:
    """The first shard of each journey by path, whatever the layout of its folder."""
    return shards.groupBy("journey_id").agg(F.min_by(F.struct(*[c for c in shards.columns if c != "journey_id"]), "path").alias("s")).select("journey_id", "s.*")


def created(products: DataFrame) -> DataFrame:
    """Products (slug, name, api_key) as they are stored: the key's digest instead of the key; of equal slugs one."""
    return products.select("slug", "name", F.sha2("api_key", 256).alias("api_key_hash"), F.lit(False).alias("revoked")).dropDuplicates(["slug"])


def revoked(products: DataFrame, which: Column) -> DataFrame:
    return products.withColumn("revoked", F.col("revoked") | F.coalesce(which, F.lit(False)))


def rotated(products: DataFrame, which: Column, key: Column) -> DataFrame:
    """Products with a new key where asked; the old one is no longer good."""
    return products.withColumn("api_key_hash", F.when(F.coalesce(which, F.lit(False)), F.sha2(key, 256)).otherwise(F.col("api_key_hash")))


def authorised(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Requests (api_key, ...) with the slug of the product whose key they bring; revoked products and unknown keys let nothing in."""
    good = products.where(~F.coalesce("revoked", F.lit(False))).select(F.col("api_key_hash").alias("_h"), "slug")
    return requests.join(good, F.sha2("api_key", 256) == F.col("_h")).drop("_h", "api_key")
