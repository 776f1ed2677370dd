"""Folders of the domain: spools, collectors, object stores, registries, reports, raw provider exports."""

from __future__ import annotations

import functools
import itertools
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.text import latest
from loomline.sources import arrays, files, wire

_DATE = r"\d{4}-\d{2}-\d{2}"


def _is_date(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{_DATE}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "file://" + tempfile.gettempdir()).rstrip("/")


def spool(spark: SparkSession, root: str) -> DataFrame:
    """Lines of journeys/<id>/<date>.<n>.jsonl with journey, date and shard; a journey's shards follow each other by date and number."""
    rows = wire.lines(spark, f"{root}/journeys", glob="*.jsonl")
    name = F.regexp_extract("path", r"/journeys/([^/]+)/[^/]+$", 1)
    shard = F.regexp_extract("path", rf"/({_DATE})\.(\d+)\.jsonl$", 2)
    return rows.select("*", name.alias("journey"), F.regexp_extract("path", rf"/({_DATE})\.\d+\.jsonl$", 1).alias("date"), F.when(shard != "", shard.cast("int")).alias("shard")).where("shard is not null")


def spool_events(spark: SparkSession, root: str) -> DataFrame:
    """Sound events of a spool as the fold reads them, in the order of shards."""
    rows = spool(spark, root)
    order = rows.select("path", "date", "shard").distinct()
    found = wire.flat(wire.events(rows))
    out = found.withColumn("_path", F.col("arrival.path")).join(order.withColumnRenamed("path", "_path"), "_path")
    return out.withColumn("arrival", F.struct("date", "shard", F.col("arrival.line_no").alias("line_no"))).drop("_path", "date", "shard")


def collector_files(found: DataFrame) -> DataFrame:
    """Paths of <root>/<date>/<stem>.jsonl and <root>/<product>/<date>/<stem>.jsonl with date, product and stem; metrics/ is no product."""
    parts = F.split("path", "/")
    date, product = F.element_at(parts, -2), F.element_at(parts, -3)
    rest = found.withColumns({"date": date, "stem": F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""), "_above": product})
    return rest.where(_is_date(F.col("date")) & (F.col("_above") != "metrics"))


def collector(spark: SparkSession, root: str) -> DataFrame:
    """Lines of a collector's folder, flat or by product; product is null in the flat layout."""
    rows = collector_files(wire.lines(spark, root, glob="*.jsonl"))
    base = root.rstrip("/").rpartition("/")[2]
    return rows.withColumn("product", F.when(F.col("_above") != base, F.col("_above"))).drop("_above")


def objects(spark: SparkSession, uri: str) -> DataFrame:
    """Lines of all *.jsonl objects under a URI of any store (s3a://, abfss://, ...); one that isn't UTF-8 is refused, and the sweep goes on."""
    return wire.lines(spark, uri, glob="*.jsonl")


def listing(spark: SparkSession, uri: str, suffix: str = ".jsonl", levels: int = 64) -> DataFrame:
    """(path, size) of all files under a URI by suffix, listed a level of folders at a time, each folder in a task.

    Levels are written to the shared folder as they are found, so neither
    folders nor files pass through the driver.
    """

    def run(batches):
        for batch in batches:
            for at in batch.column("path").to_pylist():
                found = files.listed(at, suffix)
                while some := list(itertools.islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some]), pa.array([n for _, n in some], pa.int64())], ["path", "size"])

    root, out = f"{shared(spark)}/loomline-{uuid.uuid4().hex}", []
    at = spark.createDataFrame([(uri,)], "path string")
    for level in range(levels):
        at.mapInArrow(run, "path string, size long").write.parquet(f"{root}/{level}")
        found = spark.read.schema("path string, size long").parquet(f"{root}/{level}")
        out.append(found.where("size >= 0"))
        at = found.where("size < 0").select("path").repartition(spark.sparkContext.defaultParallelism)
        if not at.limit(1).count():
            return functools.reduce(DataFrame.unionByName, out)
    raise ValueError(f"folders lie more than {levels} levels deep")


def sweep(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame]:
    """Lines of all *.jsonl objects under a URI that can be read, and (path, error) of each that can't.

    An object that can't be opened, isn't UTF-8, is empty or has no good header
    is a row of the second and has none in the first; the rest is read by ranges.
    """
    rows = wire.swept(listing(spark, uri))
    return rows.where("refused is null"), rows.where("line_no = 1 and refused is not null").select("path", F.col("refused").alias("error"))


def journey_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, document): whole *.json files."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return rows.select(name.alias("path"), F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.json$", "").alias("stem"), F.col("value").alias("document"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(path, ts, snapshot) of host metrics, an object a line, newest first; blank and malformed lines go."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*json*").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), "value").where((F.trim("value") != "") & F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull())
    return rows.select("path", F.get_json_object("value", "$.ts").alias("ts"), F.col("value").alias("snapshot")).orderBy(F.desc_nulls_last("ts"), "path", "snapshot")


def keyed(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Objects of a JSONL file by a key; of several with one key the last line wins, and malformed lines go."""
    rows = wire._listed(spark, path, None).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line_no", "line")).where((F.trim("line") != "") & F.try_parse_json("line").isNotNull())
    parsed = rows.select(F.from_json("line", schema).alias("o"), F.struct("path", "line_no").alias("_at")).select("o.*", "_at").where(F.col(key).isNotNull())
    return latest(parsed, [key], "_at").drop("_at")


def completions(spark: SparkSession, path: str) -> DataFrame:
    return keyed(spark, path, "id", "id string, response string")


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return keyed(spark, path, "journey_id", "journey_id string, approved boolean, score double, notes string")


def loaded(text: str):
    """A YAML document, or JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else None
    return yaml.safe_load(text)


def document(uri: str):
    """A small YAML or JSON file; None where it is missing."""
    try:
        text = b"".join(files.read_from(uri, 0)).decode()
    except FileNotFoundError:
        return None
    return loaded(text)


def benchmark(spark: SparkSession, uri: str) -> tuple[dict, DataFrame]:
    """(name and metric, tasks) of a benchmark's file; a later task of the same id wins."""
    doc = document(uri) or {}
    tasks = {str(t["id"]): (str(t["id"]), t.get("prompt"), t.get("reference")) for t in doc.get("tasks") or []}
    return {k: doc.get(k) for k in ("name", "metric")}, spark.createDataFrame(list(tasks.values()), "id string, prompt string, reference string")


def registry(spark: SparkSession, uri: str, group: str) -> DataFrame:
    """(name, version, manifest_sha256, uri) of a registry's group, by name and version; empty where the file is missing."""
    found = (document(uri) or {}).get(group) or {}
    rows = [(n, v.get("version"), v.get("manifest_sha256"), v.get("uri")) for n in sorted(found) for v in sorted(found[n] or [], key=lambda v: v.get("version") or 0)]
    return spark.createDataFrame(rows, "name string, version int, manifest_sha256 string, uri string")


_PRODUCT = "slug string, name string, revoked boolean, created_at string"


def _shown(value) -> str | None:
    """A field as text; lone surrogates, which no text of Spark's has, become question marks."""
    if value is None:
        return None
    text = json.dumps(value, default=str) if isinstance(value, bool | dict | list) else str(value)
    return text.encode("utf-8", "replace").decode()


def _roster(uri: str) -> Iterator[tuple]:
    """The products of one document, JSON an entry at a time; the document is read twice, as an error at its end leaves nothing of it."""
    try:
        first = arrays.Reader(uri).peek()
        last = max((n for n, _ in arrays.entries(uri, "products")), default=-1) if first in ("[", "{") else None
        if last is None:
            found = document(uri) or []
    except Exception as e:  # noqa: BLE001 - whatever a reader says of a malformed file
        if isinstance(e, OSError) and not isinstance(e, FileNotFoundError):
            raise
        return
    if last is None:
        found = found.get("products", []) if isinstance(found, dict) else found
        found = found if isinstance(found, list) else []
    else:
        found = (p for n, p in arrays.entries(uri, "products") if n == last)
    for p in found:
        if isinstance(p, dict):
            yield _shown(p.get("slug")), _shown(p.get("name")), bool(p.get("revoked")), _shown(p.get("created_at"))


def products(spark: SparkSession, uri: str) -> DataFrame:
    """(slug, name, revoked, created_at) of a products file, or of all *.json files in a folder; the key is dropped, and a malformed file is empty.

    Files are read in tasks, each by one.  What begins with a bracket is JSON,
    and a task holds a few entries of it at a time; anything else is YAML, a
    small document that its task holds whole.
    """

    def run(batches):
        for batch in batches:
            for at in batch.column("path").to_pylist():
                found = _roster(at)
                while some := list(itertools.islice(found, 4096)):
                    kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], [f.split()[0] for f in _PRODUCT.split(", ")])

    if files.is_file(uri):
        paths = spark.createDataFrame([(uri,)], "path string")
    else:
        paths = listing(spark, uri, ".json").select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return paths.mapInArrow(run, _PRODUCT)


REPORT = "benchmark string, metric string, mean_score double, num_tasks int, num_missing int"


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports of a folder, by file name."""
    docs = journey_documents(spark, path)
    return docs.select("stem", F.from_json("document", REPORT).alias("r")).select("stem", "r.*").orderBy("stem")
