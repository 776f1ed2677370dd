"""What the operators share: tables in the shared folder, row keys, removal of byte spans."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Arrow code turns into Python objects at a time.
SLICE_ROWS = 256
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set as the checkpoint
    folder and used, on one machine only: executors elsewhere could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="loomline-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomline/{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the executions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Shuffle files of the executions inside go when each ends; what they computed is in a table by then."""
    return setting(spark, _CLEANUP, "true")


def joined_in_place(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Joins inside keep a partitioning by a part of their keys; right where that part alone spreads the rows evenly."""
    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it again.

    This cuts the lineage with files that every executor can read, so nothing
    is computed twice and the loss of an executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit words that stand for a row.  Only rows equal in both columns share them, and those have equal results."""
    return [F.xxhash64(doc_id, text).alias("_r1"), F.xxhash64(text, F.length(text)).alias("_r2")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, few at a time, so that what a worker holds as Python objects doesn't grow with a batch."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(begin, SLICE_ROWS)


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as sorted maximal runs."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[start], hi[np.concatenate([start[1:], [True]])]


def cut_spans(docs: DataFrame, spans: DataFrame, min_run: int = 0, with_text: bool = True) -> DataFrame:
    """Remove byte spans from texts.

    docs has doc_id and text, spans has _r1, _r2 (see row_key) and an array of
    structs (lo, hi).  Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and, with_text, the remaining bytes as ``kept``.  Runs shorter than min_run
    stay.  A null text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *row_key(F.col("doc_id"), text))
    keyed = left.join(spans.select(F.col("_r1").alias("_s1"), F.col("_r2").alias("_s2"), F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi")), (F.col("_r1") == F.col("_s1")) & (F.col("_r2") == F.col("_s2")), "left").select("doc_id", F.encode("text", "UTF-8").alias("text"), "lo", "hi")
    return cut_rows(keyed, ["doc_id"], min_run, with_text)


def cut_rows(rows: DataFrame, keep: list[str], min_run: int = 0, with_text: bool = True) -> DataFrame:
    """The columns ``keep`` and what is left of ``text`` (bytes) without the spans of the arrays lo and hi."""
    kept = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep]
    fields = ", ".join([*kept, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept binary"] if with_text else [])])

    def cut(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for data, lo, hi in zip(*(batch.column(c) for c in ("text", "lo", "hi")), strict=True):
                data = data.as_buffer()
                n = data.size if data is not None else 0
                data = memoryview(data) if n else b""
                lo, hi = lo.values, hi.values
                if lo is None or not len(lo):
                    lo = hi = np.zeros(0, np.int64)
                else:
                    lo, hi = merge_spans(lo.to_numpy().astype(np.int64), hi.to_numpy().astype(np.int64))
                    long = hi - lo >= min_run
                    lo, hi = lo[long], hi[long]
                sha, at, parts = hashlib.sha256(), 0, []
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    sha.update(data[at:a])
                    parts.append(data[at:a])
                    at = b
                sha.update(data[at:])
                parts.append(data[at:])
                row = [n, int((hi - lo).sum()), len(lo), sha.hexdigest()] + ([b"".join(parts)] if with_text else [])
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(out[: len(names)], kinds, strict=False))], [*keep, *names])

    return rows.select(*keep, "text", "lo", "hi").mapInArrow(cut, fields)
