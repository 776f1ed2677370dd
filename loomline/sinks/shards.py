"""Wire files, trajectories and training examples as files."""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.text import safe_stem
from loomline.sources import files, wire

_WRITTEN = "path string, bytes long, sha256 string"


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write each row (name, content) as a file under root; returns (path, bytes, sha256).

    Tasks write; a file appears whole, under its name, so neither a reader nor a
    lost task leaves half of one.  Of rows with equal names one file is left.
    """
    root = root.rstrip("/")

    def run(batches):
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                data = (content.as_py() or "").encode()
                files.write_whole(f"{root}/{name}", data, attempt)
                out.append((f"{root}/{name}", len(data), hashlib.sha256(data).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [f.split()[0] for f in _WRITTEN.split(", ")])

    return rows.select("name", "content").mapInArrow(run, _WRITTEN)


def write_roster(products: DataFrame, root: str, per_file: int = 10_000) -> DataFrame:
    """Write products, JSON objects in the column ``product``, as documents {"products": [...]} of at most per_file each; returns what write_files() does."""

    def documents(batches):
        lines = (x for batch in batches for x in batch.column("product").to_pylist())
        part, n = TaskContext.get().partitionId(), 0
        while some := list(itertools.islice(lines, per_file)):
            yield pa.RecordBatch.from_arrays([pa.array([f"products-{part:05d}-{n:05d}.json"]), pa.array(['{"products":[' + ",".join(some) + "]}"])], ["name", "content"])
            n += 1

    return write_files(products.select("product").where("product is not null").mapInArrow(documents, "name string, content string"), root)


def header_line(*fields: str, version_key: str = wire.VERSION_KEY) -> Column:
    """A header as a JSON line with sorted keys, nulls left out; fields are columns."""
    return F.to_json(F.struct(*_sorted_fields(version_key, fields)))


def _sorted_fields(version_key: str, fields: tuple[str, ...]) -> list[Column]:
    named = {f: F.col(f) for f in fields} | {version_key: F.lit(wire.VERSION).alias(version_key)}
    return [named[k] for k in sorted(named)]


def wire_contents(events: DataFrame, headers: DataFrame, with_header: bool = True) -> DataFrame:
    """(journey_id, head, lines): the text of each journey's file.  events: journey_id, seq and line; headers: journey_id and line.

    Lines are in the order of seq; with_header=False leaves the head empty, as
    what is appended to a file has none.
    """
    body = events.groupBy("journey_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    head = F.concat("head", F.lit("\n")) if with_header else F.lit("")
    return body.join(headers.select("journey_id", F.col("line").alias("head")), "journey_id").select("journey_id", head.alias("head"), text.alias("lines"))


def write_wire(events: DataFrame, headers: DataFrame, root: str, date: str | None = None) -> DataFrame:
    """A wire file for each journey, header first: root/<stem>.jsonl, or root/<date>/<stem>.jsonl."""
    rows = wire_contents(events, headers)
    name = F.concat(F.lit(f"{date}/" if date else ""), safe_stem(F.col("journey_id").cast("string")), F.lit(".jsonl"))
    return write_files(rows.select(name.alias("name"), F.concat("head", "lines").alias("content")), root)


def append_wire(events: DataFrame, headers: DataFrame, root: str, batch: str | None = None) -> int:
    """Append events to root/<stem>.jsonl, with the header where the file is new, once; how many bytes were added.

    How long each file is before is written down first, under root/_batches.
    A task appends from there on what the file lacks, so one that is run again,
    or a whole batch of the same name, leaves no line twice.  A journey's lines
    are written by one task; speculative execution must be off, as stores have
    no order between two writers.  For stores that can append.
    """
    root = root.rstrip("/")
    spark = events.sparkSession
    rows = wire_contents(events, headers).select(F.concat(safe_stem(F.col("journey_id").cast("string")), F.lit(".jsonl")).alias("name"), "head", "lines")
    plan = f"{root}/_batches/{batch or uuid.uuid4().hex}"

    def sized(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("name"), pa.array([files.size(f"{root}/{n}") for n in part.column("name").to_pylist()], pa.int64())], ["name", "offset"])

    if "_SUCCESS" not in files.names(plan):
        rows.select("name").mapInArrow(sized, "name string, offset long").write.mode("overwrite").parquet(plan)
    offsets = spark.read.schema("name string, offset long").parquet(plan)

    def run(batches):
        for part in batches:
            added = [files.append_at(f"{root}/{name}", offset, ((head if offset == 0 else "") + lines).encode()) for name, offset, head, lines in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(added)], pa.int64())], ["n"])

    out = rows.join(offsets, "name").select("name", "offset", "head", "lines").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    if batch is None:
        files.remove(plan)
    return out


def json_line(columns: list[str]) -> Column:
    """Columns as one JSON object with sorted keys, nulls left out."""
    return F.to_json(F.struct(*sorted(columns)))


def write_jsonl(rows: DataFrame, path: str, single: bool = False) -> None:
    """A JSON object a line with sorted keys, one row each; in one file where asked, in as many as there are partitions otherwise."""
    out = rows.select(json_line(rows.columns).alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_trajectories(trajectories: DataFrame, root: str) -> DataFrame:
    """A file <stem>.json for each row (conversation_id, document), indented and with sorted keys."""

    def shown(batches):
        for batch in batches:
            text = [json.dumps(json.loads(d), indent=2, sort_keys=True) + "\n" for d in batch.column("document").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(text, pa.string())], ["name", "content"])

    named = trajectories.select(F.concat(safe_stem(F.col("conversation_id").cast("string")), F.lit(".json")).alias("name"), "document")
    return write_files(named.mapInArrow(shown, "name string, content string"), root)


def rotated(lines: DataFrame, root: str, max_rows: int | None = None, max_bytes: int = 100_000_000) -> DataFrame:
    """Spool shards journeys/<id>/<date>.<n>.jsonl, a new one each day and beyond a size, each with its header.

    lines: journey_id, date, seq, line and head.  An event goes into the next
    shard if the one before has max_bytes bytes already, header included, or
    max_rows events.  Events are dealt out once, by journey and day, and a task
    holds one shard of one journey at a time.
    """
    names = ["journey_id", "date", "head", "line"]
    rows = lines.select(safe_stem(F.col("journey_id").cast("string")).alias("journey_id"), "date", "seq", "head", "line")

    def shards(batches):
        key, n, held, size = None, 0, [], 0

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([f"journeys/{key[0]}/{key[1]}.{n}.jsonl"]), pa.array(["".join(held)])], ["name", "content"])

        for batch in batches:
            for journey, date, head, line in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                full = size >= max_bytes or (max_rows is not None and len(held) > max_rows)
                if key != (journey, date) or full:
                    if held:
                        yield shard()
                    n = n + 1 if key == (journey, date) else 0
                    key, held = (journey, date), [f"{head}\n"]
                    size = len(held[0].encode())
                held.append(f"{line}\n")
                size += len(held[-1].encode())
        if held:
            yield shard()

    dealt = rows.repartition("journey_id", "date").sortWithinPartitions("journey_id", "date", "seq")
    return write_files(dealt.select(*names).mapInArrow(shards, "name string, content string"), root)
