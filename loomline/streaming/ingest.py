"""Ingest and drain as Structured Streaming: arrivals without repeats, acknowledgements, tailing, upkeep."""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators import fold
from loomline.sinks import keyed, shards
from loomline.sources import files, wire

_ACK = "journey_id string, ack long"
#: Parts that live events are kept in by journey.
BUCKETS = 256


def _state_outside_the_heap(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what hasn't arrived before to a Parquet table, then stop.

    Journeys have no bound on lateness, so duplicates are known for as long as
    the state is kept; RocksDB holds it outside the heap.  Where the stream has
    a date, an event counts as the same only within its day.
    """
    _state_outside_the_heap(stream.sparkSession)
    unique = stream.dropDuplicates(["journey_id", "event_id", *(["date"] if "date" in stream.columns else [])])
    return unique.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def batch_verdicts(lines: DataFrame) -> DataFrame:
    """(path, rejected, truncated, error) of posted batches, lines() of a file each: a batch with any damage is refused whole."""
    e = wire.events(lines)
    each = e.groupBy("path").agg(F.count_if(F.col("state") == "rejected").alias("rejected"), F.max(F.col("state") == "truncated").alias("truncated"))
    heads = lines.where("line_no = 1").select("path", "refused")
    out = heads.join(each, "path", "left").fillna(0, ["rejected"]).withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    error = F.when(F.col("refused").isNotNull(), F.concat(F.lit("malformed batch: "), "refused")).when(F.col("rejected") > 0, F.concat(F.lit("malformed batch: "), F.col("rejected").cast("string"), F.lit(" rejected line(s)"))).when(F.col("truncated"), "malformed batch: truncated final line")
    return out.select("path", "rejected", "truncated", error.alias("error"))


def admitted(lines: DataFrame, stored: DataFrame | None = None, date: str | None = None) -> DataFrame:
    """Events of the batches that are whole, once each, without those that ``stored`` (journey_id, event_id) has.

    With a date, ``stored`` has a column ``date``, and what it has of other days
    doesn't count: an event that comes again on another day is let in.  Where
    stored is partitioned by date, other days aren't read.
    """
    good = batch_verdicts(lines).where("error is null").select("path")
    e = wire.flat(wire.events(lines.join(good, "path", "left_semi"))).dropDuplicates(["journey_id", "event_id"])
    if stored is not None and date is not None:
        stored = stored.where(F.col("date") == date)
    return e if stored is None else e.join(stored.select("journey_id", "event_id"), ["journey_id", "event_id"], "left_anti")


def undrained(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events beyond the acknowledged seq of their journey."""
    return events.join(acks, "journey_id", "left").where(F.col("seq") > F.coalesce("ack", F.lit(-1))).drop("ack")


def spool_status(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events, acknowledged seq (null: none) and events beyond it, by journey."""
    e = events.join(acks, "journey_id", "left").groupBy("journey_id")
    return e.agg(F.count("*").alias("total"), F.max("ack").alias("watermark"), F.count_if(F.col("seq") > F.coalesce("ack", F.lit(-1))).alias("undrained"))


def advanced(acks: DataFrame, sent: DataFrame) -> DataFrame:
    """Acknowledgements after sending; they never go back."""
    top = sent.groupBy("journey_id").agg(F.max("seq").alias("sent"))
    return acks.join(top, "journey_id", "full").select("journey_id", F.greatest(F.coalesce("ack", F.lit(-1)), F.coalesce("sent", F.lit(-1))).alias("ack"))


def drain_batch(events: DataFrame, state: str, sink: Callable[[DataFrame], DataFrame], batch: str | None = None) -> DataFrame:
    """Send what lies beyond each journey's acknowledgement and return the outcome (journey_id, sent, gaps, error).

    ``sink`` gets the events and returns (journey_id, error); the
    acknowledgements in the keyed table at ``state`` move for those without an
    error only, and never back.  A hole in the numbers is reported and no hindrance.
    A sink with the attribute by_batch gets the batch's name, too, and may find
    that it has it already, if it failed between sending and acknowledging.
    """
    spark = events.sparkSession
    events = events.withColumn("journey_id", F.col("journey_id").cast("string"))
    acks = keyed.current(spark, state, _ACK)
    new = undrained(events, acks)
    held = f"{state}/_batch-{uuid.uuid4().hex}"
    new.write.parquet(held)  # sent and acknowledged are the same events, whatever arrives meanwhile
    new = spark.read.schema(new.schema).parquet(held)
    told = sink(new, batch) if getattr(sink, "by_batch", False) else sink(new)
    outcome = told.select(F.col("journey_id").cast("string").alias("journey_id"), "error")
    outcome.write.parquet(f"{held}-outcome")
    outcome = spark.read.schema(outcome.schema).parquet(f"{held}-outcome")
    sent = new.groupBy("journey_id").agg(F.max("seq").alias("top"), F.min("seq").alias("low"), F.count_distinct("seq").alias("n"), F.count("*").alias("sent"))
    told = sent.join(outcome, "journey_id", "left")
    moved = told.where("error is null").select("journey_id", F.col("top").alias("seq"))
    known = acks.join(moved.select("journey_id"), "journey_id", "left_semi")
    keyed.upsert(spark, state, advanced(known, moved).select("journey_id", F.col("ack").cast("long").alias("ack")), ["journey_id"])
    gaps = (F.col("top") - F.col("low") + 1 - F.col("n")).cast("long")
    return told.select("journey_id", F.when(F.col("error").isNull(), F.col("sent")).otherwise(0).alias("sent"), gaps.alias("gaps"), "error")


def file_sink(root: str, header: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A sink that appends to root/<journey>.jsonl, a named batch once; header gives (journey_id, line) of the events' journeys."""

    def send(events: DataFrame, batch: str | None = None) -> DataFrame:
        shards.append_wire(wire.rendered(events), header(events), root, batch)
        return events.select("journey_id").distinct().withColumn("error", F.lit(None).cast("string"))

    send.by_batch = True
    return send


def drain(stream: DataFrame, state: str, sink: Callable[[DataFrame], DataFrame], checkpoint: str, every: int | None = None, report: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """drain_batch() of each micro-batch: once over what is there, or every 1 to 3600 seconds."""
    if every is not None and not 1 <= every <= 3600:
        raise ValueError("every must lie between 1 and 3600 seconds")
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]  # micro-batches are numbered by checkpoint

    def step(batch: DataFrame, number: int) -> None:
        outcome = drain_batch(batch, state, sink, f"{name}-{number}")
        if report:
            report(outcome)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=f"{every} seconds")).start()


def live_verdicts(stream: DataFrame, root: str, checkpoint: str, every: int | None = None) -> StreamingQuery:
    """Keep (journey_id, complete, reason) of all journeys up to date in a keyed table at root/verdicts.

    Each micro-batch is added to the events at root/events, by buckets of
    journeys, and the journeys it touches, and no others, are folded anew from
    their buckets: late and repeated events change a verdict as if they had come
    in time.  A batch that runs twice replaces what it wrote the first time.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{root}/events"
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64("journey_id"), F.lit(BUCKETS)).cast("int"))
        bucketed.write.partitionBy("bucket").mode("overwrite").parquet(f"{at}/batch={number}")
        new = spark.read.schema(bucketed.schema).parquet(f"{at}/batch={number}")
        touched = new.select("journey_id").distinct()
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if not buckets:
            return
        held = spark.read.option("basePath", at).parquet(at).where(F.col("bucket").isin(buckets)).drop("bucket", "batch")
        found = fold.verdicts(held.join(touched, "journey_id", "left_semi")).select("journey_id", "complete", "reason")
        keyed.upsert(spark, f"{root}/verdicts", found, ["journey_id"])

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=f"{every} seconds")).start()


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose time or size differs from the state, or that it doesn't know."""
    s = state.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    return listing.join(s, "path", "left").where("_m is null or _m <> mtime or _s <> size").drop("_m", "_s")


def gone_files(state: DataFrame, listing: DataFrame) -> DataFrame:
    return state.join(listing, "path", "left_anti")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, mtime, size) of the files of a folder; their contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))


def tail(spark: SparkSession, path: str, offsets: DataFrame, glob: str = "*.ndjson") -> tuple[DataFrame, DataFrame]:
    """Objects beyond each file's offset, as (path, value), and the offsets (path, offset) after them.

    Only the new bytes are read.  A last line without its end waits for the next
    pass; blank and malformed lines go.  A file that has shrunk is read anew.
    """

    def run(batches):
        for batch in batches:
            for name, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = at if at is not None and at <= size else 0
                rest = b""
                for part in files.read_from(name, at):
                    whole, sep, rest = (rest + part).rpartition(b"\n")
                    at += len(whole) + len(sep)
                    out = [x.decode("utf-8", "replace") for x in whole.split(b"\n") if x.strip()]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(out), pa.array([None] * len(out), pa.int64())], ["path", "value", "offset"])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.string()), pa.array([at], pa.int64())], ["path", "value", "offset"])

    found = listing(spark, path, glob).join(offsets, "path", "left").where("offset is null or offset <> size").select("path", "size", "offset")
    rows = found.mapInArrow(run, "path string, value string, offset long")
    values = rows.where(F.col("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()).select("path", "value")
    moved = rows.where("offset is not null").select("path", "offset")
    return values, moved.unionByName(offsets.join(moved.select("path"), "path", "left_anti").select("path", "offset"))


def upkeep(step: Callable[[], None], reconcile: Callable[[], None], stop: threading.Event, seconds: float = 5.0, every: int = 20, failed: Callable[[Exception], None] | None = None) -> int:
    """step() every few seconds, and reconcile() at every 20th pass, until stop is set; the number of passes.  A failed pass is told and followed by the next."""
    passes = 0
    while not stop.is_set():
        try:
            step()
            if passes % every == every - 1:
                reconcile()
        except Exception as e:  # noqa: BLE001 - the loop outlives its passes
            if failed:
                failed(e)
        passes += 1
        stop.wait(seconds)
    return passes
