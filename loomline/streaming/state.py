"""Folding journeys as they arrive: each journey's facts are state, and verdicts and steps follow from new events and that state alone."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators import fold
from loomline.sinks import keyed

#: What the fold needs of an event besides its journey; texts stay where the events are.
FACTS = {"event_id": "string", "seq": "long", "arrival": "long", "kind": "string", "role": "string", "signal": "string", "target_seq": "long", "writer": "string", "flag": "string", "calls": "int"}
#: ``copies`` is how often the event has arrived.
_STORED = FACTS | {"copies": "long"}
_STATE = "closed boolean, " + ", ".join(f"{c} array<{t}>" for c, t in _STORED.items())
OUT = "journey_id string, " + ", ".join(f"{c} {t}" for c, t in _STORED.items()) + ", closed boolean"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_ID, _SEQ, _ARRIVAL, _KIND, _COPIES = (list(_STORED).index(c) for c in ("event_id", "seq", "arrival", "kind", "copies"))


def _values(frame: pd.DataFrame, name: str, kind: str) -> list:
    """A column of a pandas frame as state holds it: numbers whole again where a missing one had made them fractions, and None for what is missing."""
    as_held = int if kind in ("long", "int") else str
    return [None if missing else as_held(v) for v, missing in zip(frame[name].tolist(), frame[name].isna().tolist(), strict=True)]


def merged(facts: dict[str, list], rows: Iterable[list]) -> None:
    """Take new events in: of those of one id the first arrival stands, by seq where arrivals tie, and all are counted."""
    for row in rows:
        row = list(row)
        held = facts.get(row[_ID])
        if held is None:
            facts[row[_ID]] = row
            continue
        n = held[_COPIES] + row[_COPIES]
        if (row[_ARRIVAL], row[_SEQ]) < (held[_ARRIVAL], held[_SEQ]):
            facts[row[_ID]] = held = row
        held[_COPIES] = n


def ended(facts: dict[str, list]) -> bool:
    """Whether a journey has its terminal and every number up to it."""
    ends = [f[_SEQ] for f in facts.values() if f[_KIND] == "terminal"]
    return bool(ends) and len({f[_SEQ] for f in facts.values() if f[_SEQ] <= min(ends)}) == min(ends) + 1


def journey_facts(stream: DataFrame, grace_ms: int | None = None) -> DataFrame:
    """The kept facts of each journey that a micro-batch touches, as a stream; see FACTS for the columns that stream needs.

    A journey's state goes ``grace_ms`` after it has its terminal and every
    number before it, unless events arrive until then; what comes later is
    ignored, and a mark of one boolean tells that the journey is closed.  With
    None state stays for good, and any order of arrival gives the same.
    """
    schema = [c.split()[0] for c in OUT.split(", ")]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = [[] for _ in _STORED]
        if state.hasTimedOut:
            state.update((True, *none))
            return
        closed, *columns = state.get if state.exists else (False, *none)
        if closed:
            return
        facts = {f[_ID]: list(f) for f in zip(*columns, strict=True)}
        for frame in frames:
            merged(facts, zip(*(_values(frame, c, t) for c, t in FACTS.items()), [1] * len(frame), strict=True))
        columns = [list(c) for c in zip(*facts.values(), strict=True)]
        state.update((False, *columns))
        if grace_ms is not None and ended(facts):
            state.setTimeoutDuration(grace_ms)
        yield pd.DataFrame({"journey_id": key[0], **dict(zip(_STORED, columns, strict=True)), "closed": False})[schema].astype({"target_seq": "Int64", "calls": "Int32"})

    known = stream.select(F.col("journey_id").cast("string").alias("journey_id"), *(_field(stream, c, t) for c, t in FACTS.items()))
    timeout = GroupStateTimeout.NoTimeout if grace_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return known.groupBy("journey_id").applyInPandasWithState(update, OUT, _STATE, "update", timeout)


def _field(stream: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in stream.columns else F.lit(None)).cast(kind).alias(name)


def refolded(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, steps) of the journeys of journey_facts(), as fold.verdicts() and fold.steps() have them."""
    copies = facts.groupBy("journey_id").agg((F.sum("copies") - F.count("*")).cast("long").alias("duplicates"))
    verdicts = fold.verdicts(facts).drop("duplicates").join(copies, "journey_id")
    told = facts.withColumns({c: F.lit(None).cast("string") for c in ("content", "response", "error")})
    return verdicts, fold.steps(fold.messages(fold.clean(told)))


def live_fold(stream: DataFrame, root: str, checkpoint: str, every: int | None = None, grace_ms: int | None = None) -> StreamingQuery:
    """Keep the verdicts and the steps of all journeys up to date, in keyed tables at root/verdicts and root/steps.

    A micro-batch reads its events and the state of their journeys, and stores
    the journeys it touched; late and repeated events change a journey as if
    they had come in time.  The steps of a journey are one row, an array, so
    that those that no longer hold go with the row.  A batch that runs twice
    stores the same again.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def step(batch: DataFrame, number: int) -> None:
        path = f"{root}/touched/{number % 2}"  # read several times below; of two folders the one before the last is written over
        batch.write.mode("overwrite").parquet(path)
        facts = batch.sparkSession.read.schema(OUT).parquet(path)
        verdicts, steps = refolded(facts)
        keyed.upsert(batch.sparkSession, f"{root}/verdicts", verdicts, ["journey_id"])
        packed = steps.groupBy("journey_id").agg(F.array_sort(F.collect_list(F.struct("step_index", "end_ordinal", "end_seq", "prefix_block", "status", "message_count"))).alias("steps"))
        none = verdicts.select("journey_id").join(packed, "journey_id", "left")
        keyed.upsert(batch.sparkSession, f"{root}/steps", none, ["journey_id"])

    writer = journey_facts(stream, grace_ms).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    if every is not None:
        return writer.trigger(processingTime=f"{every} seconds").start()
    # batches without data, which timers ask for without end, would keep a query over what is there from stopping
    before = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_NO_DATA, before)
