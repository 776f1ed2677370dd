"""Operators on whole journeys: assembly, metrics, clean-up, validation, augmentation, retention."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
STATUSES = ("trainable", "not_trainable", "superseded")
_J = "journey_id"


def tool_metrics(messages: DataFrame) -> DataFrame:
    """Calls, failures and their rate by journey; the rate is 0 without calls.  messages: journey_id, role, calls, error."""
    calls = F.sum(F.when(F.col("role") == "assistant", F.coalesce("calls", F.lit(0))).otherwise(0)).cast("long")
    failed = F.count_if((F.col("role") == "tool") & (F.coalesce("error", F.lit("")) != ""))
    out = messages.groupBy(_J).agg(calls.alias("calls"), failed.alias("failures"))
    return out.withColumn("error_rate", F.when(F.col("calls") == 0, 0.0).otherwise(F.col("failures") / F.col("calls")))


def tool_call_accuracy(error_rate: Column) -> Column:
    return F.lit(1.0) - F.coalesce(error_rate, F.lit(0.0))


def total_time(started: Column, ended: Column) -> Column:
    """Seconds between two ISO times; null where either can't be read."""
    return F.unix_micros(F.try_to_timestamp(ended)) / 1e6 - F.unix_micros(F.try_to_timestamp(started)) / 1e6


def reward_from_scalar(value: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    if hi <= lo:
        raise ValueError("hi must be above lo")
    return F.struct(((value - lo) / (hi - lo)).alias("aggregated_value"), F.lit("identity").alias("aggregation_method"), value.alias("component"))


def sample(rows: DataFrame, share: float, key: str = _J) -> DataFrame:
    """Whole journeys whose hash falls below the share: the same ones in every run and every table."""
    at = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return rows.where(at < share)


def effective_tags(header: Column, event: Column) -> Column:
    """Tags in force for an event: those of the header, replaced by its own."""
    keep = F.map_filter(header, lambda k, v: ~F.map_contains_key(event, k))
    return F.map_concat(keep, event)


def tag_delta(header: Column, tags: Column) -> Column:
    """Tags that differ from the header's."""
    return F.map_filter(tags, lambda k, v: ~F.equal_null(F.element_at(header, k), v))


def request_delta(calls: DataFrame, order: str, size: str = "n_messages") -> DataFrame:
    """Where the new messages of each call begin and how many there are; a shorter list starts over and adds none."""
    before = F.coalesce(F.lag(size).over(Window.partitionBy(_J).orderBy(order)), F.lit(0))
    return calls.withColumn("consumed", before).withColumn("added", F.greatest(F.col(size) - F.col("consumed"), F.lit(0)))


def run_roots(runs: DataFrame, max_doublings: int = 40) -> DataFrame:
    """The root of each run (run_id, parent_id): the run above whose parent is missing or unknown.

    Pointers double, so a chain of n runs takes log n rounds; each round is
    written to the checkpoint folder.  A cycle, which has no root, raises.
    """
    spark = runs.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="roots-"))
    known = runs.select(F.col("run_id").alias("_k"))
    at = runs.join(known, F.col("parent_id") == F.col("_k"), "left").select("run_id", F.coalesce("_k", "run_id").alias("root")).checkpoint()
    for _ in range(max_doublings):
        above = at.select(F.col("run_id").alias("_k"), F.col("root").alias("_up"))
        moved = at.join(above, F.col("root") == F.col("_k")).select("run_id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")).checkpoint()
        at = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            return at
    raise ValueError("runs form a cycle")


def drop_dead_turns(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (journey_id, step_index, ordinal, ...) of steps that add anything, steps renumbered, and the steps that went.

    A message is dead without content, calls and response.  Rows are what each
    step adds, so steps after a dropped one need no other change.
    """
    dead = (F.coalesce("content", F.lit("")) == "") & (F.coalesce("calls", F.lit(0)) == 0) & (F.coalesce("response", F.lit("")) == "")
    marked = messages.withColumn("_dead", F.min(dead).over(Window.partitionBy(_J, "step_index")))
    w = Window.partitionBy(_J).orderBy("step_index")
    kept = marked.where("not _dead").withColumn("step_index", (F.dense_rank().over(w) - 1).cast("long"))
    return kept.drop("_dead"), marked.where("_dead").select(_J, "step_index").distinct()


def schema_errors(steps: Column) -> Column:
    """Errors of a journey's steps: array of structs with trainable_status and messages of (role).  Fixed values: the wording."""

    def step(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("steps["), i.cast("string"), F.lit("]"))
        status = F.when(~F.coalesce(s["trainable_status"], F.lit("not_trainable")).isin(*STATUSES), F.concat(at, F.lit(".trainable_status: invalid value '"), s["trainable_status"], F.lit("'")))
        roles = F.transform(s["messages"], lambda m, j: F.when(~F.coalesce(m["role"].isin(*ROLES), F.lit(False)), F.concat(at, F.lit(".messages["), j.cast("string"), F.lit("].role: invalid or missing"))))
        lists = F.when(s["messages"].isNull(), F.array(F.concat(at, F.lit(".messages: missing or not a list")))).otherwise(roles)
        return F.when(s.isNull(), F.array(F.concat(at, F.lit(": not an object")))).otherwise(F.concat(F.array(status), lists))

    return F.when(steps.isNull(), F.array(F.lit("steps: missing or not a list"))).otherwise(F.array_compact(F.flatten(F.transform(steps, step))))


def perturb_tool_calls(messages: DataFrame) -> DataFrame:
    """For each call with arguments of a journey's last step: the journey without the first argument by name.

    messages: journey_id, ordinal, calls array<struct<name, arguments map>>.
    Returns journey_id, synthetic_id, ordinal, call, tool, dropped_argument and the arguments that are left; the other
    messages are those of the journey.
    """
    calls = messages.select(_J, "ordinal", F.posexplode("calls").alias("call", "c")).where(F.size("c.arguments") > 0)
    n = F.row_number().over(Window.partitionBy(_J).orderBy("ordinal", "call")) - 1
    gone = F.array_min(F.map_keys("c.arguments"))
    out = calls.select(_J, F.concat(F.col(_J).cast("string"), F.lit("__synthetic_"), n.cast("string")).alias("synthetic_id"), "ordinal", "call", F.col("c.name").alias("tool"), gone.alias("dropped_argument"), F.col("c.arguments").alias("arguments"))
    return out.withColumn("arguments", F.map_filter("arguments", lambda k, v: k != F.col("dropped_argument")))


def rewrite_turns(turns: DataFrame, client: Callable[[list[str]], Iterable[str | None]], variants: int = 1) -> DataFrame:
    """Variants of user turns (journey_id, ordinal, content) by an injected client; a reply of None or blank is left out.

    The client is called on the workers with a batch of texts at a time.
    """

    def run(frames):
        for frame in frames:
            for v in range(variants):
                out = frame.assign(content=pd.Series(list(client(frame["content"].tolist())), index=frame.index, dtype=object), variant=v)
                yield out[out["content"].map(lambda t: isinstance(t, str) and bool(t.strip()))]

    kind = turns.schema[_J].dataType.simpleString()
    return turns.where("role = 'user' and content is not null").select(_J, F.col("ordinal").cast("long").alias("ordinal"), "content").mapInPandas(run, f"{_J} {kind}, ordinal long, content string, variant int")


def collectable(shards: DataFrame, acks: DataFrame, now: Column, min_age: int) -> DataFrame:
    """Journeys whose shards may go: all events acknowledged, old enough, not open."""
    a = acks.select(_J, "ack")
    return shards.join(a, _J).where((F.col("ack") == F.col("highest_seq")) & (now - F.col("mtime") >= min_age) & ~F.col("open"))


def expired(dates: Column, today: Column, keep_days: int) -> Column:
    """Whether a date folder is older than the days kept; folders that aren't dates stay."""
    return F.coalesce(F.try_to_timestamp(dates, F.lit("yyyy-MM-dd")).cast("date") < F.date_sub(today, keep_days), F.lit(False))


def audit(registry: DataFrame, shards: DataFrame) -> DataFrame:
    """Registered shards whose file is missing or has another digest."""
    found = shards.select("name", F.col("sha256").alias("_found"))
    return registry.join(found, "name", "left").withColumn("problem", F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("sha256"), "sha mismatch")).where("problem is not null").drop("_found")
