"""Folding an event stream into journeys.

Every operator here works on partitions of journey_id; ``dealt`` deals rows out
once, and all windows and groupings contain that key, so nothing moves again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import canonical

SUPERSEDING = ("regenerated", "user_edit")
_J = "journey_id"


def dealt(events: DataFrame) -> DataFrame:
    return events.repartition(_J)


def dedupe(events: DataFrame) -> DataFrame:
    """The first arrival of each event_id."""
    w = Window.partitionBy(_J, "event_id").orderBy("arrival", "seq")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def terminal_cut(events: DataFrame) -> DataFrame:
    """Events up to the lowest terminal; all where there is none."""
    end = F.min(F.when(F.col("kind") == "terminal", F.col("seq"))).over(Window.partitionBy(_J))
    return events.withColumn("_end", end).where("_end is null or seq <= _end").drop("_end")


def clean(events: DataFrame) -> DataFrame:
    return terminal_cut(dedupe(dealt(events)))


def gap_ranges(kept: DataFrame) -> DataFrame:
    """Missing sequence numbers between 0 and the highest kept one, as ranges from first_seq to last_seq: a row a hole, however wide."""
    seqs = kept.select(_J, F.col("seq").cast("long").alias("seq")).dropDuplicates([_J, "seq"])
    before = F.coalesce(F.lag("seq").over(Window.partitionBy(_J).orderBy("seq")), F.lit(-1).cast("long"))
    return seqs.withColumn("_before", before).where("seq > _before + 1").select(_J, (F.col("_before") + 1).alias("first_seq"), (F.col("seq") - 1).alias("last_seq"))


def gaps(kept: DataFrame, step: int = 1 << 20) -> DataFrame:
    """gap_ranges() number by number; wide holes are spelled out in steps, so no array grows with a hole."""
    first = F.explode(F.sequence("first_seq", "last_seq", F.lit(step).cast("long")))
    blocks = gap_ranges(kept).select(_J, "last_seq", first.alias("_at"))
    return blocks.select(_J, F.explode(F.sequence("_at", F.least(F.col("_at") + step - 1, F.col("last_seq")))).alias("missing_seq"))


def _reason(writers: Column, missing: Column, terminated: Column) -> Column:
    return F.when(writers > 1, "writer_conflict").when(missing > 0, "missing_events").when(~terminated, "no_terminal")


def verdicts(events: DataFrame) -> DataFrame:
    """Whether each journey is complete, and why not: writers before gaps before a missing end."""
    raw = dealt(events)
    j = Window.partitionBy(_J)
    first = F.row_number().over(Window.partitionBy(_J, "event_id").orderBy("arrival", "seq")) == 1
    marked = raw.withColumn("_first", first)
    end = F.min(F.when(F.col("_first") & (F.col("kind") == "terminal"), F.col("seq"))).over(j)
    marked = marked.withColumn("_end", end)
    inside = F.col("_first") & (F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
    kept = marked.groupBy(_J).agg(
        F.count_if(~F.col("_first")).alias("duplicates"),
        F.max("_end").isNotNull().alias("terminated"),
        F.count_if(F.col("_first") & ~inside).alias("rejected"),
        (F.max(F.when(inside, F.col("seq"))) + 1 - F.countDistinct(F.when(inside, F.col("seq")))).cast("long").alias("missing"),
        F.countDistinct(F.when(inside, F.col("writer"))).alias("writers"),
    )
    reason = _reason(F.col("writers"), F.col("missing"), F.col("terminated"))
    return kept.select(_J, "duplicates", "rejected", "missing", "writers", "terminated", reason.isNull().alias("complete"), reason.alias("reason"))


def judged(kept: DataFrame) -> DataFrame:
    """Kept events with the verdict on their journey as the column ``reason``, null if it is complete; no exchange beyond that of clean()."""
    j = Window.partitionBy(_J)
    first = F.row_number().over(Window.partitionBy(_J, "seq").orderBy("arrival")) == 1
    out = kept.withColumn("_first", first)
    missing = F.max("seq").over(j) + 1 - F.sum(F.col("_first").cast("long")).over(j)
    writers = F.when(F.min("writer").over(j) != F.max("writer").over(j), 2).otherwise(1)
    ended = F.max(F.col("kind") == "terminal").over(j)
    return out.withColumn("reason", _reason(writers, missing, ended)).drop("_first")


def _any(signals: tuple[str, ...], over) -> Column:
    return F.coalesce(F.max(F.col("signal").isin(*signals)).over(over), F.lit(False))


#: What a message says besides its role, its text and the number of its calls.
_REST = ("response", "error", "tool_calls", "tool_id", "tool_name", "reasoning", "tool_definitions")
#: Columns that a stream may lack, null then; the number of calls is that of the calls.
_OPTIONAL = {"flag": "string", "calls": "int", "response": "string", "error": "string", "reward": "double", "reason": "string", "voice": "string", "model_id": "string", "tool_calls": "array<struct<name:string,arguments:string,id:string>>", "tool_id": "string", "tool_name": "string", "reasoning": "string", "tool_definitions": "array<struct<name:string,description:string,parameters:string>>"}


def _whole(events: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in events.columns}
    if "calls" in missing and "tool_calls" not in missing:
        missing["calls"] = F.size("tool_calls")
    return events.withColumns(missing) if missing else events


def messages(kept: DataFrame) -> DataFrame:
    """Messages with their training status; signals reach their message within the journey's partition.

    A message's own flag comes first: ``summarization`` marks a boundary, and an
    interrupted turn of the agent is no target.  Then what signals say of it:
    replaced, disliked, liked; then its role.  Of several messages of one seq
    the last arrival stays, by event_id where arrivals tie.
    """
    passed = [c for c in ("reason",) if c in kept.columns]
    kept = _whole(kept)
    aim = F.when(F.col("kind") == "signal", F.col("target_seq")).otherwise(F.col("seq"))
    w = Window.partitionBy(_J, "_aim")
    later = Window.partitionBy(_J, "kind", "seq").orderBy(F.desc("arrival"), F.desc("event_id"))
    marked = kept.withColumn("_aim", aim).withColumns({"_sup": _any(SUPERSEDING, w), "_down": _any(("thumbs_down",), w), "_up": _any(("thumbs_up",), w), "_last": F.row_number().over(later)})
    agent = F.col("role") == "assistant"
    status = (
        F.when(F.col("flag") == "summarization", "summarization_boundary")
        .when((F.col("flag") == "interrupted") & agent, "not_trainable")
        .when(F.col("_sup"), "superseded")
        .when(F.col("_down"), "not_trainable")
        .when(F.col("_up"), "trainable")
        .when(agent, "trainable")
        .otherwise("not_trainable")
    )
    return marked.where("kind = 'message' and _last = 1").select(_J, "seq", "role", "content", status.alias("status"), (F.coalesce("calls", F.lit(0)) > 0).alias("has_calls"), F.coalesce("calls", F.lit(0)).alias("calls"), *_REST, *passed)


def marked(msgs: DataFrame) -> DataFrame:
    """Messages with the step that each closes, if any.

    A swap is a system message after the first user message; swaps that follow
    the same message form a block, and the latest block in force takes the place
    of all system messages.  k counts the other messages; ``block`` is the k of
    the block in force, null if none.
    """
    j = Window.partitionBy(_J)
    run = j.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = j.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    first_user = F.min(F.when(F.col("role") == "user", F.col("seq"))).over(j)
    m = msgs.withColumn("_fu", first_user).withColumn("swap", F.coalesce((F.col("role") == "system") & (F.col("seq") > F.col("_fu")), F.lit(False)))
    m = m.withColumn("k", F.sum(F.when(F.col("swap"), 0).otherwise(1)).over(run).cast("long"))
    m = m.withColumn("after", F.sum(F.col("swap").cast("int")).over(Window.partitionBy(_J, "k")))
    m = m.withColumns(
        {
            "before": F.max(F.when(F.col("swap"), F.col("k"))).over(run),
            "_size": F.last(F.when(F.col("swap"), F.col("after")), True).over(run),
            "plain": F.sum(F.when(F.col("role") != "system", 1).otherwise(0)).over(run),
            "_next": F.last(F.when(~F.col("swap"), F.col("role")), True).over(ahead),
        }
    )
    agent = F.col("role") == "assistant"
    a = agent & (F.col("status") == "superseded")
    b = agent & (F.col("after") > 0) & ~F.col("has_calls")
    turn = (F.col("_next") == "user") & (F.col("_fu") <= F.col("seq")) & (F.col("role") != "user")
    block = F.when(a | b, F.col("before")).otherwise(F.when(F.col("after") > 0, F.col("k")).otherwise(F.col("before")))
    m = m.withColumn("block", block).withColumn("closes", ~F.col("swap") & F.coalesce(a | b | turn | F.col("_next").isNull(), F.lit(False)))
    size = F.when(F.col("block") == F.col("k"), F.col("after")).otherwise(F.col("_size"))
    count = F.when(F.col("block").isNull(), F.col("k")).otherwise(size + F.col("plain")).cast("long")
    m = m.withColumn("message_count", count).withColumn("step_index", (F.sum(F.col("closes").cast("int")).over(run) - 1).cast("long"))
    return m.drop("_fu", "after", "before", "_size", "plain", "_next")


def steps(msgs: DataFrame) -> DataFrame:
    """Cumulative steps as (step_index, end_ordinal, prefix_block, status, message_count); no message is copied."""
    return marked(msgs).where("closes").select(_J, "step_index", F.col("k").alias("end_ordinal"), F.col("seq").alias("end_seq"), F.col("block").alias("prefix_block"), "status", "message_count")


_MESSAGE = ("role", "content", "calls", *_REST)


def _said(x: Column | None = None) -> Column:
    """A message as a struct of its own, from the columns of messages() or from a struct that has them."""
    return F.struct(*((F.col(c) if x is None else x[c]).alias(c) for c in _MESSAGE))


def digest() -> Column:
    """What a message says, whole: equal messages, calls, results, reasoning and definitions included, have equal digests."""
    return F.sha2(F.to_json(F.struct(*sorted(_MESSAGE)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def _history() -> Column:
    """Everything a journey has said, in order, one array for all of its steps."""
    return F.array_sort(F.collect_list(F.struct("seq", "k", "swap", *_MESSAGE))).alias("_all")


def _in_force(upto: Column, block: Column, said=None) -> Column:
    """The messages of _all in force up to a seq: the block before what is not system, or, without a block, all but swaps."""

    def plain(x: Column) -> Column:
        return ~x["swap"] & (x["seq"] <= upto) & (block.isNull() | (x["role"] != "system"))

    picked = F.concat(F.filter("_all", lambda x: x["swap"] & (x["k"] == block)), F.filter("_all", plain))
    return F.transform(picked, said or (lambda x: _said(x)))


def sft_examples(events: DataFrame) -> DataFrame:
    """A row for each trainable step of a complete journey, with its messages; one exchange.

    Message arrays are quadratic in a journey's length, as the format is.
    """
    m = marked(messages(judged(clean(events)))).where("reason is null")
    step = F.when(F.col("closes") & (F.col("status") == "trainable"), F.struct("step_index", "seq", "block", "status", "message_count"))
    each = m.groupBy(_J).agg(_history(), F.collect_list(step).alias("_steps"))
    out = each.select(_J, "_all", F.explode("_steps").alias("s"))
    return out.select(_J, "s.step_index", F.col("s.seq").alias("end_seq"), F.col("s.block").alias("prefix_block"), "s.status", "s.message_count", _in_force(F.col("s.seq"), F.col("s.block")).alias("messages"))


def message_store(events: DataFrame) -> DataFrame:
    """(digest, message): each message of the kept events once, whoever says it; a step refers to its messages by digest."""
    m = messages(clean(events)).select(digest().alias("digest"), _said().alias("message"))
    return m.groupBy("digest").agg(F.first("message").alias("message"))


def step_digests(events: DataFrame) -> DataFrame:
    """(journey_id, step_index, status, digests): the messages of each step by digest, in order; one exchange.

    A history is spelled out where it is written, and here costs a digest a
    message and step, however long the messages are.
    """
    m = marked(messages(clean(events)).withColumn("digest", digest()))
    step = F.when(F.col("closes"), F.struct("step_index", "seq", "block", "status"))
    each = m.groupBy(_J).agg(F.array_sort(F.collect_list(F.struct("seq", "k", "swap", "role", "digest"))).alias("_all"), F.collect_list(step).alias("_steps"))
    out = each.select(_J, "_all", F.explode("_steps").alias("s"))
    return out.select(_J, "s.step_index", "s.status", _in_force(F.col("s.seq"), F.col("s.block"), lambda x: x["digest"]).alias("digests"))


def spelled_out(steps: DataFrame, store: DataFrame) -> DataFrame:
    """Steps of step_digests() with their messages, from the store, as ``messages``; each message is joined by its digest, and steps are put together again by journey."""
    each = steps.select(_J, "step_index", "status", F.posexplode("digests").alias("_at", "digest")).join(store, "digest")
    found = F.array_sort(F.collect_list(F.struct("_at", "message")), lambda a, b: (a["_at"] - b["_at"]).cast("int"))
    return each.groupBy(_J, "step_index", "status").agg(F.transform(found, lambda x: x["message"]).alias("messages"))


def trajectories(events: DataFrame) -> DataFrame:
    """A row for each journey that has steps, with the messages of its last step, which hold all of its history in force."""
    m = marked(messages(judged(clean(events))))
    last = F.max(F.when(F.col("closes"), F.struct("step_index", "seq", "block", "status", "message_count")))
    each = m.groupBy(_J).agg(_history(), last.alias("s"), F.max("reason").alias("reason")).where("s is not null")
    return each.select(_J, "s.step_index", F.col("s.seq").alias("end_seq"), F.col("s.block").alias("prefix_block"), "s.status", "s.message_count", (F.col("s.step_index") + 1).alias("num_steps"), "reason", _in_force(F.col("s.seq"), F.col("s.block")).alias("messages"))


def dpo_pairs(events: DataFrame) -> DataFrame:
    """Runs of superseded steps directly followed by a trainable one: a row for each rejected step; one exchange.

    The prompt is what the first rejected step saw, without its own last message;
    rejected and chosen are contents, rejected_message and chosen_message whole.
    """
    m = marked(messages(judged(clean(events)))).where("reason is null")
    j = Window.partitionBy(_J)
    earlier = j.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_run", F.when(F.col("closes"), F.coalesce(F.sum(F.when(F.col("closes") & (F.col("status") != "superseded"), 1).otherwise(0)).over(earlier), F.lit(0))))
    r = Window.partitionBy(_J, "_run")
    ends = F.struct("step_index", "status", "content", _said().alias("message"))
    m = m.withColumns({"_end": F.max(ends).over(r), "_first": F.min(F.struct("step_index", "seq", "block")).over(r)})
    pair = F.when(F.col("closes") & (F.col("status") == "superseded") & (F.col("_end.status") == "trainable"), F.struct("step_index", "content", _said().alias("message"), F.col("_end").alias("end"), F.col("_first").alias("first")))
    each = m.groupBy(_J).agg(_history(), F.collect_list(pair).alias("_pairs"))
    out = each.select(_J, "_all", F.explode("_pairs").alias("p"))
    return out.select(_J, F.col("p.step_index").alias("rejected_step"), F.col("p.end.step_index").alias("chosen_step"), _in_force(F.col("p.first.seq") - 1, F.col("p.first.block")).alias("prompt"), F.col("p.content").alias("rejected"), F.col("p.end.content").alias("chosen"), F.col("p.message").alias("rejected_message"), F.col("p.end.message").alias("chosen_message"))


def parts(kept: DataFrame) -> DataFrame:
    """What a journey's kept events say besides its messages, a row a journey.

    reward, termination_reason and error are those of the last event of their
    kind; models and writers are in the order of their first event; model_id is
    the journey's only if it has one.
    """
    kept, at = _whole(kept), F.struct("seq", "arrival")
    of = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, at))

    def seen(c: str) -> Column:
        return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", "arrival", c)))), lambda e: e[c]))

    said = lambda kind, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "arrival", c)))), lambda e: e[c])
    out = kept.groupBy(_J).agg(
        F.count_distinct(F.when(F.col("kind") == "message", F.col("seq"))).alias("messages"),
        said("signal", "signal").alias("signals"),
        said("voice", "voice").alias("voice"),
        of("reward", "reward").alias("aggregated_reward"),
        F.coalesce(of("terminal", "reason"), F.lit("NONE")).alias("termination_reason"),
        of("terminal", "error").alias("error"),
        seen("model_id").alias("model_ids"),
        seen("writer").alias("writers"),
        F.max(F.when(F.col("kind") == "terminal", F.col("seq"))).alias("terminal_seq"),
    )
    return out.withColumn("model_id", F.when(F.size("model_ids") == 1, F.col("model_ids")[0]))


def assemble(events: DataFrame, headers: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """A row for each journey: identity, steps, tool metrics, reward and verdict.

    Identity comes from the header where there is one: data_source (``unknown``
    without), trace_id, started_at and num_turns, which otherwise is the number
    of steps; ``source`` overrides the header's.
    """
    raw = dealt(events)
    kept = terminal_cut(dedupe(raw))
    m = marked(messages(kept))
    agent = F.col("role") == "assistant"
    calls, failed = F.sum(F.when(agent, F.col("calls")).otherwise(0)), F.count_if((F.col("role") == "tool") & (F.coalesce("error", F.lit("")) != ""))
    each = m.groupBy(_J).agg(
        F.count_if("closes").alias("num_steps"),
        F.count_if(F.col("closes") & (F.col("status") == "trainable")).alias("trainable_steps"),
        F.coalesce(F.max_by("message_count", F.when(F.col("closes"), F.col("step_index"))), F.lit(0)).cast("long").alias("messages"),
        calls.cast("long").alias("num_tool_calls"),
        failed.alias("num_tool_failures"),
        F.count_if((F.col("role") == "tool") & F.col("response").isNull()).alias("num_tool_response_none"),
    )
    facts = parts(kept).drop("messages", "signals", "voice", "writers", "terminal_seq")
    out = facts.join(verdicts(raw).select(_J, "complete", F.col("reason").alias("incomplete_reason")), _J).join(each, _J, "left")
    zero = ["num_steps", "trainable_steps", "messages", "num_tool_calls", "num_tool_failures", "num_tool_response_none"]
    out = out.fillna(0, zero)
    rate = F.when(F.col("num_tool_calls") == 0, 0.0).otherwise(F.col("num_tool_failures") / F.col("num_tool_calls"))
    if headers is None:
        known = {"data_source": "string", "trace_id": "string", "started_at": "string", "num_turns": "long"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in known.items()})
    else:
        out = out.join(headers.select(_J, "data_source", "trace_id", "started_at", F.col("num_turns").cast("long").alias("num_turns")), _J, "left")
    name = F.lit(source) if source else F.coalesce("data_source", F.lit("unknown"))
    return out.withColumns({"data_source": name, "num_turns": F.coalesce("num_turns", "num_steps"), "tool_error_rate": rate}).withColumn("task_id", F.concat_ws(":", "data_source", F.col(_J).cast("string")))


def _object(**fields: Column | str) -> Column:
    return F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in sorted(fields.items())))


def journey_documents(events: DataFrame, headers: DataFrame | None = None, source: str | None = None, last_step_only: bool = False) -> DataFrame:
    """(journey_id, conversation_id, document, incomplete_reason): each journey as one JSON object, its steps cumulative.

    The object has task, steps, metrics, execution_metrics, reward, model_id,
    trace_id, error and telemetry with the content hash, which is taken before
    the reward's sum, the number of turns and the steps' statuses are filled in.
    What the fold found stands under ``_diagnostics``, complete or not.
    last_step_only writes the last step, which holds all messages in force.
    Null fields are left out.
    """
    facts = assemble(events, headers, source)
    m = marked(messages(clean(events)))
    step = F.when(F.col("closes"), F.struct("step_index", "seq", "block", "status"))
    history = F.array_sort(F.collect_list(F.struct("seq", "k", "swap", *_MESSAGE, "status"))).alias("_all")
    each = m.groupBy(_J).agg(history, F.array_sort(F.collect_list(step)).alias("_steps"))

    def held(s: Column) -> Column:
        def plain(x: Column) -> Column:
            return ~x["swap"] & (x["seq"] <= s["seq"]) & (s["block"].isNull() | (x["role"] != "system"))

        picked = F.concat(F.filter("_all", lambda x: x["swap"] & (x["k"] == s["block"])), F.filter("_all", plain))
        return F.transform(picked, lambda x: _object(role=x["role"], content=x["content"], reasoning=x["reasoning"], tool_calls=F.when(F.size(x["tool_calls"]) > 0, F.transform(x["tool_calls"], lambda c: _object(name=c["name"], arguments=c["arguments"], id=c["id"]))), tool_definitions=F.when(F.size(x["tool_definitions"]) > 0, F.transform(x["tool_definitions"], lambda d: _object(name=d["name"], description=d["description"], parameters=d["parameters"]))), tool_response=F.when(x["role"] == "tool", _object(id=x["tool_id"], name=x["tool_name"], response=x["response"], error=x["error"])), trainable_status=x["status"]))

    rows = facts.join(each, _J, "left").withColumn("_steps", F.coalesce("_steps", F.array().cast(each.schema["_steps"].dataType)))
    bare = F.transform("_steps", lambda s: _object(messages=held(s)))
    task = {"conversation_id": F.col(_J).cast("string"), "data_source": F.col("data_source"), "id": F.col("task_id"), "num_steps": F.col("num_steps")}
    metrics = {"num_tool_calls": F.col("num_tool_calls"), "num_tool_failures": F.col("num_tool_failures"), "steps": F.col("num_steps"), "tool_error_rate": F.col("tool_error_rate")}
    shared = {"execution_metrics": _object(termination_reason="termination_reason"), "model_id": F.col("model_id"), "reward": F.when(F.col("aggregated_reward").isNotNull(), _object(aggregated_value="aggregated_reward"))}
    hashed = _object(task=_object(**task), steps=bare, metrics=_object(**metrics), **shared)
    written = F.slice("_steps", -1, 1) if last_step_only else F.col("_steps")
    trimmed = F.when((F.size("_steps") > 1) & F.lit(last_step_only), "last")
    steps_ = F.transform(F.when(F.size("_steps") > 0, written).otherwise(F.col("_steps")), lambda s: _object(messages=held(s), trainable_status=s["status"]))
    told = _object(complete="complete", incomplete_reason="incomplete_reason", journey_id=F.col(_J).cast("string"), model_ids="model_ids", steps_written=trimmed, terminated=F.col("termination_reason") != "NONE")
    telemetry = _object(source="data_source", data=_object(conversation_id=F.col(_J).cast("string"), trace_id="trace_id"))
    filled = metrics | {"aggregated_reward": F.col("aggregated_reward"), "num_tool_response_none": F.col("num_tool_response_none")}
    doc = _object(task=_object(**task, num_turns=F.col("num_turns")), steps=steps_, metrics=_object(**filled), telemetry=telemetry, trace_id="trace_id", error="error", _diagnostics=told, **shared)
    rows = rows.select(_J, F.col(_J).cast("string").alias("conversation_id"), F.to_json(doc).alias("_doc"), F.to_json(hashed).alias("_hashed"), "incomplete_reason")

    def stamp(frames):
        for f in frames:
            f["document"] = [canonical.stamped(d, c) for d, c in zip(f.pop("_doc"), f.pop("_hashed"), strict=True)]
            yield f[[_J, "conversation_id", "document", "incomplete_reason"]]

    return rows.mapInPandas(stamp, f"{_J} {rows.schema[_J].dataType.simpleString()}, conversation_id string, document string, incomplete_reason string")


def collected(scanned: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events by their own journey_id, whatever file they came in, and a header a journey, that of its first file by path.

    scanned has journey_id, path and what the fold reads; headers has path.
    """
    first = scanned.groupBy(_J).agg(F.min("path").alias("path"))
    return scanned.drop("path"), first.join(headers, "path").drop("path")


KINDS = ("message", "signal", "reward", "terminal", "voice")


def diagnostics(events: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """What each journey would give: counts by kind over all events as they arrived, then the fold's findings and the drain's."""
    raw = dealt(events)
    counted = raw.groupBy(_J).agg(
        F.count("*").alias("events"),
        *(F.count_if(F.col("kind") == k).alias(f"{k}s" if k != "voice" else k) for k in KINDS),
        F.max("seq").cast("long").alias("highest_seq"),
        F.array_join(F.array_sort(F.collect_set("writer")), ",").alias("writers"),
    )
    found = verdicts(raw).select(_J, "missing", F.col("duplicates").alias("duplicates_dropped"), "terminated", F.col("complete").alias("trainable"), F.col("reason").alias("problem"))
    out = counted.join(found, _J)
    if acks is None:
        return out
    out = out.join(acks.select(_J, F.col("ack").alias("watermark")), _J, "left")
    left = raw.join(acks.select(_J, "ack"), _J, "left").where(F.col("seq") > F.coalesce("ack", F.lit(-1))).groupBy(_J).agg(F.count("*").alias("undrained"))
    return out.join(left, _J, "left").fillna(0, ["undrained"])
