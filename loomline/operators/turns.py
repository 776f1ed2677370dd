"""Turns from what producers record: utterances, tool turns, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import parsers

_J = "journey_id"
_CALLS = "array<struct<name:string,arguments:string,id:string>>"
#: Why a session closed, as a termination reason.  Fixed values.
CLOSE_REASONS = {"error": "ERROR", "job_shutdown": "TRUNCATION", "participant_disconnected": "ENV_DONE", "user_initiated": "ENV_DONE", "task_completed": "ENV_DONE"}
#: Roles of a live session.  Fixed values.
SESSION_ROLES = {"developer": "system", "system": "system", "user": "user", "assistant": "assistant"}


def _looked_up(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def close_reason(said: Column) -> Column:
    return F.coalesce(_looked_up(CLOSE_REASONS, said), F.lit("ENV_DONE"))


def session_role(role: Column) -> Column:
    """The role of a message, null for what is no message of the journey."""
    return _looked_up(SESSION_ROLES, role)


def islands(items: DataFrame) -> DataFrame:
    """items (journey_id, at, kind, role, text, interrupted, confidence) with the number of the utterance each belongs to.

    A new one begins with another role, after an interrupted part, and after
    anything that is no speech (kind other than ``item``): a tool turn, a new
    prompt, a signal, the end.  Items of an unknown role or without text go.
    """
    role = session_role(F.col("role"))
    spoken = (F.col("kind") != "item") | (role.isNotNull() & F.col("text").isNotNull())
    rows = items.withColumn("role", F.when(F.col("kind") == "item", role)).where(spoken)
    w = Window.partitionBy(_J).orderBy("at")
    before = lambda c: F.lag(c).over(w)
    same = (before("kind") == "item") & (before("role") == F.col("role")) & ~F.coalesce(before("interrupted"), F.lit(False))
    return rows.withColumn("island", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))


def utterances(items: DataFrame) -> DataFrame:
    """(journey_id, island, role, at, parts, text, interrupted, confidence): speech joined by a space.

    Confidence is the mean over the scored parts, weighted by the length of
    their text; a part without text weighs 1.
    """
    rows = islands(items).where("kind = 'item'")
    weight = F.when(F.col("confidence").isNotNull(), F.greatest(F.length("text"), F.lit(1)))
    words = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("at", "text"))))
    return rows.groupBy(_J, "island", "role").agg(
        F.min("at").alias("at"),
        F.count("*").alias("parts"),
        F.array_join(F.transform(words, lambda x: x["text"]), " ").alias("text"),
        F.coalesce(F.max("interrupted"), F.lit(False)).alias("interrupted"),
        (F.sum(F.col("confidence") * weight) / F.sum(weight)).alias("confidence"),
    )


def tool_turns(items: DataFrame) -> DataFrame:
    """Messages (journey_id, at, part, role, content, calls, response, error, interrupted, tool_calls, tool_id, tool_name) of speech and tool rows.

    Rows of kind ``tool`` have calls, an array of (id, name, arguments, output,
    failed).  The agent's utterance right before one joins it: speech and calls
    are one message, with the calls as tool_calls; each result is a message of its
    own, with its call's id and name.
    """
    w = Window.partitionBy(_J).orderBy("at")
    said = utterances(items).withColumn("kind", F.lit("item")).select(_J, "at", "kind", "role", "text", "interrupted", F.lit(None).cast(items.schema["calls"].dataType).alias("calls"))
    other = items.where((F.col("kind") != "item") & ((F.col("kind") != "tool") | (F.size("calls") > 0))).select(_J, "at", "kind", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("interrupted"), "calls")
    rows = said.unionByName(other)
    tool, speech = F.col("kind") == "tool", (F.col("kind") == "item") & (F.col("role") == "assistant") & ~F.col("interrupted")
    rows = rows.withColumns({"_joins": F.coalesce(speech & (F.lead("kind").over(w) == "tool"), F.lit(False)), "_speech": F.when(tool & F.lag(speech).over(w), F.lag("text").over(w))})
    rows = rows.where(~F.col("_joins") & ((F.col("kind") == "item") | tool))
    none = F.lit(None).cast("string")
    message = lambda part, role, content, n, response, error, cut, calls=None, tool_id=None, name=None: F.struct(part.cast("int").alias("part"), role.alias("role"), content.alias("content"), n.cast("int").alias("calls"), response.alias("response"), error.alias("error"), cut.alias("interrupted"), (F.lit(None).cast(_CALLS) if calls is None else calls).alias("tool_calls"), (none if tool_id is None else tool_id).alias("tool_id"), (none if name is None else name).alias("tool_name"))
    plain = message(F.lit(0), F.col("role"), F.col("text"), F.lit(0), none, none, F.col("interrupted"))
    called = message(F.lit(0), F.lit("assistant"), F.col("_speech"), F.size("calls"), none, none, F.lit(False), F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"), c["id"].alias("id"))))
    results = F.transform("calls", lambda c, i: message(i + 1, F.lit("tool"), none, F.lit(0), c["output"], F.when(F.coalesce(c["failed"], F.lit(False)) & c["output"].isNotNull(), "tool_error"), F.lit(False), tool_id=c["id"], name=c["name"]))
    out = rows.select(_J, "at", F.explode(F.when(tool, F.concat(F.array(called), results)).otherwise(F.array(plain))).alias("m"))
    return out.select(_J, "at", "m.*")


def span_events(spans: DataFrame) -> DataFrame:
    """Events of journeys from spans (trace_id, span_id, parent_id, ended, ok, description, attributes map, events array<struct<name, attributes>>).

    A journey is a trace.  Spans that name a model or its system say its turns:
    what went in, then what came out, each from the attribute of messages, else
    from the span's content event, else from the older attribute.  The root's
    end ends the journey.
    """
    a = F.col("attributes")

    def first(*keys: str) -> Column:
        return F.coalesce(*(F.element_at(a, F.lit(k)) for k in keys))

    def content(side: str, event: str) -> Column:
        told = F.filter("events", lambda e: (e["name"] == f"gen_ai.content.{event}") & e["attributes"][f"gen_ai.{event}"].isNotNull())
        return F.coalesce(F.element_at(a, F.lit(f"gen_ai.{side}.messages")), F.get(told, F.lit(0))["attributes"][f"gen_ai.{event}"], F.element_at(a, F.lit(f"gen_ai.{event}")))

    model, system = first("gen_ai.request.model", "gen_ai.response.model"), first("gen_ai.system", "gen_ai.provider.name")
    turns = spans.where(model.isNotNull() | system.isNotNull())
    sides = F.array(F.struct(F.lit(0).alias("side"), content("input", "prompt").alias("payload")), F.struct(F.lit(1).alias("side"), content("output", "completion").alias("payload")))
    turns = turns.select(F.col("trace_id").alias(_J), "ended", "span_id", model.alias("model_id"), F.inline(sides)).where("payload is not null")
    turns = turns.select(_J, "ended", "span_id", "model_id", "side", F.posexplode(parsers.lenient_messages(F.col("payload"))).alias("idx", "m"))
    said = turns.select(_J, "ended", "span_id", "side", "idx", F.lit("message").alias("kind"), "m.role", "m.content", F.col("m.calls").alias("calls"), "model_id", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"))
    ends = spans.where("parent_id is null").select(F.col("trace_id").alias(_J), "ended", "span_id", F.lit(2).alias("side"), F.lit(0).alias("idx"), F.lit("terminal").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("calls"), F.lit(None).cast("string").alias("model_id"), F.when(F.col("ok"), "ENV_DONE").otherwise("ERROR").alias("reason"), F.when(~F.col("ok"), F.col("description")).alias("error"))
    w = Window.partitionBy(_J).orderBy("ended", "side", "span_id", "idx")
    rows = said.unionByName(ends).withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
    return rows.select(_J, "seq", "kind", F.concat_ws("-", F.col(_J).cast("string"), F.col("seq").cast("string")).alias("event_id"), "role", "content", "calls", "model_id", "reason", "error")


def changed(calls: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """calls with each of ``columns`` (a prompt, tool definitions) only where it differs from the call before; null elsewhere."""
    w = Window.partitionBy(_J).orderBy(order)
    return calls.withColumns({f"new_{c}": F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.col(c)) for c in columns})
