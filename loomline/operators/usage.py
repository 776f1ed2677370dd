"""Tokens and cost that providers report with messages: read from their JSON in the JVM, summed by turn and by journey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_J = "journey_id"
#: Names that providers give their counts, the first one present counts.  Fixed values.
NAMES = {
    "prompt_tokens": ("prompt_tokens", "input_tokens", "promptTokens", "inputTokens", "promptTokenCount"),
    "completion_tokens": ("completion_tokens", "output_tokens", "completionTokens", "outputTokens", "candidatesTokenCount"),
    "total_tokens": ("total_tokens", "totalTokens", "totalTokenCount"),
    "total_cost": ("total_cost", "cost"),
}
COUNTS = tuple(NAMES)


def reported(usage: Column) -> Column:
    """(prompt_tokens, completion_tokens, total_tokens, total_cost) of a usage object's JSON, null where it says nothing.

    Without a total of its own it is the sum of the two others.  What is no
    number counts as not said, and so does all of what is no object.
    """
    said = F.try_parse_json(usage)

    def read(name: str) -> Column:
        kind = "double" if name == "total_cost" else "bigint"
        return F.coalesce(*(F.try_variant_get(said, f"$.{n}", kind) for n in NAMES[name]))

    prompt, completion = read("prompt_tokens"), read("completion_tokens")
    both = F.when(prompt.isNotNull() | completion.isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(read("total_tokens"), both).alias("total_tokens"), read("total_cost").alias("total_cost"))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(F.coalesce(F.col(f"_u.{c}"), F.lit(0))).alias(c) for c in COUNTS]
    return rows.groupBy(*keys).agg(F.count("*").alias("messages"), *sums)


def turns(messages: DataFrame) -> DataFrame:
    """Messages (journey_id, seq, role, ...) with their turn, from 0: each user message after another's begins one."""
    order = Window.partitionBy(_J).orderBy("seq")
    before = F.lag("role").over(order)
    begins = (F.col("role") == "user") & before.isNotNull() & (before != "user")
    return messages.withColumn("_b", F.coalesce(begins.cast("long"), F.lit(0))).withColumn("turn", F.sum("_b").over(order)).drop("_b")


def by_turn(messages: DataFrame) -> DataFrame:
    """Sums of what messages (journey_id, seq, role, usage) report, by journey and turn; nothing said counts as 0.  One exchange, by journey."""
    return _sums(turns(messages).withColumn("_u", reported(F.col("usage"))), [_J, "turn"])


def by_journey(messages: DataFrame) -> DataFrame:
    """Sums of what messages (journey_id, usage) report, by journey: added up before they are shuffled, and null where they come to 0."""
    rows = messages.select(_J, reported(F.col("usage")).alias("_u"))
    return _sums(rows, [_J]).withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in COUNTS})
