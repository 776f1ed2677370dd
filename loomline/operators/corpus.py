"""Corpus operators: splits, leakage, statistics, drift, reviews, versions, evaluation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.text import latest, strip

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def group_key(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty, else ``unknown``."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in candidates), F.lit("unknown"))


def assign_split(key: Column, ratios: dict[str, float] | None = None) -> Column:
    """The split of a group: the first, by name, whose cumulative share lies above the group's hash on [0, 1]; the last for a hash of 1."""
    ratios = ratios or RATIOS
    total, upto, out = sum(ratios.values()), 0.0, None
    where = F.conv(F.substring(F.sha2(F.to_json(F.struct(key.alias("group_key"))), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
    names = sorted(ratios)
    for name in names[:-1]:
        upto += ratios[name] / total
        out = F.when(where < upto, name) if out is None else out.when(where < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def leakage(members: DataFrame, key: str = "id", split: str = "split") -> DataFrame:
    """Ids in more than one split."""
    found = members.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1).select(key, F.array_join("splits", ",").alias("splits"))


def corpus_stats(steps: DataFrame) -> DataFrame:
    """Journeys, mean steps and mean messages of the last step; zeros for an empty corpus."""
    each = steps.groupBy("journey_id").agg(F.count("*").alias("n"), F.max_by("message_count", "step_index").alias("m"))
    return each.agg(F.count("*").alias("journeys"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_steps"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_messages"))


def drift(current: DataFrame, baseline: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Statistics (name, value) whose relative change exceeds the threshold; a base of 0 is skipped."""
    b = baseline.select("name", F.col("value").alias("base"))
    change = F.abs(F.col("value") - F.col("base")) / F.abs("base")
    return current.join(b, "name").where(F.col("base") != 0).withColumn("change", change).where(F.col("change") > threshold)


def apply_reviews(journeys: DataFrame, decisions: DataFrame, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Journeys with a decision, with its verdict, notes and scaled score; of several decisions on one the last by line_no counts."""
    if hi <= lo:
        raise ValueError("hi must be above lo")
    if "line_no" in decisions.columns:
        decisions = latest(decisions, ["journey_id"], "line_no").drop("line_no")
    out = journeys.join(decisions, "journey_id").withColumn("scaled", (F.col("score") - lo) / (hi - lo))
    return out.withColumn("approved", F.coalesce("approved", F.lit(False)))


def unmatched(decisions: DataFrame, journeys: DataFrame) -> DataFrame:
    """Ids of decisions on journeys that aren't there."""
    return decisions.select("journey_id").distinct().join(journeys, "journey_id", "left_anti")


def watermark(pairs: list[tuple[str, str]]) -> str:
    """Hash of the sorted (id, content hash) pairs of a curated corpus."""
    if any(not i for i, _ in pairs):
        raise ValueError("a curated journey has no id")
    return hashlib.sha256(json.dumps(sorted(map(list, pairs)), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def watermark_table(pairs: DataFrame, leaf: int = 64) -> DataFrame:
    """Hash of a corpus of any size: a tree over its (id, content_hash) pairs, and their number.

    Pairs are sorted by hash prefix into leaves of about ``leaf`` pairs, whose
    hashes are hashed in turn; a level has a 64th of the nodes of the one below,
    so no row holds more than some leaf of them at any size.
    """
    h = F.sha2(F.to_json(F.struct("id", "content_hash")), 256)
    level = pairs.select(h.alias("h"), F.lit(1).cast("long").alias("n"))
    total = pairs.count()
    depth = max(0, -(-(max(total, 1).bit_length() - 1) // 6) - 1)
    key = F.substring(F.col("h"), 1, 15)
    level = level.withColumn("at", F.conv(key, 16, 10).cast("long"))
    for d in range(depth, -1, -1):
        node = F.shiftright("at", 60 - 6 * d) if d else F.lit(0).cast("long")
        level = level.groupBy(node.alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ","), 256).alias("h"), F.sum("n").alias("n"), F.min("at").alias("at")).drop("node")
    if not total:
        return pairs.sparkSession.createDataFrame([(hashlib.sha256(b"").hexdigest(), 0)], "watermark string, members long")
    return level.select(F.col("h").alias("watermark"), F.col("n").alias("members"))


#: Metrics by name; each makes a score column of a response and a reference.  Register others here.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "exact_match": lambda a, b: (strip(a) == strip(b)).cast("double"),
    "tool_call_accuracy": lambda a, b: F.lit(1.0) - F.coalesce(F.get_json_object(a, "$.tool_error_rate").try_cast("double"), F.lit(0.0)),
}


def eval_run(tasks: DataFrame, completions: DataFrame, score) -> DataFrame:
    """Tasks with the score of their completion; a missing one scores 0 and is flagged.

    score is a name of METRICS or takes two columns.  Of several completions of
    an id the last by line_no counts; without that column ids must be unique.
    """
    score = METRICS[score] if isinstance(score, str) else score
    c = latest(completions, ["id"], "line_no") if "line_no" in completions.columns else completions
    c = c.select("id", "response")
    return tasks.join(c, "id", "left").select("id", F.when(F.col("response").isNull(), 0.0).otherwise(score(F.col("response"), F.col("reference")).cast("double")).alias("score"), F.col("response").isNull().alias("missing"))


def eval_summary(run: DataFrame) -> DataFrame:
    """Mean score over all tasks, 0 without any, their number and that of the missing."""
    return run.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count("*").alias("num_tasks"), F.count_if("missing").alias("num_missing"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Score of b less that of a for the tasks of either."""
    return a.select("id", F.col("score").alias("a")).join(b.select("id", F.col("score").alias("b")), "id", "full").select("id", (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))
