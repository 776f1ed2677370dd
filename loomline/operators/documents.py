"""Curation of journey documents (path, document): cleaning, review, validation, splitting, versions, recipes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import canonical, documents
from loomline.operators import corpus
from loomline.operators.text import latest
from loomline.sources import layouts


def with_facts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_f", documents.facts(F.col("document"))).select("*", "_f.*").drop("_f")


def dedupe(docs: DataFrame) -> DataFrame:
    """The first document by path of each content hash, the stamped one where there is one; documents that can't be read stay."""
    hashed = docs.select("path", F.coalesce(documents.facts(F.col("document"))["content_hash"], F.concat(F.lit("?"), "path")).alias("_h"))
    first = hashed.groupBy("_h").agg(F.min("path").alias("path")).select("path")
    return docs.join(first, "path", "left_semi")


def clean(docs: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """dedupe(), then dead turns, encoding and, where rules are given, personal data; with the count of each (path, document, dead_turns, repairs, scrubs)."""
    return dedupe(docs).select("path", documents.cleaned(F.col("document"), rules).alias("c")).select("path", "c.*")


def byod(raw: DataFrame, provider: str, source: str) -> DataFrame:
    """(path, document, error): raw exports (path, stem, document) of a provider's format as journey documents; a file that can't be read gives its error."""
    made = raw.select("path", documents.made_document(F.col("document"), F.col("stem"), provider, source).alias("m"))
    return made.select("path", "m.document", "m.error")


def review_queue(docs: DataFrame) -> DataFrame:
    return with_facts(docs).select(F.coalesce("journey_id", "path").alias("journey_id"), "content_hash", "preview")


def review(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents with a decision (journey_id, approved, score, notes), annotated; the last decision by line_no counts."""
    if "line_no" in decisions.columns:
        decisions = latest(decisions, ["journey_id"], "line_no")
    d = decisions.select(F.col("journey_id").cast("string").alias("_id"), "approved", F.col("score").cast("double").alias("score"), "notes")
    both = with_facts(docs).join(d, F.coalesce("journey_id", "path") == F.col("_id"))
    return both.select("path", documents.annotated(F.col("document"), F.col("approved"), F.col("score"), F.col("notes")).alias("document"))


def validate(docs: DataFrame, rules: Sequence[str] | None = None, splits: DataFrame | None = None, baseline: DataFrame | None = None, threshold: float = 0.2) -> DataFrame:
    """(path, error): the gate.  Documents' errors; with splits (id, split) leaks; with a baseline (name, value) drift of the corpus' statistics."""
    out = docs.select("path", F.explode(documents.found_errors(F.col("document"), rules)).alias("error"))
    if splits is not None:
        leaks = corpus.leakage(splits)
        out = out.unionByName(leaks.select(F.lit(None).cast("string").alias("path"), F.concat(F.col("id").cast("string"), F.lit(" appears in "), "splits").alias("error")))
    if baseline is not None:
        moved = corpus.drift(stats(docs), baseline, threshold)
        out = out.unionByName(moved.select(F.lit(None).cast("string").alias("path"), F.concat("name", F.lit(": drifted")).alias("error")))
    return out


def stats(docs: DataFrame) -> DataFrame:
    """(name, value): journeys, mean steps, mean messages of the last step."""
    f = documents.facts(F.col("document"))
    s = docs.select(f.alias("f")).agg(F.count("*").cast("double").alias("journeys"), F.coalesce(F.avg("f.n_steps"), F.lit(0.0)).alias("mean_steps"), F.coalesce(F.avg("f.n_messages"), F.lit(0.0)).alias("mean_messages"))
    return s.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("journeys", "mean_messages", "mean_steps")))))


def split(docs: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """Documents with their split; those of one group stay together.  Written with partitionBy("split") this is a folder a split."""
    key = F.coalesce(documents.facts(F.col("document"))["group_key"], F.lit("unknown"))
    return docs.withColumn("group_key", key).withColumn("split", corpus.assign_split(F.col("group_key"), ratios)).drop("group_key")


def watermark(pairs: DataFrame) -> str:
    """Hash of the sorted (id, content_hash) pairs of a corpus as one canonical list.

    The pairs are sorted by the cluster and pass through the driver one after
    the other, so its memory doesn't grow with them; a digest can't be taken in
    any other order.  corpus.watermark_table() is the tree for corpora where
    that takes too long.
    """
    digest, n = hashlib.sha256(b"["), 0
    rows = pairs.select(F.col("id").cast("string").alias("id"), F.col("content_hash").cast("string").alias("h")).orderBy("id", "h")
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if not r["id"]:
            raise ValueError("a curated journey has no id")
        digest.update(("," if n else "").encode() + json.dumps([r["id"], r["h"]], separators=(",", ":"), ensure_ascii=False).encode())
        n += 1
    digest.update(b"]")
    return digest.hexdigest()


def curated_watermark(docs: DataFrame, seq: int) -> dict:
    return {"seq": seq, "hash": watermark(with_facts(docs).select(F.col("journey_id").alias("id"), "content_hash"))}


def corpus_version(recipe_hash: str, mark: dict) -> str:
    return canonical.content_hash({"recipe": recipe_hash, "watermark": mark})


@dataclass(frozen=True)
class Stage:
    stage: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    """A named, versioned list of stages; their order is part of its meaning."""

    name: str
    stages: list[Stage]
    version: int = 1

    def digest(self) -> str:
        return canonical.content_hash({"name": self.name, "version": self.version, "stages": [{"stage": s.stage, "params": s.params} for s in self.stages]})


def recipe(doc) -> Recipe:
    """A recipe from its document; what is missing or of the wrong kind is a ValueError."""

    def must(ok, what: str) -> None:
        if not ok:
            raise ValueError(what)

    must(isinstance(doc, dict), "a recipe is a mapping")
    must(isinstance(doc.get("name"), str) and doc["name"], "name: required, a string")
    must(isinstance(doc.get("stages"), list) and doc["stages"], "stages: required, a list")
    must(isinstance(doc.get("version", 1), int), "version: an integer")
    stages = []
    for i, s in enumerate(doc["stages"]):
        must(isinstance(s, dict) and isinstance(s.get("stage"), str), f"stages[{i}]: a mapping with a stage")
        must(isinstance(s.get("params", {}), dict), f"stages[{i}].params: a mapping")
        stages.append(Stage(s["stage"], s.get("params", {})))
    return Recipe(doc["name"], stages, doc.get("version", 1))


def load_recipe(uri: str) -> Recipe:
    return recipe(layouts.document(uri))


#: Stages by name; each takes documents and the recipe's parameters.  Register others here.
STAGES: dict[str, Callable[..., DataFrame]] = {
    "collection": lambda docs: docs.dropDuplicates(["path"]),
    "normalization": lambda docs, format, data_source: byod(docs.withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")), format, data_source).where("error is null").drop("error"),
    "cleaning": lambda docs, pii_rules=None: clean(docs, pii_rules).select("path", "document"),
    "validation": lambda docs, pii_rules=None: validate(docs, pii_rules),
    "splitting": lambda docs, ratios=None: split(docs, ratios),
}


@dataclass(frozen=True)
class Outcome:
    """What a recipe has made; where the gate stopped it, the errors."""

    data: DataFrame
    ok: bool = True
    failed_stage: str | None = None
    errors: DataFrame | None = None


def run(made: Recipe, docs: DataFrame) -> Outcome:
    """A recipe's stages in order.  Validation is a gate: it passes its input on, or ends the run.  Splitting comes last."""
    for i, s in enumerate(made.stages):
        if s.stage not in STAGES:
            raise ValueError(f"unknown stage {s.stage!r}; known: {sorted(STAGES)}")
        if s.stage == "splitting" and i != len(made.stages) - 1:
            raise ValueError("splitting must be the last stage")
    for s in made.stages:
        out = STAGES[s.stage](docs, **s.params)
        if s.stage != "validation":
            docs = out
        elif out.limit(1).count():
            return Outcome(docs, False, s.stage, out)
    return Outcome(docs)
