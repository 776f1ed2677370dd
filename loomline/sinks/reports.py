"""Small documents about results: manifests, registries, cards, evaluation reports, the text view of a journey."""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources import files, layouts, wire


def _dump(doc) -> bytes:
    return (json.dumps(doc, indent=2, sort_keys=True) + "\n").encode()


def _put(uri: str, data: bytes) -> str:
    files.write_whole(uri, data, uuid.uuid4().hex)
    return uri


def next_version(name: str, root: str) -> int:
    """One more than the highest version of a corpus, 1 for the first."""
    fs, path = files.opened(f"{root.rstrip('/')}/{name}")
    found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    stems = [f.base_name.removesuffix(".json").removeprefix("v") for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json")]
    return max((int(s) for s in stems if s.isdecimal()), default=0) + 1


def manifest(spark: SparkSession, name: str, root: str, shards: str, corpus_version: str, recipe_hash: str, watermark: dict) -> dict:
    """The manifest of a corpus version: its shards' digests and line counts are taken from the files."""
    found = wire.shard_inventory(spark, shards).orderBy("path").select("path", "sha256", F.col("lines").alias("rows")).collect()
    return {"name": name, "version": next_version(name, root), "corpus_version": corpus_version, "recipe_hash": recipe_hash, "curated_watermark": watermark, "shards": [r.asDict() for r in found]}


def write_manifest(doc: dict, root: str) -> str:
    return _put(f"{root.rstrip('/')}/{doc['name']}/v{doc['version']}.json", _dump(doc))


def register(uri: str, name: str, manifest_uri: str, group: str = "corpora") -> dict:
    """Put a manifest's version into a registry, in the place of an entry of that version, and keep versions sorted."""
    data = b"".join(files.read_from(manifest_uri, 0))
    version = json.loads(data)["version"]
    doc = layouts.document(uri) or {}
    entries = [v for v in doc.setdefault(group, {}).get(name) or [] if v.get("version") != version]
    entries.append({"version": version, "manifest_sha256": hashlib.sha256(data).hexdigest(), "uri": manifest_uri})
    doc[group][name] = sorted(entries, key=lambda v: v["version"])
    _put(uri, _dump(doc))  # JSON is YAML
    return doc


def card(doc: dict, licence: str, pii_posture: str, intended_use: str, splits: str | None = None) -> str:
    """The text that goes with a corpus version; licence, posture and use are what the curator says."""
    facts = [f"- {k}: `{doc[k]}`" for k in ("corpus_version", "recipe_hash", "curated_watermark")]
    facts.append(f"- shards: {len(doc['shards'])} ({sum(s['rows'] for s in doc['shards'])} rows total)")
    sections = {"Provenance": "\n".join(facts), "License": licence, "PII posture": pii_posture, "Splits": splits or "Not yet split.", "Intended use": intended_use}
    return f"# {doc['name']} v{doc['version']}\n\n" + "\n\n".join(f"## {k}\n{v}" for k, v in sections.items()) + "\n"


def write_card(doc: dict, root: str, **said: str) -> str:
    return _put(f"{root.rstrip('/')}/{doc['name']}-v{doc['version']}.md", card(doc, **said).encode())


def write_experiment(root: str, name: str, config: dict, corpus_version: str, **facts) -> str:
    """The manifest of a training run: its configuration and the corpus version it used."""
    return _put(f"{root.rstrip('/')}/{name}.json", _dump({"name": name, "config": config, "corpus_version": corpus_version, **facts}))


def resolve_model(versions: DataFrame, name: str, version: int | None = None, alias: str | None = None) -> DataFrame:
    """The entry of a model by its version or by an alias (never both); versions: name, version, aliases array<string>."""
    if (version is None) == (alias is None):
        raise ValueError("give a version or an alias")
    found = versions.where(F.col("name") == name)
    return found.where(F.col("version") == version) if alias is None else found.where(F.array_contains("aliases", alias))


def eval_report(benchmark: str, metric: str, run: DataFrame) -> dict:
    """A run (id, score, missing) as a report; as many rows as the benchmark has tasks come to the driver."""
    tasks = [{"id": str(r["id"]), "score": r["score"], "missing": r["missing"]} for r in run.orderBy("id").collect()]
    mean = sum(t["score"] for t in tasks) / len(tasks) if tasks else 0.0
    return {"benchmark": benchmark, "metric": metric, "mean_score": mean, "num_tasks": len(tasks), "num_missing": sum(t["missing"] for t in tasks), "tasks": tasks}


def report_text(report: dict) -> str:
    lines = [f"- {t['id']}: {t['score']:.4f}" + (" (missing)" if t["missing"] else "") for t in report["tasks"]]
    return f"# {report['benchmark']}\n\n- metric: {report['metric']}\n- mean score: {report['mean_score']:.4f}\n- tasks: {report['num_tasks']} ({report['num_missing']} missing)\n\n" + ("\n".join(lines) or "(no tasks)") + "\n"


def write_report(report: dict, root: str) -> tuple[str, str]:
    """The report as JSON and as text."""
    base = f"{root.rstrip('/')}/{report['benchmark']}"
    return _put(f"{base}.json", _dump(report)), _put(f"{base}.md", report_text(report).encode())


def compare_reports(a: dict, b: dict) -> dict:
    """What b scores above a, task by task; a task that one lacks scores 0 there."""
    one, two = ({t["id"]: t["score"] for t in r["tasks"]} for r in (a, b))
    deltas = {i: two.get(i, 0.0) - one.get(i, 0.0) for i in sorted(one.keys() | two.keys())}
    return {"a": a["benchmark"], "b": b["benchmark"], "mean_delta": sum(deltas.values()) / len(deltas) if deltas else 0.0, "tasks": deltas}


def _short(text: Column, n: int) -> Column:
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n - 1), F.lit("…"))).otherwise(line)


def rendered(kept: DataFrame, messages: DataFrame, verdicts: DataFrame, width: int = 74) -> DataFrame:
    """(journey_id, text): each journey as a conversation with the marks of its turns, then what training would take from it."""
    status = messages.select("journey_id", "seq", "status")
    e = kept.join(status, ["journey_id", "seq"], "left")
    body = F.when(F.coalesce("calls", F.lit(0)) > 0, F.concat(F.lit("call × "), F.col("calls").cast("string"), F.lit(" "), _short(F.col("content"), width))).when(F.col("role") == "tool", F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR "), "error")).otherwise(F.concat(F.lit("result "), _short(F.col("response"), width)))).otherwise(_short(F.col("content"), width))
    mark = F.when(F.col("status") == "trainable", F.lit("  ★ trainable")).when(~F.col("status").isin("trainable", "not_trainable"), F.concat(F.lit("  ["), "status", F.lit("]"))).otherwise("")
    said = (
        F.when(F.col("kind") == "message", F.concat(F.rpad("role", 10, " "), body, F.coalesce(mark, F.lit(""))))
        .when(F.col("kind") == "signal", F.concat(F.rpad("kind", 10, " "), "signal", F.lit(" → seq "), F.col("target_seq").cast("string")))
        .when(F.col("kind") == "reward", F.concat(F.rpad("kind", 10, " "), F.col("reward").cast("string")))
        .when(F.col("kind") == "terminal", F.concat(F.rpad("kind", 10, " "), "reason", F.coalesce(F.concat(F.lit(" — "), "error"), F.lit(""))))
    )
    lines = e.where(F.col("kind") != "voice").select("journey_id", F.struct("seq", "arrival", F.concat(F.lpad(F.col("seq").cast("string"), 5, " "), F.lit(" "), F.coalesce(said, F.lit(""))).alias("line")).alias("l"), (F.col("status") == "superseded").alias("_s"), (F.col("signal") == "thumbs_down").alias("_d"))
    each = lines.groupBy("journey_id").agg(F.array_sort(F.collect_list("l")).alias("l"), F.count("*").alias("n"), F.count_if("_s").alias("superseded"), F.count_if("_d").alias("down"))
    v = verdicts.select("journey_id", "complete", "reason")
    head = F.concat(F.lit("journey "), F.col("journey_id").cast("string"), F.lit("\n  "), F.col("n").cast("string"), F.lit(" events · "), F.when(F.col("complete"), "TRAINABLE").otherwise("NOT TRAINABLE"), F.coalesce(F.concat(F.lit("\n  why not: "), "reason"), F.lit("")))
    view = F.when(F.col("complete"), F.concat(F.lit("  superseded: "), F.col("superseded").cast("string"), F.lit("\n  thumbs_down: "), F.col("down").cast("string"))).otherwise("  nothing exportable — the journey is not complete")
    text = F.concat(head, F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n\ntraining view\n"), view)
    return each.join(v, "journey_id").select("journey_id", text.alias("text"))
