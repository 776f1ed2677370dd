"""The JSONL wire format: a header line, then an event a line, read with tolerance for damage."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.sources import files

HEADER = "schema_version string, journey_id string, data_source string, trace_id string, started_at string, journey_metadata string"
_CALL = "struct<name:string,arguments:string,id:string>"
_RESPONSE = "struct<id:string,name:string,arguments:string,response:string,error:string,metadata:string>"
_DEFINITION = "struct<name:string,description:string,parameters:string>"
_COMPONENT = "struct<name:string,value:double,scaled_value:double,explanation:string,weight:double,range:array<double>,metadata:string>"
_MESSAGE = f"struct<role:string,content:string,tool_calls:array<{_CALL}>,tool_response:{_RESPONSE},tool_definitions:array<{_DEFINITION}>,usage:string,finish_reason:string,reasoning:string,trainable_status:string,metadata:string>"
EVENT = f"journey_id string, seq bigint, kind string, ts string, event_id string, model_id string, metadata string, message {_MESSAGE}, signal struct<signal:string,target_seq:bigint,regen_order:bigint,edited_output:string>, reward struct<aggregated_value:double,aggregation_method:string,components:array<{_COMPONENT}>>, terminal struct<termination_reason:string,error:string>, voice struct<voice_kind:string,text:string,confidence:double,latency_ms:double,metadata:string>"
KINDS = ("message", "signal", "reward", "terminal", "voice")
MAJOR = "2"
VERSION = "2.0"
#: The header's key for its version; pass another where files have another.
VERSION_KEY = "schema_version"


def _refusal(line: Column, version_key: str) -> Column:
    """Why a file with this first line is refused; null if it isn't."""
    version = F.get_json_object(line, f"$.{version_key}")
    major = F.split(version, r"\.")[0]
    return F.when(F.trim(line) == "", "empty file").when(version.isNull(), "not a header").when(~major.rlike("^[0-9]+$"), "unreadable version").when(major != MAJOR, "unknown major version")


def _listed(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def lines(spark: SparkSession, path: str, version_key: str = VERSION_KEY, glob: str | None = None) -> DataFrame:
    """(path, line_no, line, last_open, refused): the lines of files; blank ones go, but for the first.

    last_open marks a last line without a line end.  refused says why the whole
    file is refused: it is empty, its first line is no header, or of another
    major version.  A file is a row until its lines are spelled out, so whether
    it ends cleanly can be told; the format's files are bounded in size.  Files
    of no bytes have no rows, as Spark's readers don't open them.
    """
    text = F.col("content").cast("string")
    rows = _listed(spark, path, glob).select("path", F.is_valid_utf8(text).alias("_valid"), F.make_valid_utf8(text).alias("_text"))
    rows = rows.select("path", "_valid", (~F.endswith("_text", F.lit("\n"))).alias("_open"), F.split("_text", "\n").alias("_all"))
    rows = rows.withColumn("refused", F.when(~F.col("_valid"), "not UTF-8").otherwise(_refusal(F.get("_all", F.lit(0)), version_key)))
    rows = rows.select("path", "refused", "_open", F.size("_all").alias("_n"), F.posexplode("_all").alias("line_no", "line"))
    kept = rows.where((F.trim("line") != "") | (F.col("line_no") == 0))
    return kept.select("path", (F.col("line_no") + 1).alias("line_no"), "line", (F.col("_open") & (F.col("line_no") + 1 == F.col("_n"))).alias("last_open"), "refused")


def ranged_lines(spark: SparkSession, path: str, version_key: str = VERSION_KEY, glob: str | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """What lines() gives, of files that are read by ranges: a file of any size is many tasks.

    A range has the lines that start in it.  A first pass counts them and tells
    whether they are UTF-8; sums of the counts give each range its first line's
    number, and the file's first line says whether the file is refused.  Then
    ranges are read again, each by itself; the one with the file's last line
    tells whether that has an end.
    """
    found = _listed(spark, path, glob).where("length > 0").select("path", F.col("length").alias("size"))
    return _ranged(found, version_key, range_bytes)


def swept(listed: DataFrame, version_key: str = VERSION_KEY, range_bytes: int = 64 << 20) -> DataFrame:
    """ranged_lines() of the objects of a listing (path, size) that goes on where one can't be read.

    Such an object, and an empty one, is a single row with line_no 1, no line
    and the reason in refused.  Only what fails at its first opening counts as
    that; one that fails later, after its lines were counted, fails the task,
    which Spark runs again.
    """
    return _ranged(listed.select("path", "size"), version_key, range_bytes, sweep=True)


def _ranged(found: DataFrame, version_key: str, range_bytes: int, sweep: bool = False) -> DataFrame:
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("begin")
    ranges = found.select("path", begin).repartition("path", "begin")

    def count(batches):
        for batch in batches:
            out = []
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, valid, first, error = 0, True, None, None
                try:
                    for line, _ in files.owned_lines(name, at, at + range_bytes):
                        n, first = n + 1, line if at == 0 and n == 0 else first
                        try:
                            line.decode()
                        except UnicodeDecodeError:
                            valid = False
                except (OSError, ValueError) as e:
                    if not sweep:
                        raise
                    error = f"{type(e).__name__}: {e}"
                out.append((name, at, n, valid, first, error))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["path", "begin", "n", "valid", "first", "error"])

    each, upto = Window.partitionBy("path"), Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.mapInArrow(count, "path string, begin long, n long, valid boolean, first binary, error string")
    first = F.max(F.make_valid_utf8(F.col("first").cast("string"))).over(each)
    told = counted.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "_valid": F.min("valid").over(each), "_first": first, "_error": F.min("error").over(each), "_lines": F.sum("n").over(each)})
    refused = F.when(~F.col("_valid"), "not UTF-8").otherwise(_refusal(F.col("_first"), version_key))
    if sweep:
        lost = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_lines") == 0, "empty file")
        told, refused = told.withColumn("_lost", lost).where("_lost is null or begin = 0"), F.coalesce(F.col("_lost"), refused)
    else:
        told = told.withColumn("_lost", F.lit(None).cast("string"))
    plan = told.select("path", "begin", "before", refused.alias("refused"), F.col("_lost").isNotNull().alias("lost"))

    def read(batches):
        for batch in batches:
            for name, at, before, refused, lost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = iter([(None, False)]) if lost else files.owned_lines(name, at, at + range_bytes)
                while some := list(itertools.islice(lines, 4096)):
                    numbers = pa.array(range(before + 1, before + 1 + len(some)), pa.int32()) if not lost else pa.array([1], pa.int32())
                    before += len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), numbers, pa.array([x for x, _ in some], pa.binary()), pa.array([o for _, o in some]), pa.array([refused] * len(some), pa.string())], ["path", "line_no", "bytes", "last_open", "refused"])

    rows = plan.repartition("path", "begin").mapInArrow(read, "path string, line_no int, bytes binary, last_open boolean, refused string")
    line = F.make_valid_utf8(F.col("bytes").cast("string")).alias("line")
    return rows.select("path", "line_no", line, "last_open", "refused").where((F.trim("line") != "") | (F.col("line_no") == 1))


def _header_columns(first: DataFrame, version_key: str) -> DataFrame:
    refused = F.col("refused") if "refused" in first.columns else _refusal(F.col("line"), version_key)
    return first.select("path", F.get_json_object("line", f"$.{version_key}").alias("version"), F.from_json("line", HEADER).alias("header"), refused.alias("error"))


def headers(rows: DataFrame, version_key: str = VERSION_KEY) -> DataFrame:
    """(path, version, header, error) of each file of lines()."""
    return _header_columns(rows.where("line_no = 1"), version_key)


def scan_headers(spark: SparkSession, path: str, version_key: str = VERSION_KEY, glob: str | None = None) -> DataFrame:
    """headers() of files of which nothing but the first line is read."""

    def run(batches):
        for batch in batches:
            names = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([files.first_line(n).decode("utf-8", "replace") for n in names], pa.string())], ["path", "line"])

    return _header_columns(_listed(spark, path, glob).select("path").mapInArrow(run, "path string, line string"), version_key)


def events(rows: DataFrame) -> DataFrame:
    """Each line after the header as ok, rejected (with a reason) or truncated; all lines of a refused file are rejected."""
    body = rows.where("line_no > 1").withColumn("event", F.from_json("line", EVENT))
    sound = F.try_parse_json("line").isNotNull()
    payloads = F.size(F.array_compact(F.array(*(F.when(F.col(f"event.{k}").isNotNull(), F.lit(k)) for k in KINDS))))
    fits = F.lit(False)
    for k in KINDS:
        fits |= (F.col("event.kind") == k) & F.col(f"event.{k}").isNotNull()
    reason = (
        F.when(F.col("refused").isNotNull(), F.concat(F.lit("file refused: "), "refused"))
        .when(~sound, "not JSON")
        .when(~F.startswith(F.ltrim("line"), F.lit("{")), "not a JSON object")
        .when(F.col("event.journey_id").isNull() | F.col("event.event_id").isNull() | F.col("event.seq").isNull() | F.col("event.kind").isNull(), "missing field")
        .when(F.col("event.seq") < 0, "negative seq")
        .when((payloads != 1) | ~fits, "payload does not match kind")
    )
    state = F.when(reason.isNull(), "ok").when(F.col("refused").isNull() & ~sound & F.col("last_open"), "truncated").otherwise("rejected")
    return body.select("path", "line_no", state.alias("state"), F.when(state == "rejected", reason).alias("reason"), F.substring("line", 1, 200).alias("raw"), F.when(state == "ok", F.col("event")).alias("event"))


def flat(scanned: DataFrame) -> DataFrame:
    """Sound events as the stream that the fold reads; arrival is the order of files by path, then of lines."""
    e = scanned.where("state = 'ok'")
    meta = F.col("event.message.metadata")
    flag = F.when(F.get_json_object(meta, "$.summarization") == "true", "summarization").when(F.get_json_object(meta, "$.interrupted") == "true", "interrupted")
    return e.select(
        "event.journey_id",
        "event.seq",
        "event.kind",
        "event.event_id",
        "event.message.role",
        F.coalesce("event.message.content", "event.voice.text").alias("content"),
        "event.signal.signal",
        "event.signal.target_seq",
        F.get_json_object("event.metadata", "$.writer").alias("writer"),
        F.struct("path", "line_no").alias("arrival"),
        flag.alias("flag"),
        F.coalesce(F.size("event.message.tool_calls"), F.lit(0)).alias("calls"),
        "event.message.tool_response.response",
        F.coalesce("event.terminal.error", "event.message.tool_response.error").alias("error"),
        F.col("event.reward.aggregated_value").alias("reward"),
        F.col("event.terminal.termination_reason").alias("reason"),
        F.col("event.voice.voice_kind").alias("voice"),
        "event.model_id",
        "event.message.tool_calls",
        F.col("event.message.tool_response.id").alias("tool_id"),
        F.col("event.message.tool_response.name").alias("tool_name"),
        "event.message.reasoning",
        "event.message.tool_definitions",
        "event.message.usage",
    )


def shard_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, rows, lines, sha256) of each *.jsonl file: non-blank lines, line ends, and the digest of its bytes."""
    found = _listed(spark, path, "*.jsonl")
    parts = F.split(F.decode("content", "UTF-8"), "\n")
    raw = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.size(F.filter(parts, lambda x: F.trim(x) != "")).cast("long").alias("rows"), raw.cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))


def _object(**fields: Column) -> Column:
    """A JSON object with sorted keys; none where all of its fields are null."""
    made = F.struct(*(c.alias(n) for n, c in sorted(fields.items())))
    return F.when(F.coalesce(*(c.cast("string") for c in fields.values())).isNotNull(), made)


def rendered(events: DataFrame) -> DataFrame:
    """(journey_id, seq, line): events of the fold's stream as wire events, compact, with sorted keys and without null fields.

    Each has the payload of its kind, whole; flat(events()) of what is written
    gives the stream's columns again, but for their arrival.
    """

    def of(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in events.columns else F.lit(None)).cast(kind)

    tool, calls = of("role") == "tool", f"array<{_CALL}>"
    call = F.transform(of("tool_calls", calls), lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    defined = F.transform(of("tool_definitions", f"array<{_DEFINITION}>"), lambda d: F.struct(d["description"].alias("description"), d["name"].alias("name"), d["parameters"].alias("parameters")))
    result = F.when(tool, F.struct(of("error").alias("error"), of("tool_id").alias("id"), of("tool_name").alias("name"), of("response").alias("response")))
    flags = _object(interrupted=F.when(of("flag") == "interrupted", F.lit(True)), summarization=F.when(of("flag") == "summarization", F.lit(True)))
    payloads = {
        "message": F.struct(of("content").alias("content"), flags.alias("metadata"), of("reasoning").alias("reasoning"), of("role").alias("role"), call.alias("tool_calls"), defined.alias("tool_definitions"), result.alias("tool_response"), F.try_parse_json(of("usage")).alias("usage")),
        "signal": F.struct(of("signal").alias("signal"), of("target_seq", "long").alias("target_seq")),
        "reward": F.struct(of("reward", "double").alias("aggregated_value")),
        "terminal": F.struct(of("error").alias("error"), of("reason").alias("termination_reason")),
        "voice": F.struct(of("content").alias("text"), of("voice").alias("voice_kind")),
    }
    fields = {k: F.when(of("kind") == k, p) for k, p in payloads.items()} | {"event_id": of("event_id"), "journey_id": of("journey_id"), "kind": of("kind"), "metadata": _object(writer=of("writer")), "model_id": of("model_id"), "seq": of("seq", "long")}
    return events.select("journey_id", "seq", F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items())))).alias("line"))
