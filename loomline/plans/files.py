"""Registered queries that write the supplied tables out in the domain's formats, read them back and work on what they find."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import documents as docs_of
from loomline.functions import redaction
from loomline.operators import catalog, documents, fold, turns, usage
from loomline.plans.journeys import _PARSED, _WIRE, _filled
from loomline.plans.queries import _FOLD, _RAW, QUERIES, SQL, _query
from loomline.sinks import keyed, reports, shards
from loomline.sources import files, layouts, tail, wire
from loomline.sources.tables import events, headers, table
from loomline.streaming import index, ingest, state

__all__ = ["QUERIES", "SQL"]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{layouts.shared(spark)}/loomline-{uuid.uuid4().hex}/{name}"


# ---- wire files: a file a conversation, an event a line; some lines and some files are damaged


def _wire(spark, sf) -> str:
    """conv_id % 10: 3 a header of another major, 7 a broken line before the last, 8 a truncated last line."""
    c = table(spark, sf, "conversations")
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), F.col("conv_id").cast("string").alias("journey_id"), F.lit("message").alias("kind"), message.alias("message"), F.col("turn").alias("seq")))
    body = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    kind = F.col("conv_id") % 10
    text = F.when(kind == 7, F.concat(F.lit("{broken\n\n"), text, F.lit("\n"))).when(kind == 8, F.concat(text, F.lit('\n{"event_id": "x'))).otherwise(F.concat(text, F.lit("\n")))
    version = F.when(kind == 3, "3.0").otherwise("2.1")
    head = F.concat(F.lit('{"journey_id":"'), F.col("conv_id").cast("string"), F.lit('","schema_version":"'), version, F.lit('"}\n'))
    root = folder(spark, "wire")
    shards.write_files(body.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("name"), F.concat(head, text).alias("content")), root).write.format("noop").mode("overwrite").save()
    return root


def _stem():
    return F.regexp_extract("path", r"/c(\d+)\.jsonl$", 1).cast("long")


@_query("select conv_id, cast(count(*) filter (where conv_id % 10 <> 3) as bigint) as ok, cast(case when conv_id % 10 = 3 then count(*) when conv_id % 10 = 7 then 1 else 0 end as bigint) as rejected, conv_id % 10 = 8 as truncated, coalesce(cast(sum(length(text)) filter (where conv_id % 10 <> 3) as bigint), 0) as chars from conversations group by conv_id")
def scan_wire(spark, sf):
    return _scanned(wire.lines(spark, _wire(spark, sf)))


def _scanned(lines):
    e = wire.events(lines)
    found = e.groupBy(_stem().alias("conv_id"))
    return found.agg(F.count_if(F.col("state") == "ok").alias("ok"), F.count_if(F.col("state") == "rejected").alias("rejected"), F.max(F.col("state") == "truncated").alias("truncated"), F.coalesce(F.sum(F.length("event.message.content")), F.lit(0)).cast("long").alias("chars"))


# The same by ranges of 1,000 bytes, so that files lie in several.
@_query(SQL["scan_wire"])
def scan_wire_by_range(spark, sf):
    return _scanned(wire.ranged_lines(spark, _wire(spark, sf), range_bytes=1000))


# A sweep of objects, of which some have gone between listing and reading (conv_id % 10 = 5): a row of its error for each.
@_query("select conv_id, case conv_id % 10 when 3 then 'unknown major version' when 5 then 'FileNotFoundError' end as error, cast(case when conv_id % 10 in (3, 5) then 0 else count(*) + 1 + case when conv_id % 10 in (7, 8) then 1 else 0 end end as bigint) as lines from conversations group by conv_id")
def sweep_objects(spark, sf):
    found = layouts.listing(spark, _wire(spark, sf))
    gone = F.when(_stem() % 10 == 5, F.regexp_replace("path", "/wire/", "/gone/")).otherwise(F.col("path"))
    rows = wire.swept(found.select(gone.alias("path"), "size"), range_bytes=1000)
    read = F.count_if(F.col("refused").isNull() & (F.trim("line") != ""))
    return rows.groupBy(_stem().alias("conv_id")).agg(F.max(F.when(F.col("refused").startswith("FileNotFoundError"), "FileNotFoundError").otherwise(F.col("refused"))).alias("error"), read.alias("lines"))


@_query("select distinct conv_id, case when conv_id % 10 = 3 then '3.0' else '2.1' end as version, case when conv_id % 10 = 3 then 'unknown major version' end as error from conversations")
def scan_headers(spark, sf):
    return wire.scan_headers(spark, _wire(spark, sf)).select(_stem().alias("conv_id"), "version", "error")


@_query("select conv_id, cast(case conv_id % 10 when 7 then 1 when 3 then count(*) else 0 end as bigint) as rejected, conv_id % 10 = 8 as truncated, case conv_id % 10 when 3 then 'malformed batch: unknown major version' when 7 then 'malformed batch: 1 rejected line(s)' when 8 then 'malformed batch: truncated final line' end as error from conversations group by conv_id")
def ingest_batches(spark, sf):
    return ingest.batch_verdicts(wire.lines(spark, _wire(spark, sf))).select(_stem().alias("conv_id"), "rejected", "truncated", "error")


# Of what is stored already, every third event; the rest of the sound batches is let in.
@_query("select cast(conv_id as varchar) as journey_id, turn as seq from conversations where conv_id % 10 not in (3, 7, 8) and turn % 3 <> 0")
def ingest_dedupe(spark, sf):
    stored = table(spark, sf, "conversations").where("turn % 3 = 0").select(F.col("conv_id").cast("string").alias("journey_id"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"))
    return ingest.admitted(wire.lines(spark, _wire(spark, sf)), stored).select("journey_id", "seq")


# Lines by state over all files, kept while files change (conv_id % 3 = 0: cut to an event) and go (conv_id % 7 = 0).
@_query("select state as key, cast(sum(n) as bigint) as n from (select conv_id, unnest(['ok', 'rejected', 'truncated']) as state, unnest([case when conv_id % 3 = 0 then 1 when conv_id % 10 = 3 then 0 else count(*) end, case when conv_id % 3 = 0 then 0 when conv_id % 10 = 3 then count(*) when conv_id % 10 = 7 then 1 else 0 end, case when conv_id % 3 <> 0 and conv_id % 10 = 8 then 1 else 0 end]) as n from conversations where conv_id % 7 <> 0 group by conv_id) group by 1 having sum(n) > 0")
def index_refresh(spark, sf):
    root, at = _wire(spark, sf), folder(spark, "index")

    def states(changed):
        return wire.events(wire.swept(changed)).select("path", F.col("state").alias("key"), F.lit(1).alias("n"))

    index.refresh(spark, at, ingest.listing(spark, root), states)
    line = F.concat(F.lit('{"journey_id":"j","schema_version":"2.1"}\n{"event_id":"e","journey_id":"j","kind":"terminal","seq":0,"terminal":{"termination_reason":"'), F.col("conv_id").cast("string"), F.lit('"}}\n'))
    cut = table(spark, sf, "conversations").where("conv_id % 3 = 0").select("conv_id").distinct()
    shards.write_files(cut.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("name"), line.alias("content")), root).write.format("noop").mode("overwrite").save()
    index.refresh(spark, at, ingest.listing(spark, root).where(_stem() % 7 != 0), states)
    return index.totals(spark, at)


@_query("select 'c' || conv_id || '.jsonl' as name, cast(count(*) + 1 + case conv_id % 10 when 7 then 1 when 8 then 1 else 0 end as bigint) as rows, cast(count(*) + 1 + case conv_id % 10 when 7 then 2 when 8 then 1 else 0 end as bigint) as lines from conversations group by conv_id")
def export_shards(spark, sf):
    return wire.shard_inventory(spark, _wire(spark, sf)).orderBy("name").select("name", "rows", "lines")


def _lines(spark, sf) -> DataFrame:
    """The event stream without repeats, rendered: journey_id, seq, line."""
    return wire.rendered(events(spark, sf).where("arrival = 0"))


def _heads(spark, sf) -> DataFrame:
    h = headers(spark, sf)
    return h.select("journey_id", shards.header_line("journey_id", "data_source", "trace_id", "started_at").alias("line"))


# What is written is read back field by field.
@_query(_RAW + "select cast(journey_id as varchar) as journey_id, seq, kind, event_id, role, content, signal, target_seq, writer, flag, calls, response, error, reward, reason, voice, model_id, call_id, call_name, call_args from ev where arrival = 0")
def wire_round_trip(spark, sf):
    root = folder(spark, "round")
    shards.write_wire(_lines(spark, sf), _heads(spark, sf), root).write.format("noop").mode("overwrite").save()
    e, call = wire.flat(wire.events(wire.lines(spark, root))), F.get("tool_calls", F.lit(0))
    said = {"call_id": F.coalesce("tool_id", call["id"]), "call_name": F.coalesce("tool_name", call["name"]), "call_args": call["arguments"]}
    return e.withColumns(said).withColumn("calls", F.col("calls").cast("int")).drop("arrival", "tool_calls", "tool_id", "tool_name", "reasoning", "tool_definitions", "usage")


# Usage as four providers report it, by conv_id % 4, read back from wire files; the agent's second message says nothing, the third no number.
_USAGE = {
    0: '{"prompt_tokens":%p,"completion_tokens":%c,"total_tokens":%t,"cost":0.5}',
    1: '{"input_tokens":%p,"output_tokens":%c}',
    2: '{"promptTokenCount":%p,"candidatesTokenCount":%c,"totalTokenCount":%t}',
    3: '{"promptTokens":%p,"completionTokens":%c}',
}
_USED = """with m as (select conv_id, turn, role, text, row_number() over (partition by conv_id, role order by turn) as nth, coalesce(lag(role) over (partition by conv_id order by turn), 'user') as before from conversations
), u as (select *, role = 'assistant' and nth not in (2, 3) as says, sum(case when role = 'user' and before <> 'user' then 1 else 0 end) over (partition by conv_id order by turn) as t from m
), s as (select conv_id, t, count(*) as messages, coalesce(sum(length(text)) filter (where says), 0) as p, coalesce(sum(turn + 1) filter (where says), 0) as c, 0.5::double * count(*) filter (where says and conv_id % 4 = 0) as cost from u group by all) """


def _used(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    prompt, completion = F.length("text"), F.col("turn") + 1
    said = F.lit(None).cast("string")
    for k, form in _USAGE.items():
        made = F.replace(F.replace(F.replace(F.lit(form), F.lit("%p"), prompt.cast("string")), F.lit("%c"), completion.cast("string")), F.lit("%t"), (prompt + completion).cast("string"))
        said = F.when(F.col("conv_id") % 4 == k, made).otherwise(said)
    said = F.when(F.col("role") == "assistant", F.when(nth == 3, '{"prompt_tokens":"many","total_tokens":null}').when(nth != 2, said))
    e = c.select(F.col("conv_id").alias("journey_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), "role", F.col("text").alias("content"), said.alias("usage"))
    heads = c.select(F.col("conv_id").alias("journey_id")).distinct().select("journey_id", shards.header_line("journey_id").alias("line"))
    root = folder(spark, "used")
    shards.write_wire(wire.rendered(e), heads, root).write.format("noop").mode("overwrite").save()
    return wire.flat(wire.events(wire.lines(spark, root)))


@_query(_USED + "select cast(conv_id as varchar) as journey_id, cast(t as bigint) as turn, messages, cast(p as bigint) as prompt_tokens, cast(c as bigint) as completion_tokens, cast(p + c as bigint) as total_tokens, cost as total_cost from s")
def usage_by_turn(spark, sf):
    return usage.by_turn(_used(spark, sf))


@_query(_USED + "select cast(conv_id as varchar) as journey_id, cast(sum(messages) as bigint) as messages, cast(nullif(sum(p), 0) as bigint) as prompt_tokens, cast(nullif(sum(c), 0) as bigint) as completion_tokens, cast(nullif(sum(p + c), 0) as bigint) as total_tokens, nullif(sum(cost), 0.0) as total_cost from s group by 1")
def usage_by_journey(spark, sf):
    return usage.by_journey(_used(spark, sf))


# Written twice: whole files first, then what comes after seq 2 is appended, without a second header.
@_query(_RAW + "select journey_id, cast(count(*) filter (where seq <= 2) + 1 as bigint) as written, cast(count(*) + 1 as bigint) as rows, 1 as headers from ev where arrival = 0 group by 1")
def write_wire(spark, sf):
    root, lines, heads = folder(spark, "out"), _lines(spark, sf), _heads(spark, sf)
    some = lines.where("seq <= 2")
    shards.append_wire(some, heads, root)
    before = wire.shard_inventory(spark, root).select("name", F.col("rows").alias("written")).collect()
    shards.append_wire(lines.where("seq > 2"), heads, root)
    after = wire.lines(spark, root).groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("rows"), F.count_if(F.col("line").contains("schema_version")).cast("int").alias("headers"))
    first = spark.createDataFrame(before, "name string, written long")
    return after.join(first, "name").select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("journey_id"), "written", "rows", "headers")


# A spool: shards of 4 events, a header in each; days change with seq.
@_query(_RAW + "select journey_id, cast(count(*) as bigint) as events, cast(sum(seq) as bigint) as total, bool_and(true) as in_order, cast(count(distinct seq // 4) as bigint) as shards from ev where arrival = 0 group by 1")
def scan_spool(spark, sf):
    e = events(spark, sf).where("arrival = 0")
    payload = F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.lit("x").alias("content"))
    line = F.to_json(F.struct(F.col("event_id"), F.col("journey_id").cast("string").alias("journey_id"), F.lit("message").alias("kind"), payload.alias("message"), "seq"))
    rows = e.select("journey_id", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("seq") / 4).cast("int")).cast("string").alias("date"), "seq", line.alias("line"), F.concat(F.lit('{"journey_id":"'), F.col("journey_id").cast("string"), F.lit('","schema_version":"2.0"}')).alias("head"))
    root = folder(spark, "spool")
    shards.rotated(rows, root, 4).write.format("noop").mode("overwrite").save()
    found = layouts.spool_events(spark, root)
    w = Window.partitionBy("journey_id").orderBy("arrival")
    found = found.withColumn("_up", F.coalesce(F.col("seq") > F.lag("seq").over(w), F.lit(True)))
    return found.groupBy(F.col("journey_id").cast("long").alias("journey_id")).agg(F.count("*").alias("events"), F.sum("seq").cast("long").alias("total"), F.min("_up").alias("in_order"), F.count_distinct(F.struct("arrival.date", "arrival.shard")).alias("shards"))


# Flat and by product, with a folder of metrics and one that is no date beside them.
@_query("select distinct '2024-01-0' || (1 + conv_id % 5) as date, case when conv_id % 2 = 1 then 'p' || conv_id % 3 end as product, 'c' || conv_id as stem from conversations where conv_id % 7 not in (5, 6)")
def scan_collector(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    day = F.concat(F.lit("2024-01-0"), (1 + F.col("conv_id") % 5).cast("string"))
    top = F.when(F.col("conv_id") % 7 == 5, F.concat(F.lit("metrics/"), day)).when(F.col("conv_id") % 7 == 6, "notes").when(F.col("conv_id") % 2 == 1, F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string"), F.lit("/"), day)).otherwise(day)
    name = F.concat(top, F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    root = folder(spark, "collector")
    shards.write_files(c.select(name.alias("name"), F.lit('{"schema_version":"2.0"}\n').alias("content")), root).write.format("noop").mode("overwrite").save()
    return layouts.collector(spark, root).select("date", "product", "stem")


# The first shard of a journey by path, whatever folder it lies in.
@_query("select conv_id % 20 as journey_id, min('2024-01-0' || (1 + conv_id % 5) || '/c' || conv_id) as path from conversations group by 1")
def first_shard(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 20).alias("journey_id"), F.concat(F.lit("2024-01-0"), (1 + F.col("conv_id") % 5).cast("string"), F.lit("/c"), F.col("conv_id").cast("string")).alias("path"))
    return catalog.first_shard(c)


# ---- host metrics: NDJSON with blank and broken lines


def _ndjson(spark, sf) -> str:
    e = table(spark, sf, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat(F.lit('{"hostname":"'), F.col("user_id").cast("string"), F.lit('","ts":"'), ts, F.lit('","id":'), F.col("event_id").cast("string"), F.lit("}"))
    line = F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("{broken\n\n"), line)).otherwise(line)
    body = e.groupBy((F.col("event_id") % 5).alias("k")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    root = folder(spark, "metrics")
    shards.write_files(body.select(F.concat(F.lit("m"), F.col("k").cast("string"), F.lit(".ndjson")).alias("name"), F.concat(text, F.when(F.col("k") == 4, "").otherwise("\n")).alias("content")), root).write.format("noop").mode("overwrite").save()
    return root


@_query("select event_id as id, user_id as host, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as ts from events")
def metrics_scan(spark, sf):
    m = layouts.metrics(spark, _ndjson(spark, sf))
    return m.select(F.get_json_object("snapshot", "$.id").cast("long").alias("id"), F.get_json_object("snapshot", "$.hostname").cast("long").alias("host"), "ts")


# Two passes: the second sees what was appended meanwhile, and the line that had no end is read once it has one.
@_query("select event_id as id, case when event_id = (select max(event_id) from events where event_id % 5 = 4) then 2 else 1 end as pass from events union all select 1000000 + k, 2 from (select unnest(range(0, 5)) as k)")
def tail_metrics(spark, sf):
    root, passes = _ndjson(spark, sf), []
    offsets = spark.createDataFrame([], "path string, offset long")
    for n in (1, 2):
        values, after = ingest.tail(spark, root, offsets)
        kept = folder(spark, f"pass{n}")
        values.write.parquet(kept)
        passes.append(spark.read.schema(values.schema).parquet(kept).withColumn("pass", F.lit(n)))
        offsets = spark.createDataFrame(after.collect(), "path string, offset long")  # a row a file
        if n == 1:
            for k in range(5):
                end = "\n" if k == 4 else ""
                files.append(f"{root}/m{k}.ndjson", b"", f'{end}{{"id":{1000000 + k}}}\n'.encode())
    return passes[0].unionByName(passes[1]).select(F.get_json_object("value", "$.id").cast("long").alias("id"), "pass")


# The same by a stream that is stopped and started again; its checkpoint holds the sizes.
@_query(SQL["tail_metrics"])
def tail_stream(spark, sf):
    root, out = _ndjson(spark, sf), folder(spark, "tailed")
    for n in (1, 2):

        def keep(batch, number, n=n):
            batch.withColumn("pass", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

        rows = tail.stream(spark, root, range_bytes=1 << 20)
        rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if n == 1:
            for k in range(5):
                end = "\n" if k == 4 else ""
                files.append(f"{root}/m{k}.ndjson", b"", f'{end}{{"id":{1000000 + k}}}\n'.encode())
    return spark.read.schema("path string, value string, pass int").parquet(f"{out}/rows").select(F.get_json_object("value", "$.id").cast("long").alias("id"), "pass")


# ---- small documents


@_query("select 'd' || doc_id as name, 1 + quality as version, sha256(cast(doc_id as varchar)) as manifest_sha256, 'm/' || doc_id as uri from labels")
def registry_list(spark, sf):
    # a registry is a small document; this one has an entry for each label
    rows = table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.to_json(F.array(F.struct(F.sha2(F.col("doc_id").cast("string"), 256).alias("manifest_sha256"), F.concat(F.lit("m/"), F.col("doc_id").cast("string")).alias("uri"), (1 + F.col("quality")).cast("int").alias("version")))).alias("v"))
    root = folder(spark, "registry")
    text = json.dumps({"corpora": {r["name"]: json.loads(r["v"]) for r in rows.toLocalIterator()}})
    files.write_whole(f"{root}/registry.yaml", text.encode())
    return layouts.registry(spark, f"{root}/registry.yaml", "corpora").select("name", F.col("version").cast("long").alias("version"), "manifest_sha256", "uri")


# A roster in documents of at most 10,000 products, written and read in tasks.
@_query("select 'p' || c_custkey as slug, c_name as name from customer where c_custkey % 4 <> 0")
def products(spark, sf):
    c = table(spark, sf, "customer").select(F.to_json(F.struct(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"), F.lit("k").alias("api_key"), F.coalesce(F.col("c_custkey") % 4 == 0, F.lit(True)).alias("revoked"))).alias("product"))
    root = folder(spark, "products")
    shards.write_roster(c, root).write.format("noop").mode("overwrite").save()
    return catalog.active_products(layouts.products(spark, root)).select("slug", "name")


# A benchmark for each language: a report written, then read back.
@_query("select lang as benchmark, 'quality' as metric, round(avg(coalesce(quality, 0.0)), 9) as mean_score, cast(count(*) as int) as num_tasks, cast(count(*) filter (where quality is null) as int) as num_missing from documents left join labels using (doc_id) group by 1")
def eval_runs(spark, sf):
    root = folder(spark, "reports")
    runs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = runs.groupBy("lang").agg(F.avg(F.coalesce("quality", F.lit(0)).cast("double")).alias("mean_score"), F.count("*").cast("int").alias("num_tasks"), F.count_if(F.col("quality").isNull()).cast("int").alias("num_missing"))
    text = F.to_json(F.struct(F.col("lang").alias("benchmark"), F.lit("quality").alias("metric"), "mean_score", "num_missing", "num_tasks"))
    shards.write_files(rows.select(F.concat("lang", F.lit(".json")).alias("name"), text.alias("content")), root).write.format("noop").mode("overwrite").save()
    return layouts.reports(spark, root).select("benchmark", "metric", F.round("mean_score", 9).alias("mean_score"), "num_tasks", "num_missing")


# Completions a line, the second of an id wins; broken lines go.
@_query("select cast(doc_id as varchar) as id, 'second' as response from documents")
def completions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    line = F.concat(F.lit('{"id":"'), "id", F.lit('","response":"first"}\n{"id":\n{"id":"'), "id", F.lit('","response":"second"}'))
    body = d.groupBy(F.pmod(F.hash("id"), F.lit(4)).alias("k")).agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    root = folder(spark, "completions")
    shards.write_files(body.select(F.concat(F.lit("c"), F.col("k").cast("string"), F.lit(".jsonl")).alias("name"), "content"), root).write.format("noop").mode("overwrite").save()
    return layouts.completions(spark, root)


# ---- raw exports and journey documents


def _raw(spark, sf, provider: str) -> str:
    """A file a conversation; conv_id % 10: 3 isn't JSON, 4 wraps its messages and names its trace."""
    c = table(spark, sf, "conversations")
    said = F.to_json(F.struct(F.col("text").alias("t")))
    said = F.substring(said, 6, F.length(said) - 6)
    kinds = {k: _filled(t, said, F.col("turn").cast("string")) for k, t in _WIRE[provider].items()}
    line = F.when(F.col("role") == "assistant", kinds["assistant"]).when(F.col("role") == "user", kinds["user"]).otherwise(kinds["system"])
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    entries = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["line"]), ","), F.lit("]"))
    kind = F.col("conv_id") % 10
    text = F.when(kind == 3, "[{").when(kind == 4, F.concat(F.lit('{"conversation_id":"w'), F.col("conv_id").cast("string"), F.lit('","trace_id":"t","messages":'), entries, F.lit("}"))).otherwise(entries)
    root = folder(spark, "raw")
    shards.write_files(lists.select(F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit(".json")).alias("name"), text.alias("content")), root).write.format("noop").mode("overwrite").save()
    return root


_BYOD = (
    _PARSED.replace("select conv_id as id, cast(row_number()", ", msgs as (select conv_id as id, cast(row_number()", 1)
    + """), turns as (
  select *, lead(role) over w as nxt, min(case when role = 'user' then idx end) over (partition by id) as fu from msgs window w as (partition by id order by idx)
) select id as conv_id, case id % 10 when 4 then 'w' || id else 'r' || id end as journey_id, cast(count(*) filter (where nxt is null or (nxt = 'user' and fu <= idx and role <> 'user')) as bigint) as n_steps, cast(count(*) as bigint) as n_messages, id % 10 = 4 as traced from turns where id % 10 <> 3 group by id
union all select distinct conv_id, null, 0, 0, false from conversations where conv_id % 10 = 3"""
)


@_query(_BYOD)
def byod_normalize(spark, sf):
    d = documents.byod(layouts.journey_documents(spark, _raw(spark, sf, "openai")), "openai", "raw")
    f = d.withColumn("f", docs_of.facts(F.col("document")))
    conv = F.regexp_extract("path", r"/r(\d+)\.json$", 1).cast("long")
    return f.select(conv.alias("conv_id"), F.when(F.col("error").isNull(), F.col("f.journey_id")).alias("journey_id"), F.coalesce("f.n_steps", F.lit(0)).cast("long").alias("n_steps"), F.coalesce("f.n_messages", F.lit(0)).cast("long").alias("n_messages"), F.coalesce(F.get_json_object("document", "$.trace_id") == "t", F.lit(False)).alias("traced"))


def _documents(spark, sf) -> DataFrame:
    """A journey document a conversation, two steps: the second says nothing where conv_id % 4 is 0; every sixth repeats the one before it under another path."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    m = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    one = F.array(m(F.lit("user"), F.concat(F.col("text"), F.lit("\x07"))), m(F.lit("assistant"), F.lit("fine")))
    rest = F.array(m(F.lit("user"), F.when(F.col("conv_id") % 4 != 0, F.lit("call 555-123-4567"))), m(F.lit("assistant"), F.when(F.col("conv_id") % 4 != 0, F.lit("done"))))
    step = lambda said: F.struct(said.alias("messages"), F.lit("trainable").alias("trainable_status"))
    task = F.struct(F.col("conv_id").cast("string").alias("conversation_id"))
    doc = F.to_json(F.struct(F.array(step(one), step(F.concat(one, rest))).alias("steps"), task.alias("task"), F.concat(F.lit("t"), F.floor(F.col("conv_id") / 3).cast("string")).alias("trace_id")))
    rows = c.select(F.concat(F.lit("a"), F.col("conv_id").cast("string")).alias("path"), doc.alias("document"), "conv_id")
    again = rows.where("conv_id % 6 = 0").select(F.concat(F.lit("z"), "path").alias("path"), "document", "conv_id")
    return rows.unionByName(again).select("path", "document")


_FIRST = "with c as (select conv_id, arg_min(text, turn) as text from conversations group by 1) "


@_query(_FIRST + "select 'a' || conv_id as path, cast(case when conv_id % 4 = 0 then 1 else 0 end as bigint) as dead_turns, cast(case when conv_id % 4 = 0 then 1 else 2 end as bigint) as repairs, cast(case when conv_id % 4 = 0 then 0 else 1 end as bigint) as scrubs, sha256(text || case when conv_id % 4 = 0 then 'fine' else 'finecall [REDACTED_PHONE]done' end) as said from c")
def clean(spark, sf):
    d = documents.clean(_documents(spark, sf), ["PHONE"])
    last = F.from_json("document", "steps array<struct<messages:array<struct<content:string>>>>")
    said = F.transform(F.element_at(last["steps"], -1)["messages"], lambda m: m["content"])
    return d.select("path", "dead_turns", "repairs", "scrubs", F.sha2(F.encode(F.array_join(said, ""), "UTF-8"), 256).alias("said"))


def _broken(spark, sf) -> DataFrame:
    d = _documents(spark, sf)
    id_ = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    return d.withColumn("document", F.when(id_ % 5 == 1, F.regexp_replace("document", '"role":"user"', '"role":"narrator"')).when(id_ % 5 == 2, F.regexp_replace("document", r'"task":\{', '"task":{"api_key":"k",')).otherwise(F.col("document")))


@_query(
    _FIRST
    + """, p as (select 'a' || conv_id as path, conv_id from c union all select 'za' || conv_id, conv_id from c where conv_id % 6 = 0)
select path, unnest(case when conv_id % 5 = 1 then ['steps[0].messages[0].role: invalid or missing', 'steps[1].messages[0].role: invalid or missing', 'steps[1].messages[2].role: invalid or missing'] when conv_id % 5 = 2 then ['unredacted key ''api_key'' (value: ''k'')'] else [] end
  || case when conv_id % 4 <> 0 then ['unredacted PHONE in message.content (1 match(es))'] else [] end) as error from p"""
)
def validate(spark, sf):
    return documents.validate(_broken(spark, sf), ["PHONE"])


_DOC_SPLIT = """, g as (select conv_id, cast(('0x' || substr(sha256('{"group_key":"t' || conv_id // 3 || '"}'), 1, 8)) as bigint) / 4294967295.0::double as h from c)"""


@_query(_FIRST + _DOC_SPLIT + ", p as (select 'a' || conv_id as path, h from g union all select 'za' || conv_id, h from g where conv_id % 6 = 0) select path, case when h < 0.1 then 'test' when h < 0.9 then 'train' else 'val' end as split from p")
def split(spark, sf):
    root = folder(spark, "splits")
    documents.split(_documents(spark, sf)).write.partitionBy("split").parquet(root)
    return spark.read.parquet(root).select("path", F.col("split").cast("string").alias("split"))


_RECIPE = {"name": "curate", "version": 2, "stages": [{"stage": "collection"}, {"stage": "cleaning", "params": {"pii_rules": ["PHONE"]}}, {"stage": "validation"}, {"stage": "splitting"}]}


@_query(_FIRST + _DOC_SPLIT + "select 'a' || conv_id as path, case when h < 0.1 then 'test' when h < 0.9 then 'train' else 'val' end as split, true as ok from g")
def recipe(spark, sf):
    out = documents.run(documents.recipe(_RECIPE), _documents(spark, sf))
    return out.data.select("path", "split", F.lit(out.ok).alias("ok"))


_CANONICAL = json.dumps({"name": "curate", "stages": [{"params": {}, "stage": "collection"}, {"params": {"pii_rules": ["PHONE"]}, "stage": "cleaning"}, {"params": {}, "stage": "validation"}, {"params": {}, "stage": "splitting"}], "version": 2}, separators=(",", ":"))
_PAIRS = "(select sha256('[' || string_agg('[\"' || doc_id || '\",\"' || sha256(coalesce(text, '')) || '\"]', ',' order by cast(doc_id as varchar), sha256(coalesce(text, ''))) || ']') from documents)"


def _pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("content_hash"))


@_query(f"select {_PAIRS} as watermark")
def watermark(spark, sf):
    return spark.createDataFrame([(documents.watermark(_pairs(spark, sf)),)], "watermark string")


@_query(f"""select r as recipe_hash, w as watermark, sha256('{{"recipe":"' || r || '","watermark":{{"hash":"' || w || '","seq":3}}}}') as corpus_version from (select sha256('{_CANONICAL}') as r, {_PAIRS} as w)""")
def corpus_version(spark, sf):
    mark = {"seq": 3, "hash": documents.watermark(_pairs(spark, sf))}
    digest = documents.recipe(_RECIPE).digest()
    return spark.createDataFrame([(digest, mark["hash"], documents.corpus_version(digest, mark))], "recipe_hash string, watermark string, corpus_version string")


@_query(_FIRST + ", p as (select conv_id from c union all select conv_id from c where conv_id % 6 = 0) select cast(conv_id as varchar) as journey_id, 'superseded' as first_status, 'trainable' as second_status, case when conv_id % 4 = 0 then 'worse' else 'worse than 4 lines' end as rejected, case when conv_id % 4 <> 0 then 'done' end as chosen from p where true")
def synthetic_negative(spark, sf):
    made = _documents(spark, sf).select(docs_of.made_negative(F.col("document"), _worse, "stub").alias("document"))
    d = made.select(F.from_json("document", "task struct<conversation_id:string>, steps array<struct<trainable_status:string,messages:array<struct<content:string>>>>").alias("d"))
    last = lambda k: F.element_at(F.col("d.steps")[k]["messages"], -1)["content"]
    return d.select(F.regexp_replace("d.task.conversation_id", "__synthetic_negative$", "").alias("journey_id"), F.col("d.steps")[0]["trainable_status"].alias("first_status"), F.col("d.steps")[1]["trainable_status"].alias("second_status"), last(0).alias("rejected"), last(1).alias("chosen"))


def _worse(context: str) -> str:
    return " worse than 4 lines " if "call 555" in context else "worse"


@_query(_FIRST + """, p as (select conv_id, text from c union all select conv_id, text from c where conv_id % 6 = 0) select cast(conv_id as varchar) as journey_id, case when conv_id % 4 = 0 then 'user: ''' || 'hello' || ''' -> assistant: ''''' else 'user: ''hello'' -> assistant: ''done''' end as preview from p""")
def review_queue(spark, sf):
    d = _documents(spark, sf).withColumn("document", F.regexp_replace("document", r'"content":"[^"\\]*(\\.[^"\\]*)*\\u0007"', '"content":"hello"'))
    return documents.review_queue(d).select("journey_id", "preview")


@_query("select cast(doc_id as varchar) as path, quality = 1 as approved, cast(quality as double) as reward, case when toxic = 1 then 'toxic' end as notes from labels join documents using (doc_id)")
def apply_reviews(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit('{"steps":[],"task":{"conversation_id":"'), F.col("doc_id").cast("string"), F.lit('"}}')).alias("document"))
    said = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("journey_id"), (F.col("quality") == 1).alias("approved"), F.col("quality").cast("double").alias("score"), F.when(F.col("toxic") == 1, "toxic").alias("notes"), F.lit(2).alias("line_no"))
    first = said.withColumns({"approved": F.lit(None).cast("boolean"), "score": F.lit(9.0), "notes": F.lit("first thought"), "line_no": F.lit(1)})
    out = documents.review(d, said.unionByName(first))
    note = F.from_json(F.get_json_object("document", "$.telemetry.data.annotation"), "approved boolean, notes string")
    return out.select("path", note["approved"].alias("approved"), F.get_json_object("document", "$.reward.aggregated_value").cast("double").alias("reward"), note["notes"].alias("notes"))


# ---- turns


# Roles alternate at random; interrupted parts, tool rows between, and confidences on two of three.
_ITEMS = '''select user_id as journey_id, event_id as "at", case when event_type = 'signup' then 'tool' else 'item' end as kind, case event_type when 'view' then 'user' when 'click' then 'user' when 'purchase' then 'developer' else 'assistant' end as role, 'e' || event_id as text, event_id % 7 = 0 as interrupted, case when event_id % 3 <> 0 then value end as confidence from events'''


def _items(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    t, n = F.col("event_type"), F.col("event_id")
    role = F.when(t.isin("view", "click"), "user").when(t == "purchase", "developer").otherwise("assistant")
    call = F.struct(n.cast("string").alias("id"), F.lit("look").alias("name"), F.lit("{}").alias("arguments"), F.when(n % 2 == 0, F.concat(F.lit("r"), n.cast("string"))).alias("output"), (n % 4 == 0).alias("failed"))
    return e.select(F.col("user_id").alias("journey_id"), n.alias("at"), F.when(t == "signup", "tool").otherwise("item").alias("kind"), role.alias("role"), F.concat(F.lit("e"), n.cast("string")).alias("text"), (n % 7 == 0).alias("interrupted"), F.when(n % 3 != 0, F.col("value")).alias("confidence"), F.when(t == "signup", F.array(call)).alias("calls"))


_UTTERED = (
    "with i as ("
    + _ITEMS
    + """), m as (select *, case when kind = 'item' then case when role = 'developer' then 'system' else role end end as r from i), b as (
  select *, case when lag(kind) over w = 'item' and lag(r) over w = r and not lag(interrupted) over w then 0 else 1 end as new from m window w as (partition by journey_id order by "at")
), n as (select *, cast(sum(new) over (partition by journey_id order by "at") as bigint) as island from b), u as (
  select journey_id, island, r as role, min("at") as "at", count(*) as parts, string_agg(text, ' ' order by "at") as text, bool_or(interrupted) as interrupted, round(sum(confidence * length(text)) / sum(case when confidence is not null then length(text) end), 9) as confidence from n where kind = 'item' group by journey_id, island, r
)"""
)


@_query(_UTTERED + ' select journey_id, island, role, "at", parts, text, interrupted, confidence from u')
def coalesce_utterances(spark, sf):
    return turns.utterances(_items(spark, sf)).withColumn("confidence", F.round("confidence", 9))


@_query(
    _UTTERED
    + """, rows as (select journey_id, "at", 'item' as kind, role, text, interrupted from u union all select journey_id, "at", 'tool', null, null, false from i where kind = 'tool'), j as (
  select *, kind = 'item' and role = 'assistant' and not interrupted as speech, lead(kind) over w as nk, lag(text) over w as lt, lag(kind = 'item' and role = 'assistant' and not interrupted) over w as ls from rows window w as (partition by journey_id order by "at")
) select journey_id, "at", 0 as part, role, text as content, 0 as calls, null as response, null as error, interrupted, null as call_id, null as call_name, null as call_args from j where kind = 'item' and not (speech and coalesce(nk = 'tool', false))
union all select journey_id, "at", 0, 'assistant', case when ls then lt end, 1, null, null, false, cast("at" as varchar), 'look', '{}' from j where kind = 'tool'
union all select journey_id, "at", 1, 'tool', null, 0, case when "at" % 2 = 0 then 'r' || "at" end, case when "at" % 4 = 0 then 'tool_error' end, false, cast("at" as varchar), 'look', null from j where kind = 'tool'"""
)
def tool_turns(spark, sf):
    t, call = turns.tool_turns(_items(spark, sf)), F.get("tool_calls", F.lit(0))
    said = {"call_id": F.coalesce("tool_id", call["id"]), "call_name": F.coalesce("tool_name", call["name"]), "call_args": call["arguments"]}
    return t.withColumns(said).drop("tool_calls", "tool_id", "tool_name")


@_query("select event_id, case event_type when 'error' then 'ERROR' when 'signup' then 'TRUNCATION' else 'ENV_DONE' end as reason, case event_type when 'click' then 'system' when 'view' then 'user' end as role from events")
def close_reasons(spark, sf):
    t = F.col("event_type")
    said = F.when(t == "error", "error").when(t == "signup", "job_shutdown").when(t == "view", "user_initiated").otherwise("whatever")
    return table(spark, sf, "events").select("event_id", turns.close_reason(said).alias("reason"), turns.session_role(F.when(t == "click", "developer").when(t == "view", "user").otherwise("function")).alias("role"))


# A trace for each conversation: spans of turns with the text in one of three places, a span without a model, and a root.
@_query(
    """with s as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as seq, count(*) over (partition by conv_id) as n from conversations)
select cast(conv_id as varchar) as journey_id, seq, 'message' as kind, case when role = 'assistant' then 'assistant' when role = 'user' then 'user' else 'system' end as role, text as content, 'm' || conv_id % 3 as model_id, null as reason, null as error from s
union all select distinct cast(conv_id as varchar), n, 'terminal', null, null, null, case when conv_id % 5 = 0 then 'ERROR' else 'ENV_DONE' end, case when conv_id % 5 = 0 then 'bad' end from s"""
)
def otel_spans_to_events(spark, sf):
    c = table(spark, sf, "conversations")
    trace = F.col("conv_id").cast("string")
    payload = F.to_json(F.array(F.struct(F.col("role"), F.col("text").alias("content"))))
    place = F.col("turn") % 3
    none = F.lit(None).cast("string")
    attributes = F.map_filter(F.create_map(F.lit("gen_ai.request.model"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")), F.lit("gen_ai.input.messages"), F.when(place == 0, payload).otherwise(none), F.lit("gen_ai.prompt"), F.when(place == 2, payload).when(place == 1, F.lit("[]")).otherwise(none)), lambda k, v: v.isNotNull())
    told = F.array(F.struct(F.lit("gen_ai.content.prompt").alias("name"), F.create_map(F.lit("gen_ai.prompt"), payload).alias("attributes")))
    empty = F.array().cast("array<struct<name:string,attributes:map<string,string>>>")
    said = c.select(trace.alias("trace_id"), F.concat(F.lit("s"), F.col("turn").cast("string")).alias("span_id"), F.lit("root").alias("parent_id"), F.col("turn").cast("long").alias("ended"), F.lit(True).alias("ok"), none.alias("description"), attributes.alias("attributes"), F.when(place == 1, told).otherwise(empty).alias("events"))
    other = c.where("turn = 0").select(trace.alias("trace_id"), F.lit("db").alias("span_id"), F.lit("root").alias("parent_id"), F.lit(1).cast("long").alias("ended"), F.lit(False).alias("ok"), F.lit("x").alias("description"), F.create_map(F.lit("gen_ai.prompt"), F.lit('[{"role":"user","content":"no"}]')).alias("attributes"), empty.alias("events"))
    ids = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.first("text").alias("text"))
    root = ids.select(trace.alias("trace_id"), F.lit("root").alias("span_id"), none.alias("parent_id"), (F.col("turn") + 1).cast("long").alias("ended"), (F.col("conv_id") % 5 != 0).alias("ok"), F.lit("bad").alias("description"), F.map_filter(F.create_map(F.lit("k"), none), lambda k, v: v.isNotNull()).alias("attributes"), empty.alias("events"))
    return turns.span_events(said.unionByName(other).unionByName(root)).select("journey_id", "seq", "kind", "role", "content", "model_id", "reason", "error")


@_query("select event_id, case when b is distinct from event_type then event_type end as new_prompt from (select *, lag(event_type) over (partition by user_id order by event_id) as b from events)")
def prompt_changes(spark, sf):
    c = table(spark, sf, "events").select("event_id", F.col("user_id").alias("journey_id"), F.col("event_type").alias("prompt"))
    return turns.changed(c, "event_id", ["prompt"]).select("event_id", "new_prompt")


@_query("""select event_id, '{"journey_id":"' || user_id || '","journey_metadata":{"agent":"a","session_token":"[REDACTED]"}}' as header, '{"message":{"content":"token k","tool_calls":[{"arguments":{"pin":"[REDACTED]","q":' || event_id || '}}]},"metadata":{"auth":"[REDACTED]"}}' as event from events""")
def redact_headers(spark, sf):
    head = F.concat(F.lit('{"journey_id":"'), F.col("user_id").cast("string"), F.lit('","journey_metadata":{"agent":"a","session_token":"'), "event_type", F.lit('"}}'))
    event = F.concat(F.lit('{"message":{"content":"token k","tool_calls":[{"arguments":{"pin":1,"q":'), F.col("event_id").cast("string"), F.lit('}}]},"metadata":{"auth":"'), "event_type", F.lit('"}}'))
    return table(spark, sf, "events").select("event_id", redaction.redact_header_json(head).alias("header"), redaction.redact_event_json(event).alias("event"))


# ---- tables and streams


# Upserted twice: the second time rows of odd ids are replaced, and rows of new ids come in.
@_query("select doc_id as id, case when doc_id % 2 = 1 then 'new' else 'old' end as value from documents union all select -1 - doc_id, 'new' from labels")
def upsert(spark, sf):
    root = folder(spark, "table")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    keyed.upsert(spark, root, d.withColumn("value", F.lit("old")), ["id"])
    more = d.where("id % 2 = 1").unionByName(table(spark, sf, "labels").select((-1 - F.col("doc_id")).alias("id")))
    return keyed.upsert(spark, root, more.withColumn("value", F.lit("new")), ["id"])


# In two micro-batches, the repeats and every second event before the rest.
@_query(_FOLD + "select cast(journey_id as varchar) as journey_id, verdict.duplicates, verdict.rejected, missing, writers, terminated, reason is null as complete, reason, (select count(*) from sized s where s.journey_id = verdict.journey_id) as steps from verdict")
def live_fold(spark, sf):
    root = folder(spark, "live")
    e = events(spark, sf)
    early = (F.col("arrival") == 1) | (F.col("seq") % 2 == 1)
    for part in (e.where(early), e.where(~early)):
        part.coalesce(4).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        state.live_fold(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    verdicts = keyed.current(spark, f"{root}/out/verdicts", "journey_id string, rejected long, missing long, writers long, terminated boolean, complete boolean, reason string, duplicates long")
    steps = keyed.current(spark, f"{root}/out/steps", "journey_id string, steps array<struct<step_index:long>>")
    return verdicts.join(steps.select("journey_id", F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("steps")), "journey_id")


# Drained twice over a stream; journeys divisible by 10 fail the first time.
@_query(_RAW + "select journey_id, cast(count(*) filter (where arrival = 0) as bigint) as events, case when journey_id % 10 = 0 then 2 else 1 end as drained_in from ev group by 1")
def drain(spark, sf):
    root = folder(spark, "drain")
    events(spark, sf).where("arrival = 0").select("journey_id", "seq", "event_id", "kind").write.parquet(f"{root}/in")
    sent = f"{root}/sent"
    for n in (1, 2):

        def sink(rows, n=n):
            bad = (F.col("journey_id").cast("long") % 10 == 0) & F.lit(n == 1)
            rows.where(~bad).select("journey_id", "seq", F.lit(n).alias("pass")).write.mode("append").parquet(sent)
            return rows.select("journey_id").distinct().withColumn("error", F.when(bad, "refused"))

        stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
        ingest.drain(stream, f"{root}/acks", sink, f"{root}/checkpoint{n}").awaitTermination()
    done = spark.read.parquet(sent)
    return done.groupBy(F.col("journey_id").cast("long").alias("journey_id")).agg(F.count("*").alias("events"), F.max("pass").alias("drained_in"))


@_query(_FOLD + "select journey_id, cast(4 + case when verdict.reason is null then 3 else 2 end + count(*) filter (where kind <> 'voice') + case when verdict.reason is null then 0 else 1 end as bigint) as lines from k join verdict using (journey_id) group by journey_id, verdict.reason")
def render_journey(spark, sf):
    kept = fold.clean(events(spark, sf))
    text = reports.rendered(kept, fold.messages(kept), fold.verdicts(events(spark, sf)))
    return text.select("journey_id", F.size(F.split("text", "\n")).cast("long").alias("lines"))


# The page after the first 1,000 events by size and id, and the last one, off an index of their order.
@_query("select event_id, event_type, value, p.name as page, case when p.name = 'later' then '" + catalog.encode_cursor(1100) + "' end as next_cursor, p.name = 'later' as has_more, n as total from (select event_id, event_type, value, row_number() over (order by value desc nulls last, event_id) - 1 as i, count(*) over () as n from events) e, (values ('later'), ('last')) p(name) where (p.name = 'later' and i between 1000 and 1099) or (p.name = 'last' and i >= n - 7)")
def indexed_pages(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    root = folder(spark, "pages")
    catalog.index_order(e, [F.desc_nulls_last("value"), F.col("event_id")], root)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields)
    later = catalog.indexed_page(spark, root, kind, catalog.encode_cursor(1000), 100)
    last = catalog.indexed_page(spark, root, kind, catalog.encode_cursor(e.count() - 7), 100)
    return later.withColumn("page", F.lit("later")).unionByName(last.withColumn("page", F.lit("last")))


@_query("select cast(ceil(count(*) / 100.0) as bigint) as pages, cast(count(*) as bigint) as rows from nation cross join region")
def cursor_exhaustion(spark, sf):
    rows = table(spark, sf, "nation").crossJoin(F.broadcast(table(spark, sf, "region"))).select("n_nationkey", "r_regionkey")  # 125 rows
    sizes = [p.count() for p in catalog.pages(rows, [F.col("n_nationkey"), F.col("r_regionkey")], 100)]
    return spark.createDataFrame([(len(sizes), sum(sizes))], "pages long, rows long")


@_query("select 'p' || c_custkey as slug, case when c_custkey % 5 = 0 then sha256('new' || c_custkey) else sha256('k' || c_custkey) end as api_key_hash, c_custkey % 3 = 0 as revoked from customer")
def product_admin(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    roster = catalog.created(c.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("slug"), F.lit("n").alias("name"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("api_key")))
    key = F.regexp_extract("slug", r"(\d+)", 1).cast("long")
    rotated = catalog.rotated(roster, key % 5 == 0, F.concat(F.lit("new"), key.cast("string")))
    return catalog.revoked(rotated, key % 3 == 0).select("slug", "api_key_hash", "revoked")


@_query("select e.event_id, 'p' || c_custkey as product from events e join customer c on c.c_custkey = e.user_id and c.c_custkey % 3 <> 0")
def auth_lookup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    roster = catalog.created(c.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("slug"), F.lit("n").alias("name"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("api_key")))
    roster = catalog.revoked(roster, F.regexp_extract("slug", r"(\d+)", 1).cast("long") % 3 == 0)
    asked = table(spark, sf, "events").select("event_id", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("api_key"))
    return catalog.authorised(asked, roster).select("event_id", F.col("slug").alias("product"))

