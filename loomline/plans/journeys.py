"""Registered queries on whole journeys, provider formats and the catalog, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import parsers, redaction
from loomline.operators import corpus, fold, journeys, text
from loomline.plans.queries import _CALLS, _FOLD, _JOURNEYS, _METRICS, _RAW, _TASKS, QUERIES, SQL, _benchmark, _completions, _joined, _metrics, _query
from loomline.sources.tables import HEADERS, events, headers, table
from loomline.streaming import ingest

__all__ = ["QUERIES", "SQL"]


def _steps(spark, sf):
    return fold.steps(fold.messages(fold.clean(events(spark, sf))))


_PARTS = """, facts as (
  select journey_id, cast(count(distinct case when kind = 'message' then seq end) as bigint) as messages, coalesce(string_agg(signal, ',' order by seq) filter (where kind = 'signal'), '') as signals, coalesce(string_agg(voice, ',' order by seq) filter (where kind = 'voice'), '') as voice,
    max_by(reward, seq) filter (where kind = 'reward') as aggregated_reward, coalesce(max(case when kind = 'terminal' then reason end), 'NONE') as termination_reason, max(case when kind = 'terminal' then error end) as error,
    case when max(model_id) = min(model_id) then max(model_id) end as model_id, max(seq) filter (where kind = 'terminal') as terminal_seq from k group by 1
), seen as (
  select journey_id, coalesce(string_agg(v, ',' order by s) filter (where c = 'm'), '') as model_ids, string_agg(v, ',' order by s) filter (where c = 'w') as writers
  from (select journey_id, 'm' as c, model_id as v, min(seq) as s from k where model_id is not null group by all union all select journey_id, 'w', writer, min(seq) from k group by all) group by 1
)"""


@_query(_FOLD + _PARTS + "select * from facts join seen using (journey_id)")
def fold_partition(spark, sf):
    p = fold.parts(fold.clean(events(spark, sf)))
    return p.withColumns({c: F.array_join(c, ",") for c in ("signals", "writers", "voice", "model_ids")})


_ASSEMBLED = (
    _PARTS
    + """, tool as (
  select journey_id, cast(sum(case when role = 'assistant' then calls else 0 end) as bigint) as c, count(*) filter (where role = 'tool' and error <> '') as f, count(*) filter (where role = 'tool' and response is null) as n from msg group by 1
), done as (
  select journey_id, count(*) as num_steps, count(*) filter (where status = 'trainable') as trainable_steps, cast(arg_max(message_count, step_index) as bigint) as messages from sized group by 1
), head as ("""
    + HEADERS.format(conversations="conversations")
    + """) select journey_id, coalesce(data_source, 'unknown') as data_source, coalesce(data_source, 'unknown') || ':' || journey_id as task_id, trace_id, started_at, cast(coalesce(h.num_turns, num_steps) as bigint) as num_turns, num_steps, trainable_steps, done.messages, c as num_tool_calls, tool.f as num_tool_failures, tool.n as num_tool_response_none,
  case when c = 0 then 0.0::double else tool.f / cast(c as double) end as tool_error_rate, aggregated_reward, termination_reason, error, model_ids, model_id, reason is null as complete, reason as incomplete_reason
  from facts join seen using (journey_id) join verdict using (journey_id) join tool using (journey_id) join done using (journey_id) left join head h using (journey_id)"""
)


@_query(_FOLD + _ASSEMBLED)
def journeys_assembled(spark, sf):
    return fold.assemble(events(spark, sf), headers(spark, sf)).withColumn("model_ids", F.array_join("model_ids", ","))


QUERIES["journeys"], SQL["journeys"] = QUERIES.pop("journeys_assembled"), SQL.pop("journeys_assembled")


@_query(_FOLD + ", tool as (select journey_id, cast(sum(case when role = 'assistant' then calls else 0 end) as bigint) as num_tool_calls from msg group by 1) select journey_id, step_index, status, cast(message_count as bigint) as message_count, num_tool_calls, (select max_by(reward, seq) from k where k.journey_id = s.journey_id and kind = 'reward') as aggregated_reward from sized s join tool using (journey_id)")
def journey_detail(spark, sf):
    metrics = fold.assemble(events(spark, sf)).select("journey_id", "num_tool_calls", "aggregated_reward")
    return _steps(spark, sf).select("journey_id", "step_index", "status", "message_count").join(metrics, "journey_id")


@_query(_FOLD + "select journey_id, count(*) as num_steps, case when count(*) > 1 then 'last' end as steps_written, cast(arg_max(message_count, step_index) as bigint) as messages, arg_max(status, step_index) as status, any_value(reason is null) as complete, true as stamped from sized join verdict using (journey_id) group by 1")
def trajectory_documents(spark, sf):
    d = fold.journey_documents(events(spark, sf), headers(spark, sf), last_step_only=True).select("journey_id", F.from_json("document", "task struct<num_steps:bigint>, steps array<struct<messages:array<struct<role:string>>,trainable_status:string>>, _diagnostics struct<steps_written:string,complete:boolean>, telemetry struct<data:struct<content_hash:string>>").alias("d"))
    return d.select("journey_id", "d.task.num_steps", F.col("d._diagnostics.steps_written").alias("steps_written"), F.size(F.col("d.steps")[0]["messages"]).cast("long").alias("messages"), F.col("d.steps")[0]["trainable_status"].alias("status"), F.col("d._diagnostics.complete").alias("complete"), (F.length("d.telemetry.data.content_hash") == 64).alias("stamped"))


@_query(
    _FOLD
    + """select s.journey_id, s.step_index + 1 as num_steps, 'last' as steps_written, s.status, sha256((select string_agg(o.role || ':' || coalesce(o.content, o.response, '') || """ + _CALLS + """, chr(10) order by not o.swap, o.seq) from ord o where o.journey_id = s.journey_id and case when s.block is null then not o.swap and o.seq <= s.end_seq
  else (o.swap and o.k = s.block) or (not o.swap and o.role <> 'system' and o.seq <= s.end_seq) end)) as messages_sha256 from sized s qualify row_number() over (partition by s.journey_id order by s.step_index desc) = 1"""
)
def trajectory(spark, sf):
    t = fold.trajectories(events(spark, sf))
    return t.select("journey_id", "num_steps", F.lit("last").alias("steps_written"), "status", F.sha2(F.encode(_joined("messages"), "UTF-8"), 256).alias("messages_sha256"))


@_query(f"select * exclude (rejected_message, chosen_message) replace ([chosen] as chosen, [rejected] as rejected) from ({SQL['dpo_pairs']})")
def dpo_wrapped(spark, sf):
    d = fold.dpo_pairs(events(spark, sf))
    return d.select("journey_id", "rejected_step", "chosen_step", F.sha2(F.encode(_joined("prompt"), "UTF-8"), 256).alias("prompt_sha256"), *(F.array(c).alias(c) for c in ("chosen", "rejected")))


@_query(_RAW + ", a as (select journey_id, max(seq) as ack from ev where kind = 'signal' group by 1) select journey_id, count(*) as total, cast(max(ack) as bigint) as watermark, count(*) filter (where seq > coalesce(ack, -1)) as undrained from ev left join a using (journey_id) where arrival = 0 group by 1")
def spool_status(spark, sf):
    e = events(spark, sf).where("arrival = 0")
    acks = e.where("kind = 'signal'").groupBy("journey_id").agg(F.max("seq").alias("ack"))
    return ingest.spool_status(e, acks)


@_query(_FOLD + "select journey_id, coalesce(v.reason is null, false) as complete from (select distinct conv_id as journey_id from conversations) left join verdict v using (journey_id)")
def journeys_status(spark, sf):
    every = table(spark, sf, "conversations").select(F.col("conv_id").alias("journey_id")).distinct()
    return every.join(fold.verdicts(events(spark, sf)), "journey_id", "left").select("journey_id", F.coalesce("complete", F.lit(False)).alias("complete"))


@_query("select user_id as journey_id, cast(count(*) filter (where event_type <> 'error') as bigint) as calls, count(*) filter (where event_type = 'error') as failures, case when count(*) filter (where event_type <> 'error') = 0 then 0.0::double else count(*) filter (where event_type = 'error') / cast(count(*) filter (where event_type <> 'error') as double) end as error_rate from events group by 1")
def tool_metrics(spark, sf):
    failed = F.col("event_type") == "error"
    m = table(spark, sf, "events").select(F.col("user_id").alias("journey_id"), F.when(failed, "tool").otherwise("assistant").alias("role"), F.when(failed, 0).otherwise(1).alias("calls"), F.when(failed, "tool_error").alias("error"))
    return journeys.tool_metrics(m)


@_query("select doc_id, 1.0::double - coalesce(cast(l.toxic as double), 0) as accuracy from documents left join labels l using (doc_id)")
def tool_call_accuracy(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", journeys.tool_call_accuracy(F.col("toxic").cast("double")).alias("accuracy"))


@_query("select user_id as journey_id, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) as seconds from events group by 1")
def total_time(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("journey_id")).agg(F.min("ts").cast("string").alias("a"), F.max("ts").cast("string").alias("b"))
    return e.select("journey_id", F.round(journeys.total_time(F.col("a"), F.col("b")), 6).alias("seconds"))


@_query("select source, cast(sum(coalesce(n_chars, 0)) as bigint) as tokens, cast(sum(coalesce(l.quality, 0)) as bigint) as cost from documents left join labels l using (doc_id) group by 1")
def token_cost(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.sum(F.coalesce("n_chars", F.lit(0))).alias("tokens"), F.sum(F.coalesce("quality", F.lit(0))).cast("long").alias("cost"))


@_query("select doc_id, (quality + 1) / 2.0::double as aggregated_value, 'identity' as aggregation_method from labels")
def reward_scalar(spark, sf):
    return table(spark, sf, "labels").select("doc_id", journeys.reward_from_scalar(F.col("quality").cast("double"), -1.0, 1.0).alias("r")).select("doc_id", "r.aggregated_value", "r.aggregation_method")


@_query("select conv_id as journey_id, turn from conversations where cast(('0x' || substr(sha256(cast(conv_id as varchar)), 1, 8)) as bigint) / 4294967296.0::double < 0.5")
def sample_journeys(spark, sf):
    return journeys.sample(table(spark, sf, "conversations").select(F.col("conv_id").alias("journey_id"), "turn"), 0.5)


@_query("select event_id, coalesce(json_extract_string(props, '$.k'), '0') as k, event_type as source, (json_extract_string(props, '$.k') is distinct from '0') as differs from events")
def effective_tags(spark, sf):
    header = F.create_map(F.lit("k"), F.lit("0"), F.lit("source"), F.col("event_type"))
    e = table(spark, sf, "events").select("event_id", header.alias("h"), F.from_json("props", "map<string,string>").alias("t"))
    tags = journeys.effective_tags(F.col("h"), F.coalesce("t", F.create_map().cast("map<string,string>")))
    return e.select("event_id", tags["k"].alias("k"), tags["source"].alias("source"), (F.size(journeys.tag_delta(F.col("h"), F.col("t"))) > 0).alias("differs"))


@_query("select event_id, cast(before as bigint) as consumed, cast(greatest(n - before, 0) as bigint) as added from (select event_id, n, coalesce(lag(n) over (partition by user_id order by event_id), 0) as before from (select *, cast(floor(value) as bigint) as n from events))")
def request_delta(spark, sf):
    calls = table(spark, sf, "events").select("event_id", F.col("user_id").alias("journey_id"), F.floor("value").alias("n_messages"))
    return journeys.request_delta(calls, "event_id").select("event_id", "consumed", "added")


@_query("with recursive p as (select event_id as id, case when event_type <> 'signup' then event_id // 3 end as parent from events), t as (select id, id as root from p where parent is null or parent = id or parent not in (select id from p) union all select p.id, t.root from p join t on p.parent = t.id where p.id <> p.parent) select id as run_id, root from t")
def run_roots(spark, sf):
    parent = F.when(F.col("event_type") != "signup", F.floor(F.col("event_id") / 3))
    return journeys.run_roots(table(spark, sf, "events").select(F.col("event_id").alias("run_id"), parent.alias("parent_id")))


_KEPT = "select conv_id as journey_id, cast(dense_rank() over (partition by conv_id order by turn) - 1 as bigint) as step_index, role, text from (select * from conversations where role <> 'system')"


@_query(_KEPT)
def drop_dead_turns(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.when(F.col("role") != "system", F.col("text"))
    m = c.select(F.col("conv_id").alias("journey_id"), F.col("turn").alias("step_index"), "role", said.alias("content"), F.lit(0).alias("calls"), F.lit("").alias("response"))
    return journeys.drop_dead_turns(m)[0].select("journey_id", "step_index", "role", F.col("content").alias("text"))


@_query("select conv_id, 'steps[0].messages[' || (row_number() over (partition by conv_id order by turn) - 1) || '].role: invalid or missing' as error from (select *, case when role = 'system' then 'rules' else role end as r from conversations) qualify r = 'rules'")
def validate_schema(spark, sf):
    role = F.when(F.col("role") == "system", "rules").otherwise(F.col("role"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role")))).alias("messages"))
    return c.select("conv_id", F.explode(journeys.schema_errors(F.array(F.struct(F.lit("trainable").alias("trainable_status"), "messages")))).alias("error"))


_SECRETS = """'{"user":' || user_id || ',"auth-token":"' || event_type || '","inner":[{"pin":' || {pin} || ',"note":"","otp":null}]}'"""


def _payload():
    pin = F.when(F.col("event_type") == "error", F.lit("[]")).otherwise(F.col("event_id").cast("string"))
    return F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"auth-token":"'), "event_type", F.lit('","inner":[{"pin":'), pin, F.lit(',"note":"","otp":null}]}'))


@_query("""select event_id, '{"user":' || user_id || ',"auth-token":"[REDACTED]","inner":[{"pin":' || case when event_type = 'error' then '[]' else '"[REDACTED]"' end || ',"note":"","otp":null}]}' as payload from events""")
def redact_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", redaction.redact_json(_payload()).alias("payload"))


@_query("""select event_id, unnest(case when event_type = 'error' then [a] else [a, 'unredacted key ''pin'' (value: ' || event_id || ')'] end) as error from (select *, 'unredacted key ''auth-token'' (value: ''' || event_type || ''')' as a from events)""")
def validate_redaction(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(redaction.unmasked_json(_payload())).alias("error"))


# Each provider's wire format made of conversations: agents call a tool with the turn, users bring its result.
_PARSED = """with p as (select conv_id, turn, 0 as part, role, text as content, case when role = 'assistant' then '{"turn": ' || turn || '}' end as arguments, null as response from conversations
  union all select conv_id, turn, 1, 'tool', 'r' || turn, null, 'r' || turn from conversations where role = 'user')
select conv_id as id, cast(row_number() over (partition by conv_id order by turn, part) - 1 as int) as idx, role, content, arguments, response from p"""


def _entries(spark, sf, entry):
    """(id, payload): entry makes JSON columns of a turn, one for each role."""
    c = table(spark, sf, "conversations")
    said = F.to_json(F.struct(F.col("text").alias("t")))
    said = F.substring(said, 6, F.length(said) - 6)
    number = F.col("turn").cast("string")
    kinds = entry(said, number)
    line = F.when(F.col("role") == "assistant", kinds["assistant"]).when(F.col("role") == "user", kinds["user"]).otherwise(kinds["system"])
    lists = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lists.select("id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["line"]), ","), F.lit("]")).alias("payload"))


def _parsed(conversations, provider):
    m = parsers.parse_messages(conversations, provider)
    return m.select("id", "idx", "role", "content", F.get("tool_calls", F.lit(0))["arguments"].alias("arguments"), "tool_response.response")


def _filled(template: str, said, number):
    """A template with @ for the JSON text of the turn and # for its number."""
    parts, at = [], ""
    for ch in template:
        if ch in "@#":
            parts += [F.lit(at), said if ch == "@" else number]
            at = ""
        else:
            at += ch
    return F.concat(*parts, F.lit(at))


_WIRE = {
    "openai": {"assistant": '{"role":"ai","content":[{"type":"text","text":@},{"type":"image_url"}],"tool_calls":[{"id":"c#","function":{"name":"look","arguments":"{\\"turn\\":#}"}}]}', "user": '{"role":"human","content":@},{"role":"tool","tool_call_id":"c","content":"r#"}', "system": '{"role":"system","content":{"text":@}}'},
    "anthropic": {"assistant": '{"role":"assistant","content":[{"type":"text","text":@},{"type":"tool_use","id":"c#","name":"look","input":{"turn":#}}]}', "user": '{"role":"user","content":[{"type":"tool_result","tool_use_id":"c","content":[{"type":"text","text":"r#"}]},{"type":"text","text":@}]}', "system": '{"role":"system","content":@}'},
    "vercel": {"assistant": '{"role":"assistant","parts":[{"type":"text","text":@},{"type":"tool-call","toolCallId":"c#","toolName":"look","args":{"turn":#}}]}', "user": '{"role":"user","content":[{"type":"tool-result","toolCallId":"c","result":{"text":"r#"}},{"type":"text","text":@}]}', "system": '{"role":"system","content":@}'},
    "gemini": {"assistant": '{"role":"model","parts":[{"text":@},{"text":"hm","thought":true},{"function_call":{"name":"look","args":{"turn":#}}}]}', "user": '{"role":"user","parts":[{"function_response":{"name":"look","response":"r#"}},{"text":@}]}', "system": '{"role":"system","parts":[{"text":@}]}'},
}


def _provider(name):
    def query(spark, sf):
        return _parsed(_entries(spark, sf, lambda said, number: {k: _filled(t, said, number) for k, t in _WIRE[name].items()}), name)

    return query


for _name in _WIRE:
    QUERIES[f"parse_{_name}"], SQL[f"parse_{_name}"] = _provider(_name), _PARSED


@_query("select conv_id as id, turn, role, text as content from conversations")
def parse_pairs(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", F.when(F.col("role") == "assistant", " Chatbot ").when(F.col("role") == "user", "HUMAN").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))
    return parsers.parse_pairs(c, "turn").drop("error")


@_query("select conv_id as journey_id, conv_id || '__synthetic_' || (row_number() over (partition by conv_id order by turn) - 1) as synthetic_id, turn as ordinal, 'look' as tool, 'a' as dropped_argument, turn as b from conversations where role = 'assistant'")
def perturb_tool_calls(spark, sf):
    args = F.create_map(F.lit("b"), F.col("turn").cast("string"), F.lit("a"), F.lit("x"))
    calls = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("look").alias("name"), args.alias("arguments"))))
    m = table(spark, sf, "conversations").select(F.col("conv_id").alias("journey_id"), F.col("turn").alias("ordinal"), calls.alias("calls"))
    return journeys.perturb_tool_calls(m).select("journey_id", "synthetic_id", "ordinal", "tool", "dropped_argument", F.col("arguments")["b"].cast("long").alias("b"))


@_query("select conv_id as journey_id, turn as ordinal, text || ' (again)' as content, v.variant from conversations, (select unnest([0, 1]) as variant) v where role = 'user' and trim(text) <> ''")
def paraphrase(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("journey_id"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"))
    return journeys.rewrite_turns(turns, _again, 2)


def _again(texts):
    return [t + " (again)" for t in texts]


@_query(_JOURNEYS + "select date, count(*) as n from j group by 1")
def counts_by_date(spark, sf):
    return _metrics(spark, sf).groupBy(F.col("ts").cast("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@_query(_JOURNEYS + "select date, id, event_type as product from j")
def journeys_list(spark, sf):
    m = _metrics(spark, sf).select(F.col("ts").cast("date").cast("string").alias("date"), "id", F.col("event_type").alias("product"))
    return m.orderBy(F.desc_nulls_last("date"), F.desc_nulls_last("id"))


@_query(_METRICS + "select id, host, value from m where ts is not null and host is not null and event_type is not null")
def metrics_list(spark, sf):
    return _metrics(spark, sf).where("ts is not null and host is not null and event_type is not null").orderBy(F.desc("ts"), F.desc("id")).select("id", "host", "value")


@_query(_METRICS + "select event_type as product, count(distinct host) as projects from m group by 1")
def projects_per_product(spark, sf):
    return _metrics(spark, sf).groupBy(F.col("event_type").alias("product")).agg(F.count_distinct("host").alias("projects"))


# Files hold events of several journeys; a journey's header is that of its first file.
@_query(_RAW + ", f as (select *, (journey_id + seq) % 4 as path from ev where arrival = 0) select journey_id, 'h' || min(path) as header, count(*) as events from f group by 1")
def collect_merge(spark, sf):
    e = events(spark, sf).where("arrival = 0").withColumn("path", (F.col("journey_id") + F.col("seq")) % 4)
    heads = spark.range(4).select(F.col("id").alias("path"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("header"))
    merged, first = fold.collected(e, heads)
    return merged.groupBy("journey_id").agg(F.count("*").alias("events")).join(first, "journey_id")


@_query("select doc_id as journey_id from documents join labels l using (doc_id) where l.toxic = 0 and n_chars >= 1000 and lang <> 'de'")
def gc_candidates(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("journey_id"), F.lit(0).alias("highest_seq"), (-F.col("n_chars")).alias("mtime"), (F.col("lang") == "de").alias("open"))
    acks = table(spark, sf, "labels").select(F.col("doc_id").alias("journey_id"), F.col("toxic").alias("ack"))
    return journeys.collectable(d, acks, F.lit(0), 1000).select("journey_id")


@_query(_JOURNEYS + "select distinct date from j where date < cast(cast('2024-01-20' as date) - 10 as varchar)")
def prune_candidates(spark, sf):
    return counts_by_date(spark, sf).where(journeys.expired(F.col("date"), F.lit("2024-01-20").cast("date"), 10)).select("date")


@_query("select d.doc_id as name, case when l.doc_id is null then 'missing' else 'sha mismatch' end as problem from documents d left join labels l using (doc_id) where l.doc_id is null or l.quality = 0")
def registry_audit(spark, sf):
    r = table(spark, sf, "documents").select(F.col("doc_id").alias("name"), F.lit("1").alias("sha256"))
    return journeys.audit(r, table(spark, sf, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("string").alias("sha256"))).select("name", "problem")


@_query(_TASKS + "select id, trim(response) = trim(reference) as same from t where response is not null")
def exact_match(spark, sf):
    done = _benchmark(spark, sf).join(text.latest(_completions(spark, sf), ["id"], "line_no"), "id")
    return done.select("id", (corpus.METRICS["exact_match"](F.col("response"), F.col("reference")) == 1).alias("same"))


@_query("select count(*) as members from documents")
def watermark_tree(spark, sf):
    pairs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("content_hash"))
    return corpus.watermark_table(pairs).select("members")
