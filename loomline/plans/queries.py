"""The registered queries of the engine and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import canonical, pii
from loomline.operators import catalog, corpus, fold, text
from loomline.sources.tables import _STEPS, EVENTS, events, spread, table
from loomline.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Common table expressions of the SQL side: the stream, and what folding makes of it.
_RAW = _STEPS.format(conversations="conversations") + ", ev as (" + EVENTS + ")"
_FOLD = (
    _RAW
    + """, one as (
  select * from ev qualify row_number() over (partition by journey_id, event_id order by arrival) = 1
), ended as (select journey_id, min(seq) as t from one where kind = 'terminal' group by 1
), k as (select one.* from one left join ended using (journey_id) where t is null or seq <= t
), verdict as (
  select j.journey_id, cast(j.arrived - j.ids as bigint) as duplicates, cast(j.ids - x.n as bigint) as rejected, cast(x.top + 1 - x.seqs as bigint) as missing, x.writers, t is not null as terminated,
    case when x.writers > 1 then 'writer_conflict' when x.top + 1 > x.seqs then 'missing_events' when t is null then 'no_terminal' end as reason
  from (select journey_id, count(*) as arrived, count(distinct event_id) as ids from ev group by 1) j
  join (select journey_id, count(*) as n, max(seq) as top, count(distinct seq) as seqs, count(distinct writer) as writers from k group by 1) x using (journey_id)
  left join ended using (journey_id)
), sig as (
  select journey_id, target_seq, bool_or(signal in ('regenerated', 'user_edit')) as sup, bool_or(signal = 'thumbs_down') as down, bool_or(signal = 'thumbs_up') as up from k where kind = 'signal' group by all
), msg as (
  select k.journey_id, k.seq, k.role, k.content, k.calls, k.response, k.error, k.call_id, k.call_name, k.call_args, case when k.flag = 'summarization' then 'summarization_boundary' when k.flag = 'interrupted' and k.role = 'assistant' then 'not_trainable' when sup then 'superseded' when down then 'not_trainable' when up then 'trainable' when role = 'assistant' then 'trainable' else 'not_trainable' end as status
  from k left join sig on k.journey_id = sig.journey_id and k.seq = sig.target_seq where k.kind = 'message'
), fu as (select journey_id, min(seq) as fu from msg where role = 'user' group by 1
), ord as (
  select msg.*, fu, coalesce(role = 'system' and seq > fu, false) as swap,
    sum(case when coalesce(role = 'system' and seq > fu, false) then 0 else 1 end) over (partition by journey_id order by seq) as k
  from msg left join fu using (journey_id)
), blocks as (select journey_id, k, count(*) as n from ord where swap group by all
), con as (
  select o.*, lead(role) over w as nxt, coalesce(b.n, 0) as after, (select max(x.k) from blocks x where x.journey_id = o.journey_id and x.k < o.k) as before
  from ord o left join blocks b on o.journey_id = b.journey_id and o.k = b.k where not swap window w as (partition by o.journey_id order by seq)
), clo as (
  select *, (role = 'assistant' and (status = 'superseded' or (after > 0 and calls = 0))) as early from con
  where (role = 'assistant' and (status = 'superseded' or (after > 0 and calls = 0))) or nxt is null or (nxt = 'user' and fu <= seq and role <> 'user')
), st as (
  select journey_id, row_number() over (partition by journey_id order by seq) - 1 as step_index, k as end_ordinal, seq as end_seq, status,
    case when early then before when after > 0 then k else before end as block from clo
), sized as (
  select st.*, case when block is null then end_ordinal else (select n from blocks b where b.journey_id = st.journey_id and b.k = block)
    + (select count(*) from ord o where o.journey_id = st.journey_id and not o.swap and o.role <> 'system' and o.seq <= end_seq) end as message_count from st
)
"""
)
# A message's calls, or whose result it is.
_CALLS = "case when o.role = 'tool' then '<' || coalesce(o.call_id, '') || ' ' || coalesce(o.call_name, '') when o.call_args is not null then '|' || o.call_id || ' ' || o.call_name || ' ' || o.call_args else '' end"
_PROMPT = """(select string_agg(o.role || ':' || coalesce(o.content, o.response, '') || """ + _CALLS + """, chr(10) order by not o.swap, o.seq) from ord o where o.journey_id = {j} and case when {block} is null then not o.swap and o.seq <= {upto}
  else (o.swap and o.k = {block}) or (not o.swap and o.role <> 'system' and o.seq <= {upto}) end)"""


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _joined(messages: str):
    return F.array_join(F.transform(messages, _shown), "\n")


def _shown(m):
    calls = F.array_join(F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,arguments:string,id:string>>")), lambda c: F.concat(F.lit("|"), F.concat_ws(" ", c["id"], c["name"], c["arguments"]))), "")
    result = F.concat(F.lit("<"), F.coalesce(m["tool_id"], F.lit("")), F.lit(" "), F.coalesce(m["tool_name"], F.lit("")))
    return F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], m["response"], F.lit("")), F.when(m["role"] == "tool", result).otherwise(calls))


@_query(_RAW + "select journey_id, cast(count(*) - count(distinct event_id) as bigint) as dropped, cast(count(distinct event_id) as bigint) as kept from ev group by 1")
def fold_dedupe(spark, sf):
    e = fold.dealt(events(spark, sf))
    kept = fold.dedupe(e).groupBy("journey_id").agg(F.count("*").alias("kept"))
    return e.groupBy("journey_id").agg(F.count("*").alias("n")).join(kept, "journey_id").select("journey_id", (F.col("n") - F.col("kept")).alias("dropped"), "kept")


@_query(_FOLD + "select journey_id, cast(count(*) as bigint) as kept, cast(max(seq) as bigint) as top from k group by 1")
def fold_terminal_cut(spark, sf):
    return fold.clean(events(spark, sf)).groupBy("journey_id").agg(F.count("*").alias("kept"), F.max("seq").cast("long").alias("top"))


@_query(_FOLD + "select journey_id, cast(s as bigint) as missing_seq from (select journey_id, unnest(range(0, max(seq) + 1)) as s from k group by 1) x where not exists (select 1 from k where k.journey_id = x.journey_id and k.seq = x.s)")
def fold_gaps(spark, sf):
    return fold.gaps(fold.clean(events(spark, sf)))


@_query(_FOLD + "select journey_id, seq, role, status from msg")
def trainable_status(spark, sf):
    return fold.messages(fold.clean(events(spark, sf))).select("journey_id", "seq", "role", "status")


@_query(_FOLD + "select journey_id, duplicates, rejected, missing, writers, terminated, reason is null as complete, reason from verdict")
def completeness(spark, sf):
    return fold.verdicts(events(spark, sf))


@_query(_FOLD + "select journey_id, step_index, cast(end_ordinal as bigint) as end_ordinal, coalesce(cast(block as bigint), 0) as prefix_block, status, cast(message_count as bigint) as message_count from sized")
def steps(spark, sf):
    return fold.steps(fold.messages(fold.clean(events(spark, sf)))).drop("end_seq").fillna(0, ["prefix_block"])


@_query(_FOLD + f"select journey_id, step_index, cast(message_count as bigint) as n_messages, sha256({_PROMPT.format(j='s.journey_id', block='s.block', upto='s.end_seq')}) as messages_sha256 from sized s join verdict v using (journey_id) where s.status = 'trainable' and v.reason is null")
def sft_examples(spark, sf):
    s = fold.sft_examples(events(spark, sf))
    return s.select("journey_id", "step_index", F.size("messages").cast("long").alias("n_messages"), F.sha2(F.encode(_joined("messages"), "UTF-8"), 256).alias("messages_sha256"))


@_query(_FOLD + "select distinct role, content, response, error, call_id, call_name, call_args from msg")
def message_store(spark, sf):
    m = fold.message_store(events(spark, sf)).select("message.*")
    call, tool = F.get("tool_calls", F.lit(0)), F.col("role") == "tool"
    return m.select("role", "content", "response", "error", F.when(tool, F.col("tool_id")).otherwise(call["id"]).alias("call_id"), F.when(tool, F.col("tool_name")).otherwise(call["name"]).alias("call_name"), call["arguments"].alias("call_args"))


@_query(_FOLD + f"select journey_id, step_index, s.status, cast(message_count as bigint) as n_messages, sha256({_PROMPT.format(j='s.journey_id', block='s.block', upto='s.end_seq')}) as messages_sha256 from sized s")
def steps_by_digest(spark, sf):
    stream = events(spark, sf)
    s = fold.spelled_out(fold.step_digests(stream), fold.message_store(stream))
    return s.select("journey_id", "step_index", "status", F.size("messages").cast("long").alias("n_messages"), F.sha2(F.encode(_joined("messages"), "UTF-8"), 256).alias("messages_sha256"))


@_query(
    _FOLD
    + f"""select p.journey_id, rejected_step, chosen_step, sha256({_PROMPT.format(j="p.journey_id", block="p.block", upto="p.first_seq - 1")}) as prompt_sha256, r.content as rejected, c.content as chosen, r.role || ':' || coalesce(r.content, '') as rejected_message, c.role || ':' || coalesce(c.content, '') || case when c.call_args is not null then '|' || c.call_id || ' ' || c.call_name || ' ' || c.call_args else '' end as chosen_message from (
  select s.journey_id, s.step_index as rejected_step, s.end_seq as rs, e.step_index as chosen_step, e.end_seq as cs, f.end_seq as first_seq, f.block
  from st s join verdict v on v.journey_id = s.journey_id and v.reason is null
  join st e on e.journey_id = s.journey_id and e.step_index = (select min(x.step_index) from st x where x.journey_id = s.journey_id and x.step_index > s.step_index and x.status <> 'superseded') and e.status = 'trainable'
  join st f on f.journey_id = s.journey_id and f.step_index = (select coalesce(max(x.step_index), -1) + 1 from st x where x.journey_id = s.journey_id and x.step_index < s.step_index and x.status <> 'superseded')
  where s.status = 'superseded') p join msg r on r.journey_id = p.journey_id and r.seq = rs join msg c on c.journey_id = p.journey_id and c.seq = cs"""
)
def dpo_pairs(spark, sf):
    d = fold.dpo_pairs(events(spark, sf))
    return d.select("journey_id", "rejected_step", "chosen_step", F.sha2(F.encode(_joined("prompt"), "UTF-8"), 256).alias("prompt_sha256"), "rejected", "chosen", *(_shown(F.col(c)).alias(c) for c in ("rejected_message", "chosen_message")))


@_query(
    _FOLD
    + """, c as (select journey_id, count(*) as events, count(*) filter (where kind = 'message') as messages, count(*) filter (where kind = 'signal') as signals, count(*) filter (where kind = 'reward') as rewards, count(*) filter (where kind = 'terminal') as terminals, count(*) filter (where kind = 'voice') as voice,
  cast(max(seq) as bigint) as highest_seq, string_agg(distinct writer, ',' order by writer) as writers, cast(case when bool_or(kind = 'signal') then 2 end as int) as watermark, count(*) filter (where seq > 2) as later from ev group by 1)
select journey_id, events, messages, signals, rewards, terminals, voice, highest_seq, c.writers, missing, duplicates as duplicates_dropped, terminated, reason is null as trainable, reason as problem, watermark, case when watermark is null then events else later end as undrained from c join verdict v using (journey_id)"""
)
def diagnostics(spark, sf):
    e = events(spark, sf)
    acks = e.where("kind = 'signal'").select("journey_id").distinct().withColumn("ack", F.lit(2))
    return fold.diagnostics(e, acks)


@_query(_RAW + "select journey_id, cast(max(seq) + 1 as bigint) as next_seq from ev group by 1")
def next_seq(spark, sf):
    return events(spark, sf).groupBy("journey_id").agg((F.max("seq") + 1).cast("long").alias("next_seq"))


@_query(_FOLD + "select count(*) as journeys, round(avg(n), 9) as mean_steps, round(avg(m), 9) as mean_messages from (select journey_id, count(*) as n, arg_max(message_count, step_index) as m from sized group by 1)")
def corpus_stats(spark, sf):
    s = corpus.corpus_stats(fold.steps(fold.messages(fold.clean(events(spark, sf)))))
    return s.select("journeys", F.round("mean_steps", 9).alias("mean_steps"), F.round("mean_messages", 9).alias("mean_messages"))


@_query(_RAW + "select journey_id, event_id, cast(seq as bigint) as seq from ev where arrival = 0 and seq > case when journey_id in (select journey_id from ev where kind = 'signal') then 2 else -1 end")
def undrained(spark, sf):
    e = events(spark, sf).where("arrival = 0")
    acks = e.where("kind = 'signal'").select("journey_id").distinct().withColumn("ack", F.lit(2))
    return ingest.undrained(e, acks).select("journey_id", "event_id", F.col("seq").cast("long").alias("seq"))


_SPLIT = "case when h < 0.1 then 'test' when h < 0.9 then 'train' else 'val' end"
_SPLITS = f"""with x as (select conv_id, cast(conv_id // 3 as varchar) as g from conversations group by 1), y as (select *, cast(('0x' || substr(sha256('{{"group_key":"' || g || '"}}'), 1, 8)) as bigint) / 4294967295.0::double as h from x), s as (select conv_id, g, {_SPLIT} as split from y) """


@_query(_SPLITS + "select conv_id, g as group_key, split from s")
def split_assign(spark, sf):
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    key = corpus.group_key(F.floor(F.col("conv_id") / 3))
    return ids.select("conv_id", key.alias("group_key"), corpus.assign_split(key).alias("split"))


@_query(_SPLITS + "select id, string_agg(distinct split, ',' order by split) as splits from (select conv_id // 2 as id, split from s) group by 1 having count(distinct split) > 1")
def check_leakage(spark, sf):
    return corpus.leakage(split_assign(spark, sf).select(F.floor(F.col("conv_id") / 2).alias("id"), "split"))


@_query("with c as (select lang as name, avg(n_chars) as value from documents group by 1), b as (select lang as name, avg(n_chars) as base from documents where source <> 'src0' group by 1) select name, round(abs(value - base) / abs(base), 9) as change from c join b using (name) where base <> 0 and abs(value - base) / abs(base) > 0.001")
def check_drift(spark, sf):
    d = table(spark, sf, "documents")
    mean = lambda x: x.groupBy(F.col("lang").alias("name")).agg(F.avg("n_chars").alias("value"))
    return corpus.drift(mean(d), mean(d.where("source <> 'src0'")), 0.001).select("name", F.round("change", 9).alias("change"))


@_query("select l.doc_id from labels l where not exists (select 1 from conversations c where c.conv_id = l.doc_id)")
def unmatched_reviews(spark, sf):
    journeys = table(spark, sf, "conversations").select(F.col("conv_id").alias("journey_id")).distinct()
    return corpus.unmatched(table(spark, sf, "labels").select(F.col("doc_id").alias("journey_id")), journeys).select(F.col("journey_id").alias("doc_id"))


@_query("select sha256(text) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def dedupe_exact(spark, sf):
    return text.dedupe_exact(table(spark, sf, "documents"), F.col("text"), "doc_id")


@_query(r"select doc_id, nfc_normalize(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) as text from documents")
def repair_encoding(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.repair(F.col("text")).alias("text"))


@_query()
def pii_scan(spark, sf):
    """Counts by rule and the masked samples, "rule: context" joined by line ends; Python's patterns have no counterpart in RE2, so tests compare it with them."""
    found = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", pii.scanned(F.col("text")).alias("found"))
    return found.select("doc_id", *(F.coalesce(F.col("found.counts")[r], F.lit(0)).cast("long").alias(f"n_{r.lower()}") for r in pii.RULES), F.array_join(F.transform("found.samples", lambda x: F.concat_ws(": ", x["rule"], x["context"])), "\n").alias("samples"))


@_query()
def pii_redact(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", pii.redacted(F.col("text")).alias("text"))


# Keys out of order, nulls at two depths and a volatile key; lists keep their nulls.
@_query("""select doc_id, sha256(c) as hash, concat_ws(':', source, lang, sha256(c)) as idempotency_key from (select *, '{"a":{"k":[' || n_chars || ',null,{"x":1}]},"lang":"' || lang || '","source":"' || source || '"}' as c from documents)""")
def content_hash(spark, sf):
    given = F.concat(F.lit('{"source": "'), "source", F.lit('", "idx": 3, "lang": "'), "lang", F.lit('", "z": null, "a": {"n": null, "idx": 1, "k": ['), F.col("n_chars").cast("string"), F.lit(', null, {"y": null, "x": 1}]}}'))
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", canonical.hash_json(given).alias("hash"))
    return d.select("doc_id", "hash", canonical.idempotency_key(F.col("source"), F.col("lang"), F.col("hash")).alias("idempotency_key"))


@_query(r"select page_id, case when s = '' then 'journey' else s end as stem from (select page_id, substr(regexp_replace(array_to_string(list_filter(string_split_regex(trim(url), '[/\\]'), lambda p: p not in ('', '.', '..')), '_'), '^\.+', ''), 1, 240) as s from pages)")
def safe_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.safe_stem(F.col("url")).alias("stem"))


@_query("select event_id, case lower(trim(event_type)) when 'system' then 'system' when 'user' then 'user' when 'assistant' then 'assistant' when 'tool' then 'tool' when 'human' then 'user' when 'ai' then 'assistant' when 'chatbot' then 'assistant' when 'model' then 'assistant' when 'tool_use' then 'assistant' when 'function' then 'tool' when 'tool_result' then 'tool' end as role from events")
def normalize_role(spark, sf):
    return table(spark, sf, "events").select("event_id", text.normalize_role(F.col("event_type")).alias("role"))


# Completions are documents, and each is sent twice: the second, which is the later line, counts.
_TASKS = "with t as (select b.item_id as id, b.text as reference, case when d.doc_id % 2 = 0 then b.text || ' ' else d.text end as response from benchmark b left join documents d on d.doc_id = b.item_id) "


def _benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("reference"))


def _completions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    right = d.join(_benchmark(spark, sf), "id").select("id", F.when(F.col("id") % 2 == 0, F.concat("reference", F.lit(" "))).otherwise(F.col("text")).alias("response"), F.lit(2).alias("line_no"))
    return right.unionByName(d.select("id", F.lit("draft").alias("response"), F.lit(1).alias("line_no")).join(right.select("id"), "id", "left_semi"))


@_query(_TASKS + "select id, case when response is null then 0.0::double when trim(response) = trim(reference) then 1.0::double else 0.0::double end as score, response is null as missing from t")
def eval_run(spark, sf):
    return corpus.eval_run(_benchmark(spark, sf), _completions(spark, sf), corpus.METRICS["exact_match"])


@_query("select coalesce(a.doc_id, b.doc_id) as id, coalesce(cast(b.n_chars % 3 as double), 0) - coalesce(cast(a.quality as double), 0) as delta from labels a full join documents b on a.doc_id = b.doc_id")
def eval_compare(spark, sf):
    a = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    return corpus.compare_runs(a, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3).cast("double").alias("score")))


@_query("select distinct item_id from benchmark where item_id in (select doc_id from documents)")
def eval_overlap(spark, sf):
    return table(spark, sf, "benchmark").select("item_id").distinct().join(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")


def _metrics(spark, sf):
    e = table(spark, sf, "events")
    total = F.when(F.col("event_id") % 10 == 3, 0).otherwise(200)
    return e.select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("id"), "value", "event_type", total.cast("double").alias("total"), (F.col("event_id") % 8 + 1).alias("cpus"))


_JOURNEYS = "with j as (select event_id as id, event_type, cast(cast(ts as date) as varchar) as date from events) "
_METRICS = "with m as (select user_id as host, ts, event_id as id, value, event_type, case when event_id % 10 = 3 then 0 else 200 end as total, event_id % 8 + 1 as cpus from events) "


@_query(_METRICS + "select event_type, count(*) as n from m group by 1")
def counts_by_product(spark, sf):
    return _metrics(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@_query(_METRICS + "select event_type, host, count(*) as n from m group by all")
def counts_by_project(spark, sf):
    return _metrics(spark, sf).groupBy("event_type", "host").agg(F.count("*").alias("n"))


@_query(_METRICS + "select cast(cast(ts as date) as varchar) as date, count(*) as n from m group by 1 order by 1 desc limit 30")
def snapshots_by_date(spark, sf):
    return _metrics(spark, sf).groupBy(F.col("ts").cast("date").cast("string").alias("date")).agg(F.count("*").alias("n")).orderBy(F.desc("date")).limit(30)


@_query(_METRICS + "select host, id, round(pct, 9) as pct from (select *, count(*) over (partition by host) as c from (select host, id, 100.0 * value / total as pct, row_number() over (partition by host order by ts desc, id desc) as r from m where total > 0) where r <= 60) where c >= 2")
def host_pct_series(spark, sf):
    return catalog.host_series(_metrics(spark, sf), F.col("value"), F.col("total")).select("host", "id", F.round("pct", 9).alias("pct"))


@_query(_METRICS + "select host, id, value from m qualify row_number() over (partition by host order by ts desc, id desc) = 1")
def latest_per_host(spark, sf):
    return catalog.latest_per_host(_metrics(spark, sf)).select("host", "id", "value")


@_query(_METRICS + "select count(distinct host) as hosts, count(distinct event_type) as projects, arg_max(id, (ts, id)) as latest, cast((select sum(cpus) from (select cpus from m qualify row_number() over (partition by host order by ts desc, id desc) = 1)) as bigint) as cpus from m")
def fleet_summary(spark, sf):
    return catalog.fleet(_metrics(spark, sf).withColumnRenamed("event_type", "project"))


@_query(_METRICS + "select distinct event_type as project from m where event_type <> ''")
def projects(spark, sf):
    return _metrics(spark, sf).where("event_type <> ''").select(F.col("event_type").alias("project")).distinct()


@_query(_METRICS + "select id, host from m where cast(ts as date) = (select max(cast(ts as date)) from m)")
def journeys_latest_date(spark, sf):
    m = _metrics(spark, sf).withColumn("date", F.col("ts").cast("date"))
    return m.join(F.broadcast(m.agg(F.max("date").alias("date"))), "date").select("id", "host")


@_query(_METRICS + "select id, host, case when t > 50 then 'NTA=' end as next_cursor, t > 50 as has_more, t as total from (select id, host, ts from m order by ts desc, id desc limit 25 offset 25), (select count(*) as t from m)")
def paginate(spark, sf):
    return catalog.paginate(_metrics(spark, sf).select("id", "host", "ts"), [F.desc("ts"), F.desc("id")], "MjU=").drop("ts")


@_query("select doc_id, n_chars, case when n_chars is null then '—' when n_chars >= 1000000 then printf('%.1f MB', (n_chars + case when n_chars % 1000000 in (250000, 750000) then 50000 else 0 end) / 1e6) when n_chars >= 1000 then printf('%.1f KB', (n_chars + case when n_chars % 1000 in (250, 750) then 50 else 0 end) / 1e3) else n_chars || ' B' end as size from documents")
def format_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", catalog.format_bytes(F.col("n_chars").cast("double")).alias("size"))


@_query("select a.doc_id from documents a where not exists (select 1 from labels l where l.doc_id = a.doc_id)")
def reconcile(spark, sf):
    return ingest.gone_files(table(spark, sf, "documents").select(F.col("doc_id").alias("path")), table(spark, sf, "labels").select(F.col("doc_id").alias("path"))).withColumnRenamed("path", "doc_id")


@_query("select a.doc_id as path from documents a left join labels l using (doc_id) where l.doc_id is null or l.doc_id % 2 = 1")
def changed_files(spark, sf):
    d = table(spark, sf, "documents")
    listing = d.select(F.col("doc_id").alias("path"), F.lit(0).alias("mtime"), F.col("n_chars").alias("size"))
    state = d.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("path"), F.lit(0).alias("mtime"), (F.col("n_chars") + F.col("doc_id") % 2).alias("size"))
    return ingest.changed_files(listing, state).select("path")
