"""Relations of the engine derived from plain tables.

EVENTS turns conversations into an unordered, at-least-once event stream with
the damage such streams have: regenerated answers, missing and repeated events,
events after the end, two writers, replaced system prompts, tool calls, flags,
rewards and voice.  The text is plain SQL, so another engine can derive the same
stream; events() makes the same rows without its unions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = """
select conv_id as journey_id, seq, kind, concat(conv_id, '-', seq) as event_id, role, content, signal, target_seq,
  case when conv_id % 11 = 0 and seq % 2 = 1 then 'w1' else 'w0' end as writer, arrival,
  flag, calls, response, error, reward, reason, voice, model_id, call_id, call_name, call_args
from (
  select *, 0 as arrival from kept union all select *, 1 as arrival from kept where conv_id % 4 = 0
) x
"""
_NONE = "cast(null as varchar(9)) as flag, 0 as calls, cast(null as varchar(9)) as response, cast(null as varchar(9)) as error, cast(null as double) as reward, cast(null as varchar(9)) as reason, cast(null as varchar(9)) as voice, cast(null as varchar(9)) as model_id, cast(null as varchar(9)) as call_id, cast(null as varchar(9)) as call_name, cast(null as varchar(9)) as call_args"
_STEPS = f"""
with m as (
  select conv_id, turn, role, text, min(case when role = 'assistant' then turn end) over (partition by conv_id) as fa, max(turn) over (partition by conv_id) as la from {{conversations}}
), items as (
  select conv_id, turn, 0 as slot, 'message' as kind, role, text as content, nullif('', '') as signal,
    case when role = 'assistant' and conv_id % 16 = 5 and turn % 4 = 3 then 'summarization' when conv_id % 14 = 3 and turn % 6 in (2, 5) then 'interrupted' end as flag,
    case when role = 'assistant' and conv_id % 8 = 1 and turn % 4 = 1 then 1 else 0 end as calls,
    nullif('', '') as response, nullif('', '') as error, cast(null as double) as reward, nullif('', '') as reason, nullif('', '') as voice,
    case when role = 'assistant' and conv_id % 10 = 7 and turn > 2 then 'm2' when role = 'assistant' then 'm1' end as model_id,
    case when role = 'assistant' and conv_id % 8 = 1 and turn % 4 = 1 then concat('c', conv_id, '-', turn) end as call_id,
    case when role = 'assistant' and conv_id % 8 = 1 and turn % 4 = 1 then 'lookup' end as call_name,
    case when role = 'assistant' and conv_id % 8 = 1 and turn % 4 = 1 then concat(chr(123), '"turn":', turn, chr(125)) end as call_args from m
  union all select conv_id, turn, 1, 'signal', null, null, 'regenerated', {_NONE} from m where turn = fa and conv_id % 3 = 0
  union all select conv_id, turn, 2, 'message', 'assistant', concat(text, ' (again)'), null, {_NONE} from m where turn = fa and conv_id % 3 = 0
  union all select conv_id, turn, -1, 'message', 'system', 'new rules', null, {_NONE} from m where turn = 2 and conv_id % 13 = 0
  union all select conv_id, turn, 3, 'signal', null, null, case when conv_id % 2 = 0 then 'thumbs_up' else 'thumbs_down' end, {_NONE} from m where turn = fa + 2 and conv_id % 9 = 0
  union all select conv_id, turn, 4, 'message', 'tool', null, null, null, 0, case when conv_id % 16 = 1 then concat('r', turn) end, case when conv_id % 24 = 1 then 'tool_error' end, null, null, null, null, concat('c', conv_id, '-', turn), 'lookup', null from m where role = 'assistant' and conv_id % 8 = 1 and turn % 4 = 1
  union all select conv_id, turn, 5, 'voice', null, 'hm', null, null, 0, null, null, null, null, 'stt_transcript', null, null, null, null from m where turn = 0 and conv_id % 6 = 4
  union all select conv_id, turn, 6, 'reward', null, null, null, null, 0, null, null, conv_id % 10 / 8.0, null, null, null, null, null, null from m where turn = la and conv_id % 4 = 2
  union all select conv_id, turn, 7, 'reward', null, null, null, null, 0, null, null, 0.5, null, null, null, null, null, null from m where turn = la and conv_id % 12 = 2
), numbered as (
  select *, cast(row_number() over (partition by conv_id order by turn, slot) - 1 as bigint) as seq from items
), ends as (
  select conv_id, max(seq) + 1 as t from numbered group by conv_id
), stream as (
  select conv_id, seq, kind, role, content, signal, case when kind = 'signal' then seq - 1 end as target_seq, flag, calls, response, error, cast(reward as double) as reward, reason, voice, model_id, call_id, call_name, call_args from numbered
  union all select conv_id, t, 'terminal', null, null, null, null, null, 0, null, case when conv_id % 15 = 1 then 'gone' end, null, case when conv_id % 15 = 1 then 'ERROR' else 'ENV_DONE' end, null, null, null, null, null from ends where conv_id % 5 <> 0
  union all select conv_id, t + 1, 'message', 'user', 'late', null, null, null, 0, null, null, null, null, null, null, null, null, null from ends where conv_id % 5 <> 0 and conv_id % 6 = 1
), kept as (
  select * from stream where not (conv_id % 7 = 0 and seq = 1)
)
"""
#: What a file's header says of its journey; some say less.
HEADERS = "select conv_id as journey_id, case when conv_id % 9 <> 0 then 'loom' end as data_source, case when conv_id % 4 <> 0 then concat('t', cast(floor(conv_id / 3) as int)) end as trace_id, '2024-05-01T10:00:00Z' as started_at, case when conv_id % 12 = 5 then 99 end as num_turns from (select distinct conv_id from {conversations}) c"


def events_sql(conversations: str) -> str:
    return _STEPS.format(conversations=conversations) + EVENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: for work per row that is dearer than moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_ITEM = {"kind": "string", "role": "string", "content": "string", "signal": "string", "flag": "string", "calls": "int", "response": "string", "error": "string", "reward": "double", "reason": "string", "voice": "string", "model_id": "string", "call_id": "string", "call_name": "string", "call_args": "string"}


def _item(slot: int, kind: str, **given: Column | str | float) -> Column:
    """An entry of the stream at a turn; slot is its place among those of the turn."""
    given = {"kind": kind, "calls": 0} | given
    fields = [(c if isinstance(c, Column) else F.lit(c)).cast(t).alias(n) for n, t in _ITEM.items() for c in [given.get(n)]]
    return F.struct(F.lit(slot).alias("slot"), *fields)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of EVENTS, row by row instead of by unions: one exchange, by conversation."""
    conv, turn, role, agent = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("role") == "assistant"
    each, order = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn", "slot")
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.min(F.when(agent, turn)).over(each).alias("fa"), F.max("turn").over(each).alias("la"))
    called = agent & (conv % 8 == 1) & (turn % 4 == 1)
    flag = F.when(agent & (conv % 16 == 5) & (turn % 4 == 3), "summarization").when((conv % 14 == 3) & (turn % 6).isin(2, 5), "interrupted")
    model = F.when(agent & (conv % 10 == 7) & (turn > 2), "m2").when(agent, "m1")
    call_id = F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), turn.cast("string"))
    first, last = turn == F.col("fa"), turn == F.col("la")
    said = [
        F.when((turn == 2) & (conv % 13 == 0), _item(-1, "message", role="system", content="new rules")),
        _item(0, "message", role=role, content=F.col("text"), flag=flag, calls=F.when(called, 1).otherwise(0), model_id=model, call_id=F.when(called, call_id), call_name=F.when(called, "lookup"), call_args=F.when(called, F.concat(F.lit('{"turn":'), turn.cast("string"), F.lit("}")))),
        F.when(first & (conv % 3 == 0), _item(1, "signal", signal="regenerated")),
        F.when(first & (conv % 3 == 0), _item(2, "message", role="assistant", content=F.concat("text", F.lit(" (again)")))),
        F.when((turn == F.col("fa") + 2) & (conv % 9 == 0), _item(3, "signal", signal=F.when(conv % 2 == 0, "thumbs_up").otherwise("thumbs_down"))),
        F.when(called, _item(4, "message", role="tool", response=F.when(conv % 16 == 1, F.concat(F.lit("r"), turn.cast("string"))), error=F.when(conv % 24 == 1, "tool_error"), call_id=call_id, call_name="lookup")),
        F.when((turn == 0) & (conv % 6 == 4), _item(5, "voice", content="hm", voice="stt_transcript")),
        F.when(last & (conv % 4 == 2), _item(6, "reward", reward=(conv % 10) / 8.0)),
        F.when(last & (conv % 12 == 2), _item(7, "reward", reward=0.5)),
    ]
    numbered = m.select("conv_id", "turn", F.inline(F.array_compact(F.array(*said)))).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    numbered = numbered.withColumn("_end", F.max("seq").over(each) + 1)
    entry = F.struct("seq", *_ITEM)
    ended = (F.col("seq") == F.col("_end") - 1) & (conv % 5 != 0)

    def after(by: int, item: Column) -> Column:
        return F.struct((F.col("_end") + by).alias("seq"), *(item[n].alias(n) for n in _ITEM))

    gone = conv % 15 == 1
    terminal = after(0, _item(0, "terminal", error=F.when(gone, "gone"), reason=F.when(gone, "ERROR").otherwise("ENV_DONE")))
    late = after(1, _item(0, "message", role="user", content="late"))
    stream = numbered.select("conv_id", F.inline(F.array_compact(F.array(entry, F.when(ended, terminal), F.when(ended & (conv % 6 == 1), late)))))
    kept = stream.where(~((conv % 7 == 0) & (F.col("seq") == 1)))
    twice = F.explode(F.when(conv % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    seq = F.col("seq")
    stream = kept.select(
        conv.alias("journey_id"),
        "seq",
        "kind",
        F.concat(conv.cast("string"), F.lit("-"), seq.cast("string")).alias("event_id"),
        "role",
        "content",
        "signal",
        F.when(F.col("kind") == "signal", seq - 1).alias("target_seq"),
        F.when((conv % 11 == 0) & (seq % 2 == 1), "w1").otherwise("w0").alias("writer"),
        twice.alias("arrival"),
        "flag",
        "calls",
        "response",
        "error",
        "reward",
        "reason",
        "voice",
        "model_id",
        "call_id",
        "call_name",
        "call_args",
    )
    return whole(stream)


def whole(stream: DataFrame) -> DataFrame:
    """The stream of EVENTS with its calls as messages have them: tool_calls of the agent's, tool_id and tool_name of a tool's."""
    tool, call = F.col("role") == "tool", F.struct(F.col("call_name").alias("name"), F.col("call_args").alias("arguments"), F.col("call_id").alias("id"))
    made = {"tool_calls": F.when(F.col("call_args").isNotNull(), F.array(call)), "tool_id": F.when(tool, F.col("call_id")), "tool_name": F.when(tool, F.col("call_name"))}
    return stream.withColumns(made).drop("call_id", "call_name", "call_args")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HEADERS, conversations=table(spark, sf_dir, "conversations"))
