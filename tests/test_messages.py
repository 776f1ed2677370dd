"""Whole messages: calls, results, reasoning and definitions from the wire into every export, and back onto the wire."""

import json

import pytest

from pyspark.sql import functions as F

from loomline.operators import fold
from loomline.sinks import shards
from loomline.sources import wire
from loomline.streaming import ingest

CALL = {"name": "lookup", "arguments": '{"q":"x"}', "id": "c1"}
TOOL = {"name": "lookup", "description": "d", "parameters": "{}"}


def said(seq, role, **message):
    return {"journey_id": "j", "seq": seq, "kind": "message", "event_id": f"e{seq}", "message": {"role": role, **message}}


def lines(arguments='{"q":"x"}'):
    return [
        said(0, "system", content="rules", tool_definitions=[TOOL]),
        said(1, "user", content="where?"),
        said(2, "assistant", content="bad", tool_calls=[CALL | {"id": "c0"}]),
        {"journey_id": "j", "seq": 3, "kind": "signal", "event_id": "e3", "signal": {"signal": "regenerated", "target_seq": 2}},
        said(4, "assistant", content=None, reasoning="think", tool_calls=[CALL | {"arguments": arguments}]),
        said(5, "tool", tool_response={"id": "c1", "name": "lookup", "response": "r", "error": ""}),
        said(6, "assistant", content="there", metadata={"interrupted": False}),
        {"journey_id": "j", "seq": 7, "kind": "reward", "event_id": "e7", "reward": {"aggregated_value": 0.5}},
        {"journey_id": "j", "seq": 8, "kind": "voice", "event_id": "e8", "voice": {"voice_kind": "stt_transcript", "text": "hm"}},
        {"journey_id": "j", "seq": 9, "kind": "terminal", "event_id": "e9", "terminal": {"termination_reason": "ENV_DONE"}},
    ]


def stream(spark, folder, **kw):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "j.jsonl").write_text("\n".join(json.dumps(x) for x in [{"schema_version": "2.0", "journey_id": "j"}, *lines(**kw)]) + "\n")
    return wire.flat(wire.events(wire.lines(spark, str(folder))))


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    return stream(spark, tmp_path_factory.mktemp("in") / "a")


def shown(m):
    calls = [c.asDict() for c in m["tool_calls"] or []]
    return m["role"], m["content"], calls, m["tool_id"], m["tool_name"], m["response"], m["reasoning"], [d.asDict() for d in m["tool_definitions"] or []]


HISTORY = [
    ("system", "rules", [], None, None, None, None, [TOOL]),
    ("user", "where?", [], None, None, None, None, []),
    ("assistant", "bad", [CALL | {"id": "c0"}], None, None, None, None, []),
    ("assistant", None, [CALL], None, None, None, "think", []),
    ("tool", None, [], "c1", "lookup", "r", None, []),
    ("assistant", "there", [], None, None, None, None, []),
]


def test_examples_and_trajectories_hold_whole_messages(events):
    (example,) = fold.sft_examples(events).collect()
    assert [shown(m) for m in example["messages"]] == HISTORY
    (trajectory,) = fold.trajectories(events).collect()
    assert [shown(m) for m in trajectory["messages"]] == HISTORY


def test_pairs_hold_whole_answers(events):
    (pair,) = fold.dpo_pairs(events).collect()
    assert [shown(m) for m in pair["prompt"]] == HISTORY[:2]
    assert shown(pair["rejected_message"]) == HISTORY[2] and shown(pair["chosen_message"]) == HISTORY[-1]


def test_documents_hold_calls_and_their_hash_follows_an_argument(spark, events, tmp_path):
    document = lambda e: json.loads(fold.journey_documents(e).first()["document"])
    d = document(events)
    m = d["steps"][-1]["messages"]
    assert m[3]["tool_calls"] == [CALL] and m[3]["reasoning"] == "think" and m[4]["tool_response"] == {"error": "", "id": "c1", "name": "lookup", "response": "r"} and m[0]["tool_definitions"] == [TOOL]
    other = document(stream(spark, tmp_path / "b", arguments='{"q":"y"}'))
    assert other["telemetry"]["data"]["content_hash"] != d["telemetry"]["data"]["content_hash"]
    assert d["metrics"]["num_tool_calls"] == 2


def test_steps_refer_to_messages_by_digest(spark, events):
    store, steps = fold.message_store(events), fold.step_digests(events)
    assert store.count() == 6
    rows = {r["step_index"]: r for r in fold.spelled_out(steps, store).collect()}
    assert [shown(m) for m in rows[1]["messages"]] == HISTORY and [shown(m) for m in rows[0]["messages"]] == HISTORY[:3]
    twice = events.union(events.withColumn("journey_id", F.lit("k")).withColumn("event_id", F.concat(F.lit("k"), "event_id")))
    assert fold.message_store(twice).count() == 6  # said again elsewhere, kept once


def test_what_a_sink_writes_reads_back(spark, events, tmp_path):
    head = lambda e: e.select("journey_id").distinct().withColumn("line", F.lit('{"schema_version":"2.0","journey_id":"j"}'))
    ingest.file_sink(str(tmp_path / "sunk"), head)(events).collect()
    scanned = wire.events(wire.lines(spark, str(tmp_path / "sunk")))
    assert [r["state"] for r in scanned.collect()] == ["ok"] * 10
    again = wire.flat(scanned).drop("arrival")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, events.select(*again.columns).collect()))


def test_rendered_events_of_a_stream_that_lacks_columns(spark):
    e = spark.createDataFrame([("a", 0, "message", "x", "user", "hi"), ("a", 1, "terminal", "y", None, None), ("a", 2, "signal", "z", None, None)], "journey_id string, seq long, kind string, event_id string, role string, content string")
    assert [r["line"] for r in wire.rendered(e).orderBy("seq").collect()] == [
        '{"event_id":"x","journey_id":"a","kind":"message","message":{"content":"hi","role":"user"},"seq":0}',
        '{"event_id":"y","journey_id":"a","kind":"terminal","seq":1,"terminal":{}}',
        '{"event_id":"z","journey_id":"a","kind":"signal","seq":2,"signal":{}}',
    ]


def test_a_batch_is_appended_once(spark, events, tmp_path):
    """Run again whole, after half of a file was written, and next to other batches."""
    root, file = str(tmp_path / "sunk"), tmp_path / "sunk" / "j.jsonl"
    head = spark.createDataFrame([("j", '{"schema_version":"2.0"}')], "journey_id string, line string")
    some, rest = wire.rendered(events.where("seq < 4")), wire.rendered(events.where("seq >= 4"))
    assert shards.append_wire(some, head, root, "b1") == file.stat().st_size
    first = file.read_bytes()
    assert shards.append_wire(some, head, root, "b1") == 0 and file.read_bytes() == first
    shards.append_wire(rest, head, root, "b2")
    whole = file.read_bytes()
    assert whole.startswith(first) and whole.count(b"schema_version") == 1 and whole.count(b"\n") == 11
    file.write_bytes(whole[: len(first) + 50])  # the task was lost in the middle of a line
    assert shards.append_wire(rest, head, root, "b2") == len(whole) - len(first) - 50 and file.read_bytes() == whole
    file.write_bytes(first + b"something else")
    with pytest.raises(Exception, match="other data"):
        shards.append_wire(rest, head, root, "b2")


def test_a_drain_that_failed_before_it_acknowledged_sends_nothing_twice(spark, events, tmp_path):
    head = lambda e: e.select("journey_id").distinct().withColumn("line", F.lit('{"schema_version":"2.0"}'))
    sink, file = ingest.file_sink(str(tmp_path / "sunk"), head), tmp_path / "sunk" / "j.jsonl"
    sink(events, "b1")
    once = file.read_bytes()
    (row,) = ingest.drain_batch(events, str(tmp_path / "acks"), sink, "b1").collect()
    assert row["sent"] == 10 and row["error"] is None and file.read_bytes() == once
    assert ingest.drain_batch(events, str(tmp_path / "acks"), sink, "b2").count() == 0 and file.read_bytes() == once


def test_events_are_let_in_once_a_day(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "j.jsonl").write_text("\n".join(json.dumps(x) for x in [{"schema_version": "2.0", "journey_id": "j"}, *lines()]) + "\n")
    spark.createDataFrame([("j", "e0", "2024-05-01"), ("j", "e1", "2024-05-02"), ("k", "e2", "2024-05-02")], "journey_id string, event_id string, date string").write.partitionBy("date").parquet(str(tmp_path / "stored"))
    stored = spark.read.schema("journey_id string, event_id string, date string").parquet(str(tmp_path / "stored"))
    posted = wire.lines(spark, str(tmp_path / "p"))
    let_in = lambda *on: {r["event_id"] for r in ingest.admitted(posted, stored, *on).collect()}
    every = {f"e{i}" for i in range(10)}
    assert let_in("2024-05-01") == every - {"e0"} and let_in("2024-05-02") == every - {"e1"} and let_in("2024-05-03") == every and let_in() == every - {"e0", "e1"}
    plan = ingest.admitted(posted, stored, "2024-05-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_shards_rotate_by_bytes_and_by_day(spark, tmp_path):
    rows = [(j, d, 10 * k + i, "é" * (5 + 3 * i), '{"h":1}') for j in ("a", "b/c") for k, d in enumerate(("2024-05-01", "2024-05-02")) for i in range(7)]
    lines = spark.createDataFrame(rows, "journey_id string, date string, seq long, line string, head string").repartition(3)
    written = {r["path"].rpartition("/journeys/")[2]: r["bytes"] for r in shards.rotated(lines, str(tmp_path), max_bytes=60).collect()}
    want = {}
    for j, d in {(r[0], r[1]) for r in rows}:
        n, size = 0, 8
        for r in sorted(x for x in rows if x[:2] == (j, d)):
            if size >= 60:
                n, size = n + 1, 8
            size += len(r[3].encode()) + 1
            want[j, d, n] = size
    assert sorted(written.values()) == sorted(want.values()) and len(written) == len(want)
    assert {k.rpartition("/")[2] for k in written} == {f"{d}.{n}.jsonl" for _, d, n in want}
    assert (tmp_path / "journeys/a/2024-05-01.0.jsonl").read_text().startswith('{"h":1}\n' + "é" * 5 + "\n")


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_ranges_give_the_lines_of_whole_files(spark, tmp_path, size):
    head = b'{"schema_version":"2.0","journey_id":"j"}'
    contents = [head + b"\n{}\n\n  \n" + "é".encode() * 40 + b"\n{", head + b"\n{}\n", b"\n\n{}\n", b"no header\n{}\n", head + b"\n\xff\xfe{}\n{}", head, b"\n", b""]
    for i, c in enumerate(contents if size > 1 else contents[2:4] + contents[6:]):
        (tmp_path / f"f{i}.jsonl").write_bytes(c)
    rows = lambda df: sorted(tuple(r) for r in df.select("path", "line_no", "line", "last_open", F.coalesce("refused", F.lit("-"))).collect())
    want = rows(wire.lines(spark, str(tmp_path)))
    assert want and rows(wire.ranged_lines(spark, str(tmp_path), range_bytes=size)) == want
