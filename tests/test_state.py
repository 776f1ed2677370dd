"""Journeys folded from state: any order of arrival, restarts, and state that goes."""

import random
import time

import pytest

from loomline.operators import fold
from loomline.sinks import keyed
from loomline.sources import tables
from loomline.streaming import state

SF = "/root/testdata/sf0.001"
COLUMNS = ["duplicates", "rejected", "missing", "writers", "terminated", "complete", "reason"]


def folded(events):
    v = {str(r["journey_id"]): tuple(r[c] for c in COLUMNS) for r in fold.verdicts(events).collect()}
    s = {}
    for r in fold.steps(fold.messages(fold.clean(events))).orderBy("step_index").collect():
        s.setdefault(str(r["journey_id"]), []).append((r["step_index"], r["end_ordinal"], r["end_seq"], r["prefix_block"], r["status"], r["message_count"]))
    return v, s


def live(spark, root):
    v = keyed.current(spark, f"{root}/verdicts", "journey_id string, rejected long, missing long, writers long, terminated boolean, complete boolean, reason string, duplicates long")
    s = keyed.current(spark, f"{root}/steps", "journey_id string, steps array<struct<step_index:long,end_ordinal:long,end_seq:long,prefix_block:long,status:string,message_count:long>>")
    return {r["journey_id"]: tuple(r[c] for c in COLUMNS) for r in v.collect()}, {r["journey_id"]: [tuple(x) for x in r["steps"]] for r in s.collect() if r["steps"]}


@pytest.fixture(scope="module")
def events(spark):
    return tables.events(spark, SF).where("journey_id < 30").cache()


def test_any_order_of_arrival_gives_the_batch_fold(spark, events, tmp_path):
    """Two micro-batches in shuffled order, each by a query of its own from the checkpoint of the one before."""
    rows = events.collect()
    random.Random(2).shuffle(rows)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    n = len(rows)
    for part in (rows[: n // 2], rows[n // 2 :]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(src)
        state.live_fold(spark.readStream.schema(events.schema).parquet(src), root, str(tmp_path / "cp")).awaitTermination()
    got, want = live(spark, root), folded(events)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_a_late_event_changes_its_journey_alone(spark, tmp_path):
    schema = "journey_id string, seq long, kind string, event_id string, role string, content string, writer string, arrival long"
    src, root = str(tmp_path / "in"), str(tmp_path / "out")

    def add(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        state.live_fold(spark.readStream.schema(schema).parquet(src), root, str(tmp_path / "cp")).awaitTermination()
        return live(spark, root)

    v, s = add(("a", 0, "message", "e0", "user", "hi", "w", 0), ("a", 2, "terminal", "e2", None, None, "w", 0), ("b", 0, "message", "f0", "user", "x", "w", 0))
    assert v["a"][-1] == "missing_events" and v["b"][-1] == "no_terminal" and [x[4] for x in s["a"]] == ["not_trainable"]
    v, s = add(("a", 1, "message", "e1", "assistant", "ho", "w", 1), ("a", 1, "message", "e1", "assistant", "ho", "w", 2))
    assert v["a"][0] == 1 and v["a"][-2:] == (True, None) and v["b"][-1] == "no_terminal" and [x[4] for x in s["a"]] == ["trainable"]


def test_state_goes_after_the_end():
    rows = [["e0", 0, 0, "message", "user", None, None, "w", None, 0, 1], ["e1", 1, 0, "terminal", None, None, None, "w", None, 0, 1]]
    facts = {}
    state.merged(facts, rows[1:])
    assert not state.ended(facts)
    state.merged(facts, [rows[0], [*rows[0][:2], -1, *rows[0][3:]]])
    assert state.ended(facts) and facts["e0"][-1] == 2 and facts["e0"][2] == -1


def test_closed_journeys_ignore_what_comes_later(spark, tmp_path):
    schema = "journey_id string, seq long, kind string, event_id string, role string, writer string, arrival long"
    src, root = str(tmp_path / "in"), str(tmp_path / "out")

    def add(*rows, grace):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        state.live_fold(spark.readStream.schema(schema).parquet(src), root, str(tmp_path / "cp"), grace_ms=grace).awaitTermination()
        return live(spark, root)[0]

    assert add(("a", 0, "message", "e0", "user", "w", 0), ("a", 1, "terminal", "e1", None, "w", 0), grace=1)["a"][-1] is None
    time.sleep(0.1)
    add(("b", 0, "message", "f0", "user", "w", 1), grace=1)  # the timer is looked at by the next batch
    assert add(("a", 0, "message", "late", "user", "w2", 2), grace=1)["a"][-1] is None
