"""Usage of messages: unlike providers, what is no number, sums against Python."""

import json
import random

from loomline.operators import usage
from loomline.sources import wire

M = "journey_id string, seq long, role string, usage string"


def test_what_providers_report(spark):
    given = {
        '{"prompt_tokens":3,"completion_tokens":4,"total_tokens":9,"cost":0.25}': (3, 4, 9, 0.25),
        '{"input_tokens":3,"output_tokens":4}': (3, 4, 7, None),
        '{"promptTokenCount":3}': (3, None, 3, None),
        '{"inputTokens":null,"outputTokens":2,"total_cost":1}': (None, 2, 2, 1.0),
        '{"prompt_tokens":"many"}': (None, None, None, None),
        "[1]": (None, None, None, None),
        "{": (None, None, None, None),
        "": (None, None, None, None),
    }
    d = spark.createDataFrame([(u,) for u in given], "u string")
    got = {r["u"]: tuple(r["r"]) for r in d.select("u", usage.reported(d["u"]).alias("r")).collect()}
    assert got == given
    none = spark.createDataFrame([(None,)], "u string")
    assert tuple(none.select(usage.reported(none["u"]).alias("r")).first()["r"]) == (None,) * 4


def test_sums_by_turn_and_journey(spark):
    r, rows = random.Random(3), []
    for j in ("a", "b", None):
        rows += [(j, i, r.choice(["user", "assistant", "tool"]), r.choice([None, "x", json.dumps({"input_tokens": i, "output_tokens": 1})])) for i in range(20)]
    rows.append(("quiet", 0, "user", None))
    want, whole = {}, {}
    for j in ("a", "b", None, "quiet"):
        turn, before = 0, None
        for _, i, role, u in (x for x in rows if x[0] == j):
            turn += role == "user" and before is not None and before != "user"
            before = role
            n = sum(json.loads(u).values()) if u and u != "x" else 0
            want[j, turn] = want.get((j, turn), 0) + n
            whole[j] = whole.get(j, 0) + n
    d = spark.createDataFrame(rows, M).repartition(3)
    assert {(x["journey_id"], x["turn"]): x["total_tokens"] for x in usage.by_turn(d).collect()} == want
    assert {x["journey_id"]: x["total_tokens"] for x in usage.by_journey(d).collect()} == {j: n or None for j, n in whole.items()}
    assert usage.by_turn(d.limit(0)).count() == usage.by_journey(d.limit(0)).count() == 0


def test_sums_have_one_exchange(spark):
    d = spark.createDataFrame([("a", 0, "user", None)], M)
    for f in (usage.by_turn, usage.by_journey):
        plan = f(d)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("+- == Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
        assert "Python" not in plan


def test_usage_outlives_the_wire(spark, tmp_path):
    d = spark.createDataFrame([("j", 0, "e", "assistant", "message", '{"input_tokens":7}'), ("j", 1, "f", "user", "message", None)], "journey_id string, seq long, event_id string, role string, kind string, usage string")
    lines = [x["line"] for x in wire.rendered(d).orderBy("seq").collect()]
    assert json.loads(lines[0])["message"]["usage"] == {"input_tokens": 7} and "usage" not in json.loads(lines[1])["message"]
    (tmp_path / "a.jsonl").write_text("\n".join(['{"schema_version":"2.0"}', *lines]) + "\n")
    assert [x["usage"] for x in wire.flat(wire.events(wire.lines(spark, str(tmp_path)))).orderBy("seq").collect()] == ['{"input_tokens":7}', None]
