import hashlib
import http.server
import json
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import canonical, parsers
from loomline.functions import documents as docs_of
from loomline.operators import documents, fold, turns
from loomline.plans import files as plans
from loomline.sinks import http as posts
from loomline.sinks import keyed, reports, shards
from loomline.sources import arrays, files, host, layouts, wire
from loomline.streaming import ingest


def test_files_appear_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json", "é"), ("b.json", None)], "name string, content string")
    got = {r["path"][len(str(tmp_path)) :]: (r["bytes"], r["sha256"]) for r in shards.write_files(rows, f"file://{tmp_path}".replace("file://", "")).collect()}
    assert got == {"/a/x.json": (2, hashlib.sha256("é".encode()).hexdigest()), "/b.json": (0, hashlib.sha256(b"").hexdigest())}
    assert not list(tmp_path.rglob("*.tmp")) and (tmp_path / "a/x.json").read_text() == "é"


def test_jsonl_and_trajectories(spark, tmp_path):
    rows = spark.createDataFrame([(2, "x", None), (1, "y", 3)], "b int, a string, c int")
    shards.write_jsonl(rows, str(tmp_path / "sft"), single=True)
    (only,) = (tmp_path / "sft").glob("part-*")
    assert sorted(only.read_text().splitlines()) == ['{"a":"x","b":2}', '{"a":"y","b":1,"c":3}']
    t = spark.createDataFrame([("../c/1", '{"b":1,"a":[2]}')], "conversation_id string, document string")
    shards.write_trajectories(t, str(tmp_path / "out")).collect()
    assert (tmp_path / "out/c_1.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'


class Handler(http.server.BaseHTTPRequestHandler):
    seen: list = []
    busy = 1

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Handler.seen.append((self.path, self.headers["Authorization"], self.headers["Content-Encoding"], body))
        if self.path.endswith("/late") and Handler.busy:
            Handler.busy -= 1
            self.send_response(429)
            self.send_header("Retry-After", "0.5")
        else:
            self.send_response(400 if self.path.endswith("/bad") else 200)
        answer = json.dumps([{"journey_id": "a"}, {"journey_id": "b", "error": "full"}]).encode()
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Handler.seen, Handler.busy = [], 1
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1"
    s.shutdown()


def test_posts_wait_when_told_and_fail_alone(spark, server):
    waits = []
    sink = posts.HttpSink(server, "k", sleep=waits.append)
    assert sink.send("late", "x\n") is None and waits == [0.5]
    assert sink.send("bad", "x\n") == "HTTP 400" and sink.send("a b", "x\n") is None
    assert sink.send_batch([("a", "x"), ("b", "y")]) == {"a": None, "b": "full"}
    assert Handler.seen[0][:3] == ("/v1/journeys/late", "Bearer k", "gzip") and Handler.seen[3][0] == "/v1/journeys/a%20b"
    sink.close()
    assert posts.HttpSink("http://127.0.0.1:9", timeout=0.2).send("a", "x").startswith(("ConnectionRefusedError", "OSError", "TimeoutError"))
    rows = spark.createDataFrame([("ok", "h\n", "l\n"), ("bad", "h\n", "l\n")], "journey_id string, head string, lines string")
    assert {tuple(r) for r in posts.send_all(rows, server).collect()} == {("ok", None), ("bad", "HTTP 400")}


def test_manifest_registry_and_card(spark, tmp_path):
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards/a.jsonl").write_text('{"a":1}\n\n{"a":2}')
    root = str(tmp_path / "manifests")
    for version in (1, 2):
        doc = reports.manifest(spark, "c", root, str(tmp_path / "shards"), "cv", "rh", {"seq": version, "hash": "h"})
        assert doc["version"] == version and doc["shards"][0]["rows"] == 3
        uri = reports.write_manifest(doc, root)
        for _ in range(2):
            reports.register(str(tmp_path / "registry.yaml"), "c", uri)
    found = layouts.registry(spark, str(tmp_path / "registry.yaml"), "corpora").collect()
    assert [(r["version"], r["uri"]) for r in found] == [(1, f"{root}/c/v1.json"), (2, f"{root}/c/v2.json")]
    assert found[1]["manifest_sha256"] == hashlib.sha256((tmp_path / "manifests/c/v2.json").read_bytes()).hexdigest()
    text = open(reports.write_card(doc, str(tmp_path), licence="MIT", pii_posture="none", intended_use="tests")).read()
    assert text.startswith("# c v2\n") and "(3 rows total)" in text and "Not yet split" in text
    assert layouts.registry(spark, str(tmp_path / "none.yaml"), "corpora").count() == 0
    run = reports.write_experiment(str(tmp_path), "run1", {"lr": 1}, "cv")
    assert json.load(open(run))["corpus_version"] == "cv"


def test_evaluation_reports(spark, tmp_path):
    run = spark.createDataFrame([("t2", 0.0, True), ("t1", 1.0, False)], "id string, score double, missing boolean")
    a = reports.eval_report("bench", "exact_match", run)
    js, md = reports.write_report(a, str(tmp_path))
    assert json.load(open(js))["mean_score"] == 0.5 and "- t2: 0.0000 (missing)" in open(md).read()
    b = reports.eval_report("other", "exact_match", run.where("id = 't2'").withColumn("id", F.lit("t3")))
    assert reports.compare_reports(a, b)["tasks"] == {"t1": -1.0, "t2": 0.0, "t3": 0.0}
    assert [r["benchmark"] for r in layouts.reports(spark, str(tmp_path)).collect()] == ["bench"]


def test_models_resolve_by_version_or_alias(spark):
    v = spark.createDataFrame([("m", 1, ["prod"]), ("m", 2, [])], "name string, version int, aliases array<string>")
    assert reports.resolve_model(v, "m", alias="prod").first()["version"] == 1 and reports.resolve_model(v, "m", 2).count() == 1
    with pytest.raises(ValueError):
        reports.resolve_model(v, "m", 1, "prod")


def test_malformed_small_documents_are_empty(spark, tmp_path):
    (tmp_path / "p.json").write_text("{[")
    assert layouts.products(spark, str(tmp_path / "p.json")).count() == 0
    assert layouts.products(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "b.yaml").write_text('{"name": "n", "metric": "exact_match", "tasks": [{"id": 1, "prompt": "p", "reference": "r"}]}')
    facts, tasks = layouts.benchmark(spark, str(tmp_path / "b.yaml"))
    assert facts == {"name": "n", "metric": "exact_match"} and [tuple(r) for r in tasks.collect()] == [("1", "p", "r")]


def test_entries_of_a_document_are_those_of_json_loads(tmp_path):
    whole = ['[]', ' [1, -2.5e3 ,null,true,"a"] ', '{}', '{"a":[1],"products":[{"slug":"\\u00e9\\ud83d\\ude00é","x":[1,{"y":"]}\\\\\\""}]},5],"z":{}}', '{"products":[1],"products":[2,3]}', '{"products":[1],"products":7}', '{"products":[]}', '{"product\\u0073":[4]}', "[[[]],[{}]]", "[12345]"]
    broken = ["", "[", "[1,]", "[1 2]", '{"products":[1]', '{"products":[1]}]', '{1:2}', '{"a":1,}', "[tru]", '["a]', "[1]x", "{[", '{"products" [1]}', '[{"a":1}}', "[NULL, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]"]
    path = str(tmp_path / "p.json")
    for step in (1, 2, 3, 7, 1 << 20):
        for text in whole:
            (tmp_path / "p.json").write_text(text)
            doc = json.loads(text)
            doc = doc.get("products") if isinstance(doc, dict) else doc
            found = list(arrays.entries(path, "products", step))
            last = max((n for n, _ in found), default=-1)
            assert [x for n, x in found if n == last][1:] == (doc if isinstance(doc, list) else []), (text, step)
        for text in broken:
            (tmp_path / "p.json").write_text(text)
            with pytest.raises(ValueError):
                json.loads(text)
            with pytest.raises(ValueError):
                list(arrays.entries(path, "products", step))


def test_rosters_are_files_and_folders_of_documents(spark, tmp_path):
    def slugs(uri):
        return sorted((r["slug"] or "", r["name"] or "", r["revoked"]) for r in layouts.products(spark, str(uri)).collect())

    (tmp_path / "f/g").mkdir(parents=True)
    (tmp_path / "f/a.json").write_text('{"products":[{"slug":"a","name":"A","api_key":"k"},7,{"slug":"b","revoked":true}]}')
    (tmp_path / "f/g/b.json").write_text('[{"slug":"c","name":5}]')
    (tmp_path / "f/cut.json").write_text('[{"slug":"d"},{"slug":')
    (tmp_path / "f/other.txt").write_text('[{"slug":"e"}]')
    (tmp_path / "f/y.json").write_text('products:\n  - {slug: y, name: Y}\n')
    assert slugs(tmp_path / "f/a.json") == [("a", "A", False), ("b", "", True)]
    assert [x for x in slugs(tmp_path / "f") if x[0] != "y"] == [("a", "A", False), ("b", "", True), ("c", "5", False)]
    assert layouts.products(spark, str(tmp_path / "f")).columns == ["slug", "name", "revoked", "created_at"]
    rows = spark.range(25).selectExpr("""'{"slug":"' || id || '"}' as product""")
    written = shards.write_roster(rows.repartition(2), str(tmp_path / "w"), per_file=4).collect()
    assert len(written) >= 7 and all(len(json.load(open(r["path"]))["products"]) <= 4 for r in written)
    assert sorted(int(s) for s, _, _ in slugs(tmp_path / "w")) == list(range(25))


def test_the_roster_does_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id as c_custkey", "'n' || id as c_name").write.parquet(str(tmp_path / "customer.parquet"))
    make = type(spark).createDataFrame

    def refused(*_, **__):
        raise AssertionError("rows come to the driver")

    def few(self, data, *a, **k):
        assert not isinstance(data, list) or len(data) <= 1
        return make(self, data, *a, **k)

    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "collect", "toPandas"):
            m.setattr(type(spark.range(0)), name, refused)
        m.setattr(type(spark), "createDataFrame", few)
        found = plans.QUERIES["products"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"p{k}", f"n{k}") for k in range(100) if k % 4)


def test_a_customer_without_a_key_is_no_active_product(spark, tmp_path):
    spark.createDataFrame([(None, "a"), (1, None), (-3, 'q"\\\n\u2028é'), (4, "d")], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    rows = duckdb.sql(plans.SQL["products"].replace("from customer", f"from '{tmp_path}/customer.parquet/*.parquet'")).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in plans.QUERIES["products"](spark, str(tmp_path)).collect())


def test_a_bad_object_does_not_stop_the_sweep(spark, tmp_path):
    event = {"journey_id": "j", "seq": 0, "kind": "message", "ts": "t", "event_id": "e0", "message": {"role": "user", "content": "hi"}}
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.jsonl").write_text('{"schema_version":"2.0"}\n' + json.dumps(event) + "\n")
    (tmp_path / "b.jsonl").write_bytes(b'{"schema_version":"2.0"}\n\xff\xfe\n')
    (tmp_path / "c.txt").write_text("x")
    rows = layouts.objects(spark, str(tmp_path))
    assert {r["path"][-7:]: r["refused"] for r in rows.where("line_no = 1").collect()} == {"a.jsonl": None, "b.jsonl": "not UTF-8"}
    flat = wire.flat(wire.events(rows)).collect()
    assert [(r["journey_id"], r["content"]) for r in flat] == [("j", "hi")]


def test_drain_moves_on_success_only(spark, tmp_path):
    e = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0)], "journey_id string, seq long")
    state, fail = str(tmp_path / "acks"), {"b"}

    def sink(rows):
        return rows.select("journey_id").distinct().withColumn("error", F.when(F.col("journey_id").isin(*fail or [""]), "down"))

    first = {r["journey_id"]: (r["sent"], r["gaps"], r["error"]) for r in ingest.drain_batch(e, state, sink).collect()}
    assert first == {"a": (2, 1, None), "b": (0, 0, "down")}
    fail.clear()
    assert {r["journey_id"]: r["sent"] for r in ingest.drain_batch(e, state, sink).collect()} == {"b": 1}
    assert ingest.drain_batch(e, state, sink).count() == 0
    with pytest.raises(ValueError):
        ingest.drain(None, "", sink, "", every=0)


def test_file_sink_writes_the_header_once(spark, tmp_path):
    e = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "journey_id string, seq long, kind string")
    send = ingest.file_sink(str(tmp_path), lambda rows: rows.select("journey_id").distinct().withColumn("line", F.lit("{}")))
    for part in (e.where("seq = 0"), e.where("seq = 1")):
        assert send(part).first()["error"] is None
    assert (tmp_path / "a.jsonl").read_text() == '{}\n{"journey_id":"a","kind":"x","seq":0}\n{"journey_id":"a","kind":"y","seq":1}\n'


def test_upkeep_outlives_failures():
    stop, seen = threading.Event(), []

    def step():
        seen.append("s")
        if len(seen) > 5:
            stop.set()
        if len(seen) == 2:
            raise ValueError

    assert ingest.upkeep(step, lambda: seen.append("r"), stop, 0, 3, lambda e: seen.append("f")) == 4
    assert seen == ["s", "s", "f", "s", "r", "s"]


def test_observed_calls_are_recorded():
    told = []

    @host.observe(told.append, "add")
    def plus(a, b=1):
        return a / b

    assert plus(4, b=2) == 2
    with pytest.raises(ZeroDivisionError):
        plus(1, b=0)
    assert [(t["name"], t["response"], t["error"]) for t in told] == [("add", 2.0, None), ("add", None, "ZeroDivisionError: division by zero")]
    assert told[0]["arguments"] == {"args": [4], "b": 2} and told[0]["duration_ms"] >= 0
    snap = host.snapshot()
    assert snap["hostname"] and snap["disk_total_bytes"] > 0 and set(snap) == {f.split()[0] for f in host.SNAPSHOT.split(", ")}
    assert host.project({"LOOMLINE_PROJECT": " p "}) == "p" and host.project({}, "/") == ""


def test_lenient_parsers_report_what_they_cannot_read(spark):
    entries = [{"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "chart"}]}, 5, {"role": "narrator", "content": "x"}]
    found, unknown = parsers.lenient(json.dumps(entries), "anthropic")
    assert [(m["role"], m.get("content"), m.get("reasoning")) for m in found[:1]] == [("assistant", "a", "hm")]
    assert found[1]["role"] == "user" and unknown[:2] == ["chart", "entry:int"] and len(unknown) == 3
    d = spark.createDataFrame([(1, "{"), (2, "[]"), (3, json.dumps(entries[:1]))], "id int, payload string")
    got = {r["id"]: (r["content"], r["unknown"]) for r in parsers.parse_lenient(d, "anthropic").collect()}
    assert got == {1: (None, "not JSON"), 2: (None, None), 3: ("a", "chart")}


def doc(*turns_, **task):
    steps, said = [], []
    for added in turns_:
        said = said + [{"role": r, "content": c} for r, c in added]
        steps.append({"messages": said, "trainable_status": "trainable"})
    return {"task": {"conversation_id": "c"} | task, "steps": steps}


def test_dead_turns_leave_later_histories():
    d, gone = docs_of.without_dead_turns(doc([("user", "a"), ("assistant", "b")], [("assistant", "")], [("user", "c")]))
    assert gone == 1 and [len(s["messages"]) for s in d["steps"]] == [2, 3] and d["steps"][1]["messages"][2]["content"] == "c"


def test_raw_exports_become_journeys():
    raw = json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": "v"}], "conversation_id": 7, "task_metadata": {"num_turns": 3, "other": 1}})
    d = docs_of.normalised(raw, "stem", "openai", "src")
    assert (d["task"]["id"], d["task"]["num_turns"], d["task"]["num_steps"]) == ("src:7", 3, 2)
    assert [(len(s["messages"]), s["trainable_status"]) for s in d["steps"]] == [(3, "trainable"), (4, "not_trainable")]
    assert [m["trainable_status"] for m in d["steps"][1]["messages"]] == ["not_trainable", "not_trainable", "trainable", "not_trainable"]
    for bad in ("{", "3", '{"messages": 1}', '[{"role": "x"}]'):
        with pytest.raises((ValueError, TypeError)):
            docs_of.normalised(bad, "s", "openai", "src")


def test_the_gate_ends_a_recipe(spark):
    docs = spark.createDataFrame([("a", json.dumps(doc([("user", "x")]))), ("b", json.dumps(doc([("narrator", "x")], api_key="k"))), ("c", "{")], "path string, document string")
    made = documents.recipe({"name": "r", "stages": [{"stage": "validation"}, {"stage": "splitting"}]})
    out = documents.run(made, docs)
    assert not out.ok and out.failed_stage == "validation"
    assert sorted(tuple(r) for r in out.errors.collect()) == [("b", "steps[0].messages[0].role: invalid or missing"), ("b", "unredacted key 'api_key' (value: 'k')"), ("c", "not JSON")]
    passed = documents.run(made, docs.where("path = 'a'"))
    assert passed.ok and "split" in passed.data.columns
    for bad in ([{"stage": "splitting"}, {"stage": "cleaning"}], [{"stage": "nothing"}]):
        with pytest.raises(ValueError):
            documents.run(documents.recipe({"name": "r", "stages": bad}), docs)
    for bad in ({}, {"name": "r"}, {"name": "r", "stages": [1]}, {"name": "r", "stages": [{"stage": "a", "params": 1}]}):
        with pytest.raises(ValueError):
            documents.recipe(bad)


def test_leaks_and_drift_are_errors(spark):
    docs = spark.createDataFrame([("a", json.dumps(doc([("user", "x")], [("user", "y")])))], "path string, document string")
    splits = spark.createDataFrame([("i", "train"), ("i", "val"), ("k", "val")], "id string, split string")
    base = spark.createDataFrame([("mean_steps", 5.0), ("mean_messages", 2.0), ("journeys", 0.0)], "name string, value double")
    assert sorted(r["error"] for r in documents.validate(docs, None, splits, base).collect()) == ["i appears in train,val", "mean_steps: drifted"]


def test_the_order_of_stages_is_part_of_a_recipe():
    one = {"name": "r", "stages": [{"stage": "cleaning"}, {"stage": "validation", "params": {"a": 1}}]}
    two = {"name": "r", "stages": one["stages"][::-1]}
    assert documents.recipe(one).digest() != documents.recipe(two).digest() == documents.recipe(two | {"version": 1}).digest()


def test_watermarks_don_t_depend_on_order(spark):
    pairs = [("b", "2"), ("a", "1"), ("é", "3")]
    want = hashlib.sha256('[["a","1"],["b","2"],["é","3"]]'.encode()).hexdigest()
    for p in (pairs, pairs[::-1]):
        assert documents.watermark(spark.createDataFrame(p, "id string, content_hash string").repartition(3)) == want
    with pytest.raises(ValueError):
        documents.watermark(spark.createDataFrame([("", "1")], "id string, content_hash string"))


def test_negatives_and_variants():
    d = doc([("user", "q"), ("assistant", "good")])
    made = docs_of.negative(d, lambda context: " bad ", "m")
    assert [(s["messages"][-1]["content"], s["trainable_status"]) for s in made["steps"]] == [("bad", "superseded"), ("good", "trainable")]
    assert docs_of.negative(doc([("user", "q")]), lambda c: "x", "m") is None and docs_of.negative(d, lambda c: None, "m") is None and docs_of.negative(d, lambda c: 1 / 0, "m") is None
    other = docs_of.rewritten(d, str.upper, 2)
    assert other["steps"][0]["messages"][0]["content"] == "Q" and other["steps"][0]["messages"][1]["content"] == "good"
    assert docs_of.rewritten(d, lambda t: " ", 0) is None


def test_speech_before_a_tool_call_joins_it(spark):
    call = ("c", "look", "{}", "found", False)
    rows = [
        (1, 0, "item", "user", "hi", False, None, None),
        (1, 1, "item", "assistant", "let me", False, 0.5, None),
        (1, 2, "item", "assistant", "look", False, 1.0, None),
        (1, 3, "tool", None, None, None, None, [call, ("d", "look", "{}", None, False)]),
        (1, 4, "item", "assistant", "Cut o", True, None, None),
        (1, 5, "item", "assistant", "Done.", False, None, None),
        (1, 6, "item", "function", "no role", False, None, None),
        (1, 7, "prompt", None, None, None, None, None),
        (1, 8, "item", "assistant", "Anew.", False, None, None),
    ]
    d = spark.createDataFrame(rows, "journey_id int, at int, kind string, role string, text string, interrupted boolean, confidence double, calls array<struct<id:string,name:string,arguments:string,output:string,failed:boolean>>")
    got = [(r["at"], r["part"], r["role"], r["content"], r["calls"], r["response"], r["interrupted"]) for r in turns.tool_turns(d).orderBy("at", "part").collect()]
    assert got == [(0, 0, "user", "hi", 0, None, False), (3, 0, "assistant", "let me look", 2, None, False), (3, 1, "tool", None, 0, "found", False), (3, 2, "tool", None, 0, None, False), (4, 0, "assistant", "Cut o", 0, None, True), (5, 0, "assistant", "Done.", 0, None, False), (8, 0, "assistant", "Anew.", 0, None, False)]
    said = {r["at"]: r["confidence"] for r in turns.utterances(d).collect()}
    assert said[1] == pytest.approx((0.5 * 6 + 1.0 * 4) / 10) and said[0] is None


def test_tail_waits_for_the_end_of_a_line(spark, tmp_path):
    (tmp_path / "m.ndjson").write_text('{"a":1}\n\nbroken\n{"a":2')
    none = spark.createDataFrame([], "path string, offset long")
    values, after = ingest.tail(spark, str(tmp_path), none)
    assert [r["value"] for r in values.collect()] == ['{"a":1}']
    seen = spark.createDataFrame(after.collect(), "path string, offset long")
    assert seen.first()["offset"] == 16
    files.append(str(tmp_path / "m.ndjson"), b"", b"}\n")
    values, after = ingest.tail(spark, str(tmp_path), seen)
    assert [r["value"] for r in values.collect()] == ['{"a":2}']


def test_verdicts_follow_late_events(spark, tmp_path):
    kind = "journey_id string, seq long, kind string, event_id string, role string, content string, signal string, target_seq long, writer string, arrival int"
    row = lambda j, s, k: (j, s, k, f"{j}-{s}", "user", "x", None, None, "w", 0)
    seen = []
    for n, rows in enumerate(([row("a", 0, "message"), row("b", 0, "message"), row("b", 1, "terminal")], [row("a", 2, "terminal")], [row("a", 1, "message"), row("a", 0, "message")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        ingest.live_verdicts(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
        seen.append({tuple(r) for r in keyed.current(spark, str(tmp_path / "state/verdicts"), "journey_id string, complete boolean, reason string").collect()})
    assert seen == [{("a", False, "no_terminal"), ("b", True, None)}, {("a", False, "missing_events"), ("b", True, None)}, {("a", True, None), ("b", True, None)}]


def test_documents_of_journeys_can_be_curated(spark):
    kind = "journey_id string, seq long, kind string, event_id string, role string, content string, signal string, target_seq long, writer string, arrival int"
    e = spark.createDataFrame([("a", i, k, f"e{i}", r, f"m{i}", None, None, "w", 0) for i, (k, r) in enumerate([("message", "user"), ("message", "assistant"), ("message", "user"), ("terminal", None)])], kind)
    (one,) = fold.journey_documents(e, source="s").collect()
    d = json.loads(one["document"])
    assert [(len(s["messages"]), s["trainable_status"]) for s in d["steps"]] == [(2, "trainable"), (3, "not_trainable")]
    assert d["task"] == {"conversation_id": "a", "data_source": "s", "id": "s:a", "num_steps": 2, "num_turns": 2} and d["_diagnostics"]["complete"] and "error" not in d
    bare = {"task": {k: v for k, v in d["task"].items() if k != "num_turns"}, "steps": [{"messages": s["messages"]} for s in d["steps"]], "metrics": {k: v for k, v in d["metrics"].items() if k != "num_tool_response_none"}, "execution_metrics": d["execution_metrics"]}
    assert d["telemetry"]["data"]["content_hash"] == canonical.content_hash(bare)
    assert docs_of.schema_errors(d) == [] and docs_of.identity(d) == "a"
    (last,) = fold.journey_documents(e, last_step_only=True).collect()
    d = json.loads(last["document"])
    assert len(d["steps"]) == 1 and d["_diagnostics"]["steps_written"] == "last" and d["task"]["num_turns"] == 2
