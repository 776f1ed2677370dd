import dataclasses
import enum
import hashlib
import itertools
import json
import random
import re
from decimal import ROUND_FLOOR, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import canonical, parsers, pii, redaction
from loomline.operators import catalog, corpus, fold, journeys, text
from loomline.plans.files import QUERIES, SQL
from loomline.sources import tables, wire
from loomline.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages benchmark labels conversations customer nation region".split()


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_the_stream_is_that_of_its_sql(spark):
    ours = tables.events(spark, SF)
    theirs = tables.whole(spark.sql(tables.events_sql("{conversations}"), conversations=tables.table(spark, SF, "conversations"))).select(*ours.columns)
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, oracle, name):
    ours, theirs = QUERIES[name](spark, SF), oracle.sql(SQL[name])
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


COLUMNS = "journey_id long, seq long, kind string, event_id string, role string, content string, signal string, target_seq long, writer string, arrival int"


def stream(spark, entries, journey=1):
    """entries: roles (S U A T) or (signal, target) or 'end'."""
    out = []
    for seq, e in enumerate(entries):
        kind = "terminal" if e == "end" else "signal" if isinstance(e, tuple) else "message"
        role = {"S": "system", "U": "user", "A": "assistant", "T": "tool"}.get(e) if kind == "message" else None
        signal, target = e if kind == "signal" else (None, None)
        out.append((journey, seq, kind, f"{journey}-{seq}", role, f"m{seq}", signal, target, "w", 0))
    return spark.createDataFrame(out, COLUMNS)


def test_golden_journey(spark):
    e = stream(spark, ["S", "U", "A", "T", "A", ("regenerated", 4), "A", ("user_edit", 6), "A", ("thumbs_up", 8), "end"])
    m = {r["seq"]: r["status"] for r in fold.messages(fold.clean(e)).collect()}
    assert (m[4], m[6], m[8]) == ("superseded", "superseded", "trainable")
    s = sorted((r["step_index"], r["message_count"], r["status"]) for r in fold.steps(fold.messages(fold.clean(e))).collect())
    assert s == [(0, 5, "superseded"), (1, 6, "superseded"), (2, 7, "trainable")]
    pairs = fold.dpo_pairs(e).collect()
    assert sorted((p["rejected"], p["chosen"]) for p in pairs) == [("m4", "m8"), ("m6", "m8")]
    assert [x["role"] for x in pairs[0]["prompt"]] == ["system", "user", "assistant", "tool"]
    assert [(r["step_index"], len(r["messages"])) for r in fold.sft_examples(e).collect()] == [(2, 7)]


FLAGS = "journey_id long, seq long, kind string, event_id string, role string, content string, signal string, target_seq long, writer string, arrival int, flag string, calls int, response string, error string, reward double, reason string, voice string, model_id string"


def told(seq, kind="message", role=None, signal=None, target=None, writer="w", arrival=0, event=None, flag=None, calls=0, response=None, error=None, reward=None, reason=None, voice=None, model=None):
    return (1, seq, kind, event or f"e{seq}", role, f"m{seq}", signal, target, writer, arrival, flag, calls, response, error, reward, reason, voice, model)


def test_flags_come_before_signals(spark):
    e = [told(0, role="user", flag="interrupted"), told(1, role="assistant", flag="summarization"), told(2, "signal", signal="thumbs_up", target=1), told(3, role="assistant", flag="interrupted"), told(4, "signal", signal="regenerated", target=3), told(5, "signal", signal="thumbs_up", target=0)]
    got = {r["seq"]: r["status"] for r in fold.messages(fold.clean(spark.createDataFrame(e, FLAGS))).collect()}
    assert got == {0: "trainable", 1: "summarization_boundary", 3: "not_trainable"}


def test_assembly_of_a_journey(spark):
    e = [told(0, role="user"), told(1, role="assistant", calls=2, model="a"), told(2, role="tool", response="r"), told(3, role="tool", error="tool_error"), told(4, role="assistant", model="b"), told(5, "reward", reward=0.1), told(6, "reward", reward=0.9), told(7, "voice", voice="stt_transcript"), told(8, "terminal", reason="ERROR", error="gone"), told(9, role="user")]
    head = spark.createDataFrame([(1, None, "t", None, 7)], "journey_id long, data_source string, trace_id string, started_at string, num_turns long")
    got = fold.assemble(spark.createDataFrame(e, FLAGS), head).first().asDict()
    want = {"data_source": "unknown", "task_id": "unknown:1", "trace_id": "t", "num_turns": 7, "num_steps": 1, "messages": 5, "trainable_steps": 1, "num_tool_calls": 2, "num_tool_failures": 1, "num_tool_response_none": 1, "tool_error_rate": 0.5, "aggregated_reward": 0.9, "termination_reason": "ERROR", "error": "gone", "model_ids": ["a", "b"], "model_id": None, "complete": True}
    assert {k: got[k] for k in want} == want
    alone = fold.assemble(spark.createDataFrame([told(0, "signal", signal="thumbs_up", target=5, model="a")], FLAGS), source="s").first()
    assert (alone["task_id"], alone["num_steps"], alone["num_turns"], alone["model_id"], alone["termination_reason"], alone["incomplete_reason"]) == ("s:1", 0, 0, "a", "NONE", "no_terminal")


def test_a_seq_far_off_is_a_wide_hole(spark):
    kept = spark.createDataFrame([told(0, role="user"), told(3, role="user"), told(5_000_000_000, role="user")], FLAGS)
    assert [tuple(r)[1:] for r in fold.gap_ranges(kept).orderBy("first_seq").collect()] == [(1, 2), (4, 4_999_999_999)]
    assert fold.gaps(kept.where("seq < 10")).count() == 2
    assert [r[1] for r in fold.gaps(spark.createDataFrame([told(7, role="user")], FLAGS), 3).orderBy("missing_seq").collect()] == list(range(7))


def test_of_messages_with_one_seq_the_last_arrival_stays(spark):
    e = [told(0, role="user", event="a"), told(0, role="assistant", event="b", arrival=1), told(1, role="user", event="c"), told(1, role="tool", event="d")]
    got = {r["seq"]: r["role"] for r in fold.messages(fold.clean(spark.createDataFrame(e, FLAGS).orderBy(F.rand(5)))).collect()}
    assert got == {0: "assistant", 1: "tool"}


@pytest.mark.parametrize(("case", "expected"), [("UATA", [4]), ("UAUA", [2, 4]), ("UAAA", [4]), ("UUA", [3]), ("UAU", [2, 3]), ("SUASUA", [3, 5])])
def test_segmentation(spark, case, expected):
    s = fold.steps(fold.messages(fold.clean(stream(spark, list(case) + ["end"])))).orderBy("step_index")
    assert [r["message_count"] for r in s.collect()] == expected


def scan(roles):
    """Message counts of the steps of turns without system messages, by a straight scan."""
    out, answered = [], False
    for n, role in enumerate(roles):
        if role == "U" and answered:
            out.append(n)
            answered = False
        answered |= role != "U"
    return [*out, len(roles)]


def test_segmentation_of_plain_turns_matches_a_scan(spark):
    rng = random.Random(3)
    cases = ["".join(c) for n in range(1, 5) for c in itertools.product("UAT", repeat=n) if c[0] == "U"]
    cases += ["U" + "".join(rng.choice("UAT") for _ in range(9)) for _ in range(60)]
    names = {"U": "user", "A": "assistant", "T": "tool"}
    everything = spark.createDataFrame([(j, s, "message", f"{j}-{s}", names[x], "m", None, None, "w", 0) for j, c in enumerate(cases) for s, x in enumerate(c)], COLUMNS)
    got = {}
    for r in fold.steps(fold.messages(fold.clean(everything))).collect():
        got.setdefault(r["journey_id"], []).append((r["step_index"], r["message_count"]))
    for j, c in enumerate(cases):
        assert [m for _, m in sorted(got[j])] == scan(c), c


def test_fold_ignores_order_and_repeats(spark):
    e = stream(spark, ["S", "U", "A", ("regenerated", 2), "A", "U", "A", "end"])
    again = e.unionByName(e.withColumn("arrival", F.lit(1))).orderBy(F.rand(3))
    assert sorted(map(tuple, fold.steps(fold.messages(fold.clean(e))).collect())) == sorted(map(tuple, fold.steps(fold.messages(fold.clean(again))).collect()))
    v = fold.verdicts(again).first()
    assert v["complete"] and v["duplicates"] == 8


def test_fold_deals_rows_out_once(spark):
    plan = fold.steps(fold.messages(fold.clean(stream(spark, ["U", "A", "end"]))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("export", [fold.sft_examples, fold.dpo_pairs, fold.trajectories])
def test_exports_deal_rows_out_once(spark, export):
    plan = export(stream(spark, ["U", "A", ("regenerated", 1), "A", "end"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_wire_reader_keeps_what_is_sound(spark, tmp_path):
    event = {"journey_id": "j", "seq": 0, "kind": "message", "ts": "t", "event_id": "e0", "message": {"role": "user", "content": "hi"}}
    bad = [json.dumps(event), "", "{broken", json.dumps(event | {"seq": -1}), json.dumps(event | {"kind": "signal"}), json.dumps({"seq": 1}), "[1]"]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"schema_version": "2.1", "journey_id": "j"}), *bad, '{"journey_id": "j", "se']))
    (tmp_path / "b.jsonl").write_text(json.dumps({"schema_version": "3.0", "journey_id": "k"}) + "\n" + json.dumps(event) + "\n")
    (tmp_path / "c.jsonl").write_text("\n")
    lines = wire.lines(spark, str(tmp_path))
    heads = {r["path"][-7:]: r["error"] for r in wire.headers(lines).collect()}
    assert heads == {"a.jsonl": None, "b.jsonl": "unknown major version", "c.jsonl": "empty file"}
    assert heads == {r["path"][-7:]: r["error"] for r in wire.scan_headers(spark, str(tmp_path)).collect()}
    got = [(r["path"][-7], r["line_no"], r["state"], r["reason"], r["event"] is None) for r in wire.events(lines).orderBy("path", "line_no").collect()]
    assert got == [
        ("a", 2, "ok", None, False),
        ("a", 4, "rejected", "not JSON", True),
        ("a", 5, "rejected", "negative seq", True),
        ("a", 6, "rejected", "payload does not match kind", True),
        ("a", 7, "rejected", "missing field", True),
        ("a", 8, "rejected", "not a JSON object", True),
        ("a", 9, "truncated", None, True),
        ("b", 2, "rejected", "file refused: unknown major version", True),
    ]


PROSE = ["write to o.neil+tax@mail.example.org, not to o@x", "+44 555-867-5309 or (555) 867 5309 or 1.555.867.5309", "no. 078-05-1120 and 1078-05-1120", "paid with 5555-5555-5555-4444, then left", "tracking 1234 5678 9012 3456 7", "4012888888881881x 4012888888881881", "", "Größe 078-05-1120é", "٤٠١٢٨٨٨٨٨٨٨٨١٨٨١ 55-867-5309"]


def plain_matches(line, rule):
    """A rule without guards: the pattern as it is, and the checksum by the book."""
    out = []
    for m in re.finditer(pii.PATTERNS[rule], line):
        digits = [int(c) for c in m[0] if c.isdecimal()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if rule != "CREDIT_CARD" or sum(doubled) % 10 == 0:
            out.append(m.span())
    return out


def plain_redact(line, rules):
    for rule in rules:
        for lo, hi in reversed(plain_matches(line, rule)):
            line = f"{line[:lo]}[REDACTED_{rule}]{line[hi:]}"
    return line


@pytest.mark.parametrize("rules", [("EMAIL", "PHONE", "CREDIT_CARD", "SSN"), ("SSN", "CREDIT_CARD", "NAME", "PHONE"), ()])
def test_personal_data_is_found_and_masked_in_the_callers_order(spark, rules):
    texts = PROSE + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    d = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, t string")
    got = {r["i"]: (r["r"], r["s"]) for r in d.select("i", pii.redacted(F.col("t"), rules).alias("r"), pii.scanned(F.col("t"), rules).alias("s")).collect()}
    assert got.pop(-1)[0] is None
    for i, line in enumerate(texts):
        masked, found = got[i]
        assert masked == plain_redact(line, [r for r in rules if r in pii.PATTERNS])
        want = {r: len(plain_matches(line, r)) for r in rules if r in pii.PATTERNS}
        assert (found["counts"] if found else {}) == {r: n for r, n in want.items() if n}
        assert len(found["samples"] if found else []) == sum(min(n, 3) for n in want.values())


def test_samples_never_hold_what_was_found():
    counts, samples = pii.scan("the number is 078-05-1120 as far as we know", ["SSN"])
    assert counts == {"SSN": 1} and samples == [("SSN", "e number is [SSN] as far as w")]
    assert pii.redact("paid with 5555 5555 5555 4444 here", ["CREDIT_CARD"]) == "paid with [REDACTED_CREDIT_CARD] here"
    assert pii.redact("+44 555-867-5309", ["PHONE"]) == "[REDACTED_PHONE]"


def test_stream_ingest_drops_what_arrived_before(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    e = stream(spark, ["U", "A", "end"])
    e.unionByName(e).write.parquet(src)
    for _ in range(2):
        ingest.ingest(spark.readStream.schema(e.schema).parquet(src), out, state).awaitTermination()
        e.write.mode("append").parquet(src)
    assert spark.read.parquet(out).count() == 3


def test_acknowledgements_never_go_back(spark):
    acks = spark.createDataFrame([(1, 5)], "journey_id long, ack long")
    sent = spark.createDataFrame([(1, 3), (2, 4)], "journey_id long, seq long")
    assert {tuple(r) for r in ingest.advanced(acks, sent).collect()} == {(1, 5), (2, 4)}


@pytest.mark.parametrize(
    ("provider", "entry", "expected"),
    [
        ("openai", {"role": "function", "name": "f", "content": "x"}, [("tool", "x", None, "x", None)]),
        ("openai", {"role": "assistant", "content": None, "function_call": {"name": "f", "arguments": '{"b": 1, "a": 2}'}}, [("assistant", None, '{"a": 2, "b": 1}', None, None)]),
        ("anthropic", {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "1", "content": {"t": 72}, "is_error": True}]}, [("tool", '{"t": 72}', None, '{"t": 72}', "tool_error")]),
        ("anthropic", {"role": "user", "content": []}, [("user", None, None, None, None)]),
        ("vercel", {"role": "assistant", "parts": [{"type": "tool-invocation", "toolInvocation": {"toolName": "f", "args": '{"a": 1}'}}]}, [("assistant", None, '{"a": 1}', None, None)]),
        ("gemini", {"role": "model", "parts": [{"text": "a"}, {"text": "b"}]}, [("assistant", "a\nb", None, None, None)]),
    ],
)
def test_provider_formats(provider, entry, expected):
    got = [(m["role"], m.get("content"), (m.get("tool_calls") or [{}])[0].get("arguments"), (m.get("tool_response") or {}).get("response"), (m.get("tool_response") or {}).get("error")) for m in parsers.parse(json.dumps([entry]), provider)]
    assert got == expected


@pytest.mark.parametrize(
    ("provider", "entry"),
    [("openai", {"role": "tool", "content": "x"}), ("openai", {"role": "narrator", "content": "x"}), ("openai", {"role": "user", "content": [{"type": "chart"}]}), ("anthropic", {"role": "user", "content": None}), ("anthropic", {"role": "user", "content": [{"type": "tool_use"}]}), ("vercel", {"role": "user", "content": "a", "parts": []}), ("vercel", {"role": "tool", "parts": [{"type": "tool-result"}]}), ("gemini", {"role": "user", "parts": [{}]})],
)
def test_malformed_entries_are_errors(spark, provider, entry):
    good = json.dumps([{"role": "user", "content": "hi", "parts": [{"text": "hi"}]} if provider == "gemini" else {"role": "user", "content": "hi"}])
    d = spark.createDataFrame([(1, json.dumps([entry])), (2, good), (3, "{"), (4, None)], "id long, payload string")
    got = {r["id"]: (r["content"], r["error"] is None) for r in parsers.parse_messages(d, provider).collect()}
    assert got == {1: (None, False), 2: ("hi", True), 3: (None, False), 4: (None, False)}


def test_secrets_are_masked_by_key():
    found = {"Auth": "x", "my-token": {"a": 1}, "tokens": "x", "pin": "", "list": [{"otp": 0}], "password": None}
    masked = redaction.mask(found)
    assert masked == {"Auth": "[REDACTED]", "my-token": "[REDACTED]", "tokens": "x", "pin": "", "list": [{"otp": "[REDACTED]"}], "password": None}
    assert len(redaction.unmasked(found)) == 3 and not redaction.unmasked(masked)
    event = {"metadata": {"pin": 1}, "message": {"content": "pin", "tool_calls": [{"arguments": {"otp": 2}}], "tool_response": {"response": "plain", "metadata": {"auth": "x"}}}}
    mark = "[REDACTED]"
    assert redaction.mask_event(event) == {"metadata": {"pin": mark}, "message": {"content": "pin", "tool_calls": [{"arguments": {"otp": mark}}], "tool_response": {"response": "plain", "metadata": {"auth": mark}}}}
    assert redaction.mask_header({"journey_metadata": {"token": "t", "a": 1}, "token": "kept"}) == {"journey_metadata": {"token": mark, "a": 1}, "token": "kept"}


def test_run_roots(spark):
    chain = [(i, i - 1 if i else None) for i in range(40)] + [(100, 99), (101, 100)]
    got = dict(journeys.run_roots(spark.createDataFrame(chain, "run_id long, parent_id long")).collect())
    assert got == {i: 0 for i in range(40)} | {100: 100, 101: 100}
    with pytest.raises(ValueError):
        journeys.run_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "run_id long, parent_id long"), 4).count()


def test_dead_turns_go_and_later_steps_move_up(spark):
    m = spark.createDataFrame([(1, 0, "a", 0, None), (1, 1, "", 0, None), (1, 1, None, 0, ""), (1, 2, "", 1, None), (1, 2, "", 0, None)], "journey_id long, step_index long, content string, calls int, response string")
    kept, gone = journeys.drop_dead_turns(m)
    assert sorted(r["step_index"] for r in kept.collect()) == [0, 1, 1]
    assert [tuple(r) for r in gone.collect()] == [(1, 1)]


def test_schema_errors(spark):
    kind = "steps array<struct<trainable_status:string,messages:array<struct<role:string>>>>"
    d = spark.createDataFrame([([("maybe", [("user",), (None,)]), (None, None)],), (None,), ([(None, [("tool",)])],)], kind)
    got = [r[0] for r in d.select(journeys.schema_errors(F.col("steps"))).collect()]
    assert got == [["steps[0].trainable_status: invalid value 'maybe'", "steps[0].messages[1].role: invalid or missing", "steps[1].messages: missing or not a list"], ["steps: missing or not a list"], []]


def test_format_bytes(spark):
    d = spark.createDataFrame([(999.0,), (1250.0,), (1450.0,), (-2e6,), (None,), (9.2e18,)], "n double")
    assert [r[0] for r in d.select(catalog.format_bytes(F.col("n"))).collect()] == ["999 B", "1.3 KB", "1.4 KB", "-2.0 MB", "\u2014", "9.2 EB"]
    exact = lambda n: str((Decimal(n / 1000) * 10 + Decimal("0.5")).to_integral_value(ROUND_FLOOR) / 10)
    sizes = list(range(1000, 40_000, 10))
    got = [r[0] for r in spark.createDataFrame([(float(n),) for n in sizes], "n double").select(catalog.format_bytes(F.col("n"))).collect()]
    assert got == [f"{float(exact(n)):.1f} KB" for n in sizes]


def test_cursors(spark):
    assert catalog.decode_cursor("MjU=") == 25 and catalog.decode_cursor("?") == 0
    rows, order = spark.range(60), [F.col("id")]
    first = catalog.paginate(rows, order, limit=0).collect()
    assert len(first) == 25 and first[0]["has_more"] and first[0]["total"] == 60 and catalog.decode_cursor(first[0]["next_cursor"]) == 25
    last = catalog.paginate(rows, order, catalog.encode_cursor(50)).collect()
    assert len(last) == 10 and last[0]["next_cursor"] is None and not last[0]["has_more"]
    assert [r["id"] for p in catalog.pages(rows, order) for r in p.collect()] == list(range(60))
    assert not list(catalog.pages(rows.limit(0), order))


def test_watermark_tree(spark):
    def mark(pairs):
        return tuple(corpus.watermark_table(spark.createDataFrame(pairs, "id string, content_hash string").repartition(3)).first())

    pairs = [(str(i), str(i % 7)) for i in range(5000)]
    assert mark(pairs) == mark(pairs[::-1]) and mark(pairs)[1] == 5000
    assert len({mark(pairs), mark(pairs[1:]), mark([("0", "x"), *pairs[1:]]), mark(pairs[:1]), mark([])}) == 5


def test_the_later_completion_counts(spark):
    tasks = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, reference string")
    done = spark.createDataFrame([("a", "1 ", 1), ("a", "no", 2), ("b", "x", 1), ("b", "\u00a02", 3)], "id string, response string, line_no int")
    run = corpus.eval_run(tasks, done, "exact_match")
    assert sorted(tuple(r) for r in run.collect()) == [("a", 0.0, False), ("b", 1.0, False), ("c", 0.0, True)]
    assert tuple(corpus.eval_summary(run).first()) == (1 / 3, 3, 1)
    rates = spark.createDataFrame([('{"tool_error_rate": 0.25}',), ("{}",), ("x",), ('{"tool_error_rate": "many"}',)], "r string")
    assert [r[0] for r in rates.select(corpus.METRICS["tool_call_accuracy"](F.col("r"), F.lit(None))).collect()] == [0.75, 1.0, 1.0, 1.0]
    assert tuple(corpus.eval_summary(run.limit(0)).first()) == (0.0, 0, 0)


def test_a_repeated_decision_does_not_repeat_the_journey(spark):
    j = spark.createDataFrame([("a",)], "journey_id string")
    d = spark.createDataFrame([("a", True, 1.0, 1), ("a", None, 0.5, 2), ("z", True, 1.0, 3)], "journey_id string, approved boolean, score double, line_no int")
    assert [(r["approved"], r["scaled"]) for r in corpus.apply_reviews(j, d, 0.0, 2.0).collect()] == [(False, 0.25)]
    assert [r[0] for r in corpus.unmatched(d, j).collect()] == ["z"]


def test_a_group_on_a_bound_falls_above_it(spark):
    h = lambda k: int(hashlib.sha256(json.dumps({"group_key": k}, separators=(",", ":")).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    got = spark.createDataFrame([("k",)], "k string").select(corpus.assign_split(F.col("k"), {"a": h("k"), "b": 1 - h("k")}).alias("s")).first()["s"]
    assert got == "b"


def test_names_of_files(spark):
    names = [" a/b ", "../../x", "..", None, "\t.hidden", "a\\b", "x" * 300]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in d.select(text.safe_stem(F.col("n"))).collect()] == ["a_b", "x", "journey", "journey", "hidden", "a_b", "x" * 240]


def test_null_and_empty_contents_differ(spark):
    d = spark.createDataFrame([(1, ""), (2, None), (3, ""), (4, None)], "i int, t string")
    assert sorted((r["i"], r["copies"]) for r in text.dedupe_exact(d, F.col("t"), "i").collect()) == [(1, 2), (2, 2)]


def test_canonical_hash(spark):
    a, b = '{"b": [1, null, {"idx": 1, "x": null}], "a": "é", "idx": 4}', '{"a":"é","b":[1,null,{}],"c":null}'
    d = spark.createDataFrame([(a,), (b,), ("{",), (None,)], "v string")
    got = [r[0] for r in d.select(canonical.hash_json(F.col("v"))).collect()]
    assert got == [hashlib.sha256('{"a":"é","b":[1,null,{}]}'.encode()).hexdigest()] * 2 + [None, None]


def test_values_of_any_type_as_json():
    class Colour(enum.Enum):
        RED = "r"

    @dataclasses.dataclass
    class Point:
        x: int
        tags: set

    deep = value = {}
    for _ in range(20):
        value["in"] = value = {}
    out = canonical.jsonable({"c": Colour.RED, "p": Point(1, {"b", "a"}), 3: (1, None), "o": object, "deep": deep})
    assert out["c"] == "r" and out["p"] == {"x": 1, "tags": ["a", "b"]} and out["3"] == [1, None] and isinstance(out["o"], str)
    assert len(json.dumps(out)) < 2000


def test_one_malformed_row_does_not_end_the_job(spark):
    d = spark.createDataFrame([('{"pin":1}',), ("{",), (None,)], "v string")
    got = [tuple(r) for r in d.select(redaction.redact_json(F.col("v")), redaction.is_json(F.col("v")), redaction.unmasked_json(F.col("v"))).collect()]
    assert got == [('{"pin":"[REDACTED]"}', True, ["unredacted key 'pin' (value: 1)"]), (None, False, ["not JSON"]), (None, None, [])]
