"""Keyed tables against a dictionary; what an upsert touches; merging by bucket."""

import json
import os
import random

from loomline.sinks import keyed

SCHEMA = "k string, j long, v string, w array<int>"


def rows(df):
    return {(r["k"], r["j"]): (r["v"], r["w"]) for r in df.collect()}


def folders(root):
    return {(p, b): sorted(os.listdir(f"{root}/{p}/{b}")) for p in os.listdir(root) if p.startswith("p-") for b in os.listdir(f"{root}/{p}") if b.startswith("_bucket=")}


def test_upserts_and_deletions_match_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_PARTS", 2)
    r, root, want = random.Random(4), str(tmp_path / "t"), {}
    for n in range(6):
        keys = {(r.choice(["a", "b", None, "c"]), r.choice([*range(6), None])) for _ in range(9)}
        if n % 3 == 2:
            got = keyed.delete(spark, root, spark.createDataFrame(list(keys), "k string, j long"), SCHEMA)
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            new = {k: (f"v{n}", [n]) for k in keys}
            got = keyed.upsert(spark, root, spark.createDataFrame([(*k, *v) for k, v in new.items()], SCHEMA), ["k", "j"], buckets=4)
            want |= new
        assert rows(got) == want
    assert rows(keyed.current(spark, root, SCHEMA)) == want
    held = [b for p in json.load(open(f"{root}/_current"))["parts"] for b in p["buckets"]]
    assert max(map(held.count, held)) <= 2


def test_an_upsert_writes_the_buckets_of_its_rows_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_PARTS", 2)
    root = str(tmp_path / "t")
    keyed.upsert(spark, root, spark.createDataFrame([(str(i), i, "old", []) for i in range(200)], SCHEMA), ["k", "j"], buckets=8)
    before = folders(root)
    assert len(before) == 8
    for n in range(2):  # the second brings the bucket into three parts, and merges it
        keyed.upsert(spark, root, spark.createDataFrame([("7", 7, f"new{n}", [n])], SCHEMA), ["k", "j"])
    after = folders(root)
    assert {k: after[k] for k in before} == before
    new = {b for p, b in set(after) - set(before)}
    assert len(new) == 1
    (bucket,) = (int(b.partition("=")[2]) for b in new)
    parts = json.load(open(f"{root}/_current"))["parts"]
    assert [p["buckets"] for p in parts] == [[b for b in range(8) if b != bucket], [bucket]]
    got = rows(keyed.current(spark, root, SCHEMA))
    assert len(got) == 200 and got["7", 7] == ("new1", [1]) and got["8", 8] == ("old", [])


def test_buckets_of_one_part_are_read_without_a_shuffle(spark, tmp_path):
    root = str(tmp_path / "t")
    table = keyed.upsert(spark, root, spark.createDataFrame([(str(i), i, "old", []) for i in range(50)], SCHEMA), ["k", "j"])
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_of_new_rows_of_a_key_the_last_counts(spark, tmp_path):
    e = spark.createDataFrame([("a", 1, "x", 3), ("a", 1, "y", 9), ("a", 1, "z", 5)], "k string, j long, v string, at int")
    assert [r["v"] for r in keyed.upsert(spark, str(tmp_path / "t"), e, ["k", "j"], "at").collect()] == ["y"]
    assert keyed.current(spark, str(tmp_path / "none"), SCHEMA).count() == 0
