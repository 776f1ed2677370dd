"""Sweeps of a store: listing by level, and a row of its error for each object that can't be read."""

import pytest

from loomline.sources import layouts, wire

HEAD = '{"schema_version":"2.0"}\n'


def tree(at):
    (at / "a" / "b").mkdir(parents=True)
    (at / "none").mkdir()
    (at / "top.jsonl").write_text(HEAD + "one\n\ntwo")
    (at / "a" / "x.jsonl").write_text(HEAD)
    (at / "a" / "b" / "deep.jsonl").write_text(HEAD + "é" * 3000 + "\nlast\n")
    (at / "a" / "b" / "other.txt").write_text("x")
    (at / "a" / "empty.jsonl").write_text("")
    (at / "a" / "latin.jsonl").write_bytes(HEAD.encode() + b"ok\n" * 500 + b"\xff\n")
    (at / "old.jsonl").write_text('{"schema_version":"1.0"}\nx\n')
    return {str(p): p.stat().st_size for p in at.rglob("*.jsonl")}


def test_listing_by_level(spark, tmp_path):
    want = tree(tmp_path / "s")
    assert {r["path"]: r["size"] for r in layouts.listing(spark, str(tmp_path / "s")).collect()} == want
    assert layouts.listing(spark, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(ValueError):
        layouts.listing(spark, str(tmp_path / "s"), levels=2)


def test_a_sweep_goes_on_past_what_it_cannot_read(spark, tmp_path):
    tree(tmp_path / "s")
    good, bad = layouts.sweep(spark, str(tmp_path / "s"))
    name = lambda p: p.rpartition("/")[2]
    assert {name(r["path"]): r["error"] for r in bad.collect()} == {"empty.jsonl": "empty file", "latin.jsonl": "not UTF-8", "old.jsonl": "unknown major version"}
    got = sorted((name(r["path"]), r["line_no"], r["line"], r["last_open"]) for r in good.collect())
    assert [(n, i, o) for n, i, _, o in got] == [("deep.jsonl", 1, False), ("deep.jsonl", 2, False), ("deep.jsonl", 3, False), ("top.jsonl", 1, False), ("top.jsonl", 2, False), ("top.jsonl", 4, True), ("x.jsonl", 1, False)]
    assert got[1][2] == "é" * 3000


@pytest.mark.parametrize("step", [7, 1000, 1 << 20])
def test_an_object_that_has_gone_is_one_row(spark, tmp_path, step):
    tree(tmp_path / "s")
    found = layouts.listing(spark, str(tmp_path / "s")).cache()
    assert found.count() == 6
    (tmp_path / "s" / "a" / "b" / "deep.jsonl").unlink()
    rows = wire.swept(found, range_bytes=step).where("path like '%deep%'").collect()
    assert [(r["line_no"], r["line"], r["last_open"], r["refused"].partition(":")[0]) for r in rows] == [(1, None, False, "FileNotFoundError")]
    whole = {tuple(r) for r in wire.ranged_lines(spark, str(tmp_path / "s"), glob="*.jsonl").selectExpr("regexp_extract(path, '[^/]+$', 0)", "line_no", "line", "last_open", "refused").collect()}
    parts = {tuple(r) for r in wire.swept(found, range_bytes=step).where("line is not null").selectExpr("regexp_extract(path, '[^/]+$', 0)", "line_no", "line", "last_open", "refused").collect()}
    assert parts == whole
