"""Tailing as a stream: restarts, lines that are still being written, files that shrink, ranges."""

import random

import pytest

from loomline.sources import tail


def ran(spark, folder, out, step=1 << 20):
    rows = tail.stream(spark, str(folder), range_bytes=step)
    q = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(r["value"] for r in spark.read.schema("path string, value string").parquet(f"{out}/rows").collect())


@pytest.mark.parametrize("step", [1, 3, 10, 1000])
def test_each_line_ends_in_one_range(tmp_path, step, monkeypatch):
    monkeypatch.setattr(tail, "_BACK", 4)
    r = random.Random(step)
    lines = [bytes(r.choice(b"ab\r ") for _ in range(r.choice([0, 1, 5, 30]))) for _ in range(60)]
    data = b"\n".join(lines) + b"\nopen"
    (tmp_path / "f").write_bytes(data)
    got = [x for at in range(0, len(data), step) for x in tail.ended_lines(str(tmp_path / "f"), at, min(at + step, len(data)))]
    assert got == lines


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_a_restart_loses_and_repeats_nothing(spark, tmp_path, step):
    folder, out = tmp_path / "in", tmp_path / "out"
    (folder / "deep").mkdir(parents=True)
    a, b = folder / "a.ndjson", folder / "deep" / "b.ndjson"
    a.write_text('{"n":1}\n{broken\n\n[2]\n{"n":2}\n{"n"')
    (folder / "a.txt").write_text('{"n":99}\n')
    assert ran(spark, folder, out, step) == ['{"n":1}', '{"n":2}']
    assert ran(spark, folder, out, step) == ['{"n":1}', '{"n":2}']
    with a.open("a") as f:
        f.write(':3}\n{"n":4}\n')
    b.write_text('{"n":5}')
    assert ran(spark, folder, out, step) == [f'{{"n":{n}}}' for n in (1, 2, 3, 4)]
    with b.open("a") as f:
        f.write("\n")
    assert ran(spark, folder, out, step) == [f'{{"n":{n}}}' for n in (1, 2, 3, 4, 5)]
    a.write_text('{"n":6}\n')  # shrunk: read anew
    b.unlink()
    assert ran(spark, folder, out, step) == [f'{{"n":{n}}}' for n in (1, 2, 3, 4, 5, 6)]


def test_an_empty_folder_is_a_stream_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ran(spark, tmp_path / "in", tmp_path / "out") == []
