"""The index of files against a full rebuild, after changes of any kind."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from loomline.sinks import keyed
from loomline.streaming import index

LISTING = "path string, mtime long, size long"


def measured(spark, files, read):
    def measure(changed):
        paths = [r["path"] for r in changed.collect()]
        read.append(sorted(paths))
        return spark.createDataFrame([(p, k, n) for p in paths for k, n in files[p][1]], "path string, key string, n long")

    return measure


def listed(spark, files):
    return spark.createDataFrame([(p, m, len(rows)) for p, (m, rows) in files.items()], LISTING)


def test_counts_equal_a_rebuild_after_any_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_PARTS", 2)
    r, root, files = random.Random(8), str(tmp_path / "i"), {}
    some = lambda: [(r.choice(["a", "b", "c", None]), r.randint(0, 3)) for _ in range(r.randint(0, 6))]
    for n in range(5):
        before = dict(files)
        for _ in range(4):
            files[f"f{r.randint(0, 7)}"] = (n, some())
        for p in r.sample(sorted(files), min(2, len(files) - 1)):
            del files[p]
        if n == 3:
            files = {}
        read = []
        want_read = sorted(p for p in files if files[p] != before.get(p))
        got = index.refresh(spark, root, listed(spark, files), measured(spark, files, read))
        assert got == (len(want_read), len(set(before) - set(files))) and [x for x in read if x] == ([want_read] if want_read else [])
        want = collections.Counter()
        for _, rows in files.values():
            for k, c in rows:
                if k is not None:
                    want[k] += c
        assert {x["key"]: x["n"] for x in index.totals(spark, root).collect()} == {k: c for k, c in want.items() if c}
        assert {x["path"] for x in index.known(spark, root).collect()} == set(files)
    assert index.refresh(spark, root, listed(spark, files), measured(spark, files, read)) == (0, 0)
    assert [p.name for p in (tmp_path / "i").glob("_step*")] == []


def test_a_step_that_fails_leaves_the_index_as_it_was(spark, tmp_path):
    root, files = str(tmp_path / "i"), {"x": (1, [("a", 2)]), "y": (1, [("a", 1), ("b", 5)])}
    index.refresh(spark, root, listed(spark, files), measured(spark, files, []))
    files = {"x": (2, [("b", 1)])}

    def broken(changed):
        return measured(spark, files, [])(changed).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        index.refresh(spark, root, listed(spark, files), broken)
    assert {x["key"]: x["n"] for x in index.totals(spark, root).collect()} == {"a": 3, "b": 5}
    assert index.refresh(spark, root, listed(spark, files), measured(spark, files, [])) == (1, 1)
    assert {x["key"]: x["n"] for x in index.totals(spark, root).collect()} == {"b": 1}
    assert [tuple(x) for x in index.by_file(spark, root).collect()] == [("x", "b", 1)]
