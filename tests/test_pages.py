"""Pages off an index of their order: those of a sort, and what a page reads."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import catalog

SCHEMA = "k long, name string"


@pytest.mark.parametrize("n", [0, 1, 40, 403])
def test_pages_are_those_of_a_sort(spark, tmp_path, n):
    r, root = random.Random(n), str(tmp_path / "i")
    rows = [(r.choice([None, *range(6)]), f"{i:04}") for i in range(n)]
    order = [F.desc_nulls_last("k"), F.col("name")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    catalog.index_order(df, order, root, parts=5)
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    got, cursor = [], None
    while True:
        page = catalog.indexed_page(spark, root, SCHEMA, cursor, 100).collect()
        got += [(p["k"], p["name"]) for p in page]
        assert all(p["total"] == n for p in page)
        if not page or not page[0]["has_more"]:
            break
        cursor = page[0]["next_cursor"]
    assert got == want
    assert catalog.indexed_page(spark, root, SCHEMA, catalog.encode_cursor(n), 10).collect() == []
    if n == 403:
        at = catalog.encode_cursor(77)
        assert catalog.indexed_page(spark, root, SCHEMA, at, 9).collect() == catalog.paginate(df, order, at, 9).collect()
        assert len(catalog.indexed_page(spark, root, SCHEMA, "no cursor").collect()) == 25


def test_a_page_reads_its_range_alone(spark, tmp_path):
    root = str(tmp_path / "i")
    catalog.index_order(spark.range(10000).selectExpr("id as k", "cast(id as string) as name"), [F.col("k")], root, parts=8)
    page = catalog.indexed_page(spark, root, SCHEMA, catalog.encode_cursor(40), 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters: [")[1].split("]")[0] and "_at" in plan.split("PushedFilters: [")[1].split("]")[0]
    for other in (tmp_path / "i" / "rows").glob("_range=[1-9]/*.parquet"):
        other.write_bytes(b"not Parquet")
    assert [r["k"] for r in catalog.indexed_page(spark, root, SCHEMA, catalog.encode_cursor(40), 10).collect()] == list(range(40, 50))
