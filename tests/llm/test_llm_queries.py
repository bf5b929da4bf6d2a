"""The queries of the sub-package on the smallest tables."""

import pytest

from lakeloom.llm import contamination
from lakeloom.llm.queries import R


@pytest.mark.parametrize("name", sorted(R.queries))
def test_query_runs_and_gives_distinct_rows(spark, sf, name):
    rows = [tuple(r) for r in R.queries[name](spark, sf).collect()]
    assert rows and len(rows) == len(set(rows))


def test_p6_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    runs = lambda t: {tuple(w[k : k + 13]) for w in [contamination.words(t)] for k in range(len(w) - 12)}
    mine = {i: runs(t) for i, t in items}
    want = {(d, i) for d, t in docs for r in [runs(t)] for i in mine if r & mine[i]}
    assert {tuple(r) for r in R.queries["p6_found"](spark, sf).collect()} == want


def test_p1_fills_no_file_beyond_its_capacity_and_keeps_all_bytes(spark, sf):
    rows = R.queries["p1_pack"](spark, sf).collect()
    load = {}
    for r in rows:
        if r["output_file"] is not None:
            load[r["table_name"], r["output_file"]] = load.get((r["table_name"], r["output_file"]), 0) + r["file_size"]
    assert max(load.values()) <= 536870912
