from pyspark.sql import functions as F
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeloom.operators.hierarchy import all_descendants, descendants, resolve_hierarchy

SCHEMA = "t string, id int, up int, n string, p string, g string"


def brute(rows):
    parent = {}
    for t, i, u in rows:
        if i is not None:
            old = parent.get((t, i))
            parent[t, i] = u if old is None else old if u is None else min(u, old)
    out = {}
    for (t, i) in parent:
        path, at = [i], i
        while (u := parent[t, at]) is not None and (t, u) in parent:
            if u in path:
                path = None
                break
            path.append(u)
            at = u
        out[t, i] = (at, len(path) - 1, path[::-1]) if path else (None, None, None)
    return out


def solve(spark, rows, k):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return {(r["t"], r["id"]): (r["root"], r["depth"], r["path"]) for r in resolve_hierarchy(df, "id", "up", "t", paths=True, fragment_rows=k).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 15)), st.one_of(st.none(), st.integers(0, 17))), max_size=40))
def test_against_brute_force(spark, rows):
    assert solve(spark, rows, 3) == brute(rows)


def test_long_chain_over_many_fragments(spark):
    rows = [("hot", i, i - 1 if i else None) for i in range(60)]
    assert solve(spark, rows, 7) == brute(rows)


def test_cycles_local_and_global(spark):
    rows = [("t", 1, 1), ("t", 2, 3), ("t", 3, 2), ("t", 4, 2), *[("u", i, (i + 1) % 30) for i in range(30)], ("u", 99, 5)]
    got = solve(spark, rows, 4)
    assert got == brute(rows) and got["u", 99][0] is None


def test_large_ids_keep_their_precision(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([("a", big, None), ("a", 5, big), ("a", 6, big - 1)], "t string, id bigint, up bigint")
    got = {r["id"]: (r["root"], r["depth"]) for r in resolve_hierarchy(df, "id", "up", "t").collect()}
    assert got == {big: (big, 0), 5: (big, 1), 6: (6, 0)}


def test_empty_and_descendants(spark):
    empty = resolve_hierarchy(spark.createDataFrame([], SCHEMA), "id", "up", "t")
    assert empty.count() == 0 and empty.columns == ["t", "id", "root", "depth"]
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("a", 3, 2)], "t string, id int, up int")
    pairs = {tuple(r) for r in descendants(resolve_hierarchy(df, "id", "up", "t", paths=True), "id", "t").collect()}
    assert pairs == {("a", 1, 2, 1), ("a", 1, 3, 2), ("a", 2, 3, 1)}


@pytest.mark.parametrize("k", [1, 1000])
def test_star(spark, k):
    rows = [("s", 0, None), *[("s", i, 0) for i in range(1, 40)]]
    assert solve(spark, rows, k) == brute(rows)


@pytest.mark.parametrize("k", [3, 1000])
def test_descendants_on_and_below_cycles(spark, k):
    rows = [("a", 1, 2), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 9, None), ("a", 10, 9), ("b", 5, 5), ("b", 6, 5), (None, 7, 8), (None, 8, 7), *[("u", i, (i + 1) % 12) for i in range(12)], *[("u", i, i - 7) for i in range(12, 30)]]
    parent = {(t, i): u for t, i, u in rows}
    pairs = {}
    for t, i in parent:
        seen, at = [i], parent[t, i]
        while at is not None and at not in seen:
            pairs[t, at, i] = len(seen)
            seen.append(at)
            at = parent[t, at]
    ring = {(t, at) for t, at, i in pairs if (t, i, at) in pairs} | {("b", 5)}
    df = spark.createDataFrame(rows, "t string, id int, up int")
    got = all_descendants(df, "id", "up", "t", fragment_rows=k).collect()
    assert len(got) == len(pairs) and {tuple(r)[:4] for r in got} == {(*key, n) for key, n in pairs.items()}
    assert pairs["a", 3, 4] == 1 and all(r["in_cycle"] == ((r["t"], r["ancestor"]) in ring) for r in got)


def test_a_chain_of_a_million_and_long_paths_in_bounded_memory(spark):
    import resource

    import numpy as np
    import pandas as pd

    from lakeloom.operators import hierarchy

    n = 1_000_000
    chain = spark.range(n).select(F.lit("t").alias("g"), F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    r = hierarchy.resolve_hierarchy(chain, "n", "p", "g")
    assert tuple(r.agg(F.count("*"), F.max("depth"), F.sum("depth"), F.max("root")).first()) == (n, n - 1, n * (n - 1) // 2, 0)

    k = 16_000  # 128 million path entries leave one fragment, a million at a time
    ids = np.arange(k)
    pdf = pd.DataFrame({"g": "t", "n": ids, "p": np.maximum(ids - 1, 0), "linked": ids > 0, "last": ids, "wl": 0, "cyc": False, "seg": [np.array([i]) for i in ids]})
    before, rows, entries = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
    for piece in hierarchy._contract(pdf, True):
        rows += len(piece)
        size = sum(map(len, piece["seg"]))
        assert size < hierarchy.PATH_ENTRIES + k
        entries += size
    assert rows == k and entries == k * (k + 1) // 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
