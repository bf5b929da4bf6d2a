import itertools
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.operators.drift import cast_value, compile_projection, edit_script, schema_changes, matches, tree_of, unify_rows, unify_table


def struct(*fields):
    return {"type": "struct", "fields": [{"id": i, "name": n, "type": t} for i, n, t in fields]}


def test_script_of_each_kind():
    old = tree_of(struct((1, "a", "int"), (2, "b", struct((3, "c", "string"))), (4, "gone", "date")))
    new = tree_of(struct((2, "b2", struct((5, "new", "int"))), (1, "a", "LONG"), (3, "c", "string")))
    assert edit_script(old, new) == [(1, "retyped", "int", "long"), (2, "renamed", "b", "b2"), (3, "moved", "2", "0"), (4, "dropped", "gone", None), (5, "added", None, "new")]


def test_case_blanks_order_and_docs_are_no_change():
    a = {"type": "struct", "fields": [{"id": 1, "name": "a", "type": "decimal(9,2)", "doc": "x"}, {"id": 2, "name": "b", "type": "int"}]}
    b = {"type": "struct", "fields": [{"id": "2", "name": "b", "type": "INT", "required": True}, {"id": 1, "name": "a", "type": " Decimal(9, 2)"}]}
    assert edit_script(tree_of(a), tree_of(b)) == []


def _shapes(parents):
    kids = {}
    for i, p in enumerate(parents, 1):
        kids.setdefault(p % i, []).append(i)
    return kids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=5), st.data())
def test_fewest_moves_by_brute_force(a, data):
    b = data.draw(st.lists(st.integers(0, 9), min_size=len(a), max_size=len(a)))
    old, new = _shapes(a), _shapes(b)

    def restricted(kids, keep):
        def walk(at):
            return [x for k in kids.get(at, []) for x in ([(k, tuple(walk(k)))] if k in keep else walk(k))]

        return walk(0)

    ids = range(1, len(a) + 1)
    best = max(n for n in range(len(a) + 1) for keep in itertools.combinations(ids, n) if restricted(old, set(keep)) == restricted(new, set(keep)))
    frozen = lambda kids, at=0: tuple((k, frozen(kids, k)) for k in kids.get(at, []))
    kept, _ = matches(frozen(old), frozen(new))
    assert len(kept) == best and restricted(old, kept) == restricted(new, kept)


def test_projection():
    old = tree_of(struct((1, "a", "int"), (2, "s", struct((3, "x", "int"), (4, "y", "string"))), (5, "l", {"type": "list", "element-id": 6, "element": struct((7, "p", "int"))})))
    new = tree_of({"type": "struct", "fields": [{"id": 1, "name": "a2", "type": "long"}, {"id": 2, "name": "s", "type": struct((3, "x2", "decimal(9,2)"))}, {"id": 4, "name": "y", "type": "string"}, {"id": 5, "name": "l", "type": {"type": "list", "element-id": 6, "element": struct((7, "q", "string"))}}, {"id": 8, "name": "d", "type": "int", "initial-default": 3}]})
    row = {"a": "12", "s": {"x": 5, "y": "v"}, "l": [{"p": 1}, None]}
    assert compile_projection(old, new)(row) == {"a2": 12, "s": {"x2": "5"}, "y": "v", "l": [{"q": "1"}, None], "d": 3}
    assert compile_projection(old, new)({}) == {"a2": None, "s": None, "y": None, "l": None, "d": 3}
    assert compile_projection(None, old)({"a": 1, "other": 2})["a"] == 1


def test_casts():
    assert [cast_value(x, "timestamp") for x in ("2024-10-31 11:24:37+02", "2024-10-31T11:24:37Z", "soon")] == ["2024-10-31 09:24:37.000000", "2024-10-31 11:24:37.000000", "soon"]
    assert (cast_value("2016-04-02", "date"), cast_value("1.50", "decimal(9,2)"), cast_value("T", "boolean"), cast_value(None, "int"), cast_value("x", "int")) == ("2016-04-02", "1.5", True, None, "x")


def test_changes_and_rows_end_to_end(spark):
    s = lambda i, *f: {"schema-id": i, **struct(*f)}
    docs = [("t", {"schemas": [s(0, (1, "a", "int")), s(3, (1, "b", "int"))]}), ("t", {"schemas": [s(7, (1, "b", "int"), (2, "c", "string"))]}), (None, {"schemas": [s(0, (1, "a", "int"))]})]
    meta = spark.createDataFrame([(t, json.dumps(d), 1, "x") for t, d in docs] + [("t", "{torn", 1, "y"), ("t", None, 1, "z")], "table_name string, metadata string, schema_id int, tree string")
    got = sorted(tuple(r) for r in schema_changes(meta).collect())
    assert got == [("t", 3, 0, 1, "renamed", "a", "b"), ("t", 7, 3, 2, "added", None, "c")]
    rows = spark.createDataFrame([(1, "t", 0, '{"a": 1}'), (2, "t", 7, '{"b": 2, "c": "x"}'), (3, "t", 5, '{"b": 3}'), (4, "t", 0, "{"), (5, "u", 0, '{"a": 9}'), (6, None, 0, '{"a": "8"}'), (7, "t", None, None)], "raw_id int, table_name string, schema_id int, body string")
    out = {r["raw_id"]: (r["row"] and json.loads(r["row"]), r["problem"]) for r in unify_rows(rows, meta, keys=["raw_id"]).collect()}
    assert out == {1: ({"b": 1, "c": None}, None), 2: ({"b": 2, "c": "x"}, None), 3: ({"b": 3, "c": None}, "unknown schema"), 4: (None, "unreadable body"), 5: ({"a": 9}, "unknown table"), 6: ({"a": 8}, None), 7: (None, "unreadable body")}
    assert schema_changes(meta.limit(0)).count() == 0


def test_values_of_fields_between_scalar_and_nested_are_kept():
    m = {"type": "map", "key-id": 20, "key": "string", "value-id": 21, "value": "int"}
    ints = lambda i: {"type": "list", "element-id": i, "element": "int"}
    old = tree_of(struct((1, "a", struct((10, "x", "int"))), (2, "b", m), (3, "c", ints(30)), (4, "d", "int"), (5, "e", struct((50, "x", "int"))), (6, "f", "int"), (7, "g", ints(70))))
    new = tree_of(struct((1, "a", "string"), (2, "b", "string"), (3, "c", "string"), (4, "d2", {"type": "list", "element-id": 40, "element": "string"}), (5, "e", "uuid"), (6, "f", struct((60, "x", "int"))), (7, "g", {"type": "list", "element-id": 70, "element": struct((71, "p", "int"))})))
    rest, misfits = {}, []
    row = compile_projection(old, new)({"a": {"x": 1}, "b": {"k": 2}, "c": [3], "d": 4, "e": {"x": 5}, "f": 6, "g": [7, None]}, rest, misfits)
    assert row == {"a": '{"x": 1}', "b": '{"k": 2}', "c": "[3]", "d2": ["4"], "e": None, "f": None, "g": [None, None]}
    assert rest == {"5": {"x": 5}, "6": 6, "7/0/70": 7} and misfits == ["e", "f", "g.element"]


def test_values_that_fit_nowhere_come_out_beside_the_row(spark):
    docs = [{"schemas": [{"schema-id": i, **struct((1, "a", t))} for i, t in enumerate([struct((2, "x", "int")), "uuid"])]}]
    meta = spark.createDataFrame([("t", json.dumps(d)) for d in docs], "table_name string, metadata string")
    rows = spark.createDataFrame([(1, "t", 0, '{"a": {"x": 1}}'), (2, "t", 1, '{"a": "u"}')], "raw_id int, table_name string, schema_id int, body string")
    out = {r["raw_id"]: (json.loads(r["row"]), r["rest"] and json.loads(r["rest"])["1"], r["problem"]) for r in unify_rows(rows, meta, keys=["raw_id"]).collect()}
    assert out == {1: ({"a": None}, {"x": 1}, "no fit: a"), 2: ({"a": "u"}, None, None)}


def test_cheapest_script_by_brute_force_with_nodes_on_one_side():
    import random

    rng = random.Random(7)
    for _ in range(150):
        def grow():
            ids = rng.sample(range(1, 8), rng.randint(1, 5))
            kids = {}
            for n, i in enumerate(sorted(ids)):
                kids.setdefault(rng.choice([0, *sorted(ids)[:n]]), []).append(i)
            return kids

        old, new = grow(), grow()
        frozen = lambda kids, at=0: tuple((k, frozen(kids, k)) for k in kids.get(at, []))

        def restricted(kids, keep):
            def walk(at):
                return [x for k in kids.get(at, []) for x in ([(k, tuple(walk(k)))] if k in keep else walk(k))]

            return walk(0)

        both = sorted({i for k in old.values() for i in k} & {i for k in new.values() for i in k})
        best = max(n for n in range(len(both) + 1) for keep in itertools.combinations(both, n) if restricted(old, set(keep)) == restricted(new, set(keep)))
        kept, _ = matches(frozen(old), frozen(new))
        assert len(kept) == best and kept <= set(both) and restricted(old, kept) == restricted(new, kept)


def test_current_schema_dropped_fields_and_exact_numbers(spark):
    v0 = struct((1, "a", "string"), (2, "n", "decimal(38,20)")) | {"schema-id": 0}
    v1 = struct((1, "b", "string"), (2, "n", "decimal(38,20)"), (3, "extra", struct((4, "x", "int")))) | {"schema-id": 1}
    docs = [(1, "t", json.dumps({"schemas": [v0, v1], "current-schema-id": 1})), (2, "t", json.dumps({"schemas": [v0, v1], "current-schema-id": 0})), (3, "t", json.dumps({"current-schema-id": 1})[:-3]), (1, "u", json.dumps({"schemas": [v0, v1]}))]
    meta = spark.createDataFrame(docs, "metadata_id bigint, table_name string, metadata string")
    body = '{"b": "x", "n": 123456789012345678.12345678901234567890, "extra": {"x": 5}}'
    rows = spark.createDataFrame([(1, "t", 1, body), (2, "u", 0, '{"a": "y", "n": "1.50"}'), (3, None, 0, "{}"), (4, "t", None, '{"a": "z"}')], "raw_id bigint, table_name string, schema_id int, body string")
    u = unify_rows(rows, meta, keys=["raw_id"])
    got = {r["raw_id"]: r for r in u.collect()}
    assert got[1]["latest_schema_id"] == 0 and json.loads(got[1]["row"]) == {"a": "x", "n": "123456789012345678.1234567890123456789"} and json.loads(got[1]["rest"]) == {"3": {"x": 5}} and got[1]["problem"] is None
    assert got[2]["latest_schema_id"] == 1 and json.loads(got[2]["row"]) == {"b": "y", "n": "1.5", "extra": None} and got[3]["problem"] == "unknown table" and got[4]["problem"] == "unknown schema"
    t = unify_table(u, meta, "u", keys=["raw_id"])
    assert t.dtypes == [("raw_id", "bigint"), ("b", "string"), ("n", "decimal(38,20)"), ("extra", "struct<x:int>"), ("rest", "string"), ("problem", "string")]
    assert t.first()["b"] == "y" and str(t.first()["n"]).startswith("1.5")
