import json

from lakeloom.operators.nested import as_int, flatten_records, flatten_schemas, schemas_of


def test_ids_of_any_kind():
    assert [as_int(x) for x in (3, "4", 5.0, "6.0", None, True, "x", [1], 2.5)] == [3, 4, 5, 6, None, None, None, None, None]


def test_flatten_schemas_edge_cases(spark):
    deep = {"type": "list", "element-id": 3, "element": {"type": "map", "key-id": "4", "key": "string", "value-id": 5, "value": json.dumps({"type": "struct", "fields": [{"id": 6, "name": "x", "type": "INT"}]})}}
    doc = {"schemas": [{"schema-id": "1", "fields": [{"id": 1, "name": "a", "type": "decimal( 9, 2)"}, {"id": 2, "name": "b", "type": deep}, {"name": "no id", "type": {"type": "struct", "fields": [{"id": 9, "name": "y", "type": "int"}]}}]}]}
    old = {"schema": {"fields": [{"id": 1, "name": "a", "type": "int"}]}}
    rows = [("t", json.dumps(doc)), ("t", json.dumps(doc)), ("t", json.dumps(doc)[:-9]), ("t", None), ("t", ""), ("t", "[]"), (None, json.dumps(old)), ("t", '{"schemas": null}')]
    df = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, metadata string, field_id int")
    got = {tuple(r) for r in flatten_schemas(df).collect()}
    assert got == {("t", 1, 1, 0, "a", "decimal(9,2)"), ("t", 1, 2, 0, "b", "list"), ("t", 1, 3, 2, "element", "map"), ("t", 1, 4, 3, "key", "string"), ("t", 1, 5, 3, "value", "struct"), ("t", 1, 6, 5, "x", "int"), ("t", 1, 9, 0, "y", "int"), (None, 0, 1, 0, "a", "int")}
    assert flatten_schemas(df.limit(0)).count() == 0 and schemas_of("17") == []


def test_types_of_any_depth_against_a_walk(spark):
    import random

    from lakeloom.operators.nested import as_int, children_of, type_name

    rng, ids = random.Random(3), iter(range(1, 100_000))

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["int", "String", " decimal( 9, 2)"])
        kind = rng.choice(["struct", "list", "map", "struct"])
        if kind == "list":
            t = {"type": "list", "element-id": next(ids), "element": grow(depth - 1)}
        elif kind == "map":
            t = {"type": "MAP ", "key-id": str(next(ids)), "key": "string", "value-id": float(next(ids)), "value": grow(depth - 1)}
        else:
            t = {"type": "struct", "fields": [{"id": next(ids) if rng.random() < 0.9 else None, "name": f"n{k} \"é\"", "type": grow(depth - 1)} for k in range(rng.randint(0, 3))] + [7]}
        return json.dumps(t) if rng.random() < 0.2 else {"type": t} if rng.random() < 0.1 else t

    def walk(t, parent, out):
        for i, name, kind, _ in children_of(t):
            if i is not None:
                out.add((i, parent, name, type_name(kind)))
            walk(kind, parent if i is None else i, out)

    docs, want = [], set()
    for n in range(40):
        schema = {"schema-id": n, "type": "struct", "fields": [{"id": next(ids), "name": "top", "type": grow(n % 12)}]}
        docs.append((f"t{n % 3}", json.dumps({"schemas": [schema, None, 3]}) if n % 2 else json.dumps({"schema": schema})))
        out = set()
        walk(schema, 0, out)
        want |= {(f"t{n % 3}", n, *x) for x in out}
    got = {tuple(r) for r in flatten_schemas(spark.createDataFrame(docs, "table_name string, metadata string")).collect()}
    assert got == want and as_int("5") == 5


SCHEMA = "k int, name string, a array<struct<x:int, s:struct<y:string>, b:array<struct<z:int>>>>, w struct<u:int, c:array<struct<k:int>>>"


def test_flatten_records_against_plain_loops(spark):
    rows = [(1, "p", [(1, ("q",), [(7,), None]), None, (2, None, None)], (5, [(8,), (9,)])), (2, None, None, None), (3, "r", [], (None, None)), (4, "s", [(None, (None,), [])], (6, []))]
    t = flatten_records(spark.createDataFrame(rows, SCHEMA).repartition(2), ["k"])
    assert set(t) == {"", "a", "a.b", "w.c"}
    assert sorted(tuple(r) for r in t[""].collect() if r[0] != 2) == [(1, "p", 5), (3, "r", None), (4, "s", 6)]
    assert sorted((r["k"], r["_pos"], r["a.x"], r["a.s.y"]) for r in t["a"].collect()) == [(1, [0], 1, "q"), (1, [1], None, None), (1, [2], 2, None), (4, [0], None, None)]
    assert sorted((r["k"], r["_pos"], r["a.b.z"]) for r in t["a.b"].collect()) == [(1, [0, 0], 7), (1, [0, 1], None)]
    assert sorted((r["k"], r["_pos"], r["w.c.k"]) for r in t["w.c"].collect()) == [(1, [0], 8), (1, [1], 9)]
    assert all(x.count() == 0 for x in flatten_records(spark.createDataFrame([], SCHEMA), ["k"]).values())
