"""Schemas that drift: tree edit scripts between versions, compiled into projections.

A schema is a tree whose nodes carry a persistent id, a name and a type. The script
between two versions is a cheapest tree edit: deleting or adding a node costs one,
renaming and retyping a matched node half of one each, and nodes with different ids never
match. Whole trees go in; from the right end of both forests, steps that every cheapest
script has (a tree that both sides have as it is, a node that the other side has nowhere,
a node below which both sides have the same nodes) are taken as they come, and only where
several are open does the dynamic programme over ordered forests decide. A node that the
script deletes and adds again is moved.

The script, as a mapping of ids, is compiled into a projection that turns rows written
under one version into rows of the latest version.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.nested import as_int, children_of, plain, schemas_of, type_name
from lakeloom.operators.ordered import predecessor
from lakeloom.shared import fresh_path, materialize
from lakeloom.sources.parquet_blocks import _open

#: A tree node: [id, name, type, default, children]; children are in the order of their ids.
Node = list


def tree_of(t: object) -> list[Node]:
    """Children of a type as nodes; nodes without an id are passed over in favour of what is inside them."""
    out: list[Node] = []
    for i, name, kind, default in children_of(t):
        below = tree_of(kind) if isinstance(plain(kind), dict) else []
        out += below if i is None else [[i, name, type_name(kind), default, below]]
    return sorted(out, key=lambda n: n[0])


def schema_trees(metadata: DataFrame, table_col: str, json_col: str) -> DataFrame:
    """table_name, schema_id, tree (JSON) of every schema; where records state different trees under one id, the fullest and then last in order holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(t, sid, json.dumps(tree_of(s), sort_keys=True, ensure_ascii=False)) for t, m in zip(b["t"], b["m"]) for sid, s in schemas_of(m)}
            yield pd.DataFrame(list(rows), columns=["table_name", "schema_id", "tree"]).astype({"schema_id": "int32"})

    two = metadata.select(F.col(table_col).cast("string").alias("t"), F.col(json_col).cast("string").alias("m"))
    found = two.mapInPandas(run, "table_name string, schema_id int, tree string")
    return found.groupBy("table_name", "schema_id").agg(F.max(F.struct(F.length("tree"), "tree"))["tree"].alias("tree"))


def _index(nodes: list[Node], parent: int = 0, out: dict | None = None) -> dict[int, tuple[str | None, str, int, object]]:
    """id -> (name, type, parent id, default)."""
    out = {} if out is None else out
    for i, name, kind, default, kids in nodes:
        out.setdefault(i, (name, kind, parent, default))
        _index(kids, i, out)
    return out


Forest = tuple  # of (id, Forest), in the order of ids


def forest_of(nodes: list[Node], seen: set[int] | None = None) -> Forest:
    """The tree's ids; of an id that stands twice the first counts, what is below the others hangs from the node around them."""
    seen, out = set() if seen is None else seen, []
    for i, _, _, _, kids in nodes:
        if i in seen:
            out += forest_of(kids, seen)
        else:
            seen.add(i)
            out.append((i, forest_of(kids, seen)))
    return tuple(sorted(out, key=lambda x: x[0]))


def _ids(f: Forest, out: set[int] | None = None) -> set[int]:
    out = set() if out is None else out
    for i, kids in f:
        out.add(i)
        _ids(kids, out)
    return out


def matches(a: Forest, b: Forest) -> tuple[set[int], bool]:
    """(ids that a cheapest script leaves in place, whether the dynamic programme was needed)."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    here, there = _ids(a), _ids(b)
    kept, hard, todo = set(), False, [(a, b)]
    while todo:
        a, b = todo.pop()
        while a and b:
            if a[-1] == b[-1]:
                _ids(a[-1:], kept)
                a, b = a[:-1], b[:-1]
                continue
            (i, ik), (j, jk) = a[-1], b[-1]
            if i not in there:
                a = a[:-1] + ik
            elif j not in here:
                b = b[:-1] + jk
            elif i == j and _ids(ik) & there == _ids(jk) & here:
                kept.add(i)
                todo.append((ik, jk))
                a, b = a[:-1], b[:-1]
            else:
                hard = True
                kept |= _programme(a, b)
                break
    return kept, hard


def _programme(a: Forest, b: Forest) -> set[int]:
    """Most matches of two ordered forests, by the rightmost roots: delete the one, add the other, or match them."""

    @lru_cache(None)
    def size(f: Forest) -> int:
        return sum(1 + size(k) for _, k in f)

    @lru_cache(None)
    def best(a: Forest, b: Forest) -> tuple[int, str]:
        if a == b:
            return size(a), "all"
        if not a or not b:
            return 0, ""
        (i, ik), (j, jk) = a[-1], b[-1]
        options = [(best(a, b[:-1] + jk)[0], "add"), (best(a[:-1] + ik, b)[0], "delete")]
        if i == j:
            options.insert(0, (best(a[:-1], b[:-1])[0] + best(ik, jk)[0] + 1, "match"))
        return max(options, key=lambda x: x[0])  # of equal ones the first

    kept, todo = set(), [(a, b)]
    while todo:
        a, b = todo.pop()
        step = best(a, b)[1]
        if step == "all":
            _ids(a, kept)
        elif step == "delete":
            todo.append((a[:-1] + a[-1][1], b))
        elif step == "add":
            todo.append((a, b[:-1] + b[-1][1]))
        elif step == "match":
            kept.add(a[-1][0])
            todo += [(a[:-1], b[:-1]), (a[-1][1], b[-1][1])]
    return kept


def edit_script(old: list[Node], new: list[Node]) -> list[tuple[int, str, str | None, str | None]]:
    """(id, change, before, after) with change one of added, dropped, moved, renamed, retyped: the operations of a cheapest edit of one tree into the other."""
    a, b = _index(old), _index(new)
    kept, _ = matches(forest_of(old), forest_of(new))
    out = []
    for i in a.keys() - kept:
        out.append((i, "moved", str(a[i][2]), str(b[i][2])) if i in b else (i, "dropped", a[i][0], None))
    for i in b.keys() - kept - a.keys():
        out.append((i, "added", None, b[i][0]))
    for i in kept | (a.keys() & b.keys()):
        (n0, t0, _, _), (n1, t1, _, _) = a[i], b[i]
        if n0 != n1:
            out.append((i, "renamed", n0, n1))
        if t0 != t1:
            out.append((i, "retyped", t0, t1))
    return sorted(out, key=lambda x: (x[0], x[1]))


CHANGES = "table_name string, schema_id int, previous_schema_id int, field_id int, change_kind string, before string, after string"


def schema_changes(metadata: DataFrame, table_col: str = "table_name", json_col: str = "metadata") -> DataFrame:
    """Every change from each schema of a table to the next: the edit scripts as rows.

    Defined cases: text that is null or not valid JSON holds no schema; the lowest schema
    id of a table gives no change; ids given as text are numbers; of two nodes with one
    id in a schema the first counts; a null table name is a table of its own; an empty
    table gives an empty result.
    """
    pairs = predecessor(schema_trees(metadata, table_col, json_col), "table_name", "schema_id", "tree")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.table_name, r.schema_id, r.prev_id, *c) for r in b.itertuples() for c in edit_script(json.loads(r.prev), json.loads(r.tree))]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")])
            yield out.astype({"schema_id": "int32", "previous_schema_id": "int32", "field_id": "int32"})

    have = pairs.filter(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("tree")))
    return have.select("table_name", "schema_id", F.col("_prev_order").alias("prev_id"), F.col("_prev").alias("prev"), "tree").mapInPandas(run, CHANGES)


class _Exact(float):
    """A JSON number with a fraction that remembers how it was written."""

    def __new__(cls, text: str) -> _Exact:
        self = float.__new__(cls, text)
        self.text = text
        return self


_DIGITS = decimal.Context(prec=100)


def _plain_text(x: object) -> str:
    return x.text if isinstance(x, _Exact) else json.dumps(x) if isinstance(x, bool) else str(x)


def _decimal(x: object) -> str | None:
    try:
        return None if isinstance(x, bool) else format(_DIGITS.normalize(_DIGITS.create_decimal(_plain_text(x))), "f")
    except decimal.InvalidOperation:
        return None


def _moment(x: object) -> str | None:
    m = re.fullmatch(r"\s*(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d(?:\.\d+)?)?))?\s*(Z|[+-]\d\d(?::?\d\d)?)?\s*", str(x))
    if not m:
        return None
    zone = (m[3] or "Z").replace("Z", "+00:00").replace(":", "")
    try:
        t = datetime.datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}").replace(tzinfo=datetime.timezone(datetime.timedelta(minutes=(1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[3:5] or 0)))))
    except ValueError:
        return None
    return t.astimezone(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def cast_value(x: object, kind: str) -> object:
    """A JSON value as ``kind`` wants it; a value that cannot be read so is kept as text."""
    if x is None or kind in NESTED_KINDS:
        return x
    if kind in ("int", "integer", "long", "bigint", "smallint") and (i := as_int(x)) is not None:
        return i
    if kind in ("float", "double", "real", "doubleprecision") and not isinstance(x, (bool, dict, list)):
        try:
            return float(str(x))
        except ValueError:
            return str(x)
    if kind.startswith(("decimal", "numeric")) and (d := _decimal(x)) is not None:
        return d
    if kind.startswith("timestamp") and (t := _moment(x)) is not None:
        return t
    if kind == "date" and (t := _moment(x)) is not None:
        return t[:10]
    if kind in ("boolean", "bool") and str(x).strip().lower() in ("true", "false", "t", "f", "0", "1"):
        return str(x).strip().lower() in ("true", "t", "1")
    return json.dumps(x, sort_keys=True) if isinstance(x, (dict, list)) else _plain_text(x)


NESTED_KINDS = ("struct", "list", "map")


def compile_projection(source: list[Node] | None, target: list[Node]):
    """A function from rows written under ``source`` to rows of ``target``; fields are matched by id.

    Without a known source schema, fields are matched by name. A field that the source
    lacks takes its initial default, else null. A field that was moved to another struct
    is fetched from where it was, unless a list or map lies between. A struct, list or map
    that became text is written as JSON, a scalar that became a list is its one element.
    Any other value that does not fit is null in the row and goes into ``rest`` as it was,
    under the ids on the way to it (with places in lists and keys of maps between them);
    ``misfits`` takes the names of such fields. Values of fields that the target lacks go
    into ``rest`` too, without a word in ``misfits``.
    """
    places: dict[int, tuple[str, ...]] = {}
    names = {i: n[0] for i, n in _index(target).items()}

    def place(nodes: list[Node], at: tuple[str, ...]) -> None:
        for i, name, kind, _, kids in nodes:
            places.setdefault(i, (*at, name))
            if kind == "struct":
                place(kids, (*at, name))

    place(source or [], ())

    wanted = {i: n[1] for i, n in _index(target).items()}

    def dropped(x: dict, below: list[Node], ids: tuple, rest: dict) -> None:
        for i, name, kind, _, kids in below:
            y = x.get(name)
            if y is None:
                continue
            if i not in wanted:
                rest[_pointer((*ids, i))] = y
            elif kind == wanted[i] == "struct" and isinstance(y, dict):
                dropped(y, kids, (*ids, i), rest)

    def fetch(row: dict, i: int) -> object:
        x: object = row
        for name in places[i]:
            x = x.get(name) if isinstance(x, dict) else None
        return x

    def project(row: dict, rest: dict | None = None, misfits: list | None = None) -> dict:
        def misfit(x: object, ids: tuple) -> None:
            if rest is not None:
                rest[_pointer(ids)] = x
            if misfits is not None:
                name = ".".join(str(names.get(i, i)) for i in ids if isinstance(i, int))
                if name not in misfits:
                    misfits.append(name)

        def value(x: object, t: Node, s: Node | None, ids: tuple) -> object:
            kind, kids = t[2], t[4]
            if x is None:
                return None
            same = s is None or s[2] == kind or (s[2] not in NESTED_KINDS and kind not in NESTED_KINDS)
            below = s[4] if s is not None and same else None
            if kind == "struct" and same and isinstance(x, dict):
                return struct(x, kids, below, ids)
            if kind == "map" and same and isinstance(x, dict):
                e, f = _named(kids, "value"), _named(below, "value")
                return {k: value(y, e, f, (*ids, k, e[0])) if e else y for k, y in x.items()}
            if kind == "list" and isinstance(x, list):
                e, f = _named(kids, "element"), _named(below, "element")
                return [value(y, e, f, (*ids, str(n), e[0])) if e else y for n, y in enumerate(x)]
            if kind == "list" and not isinstance(x, dict):
                e = _named(kids, "element")
                if e is None or e[2] not in ("struct", "map"):
                    return [value(x, e, None, ids) if e else x]
            elif kind not in NESTED_KINDS and (same or _is_text(kind) or not isinstance(x, (dict, list))):
                return cast_value(x, kind)
            misfit(x, ids)
            return None

        def struct(x: dict, kids: list[Node], below: list[Node] | None, ids: tuple) -> dict:
            by = {n[0]: n for n in below} if below is not None else None
            out = {}
            for t in kids:
                at = (*ids, t[0])
                if by is None:
                    out[t[1]] = value(x.get(t[1]), t, None, at)
                elif t[0] in by:
                    out[t[1]] = value(x.get(by[t[0]][1]), t, by[t[0]], at)
                elif t[0] in places:
                    out[t[1]] = value(fetch(row, t[0]), t, None, at)
                else:
                    out[t[1]] = cast_value(t[3], t[2])
            return out

        if rest is not None and source is not None:
            dropped(row, source, (), rest)
        return struct(row, target, source, ())

    return project


def _pointer(ids: tuple) -> str:
    """A path as one text, with / and ~ in keys of maps written as in JSON pointers."""
    return "/".join(str(i).replace("~", "~0").replace("/", "~1") for i in ids)


def _is_text(kind: str) -> bool:
    return kind.startswith(("string", "text", "varchar", "char", "bpchar"))


def _named(kids: list[Node] | None, name: str) -> Node | None:
    return next((k for k in kids or [] if k[1] == name), None)


def target_schemas(metadata: DataFrame, trees: DataFrame, table_col: str = "table_name", json_col: str = "metadata", order: tuple[str, ...] = ("recorded_time", "metadata_id")) -> DataFrame:
    """_t, latest_schema_id, _latest: of each table, the schema that its newest valid record names as current; the highest one if none is named or that one is not known."""
    order = tuple(c for c in order if c in metadata.columns)
    said = F.get_json_object(json_col, "$.current-schema-id").try_cast("int")
    valid = metadata.filter(F.json_object_keys(json_col).isNotNull()).select(F.col(table_col).cast("string").alias("_ct"), F.struct(*order, said.alias("id")).alias("r"))
    current = valid.filter("r.id is not null").groupBy("_ct").agg(F.max("r")["id"].alias("_current"))
    j = trees.join(current, F.col("_t").eqNullSafe(F.col("_ct")), "left")
    best = j.groupBy("_t").agg(F.max(F.struct(F.coalesce(F.col("_s") == F.col("_current"), F.lit(False)).alias("named"), "_s", "_tree")).alias("_l"))
    return best.select("_t", F.col("_l._s").alias("latest_schema_id"), F.col("_l._tree").alias("_latest"))


def unify_rows(rows: DataFrame, metadata: DataFrame, *, table_col: str = "table_name", schema_col: str = "schema_id", body_col: str = "body", keys: list[str], json_col: str = "metadata") -> DataFrame:
    """All rows of each table under its current schema: table_name, ``keys``, schema_id, latest_schema_id, row, rest, problem.

    ``row`` is a JSON object with all fields of the schema that :func:`target_schemas`
    chooses, in the order of their ids; :func:`unify_table` gives typed columns. Rows carry
    no schema and meet no shuffle, however many one table has: each worker looks up the
    trees of the tables that it meets in a written table, and compiles one projection for
    each pair of schemas.

    Defined cases: a body that is null or no JSON object gives a null row with the
    problem ``unreadable body``; a schema id that no record of the table states gives the
    problem ``unknown schema`` and fields are matched by name; a table without any schema
    keeps its body as it is with ``unknown table``. A value that fits its field's latest
    type in no way is null in ``row``, stands in ``rest`` (a JSON object by paths of ids)
    and its field is named in ``problem`` after ``no fit:``. Values of fields that the
    target lacks stand in ``rest`` as well. Numbers keep all their digits.
    """
    trees = schema_trees(metadata, table_col, json_col).select(F.col("table_name").alias("_t"), F.col("schema_id").alias("_s"), F.col("tree").alias("_tree"))
    trees = materialize(trees, "trees")
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null")).alias("k")
    none = F.lit(None).cast("int")
    latest = target_schemas(metadata, trees, table_col, json_col).select(key(F.col("_t")), F.lit(None).cast("int").alias("s"), F.col("_latest").alias("tree"), "latest_schema_id")
    lookup = trees.select(key(F.col("_t")), F.col("_s").alias("s"), F.col("_tree").alias("tree"), none.alias("latest_schema_id")).unionAll(latest)
    path = fresh_path(rows.sparkSession, "schemas")
    lookup.repartitionByRange("k").sortWithinPartitions("k").write.option("parquet.block.size", 1 << 20).parquet(path)

    names = ["table_name", *[k for k in keys if k != table_col], "schema_id"]
    base = rows.select(F.col(table_col).alias("table_name"), *[F.col(k) for k in keys if k != table_col], F.col(schema_col).cast("int").alias("schema_id"), F.col(body_col).cast("string").alias("row"))
    text, out = F.lit(None).cast("string"), None
    out = base.select(*names, none.alias("latest_schema_id"), "row", text.alias("rest"), text.alias("problem")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[int | None, tuple[str, int | None]]] = {}

        def learn(tables: list[str]) -> None:
            fs, p = _open(path)
            t = ds.dataset(p, filesystem=fs, format="parquet").to_table(filter=pc.field("k").isin(tables))
            if len(known) + len(tables) > 5_000:
                known.clear()
            known.update({k: {} for k in tables})
            for r in t.to_pylist():
                known[r["k"]][r["s"]] = (r["tree"], r["latest_schema_id"])

        @lru_cache(4096)
        def projection(source: str | None, target: str):
            return compile_projection(None if source is None else json.loads(source), json.loads(target))

        def one(table: str | None, schema: object, body: str | None) -> tuple[int | None, str | None, str | None, str | None]:
            schemas = known["null" if table is None else f"={table}"]
            target, target_id = schemas.get(None, (None, None))
            source = None if schema is None or schema != schema else schemas.get(int(schema), (None,))[0]
            try:
                x = plain(json.loads(body, parse_float=_Exact)) if body else None
            except ValueError:
                x = None
            if not isinstance(x, dict):
                return target_id, None, None, "unreadable body"
            if target is None:
                return None, body, None, "unknown table"
            rest, misfits = {}, []
            said = projection(source, target)(x, rest, misfits)
            problems = ["unknown schema"] * (source is None) + ["no fit: " + ", ".join(misfits)] * bool(misfits)
            return target_id, json.dumps(said, ensure_ascii=False), json.dumps(rest, ensure_ascii=False) if rest else None, "; ".join(problems) or None

        for b in batches:
            tables = [None if x is None or x != x else x for x in b["table_name"]]
            if unseen := {"null" if x is None else f"={x}" for x in tables} - known.keys():
                learn(sorted({"null" if x is None else f"={x}" for x in tables} if len(known) + len(unseen) > 5_000 else unseen))
            done = [one(*r) for r in zip(tables, b["schema_id"], b["row"])]
            cols = {c: pd.Series([d[k] for d in done], dtype="Int64" if k == 0 else object, index=b.index) for k, c in enumerate(("latest_schema_id", "row", "rest", "problem"))}
            yield b[names].assign(**cols)

    return base.mapInPandas(run, out)


# Types of schemas and what they are in Spark, where the names differ.
_SPARK = {"long": "bigint", "integer": "int", "int4": "int", "int8": "bigint", "int2": "smallint", "float4": "float", "real": "float", "float8": "double", "doubleprecision": "double", "bool": "boolean", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "numeric": "decimal(38,10)"}


def spark_type(node: Node) -> str:
    """The Spark type of a node's values in ``row``; kinds that Spark lacks are text."""
    _, _, kind, _, kids = node
    if kind == "struct":
        return "struct<" + ",".join(f"`{(k[1] or str(k[0])).replace('`', '``')}`:{spark_type(k)}" for k in kids) + ">" if kids else "string"
    if kind == "list":
        return f"array<{spark_type(kids[0])}>" if kids else "array<string>"
    if kind == "map":
        value = _named(kids, "value")
        return f"map<string,{spark_type(value)}>" if value else "map<string,string>"
    said = _SPARK.get(kind, kind)
    return said if re.fullmatch(r"(tinyint|smallint|int|bigint|float|double|boolean|date|timestamp|timestamp_ntz|decimal\(\d+,\d+\))", said) else "string"


def unify_table(unified: DataFrame, metadata: DataFrame, table_name: str, *, keys: list[str], table_col: str = "table_name", json_col: str = "metadata") -> DataFrame:
    """One table of :func:`unify_rows` as typed columns: ``keys``, the fields of its current schema, ``rest`` and ``problem``.

    The target's tree, one row, comes to the driver. A field named like a key, ``rest`` or
    ``problem`` gets an underscore behind its name.
    """
    own = metadata.filter(F.col(table_col) == table_name)
    trees = schema_trees(own, table_col, json_col).select(F.col("table_name").alias("_t"), F.col("schema_id").alias("_s"), F.col("tree").alias("_tree"))
    found = target_schemas(own, trees, table_col, json_col).first()
    if found is None:
        raise ValueError(f'no schema of "{table_name}"')
    fields = json.loads(found["_latest"])
    kind = T._parse_datatype_string(spark_type([0, None, "struct", None, fields]))
    typed = F.from_json("row", kind, {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("r")
    taken = {*keys, "rest", "problem"}
    one = unified.filter(F.col("table_name") == table_name).select(*keys, typed, "rest", "problem")
    return one.select(*keys, *[F.col("r")[f.name].alias(f.name + "_" * (f.name in taken)) for f in kind], "rest", "problem")
