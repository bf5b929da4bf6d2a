"""Deeply nested records to related flat tables, on Arrow buffers.

Lists are flattened level by level: the offsets of a list array say how many children
each row has, the parent-index kernel says whose they are, and the keys reach the
children by one vectorised ``take``. No row is walked to emit its children. JSON text is
treated alike: its brackets and quotes are found in the whole buffer at once, which gives
the same offsets (:class:`JsonArrays`). The work is a ``mapInArrow`` without shuffle, so it
goes with the input's partitions; the only shuffle is the final removal of repeated rows,
combined map-side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The kinds of nested types in a table schema.
NESTED = ("struct", "list", "map")


def as_int(x: object) -> int | None:
    """An id given as a number or as text; None for anything else."""
    try:
        return None if x is None or isinstance(x, (bool, dict, list)) else int(x) if not isinstance(x, float) else int(x) if x == int(x) else None
    except (ValueError, OverflowError):
        try:
            return int(float(str(x))) if float(str(x)) == int(float(str(x))) else None
        except (ValueError, OverflowError):
            return None


def plain(x: object) -> object:
    """An object or array that was written as JSON text, decoded; anything else as it is."""
    while isinstance(x, str) and x.lstrip()[:1] in ("{", "["):
        try:
            x = json.loads(x)
        except ValueError:
            break
    return x


def _listed(x: object, key: str) -> list[dict]:
    held = plain(x.get(key)) if isinstance(x, dict) else None
    return [y for y in map(plain, held) if isinstance(y, dict)] if isinstance(held, list) else []


def schemas_of(text: str | None) -> list[tuple[int, dict]]:
    """(schema id, struct) of every schema in one metadata document; nothing for text that is not valid JSON.

    Reads ``schemas`` and the single ``schema`` of the older layout, whose id counts as 0 where it is missing.
    """
    try:
        doc = plain(json.loads(text)) if text else None
    except ValueError:
        return []
    if not isinstance(doc, dict):
        return []
    found = _listed(doc, "schemas")
    if isinstance(single := plain(doc.get("schema")), dict):
        found.append(single)
    return [(i, s) for s in found if (i := as_int(s.get("schema-id", 0))) is not None]


def children_of(t: object) -> list[tuple[int | None, str | None, object, object]]:
    """(id, name, type, initial default) of the nodes directly inside a type; types written as text are decoded."""
    t = plain(t)
    if not isinstance(t, dict):
        return []
    inner = plain(t.get("type"))
    if isinstance(inner, dict):  # one more wrapper around the type
        return children_of(inner)
    kind = str(inner).strip().lower()
    if kind == "list":
        return [(as_int(t.get("element-id")), "element", plain(t.get("element")), None)]
    if kind == "map":
        return [(as_int(t.get("key-id")), "key", plain(t.get("key")), None), (as_int(t.get("value-id")), "value", plain(t.get("value")), None)]
    return [(as_int(f.get("id")), None if f.get("name") is None else str(f["name"]), plain(f.get("type")), f.get("initial-default")) for f in _listed(t, "fields")]


def type_name(t: object) -> str:
    """struct, list or map for nested types, else the name without blanks in lower case."""
    t = plain(t)
    if isinstance(t, dict):
        inner = plain(t.get("type"))
        return type_name(inner) if isinstance(inner, dict) else "struct" if "fields" in t else type_name(inner)
    return "".join(str(t).split()).lower()


#: Bytes of JSON text whose structure is found at a time; bounds a worker's memory (about 100 bytes for each).
CHUNK_BYTES = 1 << 20

NODES = T.StructType(
    [T.StructField("table_name", T.StringType()), T.StructField("schema_id", T.IntegerType()), T.StructField("field_id", T.IntegerType()), T.StructField("parent_field_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]
)


class JsonArrays:
    """Where the values of JSON objects lie in the buffer of a string array, found by operations on whole arrays.

    Texts must be valid. Brackets outside strings give each object and array its depth;
    from that follow, by one search for all of them, what lies around each, which objects
    an array holds (as offsets into one list), and for each object where the value of each
    wanted key begins. No text is parsed on its own.
    """

    def __init__(self, texts: pa.Array, keys: tuple[str, ...]) -> None:
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        b = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.b, starts, n = b, ends - ends[0], len(b)
        at = np.arange(n, dtype=np.int64)
        quote = b == 34
        slash = b == 92
        if slash.any():  # a quote behind an odd number of backslashes is none
            other = np.maximum.accumulate(np.where(slash, -1, at))
            behind = np.append(np.int64(-1), other[:-1])
            quote &= (at - 1 - behind) % 2 == 0
        free = (np.cumsum(quote) % 2 == 0) & ~quote
        self.quotes = np.flatnonzero(quote)
        opening, closing = free & ((b == 123) | (b == 91)), free & ((b == 125) | (b == 93))
        depth = np.cumsum(opening.astype(np.int32) - closing.astype(np.int32))
        self.open = np.flatnonzero(opening)
        level = depth[self.open].astype(np.int64)
        order = np.argsort(level, kind="stable")
        place = level[order] * n + self.open[order]
        around = lambda p, d: order[np.searchsorted(place, d * n + p, side="right") - 1]
        self.parent = np.where(level > 1, around(self.open, np.maximum(level - 1, 1)), -1) if len(self.open) else np.zeros(0, np.int64)
        self.row = np.searchsorted(starts, self.open, side="right") - 1
        self.roots = np.flatnonzero((level == 1) & (b[self.open] == 123))
        self.stops = np.flatnonzero(free & ((b == 44) | (b == 125) | (b == 93) | (b == 32) | (b == 9) | (b == 10) | (b == 13)))
        solid = ~((b == 32) | (b == 9) | (b == 10) | (b == 13))
        following = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
        # objects inside each array, as one list with offsets
        is_object = b[self.open] == 123
        held = np.flatnonzero((self.parent >= 0) & is_object)
        self.members = held[np.argsort(self.parent[held], kind="stable")]
        self.offsets = np.searchsorted(self.parent[self.members], np.arange(len(self.open) + 1))
        colons = np.flatnonzero(free & (b == 58))
        end = self.quotes[np.searchsorted(self.quotes, colons) - 1] if len(colons) else colons
        begin = self.quotes[np.searchsorted(self.quotes, colons) - 2] + 1 if len(colons) else colons
        owner = around(colons, depth[colons].astype(np.int64)) if len(colons) else colons
        value = following[colons + 1] if len(colons) else colons
        self.value = {}
        for k in keys:
            raw = k.encode()
            hit = np.flatnonzero(end - begin == len(raw))
            for j, c in enumerate(raw):
                hit = hit[b[begin[hit] + j] == c]
            found = np.full(len(self.open), -1, np.int64)
            found[owner[hit]] = value[hit]  # of a repeated key the last counts
            self.value[k] = found

    def container(self, at: np.ndarray, bracket: str) -> np.ndarray:
        """Number of the object or array that begins at each place; -1 where none of that kind does."""
        ok = at >= 0
        ok[ok] = self.b[at[ok]] == ord(bracket)
        out = np.full(len(at), -1, np.int64)
        out[ok] = np.searchsorted(self.open, at[ok])
        return out

    def objects_in(self, arrays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(objects inside the arrays, which of the arrays each lies in); -1 is an empty array."""
        known = np.where(arrays >= 0, arrays, 0)
        first = self.offsets[known] if len(self.open) else known
        count = np.where(arrays >= 0, self.offsets[known + 1] - first, 0) if len(self.open) else known
        of = np.repeat(np.arange(len(arrays)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return self.members[first[of] + nth], of

    def text(self, at: np.ndarray) -> pa.Array:
        """Strings, and other scalars as they are written; null where there is none, and for objects and arrays."""
        begin, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ok = at >= 0
        first = np.zeros(len(at), np.uint8)
        first[ok] = self.b[at[ok]]
        string, scalar = first == 34, ok & ~np.isin(first, (34, 123, 91, 110))
        begin[string] = at[string] + 1
        end[string] = self.quotes[np.searchsorted(self.quotes, at[string]) + 1]
        begin[scalar] = at[scalar]
        end[scalar] = self.stops[np.searchsorted(self.stops, at[scalar])]
        length = end - begin
        offsets = np.append(0, np.cumsum(length)).astype(np.int32)
        data = self.b[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
        valid = string | scalar
        bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        out = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()), bits, int((~valid).sum()))
        escaped = pc.fill_null(pc.match_substring(out, "\\"), False)
        if pc.any(escaped).as_py():
            plain_text = [json.loads(f'"{x}"') for x in out.filter(escaped).to_pylist()]
            out = pc.replace_with_mask(out, escaped, pa.array(plain_text, pa.string()))
        return out


def _ids(texts: pa.Array) -> pa.Array:
    """Ids given as numbers or as text; null for anything else."""
    t = pc.utf8_trim_whitespace(texts)
    ok = pc.fill_null(pc.match_substring_regex(t, r"^[-+]?\d{1,9}\d?(\.0*)?$"), False)
    n = pc.cast(pc.if_else(ok, pc.replace_substring_regex(t, r"^\+|\.0*$", ""), pa.scalar(None, pa.string())), pa.int64())
    return pc.cast(pc.if_else(pc.less(pc.abs(n), 1 << 31), n, pa.scalar(None, pa.int64())), pa.int32())


_KEYS = ("schemas", "schema", "schema-id", "fields", "id", "name", "type", "element-id", "element", "key-id", "key", "value-id", "value")


def _type_names(j: JsonArrays, at: np.ndarray) -> pa.Array:
    """Names of the types that begin at these places: struct, list or map for nested ones, else without blanks in lower case."""
    inner = j.container(at, "{")
    while len(inner) and (deeper := j.container(np.where(inner >= 0, j.value["type"][inner], -1), "{")).max() >= 0:  # wrappers around the type
        inner = np.where(deeper >= 0, deeper, inner)
    nested = inner >= 0
    said = j.text(np.where(nested, j.value["type"][inner], at) if len(j.open) else at)
    said = pc.coalesce(pc.utf8_lower(pc.replace_substring_regex(said, r"\s", "")), pa.scalar("none"))
    fields = nested & (j.value["fields"][inner] >= 0) if len(j.open) else nested
    return pc.if_else(pa.array(fields), pa.scalar("struct"), said)


def _schema_nodes(tables: pa.Array, texts: pa.Array) -> Iterator[pa.Table]:
    """One table per level of nesting, as NODES, of metadata documents."""
    j = JsonArrays(texts, _KEYS)
    if not len(j.open):
        return
    v = j.value
    listed, _ = j.objects_in(j.container(v["schemas"][j.roots], "["))
    single = j.container(v["schema"][j.roots], "{")
    types = np.concatenate([listed, single[single >= 0]])
    sid = _ids(j.text(v["schema-id"][types]))
    sid = pc.if_else(pa.array(v["schema-id"][types] < 0), pa.scalar(0, pa.int32()), sid)
    known = np.asarray(pc.is_valid(sid))
    types, sid = types[known], sid.filter(pa.array(known))
    table, parent = pc.take(tables, pa.array(j.row[types])), pa.array(np.zeros(len(types), np.int32))
    while len(types):
        wrapped = j.container(v["type"][types], "{")
        kind = pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(j.text(v["type"][types]), "")))
        is_list, is_map = (np.asarray(pc.equal(kind, k)) & (wrapped < 0) for k in ("list", "map"))
        other = ~is_list & ~is_map & (wrapped < 0)
        members, of = j.objects_in(np.where(other, j.container(v["fields"][types], "["), -1))
        w, li, m = np.flatnonzero(wrapped >= 0), np.flatnonzero(is_list), np.flatnonzero(is_map)
        of = np.concatenate([of, w, li, m, m])  # whose child each is: the keys follow by take
        none = np.full(len(w), -1, np.int64)
        ids = _ids(j.text(np.concatenate([v["id"][members], none, v["element-id"][types[li]], v["key-id"][types[m]], v["value-id"][types[m]]])))
        fixed = pa.array(["element"] * len(li) + ["key"] * len(m) + ["value"] * len(m), pa.string())
        name = pa.concat_arrays([j.text(v["name"][members]), pa.nulls(len(w), pa.string()), fixed])
        at = np.concatenate([v["type"][members], v["type"][types[w]], v["element"][types[li]], v["key"][types[m]], v["value"][types[m]]])
        of = pa.array(of)
        table, sid, parent = pc.take(table, of), pc.take(sid, of), pc.take(parent, of)
        t = pa.table([table, sid, ids, parent, name, _type_names(j, at)], names=NODES.names)
        yield t.filter(pc.is_valid(ids))
        inner = j.container(at, "{")
        deeper = pa.array(inner >= 0)
        # a node without an id of its own passes the id around it to its children
        table, sid, parent, types = table.filter(deeper), sid.filter(deeper), pc.coalesce(ids, parent).filter(deeper), inner[inner >= 0]


def _decoded(x: object) -> object:
    x = plain(x)
    return {k: _decoded(y) for k, y in x.items()} if isinstance(x, dict) else [_decoded(y) for y in x] if isinstance(x, list) else x


def flatten_schemas(metadata: DataFrame, table_col: str = "table_name", json_col: str = "metadata", columns: list[str] | None = None) -> DataFrame:
    """Every node with an id of every schema: table_name, schema_id, field_id, parent_field_id (0 at the top), name, type.

    Rows are distinct, over ``columns`` if given. Texts are taken in pieces of
    ``CHUNK_BYTES``, as they stand in the Arrow buffer; a document in which objects were
    written as JSON text inside a string is decoded first, the only ones to be parsed.

    Defined cases: text that is null or no JSON object holds no schema; ids given as text
    count as numbers; a schema without an id has 0; nodes without a usable id give no row,
    their children hang from the next node around them; a null table name stays null; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables, texts = pc.cast(b.column(0), pa.string()), pc.cast(b.column(1), pa.string())
            coded = pc.match_substring_regex(texts, r'"\s*[\[{]')
            if pc.any(coded).as_py():
                texts = pc.replace_with_mask(texts, coded, pa.array([json.dumps(_decoded(json.loads(x))) for x in texts.filter(coded).to_pylist()], pa.string()))
            size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
            cuts = np.searchsorted(size, np.arange(0, (size[-1] if len(size) else 0) + CHUNK_BYTES, CHUNK_BYTES), side="right")
            for first, last in zip([0, *cuts], [*cuts, len(size)]):
                if first < last:
                    levels = [*_schema_nodes(tables.slice(first, last - first), texts.slice(first, last - first))]
                    if levels:
                        t = pa.concat_tables(levels).group_by(NODES.names).aggregate([])  # repeats within the piece
                        yield from t.select(NODES.names).to_batches()

    text = F.col(json_col).cast("string")
    two = metadata.select(F.col(table_col).cast("string"), text.alias("doc")).filter(F.json_object_keys("doc").isNotNull())
    return two.mapInArrow(run, NODES).select(columns or NODES.names).distinct()


def _list_paths(t: T.DataType, at: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of all arrays of structs inside a type, outermost first."""
    if isinstance(t, T.StructType):
        return [p for f in t for p in _list_paths(f.dataType, (*at, f.name))]
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        return [at, *_list_paths(t.elementType, at)]
    return []


def _scalars(t: T.StructType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Leaves of a struct, with the fields of inner structs; arrays of structs are tables of their own."""
    out = []
    for f in t:
        if isinstance(f.dataType, T.StructType):
            out += _scalars(f.dataType, (*at, f.name))
        elif not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
            out.append(((*at, f.name), f.dataType))
    return out


def flatten_records(df: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Related flat tables of records with nested columns.

    Returns one table per array of structs (its name is the dotted path) and ``""`` for
    the records themselves. Each row carries the record's ``keys`` and ``_pos``, the
    positions (from 0) in the arrays around it, outermost first; a child's parent is the
    row of the enclosing table whose ``_pos`` is the same without its last entry. Fields
    of inner structs become columns named by their dotted path.

    Defined cases: a null or empty array gives no child rows; a null struct gives null
    columns; a null element of an array gives a row of nulls; a nested field that has the
    name of a key is kept as ``path.name``, never merged with it.
    """
    body = T.StructType([f for f in df.schema if f.name not in keys])
    key_fields = [df.schema[k] for k in keys]
    top = [F.col("`" + "`.`".join(p) + "`").alias(".".join(p)) for p, _ in _scalars(body)]
    out = {"": df.select(*[F.col(f"`{k}`") for k in keys], *top)}
    for path in _list_paths(body):
        out[".".join(path)] = _child_table(df, body, key_fields, path)
    return out


def _child_table(df: DataFrame, body: T.StructType, key_fields: list[T.StructField], path: tuple[str, ...]) -> DataFrame:
    t: T.DataType = body
    for name in path:
        t = t.elementType if isinstance(t, T.ArrayType) else t
        t = t[name].dataType
    leaves = _scalars(t.elementType)
    fields = [*key_fields, T.StructField("_pos", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(".".join((*path, *p)), kind) for p, kind in leaves]
    schema = T.StructType(fields)
    n_keys = len(key_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, arr, pos = list(b.columns[:n_keys]), b.column(n_keys), []
            for name in path[1:] + ("",):
                while pa.types.is_struct(arr.type) and name:
                    arr, name = _field(arr, name), ""
                if not pa.types.is_list(arr.type):
                    continue
                of = pc.list_parent_indices(arr)
                starts = pc.take(pc.subtract(arr.offsets.slice(0, len(arr)), arr.offsets[0]), of)
                arr = pc.list_flatten(arr)
                nth = pc.subtract(pa.array(range(len(arr)), pa.int32()), starts)
                keys, pos = [pc.take(k, of) for k in keys], [*[pc.take(p, of) for p in pos], nth]
                if name:
                    arr = _field(arr, name)
            n = len(arr)
            width = len(pos)
            inner = pa.array([x for row in zip(*[p.to_pylist() for p in pos]) for x in row], pa.int32())
            positions = pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * width, width), pa.int32()), inner)
            cols = []
            for p, _ in leaves:
                x = arr
                for name in p:
                    x = _field(x, name)
                cols.append(x)
            yield pa.RecordBatch.from_arrays([*keys, positions, *cols], schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in key_fields], F.col(f"`{path[0]}`")).mapInArrow(run, schema)


def _field(arr: pa.Array, name: str) -> pa.Array:
    """A field of a struct array, null where the struct is null."""
    return pc.struct_field(arr, [arr.type.get_field_index(name)])
