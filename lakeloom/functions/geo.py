"""Spatial functions on WKB columns.

Geometries are WKB in binary columns. Functions run as Arrow-batched Python functions;
points from coordinates and bounding boxes of joins stay on grid cells, so that a spatial
join is an equi-join on cells with an exact test of what meets there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import boxes
from lakeloom.functions import geometry as G
from lakeloom.shared import materialize


#: Arrow types of results.
_ARROW = {"binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "smallint": pa.int16(), "boolean": pa.bool_(), "struct<x0:double,y0:double,x1:double,y1:double,box:boolean>": boxes.BOUNDS}


def _distinct(cols: tuple[pa.Array, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each combination of values, and each row's combination."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        c = c.view(pa.int64()) if pa.types.is_float64(c.type) else c
        e = c.dictionary_encode()
        code = code * (len(e.dictionary) + 1) + e.indices.cast(pa.int64()).fill_null(len(e.dictionary)).to_numpy()
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code


def _udf(f: Callable, kind: str, inputs: int, optional: int = 0, quick: Callable | None = None):
    """A function of geometries and values; null in, null out.

    ``quick`` judges what rows of a batch it can, all at once; ``f`` is called for each
    combination of values among the others.
    """

    def by_row(cols: tuple[pa.Array, ...]) -> pa.Array:
        if any(c.null_count == len(c) for c in cols):
            return pa.nulls(len(cols[0]), _ARROW[kind])
        first, back = _distinct(cols)
        out = []
        for row in zip(*(c.take(pa.array(first)).to_pylist() for c in cols)):
            if any(v is None or (isinstance(v, float) and v != v) for v in row):
                out.append(None)
                continue
            out.append(f(*[G.from_wkb(v) if isinstance(v, bytes) else v for v in row]))
        return pa.array(out, _ARROW[kind]).take(pa.array(back))

    def call(*cols: pa.Array) -> pa.Array:
        if quick is None:
            return by_row(cols)
        done, known = quick(*cols)
        if done.all():
            return known
        rest = pa.array(np.flatnonzero(~done))
        return pc.if_else(pa.array(done), known, by_row(tuple(c.take(rest) for c in cols)).take(pa.array(np.cumsum(~done) - 1, mask=done)))

    def run(*args: object) -> Column:
        cols = [a if isinstance(a, Column) else F.col(a) if isinstance(a, str) else F.lit(a) for a in args]
        if not inputs <= len(cols) <= inputs + optional:
            raise TypeError(f"takes {inputs} to {inputs + optional} arguments, not {len(cols)}")
        shapes = {1: _one, 2: _two, 3: _three, 4: _four, 5: _five}
        return F.arrow_udf(shapes[len(cols)](call), kind)(*cols)

    return run


def _hints(run, names: tuple[str, ...]):
    run.__annotations__ = {n: pa.Array for n in names} | {"return": pa.Array}
    return run


def _one(f):
    def run(a):
        return f(a)

    return _hints(run, ("a",))


def _two(f):
    def run(a, b):
        return f(a, b)

    return _hints(run, ("a", "b"))


def _three(f):
    def run(a, b, c):
        return f(a, b, c)

    return _hints(run, ("a", "b", "c"))


def _four(f):
    def run(a, b, c, d):
        return f(a, b, c, d)

    return _hints(run, ("a", "b", "c", "d"))


def _five(f):
    def run(a, b, c, d, e):
        return f(a, b, c, d, e)

    return _hints(run, ("a", "b", "c", "d", "e"))


def _wkb(f: Callable) -> Callable:
    def run(*args):
        g = f(*args)
        return None if g is None else G.to_wkb(g)

    return run


def _of_kind(kind: str, f: Callable) -> Callable:
    return lambda g, *a: f(g, *a) if g[0] == kind else None


def _point_n(g, n: int):
    n = int(n)
    d = g[1]
    i = n - 1 if n > 0 else len(d) + n
    return ("Point", d[i]) if n and 0 <= i < len(d) else None


def _unrepeated(tolerance: float):
    def run(r: list[tuple]) -> list[tuple]:
        out = r[:1]
        for p in r[1:]:
            if math.dist(p[:2], out[-1][:2]) > tolerance:
                out.append(p)
        return out if len(out) > 1 else r[:1] + r[-1:]

    return run


def _simplified(g, tolerance: float):
    out = G.reshaped(g, lambda r: G.simplify(r, tolerance))
    if out[0] == "Polygon":
        rings = [r for r in out[1] if len(r) >= 4]
        return ("Polygon", rings)
    return out


def _extract(g, kind: int = 0):
    ps = G.parts(g)
    want = {0: G.dimension(g), 1: 0, 2: 1, 3: 2}[int(kind)]
    mine = [p for p in ps if G.dimension(p) == want]
    return mine[0] if len(mine) == 1 and not g[0].startswith(("Multi", "Geom")) else ("Multi" + G.KINDS[want], mine)


def _boundary(g):
    if G.dimension(g) == 2:
        rings = [("LineString", r) for r in G.runs(g)]
        return rings[0] if len(rings) == 1 else ("MultiLineString", rings)
    return ("MultiPoint", [("Point", p) for p in sorted(G._line_ends(g))])


def _buffer(g, radius: float, quads: int = 8):
    """All that lies within ``radius``: circles around points and their hulls along edges, united; a circle has 4 * ``quads`` corners."""
    if radius <= 0 or G.is_empty(g):
        return ("Polygon", [])
    n = 4 * int(quads)
    circle = lambda p: [(p[0] + radius * math.cos(2 * math.pi * i / n), p[1] + radius * math.sin(2 * math.pi * i / n)) for i in range(n)]
    hull = lambda ps: G.convex_hull(("MultiPoint", [("Point", q) for p in ps for q in circle(p)]))
    out = None
    lone = [[d] for k, d in G.parts(g) if k == "Point" and d is not None]
    for shape in [hull(ps) for ps in [*lone, *G.segments(g)]] + [("Polygon", d) for k, d in G.parts(g) if k == "Polygon"]:
        out = shape if out is None else G.overlay(out, shape, "union")
    return out


def _simplified_valid(g, tolerance: float):
    """Simplified as far as it stays valid."""
    for _ in range(60):
        out = G.reshaped(g, lambda r: s if len(s := G.simplify(r, tolerance)) >= (4 if r[0] == r[-1] else 2) else r)
        if G.is_valid(out):
            return out
        tolerance /= 2
    return g


def _transform(g, source: str, target: str):
    known = {"EPSG:4326": "deg", "OGC:CRS84": "deg", "EPSG:3857": "merc"}
    a, b = known.get(source.upper()), known.get(target.upper())
    if not a or not b:
        raise NotImplementedError(f"transform from {source} to {target}")
    return g if a == b else G.mapped(g, lambda p: G.web_mercator(p, a == "merc"))


def _loops(ring: list) -> list[list]:
    """The simple loops of a ring, which is cut wherever it meets itself."""
    sides = [(p[:2], q[:2]) for p, q in zip(ring, ring[1:]) if p[:2] != q[:2]]
    walk, out = [], []
    for p, q in sides:
        cuts = {e for piece in G._cut([(p, q)], [s for s in sides if s != (p, q)]) for e in piece}
        for v in sorted(cuts - {q}, key=lambda e: (e[0] - p[0]) ** 2 + (e[1] - p[1]) ** 2):
            if v in walk:
                out.append([*walk[walk.index(v) :], v])
                walk = walk[: walk.index(v)]
            walk.append(v)
    out.append([*walk, walk[0]] if walk else [])
    return [r for r in out if len(r) > 3]


def _made_valid(g):
    """A valid geometry as it is; of another surface, the area that an odd number of its loops goes round."""
    if G.is_valid(g) or g[0] not in ("Polygon", "MultiPolygon"):
        return g
    done = ("Polygon", [])
    for _, rings in G.parts(g):
        for loop in (x for r in rings for x in _loops(r)):
            one = ("Polygon", [loop])
            done = one if G.is_empty(done) else G.combine(G.combine(done, one, "difference"), G.combine(one, done, "difference"), "union")
    return done


# Input and output
st_geomfromtext = _udf(lambda t: G.to_wkb(G.from_wkt(t)), "binary", 1)
st_geometryfromtext = st_geomfromtext
st_geomfromgeojson = _udf(lambda t: G.to_wkb(G.from_geojson(t)), "binary", 1)
st_geomfromwkb = _udf(_wkb(lambda g: g), "binary", 1)
st_astext = _udf(G.to_wkt, "string", 1)
st_asgeojson = _udf(lambda g, digits=9, *_: G.to_geojson(g, int(digits)), "string", 1, 2)
st_asbinary = st_geomfromwkb
bytea = st_geomfromwkb
geography = st_geomfromwkb
st_point = _udf(lambda x, y: G.to_wkb(("Point", (x, y))), "binary", 2)
st_makeenvelope = _udf(lambda a, b, c, d, *_: G.to_wkb(G.rectangle(a, b, c, d)), "binary", 4, 1, boxes.made)
# Parts
geometrytype = _udf(lambda g: g[0].upper(), "string", 1)
st_dimension = _udf(G.dimension, "int", 1)
st_x = _udf(_of_kind("Point", lambda g: g[1] and g[1][0]), "double", 1)
st_y = _udf(_of_kind("Point", lambda g: g[1] and g[1][1]), "double", 1)
st_z = _udf(_of_kind("Point", lambda g: g[1][2] if g[1] and len(g[1]) > 2 else None), "double", 1)
st_m = _udf(lambda g: None, "double", 1)
st_srid = _udf(lambda g: 0, "int", 1)
st_zmflag = _udf(lambda g: 2 if G._has_z(g) else 0, "smallint", 1)
st_npoints = _udf(lambda g: len(G.all_points(g)), "int", 1)
st_numpoints = _udf(_of_kind("LineString", lambda g: len(g[1])), "int", 1)
st_numgeometries = _udf(lambda g: len(g[1]) if g[0].startswith(("Multi", "Geom")) else int(not G.is_empty(g)), "int", 1)
st_numinteriorrings = _udf(_of_kind("Polygon", lambda g: max(len(g[1]) - 1, 0)), "int", 1)
st_startpoint = _udf(_wkb(_of_kind("LineString", lambda g: _point_n(g, 1))), "binary", 1)
st_endpoint = _udf(_wkb(_of_kind("LineString", lambda g: _point_n(g, -1))), "binary", 1)
st_pointn = _udf(_wkb(_of_kind("LineString", _point_n)), "binary", 2)
st_exteriorring = _udf(_wkb(_of_kind("Polygon", lambda g: ("LineString", g[1][0] if g[1] else []))), "binary", 1)
st_boundary = _udf(_wkb(_boundary), "binary", 1)
st_envelope = _udf(_wkb(G.envelope), "binary", 1)
st_collectionextract = _udf(_wkb(_extract), "binary", 1, 1)
st_isempty = _udf(G.is_empty, "boolean", 1)
st_isclosed = _udf(lambda g: all(r and r[0][:2] == r[-1][:2] for k, r in G.parts(g) if k == "LineString"), "boolean", 1)
st_isring = _udf(_of_kind("LineString", lambda g: bool(g[1]) and g[1][0][:2] == g[1][-1][:2] and G.is_simple(g)), "boolean", 1)
st_issimple = _udf(G.is_simple, "boolean", 1)
st_isvalid = _udf(G.is_valid, "boolean", 1)
# Making and changing
st_makeline = _udf(_wkb(lambda a, b: ("LineString", G.all_points(a) + G.all_points(b))), "binary", 2)
st_makepolygon = _udf(_wkb(_of_kind("LineString", lambda g: ("Polygon", [g[1]]))), "binary", 1)
st_collect = _udf(_wkb(lambda a, b: G.collected([a, b])), "binary", 2)
st_flipcoordinates = _udf(_wkb(lambda g: G.mapped(g, lambda p: (p[1], p[0], *p[2:]))), "binary", 1)
st_force2d = _udf(_wkb(lambda g: G.mapped(g, lambda p: p[:2])), "binary", 1)
st_reverse = _udf(_wkb(lambda g: G.reshaped(g, lambda r: r[::-1])), "binary", 1)
st_normalize = _udf(_wkb(G.normalized), "binary", 1)
st_reduceprecision = _udf(_wkb(lambda g, size: G.mapped(g, lambda p: tuple(round(v / size) * size for v in p))), "binary", 2)
st_removerepeatedpoints = _udf(_wkb(lambda g, tolerance=0.0: G.reshaped(g, _unrepeated(tolerance))), "binary", 1, 1)
st_simplify = _udf(_wkb(_simplified), "binary", 2)
st_simplifypreservetopology = _udf(_wkb(_simplified_valid), "binary", 2)
st_convexhull = _udf(_wkb(G.convex_hull), "binary", 1)
st_centroid = _udf(_wkb(G.centroid), "binary", 1)
st_pointonsurface = _udf(_wkb(lambda g: ("Point", G.inner_point(g))), "binary", 1)
st_buffer = _udf(_wkb(_buffer), "binary", 2, 1)
st_intersection = _udf(_wkb(lambda a, b, *_: G.combine(a, b, "intersection")), "binary", 2, 1)
st_difference = _udf(_wkb(lambda a, b, *_: G.combine(a, b, "difference")), "binary", 2, 1)
st_union = _udf(_wkb(lambda a, b: G.combine(a, b, "union")), "binary", 2)
st_makevalid = _udf(_wkb(_made_valid), "binary", 1)
st_linemerge = _udf(_wkb(lambda g, *_: G.merged_lines(g)), "binary", 1, 1)
st_transform = _udf(_wkb(_transform), "binary", 3)
postgis_transform_geometry = _udf(_wkb(lambda g, source, target, *_: _transform(g, source, target)), "binary", 3, 1)
# Measures
st_area = _udf(G.area, "double", 1)
st_length = _udf(G.length, "double", 1)
st_perimeter = _udf(G.perimeter, "double", 1)
st_distance = _udf(lambda a, b: (s := G.shortest(a, b)) and s[0], "double", 2)
st_dwithin = _udf(lambda a, b, d: (s := G.shortest(a, b)) is not None and s[0] <= d, "boolean", 3, 0, boxes.within_distance)
st_shortestline = _udf(_wkb(lambda a, b: (s := G.shortest(a, b)) and ("LineString", [s[1], s[2]])), "binary", 2)
st_area_spheroid = _udf(G.spheroid_area, "double", 1)
st_length_spheroid = _udf(G.spheroid_length, "double", 1)
st_perimeter_spheroid = _udf(lambda g: G.spheroid_length(g, rings=True), "double", 1)
st_distance_spheroid = _udf(lambda a, b: G.spheroid_distance(a[1], b[1]) if a[0] == b[0] == "Point" else None, "double", 2)
# Relations
st_intersects = _udf(G.intersects, "boolean", 2, 0, boxes.related(boxes.meet))
st_disjoint = _udf(lambda a, b: not G.intersects(a, b), "boolean", 2, 0, boxes.related(lambda a, b: ~boxes.meet(a, b)))
st_contains = _udf(G.contains, "boolean", 2, 0, boxes.related(boxes.cover))
st_containsproperly = _udf(G.contains_properly, "boolean", 2, 0, boxes.related(boxes.cover_inside))
st_within = _udf(lambda a, b: G.contains(b, a), "boolean", 2, 0, boxes.related(lambda a, b: boxes.cover(b, a)))
st_covers = _udf(G.covers, "boolean", 2, 0, boxes.related(boxes.cover))
st_coveredby = _udf(lambda a, b: G.covers(b, a), "boolean", 2, 0, boxes.related(lambda a, b: boxes.cover(b, a)))
st_crosses = _udf(G.crosses, "boolean", 2, 0, boxes.crosses)
st_overlaps = _udf(G.overlaps, "boolean", 2, 0, boxes.related(boxes.overlap))
st_touches = _udf(G.touches, "boolean", 2, 0, boxes.related(lambda a, b: boxes.meet(a, b) & ~boxes.inside_meet(a, b)))
st_equals = _udf(G.equals, "boolean", 2, 0, boxes.related(lambda a, b: boxes.cover(a, b) & boxes.cover(b, a)))


def _boxes(a, b) -> bool:
    x, y = G.bbox(a), G.bbox(b)
    return bool(x and y) and x[0] <= y[2] and y[0] <= x[2] and x[1] <= y[3] and y[1] <= x[3]


bbox_intersects = _udf(_boxes, "boolean", 2)
#: Corners of the bounding box, null for an empty geometry, and whether the geometry is a box or a point, i.e. all of what its corners span.
_bounds = _udf(lambda g: (b := G.bbox(g)) and {**dict(zip(("x0", "y0", "x1", "y1"), b)), "box": False}, "struct<x0:double,y0:double,x1:double,y1:double,box:boolean>", 1, 0, boxes.bounds)


def union_agg(df: DataFrame, group: list[str], geom: str, salts: int = 16) -> DataFrame:
    """``ST_Union`` as an aggregate: ``group`` columns and ``geom``, null where a group has no geometry.

    Each group is united in ``salts`` parts first, so a hot group is no single task's work.
    """

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for w in pdf["_g"]:
            if w is not None:
                g = G.from_wkb(bytes(w))
                out = g if out is None else G.combine(out, g, "union")
        row = pdf.iloc[[0]][[c for c in pdf.columns if c != "_g"]].copy()
        row["_g"] = [None if out is None else G.to_wkb(out)]
        return row

    src = df.select(*group, F.col(geom).alias("_g")).withColumn("_salt", F.pmod(F.xxhash64("_g"), F.lit(salts)))
    part = src.groupBy(*group, "_salt").applyInPandas(unite, src.select(*group, "_salt", "_g").schema).drop("_salt")
    return part.groupBy(*group).applyInPandas(unite, part.schema).withColumnRenamed("_g", geom)


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: Callable[[Column, Column], Column], cell: float) -> DataFrame:
    """Pairs for which ``predicate(left, right)`` holds, which must imply that bounding boxes meet.

    Both sides are put into the grid cells (of side ``cell``) that their boxes touch and
    meet in an equi-join; a pair is tested in the one cell where the lower left corner of
    the boxes' intersection lies, so no pair comes twice. For ``st_intersects``, pairs of
    boxes or points are settled by that; only pairs with another geometry go to Python.
    Column names of the two sides must differ.
    """

    def bounded(df: DataFrame, geom: str, p: str) -> DataFrame:
        return df.withColumn(f"_{p}b", _bounds(F.col(geom)))

    def gridded(df: DataFrame, p: str) -> DataFrame:
        b = F.col(f"_{p}b")
        for axis in "xy":
            df = df.withColumn(f"_{p}{axis}", F.explode(F.sequence(F.floor(b[f"{axis}0"] / cell), F.floor(b[f"{axis}1"] / cell))))
        return df

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        j = gridded(left, "l").join(gridded(right, "r"), (F.col("_lx") == F.col("_rx")) & (F.col("_ly") == F.col("_ry")))
        lb, rb = F.col("_lb"), F.col("_rb")
        meet = (lb["x0"] <= rb["x1"]) & (rb["x0"] <= lb["x1"]) & (lb["y0"] <= rb["y1"]) & (rb["y0"] <= lb["y1"])
        mine = (F.floor(F.greatest(lb["x0"], rb["x0"]) / cell) == F.col("_lx")) & (F.floor(F.greatest(lb["y0"], rb["y0"]) / cell) == F.col("_ly"))
        return j.filter(meet & mine).drop("_lb", "_rb", "_lx", "_ly", "_rx", "_ry")

    a, b = bounded(left, left_geom, "l"), bounded(right, right_geom, "r")
    test = predicate(F.col(left_geom), F.col(right_geom))
    if predicate is not st_intersects:
        return met(a, b).filter(test)
    a, b = materialize(a, "bounds"), materialize(b, "bounds")
    la, lb = F.col("_lb")["box"], F.col("_rb")["box"]
    other = met(a.filter(la), b.filter(~lb)).unionByName(met(a.filter(~la), b))
    return met(a.filter(la), b.filter(lb)).unionByName(other.filter(test))
