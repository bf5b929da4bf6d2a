import math
import struct
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import boxes, geo
from lakeloom.functions import geometry as G

W = G.from_wkt
SQ, SHIFTED, INNER, BESIDE, FAR, CORNER = (W(f"POLYGON(({x}))") for x in ("0 0,4 0,4 4,0 4,0 0", "2 2,6 2,6 6,2 6,2 2", "1 1,2 1,2 2,1 2,1 1", "4 0,8 0,8 4,4 4,4 0", "10 10,11 10,11 11,10 10", "0 0,2 0,2 2,0 2,0 0"))
RING = W("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1))")


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (G.intersects, SQ, SHIFTED, True), (G.intersects, SQ, FAR, False), (G.intersects, RING, W("POINT(4 4)"), False), (G.overlaps, SQ, SHIFTED, True), (G.overlaps, SQ, INNER, False), (G.contains, SQ, INNER, True), (G.contains, INNER, SQ, False),
        (G.contains, SQ, CORNER, True), (G.contains_properly, SQ, CORNER, False), (G.contains_properly, SQ, INNER, True), (G.touches, SQ, BESIDE, True), (G.touches, SQ, SHIFTED, False), (G.touches, SQ, W("POINT(0 2)"), True), (G.contains, SQ, W("POINT(0 2)"), False),
        (G.covers, SQ, W("LINESTRING(0 0,4 0)"), True), (G.contains, SQ, W("LINESTRING(0 0,4 0)"), False), (G.crosses, W("LINESTRING(-1 2,5 2)"), SQ, True), (G.crosses, W("LINESTRING(1 1,3 3)"), SQ, False), (G.crosses, W("LINESTRING(0 0,2 2)"), W("LINESTRING(0 2,2 0)"), True),
        (G.equals, SQ, W("POLYGON((4 4,0 4,0 0,4 0,4 4))"), True), (G.equals, SQ, SHIFTED, False), (G.equals, W("POINT EMPTY"), W("LINESTRING EMPTY"), True), (G.overlaps, W("LINESTRING(0 0,2 0)"), W("LINESTRING(1 0,3 0)"), True), (G.contains, RING, W("POINT(0.5 5)"), True),
    ],
)
def test_relations(f, a, b, want):
    assert f(a, b) is want


@pytest.mark.parametrize("text", ["POINT (1 2)", "POINT EMPTY", "LINESTRING (0 0, 1.5 -2)", "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.2 0.1, 0.3 0.1, 0.3 0.2, 0.2 0.1))", "MULTIPOINT (1 2, 3 4)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT Z (1 2 3)"])
def test_round_trips(text):
    g = W(text)
    assert G.to_wkt(G.from_wkb(G.to_wkb(g))) == text and (text == "POINT EMPTY" or G.from_geojson(G.to_geojson(g)) == g)


def test_measures():
    assert (G.area(RING), G.perimeter(RING), G.length(W("LINESTRING(0 0,3 4)"))) == (32.0, 64.0, 5.0)
    assert G.centroid(SQ)[1] == (2.0, 2.0) and G.shortest(SQ, FAR)[0] == math.dist((4, 4), (10, 10)) and G.shortest(SQ, INNER)[0] == 0 and G.shortest(W("POINT EMPTY"), SQ) is None
    assert G.to_wkt(G.convex_hull(W("MULTIPOINT(0 0,2 0,1 1,2 2,0 2)"))) == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    assert G.simplify([(0, 0), (1, 0.01), (2, 0)], 0.1) == [(0, 0), (2, 0)]
    assert not G.is_simple(W("LINESTRING(0 0,2 2,2 0,0 2)")) and G.is_valid(RING) and not G.is_valid(W("POLYGON((0 0,2 2,2 0,0 2,0 0))"))
    assert G.locate(G.inner_point(RING), RING) == "I"


def test_on_the_ellipsoid():
    # Fixed value: one degree of longitude along the equator is the major axis times pi / 180.
    assert math.isclose(G.spheroid_distance((0, 0), (1, 0)), 6378137 * math.pi / 180, rel_tol=1e-9)
    assert math.isclose(G.spheroid_distance((0, 0), (0, 90)), 10001965.729, rel_tol=1e-9)
    assert math.isclose(G.spheroid_area(W("POLYGON((-180 -90,180 -90,180 90,-180 90,-180 -90))")), 5.10065621724e14, rel_tol=1e-6)


def test_columns_with_nulls(spark):
    df = spark.createDataFrame([("POINT(1 2)",), (None,), ("LINESTRING(0 0,2 0)",)], "w string").withColumn("g", geo.st_geomfromtext("w"))
    got = df.select(geo.st_x("g"), geo.st_length("g"), geo.geometrytype("g"), geo.st_astext(geo.st_buffer("g", 1.0, 1)), geo.st_srid("g")).collect()
    assert [r[0] for r in got] == [1.0, None, None] and [r[2] for r in got] == ["POINT", None, "LINESTRING"] and got[1][3] is None and got[0][4] == 0
    e = spark.createDataFrame([(1,)], "i int").select(geo.st_astext(geo.st_intersection(geo.st_makeenvelope(0.0, 0.0, 2.0, 2.0), geo.st_makeenvelope(1.0, 1.0, 3.0, 3.0))).alias("w")).first()[0]
    assert G.area(W(e)) == 1.0


def _polygon(draw_points):
    hull = G.convex_hull(("MultiPoint", [("Point", p) for p in draw_points]))
    return hull if hull[0] == "Polygon" else None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=7), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=7), st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=5))
def test_areas_of_overlays(x, y, z):
    a, b, c = _polygon(x), _polygon(y), _polygon(z)
    if not (a and b and c):
        return
    u, i, d = (G.combine(a, b, h) for h in ("union", "intersection", "difference"))
    assert math.isclose(G.area(u), G.area(a) + G.area(b) - G.area(i), abs_tol=1e-6)
    assert math.isclose(G.area(d), G.area(a) - G.area(i), abs_tol=1e-6)
    assert math.isclose(G.area(G.combine(u, c, "intersection")) + G.area(G.combine(u, c, "difference")), G.area(u), abs_tol=1e-5)


def test_overlays_of_other_kinds(spark):
    assert G.to_wkt(G.combine(W("LINESTRING(-1 2,5 2)"), SQ, "intersection")) == "LINESTRING (0 2, 4 2)"
    assert G.to_wkt(G.combine(W("LINESTRING(-1 2,5 2)"), SQ, "difference")) == "MULTILINESTRING ((-1 2, 0 2), (4 2, 5 2))"
    assert G.to_wkt(G.combine(W("MULTIPOINT(1 1,9 9)"), SQ, "intersection")) == "POINT (1 1)" and G.combine(SQ, FAR, "intersection") == ("Polygon", [])
    assert G.to_wkt(G.normalized(G.combine(SQ, INNER, "difference"))) == "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    assert G.to_wkt(G.normalized(G.combine(SQ, BESIDE, "union"))) == "POLYGON ((0 0, 0 4, 4 4, 8 4, 8 0, 4 0, 0 0))"
    assert G.to_wkt(G.merged_lines(W("MULTILINESTRING((0 0,1 1),(2 2,1 1),(5 5,6 6))"))).startswith("MULTILINESTRING")
    df = spark.createDataFrame([("a", "POLYGON((0 0,1 0,1 1,0 1,0 0))"), ("a", "POLYGON((1 0,2 0,2 1,1 1,1 0))"), ("a", None), ("b", None)], "k string, w string").withColumn("g", geo.st_geomfromtext("w"))
    got = {r["k"]: r["a"] for r in geo.union_agg(df, ["k"], "g").select("k", geo.st_area("g").alias("a")).collect()}
    assert got == {"a": 2.0, "b": None}


def test_buffers_and_simplification(spark):
    row = spark.createDataFrame([("POINT(0 0)", "LINESTRING(0 0,10 0)", "POLYGON((0 0,4 0,4 4,2 1,0 4,0 0))")], "p string, l string, c string")
    a = row.select(*[geo.st_area(geo.st_buffer(geo.st_geomfromtext(x), 1.0, 64)).alias(x) for x in "plc"], geo.st_area(geo.st_simplifypreservetopology(geo.st_geomfromtext("c"), 50.0)).alias("s")).first()
    assert math.isclose(a["p"], math.pi, rel_tol=1e-3) and math.isclose(a["l"], 20 + math.pi, rel_tol=1e-3) and a["c"] > 10 + 4 * 3 and a["s"] > 0


def test_spatial_join_of_many_boxes(spark):
    """Three million pairs of boxes that lie in one place: no pair of boxes may go to Python."""
    box = lambda: geo.st_makeenvelope(F.lit(1.0), F.lit(1.0), F.lit(2.0) + F.col("id") % 2, F.lit(2.0))
    a, b = spark.range(3000).select(F.col("id").alias("i"), box().alias("ga")), spark.range(1000).select(F.col("id").alias("j"), box().alias("gb"))
    began = time.monotonic()
    assert geo.spatial_join(a, b, "ga", "gb", geo.st_intersects, 10.0).count() == 3_000_000 and time.monotonic() - began < 60


def test_spatial_join_of_all_kinds(spark):
    texts = ["POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((2 2,4 2,4 4,2 4,2 2))", "POLYGON((0 0,9 0,9 9,0 0))", "POLYGON((5 5,5 5,5 8,5 8,5 5))", "POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,8 1,8 8,1 8,1 1))", "POINT(2 2)", "POINT(7 3)", "POINT Z (1 1 5)", "POINT EMPTY", "LINESTRING(0 5,9 5)", "LINESTRING(0 9,1 4)", "MULTIPOINT(1 1,7 1)", "POLYGON EMPTY"]
    shapes = [(i, G.to_wkb(W(t))) for i, t in enumerate(texts)] + [(len(texts), None)]
    a, b = spark.createDataFrame(shapes, "i int, ga binary"), spark.createDataFrame(shapes, "j int, gb binary")
    for f, rule in ((geo.st_intersects, G.intersects), (geo.st_contains, G.contains), (geo.bbox_intersects, geo._boxes)):
        got = [(r["i"], r["j"]) for r in geo.spatial_join(a, b, "ga", "gb", f, 4.0).collect()]
        want = [(i, j) for i, g in enumerate(texts) for j, h in enumerate(texts) if rule(W(g), W(h))]
        assert sorted(got) == want and want


def test_bounds_of_columns():
    ring = lambda *p: G.to_wkb(("Polygon", [list(p)]))
    big = struct.pack(">BIII10d", 0, 3, 1, 5, 0, 0, 0, 1, 1, 1, 1, 0, 0, 0)
    col = [ring((0, 0), (0, 1), (2, 1), (2, 0), (0, 0)), None, ring((2, 1), (0, 1), (0, 0), (2, 0), (2, 1)), ring((0, 0), (2, 1), (2, 0), (0, 1), (0, 0)), ring((0, 0), (0, 0), (2, 0), (2, 0), (0, 0)), ring((0, 0), (1, 0), (2, 0), (1, 0), (0, 0)), ring((0, 0), (0, 1), (2, 1), (2, 0), (0, 0.5)), ring((0, 0), (0, 1), (math.nan, 1), (2, 0), (0, 0)), big, G.to_wkb(W("POINT(3 4)")), G.to_wkb(W("POINT EMPTY"))]
    for at in (0, 2):
        done, got = boxes.bounds(pa.array(col, pa.binary())[at:])
        assert [i + at for i, d in enumerate(done) if d] == [i for i in (0, 2, 9) if i >= at]
        assert all(tuple(got[i].as_py()[n] for n in ("x0", "y0", "x1", "y1")) == G.bbox(G.from_wkb(col[i + at])) for i, d in enumerate(done) if d)
    done, got = boxes.made(*(pa.array(v) for v in ([0, None, 2], [0.0, 0.0, math.nan], [2.0, 1.0, 1.0], [1, 1, 1])))
    assert done.tolist() == [True, False, False] and got[0].as_py() == G.to_wkb(G.rectangle(0.0, 0.0, 2.0, 1.0))
    assert not boxes.bounds(pa.array([], pa.binary()))[0].size


NUMBERS = st.sampled_from([0.0, 1.0, 2.0, 3.0, 4.0, 2.0 + 1e-13, 2.0 + 1e-9, 2.0 - 3e-10, 2.0 + 1e-6, -1e6, 1e6])
SHAPES = st.one_of(
    st.tuples(NUMBERS, NUMBERS, NUMBERS, NUMBERS).map(lambda v: G.rectangle(*v)), st.tuples(NUMBERS, NUMBERS, NUMBERS).map(lambda v: ("LineString", [v[:2], (v[0], v[2])])), st.tuples(NUMBERS, NUMBERS, NUMBERS).map(lambda v: ("LineString", [v[:2], (v[2], v[1])])),
    st.tuples(NUMBERS, NUMBERS).map(lambda v: ("Point", v)), st.just(W("POLYGON((0 0,4 0,4 4,0 0))")),
)
RULES = [
    (boxes.related(boxes.meet), G.intersects), (boxes.related(boxes.cover), G.contains), (boxes.related(boxes.cover), G.covers), (boxes.related(boxes.cover_inside), G.contains_properly), (boxes.related(boxes.overlap), G.overlaps), (boxes.crosses, G.crosses),
    (boxes.related(lambda a, b: boxes.meet(a, b) & ~boxes.inside_meet(a, b)), G.touches), (boxes.related(lambda a, b: boxes.cover(a, b) & boxes.cover(b, a)), G.equals),
]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(SHAPES, SHAPES, st.sampled_from([0.0, 0.5, 1.0, 2.0])), min_size=1, max_size=6))
def test_relations_of_boxes_are_those_of_the_kernel(rows):
    a, b = (pa.array([G.to_wkb(r[i]) for r in rows], pa.binary()) for i in (0, 1))
    for quick, rule in RULES:
        done, got = quick(a, b)
        assert [got[i].as_py() for i in range(len(rows)) if done[i]] == [rule(*r[:2]) for r, d in zip(rows, done) if d]
    done, got = boxes.within_distance(a, b, pa.array([r[2] for r in rows]))
    assert [got[i].as_py() for i in range(len(rows)) if done[i]] == [G.shortest(*r[:2])[0] <= r[2] for r, d in zip(rows, done) if d]


def test_relations_of_many_boxes(spark):
    """Two hundred thousand pairs, all different: those of boxes and lines along the axes may not go to the kernel one by one."""
    x = F.col("id") * 37 % 200_000 / 4000.0
    df = spark.range(200_000).select(x.alias("x"), geo.st_makeenvelope(0.0, 0.0, 30.0, 10.0).alias("a"), geo.st_makeenvelope(x, F.lit(4.0), x + 2, F.lit(5.0)).alias("b"), geo.st_geomfromtext(F.concat(F.lit("LINESTRING("), x.cast("string"), F.lit(" 5,"), (x + 2).cast("string"), F.lit(" 5)"))).alias("l"))
    rows = df.select("x", geo.st_contains("a", "b").alias("c"), geo.st_containsproperly("a", "b").alias("p"), geo.st_coveredby("b", "a").alias("d"), geo.st_overlaps("a", "b").alias("o"), geo.st_crosses("l", "a").alias("s"), geo.st_dwithin("a", "b", 5.0).alias("n"))
    began = time.monotonic()
    right = (F.col("c") == (F.col("x") <= 28)) & (F.col("p") == ((F.col("x") > 0) & (F.col("x") < 28))) & (F.col("d") == F.col("c")) & (F.col("o") == ((F.col("x") > 28) & (F.col("x") < 30))) & (F.col("s") == F.col("o")) & (F.col("n") == (F.col("x") <= 35))
    assert rows.filter(right).count() == 200_000 and time.monotonic() - began < 45
