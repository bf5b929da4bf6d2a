"""Queries of spatial functions, on shapes whose figures plain SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import geo
from lakeloom.registry import Registry
from lakeloom.sources.tables import table

R = Registry()


def _wkt(*parts: object) -> Column:
    """A geometry from WKT text made of constants and numeric columns."""
    return geo.st_geomfromtext(F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Shapes that grow with s_suppkey: an open line, a square with a hole, a ring, a crossing line, a bow tie."""
    a = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        a.alias("k"), _wkt("LINESTRING(0 0,", a, " 0,", a, " 1)").alias("line"), _wkt("POLYGON((0 0,", a + 3, " 0,", a + 3, " 3,0 3,0 0),(1 1,2 1,2 2,1 2,1 1))").alias("holed"),
        _wkt("LINESTRING(0 0,", a, " 0,", a, " ", a, ",0 0)").alias("ring"), _wkt("LINESTRING(0 0,2 2,2 0,0 2)").alias("crossing"), _wkt("POLYGON((0 0,2 2,2 0,0 2,0 0))").alias("bow"), _wkt("POINT Z (1 2 ", a, ")").alias("high"),
    )


@R.add(
    "geo_parts",
    "SELECT s_suppkey AS k, 1 AS line_dim, 2 AS area_dim, 3 AS points, 1 AS holes, 0.0::DOUBLE AS start_x, 1.0::DOUBLE AS end_y, s_suppkey::DOUBLE AS second_x, s_suppkey + 1.0::DOUBLE AS length, 5 AS outer_points, 2 AS ends, "
    "s_suppkey * 1.0::DOUBLE AS box, 2 AS members, s_suppkey + 1.0::DOUBLE AS extracted, s_suppkey::DOUBLE AS z, NULL::DOUBLE AS m, 0 AS srid, 2::SMALLINT AS zm FROM supplier",
)
def geo_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of geometries: dimensions, points, rings, ends, boxes, members of collections."""
    s = _shapes(spark, sf)
    both = geo.st_collect("high", "line")
    return s.select(
        "k", geo.st_dimension("line").alias("line_dim"), geo.st_dimension("holed").alias("area_dim"), geo.st_numpoints("line").alias("points"), geo.st_numinteriorrings("holed").alias("holes"), geo.st_x(geo.st_startpoint("line")).alias("start_x"),
        geo.st_y(geo.st_endpoint("line")).alias("end_y"), geo.st_x(geo.st_pointn("line", 2)).alias("second_x"), geo.st_length("line").alias("length"), geo.st_npoints(geo.st_exteriorring("holed")).alias("outer_points"),
        geo.st_numgeometries(geo.st_boundary("line")).alias("ends"), geo.st_area(geo.st_envelope("line")).alias("box"), geo.st_numgeometries(both).alias("members"), geo.st_length(geo.st_collectionextract(both, 2)).alias("extracted"),
        geo.st_z("high").alias("z"), geo.st_m("high").alias("m"), geo.st_srid("high").alias("srid"), geo.st_zmflag("high").alias("zm"),
    )


@R.add("geo_states", "SELECT s_suppkey AS k, false AS empty, true AS void, false AS line_closed, true AS ring_closed, true AS ring, false AS line_ring, true AS line_simple, false AS crossing_simple, true AS valid, false AS bow_valid, true AS mended_valid, 2.0::DOUBLE AS mended_area FROM supplier")
def geo_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of geometries: empty, closed, simple, valid; an invalid one made valid."""
    s = _shapes(spark, sf)
    return s.select(
        "k", geo.st_isempty("line").alias("empty"), geo.st_isempty(geo.st_geometryfromtext(F.lit("POLYGON EMPTY"))).alias("void"), geo.st_isclosed("line").alias("line_closed"), geo.st_isclosed("ring").alias("ring_closed"), geo.st_isring("ring").alias("ring"),
        geo.st_isring("line").alias("line_ring"), geo.st_issimple("line").alias("line_simple"), geo.st_issimple("crossing").alias("crossing_simple"), geo.st_isvalid("holed").alias("valid"), geo.st_isvalid("bow").alias("bow_valid"),
        geo.st_isvalid(geo.st_makevalid("bow")).alias("mended_valid"), F.round(geo.st_area(geo.st_makevalid("bow")), 9).alias("mended_area"),
    )


@R.add(
    "geo_making",
    "SELECT s_suppkey AS k, s_suppkey::DOUBLE AS made_length, s_suppkey * s_suppkey / 2.0::DOUBLE AS made_area, 1.0::DOUBLE AS flipped_x, 0::SMALLINT AS flat, s_suppkey::DOUBLE AS reversed_x, true AS normal, s_suppkey + 0.5::DOUBLE AS rounded_x, "
    "2 AS unrepeated, 2 AS simplified, 2 AS simplified_valid, s_suppkey * 2.0::DOUBLE AS hull, true AS inner_point, true AS round_area, 3 AS merged_points, 'LINESTRING' AS merged_kind, round((s_suppkey % 90) * 6378137 * pi() / 180, 3) AS mercator_x, round((s_suppkey % 90) * 6378137 * pi() / 180, 3) AS postgis_x, "
    "true AS binary_same, true AS bytea_same, true AS geography_same FROM supplier",
)
def geo_making(spark: SparkSession, sf: str) -> DataFrame:
    """Geometries made of others: lines, polygons, hulls, buffers, simplified, merged, transformed, and as binary."""
    s, k = _shapes(spark, sf), F.col("k").cast("double")
    zero, far, degree = geo.st_point(F.lit(0.0), F.lit(0.0)), geo.st_point(k, F.lit(1.0)), geo.st_point(k % 90, F.lit(0.0))
    round_area = geo.st_area(geo.st_buffer(zero, 1.0, 8))
    merged = geo.st_linemerge(_wkt("MULTILINESTRING((0 0,1 0),(1 0,2 1))"))
    return s.select(
        "k", geo.st_length(geo.st_makeline(zero, geo.st_point(k, F.lit(0.0)))).alias("made_length"), geo.st_area(geo.st_makepolygon("ring")).alias("made_area"), geo.st_x(geo.st_flipcoordinates(far)).alias("flipped_x"), geo.st_zmflag(geo.st_force2d("high")).alias("flat"),
        geo.st_x(geo.st_startpoint(geo.st_reverse("line"))).alias("reversed_x"), geo.st_equals(geo.st_normalize("holed"), "holed").alias("normal"), geo.st_x(geo.st_reduceprecision(geo.st_point(k + 0.4, F.lit(0.0)), 0.5)).alias("rounded_x"),
        geo.st_numpoints(geo.st_removerepeatedpoints(_wkt("LINESTRING(0 0,0 0,", F.col("k"), " 0)"))).alias("unrepeated"), geo.st_numpoints(geo.st_simplify(_wkt("LINESTRING(0 0,1 0.01,2 0)"), 0.5)).alias("simplified"),
        geo.st_numpoints(geo.st_simplifypreservetopology(_wkt("LINESTRING(0 0,1 0.01,2 0)"), 0.5)).alias("simplified_valid"), geo.st_area(geo.st_convexhull(_wkt("MULTIPOINT(0 0,", F.col("k"), " 0,", F.col("k"), " 2,0 2,0 1)"))).alias("hull"),
        geo.st_contains("holed", geo.st_pointonsurface("holed")).alias("inner_point"), ((round_area > 3.0) & (round_area < 3.1416)).alias("round_area"), geo.st_numpoints(merged).alias("merged_points"), geo.geometrytype(merged).alias("merged_kind"),
        F.round(geo.st_x(geo.st_transform(degree, F.lit("EPSG:4326"), F.lit("EPSG:3857"))), 3).alias("mercator_x"), F.round(geo.st_x(geo.postgis_transform_geometry(degree, F.lit("EPSG:4326"), F.lit("EPSG:3857"))), 3).alias("postgis_x"),
        geo.st_equals(geo.st_geomfromwkb(geo.st_asbinary("line")), "line").alias("binary_same"), geo.st_equals(geo.bytea("line"), "line").alias("bytea_same"), geo.st_equals(geo.geography("line"), "line").alias("geography_same"),
    )


@R.add(
    "geo_overlay",
    "SELECT s_suppkey AS k, greatest(3 - s_suppkey % 5, 0) * 2.0::DOUBLE AS both, 6 - greatest(3 - s_suppkey % 5, 0) * 2.0::DOUBLE AS first_only, 12 - greatest(3 - s_suppkey % 5, 0) * 2.0::DOUBLE AS together FROM supplier",
)
def geo_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, difference and union of two boxes that slide apart."""
    d = F.col("s_suppkey") % 5
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(2.0)).alias("a"), geo.st_makeenvelope(d.cast("double"), F.lit(0.0), d + 3.0, F.lit(2.0)).alias("b"))
    area = lambda g: F.round(F.coalesce(geo.st_area(g), F.lit(0.0)), 9)
    return s.select("k", area(geo.st_intersection("a", "b")).alias("both"), area(geo.st_difference("a", "b")).alias("first_only"), area(geo.st_union("a", "b")).alias("together"))


@R.add("geo_union_groups", "SELECT s_nationkey, max(s_suppkey) * 1.0::DOUBLE AS area FROM supplier GROUP BY s_nationkey")
def geo_union_groups(spark: SparkSession, sf: str) -> DataFrame:
    """ST_Union as an aggregate: nested boxes give the largest."""
    s = table(spark, sf, "supplier").select("s_nationkey", geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.col("s_suppkey").cast("double"), F.lit(1.0)).alias("g"))
    return geo.union_agg(s, ["s_nationkey"], "g").select("s_nationkey", F.round(geo.st_area("g"), 9).alias("area"))


@R.add(
    "geo_relations",
    "SELECT p_partkey AS k, p_size + 2 <= 30 AS contains, p_size + 2 < 30 AS properly, p_size + 2 <= 30 AS covered, p_size < 30 AND p_size + 2 > 30 AS overlapping, p_size < 30 AND p_size + 2 > 30 AS crossing, p_size - 30 <= 5 AS near, greatest(p_size - 30, 0)::DOUBLE AS gap FROM part",
)
def geo_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of a fixed box to small boxes and lines inside, across and beside it."""
    x = F.col("p_size").cast("double")
    p = table(spark, sf, "part").withColumns({"big": geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(10.0)), "small": geo.st_makeenvelope(x, F.lit(4.0), x + 2, F.lit(5.0)), "line": _wkt("LINESTRING(", F.col("p_size"), " 5,", F.col("p_size") + 2, " 5)")})
    return p.select(
        F.col("p_partkey").alias("k"), geo.st_contains("big", "small").alias("contains"), geo.st_containsproperly("big", "small").alias("properly"), geo.st_coveredby("small", "big").alias("covered"), geo.st_overlaps("big", "small").alias("overlapping"),
        geo.st_crosses("line", "big").alias("crossing"), geo.st_dwithin("big", "small", 5.0).alias("near"), F.coalesce(geo.st_length(geo.st_shortestline("big", "small")), F.lit(0.0)).alias("gap"),
    )
