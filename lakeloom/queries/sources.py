"""Queries of readers, writers, spatial functions and streams: written, read again and compared with the source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions import geo
from lakeloom.registry import Registry
from lakeloom.shared import fresh_path
from lakeloom.sources import io
from lakeloom.sources.tables import table
from lakeloom.streaming import ingest
from lakeloom.table.layer import Table

R = Registry()


@R.add("scan_csv_roundtrip", "SELECT * FROM customer")
def scan_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """COPY TO and FROM compressed CSV with a header, under a declared schema."""
    path = fresh_path(spark, "csv") + ".csv.gz"
    c = table(spark, sf, "customer")
    io.write(c, path, header=True)
    return io.read(spark, path, schema=c.schema, header=True, delimiter=",", quote='"')


@R.add("scan_csv_sniffed", "SELECT c_custkey::INT AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_sniffed(spark: SparkSession, sf: str) -> DataFrame:
    """CSV whose delimiter, header and types are found out."""
    path = fresh_path(spark, "csv") + ".csv"
    io.write(table(spark, sf, "customer"), path, header=True, delimiter=";")
    return io.read(spark, path)


@R.add("scan_csv_quoted_text", "SELECT item_id, text || chr(10) || '\"a,b\"' AS text FROM benchmark")
def scan_csv_quoted_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, delimiters and line breaks."""
    path = fresh_path(spark, "csv") + ".csv"
    b = table(spark, sf, "benchmark").withColumn("text", F.concat("text", F.lit('\n"a,b"')))
    io.write(b, path)
    return io.read(spark, path, schema=b.schema, header=False, delimiter=",", quote='"')


@R.add("scan_json_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def scan_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed newline-delimited JSON."""
    path = fresh_path(spark, "json") + ".json.gz"
    o = table(spark, sf, "orders")
    io.write(o, path)
    return io.read(spark, path, schema=o.schema)


@R.add("scan_json_nested", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def scan_json_nested(spark: SparkSession, sf: str) -> DataFrame:
    """JSON with inferred nested types."""
    path = fresh_path(spark, "json") + ".json"
    io.write(table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("p")), path)
    return io.read(spark, path).select("event_id", "p.k")


@R.add("scan_parquet_compressions", "SELECT * FROM part UNION ALL SELECT * FROM part UNION ALL SELECT * FROM part")
def scan_parquet_compressions(spark: SparkSession, sf: str) -> DataFrame:
    """Parquet in three compressions, read as one list."""
    p, paths = table(spark, sf, "part"), []
    for c in ("gzip", "zstd", "none"):
        paths.append(fresh_path(spark, c) + ".parquet")
        io.write(p, paths[-1], compression=c)
    return io.read(spark, paths)


@R.add("scan_glob_filename", "SELECT *, n_regionkey IN (1, 2) AS mine FROM nation WHERE n_regionkey IN (1, 2)")
def scan_glob_filename(spark: SparkSession, sf: str) -> DataFrame:
    """A glob with the file name as a column, and a filter on it."""
    root = fresh_path(spark, "glob")
    for k in range(5):
        io.write(table(spark, sf, "nation").filter(F.col("n_regionkey") == k), f"{root}/r{k}.parquet", "parquet")
    df = io.read(spark, f"{root}/r[0-3].parquet", "parquet", filename=True)
    return df.filter(F.rlike("_filename", F.lit("/r[12][.]parquet/"))).withColumn("mine", F.lit(True)).drop("_filename")


@R.add("scan_s3_log", "SELECT bucket, s3_key, date_trunc('second', request_time) AS t, request_uri, http_status, bytes_sent, total_time, coalesce(user_agent, '-') AS user_agent, tls_version FROM access_log")
def scan_s3_log(spark: SparkSession, sf: str) -> DataFrame:
    """Access log lines, parsed by position."""
    a = table(spark, sf, "access_log")
    word = lambda c: F.coalesce(F.col(c), F.lit("-"))
    quoted = lambda c: F.concat(F.lit('"'), word(c), F.lit('"'))
    cols = []
    for name, kind in io.S3_LOG:
        if kind == "time":
            cols.append(F.concat(F.lit("["), F.date_format("request_time", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000]")))
        else:
            cols.append(quoted(name) if kind == "quoted" else F.coalesce(F.col(name).cast("string"), F.lit("-")))
    path = fresh_path(spark, "log")
    a.select(F.concat_ws(" ", *cols).alias("value")).write.text(path)
    p = io.read(spark, path, "log", log_format="s3")
    return p.select("bucket", "s3_key", F.col("request_time").cast("timestamp_ntz").alias("t"), "request_uri", "http_status", "bytes_sent", "total_time", "user_agent", "tls_version")


@R.add("scan_delta", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def scan_delta(spark: SparkSession, sf: str) -> DataFrame:
    """A Delta log with an added and a removed file, partitioned."""
    root, n = fresh_path(spark, "delta"), table(spark, sf, "nation")
    n.write.partitionBy("n_regionkey").parquet(root)
    paths = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select(F.regexp_extract("path", "(n_regionkey=.*)$", 1)).collect()]
    meta = {"metaData": {"id": "x", "format": {"provider": "parquet"}, "schemaString": n.schema.json(), "partitionColumns": ["n_regionkey"], "configuration": {}}}
    first = [json.dumps(meta)] + [json.dumps({"add": {"path": p, "partitionValues": {"n_regionkey": p.split("=")[1].split("/")[0]}, "dataChange": True}}) for p in paths]
    second = [json.dumps({"remove": {"path": p, "dataChange": True}}) for p in paths if p.startswith("n_regionkey=1/")]
    for v, lines in enumerate((first, second)):
        fs, at = io._status(spark, f"{root}/_delta_log/{v:020d}.json")
        out = fs.create(at, True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
    return io.read(spark, root, "delta")


@R.add("scan_preview", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(column_name, column_type)")
def scan_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Column names and types of a file."""
    return io.preview(spark, f"{sf}/region.parquet")


@R.add("scan_files_listed", "SELECT true AS there, true AS sized, false AS missing")
def scan_files_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Listing, size and existence of files."""
    there, sized = io.file_exists(spark, f"{sf}/region.parquet"), io.list_files(spark, f"{sf}/region.parquet").filter("file_size > 0")
    return sized.limit(1).select(F.lit(there).alias("there"), (F.col("file_size") > 0).alias("sized"), F.lit(io.file_exists(spark, f"{sf}/none.parquet")).alias("missing"))


@R.add("copy_from_where", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
def copy_from_where(spark: SparkSession, sf: str) -> DataFrame:
    """COPY FROM with a column list and a filter."""
    return io.copy_from(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_quantity"], where=F.col("l_quantity") > 48)


@R.add("copy_to_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def copy_to_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """COPY TO folders by value, in files of bounded length."""
    path = fresh_path(spark, "parts")
    io.write(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "parquet", partition_by=["o_orderstatus"], records_per_file=1000)
    return io.read(spark, path, "parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")


@R.add("inherited_children", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def inherited_children(spark: SparkSession, sf: str) -> DataFrame:
    """A parent whose rows are those of its children."""
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name")))


# Spatial -----------------------------------------------------------------------------


@R.add("geo_point_distance", "SELECT s_suppkey, c_custkey, round(sqrt((s_acctbal - c_acctbal) ^ 2 + (s_nationkey - c_nationkey) ^ 2), 6) AS d FROM supplier JOIN customer ON s_suppkey = c_custkey")
def geo_point_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of points."""
    j = table(spark, sf, "supplier").join(table(spark, sf, "customer"), F.col("s_suppkey") == F.col("c_custkey"))
    a, b = geo.st_point("s_acctbal", F.col("s_nationkey").cast("double")), geo.st_point("c_acctbal", F.col("c_nationkey").cast("double"))
    return j.select("s_suppkey", "c_custkey", F.round(geo.st_distance(a, b), 6).alias("d"))


@R.add("geo_wkt_roundtrip", "SELECT c_custkey, c_acctbal AS x, c_nationkey::DOUBLE AS y, 'POINT' AS kind, true AS same FROM customer")
def geo_wkt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """WKB to WKT and GeoJSON and back."""
    c = table(spark, sf, "customer").withColumn("g", geo.st_point("c_acctbal", F.col("c_nationkey").cast("double")))
    c = c.withColumn("h", geo.st_geomfromtext(geo.st_astext("g"))).withColumn("j", geo.st_geomfromgeojson(geo.st_asgeojson("g")))
    return c.select("c_custkey", geo.st_x("h").alias("x"), geo.st_y("j").alias("y"), geo.geometrytype("h").alias("kind"), geo.st_equals("h", "j").alias("same"))


@R.add("geo_polygon_measures", "SELECT p_partkey, p_size * 3.0::DOUBLE AS area, 2.0 * (p_size + 3)::DOUBLE AS perimeter, p_size / 2 AS cx, 5 AS n FROM part")
def geo_polygon_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Area, perimeter and centroid of rectangles."""
    g = geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(3.0))
    p = table(spark, sf, "part").withColumn("g", g)
    return p.select("p_partkey", geo.st_area("g").alias("area"), geo.st_perimeter("g").alias("perimeter"), geo.st_x(geo.st_centroid("g")).alias("cx"), geo.st_npoints("g").alias("n"))


@R.add("geo_bbox_intersects", "SELECT a.p_partkey AS a, b.s_suppkey AS b FROM part a JOIN supplier b ON a.p_size <= b.s_nationkey + 2 AND a.p_size + 1 >= b.s_nationkey AND a.p_retailprice - 900 <= b.s_acctbal / 10 + 5 AND a.p_retailprice - 900 + 1 >= b.s_acctbal / 10")
def geo_bbox_intersects(spark: SparkSession, sf: str) -> DataFrame:
    """A spatial join of boxes by grid cells."""
    a = table(spark, sf, "part").select("p_partkey", geo.st_makeenvelope(F.col("p_size").cast("double"), F.col("p_retailprice") - 900, F.col("p_size") + 1.0, F.col("p_retailprice") - 900 + 1).alias("ga"))
    b = table(spark, sf, "supplier").select("s_suppkey", geo.st_makeenvelope(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 10, F.col("s_nationkey") + 2.0, F.col("s_acctbal") / 10 + 5).alias("gb"))
    return geo.spatial_join(a, b, "ga", "gb", geo.st_intersects, 10.0).select(F.col("p_partkey").alias("a"), F.col("s_suppkey").alias("b"))


@R.add("geo_predicates", "SELECT p_partkey, p_size < 10 AS inside, p_size <= 10 AS covered, p_size = 10 AS touching, p_size > 10 AS apart FROM part")
def geo_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of points and a rectangle."""
    p = table(spark, sf, "part").withColumns({"g": geo.st_point(F.col("p_size").cast("double"), F.lit(5.0)), "box": geo.st_makeenvelope(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))})
    return p.select("p_partkey", geo.st_within("g", "box").alias("inside"), geo.st_covers("box", "g").alias("covered"), geo.st_touches("g", "box").alias("touching"), geo.st_disjoint("g", "box").alias("apart"))


# Streams -----------------------------------------------------------------------------


@R.add("stream_append_table", "SELECT * FROM events")
def stream_append_table(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of files appended to a table, one commit per micro-batch."""
    source, e = fresh_path(spark, "stream-in"), table(spark, sf, "events")
    e.repartition(3).write.parquet(source)
    t = Table.create(spark, fresh_path(spark, "tbl-stream"), e.schema)
    ingest.append_stream(ingest.stream_files(spark, source, e.schema), t, fresh_path(spark, "stream-state")).awaitTermination()
    return t.read()


@R.add("stream_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over a stream with a watermark."""
    source, e = fresh_path(spark, "stream-in"), table(spark, sf, "events")
    e.repartition(2).write.parquet(source)
    return ingest.run_once(ingest.windowed_counts(ingest.stream_files(spark, source, e.schema), "ts", ["event_type"], "1 hour", "40 days"), spark)
