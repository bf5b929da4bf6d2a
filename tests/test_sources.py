import pytest
from pyspark.sql import functions as F

from lakeloom.operators import relational as rel
from lakeloom.plans.inspect import inspect
from lakeloom.sources import io


@pytest.mark.parametrize(
    ("path", "options", "want"),
    [("s3://b/x.csv.gz?versionId=1", {}, ("csv", "gzip")), ("x.PARQUET", {}, ("parquet", "snappy")), ("x.dat", {"format": "json"}, ("json", "none")), ("v3.metadata.json", {}, ("iceberg", "none")), ("x.json", {"compression": "zstd"}, ("json", "zstd"))],
)
def test_inference(path, options, want):
    assert io.infer(path, **options) == want


@pytest.mark.parametrize(("path", "options"), [("x.dat", {}), ("x.csv", {"format": "xml"}), ("x.csv", {"compression": "lz4"}), ("x.csv", {"compression": "snappy"})])
def test_refused(path, options):
    with pytest.raises(ValueError):
        io.infer(path, **options)


def test_schemes():
    assert io.check_url("s3://a/b") and io.check_url("/tmp/x")
    with pytest.raises(ValueError, match="scheme"):
        io.check_url("ftp://a/b")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("a;b\n1;2\n3;4\n", {"sep": ";", "header": "true"}), ("1,x\n2,y\n", {"sep": ",", "header": "false"}), ('a\tb\n"p\tq"\t1\n', {"sep": "\t", "header": "true"}), ("", {"sep": ",", "header": "false"}), ("one\ntwo\n", {"sep": ",", "header": "true"}),
    ],
)
def test_csv_sniffing(spark, tmp_path, body, want):
    (tmp_path / "x.csv").write_text(body)
    got = io.sniff_csv(spark, str(tmp_path / "x.csv"))
    assert {k: got[k] for k in want} == want


def test_log_lines(spark):
    good = 'own bkt [06/Feb/2019:00:00:38 +0000] 1.2.3.4 req id REST.GET.OBJECT a/b "GET /a/b HTTP/1.1" 200 - 10 - 7 - "-" "agent x" - host= SigV4 C - h TLSv1.2 - - more text'
    df = spark.createDataFrame([(good,), ("not a log line",), (None,), ("",)], "value string")
    a, b, c, d = io.parse_log_lines(df, "value").collect()
    assert len(a) == 27 and (a["bucket"], a["request_uri"], a["bytes_sent"], a["object_size"], a["user_agent"], a["extra"]) == ("bkt", "GET /a/b HTTP/1.1", 10, None, "agent x", " more text")
    assert b["bucket"] is None and b["extra"] == "not a log line" and c["extra"] is None and d["extra"] == ""


def test_geojson(spark, tmp_path):
    (tmp_path / "x.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [3, 4]}}]}')
    from lakeloom.functions import geo

    r = io.read(spark, str(tmp_path / "x.geojson")).select("n", geo.st_astext("geom").alias("w")).first()
    assert tuple(r) == (1, "POINT (3 4)")


def test_files_and_cache(spark, tmp_path):
    for n in "ab":
        spark.range(1000).write.parquet(str(tmp_path / f"{n}.parquet"))
    c = io.FileCache(spark, 1)
    c.add(str(tmp_path / "a.parquet"))
    c.add(str(tmp_path / "b.parquet"))
    assert [r["path"][-9:] for r in c.list().collect()] == ["b.parquet"] and c.remove(str(tmp_path / "b.parquet")) and not c.remove("x")
    f = str(tmp_path / "a.parquet" / "_SUCCESS")
    assert io.file_exists(spark, f) and io.file_size(spark, f) == 0 and io.file_delete(spark, f) and not io.file_exists(spark, f)


def test_plans_push_filters_and_prune_columns(spark, sf):
    p = inspect(spark.read.parquet(f"{sf}/lineitem.parquet").filter(F.col("l_quantity") > 40).groupBy("l_returnflag").agg(F.sum("l_tax")))
    assert p.exchanges == 1 and p.python_nodes == 0 and "GreaterThan(l_quantity,40.0)" in p.pushed[0] and set(p.read_columns[0]) == {"l_quantity", "l_tax", "l_returnflag"}


def test_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 7), (5, None)], "id int, v int")
    ids = lambda n, desc: sorted(r[0] for r in rel.fetch_with_ties(df, [("v", desc)], n).collect())
    assert ids(1, False) == [1, 2] and ids(3, False) == [1, 2, 4] and ids(4, False) == [1, 2, 3, 4, 5] and ids(1, True) == [3, 5] and ids(3, True) == [3, 4, 5] and ids(0, True) == [] and ids(99, True) == [1, 2, 3, 4, 5]
    assert rel.fetch_with_ties(df.limit(0), [("v", True)], 3).count() == 0


def test_limit_by_query(spark):
    df = spark.range(9)
    n = lambda x: spark.createDataFrame([(x,)], "n int")
    assert rel.limit_by_query(df, [F.col("id")], n(3)).count() == 3 and rel.limit_by_query(df, [F.col("id")], n(None)).count() == 9 and rel.limit_by_query(df, [F.col("id")], n(1).limit(0)).count() == 9
    with pytest.raises(ValueError, match="more than one row"):
        rel.limit_by_query(df, [F.col("id")], n(1).union(n(2)))


def test_range_join_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, None), (4, -5.0)], "id int, x double")
    right = spark.createDataFrame([("a", 0.0, 10.0), ("b", 9.0, 31.0), ("c", None, 1.0), ("d", 5.0, 5.0)], "k string, lo double, hi double")
    got = sorted((r["id"], r["k"]) for r in rel.range_join(left, right, "x", "lo", "hi", 4.0).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b")]
    assert rel.range_join(left, right, "x", "lo", "hi", 4.0, "left").count() == 5


def test_unsupported_statements():
    for sql in ("merge into t using s on true", "insert into t values (1) on conflict do nothing", "select * from t for update"):
        with pytest.raises(NotImplementedError):
            rel.reject_unsupported(sql)
    rel.reject_unsupported("select emerge from t")


def test_recursion_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    reach = rel.recursive_union(spark.createDataFrame([(1,)], "n int"), lambda d: d.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")))
    assert sorted(r[0] for r in reach.collect()) == [1, 2, 3]


def test_csv_fields_with_line_breaks_come_back_as_written(spark, tmp_path):
    from lakeloom.sources import io

    rows = [(1, 'a\nb "q", c'), (2, "plain"), (3, None), (4, "\n\n")]
    df = spark.createDataFrame(rows, "id int, t string")
    for name, header in (("a.csv", True), ("b.csv.gz", False)):
        path = f"file://{tmp_path}/{name}"
        io.write(df, path, header=header)
        got = io.read(spark, path, schema=df.schema, header=header, delimiter=",", quote='"')
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
