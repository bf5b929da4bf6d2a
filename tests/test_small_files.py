import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeloom.operators.lakefiles import canonical_path, newest_files
from lakeloom.operators.small_files import consolidate_parquet, consolidation_plan, list_footers, small_files
from lakeloom.sources import parquet_blocks

FILES = "id bigint, table_name string, path string, row_count bigint, updated_time timestamp_ntz, file_size bigint, content int, deleted_row_count bigint, first_row_id bigint, object string, _key int"


@pytest.mark.parametrize(
    ("path", "same_as"),
    [
        ("S3A://b/x//y", "s3://b/x/y"), ("s3n://b/x/./y", "s3://b/x/y"), ("s3://b/x%2Fy", "s3://b/x/y"), ("s3://b/a%3D1", "s3://b/a=1"), ("s3://b/x/z/../y", "s3://b/x/y"), ("s3://b/a+b", "s3://b/a%2Bb"),
    ],
)
def test_same_object(spark, path, same_as):
    a, b = spark.createDataFrame([(path,), (same_as,)], "p string").select(canonical_path(F.col("p"))).collect()
    assert a[0] == b[0] is not None


def test_other_objects_stay_apart(spark):
    paths = ["s3://b/x/y", "s3://B/x/y", "s3://b/X/y", "gs://b/x/y", "s3://b/x/y%zz", None]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(canonical_path(F.col("p"))).collect()]
    assert len(set(got)) == len(paths) and got[-1] is None


def _file(i, path="s3://b/k", t="t", size=10, when="2020-01-01 00:00:00", content=0, rows=1):
    return (i, t, path, rows, when, size, content, 0, None, "mine", 1)


def _files(spark, rows):
    plain = FILES.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, plain).withColumn("updated_time", F.col("updated_time").cast("timestamp_ntz"))


def test_newest_breaks_ties_by_id_and_keeps_null_paths(spark):
    rows = [_file(1), _file(2), _file(2), _file(3, when="2019-01-01 00:00:00"), _file(4, when=None), _file(7, path=None), _file(8, path=None)]
    assert sorted(r["id"] for r in newest_files(_files(spark, rows)).collect()) == [2, 7, 8]


def test_groups_need_five_small_files(spark):
    rows = [_file(i, f"s3://b/{i}") for i in range(5)] + [_file(10 + i, f"s3://b/{10 + i}") for i in range(5)]
    rows += [_file(20 + i, f"s3://b/{20 + i}", t="u") for i in range(4)] + [_file(30, "s3://b/30", size=None), _file(31, "s3://b/31", content=1), _file(32, "s3://b/32", size=402653184)]
    parts = spark.createDataFrame([("t", 10 + i, f, v) for i in range(5) for f, v in ((1, None), (2, "x"), (2, "x"))] + [("t", 10, 9, "own")], "table_name string, id bigint, partition_field_id int, value string")
    assert sorted(r["id"] for r in small_files(_files(spark, rows), parts).collect()) == [0, 1, 2, 3, 4]  # file 10 lies in a partition of its own


def test_plan_fills_outputs_and_keeps_every_file_once(spark):
    rows = [_file(i, f"s3://b/{i}", size=100 + i, rows=-1 if i % 3 == 0 else i) for i in range(200)]
    none = spark.createDataFrame([], "table_name string, id bigint, partition_field_id int, value string")
    plan = consolidation_plan(small_files(_files(spark, rows), none), target=1000).collect()
    assert sorted(r["id"] for r in plan) == list(range(200))
    loads = {}
    for r in plan:
        loads[r["output"]] = loads.get(r["output"], 0) + r["file_size"]
    assert max(loads.values()) < 1300 and len(loads) == -(-sum(loads.values()) // 1000)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "table_name string, id bigint, partition_field_id int, value string")
    assert consolidation_plan(small_files(_files(spark, []), none)).count() == 0


def _write(path, rows, **options):
    pq.write_table(pa.table({"a": pa.array(rows, pa.int64()), "s": pa.array([None if r % 5 == 0 else "x" * (r % 7) for r in rows], pa.string()), "l": pa.array([[r, None] for r in rows], pa.list_(pa.int32()))}), path, **options)


def test_block_copy_keeps_every_row_and_block(tmp_path):
    options = [{"compression": "zstd"}, {"compression": "none", "use_dictionary": False}, {"row_group_size": 10, "write_page_index": True}, {"compression": "gzip", "data_page_version": "2.0"}]
    paths = []
    for i, o in enumerate(options):
        paths.append(str(tmp_path / f"{i}.parquet"))
        _write(paths[-1], range(100 * i, 100 * i + 37), **o)
    _write(str(tmp_path / "empty.parquet"), [])
    [(path, files, blocks, rows, size, problem)] = parquet_blocks.merge_files([*paths, str(tmp_path / "empty.parquet")], str(tmp_path / "out"), "m")
    got = pq.read_table(path)
    want = pa.concat_tables([pq.read_table(p) for p in paths])
    assert got.equals(want) and (files, rows, problem) == (5, 148, None) and size == os.path.getsize(path)
    assert blocks == pq.ParquetFile(path).metadata.num_row_groups >= 7
    assert not [f for f in os.listdir(tmp_path / "out") if f.endswith(".tmp")]


def test_other_schemas_and_broken_files_are_kept_apart(tmp_path):
    _write(str(tmp_path / "a.parquet"), [1, 2])
    pq.write_table(pa.table({"a": [1.5]}), tmp_path / "b.parquet")
    (tmp_path / "c.parquet").write_bytes(b"PAR1 this is none PAR1")
    (tmp_path / "d.parquet").write_bytes(b"")
    made = parquet_blocks.merge_files([str(tmp_path / f"{x}.parquet") for x in "abcd"], str(tmp_path / "out"), "m")
    assert sorted(m[3] for m in made if m[0]) == [1, 2] and sum(1 for m in made if m[5]) == 2


def test_consolidate_on_tasks(spark, tmp_path):
    for i in range(12):
        _write(str(tmp_path / f"{i}.parquet"), range(i * 10, i * 10 + 10))
    plan = spark.createDataFrame([("t", "[]", i % 2, str(tmp_path / f"{i}.parquet"), None) for i in range(12)], "table_name string, partition string, output int, path string, row_count bigint")
    done = consolidate_parquet(plan, str(tmp_path / "out")).collect()
    assert sorted(r["rows"] for r in done) == [60, 60]
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("a").collect()) == list(range(120))
    assert list_footers(spark.createDataFrame([(r["path"],) for r in done], "path string")).agg(F.sum("rows")).first()[0] == 120


def test_tables_and_partitions_never_meet_and_catalog_counts_hold(spark, tmp_path):
    plan = []
    for n, (t, p) in enumerate([("a", "[]"), ("a", '[{"f":1,"v":"=x"}]'), ("b", "[]"), (None, "[]")]):
        for k in range(3):
            path = str(tmp_path / f"{n}-{k}.parquet")
            pq.write_table(pa.table({"owner": [n] * (k + 1)}), path)
            plan.append((t, p, 0, path, None if k == 0 else k + 1))
    plan[5] = (*plan[5][:4], 99)  # the catalog counts this file otherwise
    df = spark.createDataFrame(plan, "table_name string, partition string, output bigint, path string, row_count bigint")
    done = consolidate_parquet(df, str(tmp_path / "out")).collect()
    outputs, left = [r for r in done if r["path"]], [r for r in done if r["problem"]]
    assert len(outputs) == 4 and sum(r["rows"] for r in outputs) == 6 * 4 - 3 and len(left) == 1 and "3 rows instead of 99" in left[0]["problem"]
    for r in outputs:
        assert len(set(pq.read_table(r["path"])["owner"].to_pylist())) == 1
    with pytest.raises(ValueError, match="not a consolidation plan"):
        consolidate_parquet(df.drop("table_name"), str(tmp_path))
