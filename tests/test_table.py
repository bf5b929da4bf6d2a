import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakeloom.table import transforms, validation
from lakeloom.table.layer import ConcurrentWrite, Table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", "id int, s string")
    t.append(spark.createDataFrame([(i, f"v{i % 3}") for i in range(20)], "id int, s string").repartition(2))
    return t


def test_empty_table_reads_with_its_schema(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/e", "a int, b array<string>")
    assert t.read().count() == 0 and t.read().dtypes == [("a", "int"), ("b", "array<string>")] and t.size() == 0
    t.append(spark.createDataFrame([], "a int, b array<string>"))
    assert t.read().count() == 0 and not Table(spark, f"file://{tmp_path}/none").exists()


def test_of_two_writers_one_wins_and_appends_are_retried(spark, table):
    state = table.state()
    table.append(spark.createDataFrame([(100, "x")], "id int, s string"))
    with pytest.raises(ConcurrentWrite):
        table._publish(state, "overwrite", "", [], 0)
    assert table.read().count() == 21
    real, calls = table.state, []

    def stale():
        calls.append(1)
        return state if len(calls) == 1 else real()

    table.state = stale
    table.append(spark.createDataFrame([(101, "y")], "id int, s string"))
    table.state = real
    assert table.read().count() == 22


def test_deletes_over_deletes_and_metadata_only_drop(spark, table):
    table.delete(F.col("id") < 3, mode="mor")
    table.delete(F.col("id") < 5, mode="mor")
    table.update({"s": F.concat("s", F.lit("!"))}, F.col("id") == 7, mode="mor")
    assert rows(table.read().filter("id < 9")) == [(5, "v2"), (6, "v0"), (7, "v1!"), (8, "v2")]
    files = table.files().filter("content = 0").count()
    table.delete(F.lit(True))
    assert table.read().count() == 0 and files > 0 and table.files().filter("content = 0").count() == 0


def test_null_condition_deletes_nothing(spark, table):
    table.append(spark.createDataFrame([(None, None)], "id int, s string"))
    table.delete(F.col("id") > 100)
    assert table.read().count() == 21 and table.read([("id", "isnull", None)]).count() == 1 and table.read([("s", "<>", "v0")]).count() == 13


def test_schema_rules(spark, table):
    with pytest.raises(ValueError, match="already exists"):
        table.add_column("s", "int")
    with pytest.raises(ValueError, match="does not exist"):
        table.drop_column("zz")
    with pytest.raises(ValueError, match="cannot change"):
        table.widen_column("s", "int")
    with pytest.raises(ValueError, match="no such columns"):
        table.append(spark.createDataFrame([(1,)], "other int"))
    with pytest.raises(NotImplementedError, match="MERGE"):
        table.merge()
    table.add_column("d", "int", default=5)
    table.rename_column("d", "e")
    assert {r["e"] for r in table.read().collect()} == {5}
    assert table.read([("e", "=", 5)]).count() == 20 and table.read([("e", "=", 6)]).count() == 0


def test_changes_between_snapshots(spark, table):
    first = table.state()["current"]
    table.update({"s": F.lit("new")}, F.col("id") == 1, mode="mor")
    assert rows(table.changes(first)) == [(1, "new", "insert"), (1, "v1", "delete")]
    assert table.read(snapshot_id=first).filter("s = 'new'").count() == 0
    with pytest.raises(ValueError, match="no snapshot"):
        table.read(snapshot_id=99)


def test_required_columns(spark, tmp_path):
    from pyspark.sql import types as T

    t = Table.create(spark, f"file://{tmp_path}/r", T.StructType([T.StructField("a", T.IntegerType(), False)]))
    with pytest.raises(Exception, match="null value"):
        t.append(spark.createDataFrame([(None,)], "a int"))
    t.drop_not_null("a")
    t.append(spark.createDataFrame([(None,)], "a int"))
    assert t.read().count() == 1


def test_partition_specs():
    assert [p["transform"] for p in transforms.parse('day(ts), bucket(32, u), truncate(s, 4), "r"', ["ts", "u", "s", "r"])] == ["day", "bucket", "truncate", "identity"]
    for bad in ("week(ts)", "bucket(u)", "day(3, ts)", "bucket(0, u)", "nope", "day(ts"):
        with pytest.raises(ValueError):
            transforms.parse(bad, ["ts", "u"])


def test_bucket_hash_has_the_published_values(spark):
    # Test vectors of the public table format specification.
    assert transforms.murmur3((34).to_bytes(8, "little")) == 2017239379 and transforms.murmur3(b"iceberg") == 1210000089 and transforms.murmur3(b"\x00\x01\x02\x03") & 0xFFFFFFFF == (-188683207) & 0xFFFFFFFF
    values = [0, 1, -1, 34, 2**62, -(2**63), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(transforms.bucket(F.col("v"), 17, "bigint")).collect()]
    assert got == [transforms.bucket_of(v, 17) for v in values]
    texts = ["", "iceberg", "é", None, "abc" * 50]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in texts], "v string").select(transforms.bucket(F.col("v"), 9, "string")).collect()] == [transforms.bucket_of(v, 9) for v in texts]


def test_pruning_loses_no_row(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i * 3 - 50, f"k{i % 5}") for i in range(80)], "id int, v int, k string")
    for n, spec in enumerate([None, "truncate(10, v)", "k, bucket(3, v)", "bucket(4, k)", "void(k)"]):
        t = Table.create(spark, f"file://{tmp_path}/p{n}", df.schema, spec)
        t.append(df.repartitionByRange(4, "v"))
        for where in ([("v", ">", 20)], [("v", "=", 25)], [("v", "isnull", None)], [("v", "notnull", None), ("k", "in", ["k1", "k3"])], [("v", "<=", -20), ("k", "<>", "k0")]):
            want = df
            for c, op, x in where:
                want = want.filter(transforms.condition(F.col(c), op, x))
            assert rows(t.read(where).select("id")) == rows(want.select("id")), (spec, where)


def test_out_of_range(spark):
    df = spark.createDataFrame([(5, [1, None, 99], {"a": -4}, (7,)), (None, None, None, None)], "i int, a array<int>, m map<string,int>, s struct<x:int>")
    r = validation.enforce(df, {"i": (0, 3), "a": (0, 10), "m": (0, 10), "s.x": (0, 2)}, "clamp").collect()
    assert tuple(r[0]) == (3, [1, None, 10], {"a": 0}, (2,)) and tuple(r[1]) == (None,) * 4
    with pytest.raises(Exception, match="out of range"):
        validation.enforce(df, {"a": (0, 10)}).collect()
    cut = lambda s, n: spark.createDataFrame([(s,)], "s string").select(validation.limit_text(F.col("s"), n, "clamp")).first()[0]
    assert [cut("aé€😀", n) for n in (1, 2, 3, 5, 6, 9, 10)] == ["a", "a", "aé", "aé", "aé€", "aé€", "aé€😀"] and cut(None, 1) is None


def _avro(schema, records, write):
    def varint(n):
        n = (n << 1) ^ (n >> 63)
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    raw = lambda b: varint(len(b)) + b
    head = b"Obj\x01" + varint(2) + raw(b"avro.schema") + raw(json.dumps(schema).encode()) + raw(b"avro.codec") + raw(b"null") + varint(0) + b"S" * 16
    body = b"".join(write(r, varint, raw) for r in records)
    return head + varint(len(records)) + varint(len(body)) + body + b"S" * 16


def test_snapshot_of_another_engine(spark, tmp_path):
    from lakeloom.sources.io import read

    field = lambda t, i: pa.field("old_name", t, metadata={"PARQUET:field_id": str(i)})
    pq.write_table(pa.table([pa.array([1, 2, 3])], schema=pa.schema([field(pa.int64(), 1)])), tmp_path / "d.parquet")
    pq.write_table(pa.table({"file_path": [f"file://{tmp_path}/d.parquet"], "pos": [1]}), tmp_path / "del.parquet")
    data = {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}]}
    entry = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": data}]}
    files = [(1, 0, "d"), (1, 1, "del"), (2, 0, "gone")]
    (tmp_path / "m.avro").write_bytes(_avro(entry, files, lambda r, v, raw: v(r[0]) + v(r[1]) + raw(f"file://{tmp_path}/{r[2]}.parquet".encode())))
    (tmp_path / "l.avro").write_bytes(_avro({"type": "record", "name": "l", "fields": [{"name": "manifest_path", "type": ["null", "string"]}]}, [0], lambda r, v, raw: v(1) + raw(f"file://{tmp_path}/m.avro".encode())))
    schema = {"schema-id": 0, "type": "struct", "fields": [{"id": 1, "name": "id", "type": "long"}, {"id": 2, "name": "extra", "type": {"type": "list", "element-id": 3, "element": "string"}}]}
    doc = {"format-version": 2, "current-schema-id": 0, "schemas": [schema], "current-snapshot-id": 7, "snapshots": [{"snapshot-id": 7, "manifest-list": f"file://{tmp_path}/l.avro"}]}
    (tmp_path / "v1.metadata.json").write_text(json.dumps(doc))
    assert rows(read(spark, f"file://{tmp_path}/v1.metadata.json")) == [(1, None), (3, None)]


def test_catalog(spark, tmp_path):
    from lakeloom.table.catalog import Catalog

    c = Catalog(spark, f"file://{tmp_path}/cat")
    c.create("t", "a int")
    one = spark.createDataFrame([(1,)], "a int")
    with c.transaction() as tx:
        tx.table("t").append(one)
        assert c.read("t").count() == 0 and tx.table("t").read().count() == 1  # seen only inside
    assert c.read("t").count() == 1
    with pytest.raises(ConcurrentWrite), c.transaction() as tx:
        tx.table("t").append(one)
        with c.transaction() as other:
            other.table("t").append(one)
    assert c.read("t").count() == 2
    with pytest.raises(ValueError, match="already exists"):
        c.create("t", "a int")
    c.drop("t")
    assert c.names() == [] and c.purge() == 1
    with pytest.raises(ValueError, match="does not exist"):
        c.table("t")


def test_cursor(spark):
    from lakeloom.operators.relational import cursor

    assert [len(b) for b in cursor(spark.range(10), 4)] == [4, 4, 2] and list(cursor(spark.range(0))) == []


def test_file_keys_are_unique_under_two_partition_columns_and_odd_values(spark, tmp_path):
    odd = ["a b", "x:y/z", "50%", "100%25", "ü+ü", "", None, "{q}", "data", "a=b", "'"]
    df = spark.createDataFrame([(i, odd[i % 11], i % 3) for i in range(330)], "id int, k string, g int")
    for mode in ("mor", "cow"):
        t = Table.create(spark, f"file://{tmp_path}/data/{mode}", df.schema, "k, g")
        t.append(df.coalesce(1))
        keys = [t._key(r["path"]) for r in t.files().collect()]
        assert len(keys) == len(set(keys)) >= 33
        t.delete(F.col("id") == 0, mode=mode)
        t.delete("id between 11 and 15", mode=mode)
        t.update({"g": F.lit(9)}, F.col("id") == 20, mode=mode)
        want = sorted((i, 9 if i == 20 else i % 3) for i in range(330) if i != 0 and not 11 <= i <= 15)
        assert rows(t.read().select("id", "g")) == want, mode
        ids = [r["_row_id"] for r in t.row_ids().collect()]
        assert len(ids) == len(set(ids)) == 324
        assert t.snapshots().orderBy("snapshot_id").collect()[-1]["total_rows"] == 324
        t.compact()
        assert rows(t.read().select("id", "g")) == want and t.files().filter("content = 1").count() == 0
        assert rows(t.read([("k", "=", "50%")]).select("id")) == [(i,) for i in range(330) if i % 11 == 2 and not 11 <= i <= 15]


def test_conditions_prune_and_lose_no_row(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i * 3 - 50, f"k{i % 5}", i / 4, None) for i in range(80)], "id int, v int, k string, f double, d date").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id")))
    conditions = [
        "v > 20", "NOT v > 20", "v BETWEEN 3 AND 9 OR k LIKE 'k4%'", "v IN (1, 4, 7)", "v NOT IN (1, 4, 7)", "NOT (v IS NULL OR id < 5)", "v <=> 4", "NOT v <=> 4", "30 >= v", "f < 3", "CAST(id AS bigint) = 70L",
        "d = DATE '2024-02-03'", "d > DATE '2024-01-31' - INTERVAL 3 DAYS AND d < TIMESTAMP '2024-02-10 12:00:00'", "v + 1 = 5", "v = id", "length(k) = 2 AND id = 9", "v = NULL", "id IN (0,1,2,3,4,5,6,7,8,9,10,11,12)", "rand() < 2 AND id = 3", "true", "false",
    ]
    for n, spec in enumerate([None, "k, bucket(3, v)", "truncate(10, v), truncate(1, k)", "bucket(5, d)", "month(d)"]):
        t = Table.create(spark, f"file://{tmp_path}/c{n}", df.schema, spec)
        t.append(df.repartitionByRange(6, "id"))
        for c in conditions:
            assert rows(t.read(c).select("id")) == rows(df.filter(c).select("id")), (spec, c)
    t = Table(spark, f"file://{tmp_path}/c0")
    files = t.files().count()
    assert all(t.plan_files(c).count() < files for c in ("id < 10", "id BETWEEN 3 AND 9", "NOT id > 9", "d < DATE '2024-01-05'", "CAST(id AS bigint) = 70L", "id IN (1, 2) AND length(k) = 2"))
    assert Table(spark, f"file://{tmp_path}/c4").plan_files("d > DATE '2024-03-02'").count() == 1 and Table(spark, f"file://{tmp_path}/c3").plan_files("d = DATE '2024-02-03'").count() <= 20


def test_vacuum_beside_an_open_write_and_a_dead_one(spark, table):
    state = table.state()
    with table._writing() as op:
        added = table._write_data(state, spark.createDataFrame([(500, "late")], "id int, s string"), op)
        assert table.remove_orphans() == 0
        table.vacuum()
        table._publish(table.state(), "append", op, [added], 1, [])
    assert table.read().filter("id = 500").count() == 1 and table._names("open") == []
    with pytest.raises(KeyError), table._writing() as op:  # a writer that dies
        table._write_data(table.state(), spark.createDataFrame([(501, "dead")], "id int, s string"), op)
        raise KeyError
    table.vacuum()
    assert table._names("open") and table.remove_orphans() == 0
    assert table.remove_orphans(open_ms=0) >= 2 and table.read().count() == 21


def test_a_version_is_published_whole_or_not_at_all(spark, table, monkeypatch):
    import os

    def crash(*_):
        raise OSError("power cut")

    before = table.version()
    monkeypatch.setattr(os, "link", crash)
    with pytest.raises(OSError):
        table.append(spark.createDataFrame([(1, "x")], "id int, s string"))
    monkeypatch.undo()
    assert table.version() == before and table.read().count() == 20
    assert not table._publish_file(f"{table.location}/meta/v{before:06d}.json", "{}") and table.state()["version"] == before


def test_a_stream_that_crashes_anywhere_gives_each_row_once(spark, table, tmp_path, monkeypatch):
    from lakeloom.streaming import ingest

    source = f"file://{tmp_path}/in"
    spark.createDataFrame([(i, "s") for i in range(1000, 1010)], "id int, s string").repartition(2).write.parquet(source)
    run = lambda: ingest.append_stream(ingest.stream_files(spark, source, "id int, s string"), table, f"file://{tmp_path}/cp").awaitTermination()
    real_commit, real_write = Table._commit, Table._write_data

    def after_commit(self, state):
        real_commit(self, state)
        raise RuntimeError("crash after the commit")

    def before_commit(self, *a, **k):
        real_write(self, *a, **k)
        raise RuntimeError("crash before the commit")

    for place, broken in (("_write_data", before_commit), ("_commit", after_commit), ("_commit", after_commit)):
        monkeypatch.setattr(Table, place, broken)
        with pytest.raises(Exception, match="crash"):
            run()
        monkeypatch.undo()
    run()
    run()
    assert table.read().filter("id >= 1000").count() == 10 == table.read().filter("id >= 1000").distinct().count()


def test_update_from_and_delete_using(spark, table):
    s = spark.createDataFrame([(1, "one"), (1, "uno"), (2, "two"), (99, "x"), (None, "y")], "id int, s string")
    assert rows(table.update_from(s, {"s": F.col("s.s")}, "t.id = s.id", returning=True))[1] == (2, "two")
    got = dict(rows(table.read()))
    assert got[1] in ("one", "uno") and got[2] == "two" and len(got) == 20
    assert rows(table.delete_using(s, "t.id < s.id AND s.id < 3", returning=True)) == [(0, "v0"), (1, got[1])]
    assert table.read().count() == 18
    with pytest.raises(ValueError):
        table.update_from(s, {"zz": F.lit(1)}, "t.id = s.id")


def test_a_delete_takes_few_jobs(spark, table):
    table.delete("id = 3", mode="mor")
    spark.sparkContext.setJobGroup("few-jobs", "delete")
    table.delete("id = 4", mode="mor")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs < 10 and table.read().count() == 18


def test_compaction_leaves_untouched_files_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 4) for i in range(400)], "id int, g int")
    t = Table.create(spark, f"file://{tmp_path}/c", df.schema, "g")
    t.append(df)
    before = {r["path"]: r["partition"]["g"] for r in t.files().collect()}
    t.delete("id = 6", mode="mor")
    t.compact()
    after = {r["path"] for r in t.files().collect()}
    assert {g for p, g in before.items() if p not in after} == {"2"} and t.read().count() == 399
    assert t.compact() is None
