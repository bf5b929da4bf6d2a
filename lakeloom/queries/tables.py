"""Queries of the table layer: each writes a table into the shared folder, changes it and reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.registry import Registry
from lakeloom.shared import fresh_path
from lakeloom.sources.tables import table
from lakeloom.table.layer import Table

R = Registry()


def _copy(spark: SparkSession, sf: str, name: str, partition_by: str | None = None) -> Table:
    return Table.create_as(table(spark, sf, name), fresh_path(spark, f"tbl-{name}"), partition_by)


@R.add("tbl_append_read", "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P'")
def tbl_append_read(spark: SparkSession, sf: str) -> DataFrame:
    """CREATE TABLE AS, then INSERT SELECT."""
    t = _copy(spark, sf, "orders")
    t.append(table(spark, sf, "orders").filter("o_orderstatus = 'P'"))
    return t.read()


@R.add("tbl_insert_values", "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (100, 'NORTH'), (101, NULL)) v(r_regionkey, r_name)")
def tbl_insert_values(spark: SparkSession, sf: str) -> DataFrame:
    """INSERT VALUES, with a column left out."""
    t = _copy(spark, sf, "region")
    t.append(spark.createDataFrame([(100, "NORTH")], "r_regionkey int, r_name string"))
    t.append(spark.createDataFrame([(101,)], "r_regionkey int"))
    return t.read()


@R.add("tbl_delete_cow", "SELECT * FROM orders WHERE NOT o_totalprice > 250000")
def tbl_delete_cow(spark: SparkSession, sf: str) -> DataFrame:
    """DELETE by rewriting files."""
    t = _copy(spark, sf, "orders")
    t.delete(F.col("o_totalprice") > 250000, mode="cow")
    return t.read()


@R.add("tbl_delete_mor", "SELECT * FROM orders WHERE NOT o_totalprice > 480000 AND o_orderkey % 100 <> 3")
def tbl_delete_mor(spark: SparkSession, sf: str) -> DataFrame:
    """DELETE by position deletes, twice, merged when reading."""
    t = _copy(spark, sf, "orders")
    t.delete(F.col("o_totalprice") > 480000, mode="mor")
    t.delete(F.col("o_orderkey") % 100 == 3, mode="mor")
    return t.read()


@R.add("tbl_delete_returning", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 500 = 0")
def tbl_delete_returning(spark: SparkSession, sf: str) -> DataFrame:
    """DELETE RETURNING."""
    return _copy(spark, sf, "orders").delete(F.col("o_orderkey") % 500 == 0, returning=True).select("o_orderkey", "o_totalprice")


@R.add("tbl_delete_using", "SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND o_totalprice > c_acctbal * 20)")
def tbl_delete_using(spark: SparkSession, sf: str) -> DataFrame:
    """DELETE USING another table, with a join condition beyond equality."""
    t = _copy(spark, sf, "orders")
    building = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    t.delete_using(building, "t.o_custkey = s.c_custkey AND t.o_totalprice > s.c_acctbal * 20")
    return t.read()


@R.add("tbl_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def tbl_update(spark: SparkSession, sf: str) -> DataFrame:
    """UPDATE: expressions see the old values."""
    t = _copy(spark, sf, "orders")
    t.update({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1}, F.col("o_orderstatus") == "P")
    return t.read()


@R.add(
    "tbl_update_from",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN c_mktsegment = 'MACHINERY' THEN o_totalprice + c_acctbal ELSE o_totalprice END AS o_totalprice, o_orderdate, "
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN c_mktsegment ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
)
def tbl_update_from(spark: SparkSession, sf: str) -> DataFrame:
    """UPDATE ... FROM another table, whose columns the new values use."""
    t = _copy(spark, sf, "orders")
    machinery = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    t.update_from(machinery, {"o_totalprice": F.col("t.o_totalprice") + F.col("s.c_acctbal"), "o_orderpriority": F.col("s.c_mktsegment")}, "t.o_custkey = s.c_custkey")
    return t.read()


def _multi(name: str, sql: str, change) -> None:
    """Row-level changes of tables with two partition columns, written by one task, so that file names repeat across folders."""

    @R.add(name, sql.replace("$t", "events") + " UNION ALL " + sql.replace("$t", "events"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        parts = []
        for spec in ("day(ts), bucket(4, user_id)", "event_type, user_id"):
            t = Table.create(spark, fresh_path(spark, "tbl-multi"), table(spark, sf, "events").schema, spec)
            t.append(table(spark, sf, "events").withColumn("user_id", F.col("user_id") % 7).coalesce(1))
            parts.append(change(t))
        return parts[0].unionAll(parts[1])

    run.__doc__ = f"{name[10:]} under two partition columns."


_EVENTS = "SELECT event_id, ts, user_id % 7 AS user_id, event_type, value, props FROM $t"


def _after(change):
    def run(t: Table) -> DataFrame:
        change(t)
        return t.read()

    return run


_multi("tbl_multi_delete_mor", _EVENTS + " WHERE event_id % 50 <> 3", _after(lambda t: t.delete("event_id % 50 = 3", mode="mor")))
_multi("tbl_multi_delete_cow", _EVENTS + " WHERE event_id % 50 <> 3 AND event_id % 77 <> 5", _after(lambda t: [t.delete("event_id % 50 = 3", mode="cow"), t.delete("event_id % 77 = 5", mode="cow")]))
_multi("tbl_multi_update", "SELECT event_id, ts, user_id % 7 AS user_id, CASE WHEN event_id % 40 = 1 THEN 'seen' ELSE event_type END AS event_type, value, props FROM $t", _after(lambda t: t.update({"event_type": F.lit("seen")}, "event_id % 40 = 1", mode="mor")))
_multi("tbl_multi_row_ids", "SELECT count(*) AS n, count(*) AS ids, count(*) - 1 AS top FROM $t", lambda t: t.row_ids().agg(F.count("*").alias("n"), F.count_distinct("_row_id").alias("ids"), F.max("_row_id").alias("top")))
_multi("tbl_multi_compact", _EVENTS + " WHERE event_id % 9 <> 2", _after(lambda t: [t.append(t.read("event_id % 2 = 1")), t.delete("event_id % 9 = 2", mode="mor"), t.compact(), t.delete("event_id % 2 = 1"), t.append(t.read(snapshot_id=1).filter("event_id % 2 = 1 AND event_id % 9 <> 2"))]))


@R.add("tbl_truncate", "SELECT * FROM nation WHERE n_regionkey = 1")
def tbl_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """TRUNCATE, then INSERT."""
    t = _copy(spark, sf, "nation")
    t.truncate()
    t.append(table(spark, sf, "nation").filter("n_regionkey = 1"))
    return t.read()


@R.add("tbl_time_travel", "SELECT * FROM customer")
def tbl_time_travel(spark: SparkSession, sf: str) -> DataFrame:
    """An old snapshot after deletes and compaction."""
    t = _copy(spark, sf, "customer")
    first = t.state()["current"]
    t.delete(F.col("c_acctbal") > 0)
    t.compact()
    return t.read(snapshot_id=first)


@R.add("tbl_changelog", "SELECT c_custkey, 'delete' AS _change FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey + 1000000, 'insert' FROM customer WHERE c_custkey < 10")
def tbl_changelog(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that differ between two snapshots."""
    t = _copy(spark, sf, "customer")
    first = t.state()["current"]
    t.delete(F.col("c_acctbal") > 9000, mode="cow")
    t.append(table(spark, sf, "customer").filter("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return t.changes(first).select("c_custkey", "_change")


@R.add("tbl_add_column_default", "SELECT *, 7::INT AS rank FROM nation UNION ALL SELECT *, NULL FROM nation WHERE n_nationkey < 3")
def tbl_add_column_default(spark: SparkSession, sf: str) -> DataFrame:
    """ADD COLUMN with a default: old rows have it, new rows have what they say."""
    t = _copy(spark, sf, "nation")
    t.add_column("rank", "int", default=7)
    t.append(table(spark, sf, "nation").filter("n_nationkey < 3").withColumn("rank", F.lit(None).cast("int")))
    return t.read()


@R.add("tbl_rename_drop_column", "SELECT n_nationkey AS k, n_regionkey, NULL::VARCHAR AS n_name FROM nation")
def tbl_rename_drop_column(spark: SparkSession, sf: str) -> DataFrame:
    """RENAME, DROP and ADD under an old name: nothing of the dropped column comes back."""
    t = _copy(spark, sf, "nation")
    t.rename_column("n_nationkey", "k")
    t.drop_column("n_name")
    t.add_column("n_name", "string")
    return t.read()


@R.add("tbl_widen_column", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT 5000000000, 'FAR'")
def tbl_widen_column(spark: SparkSession, sf: str) -> DataFrame:
    """A safe type change."""
    t = _copy(spark, sf, "region")
    t.widen_column("r_regionkey", "bigint")
    t.append(spark.createDataFrame([(5000000000, "FAR")], "r_regionkey bigint, r_name string"))
    return t.read()


def _pruned(name: str, source: str, spec: str, where, sql: str) -> None:
    @R.add(name, f"SELECT *, true AS pruned FROM {source} WHERE {sql}")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = _copy(spark, sf, source, spec)
        read, all_ = t.plan_files(where).count(), t.files().count()
        return t.read(where).withColumn("pruned", F.lit(read < all_))

    run.__doc__ = f"Files pruned by {spec}."


_pruned("tbl_partition_day_prune", "events", "day(ts)", [("ts", ">=", "2024-01-10 00:00:00"), ("ts", "<", "2024-01-12 06:00:00")], "ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 06:00:00'")
_pruned("tbl_partition_hour_prune", "events", "hour(ts)", [("ts", "<", "2024-01-01 05:00:00")], "ts < TIMESTAMP '2024-01-01 05:00:00'")
_pruned("tbl_partition_month_prune", "orders", "month(o_orderdate)", [("o_orderdate", "=", "1997-03-05 00:00:00")], "o_orderdate = TIMESTAMP '1997-03-05 00:00:00'")
_pruned("tbl_partition_year_prune", "orders", "year(o_orderdate)", [("o_orderdate", ">", "2000-12-30 00:00:00")], "o_orderdate > TIMESTAMP '2000-12-30 00:00:00'")
_pruned("tbl_partition_bucket_prune", "orders", "bucket(16, o_custkey)", [("o_custkey", "=", 42)], "o_custkey = 42")
_pruned("tbl_partition_truncate", "customer", "truncate(50, c_custkey)", [("c_custkey", "<", 40)], "c_custkey < 40")
_pruned("tbl_partition_identity", "customer", "c_mktsegment", [("c_mktsegment", "in", ["BUILDING", "MACHINERY"])], "c_mktsegment IN ('BUILDING', 'MACHINERY')")
_pruned("tbl_partition_multi", "events", "day(ts), bucket(4, user_id)", [("ts", "<", "2024-01-03 00:00:00"), ("user_id", "=", 7)], "ts < TIMESTAMP '2024-01-03 00:00:00' AND user_id = 7")
_pruned("tbl_condition_prune", "events", "day(ts)", "ts BETWEEN TIMESTAMP_NTZ '2024-01-04 00:00:00' AND TIMESTAMP_NTZ '2024-01-03 00:00:00' + INTERVAL '2' DAY OR (NOT ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' AND upper(event_type) = 'CLICK')", "ts BETWEEN TIMESTAMP '2024-01-04 00:00:00' AND TIMESTAMP '2024-01-05 00:00:00' OR (ts >= TIMESTAMP '2024-01-20 00:00:00' AND upper(event_type) = 'CLICK')")
_pruned("tbl_partition_truncate_text", "customer", "truncate(4, c_mktsegment)", "c_mktsegment LIKE 'BUIL%' OR c_mktsegment = 'FURNITURE'", "c_mktsegment LIKE 'BUIL%' OR c_mktsegment = 'FURNITURE'")


@R.add("tbl_partition_void", "SELECT *, 1 AS parts FROM nation WHERE n_nationkey < 4")
def tbl_partition_void(spark: SparkSession, sf: str) -> DataFrame:
    """A void transform puts every row into one partition and prunes nothing away."""
    t = _copy(spark, sf, "nation", "void(n_regionkey)")
    return t.read("n_nationkey < 4").withColumn("parts", F.lit(t.files().select(F.to_json("partition")).distinct().count()))


@R.add("tbl_delete_prune", "SELECT *, true AS few FROM orders WHERE o_orderkey NOT BETWEEN 100 AND 120")
def tbl_delete_prune(spark: SparkSession, sf: str) -> DataFrame:
    """A delete opens only the files that its own condition may hit."""
    t = Table.create(spark, fresh_path(spark, "tbl-prune"), table(spark, sf, "orders").schema)
    t.append(table(spark, sf, "orders").repartitionByRange(8, "o_orderkey"))
    few = t.plan_files("o_orderkey BETWEEN 100 AND 120").count() <= 2
    t.delete("o_orderkey BETWEEN 100 AND 120", mode="mor")
    return t.read().withColumn("few", F.lit(few))


@R.add("tbl_bounds_prune", "SELECT *, true AS pruned FROM orders WHERE o_orderkey BETWEEN 100 AND 120")
def tbl_bounds_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Files pruned by column bounds alone."""
    t = Table.create(spark, fresh_path(spark, "tbl-bounds"), table(spark, sf, "orders").schema)
    t.append(table(spark, sf, "orders").repartitionByRange(8, "o_orderkey"))
    where = [("o_orderkey", ">=", 100), ("o_orderkey", "<=", 120)]
    return t.read(where).withColumn("pruned", F.lit(t.plan_files(where).count() < t.files().count()))


@R.add("tbl_evolve_spec", "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND user_id = 9 UNION ALL SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND user_id = 9")
def tbl_evolve_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two partition specs in one table."""
    t = _copy(spark, sf, "events", "day(ts)")
    t.set_partitioning("bucket(8, user_id)")
    t.append(table(spark, sf, "events"))
    return t.read([("ts", ">=", "2024-01-20 00:00:00"), ("user_id", "=", 9)])


@R.add("tbl_compact", "SELECT o_orderkey, o_totalprice, true AS fewer FROM orders WHERE o_orderkey % 50 <> 7")
def tbl_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Compaction of many small files with position deletes."""
    t = Table.create(spark, fresh_path(spark, "tbl-compact"), table(spark, sf, "orders").schema)
    t.append(table(spark, sf, "orders").repartition(16))
    t.delete(F.col("o_orderkey") % 50 == 7, mode="mor")
    before = t.files().count()
    t.compact()
    return t.read().select("o_orderkey", "o_totalprice").withColumn("fewer", F.lit(t.files().count() < before))


@R.add("tbl_expire", "SELECT 2 AS expired, true AS removed, count(*) AS n FROM nation WHERE n_nationkey >= 5")
def tbl_expire(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot expiry and orphan removal leave the current rows alone."""
    t = _copy(spark, sf, "nation")
    t.delete(F.col("n_nationkey") < 5, mode="cow")
    t.rewrite_manifest()
    expired, removed = t.expire_snapshots(1), t.remove_orphans()
    return t.read().agg(F.count("*").alias("n")).withColumns({"expired": F.lit(expired), "removed": F.lit(removed > 0)})


@R.add("tbl_row_ids", "SELECT count(*) AS n, count(*) AS ids FROM customer")
def tbl_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Row ids are unique."""
    return _copy(spark, sf, "customer").row_ids().agg(F.count("*").alias("n"), F.count_distinct("_row_id").alias("ids"))


@R.add("tbl_clamp_out_of_range", "SELECT o_orderkey, least(greatest(o_totalprice, 1000), 200000) AS o_totalprice FROM orders")
def tbl_clamp_out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside a range are clamped on their way in."""
    from lakeloom.table.validation import enforce

    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    t = Table.create_as(enforce(o, {"o_totalprice": (1000.0, 200000.0)}, "clamp"), fresh_path(spark, "tbl-clamp"))
    return t.read()


@R.add("tbl_files_metadata", "SELECT (date_trunc('day', ts)::DATE - DATE '1970-01-01')::VARCHAR AS day, count(*) AS row_count, true AS sized FROM events GROUP BY ALL")
def tbl_files_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a table with their partition values, rows and sizes, by partition."""
    f = _copy(spark, sf, "events", "day(ts)").files()
    return f.groupBy(F.col("partition")["ts_day"].alias("day")).agg(F.sum("row_count").alias("row_count"), (F.min("file_size") > 0).alias("sized"))


@R.add("tbl_size", "SELECT true AS same, true AS some")
def tbl_size(spark: SparkSession, sf: str) -> DataFrame:
    """Size of a table: the sum over its files as they are on disk."""
    t = _copy(spark, sf, "orders")
    disk = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{t.location}/data").agg(F.sum("length").alias("n"))
    return disk.select((F.col("n") == t.size()).alias("same"), (F.col("n") > 0).alias("some"))


@R.add("tbl_set_default", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'NEW' UNION ALL SELECT 101, NULL")
def tbl_set_default(spark: SparkSession, sf: str) -> DataFrame:
    """SET DEFAULT holds for later inserts only; DROP DEFAULT ends it."""
    t = _copy(spark, sf, "region")
    t.set_default("r_name", "NEW")
    t.append(spark.createDataFrame([(100,)], "r_regionkey int"))
    t.set_default("r_name", None)
    t.append(spark.createDataFrame([(101,)], "r_regionkey int"))
    return t.read()


@R.add("tbl_drop_not_null", "SELECT r_regionkey, r_name, true AS refused FROM region UNION ALL SELECT NULL, 'NOWHERE', true")
def tbl_drop_not_null(spark: SparkSession, sf: str) -> DataFrame:
    """NOT NULL is kept until it is dropped."""
    r = table(spark, sf, "region")
    kind = T.StructType([T.StructField("r_regionkey", T.IntegerType(), False), T.StructField("r_name", T.StringType())])
    t, nowhere = Table.create(spark, fresh_path(spark, "tbl-null"), kind), spark.createDataFrame([(None, "NOWHERE")], "r_regionkey int, r_name string")
    t.append(r)
    try:
        t.append(nowhere)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "null value" in str(e)
    t.drop_not_null("r_regionkey")
    t.append(nowhere)
    return t.read().withColumn("refused", F.lit(refused))


@R.add("tbl_drop", "SELECT 2 AS before, 1 AS after, 1 AS purged, true AS gone, count(*) AS n FROM nation")
def tbl_drop(spark: SparkSession, sf: str) -> DataFrame:
    """DROP TABLE: the name goes at once, the files with the next purge, other tables stay."""
    from lakeloom.sources.io import file_exists
    from lakeloom.table.catalog import Catalog

    c, n = Catalog(spark, fresh_path(spark, "catalog")), table(spark, sf, "nation")
    with c.transaction() as tx:
        tx.create("keep", n.schema).append(n)
        tx.create("lose", n.schema).append(n)
    place, before = c.table("lose").location, len(c.names())
    c.drop("lose")
    after, purged = len(c.names()), c.purge()
    return c.read("keep").agg(F.count("*").alias("n")).withColumns({"before": F.lit(before), "after": F.lit(after), "purged": F.lit(purged), "gone": F.lit(not file_exists(spark, place))})


@R.add("tbl_unsupported", "SELECT * FROM (VALUES ('merge', 'NotImplementedError'), ('narrow a type', 'ValueError'), ('unknown column', 'ValueError'), ('unknown table', 'ValueError'), ('unknown transform', 'ValueError')) v(statement, raised)")
def tbl_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that tables do not take raise, and change nothing."""
    from lakeloom.table.catalog import Catalog

    t = _copy(spark, sf, "region")
    tries = {
        "merge": lambda: t.merge(), "narrow a type": lambda: t.widen_column("r_regionkey", "smallint"), "unknown column": lambda: t.update({"zz": F.lit(1)}, F.lit(True)),
        "unknown table": lambda: Catalog(spark, fresh_path(spark, "catalog")).table("none"), "unknown transform": lambda: t.set_partitioning("week(r_name)"),
    }
    said = []
    for what, do in tries.items():
        try:
            do()
            said.append((what, "nothing"))
        except Exception as e:  # noqa: BLE001
            said.append((what, type(e).__name__))
    return spark.createDataFrame(said, "statement string, raised string")


@R.add("tbl_many_commits", "SELECT n_nationkey, count(*) AS n, true AS merged FROM nation, range(7) GROUP BY ALL")
def tbl_many_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of many small commits are merged on the way."""
    n = table(spark, sf, "nation")
    t = Table.create(spark, fresh_path(spark, "tbl-many"), n.schema, properties={"merge_manifests": 3})
    for _ in range(7):
        t.append(n)
    held = len(t._snapshot(t.state())["manifests"])
    return t.read().groupBy("n_nationkey").agg(F.count("*").alias("n")).withColumn("merged", F.lit(held <= 3))


@R.add("tbl_column_stats", "SELECT 'o_orderkey' AS column, min(o_orderkey)::VARCHAR AS lower, max(o_orderkey)::VARCHAR AS upper, 0::BIGINT AS nulls FROM orders")
def tbl_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of a column over all files, from the manifest only."""
    s = _copy(spark, sf, "orders").column_stats().filter("column = 'o_orderkey'")
    return s.groupBy("column").agg(F.min(F.col("lower").cast("bigint")).cast("string").alias("lower"), F.max(F.col("upper").cast("bigint")).cast("string").alias("upper"), F.sum("nulls").alias("nulls"))


@R.add("tbl_snapshots", "SELECT * FROM (VALUES (1::BIGINT, 'append'), (2, 'delete'), (3, 'truncate')) v(snapshot_id, operation)")
def tbl_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The history of a table."""
    t = _copy(spark, sf, "nation")
    t.delete(F.col("n_nationkey") < 5)
    t.truncate()
    return t.snapshots().select("snapshot_id", "operation")


@R.add("tbl_modifying_cte", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def tbl_modifying_cte(spark: SparkSession, sf: str) -> DataFrame:
    """DELETE ... RETURNING into another table, in one transaction."""
    from lakeloom.table.catalog import Catalog

    c, n = Catalog(spark, fresh_path(spark, "catalog")), table(spark, sf, "nation")
    with c.transaction() as tx:
        tx.create("t", n.schema).append(n)
        tx.create("archive", "n_nationkey int, n_name string")
    with c.transaction() as tx:
        tx.table("archive").append(tx.table("t").delete(F.col("n_regionkey") == 2, returning=True).select("n_nationkey", "n_name"))
    return c.read("archive")


@R.add("tbl_load_from", "SELECT * FROM supplier")
def tbl_load_from(spark: SparkSession, sf: str) -> DataFrame:
    """A table with the definition and rows of a file."""
    return Table.from_files(spark, fresh_path(spark, "tbl-load"), f"{sf}/supplier.parquet").read()


@R.add("tbl_vacuum", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def tbl_vacuum(spark: SparkSession, sf: str) -> DataFrame:
    """Compaction, expiry and orphan removal, then a read."""
    t = _copy(spark, sf, "orders")
    t.delete(F.col("o_orderkey") % 3 == 0, mode="mor")
    t.vacuum()
    return t.read().select("o_orderkey")


@R.add("tbl_transaction", "SELECT n_nationkey, n_name, 'moved' AS place FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_name, 'left' FROM nation WHERE n_regionkey <> 1")
def tbl_transaction(spark: SparkSession, sf: str) -> DataFrame:
    """Rows moved from one table to another in one transaction; one that fails leaves no trace."""
    from lakeloom.table.catalog import Catalog

    c, n = Catalog(spark, fresh_path(spark, "catalog")), table(spark, sf, "nation")
    with c.transaction() as tx:
        tx.create("a", n.schema).append(n)
        tx.create("b", n.schema)
    try:
        with c.transaction() as tx:
            tx.table("a").truncate()
            raise KeyError("changed our mind")
    except KeyError:
        pass
    with c.transaction() as tx:
        tx.table("b").append(tx.table("a").delete(F.col("n_regionkey") == 1, returning=True))
    place = lambda name, x: c.read(name).select("n_nationkey", "n_name", F.lit(x).alias("place"))
    return place("b", "moved").unionAll(place("a", "left"))
