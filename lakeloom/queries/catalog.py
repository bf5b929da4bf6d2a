"""Queries over the lake's catalog tables: small files, hierarchies, drift, nested schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import drift, hierarchy, nested, small_files
from lakeloom.registry import Registry
from lakeloom.shared import fresh_path, materialize
from lakeloom.sources.tables import table

R = Registry()

_CLIMB = """
WITH RECURSIVE n AS (SELECT table_name, field_id, min(parent_field_id) AS p FROM field_id_mappings WHERE field_id IS NOT NULL GROUP BY ALL),
l AS (SELECT n.table_name, n.field_id, m.field_id AS p FROM n LEFT JOIN n m ON m.table_name = n.table_name AND m.field_id = n.p),
up AS (SELECT table_name, field_id, field_id AS cur, 0 AS d, [field_id] AS path FROM l
 UNION ALL SELECT up.table_name, up.field_id, l.p, d + 1, list_prepend(l.p, path) FROM up JOIN l ON l.table_name = up.table_name AND l.field_id = up.cur WHERE l.p IS NOT NULL AND NOT list_contains(path, l.p)),
done AS (SELECT up.* FROM up JOIN l ON l.table_name = up.table_name AND l.field_id = up.cur WHERE l.p IS NULL)
"""


@R.add(
    "p3_found",
    _CLIMB + "SELECT n.table_name, n.field_id, coalesce(cur, -1)::INT AS root_field_id, coalesce(d, -1)::INT AS field_depth FROM n LEFT JOIN done USING (table_name, field_id)",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every field; -1 for fields whose links never end at a root."""
    r = hierarchy.resolve_hierarchy(table(spark, sf, "field_id_mappings"), "field_id", "parent_field_id", "table_name")
    return r.select("table_name", "field_id", F.coalesce("root", F.lit(-1)).alias("root_field_id"), F.coalesce("depth", F.lit(-1)).alias("field_depth"))


@R.add("p3_paths", _CLIMB + "SELECT table_name, field_id, array_to_string(path, '/') AS path, cur::INT AS root_field_id, d::INT AS field_depth FROM done")
def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path from the root to each field that has a root."""
    r = hierarchy.resolve_hierarchy(table(spark, sf, "field_id_mappings"), "field_id", "parent_field_id", "table_name", paths=True)
    return r.filter(F.col("root").isNotNull()).select("table_name", "field_id", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"), F.col("root").alias("root_field_id"), F.col("depth").alias("field_depth"))


@R.add(
    "p3_descendants",
    _CLIMB + "SELECT * FROM (SELECT table_name, unnest(path)::INT AS ancestor, field_id AS descendant, unnest(range(d, -1, -1))::INT AS steps FROM done) WHERE steps > 0",
)
def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every field below every field whose links end at a root, with the number of steps between them."""
    r = hierarchy.resolve_hierarchy(table(spark, sf, "field_id_mappings"), "field_id", "parent_field_id", "table_name", paths=True)
    return hierarchy.descendants(r, "field_id", "table_name")


@R.add(
    "p3_all_descendants",
    _CLIMB + ", ring AS (SELECT DISTINCT up.table_name, up.field_id FROM up JOIN l ON l.table_name = up.table_name AND l.field_id = up.cur WHERE l.p = up.field_id) "
    "SELECT up.table_name, cur::INT AS ancestor, up.field_id AS descendant, d::INT AS steps, ring.field_id IS NOT NULL AS in_cycle FROM up LEFT JOIN ring ON ring.table_name = up.table_name AND ring.field_id = cur WHERE d > 0",
)
def p3_all_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every field below every field, on and below cycles too, with the fewest steps between them."""
    return hierarchy.all_descendants(table(spark, sf, "field_id_mappings"), "field_id", "parent_field_id", "table_name")


_NODES = """
WITH RECURSIVE ok AS (SELECT table_name, metadata::JSON AS m FROM iceberg_metadata WHERE json_valid(metadata)),
s AS (SELECT table_name, unnest(CASE WHEN json_type(m->'$.schemas') = 'ARRAY' THEN (m->'$.schemas[*]')::JSON[] ELSE []::JSON[] END) AS s FROM ok
 UNION ALL SELECT table_name, m->'$.schema' FROM ok WHERE json_type(m->'$.schema') = 'OBJECT'),
n AS (SELECT DISTINCT table_name, coalesce(s->>'$."schema-id"', '0')::INT AS schema_id, 0 AS parent_field_id, NULL::INT AS field_id, NULL::VARCHAR AS name, s AS t FROM s
 UNION SELECT table_name, schema_id, coalesce(field_id, 0), (k->>'$.id')::INT, k->>'$.name', CASE WHEN json_type(k->'$.t') = 'VARCHAR' AND ltrim(k->>'$.t') LIKE '{%' THEN (k->>'$.t')::JSON ELSE k->'$.t' END
 FROM (SELECT table_name, schema_id, field_id, unnest(CASE t->>'$.type'
   WHEN 'struct' THEN [json_object('id', f->'$.id', 'name', f->'$.name', 't', f->'$.type') FOR f IN (t->'$.fields[*]')::JSON[]]
   WHEN 'list' THEN [json_object('id', t->'$."element-id"', 'name', 'element', 't', t->'$.element')]
   WHEN 'map' THEN [json_object('id', t->'$."key-id"', 'name', 'key', 't', t->'$.key'), json_object('id', t->'$."value-id"', 'name', 'value', 't', t->'$.value')]
   ELSE []::JSON[] END) AS k FROM n WHERE json_type(t) = 'OBJECT')),
nodes AS (SELECT DISTINCT table_name, schema_id, field_id, parent_field_id, name, CASE WHEN json_type(t) = 'OBJECT' THEN t->>'$.type' ELSE lower(regexp_replace(t->>'$', '\\s', '', 'g')) END AS type FROM n WHERE field_id IS NOT NULL)
"""


@R.add("p5_found", _NODES + "SELECT DISTINCT table_name, schema_id, field_id, parent_field_id FROM nodes")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with an id of every schema, tied to the node around it."""
    return nested.flatten_schemas(table(spark, sf, "iceberg_metadata"), columns=["table_name", "schema_id", "field_id", "parent_field_id"])


_DETAIL = "`snapshots` array<struct<`snapshot-id`:bigint, `timestamp-ms`:bigint, `summary`:struct<`operation`:string>>>"


@R.add(
    "p5_snapshots",
    "SELECT DISTINCT metadata_id, (i - 1)::INT AS nth, (s->>'$.\"snapshot-id\"')::BIGINT AS snapshot_id, s->>'$.summary.operation' AS operation FROM "
    "(SELECT metadata_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS s FROM (SELECT metadata_id, (metadata::JSON->'$.snapshots[*]')::JSON[] AS a FROM iceberg_metadata WHERE json_valid(metadata)))",
)
def p5_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots nested in each record as a table of their own, with the place in the list around them."""
    m = table(spark, sf, "iceberg_metadata").filter(F.try_parse_json("metadata").isNotNull())
    typed = m.select("metadata_id", F.from_json("metadata", _DETAIL).alias("doc"))
    t = nested.flatten_records(typed, ["metadata_id"])["doc.snapshots"]
    return t.select("metadata_id", F.col("_pos")[0].alias("nth"), F.col("`doc.snapshots.snapshot-id`").alias("snapshot_id"), F.col("`doc.snapshots.summary.operation`").alias("operation")).distinct()


@R.add("p5_fields", _NODES + "SELECT table_name, schema_id, field_id, parent_field_id, name, type FROM nodes")
def p5_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The same flat rows with each node's name and type."""
    return nested.flatten_schemas(table(spark, sf, "iceberg_metadata"))


_DRIFT = _NODES + """
, v AS (SELECT table_name, schema_id, lag(schema_id) OVER (PARTITION BY table_name ORDER BY schema_id) AS p FROM (SELECT DISTINCT table_name, schema_id FROM nodes)),
c AS (SELECT v.table_name, v.schema_id, v.p, n.field_id, n.name, n.type FROM v JOIN nodes n USING (table_name, schema_id) WHERE p IS NOT NULL),
o AS (SELECT v.table_name, v.schema_id, v.p, n.field_id, n.name, n.type FROM v JOIN nodes n ON n.table_name = v.table_name AND n.schema_id = v.p),
j AS (SELECT coalesce(c.table_name, o.table_name) AS table_name, coalesce(c.schema_id, o.schema_id) AS schema_id, coalesce(c.p, o.p) AS previous_schema_id, coalesce(c.field_id, o.field_id) AS field_id,
 c.field_id AS cf, o.field_id AS of, c.name AS cn, o.name AS on_, c.type AS ct, o.type AS ot
 FROM c FULL JOIN o ON c.table_name = o.table_name AND c.schema_id = o.schema_id AND c.field_id = o.field_id),
changes AS (SELECT table_name, schema_id, previous_schema_id, field_id, 'added' AS change_kind, NULL AS before, cn AS after FROM j WHERE of IS NULL
 UNION ALL SELECT table_name, schema_id, previous_schema_id, field_id, 'dropped', on_, NULL FROM j WHERE cf IS NULL
 UNION ALL SELECT table_name, schema_id, previous_schema_id, field_id, 'renamed', on_, cn FROM j WHERE cf IS NOT NULL AND of IS NOT NULL AND cn IS DISTINCT FROM on_
 UNION ALL SELECT table_name, schema_id, previous_schema_id, field_id, 'retyped', ot, ct FROM j WHERE cf IS NOT NULL AND of IS NOT NULL AND ct <> ot)
"""


@R.add("p4_found", _DRIFT + "SELECT table_name, schema_id, field_id, change_kind FROM changes")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every added, dropped, renamed or retyped field: the edit scripts from each schema to the next, without their moves."""
    c = drift.schema_changes(table(spark, sf, "iceberg_metadata"))
    return c.filter("change_kind <> 'moved'").select("table_name", "schema_id", "field_id", "change_kind").distinct()


@R.add(
    "p4_changes",
    _DRIFT + "SELECT * FROM changes UNION ALL SELECT c.table_name, c.schema_id, c.p, c.field_id, 'moved', o.parent_field_id::VARCHAR, c.parent_field_id::VARCHAR "
    "FROM (SELECT v.table_name, v.schema_id, v.p, n.field_id, n.parent_field_id FROM v JOIN nodes n USING (table_name, schema_id) WHERE p IS NOT NULL) c "
    "JOIN nodes o ON o.table_name = c.table_name AND o.schema_id = c.p AND o.field_id = c.field_id WHERE o.parent_field_id <> c.parent_field_id",
)
def p4_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The edit scripts, moves included, with what was before and after each change."""
    return drift.schema_changes(table(spark, sf, "iceberg_metadata"))


def _unified(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unify_rows(table(spark, sf, "raw_rows"), table(spark, sf, "iceberg_metadata"), keys=["raw_id", "path", "row_pos"])


_TARGETS = _NODES + """
, newest AS (SELECT table_name, (m->>'$."current-schema-id"')::INT AS id FROM (SELECT table_name, metadata::JSON AS m, recorded_time, metadata_id FROM iceberg_metadata WHERE json_valid(metadata))
 WHERE (m->>'$."current-schema-id"') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY recorded_time DESC, metadata_id DESC, id DESC) = 1),
versions AS (SELECT DISTINCT table_name, schema_id FROM nodes),
target AS (SELECT v.table_name, coalesce(max(v.schema_id) FILTER (WHERE v.schema_id = c.id), max(v.schema_id))::INT AS latest_schema_id FROM versions v LEFT JOIN newest c USING (table_name) GROUP BY v.table_name)
"""


@R.add(
    "p4_rows",
    _TARGETS + "SELECT DISTINCT r.raw_id, r.table_name, r.path, r.row_pos, r.schema_id, t.latest_schema_id, "
    "CASE WHEN json_valid(r.body) AND t.latest_schema_id IS NOT NULL THEN (SELECT count(*) FROM nodes n WHERE n.table_name = r.table_name AND n.schema_id = t.latest_schema_id AND n.parent_field_id = 0)::INT END AS fields, "
    "coalesce(v.schema_id IS NULL AND json_valid(r.body), false) AS unknown_schema FROM raw_rows r LEFT JOIN target t USING (table_name) LEFT JOIN versions v ON v.table_name = r.table_name AND v.schema_id = r.schema_id",
)
def p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All raw rows under the current schema of their table: which schema that is, and how many fields each row has."""
    u = _unified(spark, sf)
    return u.select("raw_id", "table_name", "path", "row_pos", "schema_id", "latest_schema_id", F.json_array_length(F.to_json(F.json_object_keys("row"))).alias("fields"), F.coalesce(F.contains("problem", F.lit("unknown schema")), F.lit(False)).alias("unknown_schema")).distinct()


@R.add(
    "p4_values",
    _TARGETS + ", at_top AS (SELECT * FROM nodes WHERE parent_field_id = 0 AND type = 'string') "
    "SELECT DISTINCT r.raw_id, w.field_id, w.name, json_extract_string(r.body, '$.\"' || o.name || '\"') AS value FROM raw_rows r JOIN target t USING (table_name) "
    "JOIN at_top o ON o.table_name = r.table_name AND o.schema_id = r.schema_id JOIN at_top w ON w.table_name = r.table_name AND w.schema_id = t.latest_schema_id AND w.field_id = o.field_id "
    "WHERE json_valid(r.body) AND json_extract_string(r.body, '$.\"' || o.name || '\"') IS NOT NULL",
)
def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Texts at the top of the unified rows, whatever their field was called when they were written."""
    nodes = nested.flatten_schemas(table(spark, sf, "iceberg_metadata")).filter("parent_field_id = 0 AND type = 'string'")
    u = _unified(spark, sf).select("raw_id", "table_name", "schema_id", "latest_schema_id", F.explode(F.from_json("row", "map<string,string>")).alias("name", "value")).filter("value IS NOT NULL")
    now = nodes.select(F.col("table_name").alias("t"), F.col("schema_id").alias("s"), "field_id", F.col("name").alias("n"))
    then = nodes.select(F.col("table_name").alias("t2"), F.col("schema_id").alias("s2"), F.col("field_id").alias("f2"))
    j = u.join(now, (F.col("table_name") == F.col("t")) & (F.col("latest_schema_id") == F.col("s")) & (F.col("name") == F.col("n")))
    j = j.join(then, (F.col("table_name") == F.col("t2")) & (F.col("schema_id") == F.col("s2")) & (F.col("field_id") == F.col("f2")), "left_semi")
    return j.select("raw_id", "field_id", "name", "value").distinct()


@R.add(
    "p4_table",
    _TARGETS + "SELECT count(DISTINCT raw_id) AS n, (SELECT count(*) FROM nodes n JOIN target t ON t.table_name = n.table_name AND t.latest_schema_id = n.schema_id WHERE n.table_name = 'telemetry.device_pings' AND n.parent_field_id = 0)::INT AS fields "
    "FROM raw_rows WHERE table_name = 'telemetry.device_pings'",
)
def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    """One table's rows, whatever version wrote them, as typed columns of its current schema."""
    t = drift.unify_table(_unified(spark, sf), table(spark, sf, "iceberg_metadata"), "telemetry.device_pings", keys=["raw_id"])
    return t.agg(F.count_distinct("raw_id").alias("n")).withColumn("fields", F.lit(len(t.columns) - 3))


_SMALL = r"""
WITH f AS (SELECT DISTINCT *, regexp_replace(regexp_replace(regexp_replace(url_decode(replace(regexp_replace(path, '^[A-Za-z0-9]+:/*', ''), '+', '%2B')), '/\./', '//', 'g'), '/\./', '//', 'g'), '//+', '/', 'g') AS obj FROM lake_files),
newest AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY table_name, obj ORDER BY updated_time DESC, id DESC) = 1),
small AS (SELECT * FROM newest WHERE content = 0 AND file_size < 402653184),
part AS (SELECT id, list_sort(list(DISTINCT {'f': partition_field_id, 'v': value}))::VARCHAR AS p FROM data_file_partition_values GROUP BY id),
g AS (SELECT s.*, coalesce(p, '') AS p FROM small s LEFT JOIN part USING (id)),
found AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY table_name, p) >= 5)
"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return small_files.consolidation_plan(small_files.small_files(table(spark, sf, "lake_files"), table(spark, sf, "data_file_partition_values")))


@R.add("p2_found", _SMALL + "SELECT id FROM found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the files whose blocks the consolidation plan copies into larger ones."""
    return _plan(spark, sf).select("id").distinct()


@R.add(
    "p2_plan",
    _SMALL + "SELECT table_name, count(*) AS files, sum(file_size)::BIGINT AS bytes, sum(CASE WHEN row_count >= 0 THEN row_count END)::BIGINT AS row_count FROM found GROUP BY ALL",
)
def p2_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Files, bytes and known rows that the planned outputs of each table take in; equal to those of the files replaced."""
    outputs = _plan(spark, sf).groupBy("table_name", "partition", "output").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.sum("row_count").alias("row_count"))
    return outputs.groupBy("table_name").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "row_count")])


@R.add(
    "p2_outputs",
    _SMALL + "SELECT table_name, count(*) AS files, count(*) AS placed, true AS bounded, true AS few FROM found GROUP BY ALL",
)
def p2_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The planned outputs by table: every file placed once, none above the target by more than half of its two outer files, and no more outputs than one beyond the bytes of each partition."""
    each = _plan(spark, sf).groupBy("table_name", "partition", "output").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum("file_size").alias("bytes"))
    parts = each.groupBy("table_name", "partition").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.max("bytes").alias("most"), F.count("*").alias("outputs"), F.sum("bytes").alias("bytes"))
    ok = F.bool_and(F.col("most") <= small_files.TARGET_BYTES + small_files.SMALL_BELOW), F.bool_and(F.col("outputs") <= F.floor(F.col("bytes") / small_files.TARGET_BYTES) + 1)
    return parts.groupBy("table_name").agg(F.sum("n").alias("files"), F.sum("ids").alias("placed"), ok[0].alias("bounded"), ok[1].alias("few"))


@R.add(
    "p2_block_copy",
    "SELECT 'orders' AS table_name, o_orderstatus AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, 0::BIGINT AS problems, true AS fewer, true AS counted FROM orders GROUP BY ALL "
    "UNION ALL SELECT 'customer', c_mktsegment, count(*), sum(c_custkey)::BIGINT, 0, true, true FROM customer GROUP BY ALL",
)
def p2_block_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Two partitioned tables written as many small files, registered, planned, merged by copying blocks, and read again by table and partition."""
    where, merged = fresh_path(spark, "scattered"), fresh_path(spark, "merged")
    tables = {"orders": ("o_orderstatus", "o_orderkey"), "customer": ("c_mktsegment", "c_custkey")}
    for name, (part, _) in tables.items():
        t = table(spark, sf, name)
        t.withColumn("p", F.col(part)).repartition(9).write.partitionBy("p").parquet(f"{where}/{name}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(where).select("path")
    files = files.join(small_files.list_footers(files), "path").select(F.xxhash64("path").alias("id"), "path", F.col("rows").alias("row_count"), F.col("bytes").alias("file_size"), F.regexp_extract("path", "/(orders|customer)/p=", 1).alias("table_name"), F.regexp_extract("path", "/p=([^/]*)/", 1).alias("value"))
    files = materialize(files.withColumns({"content": F.lit(0), "updated_time": F.lit(None).cast("timestamp_ntz")}), "registered")
    plan = materialize(small_files.consolidation_plan(small_files.small_files(files, files.select("id", F.lit(1).alias("partition_field_id"), "value"))), "plan")
    done = materialize(small_files.consolidate_parquet(plan, merged), "merged")
    made = done.groupBy("table_name", "partition").agg(F.count("path").alias("outputs"), F.sum("files").alias("inputs"), F.sum("rows").alias("rows"), F.count("problem").alias("problems"))
    paths, parts = {r["table_name"]: r["paths"] for r in done.groupBy("table_name").agg(F.collect_list("path").alias("paths")).collect()}, []  # one row per table
    for name, (part, key) in tables.items():
        t = spark.read.schema(table(spark, sf, name).schema).parquet(*paths[name])
        found = t.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"), F.sum(key).alias("keys")).withColumn("table_name", F.lit(name))
        one = made.filter(F.col("table_name") == name).select(F.get_json_object("partition", "$[0].v").alias("v"), "outputs", "inputs", "rows", "problems")
        parts.append(found.join(one, F.col("v") == F.concat(F.lit("="), F.col("part"))).select("table_name", "part", "n", "keys", "problems", (F.col("outputs") < F.col("inputs")).alias("fewer"), (F.col("rows") == F.col("n")).alias("counted")))
    return parts[0].unionAll(parts[1])
