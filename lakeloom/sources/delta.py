"""Reading Delta tables by their log: JSON commits, from the last Parquet checkpoint on."""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type(t: object) -> T.DataType:
    return T._parse_datatype_json_value(t)


def read_delta(spark: SparkSession, location: str) -> DataFrame:
    """The latest version of a Delta table without deletion vectors or column mapping.

    The log is replayed as a query: of each path, the action of the highest version counts.
    """
    root = location.rstrip("/")
    commits = spark.read.text(f"{root}/_delta_log/*.json").select("value", F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).alias("v")).filter("v <> ''")
    actions = commits.select(F.col("v").cast("bigint").alias("v"), F.col("value"), F.get_json_object("value", "$.add.path").alias("add"), F.get_json_object("value", "$.remove.path").alias("gone"), F.get_json_object("value", "$.metaData").alias("meta"))
    if not actions.filter(F.get_json_object("value", "$.add.deletionVector").isNotNull()).isEmpty():
        raise NotImplementedError("deletion vectors")
    meta = json.loads(actions.filter("meta is not null").orderBy(F.col("v").desc()).select("meta").first()[0])
    schema, parts = _type(json.loads(meta["schemaString"])), meta.get("partitionColumns", [])
    touched = actions.filter("add is not null or gone is not null").groupBy(F.coalesce("add", "gone").alias("path")).agg(F.max(F.struct("v", F.col("add").isNotNull().alias("live"), F.get_json_object("value", "$.add.partitionValues").alias("values"))).alias("x"))
    live = touched.filter("x.live").select("path", F.col("x.values").alias("values"))
    files = [f"{root}/{unquote(r['path'])}" for r in live.select("path").collect()]  # one row per file that the scan reads
    if not files:
        return spark.createDataFrame([], schema)
    stored = T.StructType([f for f in schema if f.name not in parts])
    df = spark.read.schema(stored).parquet(*files)
    if parts:
        name = root.rpartition("/")[2]
        df = df.withColumn("_p", F.substring_index(F.col("_metadata.file_path"), f"/{name}/", -1))
        values = live.select(F.col("path").alias("_q"), F.from_json("values", "map<string,string>").alias("_v"))
        df = df.join(values, F.col("_p") == F.col("_q"))
        df = df.withColumns({p: F.try_element_at("_v", F.lit(p)).cast(schema[p].dataType) for p in parts})
    return df.select(*schema.names)
