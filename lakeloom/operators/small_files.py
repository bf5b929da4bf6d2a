"""Far too many small files: which to consolidate, and the consolidation itself.

The plan finds, per table and partition, the groups with enough small files and assigns
each file to an output of about the target size. The rewrite then copies the encoded
column blocks of Parquet files as they are into the output and writes one new footer
with shifted offsets: no page is decompressed or decoded. Schemas, block counts and row
totals are validated before an output is published by a rename.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lakefiles import newest_files
from lakeloom.operators.ordered import join_groups, running_total
from lakeloom.shared import materialize
from lakeloom.sources import parquet_blocks

TARGET_BYTES = 536_870_912
#: A file is small below three quarters of the target size.
SMALL_BELOW = 402_653_184
MIN_GROUP = 5


def small_files(files: DataFrame, partition_values: DataFrame, *, small_below: int = SMALL_BELOW, min_group: int = MIN_GROUP) -> DataFrame:
    """The files worth consolidating: small newest data files whose (table, partition) has at least ``min_group`` of them.

    Columns: table_name, partition (text form of the set of (field, value)), id, path,
    file_size, row_count. Counting is combined before the shuffle; the files of a hot
    group are dealt out over salts when they meet their group.
    Defined cases: null sizes are unknown and not small; a file without partition values
    lies in the empty partition; a null value is a value of its own, apart from any text;
    unknown row counts (negative or null) come out as null.
    """
    small = newest_files(files).filter((F.col("content") == 0) & F.col("file_size").isNotNull() & (F.col("file_size") < small_below))
    pair = F.struct(F.col("partition_field_id").alias("f"), F.coalesce(F.concat(F.lit("="), F.col("value")), F.lit("null")).alias("v"))
    parts = partition_values.groupBy(F.col("id").alias("_id")).agg(F.to_json(F.sort_array(F.collect_set(pair))).alias("_partition"))
    placed = small.join(parts, F.col("id") == F.col("_id"), "left").withColumn("partition", F.coalesce("_partition", F.lit("[]")))
    placed = materialize(placed.select("table_name", "partition", "id", "path", "file_size", F.when(F.col("row_count") >= 0, F.col("row_count")).alias("row_count")), "small-files")
    many = placed.groupBy("table_name", "partition").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_group)
    return join_groups(placed, materialize(many, "groups"), ["table_name", "partition"], "_n", "id")


def consolidation_plan(candidates: DataFrame, *, target: int = TARGET_BYTES) -> DataFrame:
    """Adds ``output``: the number, within table and partition, of the output file that each file goes into.

    Files stand in the order of a hash of their id and fill outputs by their running
    total; a file goes where its middle falls, so an output holds ``target`` bytes give or
    take half a file at either end, and no file is split. The total is
    exact over groups of any size without one task seeing the whole group.
    """
    kept = materialize(candidates.withColumn("_h", F.xxhash64("id")), "candidates")
    total = running_total(kept, ["table_name", "partition"], "_h", "file_size", tie=("id",))
    return total.withColumn("output", F.floor((F.col("_before") + F.col("file_size") / 2) / target).cast("bigint")).drop("_h", "_before")


def consolidate_parquet(plan: DataFrame, directory: str) -> DataFrame:
    """Copy the files of each output of a plan into one new file in ``directory``.

    Takes the columns of :func:`consolidation_plan` (table_name, partition, output, path,
    row_count). Returns table_name, partition, output, path, files, blocks, rows, bytes,
    problem: one row per output file, and one per file that was left where it is.

    Validated are schemas (files whose schema differs from the first of the output go to a
    further file of the same output, so nothing is lost), the number of blocks and of rows
    of each output against its inputs, and each file's rows against the catalog's
    ``row_count`` where that is known. A file that cannot be read as Parquet, or whose
    rows the catalog counts otherwise, is named in ``problem`` and not copied. One task
    makes one output at a time and streams the blocks, so memory is that of a footer.
    Outputs are written under a temporary name and renamed after validation; a repeated
    task makes the same file again. Files of different tables or partitions never meet; a
    plan that lacks either column is refused. A null table name is a table of its own.
    """
    if lacking := [c for c in ("table_name", "partition", "output", "path", "row_count") if c not in plan.columns]:
        raise ValueError(f"not a consolidation plan, it lacks {lacking}")
    schema = "table_name string, partition string, output bigint, path string, files int, blocks int, rows bigint, bytes bigint, problem string"
    run_id = uuid.uuid4().hex[:12]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, part, output = (None if x is None or x != x else x for x in key)
        known = {p: None if n != n or n is None else int(n) for p, n in zip(pdf["path"], pdf["row_count"])}
        group = hashlib.sha256(repr((name, part)).encode()).hexdigest()[:16]
        made = parquet_blocks.merge_files(sorted(known), directory, f"part-{group}-{int(output):06d}-{run_id}", known)
        return pd.DataFrame([(name, part, output, *m) for m in made], columns=[c.split()[0] for c in schema.split(", ")]).astype({"output": "int64"})

    kept = plan.select(F.col("table_name").cast("string"), F.col("partition").cast("string"), F.col("output").cast("bigint"), "path", F.col("row_count").cast("bigint"))
    return kept.groupBy("table_name", "partition", "output").applyInPandas(one, schema)


def list_footers(paths: DataFrame) -> DataFrame:
    """path, rows, blocks, bytes of Parquet files, from their footers only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *parquet_blocks.summary(p)) for p in b["path"]], columns=["path", "rows", "blocks", "bytes"])

    return paths.select("path").mapInPandas(run, "path string, rows bigint, blocks int, bytes bigint")
