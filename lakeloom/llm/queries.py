"""Queries of the operators for training data, with oracle SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import contamination, mixing, packing, truncation
from lakeloom.operators.lakefiles import newest_files
from lakeloom.registry import Registry
from lakeloom.sources.tables import table

R = Registry()


@R.add("p1_pack")
def p1_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The output file of every live data file, or piece of one, of every table."""
    live = newest_files(table(spark, sf, "lake_files")).filter("content = 0")
    return packing.pack(live, "table_name", "file_size", "id").withColumnRenamed("container", "output_file")


@R.add("p1_fill")
def p1_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per table: files, bytes, outputs used, and the outputs that the bytes need at least."""
    packed = p1_pack(spark, sf).filter("output_file is not null")
    out = packed.groupBy("table_name", "output_file").agg(F.sum("file_size").alias("bytes"), F.count("*").alias("pieces"))
    per = out.groupBy("table_name").agg(F.count("*").alias("outputs"), F.sum("bytes").alias("bytes"), F.sum("pieces").alias("pieces"), F.max("bytes").alias("fullest"))
    return per.withColumn("least_outputs", F.ceil(F.col("bytes") / packing.CAPACITY))


@R.add("p7_mix")
def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen documents of every mix with the number of their uses."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


@R.add("p7_shares")
def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share that each source reached in each mix."""
    return mixing.shares(*mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


@R.add("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with each benchmark item of which it holds a run of 13 words."""
    return contamination.leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@R.add("p6_overlap")
def p6_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each leaked item a document holds, and whether its beginning and its end are in it."""
    return contamination.leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"), detail=True)


@R.add("p6_items")
def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per leaked benchmark item, in how many documents it turned up."""
    return p6_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


@R.add("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whose text was cut before its end."""
    return truncation.cut_texts(table(spark, sf, "documents"))


@R.add("p8_sources")
def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts."""
    documents = table(spark, sf, "documents")
    return truncation.cut_shares(documents, truncation.cut_texts(documents))
