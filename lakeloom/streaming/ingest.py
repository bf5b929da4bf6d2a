"""Streams into tables: micro-batch append, windowed counts over event time, exactly-once by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.shared import fresh_path
from lakeloom.table.layer import Table


def stream_files(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:  # noqa: ANN001
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_stream(stream: DataFrame, table: Table, checkpoint: str, *, name: str | None = None, available_now: bool = True):
    """Append each micro-batch as one commit, each row exactly once.

    The number of the batch is committed in the same document as its rows, under the
    stream's name (by default its checkpoint folder): a batch that is run again after a
    failure, wherever that struck, is either seen there and skipped, or left no trace.
    """
    name = name or checkpoint

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, stream=(name, batch_id))

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Rows per tumbling window and key; windows close once the watermark has passed them."""
    timed = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    return timed.groupBy(F.window("_time", width).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").cast("timestamp_ntz").alias("start"), *keys, "n")


def run_once(result: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all that is there and return its last result."""
    out, state = {}, fresh_path(spark, "stream")

    def keep(batch: DataFrame, batch_id: int) -> None:
        path = fresh_path(spark, "stream-out")
        batch.write.parquet(path)
        out[batch_id] = path

    result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if not out:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(out[max(out)]) if mode == "complete" else spark.read.schema(result.schema).parquet(*out.values())
