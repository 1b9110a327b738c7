"""Structured Streaming over arriving files: appends that can be repeated, and running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.registry import query
from strandline.sources.tables import new_folder, table


def shared_folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def run_batches(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Write each micro-batch to its own folder and read all back with the column ``batch``.

    A batch that is run again after a failure overwrites its folder, so every row is written once.
    """
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, a few at a time. The path is a pattern, as a table can be one file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/{name}.parquet*")


@query("stream_append_once", "SELECT DISTINCT event_id, event_type FROM events")
def stream_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append rows whose key has not been seen: the keys seen are the stream's state, spread over all partitions."""
    seen = arriving(spark, sf_dir, "events").select("event_id", "event_type").dropDuplicates(["event_id", "event_type"])
    return run_batches(seen, shared_folder(spark), "append").drop("batch")


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(value) AS n_values FROM events GROUP BY ALL")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts by hour and type. Late rows count however late they are, so state is one row per hour and type; the last batch that changed it stands."""
    counts = arriving(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"))
    changed = run_batches(counts, shared_folder(spark), "update")
    return changed.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "n_values"), "batch").alias("v")).select("hour", "event_type", "v.*")
