"""Incremental forms of the operators on status streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.plans.lineage import checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table of a folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    batch = spark.read.parquet(path)
    files = batch.inputFiles()
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_batch)
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):  # a file: streams read folders, so its folder, by the file's name
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def latest_states(log: DataFrame) -> DataFrame:
    """Latest value per subject and kind, kept up to date: state is one row a key."""
    return log.groupBy("subject", "kind").agg(F.max_by("value", F.struct("logged_at", "record_id")).alias("value"))


def windowed_counts(log: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per kind in tumbling windows; windows close once the watermark has passed them."""
    return log.withWatermark("logged_at", late).groupBy(F.window("logged_at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Works off what is there and returns the result table. Offsets and state live in the session's shared checkpoint folder."""
    spark = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    job = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.table(name)
