"""Streaming forms of the chunked trajectory; an extension."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path


def instant(events: DataFrame) -> F.Column:
    """The time column as a timestamp; left as it is where it is one, or it would lose its watermark."""
    return F.col("ts") if dict(events.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")


def chunked(events: DataFrame, size: str = "4 hours") -> DataFrame:
    """Count and sum in micrometres for each user and tumbling window; for tables and streams alike."""
    start = F.window(instant(events), size)
    grouped = events.groupBy("user_id", start.alias("w")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1_000_000).cast("long")).alias("s_um"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "s_um")


def stream(spark: SparkSession, path: str, late: str = "1 hour", size: str = "4 hours") -> DataFrame:
    """A stream over a folder's Parquet files with a watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return chunked(rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), size)


def run_to_end(spark: SparkSession, path: str) -> DataFrame:
    """All windows of all files that are there now, through a streaming query that ends by itself."""
    if not path.endswith(".parquet"):
        raise ValueError("a Parquet file or folder is expected")
    name, out = f"chunks_{uuid.uuid4().hex}", fresh_path(spark, "chunks")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path if is_folder(spark, path) else path + "*")
    query = chunked(rows).writeStream.queryName(name).outputMode("complete").option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.parquet(f"{out}/{last['batchId'] if last else 0}")


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events without a pause of ``gap``; for tables and streams alike."""
    grouped = events.groupBy("user_id", F.session_window(instant(events), gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")
