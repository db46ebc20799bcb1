"""The folder that the driver and all executors share, and cutting lineage through it."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As the session names it in ``spark.checkpoint.dir``; one is chosen here only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            named = set_dir.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            named = "file:///tmp/scanloom-shared"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scanloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a DataFrame that ``saved`` returned, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/scanloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
