"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the context's checkpoint folder; in local mode a new folder of this
    machine, elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: what follows reads one result, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vitrine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def single_rows(df: DataFrame, key: str) -> DataFrame | None:
    """``df`` where no key has several rows, so that nothing need be moved to bring a key's rows together; else None.  Only
    keys are counted.  A table in fewer pieces than there are cores is dealt anew."""
    counts = df.select(key, F.spark_partition_id().alias("__piece")).groupBy(key).agg(F.count("*").alias("n"), F.min("__piece").alias("piece"))
    most, pieces = counts.agg(F.max("n"), F.countDistinct("piece")).first()
    if (most or 0) > 1:
        return None
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if pieces >= cores else df.repartition(4 * cores, key)
