"""Helpers that several operators share: the shared scratch folder, written intermediate tables, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``, or where that is unset
    the checkpoint folder that the context was given.  There is no other place to fall back on."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        # one machine, one process: its own folder is shared
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is there yet."""
    return f"{shared_folder(spark)}/vitrine/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files go as soon as it has ended: what it wrote is read again, they are not."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: (the table, its path).

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and readers of one table see one
    result even where a task ran twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_removed(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, *keys: str, placed: bool = False, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder in as many buckets of ``keys`` as there are shuffle partitions, and read it back:
    (the table, its path).  What later meets it by these keys comes to it; the table itself is not moved again.
    ``placed``: the rows are in partitions by these keys already."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"vitrine_{uuid.uuid4().hex}"
    moved = df if placed else df.repartition(shuffle_width(spark), *keys)
    writer = moved.write.option("compression", compression).option("path", path)
    with _shuffles_removed(spark):
        writer.bucketBy(shuffle_width(spark), *keys).saveAsTable(table)
    back = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the table read above knows them
    return back, path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def whole_text(col: str | Column) -> Column:
    """A text with null taken as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
