"""Continuous ingest with Structured Streaming: changed items, new media, idempotent replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vitrine.operators.upsert import latest, upsert


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class VersionedTable:
    """A keyed table below a folder, in buckets of the keys' hash.

    A version rewrites the buckets that its rows fall into; its manifest says in which version each bucket was written
    last.  A version is complete once its manifest is, so a batch that is replayed after a failure writes the same
    version again, and readers see whole versions only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _folder(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Complete versions, the oldest first."""
        target, files = self._folder("manifest")
        if not files.exists(target):
            return []
        found = [f.getPath().getName() for f in files.listStatus(target)]
        done = [int(n[1:]) for n in found if n.startswith("v") and self._done(n)]
        return sorted(done)

    def _done(self, name: str) -> bool:
        target, files = self._folder(f"manifest/{name}/_SUCCESS")
        return files.exists(target)

    def _places(self, before: int | None = None) -> dict[int, int]:
        """The version that holds each bucket, in the latest complete version (below ``before``)."""
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v{known[-1]}").collect()  # one for each bucket
        return {r["bucket"]: r["version"] for r in rows}

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _read(self, places: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v{version}/bucket={b}" for b, version in sorted(places.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def before(self, version: int, buckets: list[int]) -> DataFrame:
        """Some buckets of the state before a version."""
        return self._read({b: v for b, v in self._places(version).items() if b in set(buckets)})

    def write(self, version: int, df: DataFrame, keys: list[str], buckets: list[int]) -> None:
        """Write the new state of some buckets as a version, and drop versions that no later one reads any more."""
        df.withColumn("bucket", self.bucket(keys)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        places = self._places(version) | {b: version for b in buckets}
        table = self.spark.createDataFrame(sorted(places.items()), "bucket int, version long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v{version}")
        kept = set(self._versions()[-2:])  # the one before stays for readers that are at it
        needed = {x for v in kept for x in self._places(v + 1).values()} | kept
        for name, still in (("data", needed), ("manifest", kept)):
            target, files = self._folder(name)
            for entry in files.listStatus(target):
                number = entry.getPath().getName()[1:]
                if number.isdigit() and int(number) not in still and int(number) <= version:
                    files.delete(entry.getPath(), True)

    def read(self) -> DataFrame:
        return self._read(self._places())


def ingest(stream: DataFrame, table: VersionedTable, keys: list[str], modified: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Upsert what has arrived into a keyed table, batch by batch, until all is taken in.

    Of a key that arrives twice in a batch the latest row counts, rows that are not newer than the table's are left out,
    and a replayed batch gives the same version, so every key has one row.  A batch reads and rewrites only the buckets
    that its keys fall into.
    """

    def take(batch: DataFrame, number: int) -> None:
        fresh = latest(change(batch), keys, [F.col(modified)]).persist()
        try:
            touched = [r["b"] for r in fresh.select(table.bucket(keys).alias("b")).distinct().collect()]  # at most all buckets
            if not touched:
                return
            now = table.before(number, touched)
            known = now.select(*keys, F.col(modified).alias("__m"))
            newer = fresh.join(known, keys, "left").where(F.col("__m").isNull() | (F.col(modified) > F.col("__m"))).drop("__m")
            table.write(number, upsert(now, newer.select(*now.columns), keys), keys, touched)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fields_to_enrich(media: DataFrame, configured: DataFrame) -> DataFrame:
    """New image media (item_id, media_type) times the configured fields (property_id): what has to be filled in."""
    return media.where(F.col("media_type").startswith("image/")).crossJoin(F.broadcast(configured)).select("item_id", "property_id")


def trigger_enrichment(media: DataFrame, configured: DataFrame, table: VersionedTable, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """For every new image of a stream (item_id, media_type, ts), a row (item_id, property_id, ts) for each configured field.

    A file that arrives again within ``late`` is left out by the stream's own state, what that lets through by the keyed
    table, which keeps one row for each item and field.  Media older than the latest by more than ``late`` are left out.
    """
    fields = media.where(F.col("media_type").startswith("image/")).withWatermark("ts", late).crossJoin(F.broadcast(configured))
    fresh = fields.select("item_id", "property_id", "ts").dropDuplicatesWithinWatermark(["item_id", "property_id"])
    return ingest(fresh, table, ["item_id", "property_id"], "ts", checkpoint)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events (ts, event_type) per window and type; works on a stream, where later events than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
