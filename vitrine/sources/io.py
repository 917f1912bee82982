"""Readers and writers of the formats that catalogs come in and leave as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Nested JSON documents, one or a list per file, with a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_result_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a ``custom_id``; blank and broken lines and those without a positive number as id are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("item_id", F.col("custom_id").try_cast("bigint")).where(F.col("item_id") > 0)


def item_values(lines: DataFrame, column: str = "json") -> DataFrame:
    """Item documents as JSON text to attribute rows: (item_id, term, value, uri), from properties that hold lists of
    value objects; other keys are left out."""
    entry = "array<struct<`@value`: string, `@id`: string>>"
    parsed = lines.select(
        F.get_json_object(column, "$['o:id']").try_cast("bigint").alias("item_id"),
        F.explode(F.from_json(column, "map<string, string>")).alias("term", "raw"),
    )
    listed = parsed.where(F.col("term").contains(":") & F.col("raw").startswith("["))
    return listed.select("item_id", "term", F.explode(F.from_json("raw", entry)).alias("v")).select(
        "item_id", "term", F.col("v.@value").alias("value"), F.col("v.@id").alias("uri")
    )


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header, columns in a fixed order; quotes are doubled."""
    df.select(*columns).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def suggestion_records(found: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One record per item: (item_id, suggestions array<struct<label, score, band, ...>>), best first.

    Of confidence, method and the methods' scores (``s_``) those are shown that the suggestions have, numbers to four
    decimals.  With ``items`` (item_id and other columns, such as a thumbnail) every item has a record, without
    suggestions an empty list, and keeps its columns.
    """
    shown = ["label", "score", "band", *[c for c in found.columns if c in ("confidence", "method") or c.startswith("s_")]]
    entries = F.array_sort(F.collect_list(F.struct("rank", *shown)))
    rows = found.groupBy(F.col("id").alias("item_id")).agg(entries.alias("e"))
    short = lambda x, c: F.round(x[c], 4) if c == "confidence" or c.startswith("s_") else x[c]
    records = rows.select("item_id", F.transform("e", lambda x: F.struct(*[short(x, c).alias(c) for c in shown])).alias("suggestions"))
    if items is None:
        return records
    none = F.array().cast(records.schema["suggestions"].dataType)
    return items.join(records, "item_id", "left").withColumn("suggestions", F.coalesce("suggestions", none))


def write_suggestions(found: DataFrame, path: str, items: DataFrame | None = None) -> None:
    """JSON lines, one item each."""
    suggestion_records(found, items).write.mode("overwrite").json(path)


def review_lines(records: DataFrame) -> DataFrame:
    """Text for reviewers: for each record (identifier, title, date, references) a head line and a line per reference."""
    head = F.concat(F.lit("== "), F.concat_ws(" | ", "identifier", "title", "date"))
    body = F.transform("references", lambda r: F.concat(F.lit("  - "), r["name"], F.lit(" ["), r["type"], F.lit("]")))
    return records.select(F.array_join(F.concat(F.array(head), body), "\n").alias("value"))


def sitemap(static: list[str], pages: DataFrame, items: DataFrame, host: str) -> DataFrame:
    """Addresses for crawlers: (loc, lastmod, freq, priority) of static paths, pages (slug) and items (id, modified,
    template_id: 2 works, 4 exhibitions).  Without a modification date it is today."""
    spark, today = pages.sparkSession, F.date_format(F.current_date(), "yyyy-MM-dd")
    fixed = spark.createDataFrame([(p,) for p in static], "path string").select(
        F.concat(F.lit(f"https://{host}/"), "path").alias("loc"), today.alias("lastmod"), F.lit("weekly").alias("freq"), F.lit("1.0").alias("priority")
    )
    own = pages.select(F.concat(F.lit(f"https://{host}/page/"), "slug").alias("loc"), today.alias("lastmod"), F.lit("monthly").alias("freq"), F.lit("0.6").alias("priority"))
    when = F.coalesce(F.date_format("modified", "yyyy-MM-dd"), today).alias("lastmod")

    def some(template: int, freq: str, priority: str) -> DataFrame:
        loc = F.concat(F.lit(f"https://{host}/item/"), F.col("id").cast("string")).alias("loc")
        return items.where(F.col("template_id") == template).select(loc, when, F.lit(freq).alias("freq"), F.lit(priority).alias("priority"))

    return fixed.unionByName(own).unionByName(some(2, "monthly", "0.8")).unionByName(some(4, "yearly", "0.7"))
