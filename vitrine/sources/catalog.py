"""The catalog model: items described by entity-attribute-value rows, and an adapter from the sample star schema.

Tables (all DataFrames):
  resource   id, title, template_id, class_id, is_public, created, modified
  value      resource_id, property_id, value
  member     item_id, set_id            item_set   id, title
  media      id, item_id, position, storage_id
  link       item_id, target_id         exhibition id, title, start_date, venue
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Property ids of the catalog model: fixed values.
PROPERTIES = {
    "motif": 3, "date": 7, "work_type": 8, "identifier": 10, "transcription": 91, "height": 603, "support": 931, "width": 1129,
}


@dataclass
class Catalog:
    resource: DataFrame
    value: DataFrame
    member: DataFrame
    item_set: DataFrame
    media: DataFrame
    link: DataFrame
    exhibition: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the sample tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """Scan catalog tables that are stored as Parquet, one folder per table."""
    return Catalog(**{name: spark.read.parquet(f"{path}/{name}") for name in Catalog.__dataclass_fields__})


#: The numeric column by which each table is read in pieces.
KEYS = {"resource": "id", "value": "resource_id", "member": "item_id", "item_set": "id", "media": "id", "link": "item_id", "exhibition": "id"}


def read_table(spark: SparkSession, url: str, name: str, key: str, pieces: int = 8, driver: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A database table by JDBC, in ``pieces`` ranges of a numeric key, each read by its own task with its own connection.

    The database gives the key's bounds, which only divide the table: rows beyond them and null keys are read too.  What
    is filtered and selected later is pushed into the ranges' queries, so a high-water mark or a list of properties is
    looked up there.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if driver:
        reader = reader.option("driver", driver)
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    bounds = reader.option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {name}").load().first()
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(options or {}))
    if driver:
        reader = reader.option("driver", driver)
    if bounds[0] is not None and bounds[0] < bounds[1]:
        reader = reader.option("partitionColumn", key).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1] + 1)).option("numPartitions", str(pieces))
    found = reader.load()
    return found.toDF(*[c.lower() for c in found.columns])


def read_catalog_jdbc(spark: SparkSession, url: str, pieces: int = 8, driver: str | None = None, prefix: str = "", options: dict[str, str] | None = None) -> Catalog:
    """Scan catalog tables in a database; ``prefix`` stands before their names."""
    return Catalog(**{name: read_table(spark, url, f"{prefix}{name}", key, pieces, driver, options) for name, key in KEYS.items()})


def sample_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Map the sample tables to the catalog model: parts are items, their columns and the words of their names values,
    suppliers item sets, order lines media and links, orders exhibitions."""
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    first_year = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("l_partkey")
        .agg(F.year(F.min("o_orderdate")).cast("string").alias("y"))
    )
    resource = part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.lit(2).alias("template_id"),
        (F.col("p_size") % 4 + 1).alias("class_id"),
        (F.col("p_size") % 5 != 0).alias("is_public"),
        F.expr("timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, cast(p_partkey % 700 as int))").alias("created"),
        F.expr("timestamp'2021-01-01 00:00:00' + make_interval(0, 0, 0, cast(p_partkey % 500 as int))").alias("modified"),
    )
    fixed = part.select(
        F.col("p_partkey").alias("resource_id"),
        F.expr(
            "stack(5, 8, p_type, 931, p_brand, 603, cast(p_size as string),"
            " 1129, cast(cast(p_retailprice as decimal(12,2)) as string), 10, concat('N-', p_partkey))"
        ).alias("property_id", "value"),
    )
    motifs = part.select(
        F.col("p_partkey").alias("resource_id"), F.lit(3).alias("property_id"), F.explode(F.split("p_name", " ")).alias("value")
    )
    dates = part.join(first_year, part.p_partkey == first_year.l_partkey).select(
        F.col("p_partkey").alias("resource_id"),
        F.lit(7).alias("property_id"),
        F.when(F.col("p_partkey") % 17 == 0, "undated")
        .when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("c. "), "y"))
        .otherwise(F.col("y"))
        .alias("value"),
    )
    docs = table(spark, sf_dir, "documents")
    texts = part.join(docs, part.p_partkey == docs.doc_id).select(
        F.col("p_partkey").alias("resource_id"), F.lit(91).alias("property_id"), F.col("text").alias("value")
    )
    supplier = table(spark, sf_dir, "supplier")
    return Catalog(
        resource,
        fixed.unionByName(motifs).unionByName(dates).unionByName(texts),
        lines.select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("set_id")).distinct(),
        supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")),
        lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_linenumber").alias("position"),
            F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("storage_id"),
        ),
        lines.select(F.col("l_partkey").alias("item_id"), F.col("l_orderkey").alias("target_id")),
        orders.select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("Show "), F.col("o_orderkey").cast("string")).alias("title"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"),
            F.col("o_orderpriority").alias("venue"),
        ),
    )


#: The same adapter in DuckDB SQL, as common table expressions.
SAMPLE_CATALOG_SQL = """
first_year AS (SELECT l_partkey, CAST(year(min(o_orderdate)) AS VARCHAR) AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey),
resource AS (SELECT p_partkey AS id, p_name AS title, 2 AS template_id, p_size % 4 + 1 AS class_id, p_size % 5 <> 0 AS is_public,
  TIMESTAMP '2020-01-01' + to_days(CAST(p_partkey % 700 AS INTEGER)) AS created,
  TIMESTAMP '2021-01-01' + to_days(CAST(p_partkey % 500 AS INTEGER)) AS modified FROM part),
value AS (
  SELECT p_partkey AS resource_id, 8 AS property_id, p_type AS value FROM part
  UNION ALL SELECT p_partkey, 931, p_brand FROM part
  UNION ALL SELECT p_partkey, 603, CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 1129, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 10, 'N-' || p_partkey FROM part
  UNION ALL SELECT p_partkey, 3, unnest(string_split(p_name, ' ')) FROM part
  UNION ALL SELECT p_partkey, 7, CASE WHEN p_partkey % 17 = 0 THEN 'undated' WHEN p_partkey % 2 = 0 THEN 'c. ' || y ELSE y END
    FROM part JOIN first_year ON p_partkey = l_partkey
  UNION ALL SELECT p_partkey, 91, text FROM part JOIN documents ON p_partkey = doc_id),
member AS (SELECT DISTINCT l_partkey AS item_id, l_suppkey AS set_id FROM lineitem),
item_set AS (SELECT s_suppkey AS id, s_name AS title FROM supplier),
media AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS item_id, l_linenumber AS position, 'f' || l_orderkey AS storage_id
  FROM lineitem),
link AS (SELECT l_partkey AS item_id, l_orderkey AS target_id FROM lineitem),
exhibition AS (SELECT o_orderkey AS id, 'Show ' || o_orderkey AS title, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
  o_orderpriority AS venue FROM orders)
"""
