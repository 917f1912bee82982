"""Queries over items: search, filters, wide records, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import items as it
from vitrine.plans.registry import register
from vitrine.sources.catalog import PROPERTIES, SAMPLE_CATALOG_SQL, sample_catalog

WITH = "WITH " + SAMPLE_CATALOG_SQL
YEAR_SQL = "TRY_CAST(regexp_extract(regexp_replace({0}, '(?i)^c\\.?\\s*', ''), '^\\s*(\\d+)', 1) AS INTEGER)"
VALUE_YEAR = YEAR_SQL.format("value")

WIDE_SQL = """, one AS (SELECT resource_id AS id,
  max(CASE WHEN property_id = 10 THEN value END) AS identifier, max(CASE WHEN property_id = 8 THEN value END) AS work_type,
  max(CASE WHEN property_id = 931 THEN value END) AS support, max(CASE WHEN property_id = 7 THEN value END) AS date,
  TRY_CAST(max(CASE WHEN property_id = 603 THEN value END) AS DOUBLE) AS height,
  TRY_CAST(max(CASE WHEN property_id = 1129 THEN value END) AS DOUBLE) AS width,
  string_agg(CASE WHEN property_id = 3 THEN value END, '|' ORDER BY value) AS motifs
  FROM value GROUP BY 1),
sets AS (SELECT item_id AS id, string_agg(title, '|' ORDER BY title) AS collections FROM member JOIN item_set s ON s.id = set_id GROUP BY 1),
firsts AS (SELECT item_id AS id, arg_min(storage_id, position * 1e12 + id) AS storage_id, count(*) AS media_count FROM media GROUP BY 1)
SELECT w.id, r.title, identifier, work_type, support, date, height, width, coalesce(motifs, '') AS motifs,
  coalesce(collections, '') AS collections, storage_id, coalesce(media_count, 0) AS media_count
FROM wanted w JOIN resource r ON r.id = w.id LEFT JOIN one ON one.id = w.id LEFT JOIN sets ON sets.id = w.id
LEFT JOIN firsts ON firsts.id = w.id"""


def _flat(df):
    return df.withColumn("motifs", F.array_join("motifs", "|")).withColumn("collections", F.array_join("collections", "|"))


@register(
    "search_catalog",
    WITH
    + f""", wanted AS (SELECT id FROM resource WHERE is_public
  AND id IN (SELECT resource_id FROM value WHERE property_id = 7 AND {VALUE_YEAR} BETWEEN 1992 AND 1995)
  AND id IN (SELECT resource_id FROM value WHERE property_id = 603 AND TRY_CAST(value AS DECIMAL(10,2)) >= 5)
  AND id IN (SELECT resource_id FROM value WHERE property_id = 1129 AND TRY_CAST(value AS DECIMAL(10,2)) <= 1500)
  AND id IN (SELECT resource_id FROM value WHERE property_id = 931 AND value LIKE '%Brand#1%')
  ORDER BY id LIMIT 50)"""
    + WIDE_SQL,
)
def search_catalog(spark, sf_dir):
    search = it.Search(first_year=1992, last_year=1995, least_height=5, most_width=1500, support="Brand#1")
    return _flat(it.search_catalog(sample_catalog(spark, sf_dir), search, 50))


@register("wide_items", WITH + ", wanted AS (SELECT id FROM resource)" + WIDE_SQL)
def wide_items(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    return _flat(it.wide_items(catalog, catalog.resource.select("id")))


@register("filter_exact", WITH + "SELECT DISTINCT resource_id AS id FROM value WHERE property_id = 8 AND value = (SELECT min(p_type) FROM part)")
def filter_exact(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    first = catalog.value.where(F.col("property_id") == 8).agg(F.min("value").alias("value"))
    found = catalog.value.where(F.col("property_id") == 8).join(F.broadcast(first), "value", "left_semi")
    return found.select(F.col("resource_id").alias("id")).distinct()


@register("filter_containing", WITH + "SELECT DISTINCT resource_id AS id FROM value WHERE property_id = 931 AND value LIKE '%#2%'")
def filter_containing(spark, sf_dir):
    return it.containing(sample_catalog(spark, sf_dir).value, PROPERTIES["support"], "#2")


@register("filter_dated", WITH + f"SELECT DISTINCT resource_id AS id FROM value WHERE property_id = 7 AND {VALUE_YEAR} <= 1993")
def filter_dated(spark, sf_dir):
    return it.dated(sample_catalog(spark, sf_dir).value, last=1993)


@register(
    "filter_all_of",
    WITH
    + """, pair AS (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))
SELECT resource_id AS id FROM value WHERE property_id = 3 AND value IN (SELECT w FROM pair)
GROUP BY 1 HAVING count(DISTINCT value) = (SELECT count(DISTINCT w) FROM pair)""",
)
def filter_all_of(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    words = catalog.resource.orderBy("id").select(F.split("title", " ").alias("w")).first()["w"]
    return it.all_of(catalog.value, PROPERTIES["motif"], words + words[:1])


@register("filter_sized", WITH + "SELECT DISTINCT resource_id AS id FROM value WHERE property_id = 603 AND TRY_CAST(value AS DECIMAL(10,2)) BETWEEN 10 AND 20")
def filter_sized(spark, sf_dir):
    return it.sized(sample_catalog(spark, sf_dir).value, PROPERTIES["height"], 10, 20)


@register("filter_collection", WITH + "SELECT DISTINCT item_id AS id FROM member JOIN item_set s ON s.id = set_id WHERE title LIKE '%1%'")
def filter_collection(spark, sf_dir):
    return it.in_collection(sample_catalog(spark, sf_dir), "1")


@register("filter_transcribed", WITH + "SELECT DISTINCT resource_id AS id FROM value WHERE property_id = 91 AND trim(value) <> ''")
def filter_transcribed(spark, sf_dir):
    return it.having(sample_catalog(spark, sf_dir).value, PROPERTIES["transcription"], F.trim("value") != "")


@register(
    "property_query_and",
    WITH
    + """SELECT id FROM resource WHERE id IN (SELECT resource_id FROM value WHERE property_id = 931 AND contains(value, '#1'))
  AND id NOT IN (SELECT resource_id FROM value WHERE property_id = 7 AND value = 'undated')
  AND id IN (SELECT resource_id FROM value WHERE property_id = 91)""",
)
def property_query_and(spark, sf_dir):
    return it.property_query(sample_catalog(spark, sf_dir), [("in", 931, "#1"), ("neq", 7, "undated"), ("ex", 91, None)])


@register(
    "property_query_or",
    WITH
    + """SELECT id FROM resource WHERE id IN (SELECT resource_id FROM value WHERE property_id = 7 AND value = 'undated')
  OR id IN (SELECT item_id FROM link WHERE target_id = 1) OR id NOT IN (SELECT resource_id FROM value WHERE property_id = 91)""",
)
def property_query_or(spark, sf_dir):
    return it.property_query(sample_catalog(spark, sf_dir), [("eq", 7, "undated"), ("res", 74, 1), ("nex", 91, None)], "or")


@register(
    "fulltext_page",
    WITH + """SELECT DISTINCT resource_id AS id FROM value WHERE property_id = 91 AND value LIKE '%the%' ORDER BY 1 LIMIT 20 OFFSET 20""",
)
def fulltext_page(spark, sf_dir):
    found = it.containing(sample_catalog(spark, sf_dir).value, PROPERTIES["transcription"], "the")
    return it.page(found, [F.col("id").asc()], 20, 20)


@register("lookup_identifier", WITH + "SELECT resource_id AS id FROM value WHERE property_id = 10 AND value = 'N-7' LIMIT 1")
def lookup_identifier(spark, sf_dir):
    return it.exact(sample_catalog(spark, sf_dir).value, PROPERTIES["identifier"], "N-7").limit(1)


@register(
    "pivot_properties",
    WITH
    + """SELECT * FROM (SELECT resource_id AS id, max(CASE WHEN property_id = 7 THEN value END) AS date,
  max(CASE WHEN property_id = 91 THEN value END) AS transcription, max(CASE WHEN property_id = 10 THEN value END) AS identifier
  FROM value GROUP BY 1) WHERE transcription IS NOT NULL""",
)
def pivot_properties(spark, sf_dir):
    names = {7: "date", 91: "transcription", 10: "identifier"}
    return it.pivot_properties(sample_catalog(spark, sf_dir).value, names, ["transcription"])


@register(
    "exhibitions",
    WITH
    + """SELECT e.id, e.title, e.start_date, e.venue, coalesce(n, 0) AS works FROM exhibition e
  LEFT JOIN (SELECT target_id, count(*) AS n FROM link GROUP BY 1) ON target_id = e.id""",
)
def exhibitions(spark, sf_dir):
    return it.exhibitions(sample_catalog(spark, sf_dir))


@register(
    "linked_works",
    WITH
    + """SELECT target_id, item_id, rank FROM (SELECT target_id, item_id, row_number() OVER (PARTITION BY target_id
  ORDER BY created DESC, item_id DESC) AS rank FROM link JOIN resource r ON r.id = item_id) WHERE rank <= 3""",
)
def linked_works(spark, sf_dir):
    return it.linked_works(sample_catalog(spark, sf_dir), 3).select("target_id", "item_id", "rank")


@register(
    "set_members",
    WITH
    + """SELECT item_id AS id, max(CASE WHEN property_id = 8 THEN value END) AS work_type, max(CASE WHEN property_id = 931 THEN value END) AS support
  FROM member JOIN value ON resource_id = item_id WHERE set_id = (SELECT min(id) FROM item_set) GROUP BY 1""",
)
def set_members(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    title = catalog.item_set.orderBy("id").first()["title"]
    return it.set_members(catalog, title, {8: "work_type", 931: "support"})


@register(
    "item_documents",
    WITH
    + """, f AS (SELECT resource_id AS id, count(DISTINCT property_id) AS n_fields, count(value) AS n_values FROM value GROUP BY 1),
s AS (SELECT item_id AS id, string_agg(set_id, ',' ORDER BY set_id) AS sets FROM member GROUP BY 1),
m AS (SELECT item_id AS id, arg_min(storage_id, position * 1e12 + id) AS first_medium FROM media GROUP BY 1)
SELECT r.id, n_fields, n_values, coalesce(sets, '') AS sets, first_medium FROM resource r LEFT JOIN f ON f.id = r.id
LEFT JOIN s ON s.id = r.id LEFT JOIN m ON m.id = r.id""",
)
def item_documents(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    docs = it.item_documents(catalog, catalog.resource.select("id"))
    sizes = F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda t, x: t + F.size(x))
    listed = F.array_join(F.transform("sets", lambda x: x.cast("string")), ",")
    return docs.select(
        "id", F.size("fields").cast("long").alias("n_fields"), sizes.alias("n_values"), F.coalesce(listed, F.lit("")).alias("sets"), "first_medium"
    )


@register(
    "year_order_page",
    WITH
    + """, d AS (SELECT resource_id AS id, max(value) AS date FROM value WHERE property_id = 7 GROUP BY 1)
SELECT id, date FROM d ORDER BY CASE WHEN date IS NULL OR date IN ('', '∅', 'undated') THEN 1 ELSE 0 END, date, id DESC LIMIT 40""",
)
def year_order_page(spark, sf_dir):
    dates = it.pivot_properties(sample_catalog(spark, sf_dir).value, {7: "date"}, ["date"])
    return it.year_order(dates, "date").limit(40)


@register(
    "area_order_page",
    WITH
    + """, d AS (SELECT resource_id AS id, max(CASE WHEN property_id = 603 THEN value END) AS height,
  max(CASE WHEN property_id = 1129 THEN value END) AS width FROM value GROUP BY 1)
SELECT id, height, width, CAST(height AS DOUBLE) * CAST(width AS DOUBLE) AS area FROM d ORDER BY area DESC, id DESC LIMIT 40""",
)
def area_order_page(spark, sf_dir):
    return it.area_order(it.pivot_properties(sample_catalog(spark, sf_dir).value, {603: "height", 1129: "width"})).limit(40)


@register("missing_field", WITH + "SELECT id FROM resource WHERE id NOT IN (SELECT resource_id FROM value WHERE property_id = 91 AND trim(value) <> '')")
def missing_field(spark, sf_dir):
    return it.missing_field(sample_catalog(spark, sf_dir), PROPERTIES["transcription"])


@register(
    "export_wide",
    WITH
    + """SELECT resource_id AS id, coalesce(string_agg(CASE WHEN property_id = 3 THEN value END, '; ' ORDER BY value), '') AS "3",
  coalesce(string_agg(CASE WHEN property_id = 7 THEN value END, '; ' ORDER BY value), '') AS "7",
  coalesce(string_agg(CASE WHEN property_id = 8 THEN value END, '; ' ORDER BY value), '') AS "8" FROM value WHERE property_id IN (3, 7, 8) GROUP BY 1""",
)
def export_wide(spark, sf_dir):
    value = sample_catalog(spark, sf_dir).value.where(F.col("property_id").isin(3, 7, 8))
    return it.export_wide(value, [3, 7, 8])


@register(
    "primary_media",
    WITH
    + """SELECT item_id, arg_min(id, position * 1e12 + id) AS id, min(position) AS position, arg_min(storage_id, position * 1e12 + id) AS storage_id,
  count(*) AS media_count FROM media GROUP BY 1""",
)
def primary_media(spark, sf_dir):
    return it.primary_media(sample_catalog(spark, sf_dir).media)
