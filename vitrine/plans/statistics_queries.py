"""Queries over counts: summaries, facets, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.dates import norm_year
from vitrine.operators import items as it
from vitrine.operators import statistics as st
from vitrine.plans.items_queries import VALUE_YEAR, WITH
from vitrine.plans.registry import register
from vitrine.sources.catalog import PROPERTIES, sample_catalog, table


@register(
    "corpus_summary",
    WITH
    + f"""SELECT count(DISTINCT r.id) AS items, min(CASE WHEN property_id = 7 THEN {VALUE_YEAR} END) AS earliest,
  max(CASE WHEN property_id = 7 THEN {VALUE_YEAR} END) AS latest,
  count(DISTINCT CASE WHEN property_id = 91 AND trim(value) <> '' THEN r.id END) AS transcribed
  FROM resource r LEFT JOIN value ON resource_id = r.id WHERE is_public""",
)
def corpus_summary(spark, sf_dir):
    return st.corpus_summary(sample_catalog(spark, sf_dir))


@register(
    "breakdown_year",
    WITH + f"""SELECT CAST({VALUE_YEAR} AS VARCHAR) AS key, count(DISTINCT resource_id) AS items FROM value JOIN resource r ON r.id = resource_id
  WHERE is_public AND property_id = 7 AND {VALUE_YEAR} IS NOT NULL GROUP BY 1""",
)
def breakdown_year(spark, sf_dir):
    return st.breakdown(sample_catalog(spark, sf_dir), PROPERTIES["date"], norm_year(F.col("value")).cast("string"))


@register(
    "breakdown_motif",
    WITH + "SELECT value AS key, count(DISTINCT resource_id) AS items FROM value JOIN resource r ON r.id = resource_id WHERE is_public AND property_id = 3 GROUP BY 1",
)
def breakdown_motif(spark, sf_dir):
    return st.breakdown(sample_catalog(spark, sf_dir), PROPERTIES["motif"])


@register(
    "breakdown_collection",
    WITH + "SELECT title, items FROM (SELECT set_id, count(*) AS items FROM member GROUP BY 1) JOIN item_set s ON s.id = set_id",
)
def breakdown_collection(spark, sf_dir):
    return st.collection_breakdown(sample_catalog(spark, sf_dir))


@register(
    "facet_counts",
    WITH
    + """, base AS (SELECT id FROM resource WHERE is_public),
v AS (SELECT * FROM value WHERE resource_id IN (SELECT id FROM base))
SELECT 'eq:' || property_id AS facet, value AS key, count(*) AS n FROM v WHERE property_id IN (3, 8) GROUP BY 1, 2
UNION ALL SELECT 'set', CAST(set_id AS VARCHAR), count(*) FROM member WHERE item_id IN (SELECT id FROM base) GROUP BY 2
UNION ALL SELECT 'template', CAST(template_id AS VARCHAR), count(*) FROM resource WHERE is_public GROUP BY 2
UNION ALL SELECT 'res', CAST(target_id AS VARCHAR), count(*) FROM link WHERE item_id IN (SELECT id FROM base) GROUP BY 2
UNION ALL SELECT 'ex:' || property_id, NULL, count(DISTINCT resource_id) FROM v WHERE property_id IN (7, 91) GROUP BY 1
UNION ALL SELECT 'nex:' || property_id, NULL, (SELECT count(*) FROM base) - count(DISTINCT resource_id) FROM v
  WHERE property_id IN (7, 91) GROUP BY property_id""",
)
def facet_counts(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    return st.facet_counts(catalog, it.public_items(catalog.resource).select("id"), [3, 8], True, [7, 91])


@register(
    "needle_counts",
    WITH + """SELECT n_name AS needle, count(DISTINCT resource_id) AS items FROM value JOIN
  (SELECT lower(n_name[1:2]) AS n_name FROM nation GROUP BY 1) ON contains(value, n_name) WHERE property_id = 3 GROUP BY 1""",
)
def needle_counts(spark, sf_dir):
    needles = table(spark, sf_dir, "nation").select(F.lower(F.substring("n_name", 1, 2)).alias("needle")).distinct()
    return st.needle_counts(sample_catalog(spark, sf_dir), PROPERTIES["motif"], needles)


@register("status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def status_counts(spark, sf_dir):
    return st.status_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "status"), "status")


@register(
    "completeness",
    WITH
    + """SELECT p.property_id, (SELECT count(*) FROM resource) AS total, (SELECT count(*) FROM resource) - coalesce(n, 0) AS missing
  FROM (VALUES (3), (7), (91), (999)) p(property_id)
  LEFT JOIN (SELECT property_id, count(DISTINCT resource_id) AS n FROM value WHERE trim(value) <> '' GROUP BY 1) f ON f.property_id = p.property_id""",
)
def completeness(spark, sf_dir):
    template = spark.createDataFrame([(p,) for p in (3, 7, 91, 999)], "property_id int")
    return st.completeness(sample_catalog(spark, sf_dir), template)


MENTIONS_SQL = """mention AS (SELECT user_id AS item_id, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS name,
  'kind' || (event_id % 4) AS type, 'role' || (event_id % 5) AS role FROM events)"""


def mentions(spark, sf_dir):
    """Mentions out of the event table: users are items, event types names."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("pos"),
        F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"),
        F.concat(F.lit("kind"), (F.col("event_id") % 4).cast("string")).alias("type"),
        F.concat(F.lit("role"), (F.col("event_id") % 5).cast("string")).alias("role"),
    )


@register(
    "name_report",
    "WITH " + MENTIONS_SQL + """, r AS (SELECT lower(name) AS k, role, count(*) AS c, min(pos) AS f FROM mention GROUP BY 1, 2),
top AS (SELECT k, role FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, f) = 1)
SELECT arg_max(name, pos) AS name, arg_max(type, pos) AS type, count(*) AS total, count(DISTINCT item_id) AS items, any_value(top.role) AS role
FROM mention JOIN top ON k = lower(name) GROUP BY lower(name)""",
)
def name_report(spark, sf_dir):
    return st.name_report(mentions(spark, sf_dir))


@register(
    "place_report",
    "WITH " + MENTIONS_SQL + """SELECT lower(name) AS name, type, count(*) AS total, count_if(role = 'role0') AS as_role0, count_if(role = 'role1') AS as_role1,
  (SELECT string_agg(CAST(i AS VARCHAR), ', ' ORDER BY i) FROM (SELECT unnest(list(DISTINCT item_id)) AS i)) AS listed FROM mention GROUP BY 1, 2""",
)
def place_report(spark, sf_dir):
    return st.place_report(mentions(spark, sf_dir), ["role0", "role1"])


@register("type_breakdown", "WITH " + MENTIONS_SQL + "SELECT type, count(DISTINCT lower(name)) AS names, count(*) AS total FROM mention GROUP BY 1")
def type_breakdown(spark, sf_dir):
    return st.type_breakdown(mentions(spark, sf_dir))


@register(
    "class_histogram",
    "SELECT CAST(c AS INTEGER) AS size_class, coalesce(n, 0) AS n FROM range(0, 12) t(c) LEFT JOIN (SELECT p_size // 5 AS k, count(*) AS n FROM part GROUP BY 1) ON k = c",
)
def class_histogram(spark, sf_dir):
    sized = table(spark, sf_dir, "part").select(F.expr("cast(p_size div 5 as int)").alias("size_class"))
    return st.class_histogram(sized, "size_class", 0, 11)


@register(
    "category_counts",
    """SELECT CAST(position AS INTEGER) AS position, lang, coalesce(n, 0) AS n, example FROM (VALUES (0, 'fr'), (1, 'xx'), (2, 'en')) c(position, lang)
LEFT JOIN (SELECT lang AS l, count(*) AS n, min(doc_id) AS example FROM documents GROUP BY 1) ON l = lang""",
)
def category_counts(spark, sf_dir):
    return st.category_counts(table(spark, sf_dir, "documents"), "lang", ["fr", "xx", "en"], "doc_id")


@register(
    "usage_cost",
    """SELECT event_type AS model, event_id, round(CASE event_type WHEN 'click' THEN (event_id * 3.0 + user_id * 15.0) / 1e6
  ELSE (event_id * 1.0 + user_id * 5.0) / 1e6 END, 6) AS cost FROM events""",
)
def usage_cost(spark, sf_dir):
    used = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), "event_id", F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out")
    )
    return st.usage_cost(used, {"click": (3.0, 15.0), "other": (1.0, 5.0)}, "other").select("model", "event_id", "cost")


@register(
    "queue_sizes",
    """SELECT * FROM (SELECT 'large' AS rule, count_if(p_size > 40) AS n FROM part UNION ALL SELECT 'cheap', count_if(p_retailprice < 950) FROM part
  UNION ALL SELECT 'never', count_if(p_size > 400) FROM part) WHERE n > 0""",
)
def queue_sizes(spark, sf_dir):
    rules = {"large": F.col("p_size") > 40, "cheap": F.col("p_retailprice") < 950, "never": F.col("p_size") > 400}
    return st.queue_sizes(table(spark, sf_dir, "part"), rules)


@register("distinct_terms", WITH + "SELECT DISTINCT value FROM value WHERE property_id = 3")
def distinct_terms(spark, sf_dir):
    return st.distinct_terms(sample_catalog(spark, sf_dir).value, PROPERTIES["motif"])


@register(
    "new_terms",
    """SELECT min(p_type) AS value FROM part WHERE lower(p_type) NOT IN (SELECT lower(p_type) FROM part WHERE p_size < 3) GROUP BY lower(p_type)""",
)
def new_terms(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_type", "value")
    return st.new_terms(part.where("p_size < 3").select(F.upper("value").alias("value")), part.select("value"))


@register("batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 500 AS batch FROM documents")
def batches(spark, sf_dir):
    return st.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "batch")
