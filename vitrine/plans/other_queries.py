"""Queries over exports, index rows, feeds and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.operators import items as it
from vitrine.operators import reshape
from vitrine.operators.staging import shared_folder
from vitrine.plans.items_queries import WIDE_SQL, WITH
from vitrine.plans.registry import register
from vitrine.sources import io
from vitrine.sources.catalog import sample_catalog, table
from vitrine.streaming import ingest


@register(
    "storefront_rows",
    """WITH v AS (SELECT 'P' || l_partkey AS sku, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem GROUP BY 1)
SELECT trim(regexp_replace(lower(p_name || ' P' || p_partkey), '[^a-z0-9]+', '-', 'g'), '-') AS handle, p_name AS title,
  (SELECT string_agg(DISTINCT w, ', ' ORDER BY w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w)) AS tags, p_type || ' on ' || p_brand AS label,
  p_size || ' x ' || (p_size + 1) AS size, 'P' || p_partkey AS sku, coalesce(CAST(CAST(price AS DECIMAL(12,2)) AS VARCHAR), '') AS price
FROM part LEFT JOIN v ON sku = 'P' || p_partkey""",
)
def storefront_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("identifier"), F.col("p_name").alias("title"),
        F.col("p_type").alias("medium"), F.col("p_brand").alias("support"), F.col("p_size").alias("height"), (F.col("p_size") + 1).alias("width"),
        F.split("p_name", " ").alias("motifs"),
    )
    variants = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("sku"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return reshape.storefront_rows(items, variants)


@register(
    "writing_rows",
    """SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'Poem' WHEN 'de' THEN 'Gedicht' ELSE 'Prose Poem' END AS form,
  CASE WHEN length(text) <= 200 THEN text WHEN regexp_matches(substr(text, 1, 200), '\\S\\s+\\S+\\s*$') THEN regexp_replace(substr(text, 1, 200), '\\s+\\S+\\s*$', '') || '…' ELSE regexp_replace(substr(text, 1, 200), '^\\s+|\\s+$', '', 'g') || '…' END AS excerpt,
  source || ', ' || (1990 + doc_id % 30) AS credit FROM documents""",
)
def writing_rows(spark, sf_dir):
    pieces = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("form"), "text", (F.lit(1990) + F.col("doc_id") % 30).alias("year"), F.col("source").alias("outlet")
    )
    return reshape.writing_rows(pieces, {"en": "Poem", "de": "Gedicht"})


@register(
    "ingest_rows",
    WITH
    + ", wanted AS (SELECT id FROM resource), w AS ("
    + WIDE_SQL.removeprefix(", ").replace("one AS", "WITH one AS", 1)
    + """) SELECT id, title, motifs, TRY_CAST(nullif(regexp_extract(date, '^(?:c\\. )?(\\d{4})', 1), '') AS INTEGER) AS year,
  'https://x/files/large/' || storage_id || '.jpg' AS thumb_url, 'https://x/item/' || id AS item_url FROM w""",
)
def ingest_rows(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    rows = reshape.ingest_rows(it.wide_items(catalog, catalog.resource.select("id")), "x")
    return rows.withColumn("motifs", F.array_join("motifs", "|"))


@register(
    "index_blobs",
    """SELECT doc_id, trim(text, ' ') || CASE WHEN trim(text, ' ') = '' THEN '' ELSE chr(10) END || source || ', ' || lang || chr(10) || (2000 + doc_id % 20) AS blob FROM documents""",
)
def index_blobs(spark, sf_dir):
    blob = reshape.text_blob(F.col("text"), F.array("source", "lang"), F.lit(2000) + F.col("doc_id") % 20, F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", blob.alias("blob"))


@register(
    "clean_lines",
    """WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), '^\\s+|\\s+$', '', 'g') AS x,
  generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS p FROM documents),
b AS (SELECT *, regexp_replace(x, '\\s', '', 'g') AS c FROM l),
g AS (SELECT doc_id, p, x FROM b WHERE c <> '' AND len(list_filter(list_distinct(string_split(c, '')), lambda ch: contains(c, repeat(ch, 6)))) = 0
  AND (length(c) < 8 OR len(list_distinct(string_split(substr(c, 1, 80), ''))) / length(substr(c, 1, 80)) >= 0.15)),
j AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS j FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(CASE WHEN length(j) > 1500 THEN regexp_replace(substr(j, 1, 1500), '\\s+$', '') ELSE j END, '') AS cleaned FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id""",
)
def clean_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.sanitize_ocr(F.col("text")).alias("cleaned"))


@register(
    "normalized_results",
    """WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id - 1 END AS id, event_type AS title, 'u' || event_id AS url FROM events)
SELECT id, arg_min(title, pos) AS title, arg_min(url, pos) AS url, arg_min('t' || pos, pos) AS thumb FROM r WHERE id > 0 GROUP BY 1""",
)
def normalized_results(spark, sf_dir):
    key, none = F.col("event_id"), F.lit(None).cast("string")
    address = F.concat(F.lit("u"), key.cast("string"))
    payload = F.struct(
        F.when(key % 2 == 0, F.col("user_id")).alias("item_id"), (F.col("user_id") - 1).alias("id"),
        F.when(key % 3 == 0, F.col("event_type")).alias("title"), F.col("event_type").alias("label"), address.alias("url"), none.alias("item_url"),
        F.concat(F.lit("t"), key.cast("string")).alias("thumb"), none.alias("thumb_url"),
    )
    return reshape.normalized_results(table(spark, sf_dir, "events").select(key.alias("pos"), payload.alias("payload")))


@register(
    "item_values",
    """SELECT doc_id AS item_id, 'dcterms:source' AS term, source AS value, CAST(NULL AS VARCHAR) AS uri FROM documents
UNION ALL SELECT doc_id, 'dcterms:source', lang, NULL FROM documents UNION ALL SELECT doc_id, 'dcterms:title', text, 'u' || doc_id FROM documents""",
)
def item_values(spark, sf_dir):
    one = lambda value, uri: F.struct(value.alias("@value"), uri.alias("@id"))
    none = F.lit(None).cast("string")
    doc = F.struct(
        F.col("doc_id").alias("o:id"),
        F.array(one(F.col("source"), none), one(F.col("lang"), none)).alias("dcterms:source"),
        F.array(one(F.col("text"), F.concat(F.lit("u"), F.col("doc_id").cast("string")))).alias("dcterms:title"),
        F.lit("x").alias("o:kind"),
    )
    return io.item_values(table(spark, sf_dir, "documents").select(F.to_json(doc).alias("json")))


@register(
    "review_lines",
    """SELECT '== e' || user_id || ' | ' || any_value('user') || ' | ' || min(CAST(ts AS DATE)) || chr(10) ||
  string_agg('  - ' || event_type || ' [n' || event_id || ']', chr(10) ORDER BY event_id) AS value FROM events GROUP BY user_id""",
)
def review_lines(spark, sf_dir):
    entry = F.struct("event_id", F.col("event_type").alias("name"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("type"))
    records = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("references"), F.min(F.to_date("ts")).cast("string").alias("date"))
    return io.review_lines(records.select(F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("identifier"), F.lit("user").alias("title"), "date", "references"))


@register(
    "sitemap",
    WITH + """SELECT 'https://x/about' AS loc, CAST(current_date AS VARCHAR) AS lastmod, 'weekly' AS freq, '1.0' AS priority
UNION ALL SELECT 'https://x/page/' || page_id, CAST(current_date AS VARCHAR), 'monthly', '0.6' FROM pages
UNION ALL SELECT 'https://x/item/' || id, strftime(modified, '%Y-%m-%d'), 'monthly', '0.8' FROM resource""",
)
def sitemap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("slug"))
    return io.sitemap(["about"], pages, sample_catalog(spark, sf_dir).resource, "x")


@register("fields_to_enrich", "SELECT event_id AS item_id, p AS property_id FROM events, (VALUES (3), (91)) c(p) WHERE event_type = 'click'")
def fields_to_enrich(spark, sf_dir):
    media = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "click", "image/png").otherwise("text/plain").alias("media_type"))
    return ingest.fields_to_enrich(media, spark.createDataFrame([(3,), (91,)], "property_id int"))


@register(
    "windowed_counts",
    "SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def windowed_counts(spark, sf_dir):
    found = ingest.windowed_counts(table(spark, sf_dir, "events"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("streamed_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def streamed_upsert(spark, sf_dir):
    """The event table as a stream of files into a keyed table."""
    folder = f"{shared_folder(spark)}/vitrine/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").repartition(4, "event_id").write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    state = ingest.VersionedTable(spark, f"{folder}/state", schema)
    query = ingest.ingest(ingest.read_stream(spark, f"{folder}/in", schema, 1), state, ["user_id"], "event_id", f"{folder}/checkpoint")
    query.awaitTermination()
    return state.read()


@register(
    "streamed_fields",
    "SELECT event_id AS item_id, p AS property_id, max(ts) AS ts FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'click'), (VALUES (3), (91)) c(p) GROUP BY 1, 2",
)
def streamed_fields(spark, sf_dir):
    """New media as files arriving, one of them twice: the fields to fill in, each once."""
    folder = f"{shared_folder(spark)}/vitrine/stream-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "click", "image/png").otherwise("text/plain").alias("media_type")
    media = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), kind, F.col("ts").cast("timestamp").alias("ts"))
    media.repartition(3, "item_id").write.parquet(f"{folder}/in/first")
    spark.read.parquet(f"{folder}/in/first").where("item_id % 2 = 0").coalesce(1).write.parquet(f"{folder}/in/again")
    configured = spark.createDataFrame([(3,), (91,)], "property_id int")
    state = ingest.VersionedTable(spark, f"{folder}/state", spark.createDataFrame([], "item_id long, property_id int, ts timestamp").schema)
    stream = ingest.read_stream(spark, f"{folder}/in/*", spark.read.parquet(f"{folder}/in/first").schema, 2)
    ingest.trigger_enrichment(stream, configured, state, f"{folder}/checkpoint", "10000 days").awaitTermination()
    return state.read()
