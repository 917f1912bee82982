"""Queries over rounds, result pages and curation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import is_noise, upper_words
from vitrine.operators import cleaning, extraction, facets, items, pages, rounds
from vitrine.operators import suggestion as sg
from vitrine.plans.cleaning_queries import RECORDS_SQL, _records
from vitrine.plans.extraction_queries import UP, _texts
from vitrine.plans.items_queries import WITH
from vitrine.plans.registry import register
from vitrine.plans.search_queries import COS, LEXICAL_SQL, _vectors
from vitrine.sources.catalog import sample_catalog, table


@register(
    "exhibitions_in_rounds",
    """SELECT event_type AS name, string_agg(DISTINCT CAST(event_id % 4 + 1 AS VARCHAR), ',' ORDER BY CAST(event_id % 4 + 1 AS VARCHAR)) AS rounds,
CAST(max(event_id % 4 + 1) AS INTEGER) AS last FROM events WHERE event_id % 3 <> 0 GROUP BY 1""",
)
def exhibitions_in_rounds(spark, sf_dir):
    number = (F.col("event_id") % 4 + 1).cast("string")
    title = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("[Curate] "), "event_type", F.lit(" Round "), number)).otherwise("Other set")
    return rounds.exhibitions_in_rounds(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), title.alias("title")))


def _pairs(spark, sf_dir):
    key = F.col("event_id")
    pick = F.element_at(F.array(*[F.lit(x) for x in ("a", "b", "both", "none")]), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select((key * 2).alias("a"), F.when(key % 10 != 0, key * 2 + 1).alias("b"), pick.alias("pick"), (F.col("user_id") % 3).alias("round"))


BRACKET_SQL = """p AS (SELECT event_id * 2 AS a, CASE WHEN event_id % 10 <> 0 THEN event_id * 2 + 1 END AS b, ['a', 'b', 'both', 'none'][event_id % 4 + 1] AS pick, user_id % 3 AS round FROM events),
r AS (SELECT round, a AS id, b IS NULL OR pick IN ('a', 'both') AS survives FROM p UNION ALL SELECT round, b, pick IN ('b', 'both') FROM p WHERE b IS NOT NULL)"""


@register("bracket_results", f"WITH {BRACKET_SQL} SELECT id, survives FROM r")
def bracket_results(spark, sf_dir):
    return rounds.bracket_results(_pairs(spark, sf_dir))


@register(
    "round_statistics",
    f"WITH {BRACKET_SQL} SELECT round, count_if(survives) AS kept, count_if(NOT survives) AS cut, round(count_if(survives) * 100.0 / count(*), 1) AS percent FROM r GROUP BY 1",
)
def round_statistics(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return rounds.round_statistics(rounds.bracket_results(pairs).join(pairs.select(F.explode(F.array("a", "b")).alias("id"), "round"), "id"))


@register("round_pool", "SELECT p_partkey AS id FROM part WHERE p_brand LIKE '%1' AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def round_pool(spark, sf_dir):
    first = table(spark, sf_dir, "part").where("p_brand like '%1'").select(F.col("p_partkey").alias("id"), F.lit("x").alias("category"))
    survivors = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return rounds.round_pool(first, "x", survivors)


@register(
    "stratified_sample",
    "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) ORDER BY k, lang LIMIT 50",
)
def stratified_sample(spark, sf_dir):
    return rounds.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 50, "doc_id")


@register(
    "hydrated_hits",
    """WITH h AS (SELECT event_id AS id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 100)
SELECT h.id, rank, lang FROM h LEFT JOIN documents ON doc_id = h.id""",
)
def hydrated_hits(spark, sf_dir):
    best = table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(100).select(F.col("event_id").alias("id"), "value")
    ranked = best.select("id", F.row_number().over(Window.orderBy(F.desc("value"), "id")).alias("rank"))
    return pages.hydrated(ranked, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"))


@register(
    "word_snippets",
    """WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text, ' '), '\\s+') AS w FROM documents),
p AS (SELECT doc_id, w, greatest(coalesce(list_position(list_transform(w, lambda x: contains(lower(x), 'the')), true), 1) - 6, 1) AS s FROM w)
SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || array_to_string(w[s:s + 11], ' ') || CASE WHEN len(w) >= s + 12 THEN '...' ELSE '' END AS snippet FROM p""",
)
def word_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pages.word_snippet(F.col("text"), F.lit("the")).alias("snippet"))


@register("autocomplete", "SELECT DISTINCT p_name AS value FROM part WHERE contains(lower(p_name), 'a') AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) ORDER BY 1 LIMIT 12")
def autocomplete(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), "p_size")
    return pages.autocomplete(names, "A", names.where("p_size = 1"))


@register(
    "few_shot",
    """WITH t AS (SELECT user_id AS id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS tags FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2)
SELECT id, id AS rank, tags FROM t ORDER BY id LIMIT 5""",
)
def few_shot(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    candidates = events.select(F.col("user_id").alias("id"), F.col("user_id").alias("rank")).distinct()
    tags = events.select(F.col("user_id").alias("id"), F.col("event_type").alias("tag"))
    return pages.few_shot(candidates, tags).withColumn("tags", F.array_join("tags", "|"))


@register("well_tagged_sample")
def well_tagged_sample(spark, sf_dir):
    """A random sample has no SQL; a test holds its conditions."""
    tags = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("tag"))
    return pages.well_tagged_sample(tags, 3)


@register(
    "extremes",
    """(SELECT doc_id AS item_id, n_chars AS score, 'low' AS side, row_number() OVER (ORDER BY n_chars, doc_id) AS rank FROM documents QUALIFY rank <= 5)
UNION ALL (SELECT doc_id, n_chars, 'high', row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5)""",
)
def extremes(spark, sf_dir):
    return pages.extremes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("score")), "score")


@register(
    "search_hybrid",
    LEXICAL_SQL
    + f""", l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 50)),
n AS (SELECT b.vec_id AS id, {COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY 2 DESC, 1 LIMIT 50),
b AS (SELECT id, score + CASE WHEN list_has_any([lang], ['the', 'of']) THEN 0.1 ELSE 0 END
  + CASE WHEN list_has_any(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x <> lang), ['the', 'of']) THEN 0.03 ELSE 0 END AS score FROM n JOIN documents ON doc_id = id),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM b),
f AS (SELECT id, sum(p) AS score FROM (SELECT id, 0.6 / (61 + rank) AS p FROM v UNION ALL SELECT id, 0.4 / (61 + rank) FROM l) GROUP BY 1)
SELECT id, round(score / (SELECT max(score) FROM f), 6) AS score FROM f ORDER BY f.score DESC, id LIMIT 20""",
)
def search_hybrid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tags"))
    return pages.search_items(docs, _vectors(spark, sf_dir), "the of", 7).withColumn("score", F.round("score", 6))


@register(
    "search_exact",
    LEXICAL_SQL + """, p AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20)
SELECT id, 1 - (row_number() OVER (ORDER BY score DESC, id) - 1) / (SELECT count(*) FROM p) AS score FROM p""",
)
def search_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("tags"))
    return pages.search_items(docs, _vectors(spark, sf_dir), "the of", 7, "exact")


@register(
    "validated_locations",
    """SELECT event_id AS item_id, event_type AS name, 'city' AS type, 'setting' AS role, CASE WHEN event_id % 2 = 0 THEN '1.5,' || CAST(CAST(event_id AS DOUBLE) AS VARCHAR) ELSE '' END AS coordinates,
'unsure' AS flags FROM events WHERE user_id % 4 <> 0""",
)
def validated_locations(spark, sf_dir):
    key = F.col("event_id")
    entry = F.struct(
        F.col("event_type").alias("location_name"),
        F.when(F.col("user_id") % 4 == 0, "planet").otherwise("city").alias("location_type"),
        F.when(key % 2 == 0, F.array(F.lit(1.5), key.cast("double"))).otherwise(F.array(F.lit(1.5))).alias("coordinates"),
        F.lit("setting").alias("narrative_role"),
        F.array(F.lit("unsure"), F.lit("odd")).alias("flags"),
    )
    rows = table(spark, sf_dir, "events").select(key.alias("item_id"), F.to_json(F.array(entry)).alias("answer"))
    found = cleaning.validated_locations(rows, ["city"], ["setting"], ["unsure"])
    listed = F.coalesce(F.array_join(F.transform("coordinates", lambda x: x.cast("string")), ","), F.lit(""))
    return found.withColumn("coordinates", listed).withColumn("flags", F.array_join("flags", "|"))


@register(
    "backfilled_dates",
    """SELECT o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)""",
)
def backfilled_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    credit = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("printed "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise("no date")
    dated = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("item_id"))
    return cleaning.backfilled_dates(orders.select(F.col("o_orderkey").alias("item_id"), credit.alias("credit")), dated)


@register(
    "curated_members",
    """SELECT p_partkey AS id, CAST(NULL AS VARCHAR) AS outlet FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 10 <> 0""",
)
def curated_members(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("outlet"))
    decisions = part.where("id % 5 = 0").withColumn("keep", F.col("id") % 10 != 0)
    return cleaning.curated(part.where("id % 2 = 0").select("id"), decisions)


@register(
    "reconciled",
    """SELECT 'u' || event_id AS url, CASE event_id % 3 WHEN 0 THEN 'insert' WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'link' ELSE 'none' END ELSE 'none' END AS step,
CASE WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN user_id END AS target FROM events""",
)
def reconciled(spark, sf_dir):
    action = F.element_at(F.array(F.lit("create"), F.lit("add_existing"), F.lit("in_set")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), action.alias("action"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("matched_id")
    )
    return cleaning.reconciled(rows)


@register(
    "enrichment_requests",
    "SELECT doc_id AS item_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents WHERE trim(text) <> '' AND doc_id % 4 <> 0",
)
def enrichment_requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return cleaning.enrichment_requests(docs, docs.where("item_id % 4 = 0"), 100).select("item_id", "batch")


@register(
    "sprint_flags",
    f"""WITH {RECORDS_SQL} SELECT id, date = '' AS no_date, date <> '' AND NOT regexp_matches(date, '^(c\\. )?\\d{{4}}$|^∅$|^undated$') AS bad_date, no_width AS no_size,
  motifs = 0 AS no_motif, motifs = 2 AS repeated_motif, category = '' AS no_category FROM r""",
)
def sprint_flags(spark, sf_dir):
    return cleaning.sprint_flags(_records(spark, sf_dir))


@register(
    "second_pass",
    f"""WITH w AS (SELECT doc_id, length(text) AS n, list_distinct({UP}) AS w FROM documents) SELECT doc_id AS item_id,
  n >= 50 AND ((list_contains(w, 'THE') AND len(list_filter(w, lambda x: length(x) >= 12)) > 3) OR len(list_filter(w, lambda x: length(x) >= 12)) > 8) AS again FROM w""",
)
def second_pass(spark, sf_dir):
    words = F.array_distinct(upper_words(F.col("text")))
    left = F.size(F.filter(words, lambda x: F.length(x) >= 12))
    again = extraction.needs_second_pass(F.length("text"), F.array_contains(words, "THE").cast("int"), left)
    return _texts(spark, sf_dir).select("item_id", again.alias("again"))


@register("display_filter", "SELECT event_id, event_id % 3 = 0 OR event_id % 3 = 1 AS hidden FROM events")
def display_filter(spark, sf_dir):
    shown = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, "image/jpeg").otherwise("A title")
    return table(spark, sf_dir, "events").select("event_id", is_noise(shown).alias("hidden"))


@register(
    "band_totals",
    """SELECT CASE WHEN value >= 80 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS band, count(*) AS rows, count(DISTINCT user_id) AS items FROM events GROUP BY 1""",
)
def band_totals(spark, sf_dir):
    band = sg.band(F.col("value"), F.lit(80.0), F.lit(40.0))
    return sg.band_totals(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), band.alias("band")))


PUBLIC = "(SELECT id FROM resource WHERE is_public)"


@register("available_values", WITH + f"SELECT value, count(*) AS n FROM value WHERE property_id = 8 AND resource_id IN {PUBLIC} GROUP BY 1")
def available_values(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    base = items.public_items(catalog.resource).select("id")
    return facets.available(catalog, base, "eq", 8).select(F.col("label").alias("value"), "n")


@register(
    "available_choices",
    WITH + f"""SELECT 'class' AS kind, class_id AS id, 'Class ' || class_id AS label, count(*) AS n FROM resource WHERE id IN {PUBLIC} GROUP BY ALL
UNION ALL SELECT 'template', template_id, CAST(template_id AS VARCHAR), count(*) FROM resource WHERE id IN {PUBLIC} GROUP BY ALL
UNION ALL SELECT 'set', set_id, title, count(*) FROM member JOIN item_set ON item_set.id = set_id WHERE item_id IN {PUBLIC} GROUP BY ALL
UNION ALL SELECT 'linked', 0, target_id || ' ' || title, count(*) FROM link JOIN exhibition ON exhibition.id = target_id WHERE item_id IN {PUBLIC} GROUP BY ALL
UNION ALL SELECT 'property', 0, property_id || ' ' || ['work type', 'motif'][CASE property_id WHEN 8 THEN 1 ELSE 2 END], count(*) FROM value WHERE property_id IN (3, 8) AND resource_id IN {PUBLIC} GROUP BY ALL""",
)
def available_choices(spark, sf_dir):
    """Classes, templates, sets, linked items and properties of the public items, with counts."""
    catalog = sample_catalog(spark, sf_dir)
    base = items.public_items(catalog.resource).select("id")
    classes = catalog.resource.select(F.col("class_id").alias("id"), F.concat(F.lit("Class "), F.col("class_id").cast("string")).alias("label")).distinct()
    properties = spark.createDataFrame([(8, "work type"), (3, "motif")], "id int, label string")
    asked = {"class": ("resource_class", classes), "template": ("resource_template", None), "set": ("item_set", None), "linked": ("res", None), "property": ("ex", properties)}
    parts = [facets.available(catalog, base, kind, None, names).select(F.lit(name).alias("kind"), F.col("id").cast("long"), "label", "n") for name, (kind, names) in asked.items()]
    return reduce(DataFrame.unionByName, parts)
