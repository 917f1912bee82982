"""Queries over facets, full records, exports and extraction runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import dates, text
from vitrine.functions.dates import coverage
from vitrine.operators import cleaning, extraction, facets, rarity, reshape, rounds
from vitrine.operators import statistics as st
from vitrine.operators import suggestion as sg
from vitrine.operators.staging import staged
from vitrine.plans.extraction_queries import NAMES_SQL, RULES, WORDS_SQL, _phrases, _texts, _words
from vitrine.plans.items_queries import WITH
from vitrine.plans.registry import register
from vitrine.plans.search_queries import RARITY_SQL, _items, _motifs
from vitrine.sources.catalog import PROPERTIES, sample_catalog, table

# facets


@register(
    "narrowed_items",
    WITH + """SELECT id FROM resource WHERE class_id IN (1, 3) AND template_id = 2 AND id IN (SELECT item_id FROM member WHERE set_id IN (1, 2, 3, 4))
  AND id IN (SELECT resource_id FROM value WHERE contains(lower(value), 'an'))""",
)
def narrowed_items(spark, sf_dir):
    return facets.narrowed(sample_catalog(spark, sf_dir), classes=[1, 3], templates=[2], sets=[1, 2, 3, 4], text="AN")


FACETS = [
    facets.Facet("class", "resource_class", chosen=[2, 3]),
    facets.Facet("set", "item_set", chosen=[1, 2, 3, 4, 5]),
    facets.Facet("template", "resource_template"),
    facets.Facet("motif", "neq", PROPERTIES["motif"]),
    facets.Facet("without", "nin", PROPERTIES["support"], ["1", "2", "none of them"]),
    facets.Facet("with", "in", PROPERTIES["support"], ["1"], ["1"]),
    facets.Facet("has", "nex", values=[3, 7, 91]),
    facets.Facet("shown", "nres"),
]


@register(
    "category_facets",
    WITH + """pub AS (SELECT id, class_id, template_id FROM resource WHERE is_public), c AS (SELECT id FROM pub WHERE class_id IN (2, 3)),
s AS (SELECT item_id AS id FROM member WHERE set_id IN (1, 2, 3, 4, 5)), w AS (SELECT resource_id AS id FROM value WHERE property_id = 931 AND contains(value, '1')),
al AS (SELECT * FROM pub WHERE id IN (FROM c) AND id IN (FROM s) AND id IN (FROM w)), v AS (SELECT * FROM value WHERE resource_id IN (SELECT id FROM al))
SELECT 'class' AS facet, CAST(class_id AS VARCHAR) AS key, count(*) AS n FROM pub WHERE id IN (FROM s) AND id IN (FROM w) GROUP BY 2
UNION ALL SELECT 'set', CAST(set_id AS VARCHAR), count(*) FROM member WHERE item_id IN (SELECT id FROM pub WHERE id IN (FROM c) AND id IN (FROM w)) GROUP BY 2
UNION ALL SELECT 'template', CAST(template_id AS VARCHAR), count(*) FROM al GROUP BY 2
UNION ALL SELECT 'motif', value, count(*) FROM v WHERE property_id = 3 GROUP BY 2
UNION ALL SELECT 'without', t, (SELECT count(*) FROM al) - (SELECT count(DISTINCT resource_id) FROM v WHERE property_id = 931 AND contains(value, t)) FROM (SELECT unnest(['1', '2', 'none of them']) AS t)
UNION ALL SELECT 'with', '1', (SELECT count(DISTINCT resource_id) FROM value WHERE property_id = 931 AND contains(value, '1') AND resource_id IN (SELECT id FROM pub WHERE id IN (FROM c) AND id IN (FROM s)))
UNION ALL SELECT 'has', CAST(property_id AS VARCHAR), count(DISTINCT resource_id) FROM v WHERE property_id IN (3, 7, 91) GROUP BY 2
UNION ALL SELECT 'shown', CAST(target_id AS VARCHAR), count(*) FROM link WHERE item_id IN (SELECT id FROM al) GROUP BY 2""".replace("pub AS", ", pub AS", 1),
)
def category_facets(spark, sf_dir):
    return facets.category_facets(sample_catalog(spark, sf_dir), FACETS)


@register("texts_outside_sets", WITH + "SELECT resource_id AS item_id, value AS text FROM value WHERE property_id = 91 AND length(trim(value, ' ')) >= 10 AND resource_id NOT IN (SELECT item_id FROM member WHERE set_id IN (1, 2))")
def texts_outside_sets(spark, sf_dir):
    return facets.texts_outside_sets(sample_catalog(spark, sf_dir), PROPERTIES["transcription"], [1, 2])


@register(
    "press_list",
    WITH + """, m AS (SELECT item_id AS id FROM member WHERE set_id = 1) SELECT id, max(CASE WHEN property_id = 8 THEN value END) AS publisher, max(CASE WHEN property_id = 7 THEN value END) AS date,
  trim(max(CASE WHEN property_id = 8 THEN value END)) AS outlet, CASE trim(max(CASE WHEN property_id = 8 THEN value END)) WHEN 'PROMO' THEN 'promo.svg' ELSE '' END AS logo
FROM m JOIN resource USING (id) LEFT JOIN value ON resource_id = id AND property_id IN (7, 8) WHERE is_public GROUP BY 1""",
)
def press_list(spark, sf_dir):
    catalog = sample_catalog(spark, sf_dir)
    title = catalog.item_set.where("id = 1").first()["title"]
    return facets.press_list(catalog, title, {8: "publisher", 7: "date"}, {"PROMO": "promo.svg"})


# records


def _full(spark, sf_dir):
    """Full records with flaws, out of the orders."""
    key = F.col("o_orderkey")
    some = lambda n, value: F.when(key % n == 0, "").otherwise(value)
    none = F.array().cast("array<string>")
    date = F.when(key % 11 == 0, "").when(key % 13 == 0, "∅").when(key % 17 == 0, "1999:01:02 10:11:12").when(key % 19 == 0, "1950").otherwise(F.date_format("o_orderdate", "yyyy"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), some(7, "Title").alias("title"), date.alias("date"), F.element_at(F.array(*[F.lit(c) for c in ("A", "B", "X", "")]), (key % 4 + 1).cast("int")).alias("category"),
        F.when(key % 5 == 0, "tall").otherwise("12").alias("height"), some(3, "9.5").alias("width"),
        F.when(key % 9 == 0, none).when(key % 4 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("motifs"),
        some(8, "N").alias("identifier"), some(6, "Drawing").alias("work_type"), some(10, "Paper").alias("support"), some(12, "Good").alias("condition"),
        F.when(key % 14 == 0, "").when(key % 15 == 0, "x").when(key % 2 == 0, "↗").otherwise("∅").alias("signature"), some(16, "words").alias("transcription"),
        F.when(key % 18 == 0, none).otherwise(F.array(F.lit("Ink"))).alias("mediums"), some(20, "Unframed").alias("framing"), some(21, "Owner").alias("owner"),
        some(22, "Here").alias("location"), some(23, "Box 1").alias("box"), F.when(key % 24 == 0, 0).otherwise(2).alias("media_count"), (key % 25 == 0).alias("is_public"),
    )


FULL_SQL = """r AS (SELECT o_orderkey AS id, CASE WHEN id % 11 = 0 THEN '' WHEN id % 13 = 0 THEN '∅' WHEN id % 17 = 0 THEN '1999:01:02 10:11:12' WHEN id % 19 = 0 THEN '1950'
  ELSE CAST(year(o_orderdate) AS VARCHAR) END AS date, ['A', 'B', 'X', ''][id % 4 + 1] AS category, CASE WHEN id % 9 = 0 THEN 0 WHEN id % 4 = 0 THEN 2 ELSE 1 END AS motifs,
  CASE WHEN id % 14 = 0 THEN '' WHEN id % 15 = 0 THEN 'x' WHEN id % 2 = 0 THEN '↗' ELSE '∅' END AS sign FROM orders)"""


@register(
    "sprint_predicates",
    f"""WITH {FULL_SQL} SELECT id, id % 8 = 0 AS fix_identifier, id % 6 = 0 AS fix_work_type, id % 10 = 0 AS fix_support, id % 12 = 0 AS fix_condition, id % 16 = 0 AS fix_transcription,
  id % 20 = 0 AS fix_framing, id % 21 = 0 AS fix_owner, id % 22 = 0 AS fix_location, id % 23 = 0 AS fix_box,
  CASE date WHEN '' THEN true WHEN '∅' THEN sign NOT IN ('', '∅') ELSE contains(date, ':') OR CAST(date[1:4] AS INTEGER) NOT BETWEEN 1989 AND 2024 END AS fix_date,
  sign IN ('', 'x') OR (date NOT IN ('', '∅') AND sign = '∅') AS fix_signature, motifs < 2 AS fix_motifs, id % 18 = 0 AS fix_mediums, id % 5 = 0 OR id % 3 = 0 AS fix_dimensions,
  category IN ('', 'X') AS fix_category, id % 24 = 0 AS fix_media FROM r""",
)
def sprint_predicates(spark, sf_dir):
    return cleaning.sprint_predicates(_full(spark, sf_dir))


#: The checks of a record in their order, and what may be published, rule by rule.
ISSUES_SQL = FULL_SQL + """, y AS (SELECT *, regexp_matches(date, '^\\d{4}:\\d{2}:\\d{2}\\s+\\d{2}:\\d{2}:\\d{2}$') AS exif, TRY_CAST(nullif(regexp_extract(date, '\\d{4}'), '') AS INTEGER) AS year,
  date NOT IN ('', '∅') AS dated, sign NOT IN ('', '∅') AS signed FROM r),
i AS (SELECT *, list_filter([CASE WHEN id % 8 = 0 THEN 'identifier:missing' END, CASE WHEN id % 6 = 0 THEN 'work_type:missing' END, CASE WHEN id % 18 = 0 THEN 'mediums:missing' END, CASE WHEN id % 10 = 0 THEN 'support:missing' END,
  CASE WHEN id % 5 = 0 THEN 'height:non-numeric' END, CASE WHEN id % 3 = 0 THEN 'width:missing' END, CASE sign WHEN '' THEN 'signature:missing' WHEN 'x' THEN 'signature:invalid' END,
  CASE WHEN date = '' THEN 'date:missing' WHEN exif THEN 'date:EXIF timestamp' WHEN year < 1989 THEN 'date:pre-1989' WHEN year > 2024 THEN 'date:posthumous' END, CASE WHEN id % 20 = 0 THEN 'framing:missing' END,
  CASE WHEN id % 21 = 0 THEN 'owner:missing' END, CASE WHEN id % 22 = 0 THEN 'location:missing' END, CASE WHEN motifs = 0 THEN 'motifs:missing' END, CASE WHEN id % 24 = 0 THEN 'media:no image' END,
  CASE WHEN id % 23 = 0 THEN 'box:missing' END, CASE WHEN id % 16 = 0 THEN 'transcription:missing' END, CASE category WHEN '' THEN 'category:missing' WHEN 'X' THEN 'category:invalid' END,
  CASE WHEN signed AND NOT dated THEN 'date:signed but undated' END, CASE WHEN dated AND NOT signed THEN 'signature:dated but unsigned' END, CASE WHEN motifs = 2 THEN 'motifs:duplicate values' END], lambda x: x IS NOT NULL) AS issues FROM y)"""


@register("validate_full", f"WITH {ISSUES_SQL} SELECT id, array_to_string(issues, '|') AS issues FROM i")
def validate_full(spark, sf_dir):
    """All issues of full records, in the order of the checks."""
    listed = F.transform("issues", lambda x: F.concat_ws(":", x["field"], x["message"]))
    return cleaning.validate_items(_full(spark, sf_dir)).select("id", F.array_join(listed, "|").alias("issues"))


@register(
    "publish_ready",
    f"""WITH {ISSUES_SQL} SELECT id FROM y WHERE id % 25 <> 0 AND id % 24 <> 0 AND id % 8 <> 0 AND id % 6 <> 0 AND id % 18 <> 0 AND id % 10 <> 0 AND id % 5 <> 0 AND id % 3 <> 0 AND sign NOT IN ('', 'x') AND date <> '' AND NOT exif
  AND coalesce(year BETWEEN 1989 AND 2024, true) AND id % 20 <> 0 AND id % 21 <> 0""",
)
def publish_ready(spark, sf_dir):
    full = _full(spark, sf_dir)
    return full.where(cleaning.publish_ready(full)).select("id")


@register(
    "publish_warnings",
    f"""WITH {FULL_SQL} SELECT id, array_to_string(list_filter([CASE WHEN motifs = 0 THEN 'motifs' END, CASE WHEN id % 16 = 0 THEN 'transcription' END, CASE WHEN category = '' THEN 'category' END,
  CASE WHEN id % 23 = 0 THEN 'box' END, CASE WHEN id % 12 = 0 THEN 'condition' END, CASE WHEN id % 22 = 0 THEN 'location' END], lambda x: x IS NOT NULL), '|') AS warnings FROM r""",
)
def publish_warnings(spark, sf_dir):
    full = _full(spark, sf_dir)
    return full.select("id", F.array_join(cleaning.publish_warnings(full), "|").alias("warnings"))


@register(
    "coerced_lists",
    """WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) WHEN 2 THEN '["' || event_type || '", "unknown"]' ELSE 'unknown' END AS value, event_type AS t, event_id % 4 AS k FROM events)
SELECT id, CASE WHEN k < 2 THEN t ELSE '["' || t || '"]' END AS value FROM r WHERE k < 3""",
)
def coerced_lists(spark, sf_dir):
    events, key = table(spark, sf_dir, "events"), F.col("event_id") % 4
    listed = F.concat(F.lit('["'), "event_type", F.lit('", "unknown"]'))
    value = F.when(key == 0, F.col("event_type")).when(key == 1, F.upper("event_type")).when(key == 2, listed).otherwise("unknown")
    return cleaning.coerced_lists(events.select(F.col("event_id").alias("id"), value.alias("value")), events.select(F.col("event_type").alias("value")))


def _actions(spark, sf_dir):
    """An action for every word of the parts' names, some of them in capitals."""
    word, n = F.col("word"), F.length("word") % 4
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    action = F.when(n == 0, "canon").when(n == 1, "split").when(n == 2, "drop").otherwise("nonvisual")
    target = F.when(n == 0, F.array(F.initcap(word))).when(n == 1, F.array(F.concat(word, F.lit("1")), F.concat(word, F.lit("2"))))
    return words.select(F.when(F.length(word) > 5, F.upper(word)).otherwise(word).alias("value"), action.alias("action"), target.alias("target"))


@register(
    "removed_values",
    """WITH w AS (SELECT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS value FROM part)
SELECT item_id, value, ['canon', 'split', 'drop'][length(value) % 4 + 1] AS action FROM w WHERE length(value) % 4 < 3 AND length(value) <= 5""",
)
def removed_values(spark, sf_dir):
    return cleaning.removed_values(_motifs(spark, sf_dir).withColumnRenamed("motif", "value"), _actions(spark, sf_dir))


@register(
    "ground_truth",
    """WITH w AS (SELECT p_partkey AS item_id, p_type, unnest(string_split(p_name, ' ')) AS v FROM part), seeds AS (SELECT p_type, max(split_part(p_name, ' ', 1)) AS seed FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
g AS (SELECT item_id, unnest(CASE length(v) % 4 WHEN 0 THEN [upper(v[1]) || v[2:]] ELSE [v || '1', v || '2'] END) AS m FROM w LEFT JOIN seeds USING (p_type) WHERE length(v) % 4 < 2 AND (seed IS NULL OR seed <> v))
SELECT p_partkey AS item_id, coalesce((SELECT string_agg(DISTINCT m, '|' ORDER BY m) FROM g WHERE g.item_id = p_partkey), '') AS genuine,
  CASE WHEN p_type <> 'PROMO' THEN 'like ' || p_type END AS box_prior, CASE WHEN p_partkey % 2 = 1 THEN 1990 + p_size END AS year, p_partkey <= 40 AS early FROM part""",
)
def ground_truth(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    boxes = part.select(F.col("p_partkey").alias("item_id"), F.concat("p_type", F.lit(" (box "), F.col("p_size").cast("string"), F.lit(")")).alias("value"))
    seeds = part.where("p_type != 'PROMO'").groupBy(F.lower("p_type").alias("category")).agg(F.max(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("seed"), F.concat(F.lit("like "), F.max("p_type")).alias("prior"))
    years = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") + 1990).alias("year"))
    subjects = _motifs(spark, sf_dir).withColumnRenamed("motif", "value")
    found = cleaning.ground_truth(_items(spark, sf_dir), subjects, _actions(spark, sf_dir), boxes, seeds, years, 40)
    return found.withColumn("genuine", F.array_join("genuine", "|"))


@register(
    "ground_truth_counters",
    """WITH w AS (SELECT p_partkey AS item_id, p_type, unnest(string_split(p_name, ' ')) AS v FROM part), seeds AS (SELECT p_type, max(split_part(p_name, ' ', 1)) AS seed FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
j AS (SELECT w.*, CASE WHEN seed = v THEN 'seeded' ELSE ['canon', 'split', 'drop', 'nonvisual'][length(v) % 4 + 1] END AS action FROM w LEFT JOIN seeds USING (p_type)),
m AS (SELECT DISTINCT item_id, unnest(CASE action WHEN 'canon' THEN [upper(v[1]) || v[2:]] WHEN 'split' THEN [v || '1', v || '2'] ELSE [] END) AS m FROM j)
SELECT CASE action WHEN 'seeded' THEN 'box_derived_rows' WHEN 'drop' THEN 'junk_rows' ELSE 'nonvisual_rows' END AS counter, count(*) AS n FROM j WHERE action IN ('seeded', 'drop', 'nonvisual') GROUP BY 1
UNION ALL SELECT 'motif:' || m, count(*) FROM m GROUP BY 1""",
)
def ground_truth_counters(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    boxes = part.select(F.col("p_partkey").alias("item_id"), F.concat("p_type", F.lit(" (box "), F.col("p_size").cast("string"), F.lit(")")).alias("value"))
    seeds = part.where("p_type != 'PROMO'").groupBy(F.lower("p_type").alias("category")).agg(F.max(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("seed"), F.concat(F.lit("like "), F.max("p_type")).alias("prior"))
    return cleaning.ground_truth_counters(_motifs(spark, sf_dir).withColumnRenamed("motif", "value"), _actions(spark, sf_dir), boxes, seeds)


META = "Metafield: artwork.{} [{}]"


@register(
    "storefront_products",
    f"""WITH v AS (SELECT 'P' || l_partkey AS sku, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS price FROM lineitem GROUP BY 1),
i AS (SELECT p_partkey AS id, 'P ' || p_partkey AS sku, p_name, p_type, p_brand, p_size, CASE WHEN p_size % 2 = 0 THEN p_size || '" x ' || (p_size + 1) || '"' ELSE '' END AS size, 'https://x/files/original/f' || p_partkey || '.jpg' AS img,
  coalesce(text, '') AS text FROM part LEFT JOIN documents ON doc_id = p_partkey)
SELECT 'p-' || id AS "Handle", i.sku AS "Title", '' AS "Body (HTML)", 'The Studio' AS "Vendor", p_type AS "Type", array_to_string(string_split(p_name, ' '), ', ') AS "Tags", 'TRUE' AS "Published", img AS "Image Src",
  p_name AS "Image Alt Text", i.sku AS "Variant SKU", '0' AS "Variant Grams", '' AS "Variant Inventory Tracker", '1' AS "Variant Inventory Qty", 'deny' AS "Variant Inventory Policy",
  coalesce(CAST(CAST(price AS DECIMAL(12,2)) AS VARCHAR), '') AS "Variant Price", 'TRUE' AS "Variant Requires Shipping", 'draft' AS "Status", i.sku AS "{META.format('catalog_number', 'single_line_text_field')}",
  'https://x/s/studio/item/' || id AS "{META.format('catalog_url', 'url')}", p_brand AS "{META.format('medium', 'single_line_text_field')}", size AS "{META.format('dimensions', 'single_line_text_field')}",
  CAST(2000 + p_size AS VARCHAR) AS "{META.format('year', 'single_line_text_field')}", img AS "{META.format('original_image_url', 'url')}", '' AS "{META.format('signed', 'single_line_text_field')}",
  'good' AS "{META.format('condition', 'single_line_text_field')}", '' AS "{META.format('provenance', 'single_line_text_field')}",
  replace(CASE WHEN length(text) <= 200 THEN text WHEN regexp_matches(substr(text, 1, 200), '\\S\\s+\\S+\\s*$') THEN regexp_replace(substr(text, 1, 200), '\\s+\\S+\\s*$', '') || '…' ELSE regexp_replace(substr(text, 1, 200), '^\\s+|\\s+$', '', 'g') || '…' END, chr(10), ' ') AS "{META.format('content_excerpt', 'single_line_text_field')}"
FROM i LEFT JOIN v ON v.sku = replace(i.sku, ' ', '')""",
)
def storefront_products(spark, sf_dir):
    part, none = table(spark, sf_dir, "part"), F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), "text")
    items = part.join(docs, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("P "), F.col("p_partkey").cast("string")).alias("identifier"), F.col("p_name").alias("title"), F.col("p_type").alias("work_type"),
        F.col("p_brand").alias("medium"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("height"), (F.col("p_size") + 1).alias("width"), (F.col("p_size") + 2000).alias("date"),
        F.split("p_name", " ").alias("motifs"), none.alias("signature"), F.lit("good").alias("condition"), none.alias("provenance"), "text",
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("storage_id"),
    )
    variants = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P "), F.col("l_partkey").cast("string")).alias("sku"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")
    )
    return reshape.storefront_products(items, variants, "The Studio", "x", "studio")


# runs and samples


@register(
    "rarity_lookup",
    RARITY_SQL + " SELECT item_id, CAST(CASE WHEN score <= 20 THEN 1 WHEN score <= 40 THEN 2 WHEN score <= 60 THEN 3 WHEN score <= 80 THEN 4 ELSE 5 END AS INTEGER) AS class FROM r WHERE item_id BETWEEN 5 AND 60",
)
def rarity_lookup(spark, sf_dir):
    motifs = _motifs(spark, sf_dir)
    weights = motifs.select("motif").distinct().withColumn("weight", F.when(F.length("motif") < 5, rarity.BOXED).otherwise(rarity.VISUAL))
    return rarity.rarity_of(rarity.motif_rarity(_items(spark, sf_dir), motifs, weights), [*range(5, 61), -1, -2])


@register(
    "run_summary",
    f"""WITH {NAMES_SQL}, {WORDS_SQL}, m AS (SELECT * FROM words SEMI JOIN names USING (word)), p AS (SELECT item_id, count(*) AS c, sum(reps) AS reps FROM m GROUP BY 1),
d AS (SELECT doc_id, length(trim(text, ' ')) >= 10 AS long, c, reps FROM documents LEFT JOIN p ON item_id = doc_id)
SELECT CAST(count_if(long) AS BIGINT) AS processed, CAST(count_if(NOT long) AS BIGINT) AS too_short, CAST(count_if(long AND c > 0) AS BIGINT) AS with_matches, CAST(count_if(long AND c IS NULL) AS BIGINT) AS without_matches,
  CAST(coalesce(sum(c), 0) AS BIGINT) AS matches, CAST(coalesce(sum(reps), 0) AS BIGINT) AS reps, (SELECT count(DISTINCT lower(word)) FROM m) AS names FROM d""",
)
def run_summary(spark, sf_dir):
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit("name").alias("type"))
    texts = _texts(spark, sf_dir)
    return st.run_summary(texts, extraction.word_matches(extraction.words_of(texts), extraction.build_dictionary(names, []), []))


@register(
    "best_bands",
    """WITH b AS (SELECT user_id AS id, max(CASE WHEN value >= 80 THEN 2 WHEN value >= 40 THEN 1 ELSE 0 END) AS b FROM events GROUP BY 1)
SELECT CASE b WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'none' END AS best, count(*) AS items FROM customer LEFT JOIN b ON id = c_custkey GROUP BY 1""",
)
def best_bands(spark, sf_dir):
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), sg.band(F.col("value"), F.lit(80.0), F.lit(40.0)).alias("band"))
    return sg.best_bands(found, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@register(
    "era_sample",
    """WITH d AS (SELECT doc_id AS id, doc_id % 50 <> 7 AS early FROM documents), l AS (SELECT * FROM d WHERE NOT early ORDER BY id LIMIT 30)
SELECT * FROM l UNION ALL (SELECT * FROM d WHERE early ORDER BY id LIMIT (60 - (SELECT count(*) FROM l)))""",
)
def era_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50 != 7).alias("early"))
    return rounds.era_sample(docs, 60)


@register(
    "misread_words",
    f"""WITH {NAMES_SQL}, {WORDS_SQL} SELECT item_id, CASE word WHEN 'THE' THEN 'Thee' ELSE word END AS canonical, CASE word WHEN 'THE' THEN 'form' ELSE 'name' END AS type, word AS form, reps, 2 AS tier
FROM words WHERE word = 'THE' OR (word IN (SELECT word FROM names) AND word <> 'THAT')""",
)
def misread_words(spark, sf_dir):
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit("name").alias("type"))
    variants = spark.createDataFrame([("the", "Thee", "form")], "variant string, canonical string, type string")
    return extraction.word_matches(extraction.words_of(_texts(spark, sf_dir)), extraction.build_dictionary(names, []), ["THAT", "THE"], variants).drop("place")


@register("place_scan")
def place_scan(spark, sf_dir):
    """All tiers but the fuzzy one, names without a type as regions; each tier has SQL of its own, a test holds the type."""
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit(None).cast("string").alias("type")).unionByName(_phrases(spark, sf_dir))
    rules = spark.createDataFrame(RULES, "word string, canonical string, type string, context array<string>")
    return extraction.scan_places(_texts(spark, sf_dir), extraction.build_dictionary(staged(names, "names"), ["THAT"]), rules, ["THAT"])


@register(
    "coverage_lines",
    """SELECT event_id, 'Coverage of A. Name in ' || event_type || '. ' || CASE event_id % 3 WHEN 0 THEN 'Watch at' WHEN 1 THEN 'Read the PDF at' ELSE 'Read at' END || ' https://x/' || event_id AS line FROM events""",
)
def coverage_lines(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("video"), F.lit("pdf"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    address = F.concat(F.lit("https://x/"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", coverage("A. Name", F.col("event_type"), address, kind).alias("line"))


#: A number to one decimal without a trailing .0.
SHORT = "regexp_replace(printf('%.1f', round({}, 1)), '\\.0$', '')"


@register(
    "dimension_labels",
    f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS h, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS w FROM part)
SELECT id, CASE WHEN h IS NOT NULL AND w IS NOT NULL THEN {SHORT.format('h')} || ' × ' || {SHORT.format('w')} || ' in (' || {SHORT.format('h * 2.54')} || ' × ' || {SHORT.format('w * 2.54')} || ' cm)'
  WHEN h IS NOT NULL OR w IS NOT NULL THEN {SHORT.format('coalesce(h, w)')} || ' in (' || {SHORT.format('coalesce(h, w) * 2.54')} || ' cm)' ELSE 'about ' || id END AS label FROM p""",
)
def dimension_labels(spark, sf_dir):
    """Two lengths, one, or the extent as it is written."""
    key = F.col("p_partkey")
    height = F.when(key % 5 > 0, F.col("p_size").cast("string")).otherwise("tall")
    width = F.when(key % 3 > 0, F.col("p_retailprice").cast("string"))
    extent = F.concat(F.lit("about "), key.cast("string"))
    return table(spark, sf_dir, "part").select(key.alias("id"), text.dimensions(height, width, extent).alias("label"))


@register(
    "press_dates",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%B %-d, %Y') WHEN 1 THEN strftime(ts, '%Y') ELSE 'in ' || event_type END AS shown FROM events""",
)
def press_dates(spark, sf_dir):
    """Dates written out; what is no whole date stays as it is."""
    key = F.col("event_id")
    written = F.when(key % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(key % 3 == 1, F.date_format("ts", "yyyy")).otherwise(F.concat(F.lit("in "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", dates.pretty_date(written).alias("shown"))


@register(
    "canonical_names",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'T.S. ' || event_type WHEN 1 THEN 'A.B. C. ' || event_type WHEN 2 THEN 'The Visitor' ELSE event_type END AS name FROM events""",
)
def canonical_names(spark, sf_dir):
    """Initials collapsed in pairs, some names replaced whatever their case."""
    kind = F.col("event_type")
    forms = F.array(F.concat(F.lit("T. S. "), kind), F.concat(F.lit("A. B. C. "), kind), F.lit("V. Isitor"), kind)
    given = F.element_at(forms, (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.canonical_name(given, {"v. isitor": "The Visitor"}).alias("name"))
