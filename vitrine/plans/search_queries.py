"""Queries over rarity, vectors and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions.text import STOPWORDS
from vitrine.operators import rarity, search
from vitrine.plans.items_queries import WITH
from vitrine.plans.registry import register
from vitrine.sources.catalog import PROPERTIES, sample_catalog, table


def _motifs(spark, sf_dir):
    value = sample_catalog(spark, sf_dir).value.where(F.col("property_id") == PROPERTIES["motif"])
    return value.select(F.col("resource_id").alias("item_id"), F.col("value").alias("motif"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))


FREQUENCY = WITH + """, m AS (SELECT resource_id AS item_id, value AS motif FROM value WHERE property_id = 3),
f AS (SELECT motif, count(DISTINCT item_id) AS df FROM m GROUP BY 1)"""


@register("motif_frequency", FREQUENCY + " SELECT * FROM f")
def motif_frequency(spark, sf_dir):
    return rarity.motif_frequency(_motifs(spark, sf_dir))


RARITY_SQL = FREQUENCY + """, t AS (SELECT count(*) AS total FROM part),
s AS (SELECT item_id, exp(avg(ln(greatest(ln((total + 1) / (df + 1)) * CASE WHEN length(motif) < 5 THEN 0.7 ELSE 1 END, 0.001)))) AS mean
  FROM m JOIN f USING (motif), t GROUP BY 1),
r AS (SELECT p_partkey AS item_id, coalesce(least(greatest(mean / ln(total + 1) * 100, 0), 100), 0) AS score FROM part LEFT JOIN s ON item_id = p_partkey, t)"""


@register(
    "motif_rarity",
    RARITY_SQL
    + """ SELECT item_id, round(score, 6) AS score, CAST(CASE WHEN score <= 20 THEN 1 WHEN score <= 40 THEN 2 WHEN score <= 60 THEN 3
  WHEN score <= 80 THEN 4 ELSE 5 END AS INTEGER) AS class FROM r""",
)
def motif_rarity(spark, sf_dir):
    motifs = _motifs(spark, sf_dir)
    weights = motifs.select("motif").distinct().withColumn("weight", F.when(F.length("motif") < 5, rarity.BOXED).otherwise(rarity.VISUAL))
    return rarity.motif_rarity(_items(spark, sf_dir), motifs, weights).withColumn("score", F.round("score", 6))


@register("motif_details", FREQUENCY + " SELECT item_id, motif, df, row_number() OVER (PARTITION BY item_id ORDER BY df, motif) AS rank FROM (SELECT DISTINCT * FROM m) JOIN f USING (motif)")
def motif_details(spark, sf_dir):
    return rarity.motif_details(_items(spark, sf_dir), _motifs(spark, sf_dir))


@register(
    "mention_profile",
    """WITH m AS (SELECT DISTINCT user_id AS item_id, CASE WHEN user_id % 10 = 0 THEN 'NONE' ELSE event_type || (event_id % 50) END AS mention FROM events),
r AS (SELECT * FROM m WHERE mention <> 'NONE'), d AS (SELECT mention, count(*) AS df FROM r GROUP BY 1)
SELECT item_id, mention, df, round(df * 100.0 / (SELECT count(DISTINCT item_id) FROM r), 6) AS percent, df = 1 AS "unique" FROM r JOIN d USING (mention)""",
)
def mention_profile(spark, sf_dir):
    name = F.concat("event_type", (F.col("event_id") % 50).cast("string"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.when(F.col("user_id") % 10 == 0, "NONE").otherwise(name).alias("mention")
    )
    return rarity.mention_profile(rows).withColumn("percent", F.round("percent", 6))


STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)
WORDS_SQL = f"""WITH w AS (SELECT doc_id AS item_id, word, min(pos) AS pos FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word,
  generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM documents) WHERE length(word) >= 2 AND word NOT IN ({STOP_SQL}) GROUP BY 1, 2),
d AS (SELECT word, count(*) AS df FROM w GROUP BY 1)"""


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


@register("lexical_frequency", WORDS_SQL + " SELECT * FROM d")
def lexical_frequency(spark, sf_dir):
    return rarity.lexical_frequency(_texts(spark, sf_dir))


@register(
    "lexical_profile",
    WORDS_SQL
    + """ SELECT item_id, word, df, round(df * 100.0 / (SELECT count(*) FROM documents), 6) AS percent,
  row_number() OVER (PARTITION BY item_id ORDER BY df, pos) AS rank FROM w JOIN d USING (word) QUALIFY rank <= 25""",
)
def lexical_profile(spark, sf_dir):
    return rarity.lexical_profile(_texts(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 2 + 1).alias("version"), "label")


COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@register(
    "similar_items",
    f"SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND b.vec_id % 2 = 1 ORDER BY {COS} DESC, 1 LIMIT 30",
)
def similar_items(spark, sf_dir):
    return search.similar(_vectors(spark, sf_dir), 7, 30, 2).withColumn("score", F.round("score", 6))


@register(
    "vector_search",
    f"SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings b, (SELECT [1.0] || list_transform(range(63), lambda x: 0.5) AS embedding) a WHERE {COS} >= 0.05 ORDER BY {COS} DESC, 1 LIMIT 20",
)
def vector_search(spark, sf_dir):
    return search.vector_search(_vectors(spark, sf_dir), [1.0] + [0.5] * 63, 20, 0.05).withColumn("score", F.round("score", 6))


@register(
    "similar_all",
    f"""SELECT a.vec_id AS id, b.vec_id AS other, round({COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank
FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id QUALIFY rank <= 5""",
)
def similar_all(spark, sf_dir):
    return search.similar_all(_vectors(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


LEXICAL_SQL = """WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
h AS (SELECT id, word, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(w) AS n, unnest(w) AS word FROM t) WHERE word IN ('the', 'of') GROUP BY 1, 2),
d AS (SELECT word, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM h JOIN d USING (word), c
  GROUP BY 1 HAVING count(*) = 2)"""


@register("lexical_search", LEXICAL_SQL + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 50")
def lexical_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.lexical_search(docs, "the of").withColumn("score", F.round("score", 6))


#: How often each part of a query occurs in the folded words, counted by position.
PARTS_SQL = """WITH t AS (SELECT doc_id AS id, doc_id % 2 + 1 AS version, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
f AS (SELECT id, version, len(w) AS n, {frequencies} FROM t), c AS (SELECT count(*) AS docs, avg(n) AS mean, {documents} FROM f),
s AS (SELECT id, {score} AS score FROM f, c WHERE {every})"""


def _parts_sql(phrases: list[list[str]], extra: str = "") -> str:
    counted = []
    for i, words in enumerate(phrases):
        here = " AND ".join(f"w[i + {n}] = '{x}'" for n, x in enumerate(words))
        counted.append(f"len(list_filter(range(1, greatest(len(w) - {len(words) - 2}, 1)), lambda i: {here})) AS f{i}")
    weight = lambda i: f"ln((docs - d{i} + 0.5) / (d{i} + 0.5) + 1) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))"
    some = range(len(phrases))
    return PARTS_SQL.format(
        frequencies=", ".join(counted),
        documents=", ".join(f"count_if(f{i} > 0) AS d{i}" for i in some),
        score=" + ".join(map(weight, some)),
        every=" AND ".join(f"f{i} > 0" for i in some) + extra,
    )


@register("lexical_accents", _parts_sql([["fur"], ["e"]]) + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 50")
def lexical_accents(spark, sf_dir):
    """Accents on either side make no difference."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.lexical_search(docs, "FÜR é").withColumn("score", F.round("score", 6))


@register("lexical_phrase", _parts_sql([["the", "the"], ["of"]], " AND version = 2") + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20 OFFSET 3")
def lexical_phrase(spark, sf_dir):
    """A phrase, a word, and one version of the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 2 + 1).alias("version"))
    return search.lexical_search(docs, "the-The of", 20, 3, 2).withColumn("score", F.round("score", 6))


@register(
    "boosted_hits",
    """WITH h AS (SELECT doc_id AS id, n_chars / 1000.0 AS score, list_distinct(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+')) AS tags,
  list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS blob FROM documents)
SELECT id, round(score + CASE WHEN list_has_any(tags, ['en', 'the']) THEN 0.1 ELSE 0 END
  + CASE WHEN list_has_any(list_filter(blob, lambda x: NOT list_contains(tags, x)), ['en', 'the']) THEN 0.03 ELSE 0 END, 6) AS boosted FROM h""",
)
def boosted_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"), F.concat_ws(" ", "source", "lang").alias("tags"), F.col("text").alias("blob")
    )
    return search.boosted(hits, "The EN").select("id", F.round("boosted", 6).alias("boosted"))


@register(
    "fused_search",
    LEXICAL_SQL
    + f""", l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 50)),
v AS (SELECT b.vec_id AS id, row_number() OVER (ORDER BY {COS} DESC, b.vec_id) - 1 AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7
  AND b.vec_id % 2 = 1 QUALIFY rank < 50),
f AS (SELECT id, sum(p) AS score FROM (SELECT id, 0.6 / (61 + rank) AS p FROM v UNION ALL SELECT id, 0.4 / (61 + rank) FROM l) GROUP BY 1)
SELECT id, round(score, 9) AS score, round(score / (SELECT max(score) FROM f), 6) AS normal FROM f""",
)
def fused_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = search.fused(search.similar(_vectors(spark, sf_dir), 7, 50, 2), search.lexical_search(docs, "the of"))
    return found.select("id", F.round("score", 9).alias("score"), F.round("normal", 6).alias("normal"))

