"""Queries over dictionary matches, web pages and suggestions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import dictionary
from vitrine.operators import extraction as ex
from vitrine.operators import suggestion as sg
from vitrine.operators.numbering import row_numbers
from vitrine.operators.staging import staged
from vitrine.plans.registry import register
from vitrine.sources.catalog import table

#: The sharp s has two capitals in Spark and none in DuckDB.
UP = "regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z]{2,}(?:''[A-Z]+)?')"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("item_id"), "text")


def _words(spark, sf_dir):
    """Frequent words as the dictionary's names, so that it grows with the corpus like its vocabulary."""
    bench = table(spark, sf_dir, "benchmark")
    return bench.select(F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]{2,}(?:'[A-Z]+)?"), 0))).alias("word")).distinct()


NAMES_SQL = f"names AS (SELECT DISTINCT unnest({UP.replace('text', 'b.text', 1)}) AS word FROM benchmark b)"
WORDS_SQL = f"words AS (SELECT item_id, word, count(*) AS reps FROM (SELECT doc_id AS item_id, unnest({UP}) AS word FROM documents) GROUP BY 1, 2)"


@register("text_words", f"WITH {WORDS_SQL} SELECT * FROM words")
def text_words(spark, sf_dir):
    return ex.words_of(_texts(spark, sf_dir))


@register(
    "word_matches",
    f"WITH {NAMES_SQL}, {WORDS_SQL} SELECT item_id, word AS canonical, 'name' AS type, word AS form, reps, 2 AS tier FROM words SEMI JOIN names USING (word) WHERE word <> 'THAT'",
)
def word_matches(spark, sf_dir):
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit("name").alias("type"))
    return ex.word_matches(ex.words_of(_texts(spark, sf_dir)), ex.build_dictionary(names, []), ["THAT"]).drop("place")


def _phrases(spark, sf_dir):
    first = F.regexp_extract(F.upper("text"), r"^\s*([A-Z]{2,} [A-Z]{2,})", 1)
    rows = table(spark, sf_dir, "documents").select(first.alias("canonical")).where("canonical != ''").distinct()
    return rows.withColumn("type", F.lit("phrase"))


@register(
    "phrase_matches",
    """WITH p AS (SELECT DISTINCT regexp_extract(upper(replace(text, 'ß', 'ss')), '^\\s*([A-Z]{2,} [A-Z]{2,})', 1) AS c FROM documents), q AS (SELECT c FROM p WHERE c <> ''),
t AS (SELECT doc_id AS item_id, upper(trim(regexp_replace(regexp_replace(replace(replace(replace(text, 'ß', 'ss'), chr(10), ' '), chr(13), ''), '([A-Za-z]{2,})-\\s+([A-Za-z]{2,})', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) AS t FROM documents)
SELECT item_id, c AS canonical, 'phrase' AS type, c AS form, (length(t) - length(replace(t, c, ''))) // length(c) AS reps, 1 AS tier
FROM t JOIN q ON contains(t, c)""",
)
def phrase_matches(spark, sf_dir):
    return ex.phrase_matches(_texts(spark, sf_dir), ex.build_dictionary(_phrases(spark, sf_dir), [])).drop("place")


@register(
    "fuzzy_matches",
    f"""WITH {NAMES_SQL}, {WORDS_SQL}, v AS (SELECT DISTINCT word FROM words WHERE length(word) >= 7 AND word NOT IN (SELECT word FROM names)), n AS (SELECT word AS t FROM names WHERE length(word) >= 7),
near AS (SELECT word, min(t) AS t FROM v JOIN n ON abs(length(word) - length(t)) <= 1 AND levenshtein(word, t) = 1 GROUP BY 1)
SELECT item_id, t AS canonical, 'name' AS type, word AS form, reps, 3 AS tier FROM words JOIN near USING (word)""",
)
def fuzzy_matches(spark, sf_dir):
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit("name").alias("type"))
    return ex.fuzzy_matches(ex.words_of(_texts(spark, sf_dir)), ex.build_dictionary(names, []), []).drop("place")


#: Names and mentions of parts, then suppliers' names and triggers; the rules of precedence written out.
DICTIONARY_SQL = """a AS (SELECT p_name AS canonical, min(p_partkey) AS pos, arg_min(p_brand, p_partkey) AS type FROM part GROUP BY 1),
w AS (SELECT *, string_split(canonical, ' ') AS w FROM a), m AS (SELECT DISTINCT a.canonical, pos, upper(m) AS t FROM a JOIN (SELECT p_name, unnest([p_type, p_brand || ' ' || p_type, p_type || ' a b c d', 'ab']) AS m FROM part) ON p_name = a.canonical),
b AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Sup ' || s_name END AS canonical, s_name AS type, ['promo', 'x' || s_suppkey, 'ring'] AS singles, ['Promo Two', s_name || ' inc'] AS multis FROM supplier),
x AS (SELECT 1 AS tier, upper(canonical) AS t, canonical, 0 AS s, pos, 0 AS k FROM w WHERE len(w) > 1
  UNION ALL SELECT unnest([2, 3]), upper(w[-1]), canonical, 0, pos, 1 FROM w WHERE upper(w[-1]) <> 'BOLT' AND (len(w) = 1 OR length(w[-1]) >= 4)
  UNION ALL SELECT CASE WHEN len(string_split(t, ' ')) > 1 THEN 1 ELSE 2 END, t, canonical, 0, pos, 2 FROM m WHERE len(string_split(t, ' ')) BETWEEN 2 AND 4 OR (len(string_split(t, ' ')) = 1 AND t <> 'BOLT' AND length(t) >= 4)
  UNION ALL SELECT unnest([2, 3]), t, canonical, 1, pos, 0 FROM (SELECT upper(unnest(singles)) AS t, canonical, pos FROM b) WHERE t <> 'BOLT'
  UNION ALL SELECT 1, upper(unnest(multis)), canonical, 1, pos, 1 FROM b UNION ALL SELECT 1, upper(canonical), canonical, 1, pos, 2 FROM b WHERE contains(canonical, ' ')),
y AS (SELECT * FROM x WHERE NOT (tier = 3 AND s = 0 AND t = 'GEAR')),
f AS (SELECT tier, t, coalesce(arg_max(canonical, (pos, k, t)) FILTER (s = 0), arg_min(canonical, (pos, k, t)) FILTER (s = 1)) AS canonical, min((s, pos, k)) AS place FROM y GROUP BY 1, 2),
c AS (SELECT canonical, arg_min(type, (s, pos)) AS type FROM (SELECT canonical, type, 0 AS s, pos FROM a UNION ALL SELECT canonical, type, 1, pos FROM b) GROUP BY 1)"""


@register("built_dictionary", f"WITH {DICTIONARY_SQL} SELECT t AS trigger, f.canonical, type, tier, CAST(dense_rank() OVER (ORDER BY place, t) AS BIGINT) AS place FROM f JOIN c USING (canonical)")
def built_dictionary(spark, sf_dir):
    """Triggers of parts found before, in their order, and of suppliers where nothing has them yet."""
    part = table(spark, sf_dir, "part")
    said = F.array("p_type", F.concat_ws(" ", "p_brand", "p_type"), F.concat("p_type", F.lit(" a b c d")), F.lit("ab"))
    prior = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("canonical"), F.col("p_brand").alias("type"), F.explode(said).alias("mention"))
    key, name = F.col("s_suppkey"), F.col("s_name")
    more = table(spark, sf_dir, "supplier").select(
        key.alias("pos"), F.when(key % 3 == 0, name).otherwise(F.concat(F.lit("Sup "), name)).alias("canonical"), name.alias("type"),
        F.array(F.lit("promo"), F.concat(F.lit("x"), key.cast("string")), F.lit("ring")).alias("singles"), F.array(F.lit("Promo Two"), F.concat(name, F.lit(" inc"))).alias("multis"),
    )
    found = dictionary.build(prior, more, ("BOLT",), ("GEAR",))
    order = F.dense_rank().over(Window.orderBy("place.source", "place.pos", "place.step", "trigger"))  # the triggers of two small tables
    return found.select("trigger", "canonical", "type", "tier", order.cast("long").alias("place"))


RULES = [("THE", "The One", "sort", ["AND", "OF", "DER"]), ("DIE", "Die", "sort", ["UND", "DER", "DE"])]


@register(
    "context_matches",
    f"""WITH {WORDS_SQL}, r AS (SELECT unnest([{{'word': 'THE', 'c': 'The One', 'x': ['AND', 'OF', 'DER']}}, {{'word': 'DIE', 'c': 'Die', 'x': ['UND', 'DER', 'DE']}}]) AS r),
h AS (SELECT item_id, words.word, r.c AS canonical, reps, unnest(r.x) AS other FROM words JOIN r ON words.word = r.word)
SELECT h.item_id, canonical, 'sort' AS type, h.word AS form, max(h.reps) AS reps, 4 AS tier FROM h JOIN words o ON o.item_id = h.item_id AND o.word = h.other
GROUP BY ALL HAVING count(DISTINCT other) >= 2""",
)
def context_matches(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "word string, canonical string, type string, context array<string>")
    return ex.context_matches(ex.words_of(_texts(spark, sf_dir)), rules)


@register(
    "place_context",
    f"""WITH {WORDS_SQL}, r AS (SELECT unnest([{{'word': 'THE', 'c': 'The One', 'x': ['AND', 'OF', 'DER']}}, {{'word': 'DIE', 'c': 'Die', 'x': ['UND', 'DER', 'DE']}}]) AS r),
h AS (SELECT item_id, words.word, r.c AS canonical, reps, unnest(r.x) AS other FROM words JOIN r ON words.word = r.word)
SELECT h.item_id, canonical, 'sort' AS type, h.word AS form, max(h.reps) AS reps, 4 AS tier FROM h JOIN words o ON o.item_id = h.item_id AND contains(o.word, h.other)
GROUP BY ALL HAVING count(DISTINCT other) >= 2""",
)
def place_context(spark, sf_dir):
    """Context words also within other words."""
    rules = spark.createDataFrame(RULES, "word string, canonical string, type string, context array<string>")
    return ex.context_matches(ex.words_of(_texts(spark, sf_dir)), rules, inside=True)


@register("dictionary_scan")
def dictionary_scan(spark, sf_dir):
    """All tiers with their priority; each tier has its own SQL above, and their priority a test."""
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit("name").alias("type")).unionByName(_phrases(spark, sf_dir))
    rules = spark.createDataFrame(RULES, "word string, canonical string, type string, context array<string>")
    return ex.scan(_texts(spark, sf_dir), ex.build_dictionary(staged(names, "names"), ["THAT"]), rules, ["THAT"])


@register(
    "unmatched_words",
    f"""WITH {NAMES_SQL}, {WORDS_SQL}, f AS (SELECT item_id, list_sort(list(DISTINCT word)) AS w FROM words ANTI JOIN names USING (word) WHERE length(word) >= 4 GROUP BY 1)
SELECT item_id, array_to_string(w[1:20], '|') AS candidates, CAST(len(w) AS INTEGER) AS n FROM f""",
)
def unmatched_words(spark, sf_dir):
    words = ex.words_of(_texts(spark, sf_dir))
    matches = words.join(_words(spark, sf_dir), "word", "left_semi").select("item_id", F.col("word").alias("form"))
    return ex.unmatched(words, matches, []).withColumn("candidates", F.array_join("candidates", "|"))


REPORT = f"{NAMES_SQL}, {WORDS_SQL}, m AS (SELECT * FROM words SEMI JOIN names USING (word))"


@register(
    "repetition_report",
    f"WITH {REPORT} SELECT lower(word) AS name, count(DISTINCT item_id) AS items, CAST(sum(reps) AS BIGINT) AS reps, round(sum(reps) / count(DISTINCT item_id), 1) AS per_item, 2 AS primary_tier FROM m GROUP BY 1",
)
def repetition_report(spark, sf_dir):
    names = _words(spark, sf_dir).select(F.col("word").alias("canonical"), F.lit("name").alias("type"))
    return ex.repetition_report(ex.word_matches(ex.words_of(_texts(spark, sf_dir)), ex.build_dictionary(names, []), []))


@register(
    "compared_corpora",
    f"""WITH {WORDS_SQL}, a AS (SELECT word AS name, count(*) AS total FROM words WHERE item_id % 2 = 0 GROUP BY 1), b AS (SELECT word AS name, count(*) AS total FROM words WHERE item_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.total IS NULL THEN 'left only' WHEN a.total IS NULL THEN 'right only' ELSE 'both' END AS "where",
  a.total AS "left", b.total AS "right", coalesce(a.total, 0) + coalesce(b.total, 0) AS combined FROM a FULL JOIN b ON a.name = b.name""",
)
def compared_corpora(spark, sf_dir):
    counts = ex.words_of(_texts(spark, sf_dir)).withColumn("side", F.col("item_id") % 2).groupBy(F.col("word").alias("name"), "side").agg(F.count("*").alias("total"))
    return ex.compared(counts.where("side = 0"), counts.where("side = 1"))


@register(
    "page_corpus",
    """WITH l AS (SELECT url, max(page_id) AS page_id, arg_max(html, page_id) AS html FROM pages GROUP BY 1),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM l),
k AS (SELECT *, sha256(lower(text)) AS dedup_key FROM t)
SELECT *, min(page_id) OVER (PARTITION BY dedup_key) AS first_page, count(*) OVER (PARTITION BY dedup_key) AS copies, page_id = min(page_id) OVER (PARTITION BY dedup_key) AS is_first FROM k""",
)
def page_corpus(spark, sf_dir):
    return ex.page_corpus(table(spark, sf_dir, "pages"))


@register("numbered_pages", "SELECT page_id, row_number() OVER (ORDER BY page_id) AS seq FROM pages")
def numbered_pages(spark, sf_dir):
    return row_numbers(table(spark, sf_dir, "pages").select("page_id"), "page_id", "seq")


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return vectors.select("id", "v"), vectors.where("id % 3 != 0").select("id", "label")


UNIT_SQL = """e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
x AS (SELECT id, label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM e WHERE id % 3 <> 0),
s AS (SELECT label, p, sum(x) AS x, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY p) AS total, max(n) AS n FROM s GROUP BY 1)"""


@register(
    "centroid_scores",
    f"""WITH {UNIT_SQL} SELECT e.id, c.label, round(CASE WHEN e.id % 3 = 0 OR e.label <> c.label OR n = 1 THEN list_inner_product(u, total) / sqrt(list_inner_product(total, total))
  ELSE (list_inner_product(u, total) - list_inner_product(u, u)) / sqrt(list_inner_product(total, total) - 2 * list_inner_product(u, total) + list_inner_product(u, u)) END, 6) AS score FROM e, c""",
)
def centroid_scores(spark, sf_dir):
    return sg.centroid_scores(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _scored(spark, sf_dir):
    """Scores with hits: values of events, hit where the id is divisible by three."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("label"), (F.col("value") + F.col("event_id") / 1e9).alias("score"), (F.col("event_id") % 3 != 0).cast("int").alias("hit"))


SCORED_SQL = "s AS (SELECT event_type AS label, value + event_id / 1e9 AS score, CAST(event_id % 3 <> 0 AS INTEGER) AS hit, event_id FROM events)"


@register(
    "thresholds",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER w AS n, sum(hit) OVER w / row_number() OVER w AS p FROM s
  WINDOW w AS (PARTITION BY label ORDER BY score DESC, hit DESC ROWS UNBOUNDED PRECEDING))
SELECT label, round(arg_max(CASE WHEN p >= 0.7 THEN score END, CASE WHEN p >= 0.7 THEN n END), 6) AS high, round(arg_max(CASE WHEN p >= 0.66 THEN score END, CASE WHEN p >= 0.66 THEN n END), 6) AS medium
FROM r WHERE n >= 5 GROUP BY 1""",
)
def thresholds(spark, sf_dir):
    found = sg.thresholds(_scored(spark, sf_dir), {"high": 0.7, "medium": 0.66})
    return found.select("label", F.round("high", 6).alias("high"), F.round("medium", 6).alias("medium"))


@register(
    "precision_at_ranks",
    f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, hit DESC) AS k FROM s)
SELECT label, round(avg(CASE WHEN k <= 10 THEN hit END), 3) AS p10, round(avg(CASE WHEN k <= 25 THEN hit END), 3) AS p25, round(avg(CASE WHEN k <= 50 THEN hit END), 3) AS p50 FROM r GROUP BY 1""",
)
def precision_at_ranks(spark, sf_dir):
    return sg.precision_at_ranks(_scored(spark, sf_dir), [10, 25, 50])


@register(
    "weak_positives",
    f"""WITH {SCORED_SQL}, q AS (SELECT label, quantile_cont(score, 0.4) AS cut FROM s GROUP BY 1) SELECT s.label, round(score, 6) AS score, hit FROM s JOIN q ON q.label = s.label WHERE score >= cut""",
)
def weak_positives(spark, sf_dir):
    return sg.weak_positives(_scored(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register(
    "precision_at",
    """WITH a AS (SELECT event_type AS label, value AS score, event_id, event_id % 2 AS c, CAST(event_id % 3 <> 0 AND event_id % 2 = 1 AS INTEGER) AS hit FROM events),
w AS (SELECT *, (sum(hit) OVER v + 1) / (sum(c) OVER v + 2) AS confidence FROM a WINDOW v AS (PARTITION BY label ORDER BY score DESC RANGE UNBOUNDED PRECEDING))
SELECT event_id AS id, label, score, round(confidence, 6) AS confidence FROM w WHERE c = 0""",
)
def precision_at(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    calibration = events.where("id % 2 = 1").select("label", "score", (F.col("id") % 3 != 0).cast("int").alias("hit"))
    return sg.precision_at(calibration, events.where("id % 2 = 0")).withColumn("confidence", F.round("confidence", 6))


NEAR_SQL = f"""{UNIT_SQL}, d AS (SELECT a.id, b.id AS other, b.label, list_inner_product(a.u, b.u) AS score FROM e a JOIN e b ON a.id <> b.id AND b.id % 3 <> 0),
k AS (SELECT *, greatest(score, 0) AS w FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 25),
votes AS (SELECT id, label, CASE WHEN t > 0 THEN s / t ELSE 0 END AS score FROM (SELECT id, label, sum(w) AS s FROM k GROUP BY 1, 2) JOIN (SELECT id, sum(w) AS t FROM k GROUP BY 1) USING (id))"""


@register("neighbour_votes", f"WITH {NEAR_SQL} SELECT id, label, round(score, 6) AS score FROM votes")
def neighbour_votes(spark, sf_dir):
    return sg.neighbour_votes(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


#: The matrix of items and labels, written out: a vote that nothing gives is 0, deviations are at least 1e-6.
COMBINED_SQL = NEAR_SQL + """, cs AS (SELECT e.id, c.label, e.id % 3 <> 0 AS tagged, e.id % 3 <> 0 AND e.label = c.label AS own, coalesce(v.score, 0) AS sk,
  CASE WHEN e.id % 3 = 0 OR e.label <> c.label OR n = 1 THEN list_inner_product(u, total) / sqrt(list_inner_product(total, total))
  ELSE (list_inner_product(u, total) - list_inner_product(u, u)) / sqrt(list_inner_product(total, total) - 2 * list_inner_product(u, total) + list_inner_product(u, u)) END AS sc
  FROM e CROSS JOIN c LEFT JOIN votes v ON v.id = e.id AND v.label = c.label),
z AS (SELECT *, (sc - avg(sc) OVER w) / greatest(stddev_pop(sc) OVER w, 1e-6) AS zc, (sk - avg(sk) OVER w) / greatest(stddev_pop(sk) OVER w, 1e-6) AS zk FROM cs WINDOW w AS (PARTITION BY label)),
comb AS (SELECT *, (zc * 0.5 + zk * 0.3) / 0.8 AS score, CASE WHEN zc >= zk THEN 'centroid' ELSE 'knn' END AS method FROM z)"""

#: Bands and confidence from the labelled rows, scanned from the best score down.
BANDS_SQL = """, r AS (SELECT label, score, CAST(own AS INTEGER) AS hit, row_number() OVER w AS n, sum(CAST(own AS INTEGER)) OVER w AS hits FROM comb WHERE tagged
  WINDOW w AS (PARTITION BY label ORDER BY score DESC, own DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT label, sum(hit) AS pos, CASE WHEN sum(hit) > 0 THEN round(avg(CASE WHEN n <= 10 THEN hit END), 3) END AS p10, CASE WHEN sum(hit) > 0 THEN round(avg(CASE WHEN n <= 25 THEN hit END), 3) END AS p25,
  CASE WHEN sum(hit) > 0 THEN round(avg(CASE WHEN n <= 50 THEN hit END), 3) END AS p50, max(CASE WHEN n >= 5 AND hits / n >= 0.9 THEN n END) AS nh, max(CASE WHEN n >= 5 AND hits / n >= 0.6 THEN n END) AS nm FROM r GROUP BY 1),
cuts AS (SELECT q.label, pos, p10, p25, p50, h.score AS high, h.n AS high_support, round(h.hits / h.n, 3) AS high_precision, m.score AS medium, m.n AS medium_support, round(m.hits / m.n, 3) AS medium_precision
  FROM q LEFT JOIN r h ON h.label = q.label AND h.n = nh AND pos >= 5 LEFT JOIN r m ON m.label = q.label AND m.n = nm AND pos >= 5),
b AS (SELECT comb.*, CASE WHEN score >= high THEN 'high' ELSE 'medium' END AS band,
  (SELECT (coalesce(sum(hit), 0) + 1) / (count(*) + 2) FROM r WHERE r.label = comb.label AND r.score >= comb.score) AS confidence FROM comb JOIN cuts USING (label) WHERE score >= medium AND NOT own),
tags AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY band, confidence DESC, label) AS rank FROM b QUALIFY rank <= 5)"""


@register("label_scores", f"WITH {COMBINED_SQL} SELECT id, label, round(score, 5) AS score, method FROM comb")
def label_scores(spark, sf_dir):
    """Combined scores of every vector and label."""
    return sg.label_scores(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 5))


def _shown_tags(found):
    rounded = [F.round(c, 5).alias(c) for c in found.columns if c in ("score", "confidence") or c.startswith("s_")]
    return found.select("id", "label", "method", "band", "rank", *rounded)


@register(
    "pre_tag",
    f"WITH {COMBINED_SQL}{BANDS_SQL} SELECT id, label, round(score, 5) AS score, round(confidence, 5) AS confidence, method, band, rank, round(sc, 5) AS s_centroid, round(sk, 5) AS s_knn FROM tags",
)
def pre_tag(spark, sf_dir):
    return _shown_tags(sg.pre_tag(*_vectors(spark, sf_dir)))


CALIBRATION_SQL = """SELECT cuts.label, pos < 5 AS uncalibrated, CAST(pos AS BIGINT) AS calib_pos, {known} AS centroid, p10, p25, p50, round(high, 5) AS high, high_support, high_precision,
  round(medium, 5) AS medium, medium_support, medium_precision FROM cuts{joined}"""


def _shown_calibration(found):
    return found.withColumn("high", F.round("high", 5)).withColumn("medium", F.round("medium", 5))


@register("calibration", f"WITH {COMBINED_SQL}{BANDS_SQL} {CALIBRATION_SQL.format(known='true', joined='')}")
def calibration(spark, sf_dir):
    """Thresholds and precision of every label."""
    return _shown_calibration(sg.calibration(*_vectors(spark, sf_dir)))


def _prompted(spark, sf_dir):
    """Vectors, labels of which some are rare, uncertain labels, and a prompt vector for each label and for two more."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    labels = rows.where("id % 3 != 0 and (label > 3 or id % 40 < label * 2)").select("id", "label")
    weak = rows.where("id % 7 = 0").select("id", "label")
    prompts = rows.groupBy("label").agg(F.min_by("v", "id").alias("v")).unionByName(rows.where("label < 2").groupBy((F.col("label") + 100).alias("label")).agg(F.max_by("v", "id").alias("v")))
    return rows.select("id", "v"), labels, prompts, weak


#: The same with uncertain labels and prompts; labels 100 and 101 have no vectors of their own, so no centroid.
PROMPTED_SQL = """e AS (SELECT vec_id AS id, label, vec_id % 3 <> 0 AND (label > 3 OR vec_id % 40 < label * 2) AS tagged, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings),
p AS (SELECT label, arg_min(u, id) AS p FROM e GROUP BY 1 UNION ALL SELECT label + 100, arg_max(u, id) FROM e WHERE label < 2 GROUP BY 1),
g AS (SELECT label, count(*) AS n FROM e WHERE tagged GROUP BY 1), few AS (SELECT label, coalesce(g.n, 0) AS n FROM p LEFT JOIN g USING (label) WHERE coalesce(g.n, 0) < 8),
m0 AS (SELECT id, label, u, 0 AS weak FROM e WHERE tagged UNION ALL SELECT id, label, u, 1 FROM e WHERE id % 7 = 0 AND label IN (SELECT label FROM few)),
x0 AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM m0), s0 AS (SELECT label, list(x ORDER BY k) AS t FROM (SELECT label, k, sum(x) AS x FROM x0 GROUP BY 1, 2) GROUP BY 1),
w0 AS (SELECT id, label, u, weak, list_inner_product(u, t) / sqrt(list_inner_product(t, t)) AS sim FROM m0 JOIN s0 USING (label)), q0 AS (SELECT label, quantile_cont(sim, 0.4) AS cut FROM w0 WHERE weak = 1 GROUP BY 1),
m1 AS (SELECT w0.* FROM w0 LEFT JOIN q0 USING (label) WHERE weak = 0 OR sim >= cut), x1 AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM m1),
s1 AS (SELECT label, list(x ORDER BY k) AS total FROM (SELECT label, k, sum(x) AS x FROM x1 GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT p.label, p, total, coalesce((SELECT count(*) FROM m1 WHERE m1.label = p.label), 0) AS n FROM p LEFT JOIN s1 USING (label)),
d AS (SELECT a.id, b.id AS other, b.label, list_inner_product(a.u, b.u) AS score FROM e a JOIN e b ON a.id <> b.id AND b.tagged),
k AS (SELECT *, greatest(score, 0) AS w FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 25),
votes AS (SELECT id, label, s / t AS score FROM (SELECT id, label, sum(w) AS s FROM k GROUP BY 1, 2) JOIN (SELECT id, sum(w) AS t FROM k GROUP BY 1) USING (id) WHERE t > 0),
cs AS (SELECT e.id, c.label, n > 0 AS known, tagged, tagged AND e.label = c.label AS own, coalesce(v.score, 0) AS sk, list_inner_product(u, p) AS st,
  CASE WHEN n = 0 THEN 0 WHEN NOT tagged OR e.label <> c.label OR n = 1 THEN list_inner_product(u, total) / sqrt(list_inner_product(total, total))
  ELSE (list_inner_product(u, total) - list_inner_product(u, u)) / sqrt(list_inner_product(total, total) - 2 * list_inner_product(u, total) + list_inner_product(u, u)) END AS sc
  FROM e CROSS JOIN c LEFT JOIN votes v ON v.id = e.id AND v.label = c.label),
z AS (SELECT *, (sc - avg(sc) OVER w) / greatest(stddev_pop(sc) OVER w, 1e-6) AS zc, (sk - avg(sk) OVER w) / greatest(stddev_pop(sk) OVER w, 1e-6) AS zk,
  (st - avg(st) OVER w) / greatest(stddev_pop(st) OVER w, 1e-6) AS zt FROM cs WINDOW w AS (PARTITION BY label)),
comb AS (SELECT *, CASE WHEN known THEN zc * 0.5 + zk * 0.3 + zt * 0.2 ELSE zk * 0.6 + zt * 0.4 END AS score,
  CASE WHEN known AND zc >= greatest(zk, zt) THEN 'centroid' WHEN zk >= zt THEN 'knn' ELSE 'text' END AS method FROM z)"""


@register("label_scores_prompted", f"WITH {PROMPTED_SQL} SELECT id, label, round(score, 5) AS score, method FROM comb")
def label_scores_prompted(spark, sf_dir):
    """Scores with prompts and uncertain labels."""
    vectors, labels, prompts, weak = _prompted(spark, sf_dir)
    return sg.label_scores(vectors, labels, prompts, weak=weak).withColumn("score", F.round("score", 5))


@register(
    "pre_tag_prompted",
    f"WITH {PROMPTED_SQL}{BANDS_SQL} SELECT id, label, round(score, 5) AS score, round(confidence, 5) AS confidence, method, band, rank, round(sc, 5) AS s_centroid, round(sk, 5) AS s_knn, round(st, 5) AS s_text FROM tags",
)
def pre_tag_prompted(spark, sf_dir):
    vectors, labels, prompts, weak = _prompted(spark, sf_dir)
    return _shown_tags(sg.pre_tag(vectors, labels, prompts, weak=weak))


@register("calibration_prompted", f"WITH {PROMPTED_SQL}{BANDS_SQL} {CALIBRATION_SQL.format(known='n > 0', joined=' JOIN c USING (label)')}")
def calibration_prompted(spark, sf_dir):
    vectors, labels, prompts, weak = _prompted(spark, sf_dir)
    return _shown_calibration(sg.calibration(vectors, labels, prompts, weak=weak))
