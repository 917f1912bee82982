"""Queries over keyed writes, cleaning and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions import dates, text
from vitrine.operators import cleaning, upsert
from vitrine.plans.registry import register
from vitrine.sources.catalog import table

UPDATES = "SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 = 0"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")


@register(
    "upsert",
    """SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0
UNION ALL SELECT event_id, user_id, upper(event_type) FROM events WHERE event_id % 3 = 0""",
)
def upsert_rows(spark, sf_dir):
    events = _events(spark, sf_dir)
    changed = events.where("event_id % 3 = 0").withColumn("event_type", F.upper("event_type"))
    return upsert.upsert(events.where("event_id % 2 = 0"), changed, ["event_id"])


@register(
    "refresh",
    """SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND event_id % 50 = 0)
UNION ALL SELECT event_id, user_id, 'again' FROM events WHERE event_type = 'click' AND event_id % 50 = 0""",
)
def refresh(spark, sf_dir):
    events = _events(spark, sf_dir)
    run = events.where("event_type = 'click' and event_id % 50 = 0").withColumn("event_type", F.lit("again"))
    return upsert.refresh(events, run, ["user_id"])


@register("pull_new", "SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'click' AND user_id < 20)")
def pull_new(spark, sf_dir):
    events = _events(spark, sf_dir)
    return upsert.pull_new(events, events.where("event_type = 'click' and user_id < 20"), "event_id")


@register(
    "insert_missing",
    "SELECT user_id, min(event_type) AS event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 40 = 0) GROUP BY 1",
)
def insert_missing(spark, sf_dir):
    events = _events(spark, sf_dir)
    return upsert.insert_missing(events.where("event_id % 40 = 0"), events.select("user_id", "event_type"), ["user_id"])


@register("delete_items", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def delete_items(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    gone = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    return upsert.delete_items({"lines": (lines, "l_orderkey")}, gone)["lines"].select("l_orderkey", "l_linenumber")


@register("update_values", "SELECT event_id, CASE WHEN value > 50 THEN 'large' ELSE event_type END AS event_type FROM events")
def update_values(spark, sf_dir):
    return upsert.update_values(table(spark, sf_dir, "events"), F.col("value") > 50, "event_type", F.lit("large")).select("event_id", "event_type")


@register(
    "classify_changes",
    """WITH s AS (SELECT user_id AS id, max(event_id) AS modified FROM events GROUP BY 1), t AS (SELECT user_id AS id, max(event_id) AS seen FROM events WHERE event_id % 7 = 0 AND user_id % 5 <> 0 GROUP BY 1)
SELECT s.id, modified, CASE WHEN t.id IS NULL THEN 'new' WHEN modified > seen THEN 'updated' ELSE 'up_to_date' END AS change FROM s LEFT JOIN t ON t.id = s.id""",
)
def classify_changes(spark, sf_dir):
    events = _events(spark, sf_dir)
    source = events.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("modified"))
    state = events.where("event_id % 7 = 0 and user_id % 5 <> 0").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("seen"))
    return upsert.classify_changes(source, state, "id", "modified", "seen")


@register("latest_per_key", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return upsert.latest(_events(spark, sf_dir), ["user_id"], [F.col("event_id")])


@register("top_per_group", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3")
def top_per_group(spark, sf_dir):
    found = upsert.top_per_group(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.asc("event_id")], 3)
    return found.select("event_type", "event_id", "rank")


def _values(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("value"))


def _vocabulary(spark, sf_dir):
    """Types in order: the first is split, the second dropped, the third renamed."""
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct()
    ranked = names.withColumn("k", F.row_number().over(Window.orderBy("value")))
    action = F.when(F.col("k") == 1, "split").when(F.col("k") == 2, "drop").when(F.col("k") == 3, "canon")
    target = F.when(F.col("k") == 1, F.array(F.lit("one"), F.lit("two"))).when(F.col("k") == 3, F.array(F.lit("one")))
    return ranked.where("k <= 3").select("value", action.alias("action"), target.alias("target"))


VOCABULARY_SQL = "k AS (SELECT p_type AS value, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT p_type FROM part))"


@register(
    "clean_vocabulary",
    f"""WITH {VOCABULARY_SQL}, r AS (SELECT p_partkey AS id, p_partkey % 100 AS item_id, unnest(CASE WHEN k = 1 THEN ['one', 'two'] WHEN k = 2 THEN []
  WHEN k = 3 THEN ['one'] ELSE [p_type] END) AS value FROM part JOIN k ON k.value = p_type)
SELECT min(id) AS id, item_id, value FROM r GROUP BY item_id, value""",
)
def clean_vocabulary(spark, sf_dir):
    value = _values(spark, sf_dir).select(F.col("item_id").alias("id"), (F.col("item_id") % 100).alias("item_id"), "value")
    return cleaning.clean_vocabulary(value, _vocabulary(spark, sf_dir))


@register(
    "action_report",
    f"""WITH {VOCABULARY_SQL} SELECT p_type AS value, count(*) AS count, CASE k WHEN 1 THEN 'split' WHEN 2 THEN 'drop' WHEN 3 THEN 'canon' ELSE 'keep' END AS action,
CASE k WHEN 1 THEN 'one|two' WHEN 3 THEN 'one' ELSE '' END AS target FROM part JOIN k ON k.value = p_type GROUP BY 1, 3, 4""",
)
def action_report(spark, sf_dir):
    return cleaning.action_report(_values(spark, sf_dir), _vocabulary(spark, sf_dir))


@register(
    "atomic_values",
    f"""WITH {VOCABULARY_SQL} SELECT DISTINCT p_partkey AS item_id, unnest(CASE WHEN k = 1 THEN ['one', 'two'] ELSE [p_type] END) AS value FROM part JOIN k ON k.value = p_type
WHERE k = 1 OR k > 3""",
)
def atomic_values(spark, sf_dir):
    words = _vocabulary(spark, sf_dir)
    mapping = words.where("action = 'split'").select("value", F.explode("target").alias("atomic"))
    allowed = _values(spark, sf_dir).select("value").distinct().join(words, "value", "left_anti")
    return cleaning.atomic_values(_values(spark, sf_dir), mapping, allowed)


@register(
    "seeded_motifs",
    """SELECT DISTINCT p_partkey AS item_id, 'm' || (p_size % 3) AS motif FROM part WHERE p_size % 3 < 2 AND NOT (p_partkey % 2 = 0 AND p_size % 3 = 0)""",
)
def seeded_motifs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("Eyes"), F.lit("Fish"), F.lit("None")), (F.col("p_size") % 3 + 1).cast("int"))
    label = F.concat(kind, F.lit(" (box "), F.col("p_size").cast("string"), F.lit(")"))
    boxes = part.select(F.col("p_partkey").alias("item_id"), label.alias("value"))
    mapping = spark.createDataFrame([("eyes", "m0"), ("fish", "m1")], "category string, motif string")
    known = part.where("p_partkey % 2 = 0 and p_size % 3 = 0").select(F.col("p_partkey").alias("item_id"), F.lit("m0").alias("motif"))
    return cleaning.seeded_motifs(boxes, mapping, known)


def _records(spark, sf_dir):
    """Wide records with flaws, out of the orders."""
    key = F.col("o_orderkey")
    date = F.when(key % 11 == 0, "").when(key % 13 == 0, "∅").when(key % 17 == 0, "1999 -> 2001").otherwise(F.date_format("o_orderdate", "yyyy"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 7 == 0, "").otherwise("Title").alias("title"),
        date.alias("date"),
        F.element_at(F.array(*[F.lit(c) for c in ("A", "B", "X", "")]), (key % 4 + 1).cast("int")).alias("category"),
        F.when(key % 5 == 0, "tall").otherwise("12").alias("height"),
        F.when(key % 3 == 0, "").otherwise("9.5").alias("width"),
        F.when(key % 2 == 0, "↗").otherwise("∅").alias("signature"),
        F.when(key % 9 == 0, F.array().cast("array<string>")).when(key % 4 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("motifs"),
    )


RECORDS_SQL = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Title' END AS title,
  CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '∅' WHEN o_orderkey % 17 = 0 THEN '1999 -> 2001' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS date,
  ['A', 'B', 'X', ''][o_orderkey % 4 + 1] AS category, o_orderkey % 5 = 0 AS bad_height, o_orderkey % 3 = 0 AS no_width, o_orderkey % 2 = 0 AS signed,
  CASE WHEN o_orderkey % 9 = 0 THEN 0 WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS motifs FROM orders),
y AS (SELECT *, TRY_CAST(regexp_extract(date, '(\\d{4})', 1) AS INTEGER) AS year, date NOT IN ('', '∅') AS dated FROM r),
i AS (SELECT id, list_filter([CASE WHEN bad_height THEN 'height:error:non-numeric' END, CASE WHEN no_width THEN 'width:error:missing' END, CASE WHEN date = '' THEN 'date:error:missing' END,
  CASE WHEN year < 1989 THEN 'date:error:pre-1989' WHEN year > 2024 THEN 'date:error:posthumous' END, CASE WHEN motifs = 0 THEN 'motifs:error:missing' END,
  CASE category WHEN '' THEN 'category:error:missing' WHEN 'X' THEN 'category:error:invalid' END, CASE WHEN signed AND NOT dated THEN 'date:error:signed but undated' END,
  CASE WHEN NOT signed AND dated THEN 'signature:error:dated but unsigned' END, CASE WHEN motifs = 2 THEN 'motifs:error:duplicate values' END], lambda x: x IS NOT NULL) AS issues FROM y)"""


@register("validate_items", f"WITH {RECORDS_SQL} SELECT id, array_to_string(issues, '|') AS issues FROM i")
def validate_items(spark, sf_dir):
    found = cleaning.validate_items(_records(spark, sf_dir))
    return found.select("id", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["field"], x["level"], x["message"])), "|").alias("issues"))


@register(
    "issue_queue",
    f"WITH {RECORDS_SQL} SELECT id, CAST(len(issues) AS INTEGER) AS n, CAST(len(list_filter(issues, lambda x: contains(x, ':error:'))) AS INTEGER) AS errors FROM i WHERE errors > 0",
)
def issue_queue(spark, sf_dir):
    return cleaning.issue_queue(cleaning.validate_items(_records(spark, sf_dir)))


@register(
    "transition_violations",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unknown status' WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'accepted without item'
WHEN event_id % 4 = 2 AND event_id % 5 = 0 THEN 'rejected without reason' END AS violation FROM events""",
)
def transition_violations(spark, sf_dir):
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        key,
        F.when(key % 4 == 0, "odd").when(key % 4 == 1, "accepted").when(key % 4 == 2, "rejected").otherwise("new").alias("status"),
        F.when(key % 3 != 0, key).alias("item_id"),
        F.when(key % 5 != 0, "because").otherwise(" ").alias("reason"),
    )
    return cleaning.transition_violations(rows).select("event_id", "violation")


@register(
    "validated_references",
    """SELECT event_id AS item_id, event_type AS name, 'kind' || (user_id % 3) AS type,
CASE WHEN event_id % 2 = 0 THEN repeat('x', 147) || '...' ELSE 'short' END AS excerpt FROM events WHERE user_id % 3 < 2 AND event_id % 10 <> 0""",
)
def validated_references(spark, sf_dir):
    excerpt = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 200)).otherwise("short")
    entry = F.struct(
        F.concat(F.col("event_type"), F.lit(" ")).alias("reference_name"),
        F.concat(F.lit("kind"), (F.col("user_id") % 3).cast("string")).alias("reference_type"),
        excerpt.alias("text_excerpt"),
    )
    answer = F.when(F.col("event_id") % 10 == 0, "no list").otherwise(F.concat(F.lit("```json\nHere: "), F.to_json(F.array(entry)), F.lit("\n```")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), answer.alias("answer"))
    return cleaning.validated_references(rows, ["kind0", "kind1"])


@register("coerced_values", "SELECT event_id, event_type AS value FROM events WHERE event_type <> (SELECT max(event_type) FROM events)")
def coerced_values(spark, sf_dir):
    events = _events(spark, sf_dir)
    last = events.agg(F.max("event_type").alias("event_type"))
    words = events.select("event_type").distinct().join(last, "event_type", "left_anti").select(F.col("event_type").alias("value"))
    spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("value")
    return cleaning.coerced(events.select("event_id", spelled), words)


@register(
    "enrichment_values",
    """SELECT event_id AS item_id, unnest(CASE WHEN event_id % 3 = 0 THEN [event_type, 'b'] WHEN event_id % 3 = 1 THEN ['l1', 'l2'] ELSE [event_type] END) AS value FROM events
WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""",
)
def enrichment_values(spark, sf_dir):
    key = F.col("event_id")
    answer = F.when(key % 3 == 0, F.to_json(F.array(F.col("event_type"), F.lit("b")))).when(key % 3 == 1, "l1\n\n l2").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events")
    results = events.select(key.alias("item_id"), F.when(key % 5 == 0, "failed").otherwise("succeeded").alias("status"), answer.alias("answer"))
    return cleaning.enrichment_values(results, events.where(key % 7 == 0).select(key.alias("item_id")))


@register(
    "text_functions",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(source || ' / ' || lang)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug,
  CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 240 THEN trim(regexp_replace(text, '\\s+', ' ', 'g'))
    ELSE rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240)) || '...' END AS snippet,
  'JS-' || lpad(CAST(1990 + doc_id % 30 AS VARCHAR), 4, '0') || '-T' || doc_id AS catalog_id FROM documents""",
)
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.slugify(F.concat_ws(" / ", "source", "lang")).alias("slug"),
        text.snippet(F.col("text")).alias("snippet"),
        text.catalog_id(F.lit(1990) + F.col("doc_id") % 30, F.col("doc_id")).alias("catalog_id"),
    )


@register(
    "date_functions",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) END AS norm_year, year(o_orderdate) AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS iso,
  strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS pretty FROM orders""",
)
def date_functions(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    credit = F.concat(F.lit("Printed on "), day, F.lit(" by hand"))
    year = F.date_format("o_orderdate", "yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.norm_year(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("C. "), year, F.lit("-ish"))).otherwise("undated")).alias("norm_year"),
        dates.parse_year(credit).alias("parsed"),
        dates.iso_date(credit).alias("iso"),
        dates.pretty_date(day).alias("pretty"),
    )
