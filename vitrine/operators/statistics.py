"""Counts over the catalog: summaries, breakdowns, facets, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.dates import norm_year
from vitrine.operators.items import public_items
from vitrine.operators.numbering import row_numbers
from vitrine.sources.catalog import PROPERTIES, Catalog


def corpus_summary(catalog: Catalog, compat_zero: bool = False) -> DataFrame:
    """Number of public items, earliest and latest year, items with a transcription; one row."""
    ids = public_items(catalog.resource).select(F.col("id").alias("resource_id"))
    value = catalog.value.where(F.col("property_id").isin(PROPERTIES["date"], PROPERTIES["transcription"]))
    year = F.when(F.col("property_id") == PROPERTIES["date"], norm_year(F.col("value"), compat_zero))
    written = (F.col("property_id") == PROPERTIES["transcription"]) & (F.trim("value") != "")
    joined = ids.join(value, "resource_id", "left")
    return joined.agg(
        F.countDistinct("resource_id").alias("items"),
        F.min(year).alias("earliest"),
        F.max(year).alias("latest"),
        F.countDistinct(F.when(written, F.col("resource_id"))).alias("transcribed"),
    )


def breakdown(catalog: Catalog, prop: int, key: Column | None = None) -> DataFrame:
    """Public items per value of a property (or per ``key`` of it), most frequent first; null keys are left out."""
    ids = public_items(catalog.resource).select(F.col("id").alias("resource_id"))
    value = catalog.value.where(F.col("property_id") == prop).join(ids, "resource_id", "left_semi")
    named = value.select("resource_id", (F.col("value") if key is None else key).alias("key")).where(F.col("key").isNotNull())
    return named.groupBy("key").agg(F.countDistinct("resource_id").alias("items")).orderBy(F.desc("items"), "key")


def collection_breakdown(catalog: Catalog) -> DataFrame:
    """Members per set, whether public or not."""
    sized = catalog.member.groupBy("set_id").agg(F.count("*").alias("items"))
    return sized.join(catalog.item_set, sized.set_id == catalog.item_set.id).select("title", "items").orderBy(F.desc("items"), "title")


def facet_counts(catalog: Catalog, ids: DataFrame, eq: list[int], linked: bool = True, exist: list[int] = ()) -> DataFrame:
    """Counts of several facets of a base query as one long table (facet, key, n).

    eq: value rows per value; linked: links per target; exist: items that have a property (ex) and that lack it (nex);
    sets: members per set; template: items per template.
    """
    base = ids.select("id")
    value = catalog.value.join(base, F.col("resource_id") == F.col("id"), "left_semi")
    parts = [
        value.where(F.col("property_id").isin(list(eq)))
        .groupBy(F.concat(F.lit("eq:"), F.col("property_id").cast("string")).alias("facet"), F.col("value").alias("key"))
        .agg(F.count("*").alias("n")),
        catalog.member.join(base, F.col("item_id") == F.col("id"), "left_semi")
        .groupBy(F.lit("set").alias("facet"), F.col("set_id").cast("string").alias("key"))
        .agg(F.count("*").alias("n")),
        catalog.resource.join(base, "id", "left_semi")
        .groupBy(F.lit("template").alias("facet"), F.col("template_id").cast("string").alias("key"))
        .agg(F.count("*").alias("n")),
    ]
    if linked:
        links = catalog.link.join(base, F.col("item_id") == F.col("id"), "left_semi")
        parts.append(links.groupBy(F.lit("res").alias("facet"), F.col("target_id").cast("string").alias("key")).agg(F.count("*").alias("n")))
    if exist:
        has = value.where(F.col("property_id").isin(list(exist))).groupBy("property_id").agg(F.countDistinct("resource_id").alias("ex"))
        total = base.agg(F.countDistinct("id").alias("total"))
        both = has.crossJoin(F.broadcast(total))  # one row
        split = F.expr("stack(2, concat('ex:', property_id), ex, concat('nex:', property_id), total - ex)").alias("facet", "n")
        parts.append(both.select(split).select("facet", F.lit(None).cast("string").alias("key"), "n"))
    return reduce(DataFrame.unionByName, parts)


def needle_counts(catalog: Catalog, prop: int, needles: DataFrame) -> DataFrame:
    """Items per needle whose value of a property contains it; ``needles``: a bounded list of search terms, column ``needle``."""
    value = catalog.value.where(F.col("property_id") == prop)
    hit = value.join(needles, F.col("value").contains(F.col("needle")))
    return hit.groupBy("needle").agg(F.countDistinct("resource_id").alias("items"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Rows per status and, with a null status, in all."""
    return df.rollup(status).agg(F.count("*").alias("n"))


def completeness(catalog: Catalog, template: DataFrame) -> DataFrame:
    """For each property of a template: items, and items without a non-blank value.  ``template``: property_id."""
    total = catalog.resource.agg(F.countDistinct("id").alias("total"))
    filled = catalog.value.where(F.trim("value") != "").groupBy("property_id").agg(F.countDistinct("resource_id").alias("filled"))
    joined = template.join(filled, "property_id", "left").crossJoin(F.broadcast(total))
    return joined.select("property_id", "total", (F.col("total") - F.coalesce("filled", F.lit(0))).alias("missing"))


def name_report(rows: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Report of mentions: per lower-case name the last seen spelling and type, total, distinct items and the most
    common role (of equally common ones the first seen).  ``rows``: item_id, pos, name, type, role."""
    keyed = rows.withColumn("key", F.lower("name"))
    roles = keyed.groupBy("key", "role").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    top = roles.groupBy("key").agg(F.max_by("role", F.struct("c", -F.col("first"))).alias("role"))
    named = keyed.groupBy("key").agg(
        F.max_by("name", "pos").alias("name"),
        F.max_by("type", "pos").alias("type"),
        F.count("*").alias("total"),
        F.countDistinct("item_id").alias("items"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return named.join(top, "key").drop("key")


def place_report(rows: DataFrame, roles: list[str]) -> DataFrame:
    """Per lower-case name and type: total, one count per role, and the sorted items joined by ``, ``."""
    keyed = rows.groupBy(F.lower("name").alias("name"), "type")
    counts = [F.sum(F.when(F.col("role") == r, 1).otherwise(0)).alias(f"as_{r}") for r in roles]
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ", ").alias("listed")
    return keyed.agg(F.count("*").alias("total"), *counts, listed)


def type_breakdown(rows: DataFrame) -> DataFrame:
    """Different names and mentions per type."""
    return rows.groupBy("type").agg(F.countDistinct(F.lower("name")).alias("names"), F.count("*").alias("total"))


def class_histogram(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows per class from ``low`` to ``high``, zero where there are none."""
    classes = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(column))
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(classes).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def category_counts(df: DataFrame, column: str, categories: list[str], id_col: str) -> DataFrame:
    """Rows and first example per category in a fixed order, absent ones with zero, and the share of all."""
    order = df.sparkSession.createDataFrame(list(enumerate(categories)), f"position int, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"), F.min(id_col).alias("example"))
    return F.broadcast(order).join(counts, column, "left").select("position", column, F.coalesce("n", F.lit(0)).alias("n"), "example")


def usage_cost(df: DataFrame, prices: dict[str, tuple[float, float]], default: str) -> DataFrame:
    """Cost of token use at prices per million tokens (in, out) by model; an unknown model costs as ``default``."""
    table = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    price = F.coalesce(F.try_element_at(table, F.col("model")), table[default])
    cost = (F.col("tokens_in") * price["a"] + F.col("tokens_out") * price["b"]) / 1e6
    return df.withColumn("cost", F.round(cost, 6))


def queue_sizes(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that each rule holds for, in one pass; rules without rows are left out."""
    sums = df.agg(*[F.sum(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in rules.items()])
    flat = ", ".join(f"'{n}', `{n}`" for n in rules)
    return sums.select(F.expr(f"stack({len(rules)}, {flat})").alias("rule", "n")).where("n > 0")


def distinct_terms(value: DataFrame, prop: int) -> DataFrame:
    """Different values of a property in case-insensitive order."""
    return value.where(F.col("property_id") == prop).select("value").distinct().orderBy(F.lower("value"), "value")


def new_terms(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Terms of ``fresh`` that are not known in any case; of spellings that differ in case the smallest."""
    keyed = fresh.groupBy(F.lower("value").alias("key")).agg(F.min("value").alias("value"))
    return keyed.join(known.select(F.lower("value").alias("key")).distinct(), "key", "left_anti").select("value")


def run_summary(results: DataFrame, matches: DataFrame, least: int = 10) -> DataFrame:
    """One row on an extraction run: items with enough text, items too short, items with and without matches, different
    names, matches and repetitions.  ``results``: item_id, text; ``matches``: item_id, canonical, reps."""
    per_item = matches.groupBy("item_id").agg(F.count("*").alias("matches"), F.sum("reps").alias("reps"))
    names = matches.agg(F.countDistinct(F.lower("canonical")).alias("names"))
    long_enough = F.coalesce(F.length(F.trim("text")) >= least, F.lit(False))
    joined = results.select("item_id", long_enough.alias("__long")).join(per_item, "item_id", "left")  # no text is moved
    long_enough = F.col("__long")
    sums = joined.agg(
        F.sum(F.when(long_enough, 1).otherwise(0)).alias("processed"),
        F.sum(F.when(long_enough, 0).otherwise(1)).alias("too_short"),
        F.sum(F.when(long_enough & (F.coalesce("matches", F.lit(0)) > 0), 1).otherwise(0)).alias("with_matches"),
        F.sum(F.when(long_enough & F.col("matches").isNull(), 1).otherwise(0)).alias("without_matches"),
        F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("reps"), F.lit(0)).alias("reps"),
    )
    return sums.crossJoin(F.broadcast(names))  # one row


def batches(df: DataFrame, order: str, size: int = 500) -> DataFrame:
    """Number rows into batches of ``size`` in the order of a numeric key."""
    return row_numbers(df, order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")
