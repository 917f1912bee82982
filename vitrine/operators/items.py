"""Items out of entity-attribute-value rows: filters, wide records, search, lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.dates import norm_year
from vitrine.sources.catalog import PROPERTIES, Catalog

Property = int


def having(value: DataFrame, prop: Property, test: Column) -> DataFrame:
    """Ids of items with at least one value of a property that passes ``test`` (on column ``value``)."""
    return value.where((F.col("property_id") == prop) & test).select(F.col("resource_id").alias("id")).distinct()


def exact(value: DataFrame, prop: Property, wanted: str) -> DataFrame:
    return having(value, prop, F.col("value") == wanted)


def containing(value: DataFrame, prop: Property, part: str) -> DataFrame:
    """Substring match; ``%`` and ``_`` in ``part`` are wildcards, as in LIKE."""
    return having(value, prop, F.col("value").like(f"%{part}%"))


def dated(value: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Items whose normalised year lies in the range; dates without a number match nothing."""
    year, test = norm_year(F.col("value")), F.lit(True)
    if first is not None:
        test = test & (year >= first)
    if last is not None:
        test = test & (year <= last)
    return having(value, PROPERTIES["date"], test)


def all_of(value: DataFrame, prop: Property, wanted: list[str]) -> DataFrame:
    """Items that have every wanted value; a value asked for twice counts once."""
    names = sorted(set(wanted))
    found = value.where((F.col("property_id") == prop) & F.col("value").isin(names))
    full = found.groupBy("resource_id").agg(F.countDistinct("value").alias("n")).where(F.col("n") == len(names))
    return full.select(F.col("resource_id").alias("id"))


def sized(value: DataFrame, prop: Property, least: float | None = None, most: float | None = None) -> DataFrame:
    """Items whose numeric value lies in the range; texts that are no number match nothing."""
    number, test = F.col("value").try_cast("decimal(10,2)"), F.lit(True)
    if least is not None:
        test = test & (number >= F.lit(least))
    if most is not None:
        test = test & (number <= F.lit(most))
    return having(value, prop, test)


def in_collection(catalog: Catalog, part: str) -> DataFrame:
    """Members of sets whose title contains ``part``."""
    sets = catalog.item_set.where(F.col("title").contains(part)).select(F.col("id").alias("set_id"))
    return catalog.member.join(sets, "set_id", "left_semi").select(F.col("item_id").alias("id")).distinct()


def public_items(resource: DataFrame, template: int | None = 2, or_none: bool = False) -> DataFrame:
    """Public resources of a template, or without one if ``or_none``."""
    found = resource.where("is_public")
    if template is None:
        return found
    test = F.col("template_id") == template
    return found.where(test | F.col("template_id").isNull() if or_none else test)


@dataclass
class Search:
    """Conditions of a catalog search; all that are given must hold."""

    first_year: int | None = None
    last_year: int | None = None
    motifs: list[str] = field(default_factory=list)
    work_type: str | None = None
    support: str | None = None
    title: str | None = None
    collection: str | None = None
    least_height: float | None = None
    most_height: float | None = None
    least_width: float | None = None
    most_width: float | None = None
    transcribed: bool = False


def matching(catalog: Catalog, search: Search) -> DataFrame:
    """Ids of public items that meet every condition: a chain of semi-joins that the optimizer is free to order."""
    value, conditions = catalog.value, []
    if search.first_year is not None or search.last_year is not None:
        conditions.append(dated(value, search.first_year, search.last_year))
    if search.motifs:
        conditions.append(all_of(value, PROPERTIES["motif"], search.motifs))
    if search.work_type:
        conditions.append(exact(value, PROPERTIES["work_type"], search.work_type))
    if search.support:
        conditions.append(containing(value, PROPERTIES["support"], search.support))
    for prop, low, high in (("height", search.least_height, search.most_height), ("width", search.least_width, search.most_width)):
        if low is not None or high is not None:
            conditions.append(sized(value, PROPERTIES[prop], low, high))
    if search.collection:
        conditions.append(in_collection(catalog, search.collection))
    if search.transcribed:
        conditions.append(having(value, PROPERTIES["transcription"], F.trim("value") != ""))
    found = public_items(catalog.resource)
    if search.title:
        found = found.where(F.col("title").contains(search.title))
    found = found.select("id")
    for condition in conditions:
        found = found.join(condition, "id", "left_semi")
    return found


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page in order; the limit is clamped to 1..most, the offset to 0 and above."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), most))


def primary_media(media: DataFrame) -> DataFrame:
    """The first medium of each item by position, then id."""
    first = F.min_by(F.struct("id", "position", "storage_id"), F.struct("position", "id")).alias("m")
    return media.groupBy("item_id").agg(first, F.count("*").alias("media_count")).select("item_id", "m.*", "media_count")


def wide_items(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """Wide records of the given ids: single properties as columns, motifs and collections as sorted arrays (empty where
    there are none), dimensions as doubles, the primary medium and the number of media."""
    names = {v: k for k, v in PROPERTIES.items() if k != "transcription"}
    value = catalog.value.join(ids, F.col("resource_id") == F.col("id"), "left_semi")
    one = {name: F.max(F.when(F.col("property_id") == prop, F.col("value"))).alias(name) for prop, name in names.items() if name != "motif"}
    many = F.array_sort(F.collect_list(F.when(F.col("property_id") == PROPERTIES["motif"], F.col("value")))).alias("motifs")
    said = value.groupBy(F.col("resource_id").alias("id")).agg(*one.values(), many)
    members = catalog.member.join(ids, F.col("item_id") == F.col("id"), "left_semi")
    sets = members.join(catalog.item_set.withColumnRenamed("id", "set_id"), "set_id").groupBy(F.col("item_id").alias("id"))
    sets = sets.agg(F.array_sort(F.collect_list("title")).alias("collections"))
    media = primary_media(catalog.media.join(ids.withColumnRenamed("id", "item_id"), "item_id", "left_semi"))
    media = media.select(F.col("item_id").alias("id"), "storage_id", "media_count")
    wide = ids.join(catalog.resource.select("id", "title"), "id").join(said, "id", "left").join(sets, "id", "left").join(media, "id", "left")
    none = F.array().cast("array<string>")
    return wide.select(
        "id", "title", "identifier", "work_type", "support", "date",
        F.col("height").try_cast("double").alias("height"),
        F.col("width").try_cast("double").alias("width"),
        F.coalesce("motifs", none).alias("motifs"),
        F.coalesce("collections", none).alias("collections"),
        "storage_id",
        F.coalesce("media_count", F.lit(0)).alias("media_count"),
    )


def search_catalog(catalog: Catalog, search: Search, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of wide records of matching items in id order.  Only the page's ids reach the wide join."""
    ids = page(matching(catalog, search), [F.col("id").asc()], limit, offset)
    return wide_items(catalog, ids).orderBy("id")


def property_query(catalog: Catalog, clauses: list[tuple[str, Property, str | int | None]], joiner: str = "and") -> DataFrame:
    """Items that meet clauses (type, property, operand) of eight types, joined by and/or.

    eq, in: a value equals / contains the operand; res: a link points to it; ex: the property is there; neq, nin, nres,
    nex: none does.  Positive clauses are semi-joins, negative ones anti-joins; for ``or`` each clause becomes a flag.
    """

    def having_clause(kind: str, prop: Property, operand) -> DataFrame:
        if kind == "eq":
            return exact(catalog.value, prop, operand)
        if kind == "in":
            return having(catalog.value, prop, F.col("value").contains(operand))
        if kind == "res":
            return catalog.link.where(F.col("target_id") == operand).select(F.col("item_id").alias("id")).distinct()
        return having(catalog.value, prop, F.lit(True))

    found = catalog.resource.select("id")
    if joiner == "and":
        for kind, prop, operand in clauses:
            negative = kind.startswith("n")
            found = found.join(having_clause(kind[negative:], prop, operand), "id", "left_anti" if negative else "left_semi")
        return found
    met = []
    for i, (kind, prop, operand) in enumerate(clauses):
        negative = kind.startswith("n")
        has = having_clause(kind[negative:], prop, operand).withColumn(f"__c{i}", F.lit(True))
        found = found.join(has, "id", "left")
        met.append(F.col(f"__c{i}").isNull() if negative else F.col(f"__c{i}").isNotNull())
    test = met[0]
    for m in met[1:]:
        test = test | m
    return found.where(test).select("id")


def pivot_properties(value: DataFrame, names: dict[Property, str], require: list[str] | None = None) -> DataFrame:
    """One row per item with the largest value of each named property; rows without a required one are left out."""
    picked = [F.max(F.when(F.col("property_id") == p, F.col("value"))).alias(n) for p, n in names.items()]
    wide = value.where(F.col("property_id").isin(list(names))).groupBy(F.col("resource_id").alias("id")).agg(*picked)
    for name in require or []:
        wide = wide.where(F.col(name).isNotNull())
    return wide


def exhibitions(catalog: Catalog) -> DataFrame:
    """Exhibitions with the number of items that link to them."""
    counts = catalog.link.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("works"))
    return catalog.exhibition.join(counts, "id", "left").withColumn("works", F.coalesce("works", F.lit(0)))


def linked_works(catalog: Catalog, per_target: int = 100) -> DataFrame:
    """Items that link to each exhibition, the latest created first, at most ``per_target`` of each."""
    made = catalog.link.join(catalog.resource.select(F.col("id").alias("item_id"), "created"), "item_id")
    order = Window.partitionBy("target_id").orderBy(F.desc("created"), F.desc("item_id"))
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_target)


def set_members(catalog: Catalog, title: str, names: dict[Property, str]) -> DataFrame:
    """Members of the set with a title, with named properties."""
    found = catalog.item_set.where(F.col("title") == title).select(F.col("id").alias("set_id"))
    ids = catalog.member.join(F.broadcast(found.limit(1)), "set_id", "left_semi").select(F.col("item_id").alias("id"))
    return ids.join(pivot_properties(catalog.value, names), "id", "left")


def item_documents(catalog: Catalog, ids: DataFrame) -> DataFrame:
    """One nested document per item: property -> array of values, the first medium, set ids."""
    value = catalog.value.join(ids, F.col("resource_id") == F.col("id"), "left_semi").where(F.col("value").isNotNull())
    terms = value.groupBy("resource_id", "property_id").agg(F.array_sort(F.collect_list("value")).alias("values"))
    fields = terms.groupBy(F.col("resource_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("property_id", "values"))).alias("fields"))
    sets = catalog.member.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_set("set_id")).alias("sets"))
    media = primary_media(catalog.media).select(F.col("item_id").alias("id"), F.col("storage_id").alias("first_medium"))
    return ids.join(fields, "id", "left").join(sets, "id", "left").join(media, "id", "left")


def year_order(df: DataFrame, date: str, descending: bool = False) -> DataFrame:
    """Sort by a date text; rows without a date (null, empty, the none sign) are last either way, ties by falling id."""
    missing = F.col(date).isNull() | F.col(date).isin("", "∅", "undated")
    return df.orderBy(missing.cast("int"), F.desc(date) if descending else F.asc(date), F.desc("id"))


def area_order(df: DataFrame, descending: bool = True) -> DataFrame:
    """Sort by height times width as numbers; items without both are last."""
    area = F.col("height").try_cast("double") * F.col("width").try_cast("double")
    return df.withColumn("area", area).orderBy(area.isNull().cast("int"), F.desc("area") if descending else F.asc("area"), F.desc("id"))


def missing_field(catalog: Catalog, prop: Property, force: bool = False) -> DataFrame:
    """Items without a non-blank value of a property, or all if forced."""
    if force:
        return catalog.resource.select("id")
    return catalog.resource.select("id").join(having(catalog.value, prop, F.trim("value") != ""), "id", "left_anti")


def export_wide(value: DataFrame, properties: list[Property] | None = None) -> DataFrame:
    """One row per item and one column per property that occurs, values in order joined by ``; ``."""
    wide = value.groupBy(F.col("resource_id").alias("id"))
    wide = wide.pivot("property_id", properties) if properties else wide.pivot("property_id")
    return wide.agg(F.array_join(F.array_sort(F.collect_list("value")), "; "))
