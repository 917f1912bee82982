"""Facets of a browsing category: which values each offers, how many items each value has, and what has been chosen."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.items import property_query, public_items, set_members
from vitrine.sources.catalog import Catalog


@dataclass
class Facet:
    """One facet: ``kind`` is resource_class, item_set, resource_template, or a kind of property clause (eq, neq, in, nin,
    res, nres, ex, nex); ``values`` are those that it offers, all that occur if there are none (not for in and nin);
    ``chosen`` are the values that items must have, any of them."""

    name: str
    kind: str
    prop: int | None = None
    values: list = field(default_factory=list)
    chosen: list = field(default_factory=list)


def narrowed(
    catalog: Catalog,
    classes: Iterable[int] = (),
    templates: Iterable[int] = (),
    sets: Iterable[int] = (),
    ids: Iterable[int] = (),
    text: str | None = None,
) -> DataFrame:
    """Ids of resources of any of the classes, templates and sets, among the ids, with a value that has ``text`` in it in
    any case; what isn't given makes no difference."""
    found = catalog.resource
    for column, wanted in (("class_id", classes), ("template_id", templates), ("id", ids)):
        if wanted := list(wanted):
            found = found.where(F.col(column).isin(wanted))
    found = found.select("id")
    if sets := list(sets):
        members = catalog.member.where(F.col("set_id").isin(sets)).select(F.col("item_id").alias("id"))
        found = found.join(members, "id", "left_semi")
    if text:
        said = catalog.value.where(F.contains(F.lower("value"), F.lit(text.lower()))).select(F.col("resource_id").alias("id"))
        found = found.join(said, "id", "left_semi")
    return found


def choice(catalog: Catalog, facet: Facet) -> DataFrame:
    """Ids of the items that have any of a facet's chosen values."""
    if facet.kind in ("resource_class", "item_set", "resource_template"):
        name = {"resource_class": "classes", "item_set": "sets", "resource_template": "templates"}[facet.kind]
        return narrowed(catalog, **{name: facet.chosen})
    exists = facet.kind in ("ex", "nex")
    clauses = [(facet.kind, value if exists else facet.prop, None if exists else value) for value in facet.chosen]
    return property_query(catalog, clauses, "or")


def counts(catalog: Catalog, base: DataFrame, facet: Facet) -> DataFrame:
    """(facet, key, n) over the items of ``base`` (id): members or items per key, value rows per value (eq, neq), links per
    target (res, nres), items that have a property (ex, nex), items with and without a text (in, nin)."""
    if facet.kind in ("resource_class", "resource_template"):
        key, rows = {"resource_class": "class_id", "resource_template": "template_id"}[facet.kind], catalog.resource.join(base, "id", "left_semi")
    elif facet.kind == "item_set":
        key, rows = "set_id", catalog.member.join(base.withColumnRenamed("id", "item_id"), "item_id", "left_semi")
    elif facet.kind in ("res", "nres"):
        key, rows = "target_id", catalog.link.join(base.withColumnRenamed("id", "item_id"), "item_id", "left_semi")
    elif facet.kind in ("ex", "nex"):
        value = catalog.value.join(base.withColumnRenamed("id", "resource_id"), "resource_id", "left_semi")
        key, rows = "property_id", value.select("resource_id", "property_id").distinct()
    elif facet.kind in ("eq", "neq"):
        key, rows = "value", catalog.value.where(F.col("property_id") == facet.prop).join(base.withColumnRenamed("id", "resource_id"), "resource_id", "left_semi")
    else:
        texts = F.array(*[F.lit(v) for v in facet.values]).cast("array<string>")
        value = catalog.value.where(F.col("property_id") == facet.prop).join(base.withColumnRenamed("id", "resource_id"), "resource_id", "left_semi")
        held = value.select("resource_id", F.explode(F.filter(texts, lambda t: F.contains(F.col("value"), t))).alias("key"))
        held = held.groupBy("key").agg(F.countDistinct("resource_id").alias("has"))
        asked = base.agg(F.countDistinct("id").alias("total")).select("total", F.explode(F.array_distinct(texts)).alias("key"))  # one row for each text
        both = asked.join(held, "key", "left").withColumn("has", F.coalesce("has", F.lit(0)))
        return both.select(F.lit(facet.name).alias("facet"), "key", (F.col("has") if facet.kind == "in" else F.col("total") - F.col("has")).alias("n"))
    if facet.values:
        rows = rows.where(F.col(key).isin(list(facet.values)))
    return rows.where(F.col(key).isNotNull()).groupBy(F.lit(facet.name).alias("facet"), F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))


def category_facets(catalog: Catalog, facets: list[Facet], base: DataFrame | None = None, exclude_self: bool = True) -> DataFrame:
    """Counts of all facets of a category as one table (facet, key, n).

    The items are the public ones, or ``base`` (id), that meet the choices of all facets; with ``exclude_self`` a facet's
    own choice doesn't narrow its own counts, so that its other values stay countable.
    """
    base = public_items(catalog.resource, None).select("id") if base is None else base.select("id")
    chosen = {f.name: choice(catalog, f) for f in facets if f.chosen}
    parts = []
    for facet in facets:
        found = base
        for name, met in chosen.items():
            if not (exclude_self and name == facet.name):
                found = found.join(met, "id", "left_semi")
        parts.append(counts(catalog, found, facet))
    return reduce(DataFrame.unionByName, parts)


def available(catalog: Catalog, base: DataFrame, kind: str, prop: int | None = None, names: DataFrame | None = None) -> DataFrame:
    """(id, label, n): what the items of ``base`` (id) offer to choose from, the most frequent first, then by label.

    ``kind``: resource_class, resource_template or item_set, with their ids; or a type of property query, for one property
    or for all: eq, neq, in, nin give values, res and nres linked items (``id title``), ex and nex properties (``id
    name``), by value rows, with id 0.  ``names`` (id, label) are the names of classes, templates or properties; without
    them labels are the ids.
    """
    mine = base.select(F.col("id").alias("__id")).distinct()
    inside = lambda df, c: df.join(mine, F.col(c) == F.col("__id"), "left_semi")

    def named(counted: DataFrame, table: DataFrame | None) -> DataFrame:
        if table is None:
            return counted.withColumn("label", F.col("id").cast("string"))
        return counted.join(F.broadcast(table.select("id", "label")), "id")  # names of classes, templates or properties

    if kind in ("resource_class", "resource_template"):
        key = {"resource_class": "class_id", "resource_template": "template_id"}[kind]
        counted = inside(catalog.resource, "id").where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
        found = named(counted, names).select("id", "label", "n")
    elif kind == "item_set":
        counted = inside(catalog.member, "item_id").groupBy(F.col("set_id").alias("id")).agg(F.count("*").alias("n"))
        found = counted.join(catalog.item_set.select("id", F.col("title").alias("label")), "id").select("id", "label", "n")
    elif kind in ("res", "nres"):
        linked = inside(catalog.link, "item_id").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n")).join(catalog.exhibition.select("id", "title"), "id")
        found = linked.groupBy(F.concat_ws(" ", F.col("id").cast("string"), "title").alias("label")).agg(F.sum("n").alias("n")).select(F.lit(0).alias("id"), "label", "n")
    else:
        value = inside(catalog.value, "resource_id")
        value = value if prop is None else value.where(F.col("property_id") == prop)
        if kind in ("ex", "nex"):
            counted = value.groupBy(F.col("property_id").alias("id")).agg(F.count("*").alias("n"))
            label = F.concat_ws(" ", F.col("id").cast("string"), *([] if names is None else ["label"]))
            found = named(counted, names).select(F.lit(0).alias("id"), label.alias("label"), "n")
        else:
            found = value.where(F.col("value").isNotNull()).groupBy(F.col("value").alias("label")).agg(F.count("*").alias("n")).select(F.lit(0).alias("id"), "label", "n")
    return found.orderBy(F.desc("n"), "label")


def texts_outside_sets(catalog: Catalog, prop: int, sets: Iterable[int], least: int = 10) -> DataFrame:
    """(item_id, text): values of a property with at least ``least`` characters, white space at their ends aside, of items
    that are in none of the sets."""
    inside = catalog.member.where(F.col("set_id").isin(list(sets))).select("item_id").distinct()
    said = catalog.value.where(F.col("property_id") == prop).select(F.col("resource_id").alias("item_id"), F.col("value").alias("text"))
    return said.where(F.length(F.trim("text")) >= least).join(inside, "item_id", "left_anti")


def press_list(catalog: Catalog, title: str, names: dict[int, str], logos: dict[str, str]) -> DataFrame:
    """Public members of the set with a title, with named properties, the trimmed ``publisher`` as outlet, and its logo."""
    members = set_members(catalog, title, names)
    shown = members.join(public_items(catalog.resource, None).select("id"), "id", "left_semi")
    outlet = F.trim(F.coalesce("publisher", F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in logos.items() for x in pair]).cast("map<string,string>") if logos else F.create_map().cast("map<string,string>")
    return shown.withColumn("outlet", outlet).withColumn("logo", F.coalesce(F.try_element_at(known, outlet), F.lit("")))

