"""Rows for other systems: storefront, writings, search index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import sanitize_ocr, slugify, truncate_words, work_label


def last_prices(variants: DataFrame) -> DataFrame:
    """(sku, price): of several variants with one SKU the last by position."""
    return variants.groupBy("sku").agg(F.max_by("price", "pos").alias("price"))


def storefront_rows(items: DataFrame, variants: DataFrame) -> DataFrame:
    """Storefront products of items (id, identifier, title, medium, support, height, width, motifs): handle, title, tags,
    label, size, SKU and price, which is blank where the SKU is unknown."""
    priced = items.join(last_prices(variants), F.col("identifier") == F.col("sku"), "left")
    size = F.when(F.col("height").isNotNull() & F.col("width").isNotNull(), F.concat_ws(" x ", F.col("height").cast("string"), F.col("width").cast("string")))
    return priced.select(
        slugify(F.concat_ws(" ", "title", "identifier")).alias("handle"),
        "title",
        F.array_join(F.array_sort(F.array_distinct("motifs")), ", ").alias("tags"),
        work_label(F.col("medium"), F.col("support")).alias("label"),
        F.coalesce(size, F.lit("")).alias("size"),
        F.col("identifier").alias("sku"),
        F.coalesce(F.col("price").cast("string"), F.lit("")).alias("price"),
    )


def storefront_products(items: DataFrame, variants: DataFrame, vendor: str, host: str, site: str) -> DataFrame:
    """All 27 columns of a storefront's import file, one row for each item.

    ``items``: id, identifier, title, work_type, medium, height, width, date, motifs, signature, condition, provenance,
    text, storage_id; a missing value is blank.  Prices are those of ``last_prices``.
    """
    priced = items.join(last_prices(variants), F.col("identifier") == F.col("sku"), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fixed = lambda value: F.lit(value)
    image = F.coalesce(F.concat(F.lit(f"https://{host}/files/original/"), "storage_id", F.lit(".jpg")), F.lit(""))
    size = F.when((text("height") != "") & (text("width") != ""), F.concat(text("height"), F.lit('" x '), text("width"), F.lit('"'))).otherwise("")
    meta = lambda name, kind: f"Metafield: artwork.{name} [{kind}]"
    line = "single_line_text_field"
    columns = {
        "Handle": slugify(text("identifier")), "Title": text("identifier"), "Body (HTML)": fixed(""), "Vendor": fixed(vendor), "Type": text("work_type"),
        "Tags": F.coalesce(F.array_join("motifs", ", "), F.lit("")), "Published": fixed("TRUE"), "Image Src": image, "Image Alt Text": text("title"),
        "Variant SKU": text("identifier"), "Variant Grams": fixed("0"), "Variant Inventory Tracker": fixed(""), "Variant Inventory Qty": fixed("1"),
        "Variant Inventory Policy": fixed("deny"), "Variant Price": text("price"), "Variant Requires Shipping": fixed("TRUE"), "Status": fixed("draft"),
        meta("catalog_number", line): text("identifier"), meta("catalog_url", "url"): F.concat(F.lit(f"https://{host}/s/{site}/item/"), F.col("id").cast("string")),
        meta("medium", line): text("medium"), meta("dimensions", line): size, meta("year", line): text("date"), meta("original_image_url", "url"): image,
        meta("signed", line): text("signature"), meta("condition", line): text("condition"), meta("provenance", line): text("provenance"),
        meta("content_excerpt", line): F.replace(truncate_words(text("text"), 200), F.lit("\n"), F.lit(" ")),
    }
    return priced.select(*[c.alias(name) for name, c in columns.items()])


def writing_rows(pieces: DataFrame, forms: dict[str, str], default: str = "Prose Poem") -> DataFrame:
    """Writings (id, form, text, year, outlet) with the form's name, an excerpt of 200 characters and a credit line."""
    table = F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), F.lit(v))])
    credit = F.concat_ws(", ", F.when(F.col("outlet") != "", F.col("outlet")), F.col("year").cast("string"))
    return pieces.select(
        "id", F.coalesce(F.try_element_at(table, F.col("form")), F.lit(default)).alias("form"), truncate_words(F.col("text"), 200).alias("excerpt"), credit.alias("credit")
    )


def text_blob(description: Column, subjects: Column, year: Column, notes: Column) -> Column:
    """Text to index: the parts that aren't empty, one a line."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.concat_ws("\n", some(description), F.when(F.size(subjects) > 0, F.array_join(subjects, ", ")), F.when(year > 0, year.cast("string")), some(notes))


def search_blob(row: dict[str, list[str]], fallback: str = "text_blob") -> Column:
    """Text to search: for each kind (description, notes, tags, ocr) the first of its columns that isn't empty, OCR
    cleaned; without any of them the fallback column."""
    first = lambda names: F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names])
    parts = [sanitize_ocr(first(names)) if kind == "ocr" else first(names) for kind, names in row.items()]
    blob = F.concat_ws("\n", *parts)
    return F.when(blob != "", blob).otherwise(F.coalesce(fallback, F.lit("")))


def ingest_rows(wide: DataFrame, host: str) -> DataFrame:
    """Index rows of wide items: year from 1901 to 2099 at the start of the date, addresses from the primary medium."""
    year = F.regexp_extract("date", r"^(?:c\. )?(\d{4})", 1).try_cast("int")
    file = lambda kind: F.concat(F.lit(f"https://{host}/files/{kind}/"), "storage_id", F.lit(".jpg"))
    return wide.select(
        "id", "title", "motifs", F.when((year > 1900) & (year < 2100), year).alias("year"), file("large").alias("thumb_url"),
        F.concat(F.lit(f"https://{host}/item/"), F.col("id").cast("string")).alias("item_url"),
    )


def normalized_results(hits: DataFrame) -> DataFrame:
    """Results whose fields have several names: (id, title, url, thumb), first non-null of each, ids above 0, of the same
    id the first by ``pos``.  ``hits``: pos and a struct ``payload`` with item_id, id, title, label, url, item_url,
    thumb, thumb_url."""
    p = lambda *names: F.coalesce(*[F.col(f"payload.{n}") for n in names])
    rows = hits.select("pos", p("item_id", "id").alias("id"), p("title", "label").alias("title"), p("item_url", "url").alias("url"), p("thumb_url", "thumb").alias("thumb"))
    first = F.min_by(F.struct("title", "url", "thumb"), "pos").alias("r")
    return rows.where(F.col("id") > 0).groupBy("id").agg(first).select("id", "r.*")
