"""Result pages: hydration, paging, snippets, autocomplete, examples, search modes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.search import boosted, fused, lexical_search, similar
from vitrine.operators.word_index import indexed_search


def hydrated(hits: DataFrame, metadata: DataFrame, id_col: str = "id") -> DataFrame:
    """Hits with metadata, those without it kept; the rank stays."""
    return hits.join(metadata, id_col, "left").orderBy("rank")


def page_numbers(total: int, limit: int, offset: int) -> dict[str, int | bool]:
    """Page, pages, and whether there are others; a page has at least one row."""
    size = max(limit, 1)
    page, pages = max(offset, 0) // size + 1, max(1, math.ceil(total / size))
    return {"page": page, "total_pages": pages, "has_previous": page > 1, "has_next": page < pages}


def word_snippet(text: Column, query: Column, width: int = 12) -> Column:
    """A window of ``width`` words around the first one that holds the query, dots where the text goes on."""
    words = F.split(F.trim(text), r"\s+")
    marks = F.transform(words, lambda w: F.lower(w).contains(F.lower(query)))
    hit = F.greatest(F.array_position(marks, True), F.lit(1))
    start = F.greatest(hit - width // 2, F.lit(1)).cast("int")
    body = F.array_join(F.slice(words, start, width), " ")
    before = F.when(start > 1, "...").otherwise("")
    return F.concat(before, body, F.when(F.size(words) >= start + width, "...").otherwise(""))


def autocomplete(vocabulary: DataFrame, typed: str, chosen: DataFrame, limit: int = 12) -> DataFrame:
    """Terms that hold what was typed in any case, less those chosen, in order."""
    found = vocabulary.where(F.lower("value").contains(typed.lower())).select("value").distinct()
    return found.join(chosen.select("value"), "value", "left_anti").orderBy("value").limit(limit)


def few_shot(candidates: DataFrame, tags: DataFrame, least: int = 2, size: int = 5) -> DataFrame:
    """The first ``size`` candidates (id, rank) with at least ``least`` tags (id, tag), with their tags."""
    tagged = tags.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags")).where(F.size("tags") >= least)
    return candidates.join(tagged, "id").orderBy("rank").limit(size)


def well_tagged_sample(tags: DataFrame, seed: int, least: int = 3, size: int = 10) -> DataFrame:
    """A random sample of items with at least ``least`` tags; the same for the same seed."""
    counted = tags.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)


def extremes(df: DataFrame, score: str, size: int = 5, id_col: str = "item_id") -> DataFrame:
    """The ``size`` lowest and highest rows by score: + side, rank."""
    low = df.orderBy(score, id_col).limit(size).select(id_col, score, F.lit("low").alias("side"))
    high = df.orderBy(F.desc(score), id_col).limit(size).select(id_col, score, F.lit("high").alias("side"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.when(F.col("side") == "low", F.col(score)).otherwise(-F.col(score)), id_col))
    return low.unionByName(high).withColumn("rank", rank)


def search_items(
    docs: DataFrame, vectors: DataFrame, query: str, source: int, mode: str = "hybrid", limit: int = 20, offset: int = 0, weight: float = 0.6, most: int = 50, index: str | None = None
) -> DataFrame:
    """Search in a mode: semantic (near a source vector), exact (words) or hybrid (both, boosted and fused).

    ``docs``: id, text, tags; ``vectors``: id, vector.  Exact scores fall evenly over the page.  At most ``most``
    candidates of each kind are fused.  With an ``index`` (a folder of ``word_index``) words are looked up there, and no
    text is read but those of the candidates.  Returns (id, score), best first.
    """

    def words(size: int, skipped: int = 0) -> DataFrame:
        return indexed_search(docs.sparkSession, index, query, size, skipped) if index else lexical_search(docs, query, size, skipped)

    if mode == "exact":
        found = words(limit, offset)
        size = found.count()  # at most a page
        place = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1
        return found.select("id", (1 - place / max(size, 1)).alias("score"))
    near = similar(vectors, source, most, None)
    if mode == "semantic":
        return near.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
    named = near.join(docs.select("id", "tags", F.col("text").alias("blob")), "id")
    better = boosted(named, query).select("id", F.col("boosted").alias("score"))
    both = fused(better, words(most), weight)
    return both.select("id", F.col("normal").alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(limit)
