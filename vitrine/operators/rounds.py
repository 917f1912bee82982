"""Curation rounds: titles of rounds, pools, picks, brackets and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.search import seed_pairs


def rounds_of(sets: DataFrame) -> DataFrame:
    """(name, round, set_id) of sets whose title is ``[Curate] name Round n``."""
    pattern = r"^\[Curate\] (.+) Round (\d+)$"
    rows = sets.select(F.col("id").alias("set_id"), F.regexp_extract("title", pattern, 1).alias("name"), F.regexp_extract("title", pattern, 2).try_cast("int").alias("round"))
    return rows.where(F.col("round").isNotNull()).select("name", "round", "set_id")


def exhibitions_in_rounds(sets: DataFrame) -> DataFrame:
    """(name, rounds, last): the rounds of each exhibition in order, and the last one."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("round")), lambda r: r.cast("string")), ",")
    return rounds_of(sets).groupBy("name").agg(listed.alias("rounds"), F.max("round").alias("last"))


def round_pool(items: DataFrame, category: str, survivors: DataFrame | None = None) -> DataFrame:
    """Items (id, category) of a round: those of a category in the first, the survivors of the last one after."""
    if survivors is None:
        return items.where(F.col("category") == category).select("id")
    return items.join(survivors, "id", "left_semi").select("id")


def bracket_results(pairs: DataFrame) -> DataFrame:
    """(id, survives) out of decided pairs (a, b, pick): pick is a, b, both or none; an item without an opponent
    survives."""
    left = F.struct(F.col("a").alias("id"), (F.col("b").isNull() | F.col("pick").isin("a", "both")).alias("survives"))
    right = F.struct(F.col("b").alias("id"), F.col("pick").isin("b", "both").alias("survives"))
    return pairs.select(F.explode(F.array(left, right)).alias("r")).select("r.*").where(F.col("id").isNotNull())


def round_statistics(results: DataFrame) -> DataFrame:
    """Per round (round, survives): kept, cut and the share kept in per cent to one decimal."""
    kept = F.sum(F.when(F.col("survives"), 1).otherwise(0))
    return results.groupBy("round").agg(kept.alias("kept"), (F.count("*") - kept).alias("cut"), F.round(kept * 100.0 / F.count("*"), 1).alias("percent"))


def stratified_sample(items: DataFrame, stratum: str, size: int, order: str = "id") -> DataFrame:
    """``size`` rows, equally from each stratum in order; what small strata leave free is filled from the others, in
    order of the row's place in its stratum."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    ranked = items.withColumn("__place", place).where(F.col("__place") <= size)
    return ranked.orderBy("__place", stratum).limit(size).drop("__place")


def era_sample(items: DataFrame, size: int) -> DataFrame:
    """Items (id, early) of both eras in order of id: half of ``size`` from the late ones, as far as there are so many, and
    the rest from the early ones; all items if they are no more than ``size``."""
    ordered = lambda early: items.where("early" if early else "not early").orderBy("id")
    some = items.limit(size + 1).count()  # no more is counted than decides
    if some <= size:
        return items.orderBy("id")
    late = ordered(False).limit(size // 2)
    return late.unionByName(ordered(True).limit(size - late.count())).orderBy("id")


def next_round(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs of the next round, (a, b, score): the survivors of decided pairs, paired anew by similarity.  Fewer than
    two survivors have no next round and give no rows."""
    left = bracket_results(pairs).where("survives").select("id").distinct()
    return seed_pairs(vectors, left if left.limit(2).count() > 1 else left.limit(0))
