"""Keyed writes as transformations: each returns the new state of a table, which the caller writes as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in order; pre-aggregated before the shuffle, so a hot key is no bottleneck."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``updates`` replace those of the same key, others are added."""
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def refresh(target: DataFrame, run: DataFrame, by: list[str], truncate: bool = False) -> DataFrame:
    """Replace all rows of the keys that a run covers, or the whole table."""
    if truncate:
        return run
    return target.join(run.select(*by).distinct(), by, "left_anti").unionByName(run)


def pull_new(source: DataFrame, local: DataFrame, id_col: str, mark: str | None = None) -> DataFrame:
    """Rows of ``source`` above the local high-water mark that aren't there yet.  The mark is one number, read first, so
    that the comparison can be pushed into the source's scan."""
    column = mark or id_col
    high = local.agg(F.max(column).alias("high")).first()["high"]
    fresh = source if high is None else source.where(F.col(column) > F.lit(high))
    return fresh.join(local.select(id_col), id_col, "left_anti")


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in the target, one of each key: the smallest."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*") if rest else rows.distinct()
    return one.select(*rows.columns).join(target.select(*keys), keys, "left_anti")


def delete_items(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete ids (column ``id``) from several tables, each given with the column that refers to them."""
    return {n: df.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_anti").select(*df.columns) for n, (df, c) in tables.items()}


def update_values(df: DataFrame, where: Column, column: str, new: Column) -> DataFrame:
    """Change a column in rows where a condition holds; a null condition doesn't."""
    return df.withColumn(column, F.when(where, new).otherwise(F.col(column)))


def classify_changes(source: DataFrame, state: DataFrame, id_col: str, modified: str, seen: str) -> DataFrame:
    """new, updated or up_to_date; an unknown time is 0."""
    joined = source.join(state.select(id_col, F.col(seen).alias("__seen"), F.lit(True).alias("__known")), id_col, "left")
    kind = F.when(F.col("__known").isNull(), "new")
    kind = kind.when(F.coalesce(modified, F.lit(0)) > F.coalesce("__seen", F.lit(0)), "updated").otherwise("up_to_date")
    return joined.withColumn("change", kind).drop("__seen", "__known")


def without_repeats(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Of rows with equal keys the one with the smallest id."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), id_col).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*df.columns)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group in order.  Spark keeps only ``k`` rows of a group in each task before it
    moves them."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
