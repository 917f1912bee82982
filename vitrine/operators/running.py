"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.staging import staged


def running_sums(df: DataFrame, group: str, score: str, sums: dict[str, str], pieces: int | None = None) -> DataFrame:
    """One row for each ``group`` and ``score``, with the sums of columns over the group's rows of at least that score.

    ``sums``: new name -> column.  Rows are first added up by score, then put in ``pieces`` ranges of (group, score), so a
    group that holds most rows lies in many ranges; a range's sums begin at those of its group's ranges before it.  One
    row for each group and range is all that meets in one place.  A null group or score is left out.
    """
    spark = df.sparkSession
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    added = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(group, score).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    order = [F.col(group), F.col(score).desc()]
    placed = staged(added.repartitionByRange(pieces, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy(group, "__part").agg(*[F.sum(n).alias(f"__{n}") for n in sums])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(group, "__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(group, "__part").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select(group, score, "__part", *[F.sum(n).over(inside).alias(n) for n in sums])
    return within.join(starts, [group, "__part"]).select(group, score, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])
