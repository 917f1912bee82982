"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import dropped, written


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them and itself.

    ``edges`` has u > v.  Large star: every node's larger neighbours get its least neighbour.  Small star: every node's
    smaller neighbours and itself do.  The least neighbour comes from a grouped minimum (combined before the shuffle)
    and is joined back, so that a hub's edges are never gathered in one group.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component, itself included.

    Edges may repeat, point either way, or join a node to itself; an edge with a null end is left out; nodes without an
    edge are not returned.  Each round is written to the shared folder, and the rounds end when one changes nothing.
    """
    spark = edges.sparkSession
    high, low = F.greatest("a", "b"), F.least("a", "b")
    start = edges.where("a is not null and b is not null and a != b").select(high.alias("u"), low.alias("v")).distinct()
    now, path = written(start, "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        after, new = written(_star(_star(now, True), False), "edges")
        dropped(spark, path)
        now, path, last, seen = after, new, seen, mark(after)
        if seen == last:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
