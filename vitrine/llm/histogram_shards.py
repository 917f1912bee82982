"""Operator 6: sharding by histogram sort.

Rows are ordered by a key (hash of the text, id, row number), so equal texts are neighbours.  The splitters between
shards are found by counting: each round one aggregation adds up the exact bytes of all partitions below the candidate
boundaries, keeps the boundaries that meet their target, and lays finer candidates into the intervals whose target is
still open.  An interval that has shrunk to one hash is refined by id, then by row number, so that a group of copies of
any size is cut where the bytes ask for it.  Then the rows move once, to the block that their key falls into, and get
their slots there.  Only DataFrame functions run on the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import written

LEAST, MOST = -(1 << 63), (1 << 63) - 1
KEY = ("__h", "__id", "__row")

#: Bytes of a piece of a shard that one task sorts, and pieces of a shard at least.
BLOCK_BYTES, BLOCKS = 1 << 28, 8

#: Candidate boundaries laid into the whole range in the first round, and into each open interval later.
FIRST_PROBES, PROBES = 4096, 256


@dataclass
class _Interval:
    """Rows whose key starts with ``prefix`` and goes on between ``low`` and ``high``, with ``below`` bytes of smaller keys.

    They are the rows of range ``bucket`` of interval ``parent`` of the round before.
    """

    parent: int
    bucket: int
    prefix: tuple[int, ...]
    low: int
    high: int
    below: int
    targets: list[int]

    def width(self, probes: int) -> int:
        """Width of a candidate range in halves of keys, as the difference of two 64-bit keys may need 65 bits; 0: each
        key is a range."""
        return 0 if self.high - self.low < probes else ((self.high >> 1) - (self.low >> 1)) // probes + 1


def _range_of(key: Column, low: Column, width: Column) -> Column:
    """Number of the candidate range that a key lies in."""
    halves = F.shiftright(key, 1) - F.shiftright(low, 1)
    return F.when(width == 0, key - low).otherwise(F.call_function("div", halves, F.greatest(width, F.lit(1))))


def find_splitters(keys: DataFrame, targets: list[int], slack: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """For each target the key up to which (inclusive) the bytes are closest to it, to within its slack where single
    rows allow it.  ``keys`` has the key columns, their ``__range`` in the first round, and ``__bytes``; ``low`` and
    ``high`` bound the first key column."""
    spark, found = keys.sparkSession, {}
    open_ones, probes = [_Interval(0, 0, (), low, high, 0, list(range(len(targets))))], FIRST_PROBES
    rows = keys.select(*KEY, "__bytes", F.lit(0).alias("__i"), F.col("__range").alias("__b"))
    ends = [f(c).alias(f"{n}_{c}") for c in KEY for f, n in ((F.min, "min"), (F.max, "max"))]
    while True:
        counted = rows.groupBy("__i", "__b").agg(F.sum("__bytes").alias("bytes"), *ends).collect()
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["__i"], r["__b"])):
            by.setdefault(r["__i"], []).append(r)
        again: list[_Interval] = []
        for i, interval in enumerate(open_ones):
            level, ranges, below = len(interval.prefix), by.get(i, []), interval.below
            waiting, before = sorted(interval.targets, key=lambda t: targets[t]), None
            for r in ranges:
                above = below + r["bytes"]
                last = (*interval.prefix, r[f"max_{KEY[level]}"], MOST, MOST)[:3]
                single = all(r[f"min_{c}"] == r[f"max_{c}"] for c in KEY)
                inside = []
                while waiting and (targets[waiting[0]] <= above or r is ranges[-1]):
                    t = waiting.pop(0)
                    under, over = targets[t] - below, above - targets[t]
                    if before is not None and (under <= min(slack[t], over) or single and under < over):
                        found[t] = before
                    elif over <= slack[t] or single:
                        found[t] = last
                    else:
                        inside.append(t)
                if inside:
                    prefix = interval.prefix
                    while len(prefix) < 2 and r[f"min_{KEY[len(prefix)]}"] == r[f"max_{KEY[len(prefix)]}"]:
                        prefix = (*prefix, r[f"min_{KEY[len(prefix)]}"])
                    name = KEY[len(prefix)]
                    again.append(_Interval(i, r["__b"], prefix, r[f"min_{name}"], r[f"max_{name}"], below, inside))
                below, before = above, last
        if not again:
            return [found[t] for t in range(len(targets))]
        open_ones, probes = again, PROBES
        # At most one row for each target.
        places = [(x.parent, x.bucket, i, len(x.prefix), x.low, x.width(probes)) for i, x in enumerate(again)]
        table = spark.createDataFrame(places, "__i int, __b long, __next int, __level int, __low long, __width long")
        key = F.when(F.col("__level") == 0, F.col(KEY[0])).when(F.col("__level") == 1, F.col(KEY[1])).otherwise(F.col(KEY[2]))
        spot = _range_of(key, F.col("__low"), F.col("__width"))
        joined = rows.join(F.broadcast(table), ["__i", "__b"])
        rows = joined.select(*KEY, "__bytes", F.col("__next").alias("__i"), spot.cast("long").alias("__b"))


def shard_rows(
    df: DataFrame,
    shards: int = 40,
    columns: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.001,
    blocks: int | None = None,
) -> DataFrame:
    """Deal the rows of ``df`` into ``shards`` shards of near equal bytes; law ``bytes``.

    A row's size is its text's UTF-8 bytes (a null text has none) plus 16.  Returns ``row`` (a struct of ``columns``,
    by default all input columns, so that no name can clash), size, law, shard and slot (gapless from 0, in key order),
    with the rows physically in that order.  Shard sizes differ from the mean by ``tolerance`` of it plus, at most, the
    row at each boundary.  Equal texts are neighbours; null and empty texts are equal; null ids come first; repeated
    rows are kept and told apart by a row number of the staged table.  An empty table gives no rows.  ``blocks`` is the
    number of pieces per shard that are sorted by themselves, by default as many as hold ``BLOCK_BYTES`` each.
    """
    columns = columns or {c: F.col(f"`{c}`") for c in df.columns}
    text = F.col(text_col)
    staged, _ = written(
        df.select(
            F.struct(*[c.alias(name) for name, c in columns.items()]).alias("row"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("__bytes"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias(KEY[0]),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias(KEY[1]),
            F.monotonically_increasing_id().alias(KEY[2]),
        ),
        "shard-keys",
    )
    ends = staged.agg(F.sum("__bytes").alias("n"), F.min(KEY[0]).alias("low"), F.max(KEY[0]).alias("high")).first()
    total, low, high = ends["n"] or 0, ends["low"] or 0, ends["high"] or 0
    blocks = blocks or max(BLOCKS, -(-total // (shards * BLOCK_BYTES)))
    whole = _Interval(0, 0, (), low, high, 0, [])
    ranged = staged.withColumn("__range", _range_of(F.col(KEY[0]), F.lit(low), F.lit(whole.width(FIRST_PROBES))).cast("long"))
    pieces = shards * blocks
    targets = [total * i // pieces for i in range(1, pieces)]
    fine, coarse = int(total / shards * tolerance), int(total / pieces / 4)
    slack = [fine if i % blocks == 0 else coarse for i in range(1, pieces)]
    splitters = find_splitters(ranged, targets, slack, low, high) if total else []
    splitters = [max(splitters[: i + 1]) for i in range(len(splitters))]
    # The block of a row: the splitters of lower ranges, counted here, and those of its own range that its key exceeds.
    width, own = whole.width(FIRST_PROBES), {}
    for x in splitters:
        at = ((x[0] >> 1) - (low >> 1)) // width if width else x[0] - low
        own.setdefault(at, []).append(x)
    ranges, lower = [], 0
    for at in range(FIRST_PROBES + 1):  # as many rows at every size of the input
        ranges.append((at, lower, own.get(at, [])))
        lower += len(own.get(at, []))
    table = staged.sparkSession.createDataFrame(ranges, "__range long, __lower int, __own array<struct<a: long, b: long, c: long>>")
    key = F.struct(*[F.col(c).alias(n) for c, n in zip(KEY, "abc")])
    block = F.col("__lower") + F.size(F.filter("__own", lambda x: x < key))
    placed = ranged.join(F.broadcast(table), "__range").withColumn("__block", block)  # one row for each range
    held = {r["__block"]: r["count"] for r in placed.groupBy("__block").count().collect()}
    base, first = [], 0
    for i in range(pieces):
        first = 0 if i % blocks == 0 else first
        base.append(first)
        first += held.get(i, 0)
    firsts = placed.sparkSession.createDataFrame(list(enumerate(base)), "__block int, __first long")
    moved = placed.join(F.broadcast(firsts), "__block").repartitionById(pieces, "__block").sortWithinPartitions(*KEY)  # one row for each piece
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return moved.select(
        "row",
        F.col("__bytes").alias("size"),
        F.lit("bytes").alias("law"),
        F.expr(f"cast(__block div {blocks} as int)").alias("shard"),
        (F.col("__first") + inside).alias("slot"),
    )
