"""How rare an item's motifs, mentions and words are in the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import lexical_tokens
from vitrine.operators.staging import staged

#: Words that every task of a lexical profile knows.
COMMON_WORDS = 1024

#: Motifs that count less because they come from storage labels or are not visual: fixed weights.
VISUAL, BOXED, OTHER = 1.0, 0.7, 0.85


def idf(df: Column, total: Column) -> Column:
    """ln((N + 1) / (1 + df))."""
    return F.log((total + 1) / (df + 1))


def score_class(score: Column) -> Column:
    """Classes 1 to 5, up to 20, 40, 60, 80 and above."""
    return F.when(score <= 20, 1).when(score <= 40, 2).when(score <= 60, 3).when(score <= 80, 4).otherwise(5)


def motif_frequency(items: DataFrame, item: str = "item_id", motif: str = "motif") -> DataFrame:
    """(motif, df): items that have each motif; repetitions within an item count once."""
    return items.where(F.col(motif).isNotNull()).groupBy(motif).agg(F.countDistinct(item).alias("df"))


def motif_rarity(items: DataFrame, motifs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Rarity of every item: (item_id, score, class).

    ``items``: item_id, also those without motifs, which score 0 in class 1.  ``motifs``: item_id, motif; repetitions in
    an item's own list count again.  The score is the geometric mean of weighted inverse document frequencies, each at
    least 0.001, over ln(N + 1), in per cent, at most 100.  ``weights``: motif, weight; 1 where there is none.
    """
    total = items.agg(F.countDistinct("item_id").alias("total"))
    known = motif_frequency(motifs)
    rated = motifs.join(known, "motif").crossJoin(F.broadcast(total))  # one row
    if weights is not None:
        rated = rated.join(weights, "motif", "left")
    else:
        rated = rated.withColumn("weight", F.lit(1.0))
    value = F.greatest(idf(F.col("df"), F.col("total")) * F.coalesce("weight", F.lit(1.0)), F.lit(0.001))
    means = rated.groupBy("item_id").agg(F.exp(F.avg(F.log(value))).alias("mean"), F.max("total").alias("total"))
    raw = F.least(F.greatest(F.col("mean") / F.log(F.col("total") + 1) * 100, F.lit(0.0)), F.lit(100.0))
    scored = items.select("item_id").distinct().join(means, "item_id", "left").withColumn("score", F.coalesce(raw, F.lit(0.0)))
    return scored.select("item_id", "score", score_class(F.col("score")).alias("class"))


def motif_details(items: DataFrame, motifs: DataFrame) -> DataFrame:
    """Per item its motifs, the rarest first: (item_id, motif, df, rank)."""
    rated = motifs.distinct().join(motif_frequency(motifs), "motif")
    order = Window.partitionBy("item_id").orderBy("df", "motif")
    return rated.join(items.select("item_id").distinct(), "item_id", "left_semi").withColumn("rank", F.row_number().over(order))


def rarity_of(scores: DataFrame, ids: list[int]) -> DataFrame:
    """(item_id, class) of at most 100 items of a table of scores; items that it doesn't have, or has without a class, are
    left out."""
    if len(ids) > 100:
        raise ValueError("at most 100 ids can be asked for")
    return scores.where(F.col("item_id").isin([int(i) for i in ids]) & F.col("class").isNotNull()).select("item_id", "class")


def mention_profile(mentions: DataFrame, none: str = "NONE") -> DataFrame:
    """Per item and mention: the share of items with any mention that have it, and whether it is unique; ``none`` marks
    items that were read and have none, which don't count."""
    real = mentions.where(F.col("mention") != none).select("item_id", "mention").distinct()
    total = real.agg(F.countDistinct("item_id").alias("total"))
    df = real.groupBy("mention").agg(F.count("*").alias("df"))
    joined = real.join(df, "mention").crossJoin(F.broadcast(total))  # one row
    return joined.select("item_id", "mention", "df", (F.col("df") * 100.0 / F.col("total")).alias("percent"), (F.col("df") == 1).alias("unique"))


def lexical_frequency(texts: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(word, df): items whose text has each word."""
    words = texts.select(item, F.explode(lexical_tokens(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df"))


def lexical_profile(texts: DataFrame, ids: DataFrame | None = None, top: int = 25, most: int = COMMON_WORDS) -> DataFrame:
    """The rarest words of the given items, or of all, against the corpus: (item_id, word, df, percent, rank).

    ``texts``: item_id, text, one row per item.  Ties keep the order of first sight in the text.  Texts are read once, into
    lists of words.  The ``most`` most frequent words, in over so many items as no other word, are known to every task;
    they are the last in any list, so they are looked at only where an item has fewer than ``top`` others, and only the
    others are moved to meet their frequencies.
    """
    spark = texts.sparkSession
    read = staged(texts.select("item_id", lexical_tokens(F.col("text")).alias("words")), "words")
    total = read.count()
    known = staged(read.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    first = known.orderBy(F.desc("df"), "word").limit(most + 1).collect()  # a bounded vocabulary
    cut = first[most]["df"] if len(first) > most else 0
    common = spark.createDataFrame([(r["word"], r["df"]) for r in first if r["df"] > cut], "word string, df long")
    asked = read if ids is None else read.join(ids.select("item_id").distinct(), "item_id", "left_semi")
    one = F.broadcast(common.agg(F.collect_list("word").alias("common")))  # one row
    parts = asked.crossJoin(one).select("item_id", F.array_except("words", "common").alias("rare"), F.array_intersect("words", "common").alias("frequent"))
    rare = parts.select("item_id", F.posexplode("rare").alias("pos", "word")).join(known.where(F.col("df") <= cut), "word")
    frequent = parts.where(F.size("rare") < top).select("item_id", F.posexplode("frequent").alias("pos", "word")).join(F.broadcast(common), "word")
    both = rare.select("item_id", "word", "df", "pos").unionByName(frequent.select("item_id", "word", "df", "pos"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "pos")))
    return ranked.where(F.col("rank") <= top).select("item_id", "word", "df", (F.col("df") * 100.0 / total).alias("percent"), "rank")
