"""Dictionaries of names: which words and phrases stand for which name, by order of precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiers of triggers: phrases, single words, and words that a misreading may be compared with.
PHRASE, WORD, FUZZY = 1, 2, 3
#: Words of a mention that still is a trigger, at most; letters of a last word or a one-word mention, at least.
MENTION_WORDS, LEAST_LETTERS = 4, 4


def _upper(col: str | Column) -> Column:
    return F.upper(F.col(col) if isinstance(col, str) else col)


def _writes(rows: DataFrame, trigger: Column, tier: int, source: int, step: int, where: Column) -> DataFrame:
    """Entries in the order in which they are written: source, the name's place, the step within a name, the trigger."""
    at = F.struct(F.lit(source).alias("source"), F.col("pos").alias("pos"), F.lit(step).alias("step"), trigger.alias("trigger"))
    return rows.where(where).select(trigger.alias("trigger"), F.lit(tier).alias("tier"), "canonical", at.alias("at"))


def build(prior: DataFrame, supplementary: DataFrame | None = None, ambiguous: tuple[str, ...] = (), common: tuple[str, ...] = (), last_words: bool = True, least: int = 1) -> DataFrame:
    """(trigger, canonical, type, tier, place) from names found before and from supplementary ones.

    ``prior``: pos, canonical, type, mention (null where there is none), a row for each mention in order of ``pos``; a
    name stands where it is first, with the type that it has there.  A name of several words is a phrase, and its last
    word of four or more letters a word; a name of one word, of ``least`` or more letters, is a word.  Mentions of two to
    four words are phrases, those of one word of four or more letters words.  Later names take a trigger from earlier
    ones, a name's mentions come after itself.

    ``supplementary``: pos, canonical, type, singles, multis.  Its triggers, and each name of several words, count only
    where nothing has them yet, of two the first; a name that ``prior`` has keeps its type.

    Words in ``ambiguous`` are no triggers.  Words of names (not of mentions) that are not ``common``, and all
    supplementary ones, may be compared with misread words (tier 3).  ``last_words=False`` is for places: no last words,
    no mentions, no common words.  ``place`` orders triggers by when they were first written.
    """
    unclear = F.lit(True) if not ambiguous else ~F.col("__t").isin(list(ambiguous))
    plain = F.lit(True) if not common else ~F.col("__t").isin(list(common))
    named = prior.where(F.col("canonical").isNotNull()).groupBy("canonical").agg(F.min("pos").alias("pos"), F.min_by("type", "pos").alias("type"), F.collect_set("mention").alias("mentions"))
    named = named.withColumn("words", F.split(F.trim("canonical"), r"\s+")).withColumn("full", _upper("canonical"))
    many = F.size("words") > 1
    last = named.withColumn("__t", F.when(many, _upper(F.element_at("words", -1))).otherwise(F.col("full")))
    long = F.when(many, (F.length("__t") >= LEAST_LETTERS) & F.lit(last_words)).otherwise(F.length("__t") >= least)
    allowed = unclear & long & (F.lit(True) if last_words else plain)
    trigger = F.col("__t")
    parts = [_writes(named, F.col("full"), PHRASE, 0, 0, many), _writes(last, trigger, WORD, 0, 1, allowed)]
    if last_words:
        parts.append(_writes(last, trigger, FUZZY, 0, 1, allowed & plain))
        said = named.select("canonical", "pos", F.explode("mentions").alias("m")).withColumn("__t", _upper("m")).withColumn("n", F.size(F.filter(F.split(F.trim("__t"), r"\s+"), lambda x: x != "")))
        parts.append(_writes(said, trigger, PHRASE, 0, 2, F.col("n").between(2, MENTION_WORDS)))
        parts.append(_writes(said, trigger, WORD, 0, 2, (F.col("n") <= 1) & unclear & (F.length("__t") >= LEAST_LETTERS)))
    kinds = named.select("canonical", "type", F.lit(0).alias("source"), "pos")
    if supplementary is not None:
        more = supplementary.where(F.col("canonical").isNotNull())
        single = more.select("canonical", "pos", F.posexplode("singles").alias("i", "__t")).withColumn("__t", _upper("__t"))
        free = unclear & (F.lit(True) if last_words else plain)
        parts.append(_writes(single, trigger, WORD, 1, 0, free))
        if last_words:
            parts.append(_writes(single, trigger, FUZZY, 1, 0, free))
        multi = more.select("canonical", "pos", F.explode("multis").alias("__t")).withColumn("__t", _upper("__t"))
        parts.append(_writes(multi, trigger, PHRASE, 1, 1, F.lit(True)))
        parts.append(_writes(more.withColumn("__t", _upper("canonical")), trigger, PHRASE, 1, 2, F.size(F.split(F.trim("canonical"), r"\s+")) > 1))
        kinds = kinds.unionByName(more.select("canonical", "type", F.lit(1).alias("source"), "pos"))
    written = reduce(DataFrame.unionByName, parts).where("trigger != ''")
    early = F.when(F.col("at.source") == 0, F.col("at"))
    found = written.groupBy("tier", "trigger").agg(
        F.coalesce(F.max_by("canonical", early), F.min_by("canonical", "at")).alias("canonical"), F.min("at").alias("place")
    )
    types = kinds.groupBy("canonical").agg(F.min_by("type", F.struct("source", "pos")).alias("type"))
    return found.join(types, "canonical").select("trigger", "canonical", "type", "tier", "place")


def of_names(names: DataFrame, ambiguous: list[str], common: tuple[str, ...] = ()) -> DataFrame:
    """A dictionary of names (canonical, type) in the order of their text."""
    prior = names.select(F.col("canonical").alias("pos"), "canonical", "type", F.lit(None).cast("string").alias("mention"))
    return build(prior, None, tuple(ambiguous), common)


def resolved(variants: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(variant, canonical, type): misreadings (variant, trigger) with what their trigger stands for, as a word or else as
    a phrase; those of unknown triggers are left out."""
    known = dictionary.where(F.col("tier").isin(WORD, PHRASE)).groupBy("trigger").agg(
        F.max_by(F.struct("canonical", "type"), "tier").alias("n")  # words go before phrases
    )
    rows = variants.select(_upper("variant").alias("variant"), _upper("trigger").alias("trigger")).where("variant != trigger").distinct()
    return rows.join(known, "trigger").select("variant", "n.canonical", "n.type")
