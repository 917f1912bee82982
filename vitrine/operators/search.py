"""Vector search, word search, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import folded_words, query_phrases, tokenize
from vitrine.operators import vector_cells
from vitrine.operators.running import running_sums
from vitrine.operators.staging import staged
from vitrine.operators.vector_cells import CELL_ROWS, nearest

#: Vectors on either side of a task that compares blocks.
BLOCK_ROWS = 16384


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays as it is.  Its length is made once: an expression inside the function
    would be evaluated anew for each component."""
    by = lambda size: F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))
    return F.transform(F.array(norm(a)), by)[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    sizes = norm(a) * norm(b)
    return F.when(sizes > 0, dot(a, b) / sizes).otherwise(0.0)


def usual_length(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is as long as most are (of equally frequent lengths the shorter) and holds no null and no
    component that is not finite; rows without a vector are left out."""
    given = df.where(F.col(vector).isNotNull())
    most = given.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()  # a row for each length
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return given.where((F.size(vector) == (most["n"] if most else 0)) & ~F.exists(vector, bad))


def load_vectors(df: DataFrame, vector: str, payload: list[str]) -> DataFrame:
    """Vectors at length one with some payload columns; rows without a vector are left out."""
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*payload, unit(F.col(vector)).alias(vector))


def vector_search(
    df: DataFrame, query: list[float], limit: int = 30, min_score: float | None = None, id_col: str = "id", vector: str = "vector"
) -> DataFrame:
    """The rows of largest cosine with a given vector: (id, score), ties to the smaller id.  The top is taken in every
    partition before anything is moved."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = df.where(F.col(vector).isNotNull()).select(id_col, cosine(F.col(vector), wanted).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def similar(
    df: DataFrame, source: int, limit: int = 30, version: int | None = 2, min_score: float | None = None, id_col: str = "id", vector: str = "vector"
) -> DataFrame:
    """Items most similar to one item of the same version, itself left out; no rows if the item is missing, has another
    version or no vector."""
    own = df.where((F.col(id_col) == source) & F.col(vector).isNotNull())
    pool = df.where((F.col(id_col) != source) & F.col(vector).isNotNull())
    if version is not None:
        own, pool = own.where(F.col("version") == version), pool.where(F.col("version") == version)
    one = own.select(F.col(vector).alias("__q")).limit(1)
    scored = pool.crossJoin(F.broadcast(one)).select(id_col, cosine(F.col(vector), F.col("__q")).alias("score"))  # one row
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def similar_all(
    df: DataFrame, k: int, candidates: DataFrame | None = None, id_col: str = "id", vector: str = "vector", block_rows: int = vector_cells.BLOCK_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The ``k`` most similar others of every item among ``candidates`` (by default all items): (id, other, score, rank),
    ties to the smaller id; rows with the same id are not others of each other.

    Null ids and vectors are left out, and vectors that are not as long as most of ``df`` or hold a component that is null
    or not finite.  Cells of near vectors that cannot hold one of the best are not looked into (``vector_cells``); no task
    meets more than ``block_rows`` rows of either side.
    """
    usual = usual_length(df, vector)
    length = usual.select(F.size(vector)).first()

    def clean(side: DataFrame) -> DataFrame:
        return side.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("v"))

    queries = clean(usual)
    members = queries if candidates is None else clean(usual_length(candidates.where(F.size(vector) == (length[0] if length else 0)), vector))
    return nearest(queries, members, k, cell_rows, block_rows)


def _frequency(words: Column, phrase: list[str]) -> Column:
    """How often the words of a phrase follow each other in an array of words."""
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: w == phrase[0]))
    starts = F.sequence(F.lit(1), F.size(words) - len(phrase) + 1)
    here = lambda i: reduce(Column.__and__, [F.element_at(words, (i + n).cast("int")) == w for n, w in enumerate(phrase)])
    found = F.when(F.size(words) >= len(phrase), F.size(F.filter(starts, here))).otherwise(0)
    return F.when(F.array_contains(words, phrase[0]), found).otherwise(0)


def lexical_search(
    docs: DataFrame, query: str, limit: int = 50, offset: int = 0, version: int | None = None, k1: float = 1.2, b: float = 0.75, text: str = "text", id_col: str = "id"
) -> DataFrame:
    """Documents that have every part of a query, by BM25: (id, score), best first, ties to the smaller id.

    The parts of a query lie between white space; one with several words (``self-portrait``) is a phrase, whose words
    follow each other.  Case and accents make no difference on either side.  ``version`` keeps documents of one version
    (column ``version``); the weights are those of all documents.  A query without words finds nothing.  Texts are
    reduced to one frequency for each part where they are read; no words are moved.
    """
    phrases = query_phrases(query)
    words = folded_words(F.coalesce(F.col(text), F.lit("")))
    frequency = [f"__f{i}" for i in range(len(phrases))]
    kept = [id_col, "version"] if version is not None else [id_col]
    # one variable for the words, so that they are cut once a text however often they are looked at
    said = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("__n"), *[_frequency(w, p).alias(c) for p, c in zip(phrases, frequency)]))
    counted = docs.select(*kept, F.inline(said))
    corpus = counted.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__mean"), *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_docs") for c in frequency])
    hits = counted.where(reduce(Column.__and__, [F.col(c) > 0 for c in frequency], F.lit(bool(phrases))))
    if version is not None:
        hits = hits.where(F.col("version") == version)
    joined = hits.crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for c in frequency:
        weight = F.log((F.col("__docs") - F.col(f"{c}_docs") + 0.5) / (F.col(f"{c}_docs") + 0.5) + 1)
        score = score + weight * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("__n") / F.col("__mean")))
    return joined.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).offset(offset).limit(limit)


def boosted(hits: DataFrame, query: str, tag_boost: float = 0.1, blob_boost: float = 0.03) -> DataFrame:
    """Add to scores where query words meet tags, and where they meet other words of the text: hits need id, score,
    tags, blob."""
    words = tokenize(F.lit(query))
    tags, blob = tokenize(F.col("tags")), tokenize(F.col("blob"))
    score = F.col("score") + F.when(F.arrays_overlap(words, tags), tag_boost).otherwise(0.0)
    return hits.withColumn("boosted", score + F.when(F.arrays_overlap(words, F.array_except(blob, tags)), blob_boost).otherwise(0.0))


def fused(semantic: DataFrame, lexical: DataFrame, weight: float = 0.6, k: int = 60, id_col: str = "id", payload: tuple[str, ...] = ()) -> DataFrame:
    """Weighted reciprocal-rank fusion of two scored lists: (id, score, normal), normalised to a best of 1, and of each
    column in ``payload`` (both lists have it) the first that isn't null, the semantic list's before the other's.

    The lists are result pages, so ranking them needs no more than one task.
    """
    w = min(max(weight, 0.0), 1.0)

    def part(hits: DataFrame, share: float, side: int) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), id_col)) - 1
        return hits.select(id_col, (F.lit(share) / (F.lit(k) + rank + 1)).alias("part"), F.lit(side).alias("side"), *payload)

    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("side"))).alias(c) for c in payload]
    both = part(semantic, w, 0).unionByName(part(lexical, 1 - w, 1)).groupBy(id_col).agg(F.sum("part").alias("score"), *firsts)
    top = both.agg(F.max("score").alias("top"))
    joined = both.crossJoin(F.broadcast(top))  # one row
    return joined.select(id_col, "score", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("normal"), *payload)


def seed_pairs(df: DataFrame, ids: DataFrame | list[int] | None = None, id_col: str = "id", vector: str = "vector", k: int = 8, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Greedy pairing of any number of items by similarity: (a, b, score), and (a, null, null) for those left over.

    Pairs are taken from the most similar down; of equal ones (to twelve decimals) those with larger ids.  Items of one
    direction are paired at once, the largest ids first.  Then in rounds every free item looks for its best free partner,
    and the pairs that are best for both ends are taken: just those that greedy choice would take, whatever the order of
    the rest.  Partners come from each item's ``k`` nearest; an item whose list is used up waits until the free items'
    lists are made anew, twice as long where nothing could be taken.

    ``ids``: a list, or a table with the id; by default all.  Rows without an id are left out, and of rows with equal ids
    the one with the largest vector counts; items without a usable vector are left over.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    pool = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(vector).alias("vector"))
    if ids is not None:
        wanted = spark.createDataFrame([(int(i),) for i in ids], f"id {kind}") if isinstance(ids, list) else ids.toDF("id")
        pool = pool.join(wanted.distinct(), "id", "left_semi")
    pool = staged(pool, "pool")
    taken = [_same_direction(usual_length(pool, "vector"))]

    def without(rows: DataFrame, pairs: DataFrame, column: str = "id") -> DataFrame:
        return rows.join(pairs.select(F.explode(F.array("a", "b")).alias(column)), column, "left_anti")

    free = staged(without(usual_length(pool, "vector"), taken[0]), "free")
    while (left := free.count()) > 1:
        before = len(taken)
        shown = similar_all(free, k, cell_rows=cell_rows).select("id", "other", F.round("score", 12).alias("score"))
        last = F.when((F.count("*") >= k) & F.lit(k < left - 1), F.min("score")).alias("last")
        # of a list that is full, more items may have the last score than it shows
        edges = shown.join(shown.groupBy("id").agg(last), "id").where(F.col("last").isNull() | (F.col("score") > F.col("last")))
        edges = staged(edges.select("id", "other", "score"), "edges")
        while not (new := staged(_best_for_both(edges), "pairs")).isEmpty():
            taken.append(new)
            edges = staged(without(without(edges, new), new, "other").select("id", "other", "score"), "edges")
        if len(taken) == before:
            k *= 2
        for pairs in taken[before:]:
            free = without(free, pairs)
        free = staged(free, "free")
    pairs = reduce(DataFrame.unionByName, taken).withColumn("score", F.round("score", 4))
    none = F.lit(None)
    return pairs.unionByName(without(pool, pairs).select(F.col("id").alias("a"), none.cast(kind).alias("b"), none.cast("double").alias("score")))


def _same_direction(vectors: DataFrame) -> DataFrame:
    """Pairs (a, b, score 1) of the items whose vectors have one direction, in order of id from the largest."""
    size = norm(F.col("vector"))
    told = F.sha2(F.array_join(F.transform(unit(F.col("vector")), lambda x: F.round(x, 12).cast("string")), " "), 256)
    same = vectors.where(size > 0).select(told.alias("key"), "id", F.lit(1).alias("one"))
    several = same.join(same.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi")
    ranked = running_sums(several, "key", "id", {"place": "one"})
    pairs = ranked.groupBy("key", F.ceil(F.col("place") / 2)).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    return staged(pairs.select("a", "b", F.lit(1.0).alias("score")), "pairs")


def _best_for_both(edges: DataFrame) -> DataFrame:
    """The pairs (a < b) that are the best edge of both ends, by score, then larger ids; ``edges``: id, other, score."""
    order = F.struct("score", F.least("id", "other"), F.greatest("id", "other"))
    best = edges.groupBy("id").agg(F.max_by("other", order).alias("other"), F.max("score").alias("score"))
    back = best.select(F.col("other").alias("id"), F.col("id").alias("other"))
    return best.join(back, ["id", "other"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "score")
