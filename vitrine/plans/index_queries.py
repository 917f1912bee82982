"""Queries over stored indexes of words and vectors, and pairing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitrine.operators import pages, rounds, search, vector_cells, word_index
from vitrine.operators.staging import shared_folder
from vitrine.plans.registry import register
from vitrine.plans.search_queries import COS, LEXICAL_SQL, _parts_sql, _vectors
from vitrine.sources.catalog import table


def _folder(spark, name):
    return f"{shared_folder(spark)}/vitrine/{name}-{uuid.uuid4().hex}"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 2 + 1).alias("version"))


def _indexed(spark, sf_dir):
    """An index of all documents."""
    path = _folder(spark, "words")
    word_index.index_documents(_docs(spark, sf_dir), path)
    return path


@register("indexed_search", LEXICAL_SQL + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 50")
def indexed_search(spark, sf_dir):
    return word_index.indexed_search(spark, _indexed(spark, sf_dir), "the of").withColumn("score", F.round("score", 6))


@register("indexed_phrase", _parts_sql([["the", "the"], ["of"]], " AND version = 2") + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20 OFFSET 3")
def indexed_phrase(spark, sf_dir):
    return word_index.indexed_search(spark, _indexed(spark, sf_dir), "the-The of", 20, 3, 2).withColumn("score", F.round("score", 6))


@register("indexed_update", _parts_sql([["the", "of"], ["and"]]) + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 50")
def indexed_update(spark, sf_dir):
    """First other texts, then the documents' own in their place."""
    path, docs = _folder(spark, "words"), _docs(spark, sf_dir)
    word_index.index_documents(docs.withColumn("text", F.concat(F.lit("the of and the of "), F.reverse("text"))), path)
    word_index.index_documents(docs.where("id % 2 = 0"), path)
    word_index.index_documents(docs.where("id % 2 = 1"), path)
    target = _folder(spark, "words")
    word_index.compacted(spark, path, target)
    return word_index.indexed_search(spark, target, "the-of and").withColumn("score", F.round("score", 6))


@register(
    "indexed_page",
    LEXICAL_SQL + """, p AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20)
SELECT id, 1 - (row_number() OVER (ORDER BY score DESC, id) - 1) / (SELECT count(*) FROM p) AS score FROM p""",
)
def indexed_page(spark, sf_dir):
    """An exact page out of the index."""
    return pages.search_items(_docs(spark, sf_dir).withColumn("tags", F.lit("")), _vectors(spark, sf_dir), "the of", 7, "exact", index=_indexed(spark, sf_dir))


def _stored(spark, sf_dir):
    path = _folder(spark, "vectors")
    vectors = _vectors(spark, sf_dir).select("id", search.unit(F.col("vector")).alias("v"), "version")
    vector_cells.store(vectors, path, cell_rows=100)
    return path


@register(
    "stored_vector_search",
    f"SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings b, (SELECT [1.0] || list_transform(range(63), lambda x: 0.5) AS embedding) a WHERE {COS} >= 0.05 ORDER BY {COS} DESC, 1 LIMIT 20",
)
def stored_vector_search(spark, sf_dir):
    return vector_cells.stored_search(spark, _stored(spark, sf_dir), [1.0] + [0.5] * 63, 20, 0.05).withColumn("score", F.round("score", 6))


@register(
    "stored_similar",
    f"SELECT b.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND b.vec_id % 2 = 1 ORDER BY {COS} DESC, 1 LIMIT 30",
)
def stored_similar(spark, sf_dir):
    """Items like item 7 of its version, out of the cells that may hold one."""
    own = _vectors(spark, sf_dir).where("id = 7").first()
    return vector_cells.stored_search(spark, _stored(spark, sf_dir), own["vector"], 30, without=7, version=own["version"]).withColumn("score", F.round("score", 6))


@register("seeded_pairs")
def seeded_pairs(spark, sf_dir):
    """All vectors paired greedily."""
    return search.seed_pairs(_vectors(spark, sf_dir))


@register("next_round")
def next_round(spark, sf_dir):
    """The vectors paired, every third pair's first ones out, and the others paired anew."""
    first = search.seed_pairs(_vectors(spark, sf_dir))
    picks = first.withColumn("pick", F.when(F.col("a") % 3 == 0, "b").otherwise("both"))
    return rounds.next_round(picks, _vectors(spark, sf_dir))
