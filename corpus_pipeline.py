"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written to the shared folder as Parquet and read
again as the next stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import packing, quality, simhash, suffix_dedup
from vitrine.llm.common import remainder, written

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.  Rows whose id has remainder 0 modulo 5 are held out of its
    training."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, ~F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: SimHash finds texts whose five-word shingles may be similar by
    0.8 or more, the shingles themselves decide."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every repeated string of 200 bytes out of the texts, whole characters at the cuts; a text may become empty."""
    others = {c: F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")}
    cut = suffix_dedup.repeats(docs, {"text": F.col("kept").cast("string")}, others, whole_characters=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
