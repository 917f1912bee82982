"""A stored word index: postings with positions, so that a search reads its own words and no text.

An index is a folder of Parquet tables.  ``postings`` is partitioned by a hash of the word: (batch, bucket, word, id, at), of
which the last two are arrays: some documents of the word and where it stands in each;
``documents`` says which batch an id's words are in: (batch, id, version, n); ``totals`` has a row for each batch.  An
update adds a batch: of an id that comes again only the last batch counts, so its old words are gone at once.
``compacted`` writes an index anew without what no longer counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import folded_words, query_phrases
from vitrine.operators.staging import single_rows

#: Buckets of words, rows of a batch of postings, and words of documents that are put in order together.  A task writes its own
#: documents' part of each bucket: postings are not moved, and a word that all documents have is not one task's.  The bucket
#: after the last has a row for each document, until they are in a table of their own.
BUCKETS, BATCH_ROWS, BATCH_WORDS = 64, 1 << 16, 1 << 20


def _bucket(word: Column) -> Column:
    return F.when(word.isNull(), BUCKETS).otherwise(F.pmod(F.xxhash64(word), F.lit(BUCKETS))).cast("int")


def _files(spark: SparkSession, path: str):
    """A folder and the file system that it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the index, or None before the first batch."""
    files, folder = _files(spark, f"{path}/{name}")
    if not files.exists(folder):
        return None
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, id, at) of documents (id, version, words): a row for each word of some documents, in order, with where it stands
    in each; and for each document a row without a word, with its number of words and its version."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
        own = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(lengths) + 1, 2), pa.int32()), _between(pa.array(lengths, pa.int32()), batch.column(1)))
        yield _rows(pa.nulls(len(lengths), pa.string()), np.arange(len(lengths) + 1), batch.column(0), own)
        groups = np.cumsum(lengths) // BATCH_WORDS
        for first, size in zip(*(x.tolist() for x in np.unique(groups, return_index=True, return_counts=True)[1:])):
            rows = _inverted(batch.slice(first, size), lengths[first : first + size])
            for i in range(0, len(rows), BATCH_ROWS):
                yield rows.slice(i, BATCH_ROWS)


def _between(a: pa.Array, b: pa.Array) -> pa.Array:
    """The values of two arrays by turns."""
    return pa.concat_arrays([a, b]).take(pa.array(np.arange(2 * len(a)).reshape(2, -1).T.ravel()))


def _rows(words: pa.Array, offsets: np.ndarray, ids: pa.Array, places: pa.Array) -> pa.RecordBatch:
    """Rows of words; the ids and places of each lie between two offsets."""
    offsets = pa.array(offsets, pa.int32())
    return pa.record_batch([words, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, places)], names=["word", "id", "at"])


def _inverted(batch: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch:
    """The postings of some documents, in order of word and document, a row for each word."""
    coded = batch.column(2).flatten().dictionary_encode()
    n = max(len(coded), 1)
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    # the words of documents follow each other, so a word's places are in order of document and position
    order = np.sort(rank[coded.indices.to_numpy()] * n + np.arange(len(coded))) % n
    docs = np.repeat(np.arange(len(lengths)), lengths)
    places = (np.arange(len(coded)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)[order]
    docs, codes = docs[order], coded.indices.to_numpy()[order]
    heads = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(docs, prepend=-1) != 0))
    at = pa.ListArray.from_arrays(pa.array(np.append(heads, len(coded)), pa.int32()), pa.array(places, pa.int32()))
    first = np.flatnonzero(np.diff(codes[heads], prepend=-1) != 0)
    return _rows(coded.dictionary.take(pa.array(codes[heads][first])), np.append(first, len(heads)), batch.column(0).take(pa.array(docs[heads])), at)


def _write_postings(rows: DataFrame, target: str, *order: str) -> None:
    """Rows of postings by bucket, each task's own in the order that they have or in a given one."""
    rows.select("bucket", "word", "id", "at").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(target)


def _last_batch(spark: SparkSession, path: str) -> int:
    totals = _table(spark, path, "totals")
    return totals.agg(F.max("batch")).first()[0] if totals is not None else 0


def index_documents(docs: DataFrame, path: str, text: str = "text", id_col: str = "id", batch: int | None = None) -> int:
    """Add documents to the index at ``path``, or replace those whose id it has; returns the batch's number.

    ``docs``: an id, a text and, if there are versions, ``version``.  Null ids are left out, null texts have no words; of
    rows with equal ids the one with the largest text counts.  A batch that failed half-way is written again under its
    number (the last one's plus one), so no word counts twice.
    """
    spark = docs.sparkSession
    number = batch or _last_batch(spark, path) + 1
    version = F.col("version").cast("int") if "version" in docs.columns else F.lit(None).cast("int")
    one = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), version.alias("version"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    single = single_rows(one, "id")
    if single is None:
        single = one.groupBy("id").agg(F.max(F.struct("text", "version")).alias("d")).select("id", "d.*")
    words, kind, target = single.select("id", "version", folded_words(F.col("text")).alias("words")), dict(one.dtypes)["id"], f"{path}/postings/batch={number}"
    _write_postings(words.mapInArrow(_posted, f"word string, id array<{kind}>, at array<array<int>>").withColumn("bucket", _bucket(F.col("word"))), target)
    said = spark.read.schema(f"bucket int, word string, id array<{kind}>, at array<array<int>>").parquet(target).where(F.col("bucket") == BUCKETS)
    own = said.select(F.col("id")[0].alias("id"), F.col("at")[0][1].alias("version"), F.col("at")[0][0].alias("n"))
    own.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
    files, folder = _files(spark, f"{target}/bucket={BUCKETS}")
    files.delete(folder, True)
    fresh = spark.read.parquet(f"{path}/documents/batch={number}")
    before = _current(spark, path, number)
    gone = before.join(fresh.select("id"), "id", "left_semi").select(-F.lit(1).alias("d"), (-F.col("n")).alias("w"))
    totals = fresh.select(F.lit(1).alias("d"), F.col("n").alias("w")).unionByName(gone.toDF("d", "w")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("docs"), F.coalesce(F.sum("w"), F.lit(0)).alias("words"))
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/batch={number}")  # the batch is complete with its totals
    return number


def _current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The documents that count (id, batch, version, n), in batches ``below`` a number or in all complete ones."""
    last = below - 1 if below is not None else _last_batch(spark, path)
    rows = _table(spark, path, "documents").where(F.col("batch") <= last)
    return rows.groupBy("id").agg(F.max_by(F.struct("batch", "version", "n"), "batch").alias("d")).select("id", "d.*")


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """Write the index at ``path`` to ``target`` as one batch, without the words of replaced documents.  A batch of which every
    document counts, or none, is kept or left out as a whole; only the postings of others meet the documents."""
    now = _current(spark, path)
    held = _table(spark, path, "documents").groupBy("batch").agg(F.count("*").alias("n"))
    live = now.groupBy("batch").agg(F.count("*").alias("live"))
    batches = held.join(live, "batch").collect()  # a row for each batch
    postings = _table(spark, path, "postings").where(F.col("bucket") < BUCKETS)  # a batch that failed has its documents there
    whole = postings.where(F.col("batch").isin([r["batch"] for r in batches if r["live"] == r["n"]]))
    mixed = postings.where(F.col("batch").isin([r["batch"] for r in batches if r["live"] < r["n"]]))
    single = mixed.select("batch", "bucket", "word", F.inline(F.arrays_zip("id", "at"))).join(now.select("id", "batch"), ["id", "batch"], "left_semi")
    kept = whole.select("bucket", "word", "id", "at").unionByName(single.select("bucket", "word", F.array("id").alias("id"), F.array("at").alias("at")))
    _write_postings(kept, f"{target}/postings/batch=1", "word")
    now.select("id", "version", "n").write.parquet(f"{target}/documents/batch=1")
    now.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).coalesce(1).write.parquet(f"{target}/totals/batch=1")


def _shifted(places: Column, n: int) -> Column:
    """Where a phrase would start whose n-th word is at these places."""
    return F.transform(places, lambda x: x - n) if n else places


def found_in(spark: SparkSession, path: str, phrases: list[list[str]]) -> DataFrame:
    """(id, version, n, f0, f1, ...): how often each phrase occurs in the documents that have any of their words.

    Reads the postings of the phrases' words alone; a phrase occurs where its words' positions follow each other.
    """
    words = sorted({w for p in phrases for w in p})
    buckets = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"))).collect()})  # the query's own
    read = _table(spark, path, "postings").where(F.col("bucket").isin(buckets) & F.col("word").isin(words))
    live = read.select("batch", "word", F.inline(F.arrays_zip("id", "at"))).join(_current(spark, path), ["id", "batch"])
    places = [F.coalesce(F.max(F.when(F.col("word") == w, F.col("at"))), F.array().cast("array<int>")).alias(f"__w{i}") for i, w in enumerate(words)]
    rows = live.groupBy("id", "version", "n").agg(*places)
    counted = []
    for i, phrase in enumerate(phrases):
        starts = [_shifted(F.col(f"__w{words.index(w)}"), n) for n, w in enumerate(phrase)]
        counted.append(F.size(reduce(F.array_intersect, starts)).alias(f"f{i}"))
    return rows.select("id", "version", "n", *counted)


def indexed_search(spark: SparkSession, path: str, query: str, limit: int = 50, offset: int = 0, version: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The documents of the index that have every part of a query, by BM25: (id, score), as ``search.lexical_search`` gives
    them for the texts themselves."""
    phrases = query_phrases(query)
    totals = _table(spark, path, "totals")
    if not phrases or totals is None:
        documents = _table(spark, path, "documents")
        kind = dict(documents.dtypes)["id"] if documents is not None else "long"
        return spark.createDataFrame([], f"id {kind}, score double")
    names = [f"f{i}" for i in range(len(phrases))]
    counted = found_in(spark, path, phrases)
    corpus = totals.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("mean"))
    holding = counted.agg(*[F.count(F.when(F.col(f) > 0, 1)).alias(f"{f}_docs") for f in names])
    hits = counted.where(reduce(Column.__and__, [F.col(f) > 0 for f in names]))
    if version is not None:
        hits = hits.where(F.col("version") == version)
    joined = hits.crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(holding))  # one row each
    score = F.lit(0.0)
    for f in names:
        weight = F.log((F.col("docs") - F.col(f"{f}_docs") + 0.5) / (F.col(f"{f}_docs") + 0.5) + 1)
        score = score + weight * F.col(f) * (k1 + 1) / (F.col(f) + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.select("id", score.alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(limit)
