"""Operator 5: token ids in Arrow stream files of equal-length sequences.

Documents are sorted by id across partitions; each task encodes its range and writes one shard: an Arrow file whose
record batches hold fixed-size lists of ids and of mask bits, and an index file with each document's place.  Batches
all hold the same number of sequences, so sequence i lies in batch i // rows at row i % rows; a reader maps the file
and slices ids and mask bits without copying.  Only the last sequence of a shard is padded, where its mask is false.

A task may run twice.  Every attempt writes under its own name, and only the attempt whose row reaches the manifest is
read; files of lost attempts are never looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm import chunks
from vitrine.llm.common import scratch_path, shuffle_width, whole_text, written

#: Sequences in a record batch.
BATCH_SEQUENCES = 128


class ShardWriter:
    """Writes one shard's sequences and its index."""

    def __init__(self, folder: str, name: str, length: int, dtype: str):
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        self.length, self.dtype = length, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self.sinks = [files.open_output_stream(f"{root}/{name}{kind}") for kind in (".arrow", ".index.arrow")]
        self.body = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = self.docs = 0

    def add(self, keys: list, ids: list[bytes]) -> None:
        sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.record_batch([pa.array(keys, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(self.dtype)
        self.parts.append(flat)
        self.held += len(flat)
        self.total += len(flat)
        self.docs += len(keys)
        if self.held >= BATCH_SEQUENCES * self.length:
            self._write(final=False)

    def _write(self, final: bool) -> None:
        flat, block = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype), BATCH_SEQUENCES * self.length
        at = 0
        while len(flat) - at >= block or final and at < len(flat):
            part = flat[at : at + block]
            at += len(part)
            real = np.ones(-(-len(part) // self.length) * self.length, dtype=bool)
            real[len(part) :] = False
            padded = np.zeros(len(real), self.dtype)
            padded[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, real)]
            self.body.write_batch(pa.record_batch(lists, schema=self.schema))
        self.parts, self.held = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._write(final=True)
        for x in (self.body, self.index, *self.sinks):
            x.close()


class ShardReader:
    """Random access to the sequences of one shard; a local file is mapped, not read."""

    def __init__(self, folder: str, name: str):
        files, root = pafs.FileSystem.from_uri(folder)
        self.open = (lambda p: pa.memory_map(p)) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file
        self.body = pa.ipc.open_file(self.open(f"{root}/{name}.arrow"))
        self.index = pa.ipc.open_file(self.open(f"{root}/{name}.index.arrow"))
        self.length = self.body.schema.field("ids").type.list_size
        self.block = BATCH_SEQUENCES * self.length
        self.at, self.batch = -1, None

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.at:
            self.at, self.batch = i, self.body.get_batch(i)
        return self.batch

    def views(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence i and the bits of its mask, the lowest bit of a byte first; both are views of the file.  A
        sequence's length must be a multiple of eight for its bits to begin with a byte."""
        if self.length % 8:
            raise ValueError("masks of this length do not begin with a byte")
        batch, row = self._batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        bits = batch.column(1).values
        first = (bits.offset + row * self.length) // 8
        ids = batch.column(0).values.to_numpy()[row * self.length : (row + 1) * self.length]
        return ids, np.frombuffer(bits.buffers()[1], dtype=np.uint8)[first : first + self.length // 8]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sequence i (a view of the file) and its mask as booleans, made from the file's bits."""
        batch, row = self._batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
        part = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).values.to_numpy()[part], batch.column(1).values[part].to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> bytes:
        """Ids ``start`` to ``start + n`` of the shard's real ids, as little-endian unsigned 32-bit integers."""
        parts, end = [], start + n
        while start < end:
            i, inside = divmod(start, self.block)
            take = min(end - start, self.block - inside)
            parts.append(self._batch(i).column(0).values.to_numpy()[inside : inside + take].astype("<u4").tobytes())
            start += take
        return b"".join(parts)


def write_sequences(
    docs: DataFrame,
    path: str,
    folder: str | None = None,
    length: int = 2048,
    end_id: int = 2,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode whole texts in ascending id order into Arrow files below ``folder``; returns the manifest.

    The manifest has one row per shard that holds documents: (shard, name, docs, ids, base, folder); ``base`` counts the
    ids of all shards before.  ``folder`` is an address that pyarrow can open on every executor, by default a new folder
    in the shared one.  A null or empty text is the end id alone.  Rows without an id come first; rows with the same id
    follow each other in the order of their text's hash.  An empty table gives an empty manifest and no files.  Ids take
    two bytes where the vocabulary allows it.  Columns other than id and text are not carried.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "sequences")
    shards = shards or shuffle_width(spark)
    end = np.array([end_id], dtype="<u4").tobytes()
    kept = docs.select(F.col(id_col).cast("long").alias("__id"), whole_text(text_col).alias("__text"))
    kept = kept.withColumn("__tie", F.xxhash64("__text"))
    ranged = kept.repartitionByRange(shards, "__id", "__tie").sortWithinPartitions("__id", "__tie").select("__id", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = chunks.library_encoder(path), None
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks.pieces(texts):
                if writer is None:
                    writer = ShardWriter(folder, name, length, "uint16" if chunks.vocabulary_size(path) <= 65536 else "uint32")
                writer.add(keys[a:b], [x + end for x in encoder.encode(texts[a:b])])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "docs": [writer.docs], "ids": [writer.total]})

    manifest, _ = written(ranged.mapInArrow(run, "shard long, name string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("ids").over(before), F.lit(0))
    return manifest.withColumn("base", base).withColumn("folder", F.lit(folder))


def read_documents(manifest: DataFrame, shards: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Read the files of a manifest back: (id, start, ids), one row per document in the files' order.

    ``start`` counts the ids of all documents before, ``ids`` are little-endian unsigned 32-bit integers with the end
    id.  An empty manifest gives no rows.
    """
    shards = shards or shuffle_width(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["folder"], row["name"])
                for i in range(reader.index.num_record_batches):
                    places = reader.index.get_batch(i)
                    starts, sizes = places.column(1).to_numpy(), places.column(2).to_numpy()
                    ids = [reader.span(s, n) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.record_batch([places.column(0), pa.array(starts + row["base"]), pa.array(ids, pa.binary())], names=[id_col, "start", "ids"])

    placed = manifest.select("shard", "name", "base", "folder").repartitionById(shards, F.col("shard").cast("int"))
    return placed.mapInArrow(run, f"`{id_col}` long, start long, ids binary")
