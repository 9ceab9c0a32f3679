"""Token ids of a corpus in Arrow files of equal-length sequences.

`write_token_files` deals the documents into ranges of doc_id, encodes each
whole text, appends an end id to each document and writes a pair of Arrow IPC
files for each range: `ids-*`, record batches of fixed-size lists (ids, and masks
by number from the file's dictionary of all masks),
all batches but the last with equally many sequences, so sequence i lies at a
computable place and can be read from a memory map without a copy; and
`docs-*`, where each document begins in its file and how many ids it has. Only
files that the returned manifest names are valid: a task that ran twice leaves
an unnamed file, never a wrong one.

Cases: a null or empty text has the end id alone; a null doc_id sorts first;
repeated rows are documents of their own, in a fixed order within a doc_id;
an empty table has an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsight.llm import tokens
from logsight.llm.common import materialize, new_path, partitions, small_batches

MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_ids long, n_sequences long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int32(), pa.list_(pa.uint8(), length)))])


@functools.cache
def masks(length: int) -> pa.FixedSizeListArray:
    """All masks that there are: number n has n ones, then zeros. A file holds them once, as the dictionary of its mask column."""
    return pa.FixedSizeListArray.from_arrays(pa.array(np.tril(np.ones((length + 1, length), np.uint8), -1).reshape(-1)), length)


class _Writer:
    """Collects ids and writes a batch whenever it is full."""

    def __init__(self, folder: str, part: int, length: int, per_batch: int, kind: pa.DataType):
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}.arrow"
        self.ids_file, self.docs_file = f"{folder}/ids-{name}", f"{folder}/docs-{name}"
        self.length, self.per_batch, self.kind = length, per_batch, kind
        self.out = [system.open_output_stream(f"{at}/{k}-{name}") for k in ("ids", "docs")]
        self.schema = sequence_schema(length, kind)
        self.sequences = pa.ipc.new_file(self.out[0], self.schema)
        self.docs = pa.ipc.new_file(self.out[1], _DOCS)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = self.n_sequences = 0

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64(), from_pandas=True), pa.array(starts), pa.array(sizes)], schema=_DOCS))
        self.n_docs += len(ids)
        self.n_ids += int(sizes.sum())
        self.held += ids
        self.n_held += int(sizes.sum())
        if self.n_held >= self.length * self.per_batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        step = self.length * self.per_batch
        whole = len(flat) // step * step
        for i in range(0, whole, step):
            self._batch(flat[i : i + step], step)
        rest = flat[whole:]
        self.held, self.n_held = [rest], len(rest)
        if last and len(rest):
            self._batch(rest, -(-len(rest) // self.length) * self.length)

    def _batch(self, flat: np.ndarray, size: int) -> None:
        values = np.zeros(size, self.kind.to_pandas_dtype())
        values[: len(flat)] = flat
        valid = np.clip(len(flat) - np.arange(0, size, self.length), 0, self.length).astype(np.int32)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(values), self.length), pa.DictionaryArray.from_arrays(pa.array(valid), masks(self.length))]
        self.sequences.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += size // self.length

    def close(self) -> tuple:
        self._flush(True)
        for x in (self.sequences, self.docs, *self.out):
            x.close()
        return self.ids_file, self.docs_file, self.n_docs, self.n_ids, self.n_sequences


def write_token_files(
    documents: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end_id: int = 0, length: int = 1024, per_batch: int = 256, id_bits: int = 16
) -> DataFrame:
    """Write the files and return the manifest. id_bits: 16 for vocabularies of up to 65,536 ids, else 32. length: a multiple of 8."""
    if length % 8 or id_bits not in (16, 32):
        raise ValueError("length must be a multiple of 8 and id_bits 16 or 32")
    spark = documents.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    path = tokenizer_path or tokens.default_path()
    ranged = (
        documents.select(F.col("doc_id").cast("long"), "text")
        .withColumn("mix", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))  # deals the rows of one doc_id
        .repartitionByRange(partitions(spark), "doc_id", "mix")
        .sortWithinPartitions("doc_id", "mix", "text")
        .drop("mix")
        .withColumn("part", F.spark_partition_id())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, out, part = tokens.encoder(path), np.array([end_id], np.uint32), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                out = _Writer(folder, part, length, per_batch, pa.uint16() if id_bits == 16 else pa.uint32())
            ids = encoder.encode_many(batch.column("text").to_pylist())
            if id_bits == 16 and max((int(x.max()) for x in ids if len(x)), default=0) > 65_535:
                raise ValueError("the vocabulary needs id_bits=32")
            ids = [np.concatenate([x, end]) for x in ids]
            out.add(batch.column("doc_id").to_pylist(), ids)
        if out is not None:
            row = (part, *out.close())
            names = ["part", "ids_file", "docs_file", "n_docs", "n_ids", "n_sequences"]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return materialize(ranged.mapInArrow(write, MANIFEST), "op2-manifest")


def open_file(uri: str) -> pa.ipc.RecordBatchFileReader:
    """Open one Arrow file; a local one through a memory map, so that batches are views of it."""
    from pyarrow import fs

    system, at = file_system(uri)
    return pa.ipc.open_file(pa.memory_map(at) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(at))


def sequence_at(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask (1 or 0 a place) of sequence i, both views of the file."""
    per = reader.get_batch(0).num_rows
    batch = reader.get_batch(i // per)
    mask = batch.column("mask")
    own = mask.dictionary.slice(mask.indices[i % per].as_py(), 1).flatten()
    return batch.column("ids")[i % per].values.to_numpy(zero_copy_only=True), own.to_numpy(zero_copy_only=True)


def read_token_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its first sequence."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _read_pair(row["part"], row["ids_file"], row["docs_file"])

    each = manifest.repartition(max(1, partitions(spark))).mapInArrow(read, "part int, doc_id long, local long, n_tokens long, ids_crc32 long, first_sequence long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return each.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "first_sequence")


def _read_pair(part: int, ids_file: str, docs_file: str) -> Iterator[pa.RecordBatch]:
    sequences, docs = open_file(ids_file), open_file(docs_file)
    length = sequences.schema.field("ids").type.list_size
    held, begins, at = np.zeros(0, np.uint16), 0, 0  # held: the ids from `begins` on
    for k in range(docs.num_record_batches):
        index = docs.get_batch(k)
        starts, sizes = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
        crcs = np.zeros(len(starts), np.int64)
        for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
            if begins + len(held) < start + size:
                parts = [held[start - begins :]]
                got = len(parts[0])
                while got < size:
                    batch = sequences.get_batch(at)
                    at += 1
                    ids = batch.column("ids").flatten()
                    valid = int(batch.column("mask").indices.to_numpy().sum())  # a mask's number is its ones
                    parts.append(ids.to_numpy(zero_copy_only=True)[:valid])
                    got += valid
                held, begins = np.concatenate(parts), start
            one = held[start - begins : start - begins + size]
            crcs[i] = zlib.crc32(one.astype("<u4").tobytes())
        columns = [pa.array(np.full(len(starts), part, np.int32)), index.column("doc_id"), *map(pa.array, (starts, sizes, crcs, starts // length))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local", "n_tokens", "ids_crc32", "first_sequence"])
