"""Token ids of documents in binary shard files: one shared zstandard dictionary, one frame for each document.

A shard is three files in one folder, named by shard number: `.bin` (the frames, one after the other), `.idx` (for each
document its id, the place and length of its frame and its number of ids, as little-endian 64-bit integers, in ascending
document order) and a line in the manifest, which holds the dictionary's hash. The dictionary is a file of its own. A short
document is read by one look-up in `.idx`, one seek in `.bin` and one small frame to expand.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, fresh_path, map_in_arrow, write_table
from .tokens import ids_of

#: Documents, at most about, whose ids the dictionary is trained on, dealt evenly over all by a hash of the id; and its size.
DICTIONARY_DOCS, DICTIONARY_BYTES, LEVEL = 600, 64 << 10, 3
#: Compressed bytes that a shard holds, about.
SHARD_BYTES = 32 << 20
#: Stands in the index for a null doc_id; Spark sorts nulls first, where the least number belongs.
NO_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("at", "<i8"), ("size", "<i8"), ("n_tokens", "<i8")])


def with_end(text: str | None, tokenizer: str, end_id: int) -> bytes:
    return ids_of(tokenizer)(text) + int(end_id).to_bytes(4, "little")


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary of a bounded sample's serialized ids; of too few ids, the ids themselves (possibly none)."""
    spark = docs.sparkSession
    n = docs.count()
    part = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(min(1.0, DICTIONARY_DOCS / max(n, 1)) * (1 << 20)) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([with_end(t.as_py(), tokenizer, end_id) for t in b.column(0)], pa.binary())], ["ids"])

    rows = map_in_arrow(docs.where(part).select("text").limit(4 * DICTIONARY_DOCS), encode, "ids binary").collect()
    samples = sorted(bytes(r.ids)[i : i + 4096] for r in rows for i in range(0, len(r.ids), 4096))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[:DICTIONARY_BYTES]


@lru_cache(maxsize=2)
def _codec(dictionary: bytes) -> tuple:
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    """All or nothing: a task that is tried again, or twice at once, leaves the same file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, path)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode and store `docs` (doc_id, text; other columns are left alone). Gives the manifest: a row for each shard.

    Null texts count as empty; every document gets end_id. Rows that repeat a doc_id, or have none, are stored each. No rows:
    no shards.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    _put(store, f"{root}/{digest}.dict", dictionary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _codec(dictionary)[0].compress
        for b in batches:
            ids = [with_end(t, tokenizer, end_id) for t in b.column(1).to_pylist()]
            frames = pa.array([compress(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), frames], ["doc_id", "n_tokens", "frame"])

    frames = write_table(map_in_arrow(docs, encode, "doc_id long, n_tokens long, frame binary"), "frames")
    size = frames.agg(F.coalesce(F.sum(F.length("frame")), F.lit(0))).first()[0]
    ordered = frames.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc_id").sortWithinPartitions("doc_id")

    def store_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():08d}"
        index, at, own = [], 0, f"{root}/{name}.bin.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for b in batches:
                for doc, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    data = frame.as_buffer()
                    out.write(data)
                    index.append((NO_ID if doc is None else doc, at, data.size, n))
                    at += data.size
        if not index:
            store.delete_file(own)
            return
        rows = np.array(index, INDEX)
        _put(store, f"{root}/{name}.idx", rows.tobytes())
        store.move(own, f"{root}/{name}.bin")
        yield pa.RecordBatch.from_pydict({"shard": [name], "docs": [len(rows)], "tokens": [int(rows["n_tokens"].sum())], "bytes": [at], "first_doc": [int(rows["doc_id"][0])], "dictionary": [digest]})

    shards = write_table(map_in_arrow(ordered, store_shard, "shard string, docs long, tokens long, bytes long, first_doc long, dictionary string"), "manifest")
    drop_table(frames)
    # One row for each shard of SHARD_BYTES, so one task can add them up.
    before = Window.orderBy("first_doc", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _open(folder: str, shard: str, digest: str):
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{digest}.dict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"{digest}.dict isn't the dictionary that shard {shard} was written with")
    with store.open_input_file(f"{root}/{shard}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    return store.open_input_file(f"{root}/{shard}.bin"), index, _codec(dictionary)[1]


def read_shards(manifest: DataFrame, folder: str, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, from the files; ids are little-endian unsigned 32-bit integers."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                file, index, codec = _open(folder, row["shard"], row["dictionary"])
                starts = row["start"] + np.concatenate(([0], np.cumsum(index["n_tokens"])[:-1]))
                with file:
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(index["at"], index["at"][i] + block_bytes)))
                        data = memoryview(file.read(int(index["at"][j - 1] + index["size"][j - 1] - index["at"][i])))
                        base = index["at"][i]
                        ids = [codec.decompress(data[a - base : a - base + s]) for a, s in zip(index["at"][i:j], index["size"][i:j])]
                        yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"][i:j], mask=index["doc_id"][i:j] == NO_ID), pa.array(starts[i:j]), pa.array(index["n_tokens"][i:j]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        i = j

    n = max(1, manifest.count())
    return manifest.select("shard", "dictionary", "start").repartition(n, "shard").mapInArrow(expand, "doc_id long, start long, n_tokens long, ids binary")


def read_document(manifest: DataFrame, folder: str, doc_id: int) -> list[int] | None:
    """The ids of one document, by its shard's index; None if there is no such document."""
    row = manifest.where(F.col("first_doc") <= doc_id).orderBy(F.desc("first_doc"), F.desc("shard")).first()
    if row is None:
        return None
    file, index, codec = _open(folder, row.shard, row.dictionary)
    at = int(np.searchsorted(index["doc_id"], doc_id))
    with file:
        if at == len(index) or index["doc_id"][at] != doc_id:
            return None
        file.seek(int(index["at"][at]))
        return np.frombuffer(codec.decompress(file.read(int(index["size"][at]))), "<u4").tolist()


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents and read them back: (doc_id, start, n_tokens, ids)."""
    folder = fresh_path(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, folder, tokenizer, end_id), folder)
