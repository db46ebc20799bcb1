"""Documents as token ids in sorted-string tables, and reading them back by scan or by key.

A file holds documents in ascending order of key. Layout, all numbers little-endian unless said otherwise:

* blocks of at most about ``BLOCK_BYTES``: for each document a varint of the bytes its key shares with the
  key before it in the block, a varint of the key's other bytes, these bytes, a varint of the number of ids,
  and the ids (2 bytes each, or 4 if the file's ``width`` says so); then the CRC-32 of the block;
* the sparse index: for each block its last key, offset and length;
* the Bloom filter: bits that ``HASHES`` double-hashed probes of each key set;
* the footer of fixed size: offsets of index and filter, counts, first and last key, width, and a magic word.

A key is the 64-bit identifier with its sign bit flipped, big-endian, so bytes sort like numbers; a document without an
identifier has the empty key, before all others.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import forward_asof
from .arrow import batch_of, row_groups
from .encoder import default_tokenizer, encoder
from .shared import bounded_batches, fresh_path, saved

MAGIC = b"SLTOKTB1"
BLOCK_BYTES = 64 << 10
FILE_BYTES = 8 << 20
BLOOM_BITS, HASHES = 10, 7
#: About how many ids a lookup sends at once.
IDS_SENT = 1 << 18
FOOTER = struct.Struct("<QQQQQ8s8sB7x8s")
INDEX_ENTRY = struct.Struct("<8sQI")


def key_bytes(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_number(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """For each key the bits of the filter that it sets: ``a + i b`` from two CRCs of it."""
    a = np.array([zlib.crc32(k) for k in keys], np.int64)[:, None]
    b = np.array([zlib.crc32(k, 0x5BD1E995) | 1 for k in keys], np.int64)[:, None]
    return (a + np.arange(HASHES) * b) % bits


class TableWriter:
    """Builds one file in memory; ``width`` is 2 or 4 bytes for an id."""

    def __init__(self, width: int = 2, block_bytes: int | None = None):
        self.width, self.blocks, self.index, self.keys = width, [], [], []
        self.most = BLOCK_BYTES if block_bytes is None else block_bytes
        self.block, self.last, self.size, self.tokens = [], b"", 0, 0
        self.block_bytes = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_bytes(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix((key, self.last))) if self.block else 0
        entry = varint(shared) + varint(len(key) - shared) + key[shared:] + varint(len(ids)) + ids.astype(f"<u{self.width}", copy=False).tobytes()
        self.block.append(entry)
        self.block_bytes += len(entry)
        self.keys.append(key)
        self.last, self.tokens = key, self.tokens + len(ids)
        if self.block_bytes >= self.most:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = b"".join(self.block)
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append(INDEX_ENTRY.pack(self.last, self.size, len(data)))
            self.blocks.append(data)
            self.size += len(data)
            self.block, self.block_bytes = [], 0

    def bytes(self) -> bytes:
        self.end_block()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        marked = np.zeros((bits + 7) // 8 * 8, np.uint8)
        if named := [k for k in self.keys if k]:
            marked[probes(named, bits).ravel()] = 1
        bloom = np.packbits(marked, bitorder="little").tobytes()
        first, last = (self.keys[0], self.keys[-1]) if self.keys else (bytes(8), bytes(8))
        footer = FOOTER.pack(self.size, len(index), bits, len(self.keys), self.tokens, first, last, self.width, MAGIC)
        return b"".join([*self.blocks, index, bloom, footer])


class TableReader:
    """Reads a file by ranges: footer, index and filter at once, blocks when asked for."""

    def __init__(self, path: str):
        system, inner = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        footer = self.file.read_at(FOOTER.size, size - FOOTER.size)
        self.data_size, index_size, self.bits, self.count, self.tokens, self.first, self.last, self.width, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token table")
        rest = self.file.read_at(size - FOOTER.size - self.data_size, self.data_size)
        self.index = [INDEX_ENTRY.unpack_from(rest, i) for i in range(0, index_size, INDEX_ENTRY.size)]
        self.bloom = rest[index_size:]

    def block(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        _, offset, length = self.index[i]
        data = self.file.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        at, key, end = 0, b"", len(data) - 4
        while at < end:
            shared, at = read_varint(data, at)
            other, at = read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            n, at = read_varint(data, at + other)
            yield key_number(key), np.frombuffer(data, f"<u{self.width}", n, at)
            at += n * self.width

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, or None."""
        return next(self.find(doc_id), None)

    def find(self, doc_id: int) -> Iterator[np.ndarray]:
        """The ids of each document of this key: filter, then binary search in the index, then the block or blocks."""
        key = key_bytes(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes([key], self.bits)[0].tolist()):
            return
        i = bisect_left(self.index, key, key=lambda e: e[0])
        while i < len(self.index):
            for found, ids in self.block(i):
                if found == doc_id:
                    yield ids
            if self.index[i][0] != key:
                break
            i += 1  # repeated keys, or a block that ends with documents without an identifier, whose last key reads as the least


MANIFEST = "path string, part int, file int, n_docs long, n_tokens long, first_id long, last_id long"


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every document, appends ``end_id`` and writes files in key order; returns the manifest.

    Null texts have the end id alone. Rows that share a key are all kept, ordered by text. Rows without a key come first, are
    read back by scans and can't be looked up. An empty table gives no files. A task that is run again writes files of new names; only those of
    the attempt that ended are in the manifest, which is itself saved in the shared folder.
    """
    # settings go to the tasks with the function
    file_bytes, block_bytes = FILE_BYTES, BLOCK_BYTES

    def write(batches):
        context = TaskContext.get()
        words = encoder(tokenizer)
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        width = 2 if words.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
        writer, file, done = TableWriter(width, block_bytes), 0, []

        def close():
            nonlocal writer, file
            if writer.keys:
                name = f"tokens-{part:06d}-{file:05d}-{attempt}.slt"
                with system.open_output_stream(f"{inner}/{name}") as out:
                    out.write(writer.bytes())
                done.append((f"{folder}/{name}", part, file, len(writer.keys), writer.tokens, key_number(writer.keys[0]), key_number(writer.keys[-1])))
            writer, file = TableWriter(width, block_bytes), file + 1

        for batch in row_groups(batches, "text", 1 << 20):
            ids, bounds = words.encode_column(batch.column("text"), end_id)
            ids, bounds = ids.astype(f"<u{width}"), bounds.tolist()
            for k, a, b in zip(batch.column("key").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                writer.add(k, ids[a:b])
                if writer.size >= file_bytes:
                    close()
        close()
        names = ["path", "part", "file", "n_docs", "n_tokens", "first_id", "last_id"]
        if done:
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield batch_of(**{n: pa.array(x, t) for n, t, x in zip(names, types, zip(*done, strict=True), strict=True)})

    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = keyed.repartitionByRange("key").sortWithinPartitions("key", "text")
    return saved(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_tables(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all documents before it."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out = []
                for doc_id, ids in TableReader(path).scan():
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield batch_of(**{n: pa.array(x, pa.int64()) for n, x in zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*out, strict=True), strict=True)})

    # a row for each file of some megabytes: the running sum over them is short
    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of the documents that ``keys`` names: a row for each document of such a key, none for keys that no file has.

    Repeated keys count once and null keys find nothing. The manifest says which file a key falls in; a task opens each of its files once and
    goes by filter, index and block. A file holds some megabytes, so even a table whose keys are all asked for makes no large task.
    """
    sent = IDS_SENT

    def read(batches):
        path = reader = None
        found: list[tuple[int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for p, k in zip(batch.column("path").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if p != path:
                    path, reader = p, TableReader(p)
                for ids in reader.find(k):
                    found.append((k, ids))
                    size += len(ids)
                    if size >= sent:
                        yield looked_up(found)
                        found, size = [], 0
        if found:
            yield looked_up(found)

    wanted = keys.select(F.col(key).cast("long").alias("at")).where("at IS NOT NULL").distinct()
    files = manifest.where("last_id IS NOT NULL").select(F.col("last_id").alias("at"), "part", "file", "path", "first_id")
    first = forward_asof(wanted, files, "at", ["part", "file", "path", "first_id"]).where("r_at >= at AND (r_first_id IS NULL OR r_first_id <= at)")
    # a key with many documents may go on in the next files, which then begin with it
    more = wanted.join(files.select(F.col("first_id").alias("at"), "path"), "at")
    places = first.select("at", F.col("r_path").alias("path")).unionByName(more).distinct().withColumnRenamed("at", "doc_id")
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(tasks, "path").sortWithinPartitions("path", "doc_id").mapInArrow(read, "doc_id long, ids array<int>")


def looked_up(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    bounds = np.cumsum([0, *(len(ids) for _, ids in found)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([ids for _, ids in found]).astype(np.int32)))
    return batch_of(doc_id=pa.array([k for k, _ in found], pa.int64()), ids=ids)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_tables(write_tables(docs, fresh_path(spark, "token-tables"), default_tokenizer(), end_id=0))
