"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier, in blocks of about 64 KB:

    block     entries, compressed with zstd. An entry is the number of key bytes shared with the key
              before it (1 byte), the number of other key bytes (1 byte), the length of the value (4 bytes,
              little-endian), the other key bytes, and the value: ids as little-endian uint32
    index     one entry per block: last key of the block, offset, stored length, raw length
    filter    Bloom filter over identifiers
    footer    offsets and lengths of index and filter, number of documents and of ids, crc32 of index
              and filter, magic

A key is 13 bytes: 0 for a null identifier or 1, the identifier as a big-endian integer with its sign
bit turned, so that bytes sort as numbers do, and a big-endian count among rows of the same identifier.
A lookup tests the filter, finds the block by binary search in the index, and reads that block alone.

Documents are put in order by a range shuffle of their texts, encoded where they then lie, and streamed
to one shard per partition; rows of one identifier may fill many shards, cut by the checksum of the text and by
the part of the input they come from, so an identifier that holds a third of all rows is no single task. Shards go
to a file under a name of the attempt, which is then moved, so a task that runs twice leaves one
whole file. The folder must be one that all executors share.

Defined results: a null text counts as empty (end id alone); rows with null identifiers come first;
rows that share an identifier lie side by side, in order of the checksum of their texts, each with its own count
in the key (from 0 in each shard), and a lookup asks all shards that may hold them and returns them all; an empty table gives an empty set of shards.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, id_encoder, materialize, scratch, slim, table

MAGIC = b"PSST0001"
BLOCK_BYTES = 64 * 1024
BITS_A_KEY, HASHES = 10, 7
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<QII")
_SHARDS = "shard int, path string, n_docs long, n_ids long"
_FOOTER = struct.Struct("<QIQIQQI8s")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def key_of(doc_id: int | None, count: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + 2**63 if doc_id is not None else 0, count)


def id_of(key: bytes) -> int | None:
    there, n, _ = struct.unpack(">BQI", key)
    return n - 2**63 if there else None


def _codec():
    import pyarrow as pa

    return pa.Codec("zstd")


def _places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x9E3779B9) | 1
    return [(a + k * b) % bits for k in range(HASHES)]


class Writer:
    """Writes (key, value) in ascending order of key to a binary stream; holds one block at a time."""

    def __init__(self, out):
        self.out, self.at, self.block, self.size, self.last = out, 0, [], 0, b""
        self.index: list[bytes] = []
        self.keys: list[tuple[int, int]] = []
        self.docs = self.ids = 0
        self.prev_id = None
        self.count = 0

    def add(self, doc_id: int | None, value: bytes) -> None:
        self.count = self.count + 1 if self.docs and doc_id == self.prev_id else 0
        self.prev_id = doc_id
        key = key_of(doc_id, self.count)
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += [_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.size += _ENTRY.size + len(key) - shared + len(value)
        self.last = key
        if not self.count:
            self.keys.append((zlib.crc32(key[:9]), zlib.crc32(key[:9], 0x9E3779B9) | 1))
        self.docs += 1
        self.ids += len(value) // 4
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.block)
        stored = _codec().compress(raw, asbytes=True)
        self.index.append(self.last + _INDEX.pack(self.at, len(stored), len(raw)))
        self.out.write(stored)
        self.at += len(stored)
        self.block, self.size = [], 0

    def close(self) -> None:
        import numpy as np

        if self.block:
            self._flush()
        index = b"".join(self.index)
        bits = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        on = np.zeros(bits, np.uint8)
        if self.keys:
            ab = np.array(self.keys, np.uint64)
            for k in range(HASHES):
                on[(ab[:, 0] + np.uint64(k) * ab[:, 1]) % np.uint64(bits)] = 1
        bloom = np.packbits(on, bitorder="little").tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, zlib.crc32(index + bloom), MAGIC))


def _uri(path: str) -> str:
    """A path, or a name that Hadoop's readers give to a store, as the URI of the same place."""
    uri = re.sub("^s3[an]://", "s3://", path)
    return uri if "://" in uri or uri.startswith(("file:", "hdfs:")) else f"file://{uri}"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(path))


class Reader:
    """A shard: ``get`` by binary search, ``scan`` in order."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        if size < _FOOTER.size:
            raise ValueError(f"{uri}: no footer")
        i_at, i_len, b_at, b_len, self.docs, self.ids, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        index, self.bloom = self.file.read_at(i_len, i_at), self.file.read_at(b_len, b_at)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        step = 13 + _INDEX.size
        self.last = [index[i : i + 13] for i in range(0, i_len, step)]
        self.blocks = [_INDEX.unpack_from(index, i + 13) for i in range(0, i_len, step)]

    def _entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, stored, size = self.blocks[k]
        raw = _codec().decompress(self.file.read_at(stored, at), size, asbytes=True)
        i, key = 0, b""
        while i < size:
            shared, other, n = _ENTRY.unpack_from(raw, i)
            i += _ENTRY.size
            key = key[:shared] + raw[i : i + other]
            i += other
            yield key, raw[i : i + n]
            i += n

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.blocks)):
            for key, value in self._entries(k):
                yield id_of(key), value

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(key_of(doc_id), 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of the identifier, in the order they were written."""
        if not self.docs or not self.may_hold(doc_id):
            return []
        low, found = key_of(doc_id), []
        for k in range(bisect_left(self.last, low), len(self.blocks)):
            for key, value in self._entries(k):
                if key[:9] == low[:9]:
                    found.append(value)
                elif key > low:
                    return found
        return found


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, spaces: bool = True) -> DataFrame:
    """Writes the ids of all documents as shards into ``folder``; returns a row per shard in order of
    identifier: shard, path, n_docs, n_ids, before (ids in the shards before it)."""
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    kinds = arrow_schema(_SHARDS)
    files_dir = f"{folder}/shards"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx = TaskContext.get()
        shard = ctx.partitionId()
        files, place = _open(files_dir)
        files.create_dir(place, recursive=True)
        name, own = f"{place}/{shard:06d}.sst", f"{place}/.{shard:06d}.{ctx.taskAttemptId()}"
        writer, out = None, None
        tail = end_id.to_bytes(4, "little")
        encode = id_encoder(path, spaces)
        for b in slim(batches):
            if writer is None:
                out = files.open_output_stream(own)
                writer = Writer(out)
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encode(b["text"].to_pylist()), strict=True):
                writer.add(doc_id, ids + tail)
        if writer:
            writer.close()
            out.close()
            files.move(own, name)
            yield pa.RecordBatch.from_pydict(schema=kinds, mapping={"shard": [shard], "path": [f"{files_dir}/{shard:06d}.sst"], "n_docs": [writer.docs], "n_ids": [writer.ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"crc": F.crc32("text"), "part": F.spark_partition_id()})
    order = [F.col("doc_id").asc_nulls_first(), "crc", "part"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = materialize(spark, ordered.mapInArrow(run, _SHARDS), "shards")
    # a row per shard: a running sum over them is small whatever the table
    return shards.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32 of every document, in order of identifier."""

    def run(b):
        ids, start, n, crc = [], [], [], []
        for path, at in zip(b["path"].to_pylist(), b["before"].to_pylist(), strict=True):
            for doc_id, value in Reader(path).scan():
                ids.append(doc_id)
                start.append(at)
                n.append(len(value) // 4)
                crc.append(zlib.crc32(value))
                at += n[-1]
        return {"doc_id": ids, "start": start, "n_tokens": n, "ids_crc32": crc}

    return arrow_rows(shards.select("path", "before"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids (array<long>) of the identifiers in ``wanted.doc_id``, by binary search in each shard whose
    filter may hold them. The set asked for is small; it goes to every shard."""

    def run(b):
        docs, ids = [], []
        for path, asked in zip(b["path"].to_pylist(), b["asked"].to_pylist(), strict=True):
            reader = Reader(path)
            for d in asked or []:
                for value in reader.get(d):
                    docs.append(d)
                    ids.append(list(struct.unpack(f"<{len(value) // 4}I", value)))
        return {"doc_id": docs, "ids": ids}

    asked = wanted.select("doc_id").distinct().agg(F.collect_list("doc_id").alias("asked"))
    return arrow_rows(shards.select("path").join(F.broadcast(asked)), run, "doc_id long, ids array<bigint>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write(table(spark, sf_dir, "documents"), scratch(spark, "sstable"))
    return read(shards.repartition(max(1, shards.count())))
