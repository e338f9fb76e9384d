"""Token ids in sorted-string-table shards.

A shard holds documents in ascending id order: data blocks with prefix-compressed keys, a Bloom filter, a sparse
index with the first key of each block, and a fixed footer. Shards cover ascending id ranges of nearly equal size.

File, in order (integers are little-endian; v: unsigned LEB128):
  blocks:  zstd of entries (v shared, v rest, v size, rest of the key, value), each followed by its crc32 (4 bytes)
  bloom:   bit array, HASHES probes by double hashing with the two halves of a key's XXH64
  index:   entries (v key size, key, v offset, v size) of all blocks
  footer:  8 unsigned 64-bit: bloom offset, bloom size, index offset, index size, entries, ids, bytes per id, MAGIC
Keys: 8 bytes big-endian of doc_id + 2**63; a null doc_id has the empty key, which sorts first. Values: the ids.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, id_bounds, partitions, scratch_path, table
from .tokens import encoder, vocabulary

MAGIC, BLOCK, BITS_PER_KEY, HASHES, END_ID = 0x5353544142303031, 1 << 16, 10, 7, 0
FOOTER = struct.Struct("<8Q")
MANIFEST = "bucket int, path string, docs long, ids long, bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Appends entries in key order to a stream; close() writes filter, index and footer."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.docs = self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.block:
            n = min(len(key), len(self.last))
            same = next((i for i in range(n) if key[i] != self.last[i]), n)
        else:
            self.first, same = key, 0
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(data)))
            self._write(data + struct.pack("<I", zlib.crc32(data)))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self._write(struct.pack("<Q", bits) + bytes(bloom))
        index_at = self.at
        self._write(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        self._write(FOOTER.pack(bloom_at, index_at - bloom_at, index_at, self.at - index_at, self.docs, self.ids, self.width, MAGIC))


class Reader:
    """Random and ordered access to a shard through a seekable stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - FOOTER.size)
        bloom_at, bloom_n, index_at, index_n, self.docs, self.ids, self.width, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        stream.seek(bloom_at)
        data = stream.read(bloom_n)
        self.bits, self.bloom = struct.unpack_from("<Q", data)[0], data[8:]
        stream.seek(index_at)
        data, at, self.index = stream.read(index_n), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, offset, length))
        self.firsts = [x[0] for x in self.index]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, n = self.index[i]
        self.stream.seek(offset)
        data = self.stream.read(n + 4)
        if zlib.crc32(data[:n]) != struct.unpack("<I", data[n:])[0]:
            raise ValueError(f"block {i} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:n]), 0, b""
        while at < len(data):
            same, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:same] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: Bloom filter, binary search in the index, then the blocks that may hold it."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        i, found = max(0, bisect.bisect_left(self.firsts, key) - 1), []
        while i < len(self.index) and self.firsts[i] <= key:
            found += [v for k, v in self._block(i) if k == key]
            i += 1
        return found


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encode and write all documents; the manifest has one row per shard: MANIFEST.

    A shard is written under a name of its attempt and then renamed, so a repeated task replaces equal bytes.
    Null text counts as empty (its end id alone); texts of any length are written whole, as one entry; a null doc_id
    sorts first; rows of one id are ordered by their ids; other columns are ignored, whatever their names; an empty
    table gives no shard.
    """
    bounds = np.array(id_bounds(docs, "doc_id", shards or partitions(docs.sparkSession)), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                doc = part.column(0)
                bucket = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right")
                ids = [x + end for x in enc.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), doc, pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(path).dtype.itemsize
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        open_ = None

        def finish():
            bucket, writer, stream, temporary = open_
            writer.close()
            stream.close()
            files.move(temporary, f"{root}/shard-{bucket:06d}.sst")
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "path": f"{folder}/shard-{bucket:06d}.sst", "docs": writer.docs, "ids": writer.ids, "bytes": writer.at}],
                schema=pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for bucket, doc, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                if open_ and open_[0] != bucket:
                    yield finish()
                    open_ = None
                if not open_:
                    temporary = f"{root}/.shard-{bucket:06d}-{uuid.uuid4().hex}"
                    stream = files.open_output_stream(temporary)
                    open_ = (bucket, Writer(stream, width), stream, temporary)
                open_[1].add(key_of(doc), ids)
        if open_:
            yield finish()

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "bucket int, doc_id long, ids binary")
    ordered = encoded.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return cut(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files alone; start counts over all shards."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    listed = manifest.select("bucket", "path", "bytes", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, base in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                files, name = _filesystem(path)
                rows: list[tuple] = []
                with files.open_input_file(name) as stream:
                    shard = Reader(stream, size)
                    for key, value in shard:
                        ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                        rows.append((id_of(key), base, len(ids), zlib.crc32(ids.tobytes())))
                        base += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = listed.repartition(partitions(manifest.sparkSession), "bucket")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_shards(write_shards(docs, vocabulary(), scratch_path(spark, "shards")))
