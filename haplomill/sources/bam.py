"""Binary alignments: BGZF-compressed BAM files, read whole or by region, one task a file.

A file's blocks are inflated and decoded as they are read, so a task holds one block and one batch of records. Splitting
a file needs its index, which isn't read; several files are read in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed by the format: operations, bases, sizes of tag values.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
FORMS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
RECORD = "read_id string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, mate_chrom string, mate_pos int, isize int, seq string, qual string, bx string, mi string"
MISSING = 13


def blocks(stream) -> Iterator[bytes]:
    """Inflated BGZF blocks; a block says its own size in an extra field of its gzip header."""
    while True:
        head = stream.read(12)
        if len(head) < 12:
            return
        if head[:2] != b"\x1f\x8b":
            raise ValueError("not a BGZF block")
        extra = stream.read(struct.unpack_from("<H", head, 10)[0])
        at, size = 0, None
        while at + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at : at + 2] == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if size is None:
            raise ValueError("a block without a size")
        body = stream.read(size - 12 - len(extra))
        yield zlib.decompress(body[:-8], -15)


class Bytes:
    """Reads so many bytes at a time from a sequence of blocks."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at = parts, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                if len(self.held) - self.at:
                    raise ValueError("the file ends within a record")
                return b""
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out


def contigs(data: Bytes) -> list[str]:
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.take(struct.unpack("<i", data.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", data.take(4))[0]):
        n = struct.unpack("<i", data.take(4))[0]
        out.append(data.take(n)[:-1].decode())
        data.take(4)
    return out


def tags(data: bytes) -> dict[str, object]:
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            out[name], at = data[at:end].decode(), end + 1
        elif kind == "B":
            each, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * SIZES[each]
        else:
            out[name] = chr(data[at]) if kind == "A" else struct.unpack_from(FORMS[kind], data, at)[0]
            at += SIZES[kind]
    return out


def record(data: bytes, names: list[str]) -> dict:
    """A record as text formats write it; positions count from 1, missing qualities are MISSING."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_bases, mate, mate_pos, isize = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    half = (n_bases + 1) // 2
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in data[at : at + half])[:n_bases]
    at += half
    qual = data[at : at + n_bases]
    found = tags(data[at + n_bases :])
    named = lambda k: names[k] if k >= 0 else "*"
    text = lambda k: None if found.get(k) is None else str(found[k])
    return {"read_id": name, "flag": flag, "chrom": named(ref), "pos": pos + 1, "mapq": mapq, "cigar": [{"len": o >> 4, "op": "M" if OPS[o & 15] in "=X" else OPS[o & 15]} for o in ops],
            "mate_chrom": named(mate), "mate_pos": mate_pos + 1, "isize": isize, "seq": seq, "qual": "".join(chr((MISSING if q == 255 else q) + 33) for q in qual), "bx": text("BX"), "mi": text("MI")}


def span(r: dict) -> int:
    return sum(o["len"] for o in r["cigar"] if o["op"] in "MDN")


def parsed_region(region: str) -> tuple[str, int, int]:
    """(contig, first, last) of contig, contig:first or contig:first-last."""
    name, _, part = region.partition(":")
    first, _, last = part.replace(",", "").partition("-")
    return name, int(first or 1), int(last or 1 << 40)


def read_bam(spark: SparkSession, paths: list[str], region: str | None = None, min_mapq: int = 20, supplementary: bool = False) -> DataFrame:
    """Alignments as sources.text.read_sam gives them, of several files and optionally of those that touch a region."""
    schema = spark.createDataFrame([], RECORD).schema
    arrow = pa.schema([("read_id", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("len", pa.int32()), ("op", pa.string())]))), ("mate_chrom", pa.string()), ("mate_pos", pa.int32()), ("isize", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("bx", pa.string()), ("mi", pa.string())])
    asked = parsed_region(region) if region else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")
                rows = []
                with files.open_input_stream(name, compression=None) as stream:
                    data = Bytes(blocks(stream))
                    names = contigs(data)
                    while size := data.take(4):
                        r = record(data.take(struct.unpack("<i", size)[0]), names)
                        if asked and not (r["chrom"] == asked[0] and r["pos"] <= asked[2] and r["pos"] + span(r) > asked[1]):
                            continue
                        rows.append(r)
                        if len(rows) == 2_000:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    mask = 1796 if supplementary else 1796 + 2048
    return listed.mapInArrow(run, schema).where((F.col("flag").bitwiseAND(F.lit(mask)) == 0) & (F.col("mapq") >= min_mapq))
