"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The [23, 12] Golay code is perfect: each 23-bit
word lies within 3 bits of exactly one codeword, so decoding maps a word to a 12-bit index. A word and any word one
bit away share an index once a word also carries the indices of the codewords that its neighbours decode to: one
index if it lies within 2 bits of its codeword, six if it lies 3 bits away.

At most 3 differing bits over three segments leave two segments with at most one each (pigeonhole), so the 24-bit
pairs of indices of two segments are keys by which every linked pair meets. Within a key, distances are verified
and only a spanning forest of the links leaves the task, never all pairs. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.components import connected_components, roots
from .common import cut, partitions, table

SEED, RADIUS, WORDS = 42, 3, 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SMALL = 48


def _remainder(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << i - 11
    return word


class Golay:
    """Decoding tables: the syndrome of a word is linear, and each syndrome has one error of at most 3 bits."""

    def __init__(self):
        self.low = np.array([_remainder(i) for i in range(1 << 12)], dtype=np.uint32)
        self.high = np.array([_remainder(i << 12) for i in range(1 << 11)], dtype=np.uint32)
        self.error = np.zeros(1 << 11, dtype=np.uint32)
        bits = [1 << i for i in range(23)]
        for errors in ([0], bits, [a | b for a in bits for b in bits if a < b], [a | b | c for a in bits for b in bits if a < b for c in bits if b < c]):
            for e in errors:
                self.error[_remainder(e)] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        """12-bit codeword index of each 23-bit word."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return ((words ^ self.error[syndrome]) >> 11).astype(np.int64)

    def keys(self, words: np.ndarray, bits: int) -> np.ndarray:
        """The indices of each word and of all words one bit away, at most 6, padded with -1."""
        flips = np.concatenate(([0], 1 << np.arange(bits))).astype(np.uint32)
        found = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        new = np.ones_like(found, dtype=bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        rank = np.cumsum(new, axis=1) - 1
        out = np.full((len(words), int(rank.max(initial=0)) + 1), -1, dtype=np.int64)
        row, col = np.nonzero(new)
        out[row, rank[row, col]] = found[row, col]
        return out


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the fingerprint) of all keys of unsigned 64-bit fingerprints."""
    own = [golay().keys(((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32), n) for at, n in SEGMENTS]
    keys, rows = [], []
    for k, (i, j) in enumerate(PAIRS):
        a, b = own[i][:, :, None], own[j][:, None, :]
        both = np.where((a >= 0) & (b >= 0), (k << 24) | (a << 12) | b, -1).reshape(len(prints), -1)
        row, col = np.nonzero(both >= 0)
        keys.append(both[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of UTF-8 bytes: majority bits over the XXH64 of all word shingles, repeats included."""
    parts = data.lower().split()  # bytes: A-Z and blanks 09-0D, 20 only
    if not parts:
        return 0
    joined = b" ".join(parts)
    k = min(words, len(parts))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    n = len(parts) - k + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    if n < 64:
        set_bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        raw = h.view(np.uint8).reshape(n, 8)
        set_bits = np.concatenate([np.bincount(raw[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(x.as_py() or b"", words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what distances of at most radius connect among distinct fingerprints.

    Breadth-first: a node is compared with those not yet reached only, so a tight group costs little more than
    its size.
    """
    left, ends = prints, ([], [])
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = distance(left, node) <= radius
            found = left[near]
            if len(found):
                queue.extend(found)
                ends[0].append(found)
                ends[1].append(np.full(len(found), node))
                left = left[~near]
    empty = [np.zeros(0, prints.dtype)]
    return np.concatenate(ends[0] or empty), np.concatenate(ends[1] or empty)


def _link_groups(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal keys; prints are distinct within a key."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for d in range(1, SMALL):
        same = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not len(same):
            break
        near = same[distance(prints[same], prints[same + d]) <= radius]
        a.append(prints[near])
        b.append(prints[near + d])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        x, y = forest(prints[s : s + n], radius)
        a.append(x)
        b.append(y)
    if not a:
        return prints[:0], prints[:0]
    return roots(np.concatenate(a), np.concatenate(b))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) longs: edges that connect all distinct fingerprints (column fp) within radius bits of each other."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                some = b.column(0).slice(at, 2000).to_numpy().view(np.uint64)
                keys, rows = fuzzy_keys(some)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(some[rows].view(np.int64))], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_p = np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def out(k, p):
            a, b = _link_groups(k, p, radius) if len(k) > 1 else (p[:0], p[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        waiting, n = [], 0
        for b in batches:
            waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            n += b.num_rows
            if n < 100_000:
                continue
            k = np.concatenate([held_k, *(x for x, _ in waiting)])
            p = np.concatenate([held_p, *(x for _, x in waiting)])
            at = int(np.searchsorted(k, k[-1]))  # the last key may go on
            held_k, held_p, waiting, n = k[at:], p[at:], [], 0
            if at:
                yield out(k[:at], p[:at])
        yield out(np.concatenate([held_k, *(x for x, _ in waiting)]), np.concatenate([held_p, *(x for _, x in waiting)]))

    spark = prints.sparkSession
    keyed = prints.select("fp").repartition(partitions(spark)).mapInArrow(spread, "key int, fp long")
    return keyed.repartition(partitions(spark), "key").sortWithinPartitions("key", "fp").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; the component is the smallest doc_id that links reach.

    Fingerprints link at radius or fewer differing bits, an empty or null text having fingerprint zero. Texts of any
    length are read whole. Rows with a null doc_id keep it and take part in links, but name no component; repeated rows
    stay; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if radius > RADIUS:
        raise ValueError("the pigeonhole holds for 3 or fewer differing bits")
    prints = cut(fingerprints(docs, words), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected_components(links(nodes, radius))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
