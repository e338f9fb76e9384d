"""MinHash document fingerprints.

Word shingles are hashed in vectorised numpy and put through universal hash permutations x -> a*x + b modulo 2**64
(odd a); the fingerprint keeps 16 bits of each minimum, and the share of equal positions estimates the Jaccard
similarity of two shingle sets. Neighbours by doc_id are found by dealing ids out in ranges, each with a copy of
the first document of the next range, so no order over the whole table is gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket_of, id_bounds, mix64, partitions, place_of, shingle_hashes, table, word_hashes

WORDS, PERMUTATIONS = 5, 128
LEAST_ID = -(1 << 63)
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:n] | np.uint64(1), drawn[n:]


class MinHash:
    def __init__(self, n: int = PERMUTATIONS, words: int = WORDS):
        self.words = words
        a, b = permutations(n)
        self.a, self.b = a[:, None], b[:, None]

    def signature(self, data: bytes) -> np.ndarray:
        """16 bits of each permutation's minimum; all ones for a text without words."""
        x = shingle_hashes(word_hashes(data), self.words)
        low = np.full(len(self.a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(x), 256):
            part = x[None, at : at + 256] * self.a
            part += self.b
            np.minimum(low, part.min(axis=1), out=low)
        return ((low >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2") if len(x) else np.full(len(self.a), 0xFFFF, "<u2")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each row of docs: bands of signatures are joined, what meets is verified by the Jaccard
    similarity of its whole shingle sets, and links are followed; component_id is the smallest doc_id of the component.

    Equal texts, null and empty ones among them, are one text. Rows with a null doc_id keep it and take part, but name no
    component; texts of any length are compared whole; repeated rows stay; other columns are ignored; an empty table gives
    an empty result.
    """
    from .near_copies import identified, near_copies

    found = near_copies(docs, words, similarity, fuzzy=False).select("h1", "h2", F.col("keep").alias("component_id"))
    return identified(docs).join(found, ["h1", "h2"]).select("doc_id", "component_id")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(docs: DataFrame, shards: int) -> DataFrame:
    """(_bucket, _copy, doc_id, text), each bucket in order of doc_id within one task and followed by a copy of the
    first document of the next bucket (after the last one: of the first)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_key"))
    bounds = id_bounds(docs, "doc_id", shards)
    firsts = rows.select("_key").withColumn("_bucket", bucket_of(F.col("_key"), bounds)).groupBy("_bucket").agg(F.min("_key").alias("first")).orderBy("_bucket").collect()  # a row per bucket
    before = {r.first: firsts[i - 1]._bucket for i, r in enumerate(firsts)} if firsts else {}
    rows = rows.withColumn("_bucket", bucket_of(F.col("_key"), bounds))
    if before:
        also = place_of(F.col("_key"), sorted(before), [before[k] for k in sorted(before)])
        places = F.filter(F.array(F.struct(F.col("_bucket").alias("to"), F.lit(0).alias("copy")), F.struct(F.col("_also").alias("to"), F.lit(1).alias("copy"))), lambda x: x.to.isNotNull())
        rows = rows.withColumn("_also", also).withColumn("_p", F.explode(places)).select(F.col("_p.to").alias("_bucket"), F.col("_p.copy").alias("_copy"), "_key", "doc_id", "text")
    else:
        rows = rows.select("_bucket", F.lit(0).alias("_copy"), "_key", "doc_id", "text")
    return rows.repartition(max(1, len(firsts)), "_bucket").sortWithinPartitions("_bucket", "_copy", "_key", F.col("doc_id").isNotNull(), "text").select("_bucket", "_copy", "doc_id", "text")


def with_edits(docs: DataFrame, n: int = PERMUTATIONS, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of its edited text (EDITED), one row per row of docs.

    The edited text has its last half replaced by the beginning of the next document. Null text counts as empty; texts
    of any length are read whole; a null doc_id sorts first; rows of one id are ordered by text; a lone document is its own next; other columns are
    ignored; an empty table gives an empty result. Texts without words are alike (1) and unlike all others (0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(n, words)
        last = None  # bucket, doc_id, text, signature
        rows: list[tuple] = []

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2)], [x.split()[0] for x in EDITED.split(", ")])
            rows.clear()
            return batch

        for b in batches:
            for bucket, copy, doc, text in zip(*(b.column(i) for i in range(4))):
                bucket, copy, doc, text = bucket.as_py(), copy.as_py(), doc.as_py(), text.as_py()
                own = None
                if last is not None and last[0] == bucket:
                    _, prior, before, sig = last
                    own = hasher.signature(text.encode())
                    edited = edited_text(before, text).encode()
                    other = hasher.signature(edited)
                    rows.append((prior, len(before), hashlib.sha256(edited).hexdigest(), sig.tobytes().hex(), other.tobytes().hex(), float((sig == other).mean()), float((sig == own).mean())))
                    if len(rows) == 1000:
                        yield out()
                last = None if copy else (bucket, doc, text, hasher.signature(text.encode()) if own is None else own)
        if rows:
            yield out()

    return in_ranges(docs, partitions(docs.sparkSession)).mapInArrow(run, EDITED)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
