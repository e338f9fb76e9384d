"""One document of each group of near copies: SimHash links and banded minima as candidates, Jaccard verified.

SimHash fingerprints within 3 bits find copies with few edits. Most copies at a word-shingle similarity of 0.8 lie
further apart (measured: 7 bits of 64 on average), beyond what 3-bit fuzzy hashing finds, so bands of a MinHash
signature add candidates. Candidates only decide which distinct texts meet; whether two of them are copies is
decided on their whole shingle sets. Each distinct text is one node, so exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.components import connected_components, roots
from .common import cut, partitions, shingle_hashes, word_hashes
from .minhash import MinHash
from .simhash import fingerprint, links
from .tokens import forget

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Groups of more distinct texts are compared in pairs of blocks of this size, each pair by a task of its own.
BLOCK = 4_000


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h1, h2, fp, bands): h1 and h2 are 128 bits of hash of the text, bands a hash of each band of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher = MinHash(BANDS * ROWS, words)
        for b in batches:
            prints, bands = [], []
            for x in b.column(3):
                data = x.as_py() or b""
                prints.append(fingerprint(data, words))
                sig = hasher.signature(data).reshape(BANDS, ROWS).astype(np.uint64)
                h = np.arange(BANDS, dtype=np.uint64)
                for i in range(ROWS):
                    h = (h ^ sig[:, i]) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29))
                bands.append(h.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(bands) if bands else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(prints, np.uint64).view(np.int64)), lists], ["doc_id", "h1", "h2", "fp", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identity(), _text().cast("binary").alias("text")).mapInArrow(run, "doc_id long, h1 long, h2 long, fp long, bands array<long>")


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _identity():
    """128 bits that stand for a text; 64 would meet by chance among some 10**9 texts."""
    return F.xxhash64(_text()).alias("h1"), F.xxhash64(F.lit("text"), _text()).alias("h2")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identity())


def _near_prints(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes that stand for their fingerprints, which are within 3 bits of each other."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("n"))
    end = lambda k: first.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"))
    return links(first.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))


def jaccard_forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what similarities of at least `similarity` connect; sets are sorted and distinct.

    Breadth-first over an inverted index: a set meets those not yet reached only, and only those that
    share members with it.
    """
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    left, found = set(range(len(sets))), []
    alive = np.ones(len(sets), dtype=bool)
    sizes = np.array([len(s) for s in sets])
    while left:
        queue = [left.pop()]
        alive[queue[0]] = False
        while queue and left:
            i = queue.pop()
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            span = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
            near = owner[at]
            shared = np.bincount(near[alive[near]], minlength=len(sets))
            hit = np.flatnonzero((shared > 0) & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9))
            for j in hit.tolist():
                found.append((i, j))
                left.discard(j)
                queue.append(j)
            alive[hit] = False
    return found


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, fuzzy: bool = True) -> DataFrame:
    """(h1, h2, least, component, keep) of every distinct text, named by 128 bits of hash: least is its smallest doc_id,
    keep that of its component.

    Exact copies are one component, a null text counting as empty. Links are Jaccard similarities of at least
    `similarity` over the sets of word shingles; a shorter text is one shingle, a text without words links to none.
    fuzzy: near SimHash fingerprints are candidates beside bands of MinHash signatures. Texts of any length are compared
    whole; rows with a null doc_id take part, but give no keep while others do; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prints = cut(_prints(docs, words), "prints")
    distinct = prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once written
    # candidates: each text with the smallest of its band, or of its fingerprint; both linear in the rows
    banded = nodes.select("node", F.explode("bands").alias("key"))
    alike = nodes.select("node", F.col("fp").alias("key"))

    def to_least(df: DataFrame) -> DataFrame:
        low = df.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low")
        return df.join(low, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))

    pairs = to_least(banded)
    if fuzzy:
        pairs = pairs.unionByName(to_least(alike)).unionByName(_near_prints(nodes))
    groups = cut(connected_components(pairs), "groups")
    big = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("component", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(big, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j: a text goes to the pairs that its block takes part in
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"), *_identity())
    asked = nodes.select("node", F.col("h1").alias("n1"), F.col("h2").alias("n2"), "least").join(placed, "node")
    # the document is part of the key, so the copies of a text are dealt out and not one of them is gathered with the others
    one = texts.join(asked, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")) & F.col("doc_id").eqNullSafe(F.col("least")))
    spread = one.select("component", F.explode(blocks).alias("p"), "own", "node", F.col("text").cast("binary").alias("text"))
    ordered = spread.select("component", "p.i", "p.j", "own", "node", "text").repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sets = None, [], []

        def out():
            found = jaccard_forest(sets, similarity=similarity)
            a = np.array([held[x] for x, _ in found], np.int64)
            b = np.array([held[y] for _, y in found], np.int64)
            if len(a):
                a, b = roots(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for *now, node, text in zip(*(b.column(i) for i in (0, 1, 2, 4, 5))):
                now, node = [x.as_py() for x in now], node.as_py()
                if now != key:
                    if len(held) > 1:
                        yield out()
                    key, held, sets = now, [], []
                if held and held[-1] == node:
                    continue
                held.append(node)
                sets.append(np.unique(shingle_hashes(word_hashes(text.as_py()), words)))
        if len(held) > 1:
            yield out()

    final = connected_components(ordered.mapInArrow(verify, "a long, b long"))
    rooted = nodes.select("node", "h1", "h2", "least").join(final.select("node", F.col("component").alias("c")), "node", "left").select("h1", "h2", "least", F.coalesce("c", "node").alias("component"))
    low = rooted.groupBy("component").agg(F.min("least").alias("keep"))
    return cut(rooted.join(low, "component").select("h1", "h2", "least", "component", "keep"), "copies")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each component the row with its smallest doc_id stays, unchanged.

    Repeated rows of that doc_id and text leave one row. Null and empty texts are exact copies of one another. Texts of
    any length are compared whole. Rows with a null doc_id stay only where a component has no other (one of them). Other
    columns pass through, whatever their names; an empty table gives an empty result.
    """
    named = near_copies(docs, words, similarity).where("least <=> keep").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "keep")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), *_identity())
    same = (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")) & F.col("id").eqNullSafe(F.col("keep"))
    kept = cut(whole.join(named, same).select("row", "h1", "h2"), "kept")
    twice = kept.groupBy("h1", "h2").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(["h1", "h2"]) if twice else kept).select("row.*")
