"""Emission and transition probabilities of realignment, from how reads align."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.alleles import BASES
from ..sources.text import aligned_pieces
from .link import interval_join

#: Reads that are counted (a sampling operator) and that have to be useful before estimates are taken.
READS, USEFUL = 10_000, 1_000


def with_reference(reads: DataFrame, fasta: DataFrame, bin_size: int = 1_000) -> DataFrame:
    """reads with `ref`: the reference bases from pos to end. Lines of the sequence are met by bins of positions; a read's
    lines meet by its key, so nothing larger than a read is gathered."""
    spans = reads if "end" in reads.columns else aligned_pieces(reads)
    spans = spans.withColumn("_key", F.xxhash64("read_id", "flag", "pos", "seq"))
    lines = fasta.select("chrom", F.explode(F.sequence("start", F.col("start") + F.length("bases") - 1, F.lit(50))).alias("_at"), "start", "bases")
    lines = lines.select("chrom", "_at", F.substring("bases", (F.col("_at") - F.col("start") + 1).cast("int"), F.lit(50)).alias("_b"))
    asked = spans.select("_key", "chrom", "pos", "end").distinct()
    met = interval_join(asked.withColumn("_s", F.col("pos") - 49), lines, ["chrom"], bin_size, "_s", "end", "_at")
    whole = met.groupBy("_key", "pos", "end").agg(F.array_sort(F.collect_list(F.struct("_at", "_b"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["_b"]), "")
    ref = F.substring(text, (F.col("pos") - F.col("l")[0]["_at"] + 1).cast("int"), (F.col("end") - F.col("pos") + 1).cast("int"))
    return spans.join(whole.select("_key", ref.alias("ref")), "_key").drop("_key")


def alignment_counts(reads: DataFrame) -> DataFrame:
    """(kind, a, b, n): kind E counts reference base a read as b, both on the read's own strand; kind T counts steps from
    state a to b (M, I, D). reads: cigar, seq, ref, flag.

    A stretch of n aligned bases steps n - 1 times from M to M; an insertion or deletion of fewer than 10 bases that many
    less one times to itself, and is entered from M only if aligned bases stand right before it.
    """
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.lit("").alias("p"), F.array().cast("array<struct<a:string,b:string,n:int>>").alias("t"), F.array().cast("array<struct<r:int,q:int,n:int>>").alias("m"))

    def step(s, x):
        one = lambda a, b, n, when: F.when(when, F.array(F.struct(a.alias("a"), b.alias("b"), n.cast("int").alias("n")))).otherwise(F.array().cast("array<struct<a:string,b:string,n:int>>"))
        m, gap = x.op == "M", x.op.isin("I", "D")
        steps = F.concat(
            s.t, one(s.p, F.lit("M"), F.lit(1), m & s.p.isin("I", "D")), one(F.lit("M"), F.lit("M"), x.len - 1, m & (x.len > 1)),
            one(F.lit("M"), x.op, F.lit(1), gap & (s.p == "M")), one(x.op, x.op, x.len - 1, gap & (x.len > 1) & (x.len < 10)))
        return F.struct(
            (s.r + F.when(x.op.isin("M", "D", "N"), x.len).otherwise(0)).cast("int").alias("r"), (s.q + F.when(x.op.isin("M", "I", "S"), x.len).otherwise(0)).cast("int").alias("q"),
            x.op.alias("p"), steps.alias("t"), F.when(m, F.concat(s.m, F.array(F.struct(s.r.alias("r"), s.q.alias("q"), x.len.alias("n"))))).otherwise(s.m).alias("m"))

    w = reads.select(F.aggregate("cigar", start, step).alias("s"), F.upper("ref").alias("ref"), F.upper("seq").alias("seq"), (F.col("flag").bitwiseAND(F.lit(16)) != 0).alias("back"))
    t = w.select(F.explode("s.t").alias("t")).groupBy(F.col("t.a").alias("a"), F.col("t.b").alias("b")).agg(F.sum("t.n").alias("n")).select(F.lit("T").alias("kind"), "a", "b", "n")
    at = w.select("back", F.explode("s.m").alias("m"), "ref", "seq").select("back", F.substring("ref", F.col("m.r") + 1, F.col("m.n")).alias("r"), F.substring("seq", F.col("m.q") + 1, F.col("m.n")).alias("q"))
    pairs = at.select("back", F.explode(F.arrays_zip(F.split("r", "").alias("a"), F.split("q", "").alias("b"))).alias("x")).select("back", "x.a", "x.b").where(F.col("a").isin(*BASES) & F.col("b").isin(*BASES))
    own = lambda c: F.when(F.col("back"), F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    e = pairs.groupBy(own("a").alias("a"), own("b").alias("b")).agg(F.count("*").alias("n")).select(F.lit("E").alias("kind"), "a", "b", "n")
    return e.unionByName(t)


def probabilities(counts: DataFrame) -> dict[str, np.ndarray]:
    """{'E': 4 x 4 by A, C, G, T, 'T': 3 x 3 by M, I, D}: one more than each count over its row's sum (at most 25 numbers)."""
    found = {(r.kind, r.a, r.b): r.n for r in counts.collect()}
    out = {}
    for kind, names in (("E", BASES), ("T", "MID")):
        n = np.array([[found.get((kind, a, b), 0) for b in names] for a in names], dtype=float)
        out[kind] = (n + 1) / np.maximum(n.sum(axis=1, keepdims=True), 1)
    return out


def estimated(reads: DataFrame, fasta: DataFrame, most: int = READS, useful: int = USEFUL) -> dict[str, np.ndarray] | None:
    """Probabilities from at most `most` reads, in order of place and name; None unless more than `useful` lie on the sequence."""
    some = reads.where(F.col("flag").bitwiseAND(F.lit(1796 + 2048)) == 0).orderBy("chrom", "pos", "read_id").limit(most)
    met = with_reference(some, fasta).cache()
    try:
        return probabilities(alignment_counts(met)) if met.count() > useful else None
    finally:
        met.unpersist()
