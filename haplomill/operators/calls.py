"""Allele calls (frag, snp, allele, qv): consensus, coverage, depth, blocks and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.phred import err, to_char


def consensus(raw: DataFrame) -> DataFrame:
    """Agreeing calls of a fragment on a variant become one with the best quality; conflicts are dropped."""
    return raw.groupBy("frag", "snp").agg(F.min("allele").alias("allele"), F.max("allele").alias("_top"), F.max("qv").alias("qv")).where("allele = _top").drop("_top")


def summed_consensus(raw: DataFrame, cap: int = 40) -> DataFrame:
    """As consensus, but agreeing qualities add up to at most cap; a lone call keeps its own."""
    out = raw.groupBy("frag", "snp").agg(F.min("allele").alias("allele"), F.max("allele").alias("_top"), F.when(F.count("*") == 1, F.max("qv")).otherwise(F.least(F.sum("qv"), F.lit(cap))).cast("int").alias("qv"))
    return out.where("allele = _top").drop("_top")


def coverage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("snp").agg(F.count("*").alias("n"))


def depth(calls: DataFrame, strand=None) -> DataFrame:
    strand = F.col("frag") % 2 if strand is None else strand
    n = lambda a, s: F.count_if((F.col("allele") == a) & (strand == s))
    return calls.groupBy("snp").agg(n(0, 0).alias("a0_fwd"), n(0, 1).alias("a0_rev"), n(1, 0).alias("a1_fwd"), n(1, 1).alias("a1_rev"))


def informative(calls: DataFrame, least: int = 2) -> DataFrame:
    return calls.groupBy("frag").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def mean_calls(calls: DataFrame, least: float = 3) -> DataFrame:
    per = calls.groupBy("frag").agg(F.count("*").alias("n"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean_calls"), (F.avg("n") >= least).alias("long_reads"))


def fragment_lines(calls: DataFrame) -> DataFrame:
    """One text line per fragment: block count, name, (first index, alleles) of each run of indices, qualities."""
    w = Window.partitionBy("frag").orderBy("snp")
    runs = calls.withColumn("_run", F.col("snp") - F.row_number().over(w))
    blocks = runs.groupBy("frag", "_run").agg(F.min("snp").alias("s"), F.array_sort(F.collect_list(F.struct("snp", "allele", "qv"))).alias("c"))
    blocks = blocks.select("frag", F.struct("s", F.array_join(F.transform("c", lambda x: x.allele.cast("string")), "").alias("h"), F.array_join(F.transform("c", lambda x: to_char(x.qv)), "").alias("q")).alias("b"))
    joined = blocks.groupBy("frag").agg(F.array_sort(F.collect_list("b")).alias("b"))
    text = F.concat_ws(" ", F.size("b").cast("string"), F.col("frag").cast("string"), F.array_join(F.transform("b", lambda x: F.concat_ws(" ", (x.s + 1).cast("string"), x.h)), " "), F.array_join(F.transform("b", lambda x: x.q), ""))
    return joined.select("frag", text.alias("line"))


def adjacent_edges(calls: DataFrame) -> DataFrame:
    """Neighbouring variants of each fragment, with the number of fragments."""
    w = Window.partitionBy("frag").orderBy("snp")
    return calls.select(F.col("snp").alias("a"), F.lead("snp").over(w).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def fragment_pairs(calls: DataFrame) -> DataFrame:
    """All pairs of calls of a fragment. A fragment's calls are gathered once; no self-join."""
    k = calls.groupBy("frag").agg(F.array_sort(F.collect_list(F.struct("snp", "allele", "qv"))).alias("c"))
    left = k.select("frag", F.size("c").alias("k"), "c", F.posexplode("c").alias("i", "x"))
    pair = left.select("frag", "k", "x", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("y"))
    return pair.select("frag", "k", F.col("x.snp").alias("a"), F.col("y.snp").alias("b"), F.col("x.allele").alias("a1"), F.col("y.allele").alias("a2"), F.col("x.qv").alias("q1"), F.col("y.qv").alias("q2"))


def pair_edges(calls: DataFrame) -> DataFrame:
    return fragment_pairs(calls).groupBy("a", "b").agg(F.count("*").alias("n"))


def edge_weights(calls: DataFrame, hap) -> DataFrame:
    """Sum over fragments of log10(P(agree)/P(disagree))/(calls - 1); negative where a fragment contradicts hap.

    hap: function from a variant column to its allele on the current haplotype.
    """
    p = fragment_pairs(calls)
    e1, e2 = err("q1"), err("q2")
    same, other = (1 - e1) * (1 - e2) + e1 * e2, (1 - e1) * e2 + e1 * (1 - e2)
    agrees = (F.col("a1") == F.col("a2")) == (hap(F.col("a")) == hap(F.col("b")))
    w = F.log10(same / other) / (F.col("k") - 1)
    return p.groupBy("a", "b").agg(F.round(F.sum(F.when(agrees, w).otherwise(-w)), 6).alias("weight"))


def top_edges(weights: DataFrame, group, k: int = 5) -> DataFrame:
    """The k heaviest edges of each group, by absolute weight."""
    w = Window.partitionBy("comp").orderBy(F.desc(F.abs("weight")), "a", "b")
    return weights.withColumn("comp", group).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("comp", "rank", "a", "b", "weight")
