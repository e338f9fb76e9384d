"""Windows of reads over clusters of close variants, between anchors of equal bases, for realignment.

A read's variants meet by its key, so nothing larger than a read is gathered; clusters and anchors are found along its
CIGAR, which built-in functions can't express, in mapInPandas.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import align
from .clusters import MOST, NEAR
from .indels import extended_cigar, left_anchor, right_anchor, right_shift
from .link import interval_join

WINDOWS = "read string, seq string, window string, snps array<long>, offsets array<int>, refs array<string>, alts array<string>"


def grouped(variants: list[tuple], near: int = NEAR, most: int = MOST) -> list[list[tuple]]:
    """Variants (pos, snp, allele1, allele2) of a read in clusters: a new one after more than `near` bases or `most` variants."""
    out: list[list[tuple]] = []
    end = None
    for v in sorted(variants):
        if end is None or v[0] - end > near or len(out[-1]) >= most:
            out.append([])
        out[-1].append(v)
        end = v[0] + max(len(v[2]), len(v[3]))
    return out


def window_of(cluster: list[tuple], cigar: list[tuple[str, int]], seq: str, ref: str, pos: int) -> tuple | None:
    """(read bases, reference bases, offsets) from anchor to anchor, or None without both; cigar is extended, pos from 1.

    Indels have the place of the base after their anchor, so their alleles begin one base before it.
    """
    starts, q, r = [], 0, 0
    for op, n in cigar:
        starts.append((q, r))
        q += n if op in "=XMIS" else 0
        r += n if op in "=XMDN" else 0

    def entry(at: int) -> int | None:
        return next((k for k, (op, n) in enumerate(cigar) if op in "=XMDN" and starts[k][1] <= at < starts[k][1] + n), None)

    at = [v[0] - pos - (len(v[2]) != len(v[3])) for v in cluster]
    boundary = max(a + len(v[2]) - 1 + right_shift(ref, a + 1, v[2], v[3]) for a, v in zip(at, cluster))
    first, last = entry(at[0]), entry(min(boundary, len(ref) - 1))
    if first is None or last is None or at[0] < 0:
        return None
    left = left_anchor(cigar, first, at[0] - starts[first][1], *starts[first])
    right = right_anchor(cigar, last, 0, *starts[last], boundary)
    if left is None or right is None or not (left[1] <= at[0] and boundary < right[1]):
        return None
    return seq[left[0] : right[0]], ref[left[1] : right[1]], [a - left[1] for a in at]


def windows(reads: DataFrame, variants: DataFrame, bin_size: int = 500, indels: bool = False) -> DataFrame:
    """WINDOWS of reads with `ref`; variants: as text.read_extraction_variants gives them. Clusters of indels alone are left
    out unless indels are asked for, and overlapping variants of a cluster leave the later one out."""
    v = variants.where("het = '1'").select("chrom", F.col("pos").alias("vpos"), F.col("var_ix").alias("snp"), "allele1", "allele2")
    j = interval_join(reads, v, ["chrom"], bin_size, "pos", "end", "vpos")
    key = ["read_id", "flag", "chrom", "pos"]
    g = j.groupBy(*key).agg(F.first("cigar").alias("cigar"), F.first("seq").alias("seq"), F.first("ref").alias("ref"), F.collect_list(F.struct("vpos", "snp", "allele1", "allele2")).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples():
                seq, ref = x.seq.upper(), x.ref.upper()
                cigar = extended_cigar([(o["op"], o["len"]) for o in x.cigar if o["op"] != "H"], seq, ref)
                for cluster in grouped([(v["vpos"], v["snp"], v["allele1"].upper(), v["allele2"].upper()) for v in x.v]):
                    apart = [v for k, v in enumerate(cluster) if not k or v[0] - (len(v[2]) != len(v[3])) >= cluster[k - 1][0] - (len(cluster[k - 1][2]) != len(cluster[k - 1][3])) + len(cluster[k - 1][2])]
                    if not indels and all(len(v[2]) != len(v[3]) for v in apart):
                        continue
                    found = window_of(apart, cigar, seq, ref, x.pos)
                    if found:
                        out.append((x.read_id, found[0], found[1], [v[1] for v in apart], found[2], [v[2] for v in apart], [v[3] for v in apart]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")])

    return g.mapInPandas(run, WINDOWS)


def realigned_calls(reads: DataFrame, variants: DataFrame, summed: bool = False, indels: bool = False) -> DataFrame:
    """(read_id, snp, allele, qv) of reads with `ref`, by realignment to the haplotypes of each cluster under them."""
    found = align.realign(windows(reads, variants, indels=indels), summed)
    kept = variants if indels else variants.where("type = 0")
    return found.join(kept.select(F.col("var_ix").alias("snp")), "snp", "left_semi").select(F.col("read").alias("read_id"), "snp", "allele", "qv")
