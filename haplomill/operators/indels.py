"""Indel alleles of aligned reads: exact CIGAR matches, comparison with both alleles, shifts and anchors.

What follows is per read and variant and needs no shuffle; it walks along two strings, which built-in functions can't
express, so rows run through mapInPandas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Bases compared on each side, quality of a call, and of one that is better by a single base.
COMPARED, SURE, UNSURE = 10, 20, 13
ANCHOR = 8
CALLED = "read_id string, snp long, allele int, qv int"


def right_shift(ref: str, at: int, allele1: str, allele2: str) -> int:
    """How many bases an indel can move to the right without changing the sequence; `at` is the index in ref of the base
    after its anchor."""
    n = len(ref)
    if len(allele1) > len(allele2) == 1:
        gone = len(allele1) - 1
        k = 0
        while at + k + gone < n and ref[at + k] == ref[at + k + gone]:
            k += 1
        return k
    if len(allele2) > len(allele1) == 1:
        new = allele2[1:]
        k = next((i for i, c in enumerate(new) if at + i >= n or ref[at + i] != c), len(new))
        if k == len(new):  # the whole insertion is repeated in the reference
            while at + k < n and ref[at + k - len(new)] == ref[at + k]:
                k += 1
        return k
    return 0


def _mismatches(read: str, wanted: str) -> tuple[np.ndarray, np.ndarray]:
    """Running counts of mismatches and of compared bases, N excepted; beyond the wanted text nothing mismatches."""
    r = np.frombuffer(read.encode("latin-1", "replace"), np.uint8)
    w = np.zeros(len(r), np.uint8)
    w[: len(wanted)] = np.frombuffer(wanted.encode("latin-1", "replace"), np.uint8)[: len(r)]
    known = r != ord("N")
    return np.concatenate(([0], np.cumsum(known & (w != 0) & (r != w)))), np.concatenate(([0], np.cumsum(known)))


def _rightward(tail: str, allele1: str, allele2: str, after: str) -> tuple[int, int]:
    """Mismatches of a read's tail with either allele and the reference behind it; it stops once they differ by two and
    ten bases of each were compared."""
    (m1, n1), (m2, n2) = _mismatches(tail, allele1[1:] + after), _mismatches(tail, allele2[1:] + after)
    a, b = len(allele1) - 1, len(allele2) - 1
    steps = np.arange(max(len(tail) - a, len(tail) - b, 0) + 1)
    i, j = np.minimum(a + steps, len(tail)), np.minimum(b + steps, len(tail))
    done = (np.abs(m1[i] - m2[j]) > 1) & (n1[i] >= COMPARED) & (n2[j] >= COMPARED)
    done[0] = False
    at = int(done.argmax()) if done.any() else len(steps) - 1
    return int(m1[i[at]]), int(m2[j[at]])


def _leftward(head: str, ref_head: str, allele1: str, allele2: str) -> tuple[int, int, bool]:
    """Mismatches to the left of an indel's end, of at least ten bases: with the reference, and with the second allele in
    place of the first; whether the read begins inside that allele. head ends with the base that aligns with the end of
    the first allele, as ref_head does."""
    back, plain = head[::-1], ref_head[::-1]
    other = allele2[::-1] + ref_head[: max(len(ref_head) - len(allele1), 0)][::-1]
    out = []
    for wanted, least in ((plain, 0), (other, len(allele2))):
        m, n = _mismatches(back[: len(wanted)], wanted)
        stop = max(least, int(np.searchsorted(n, COMPARED)))
        out.append(int(m[min(stop, len(m) - 1)]))
    return out[0], out[1], len(head) < len(allele2)


def compare(read: str, ref: str, read_at: int, ref_at: int, n: int, variant_at: int, allele1: str, allele2: str, first: bool, last: bool) -> tuple[int, int] | None:
    """(allele, quality) that an aligned stretch of n bases shows at an indel, or None.

    The stretch begins at read[read_at] and ref[ref_at]; variant_at is the index in ref of the base after the anchor.
    first and last say whether only a clip stands before and after the stretch: an alternative allele is believed only if
    the alignment had no other way to show it.
    """
    offset = variant_at - ref_at
    end = read_at + offset + len(allele1) - 2  # aligns with the end of the first allele
    s1, s2 = _rightward(read[read_at + offset : read_at + n], allele1, allele2, ref[variant_at - 1 + len(allele1) :])
    s3 = s4 = 0
    partial = False
    if end < n:
        s3, s4, partial = _leftward(read[: end + 1], ref[: variant_at - 1 + len(allele1)], allele1, allele2)
    allele, quality = None, SURE
    if s1 < s2:
        allele = 0 if s3 < s4 else 1 if s4 == 0 and s3 >= 2 else None
        believed = first
    elif s2 < s1:
        allele = 1 if s3 < s4 and (s1 - s2 >= 2 or s2 == 0) else None
        believed, quality = last, UNSURE if s1 - s2 == 1 else SURE
    else:
        allele = 1 if s3 > s4 and s3 - s4 >= 2 and s4 < 2 else None
        believed = last
    if allele == 1 and (partial or not believed):
        return None
    return None if allele is None else (allele, quality)


def extended_cigar(cigar: list[tuple[str, int]], read: str, ref: str) -> list[tuple[str, int]]:
    """A CIGAR whose aligned stretches are split into equal ones (=) and single mismatches (X); N in the read is equal."""
    out, q, r = [], 0, 0
    for op, n in cigar:
        if op == "M":
            same = [a in (b, "N") for a, b in zip(read[q : q + n].upper(), ref[r : r + n].upper())]
            run = 0
            for ok in same:
                if ok:
                    run += 1
                    continue
                if run:
                    out.append(("=", run))
                out.append(("X", 1))
                run = 0
            if run:
                out.append(("=", run))
        else:
            out.append((op, n))
        q += n if op in "MIS=X" else 0
        r += n if op in "MDN=X" else 0
    return out


def left_anchor(cigar: list[tuple[str, int]], at: int, offset: int, read_at: int, ref_at: int, least: int = ANCHOR) -> tuple[int, int] | None:
    """(read, reference) offsets where the last `least` equal bases before a variant begin; cigar is extended, the variant
    lies `offset` bases into its entry `at`, which begins at read_at and ref_at. None if a clip or the start comes first."""
    op, n = cigar[at]
    if op == "=" and least <= offset <= n:
        return read_at + offset - least, ref_at + offset - least
    for op, n in reversed(cigar[:at]):
        if op == "S":
            return None
        read_at -= n if op in "=XMI" else 0
        ref_at -= n if op in "=XMDN" else 0
        if op == "=" and n >= least:
            return read_at + n - least, ref_at + n - least
    return None


def right_anchor(cigar: list[tuple[str, int]], at: int, offset: int, read_at: int, ref_at: int, boundary: int, least: int = ANCHOR) -> tuple[int, int] | None:
    """(read, reference) offsets one past the first `least` equal bases that begin at or after the variant's last base;
    boundary is that base's reference offset."""
    for k in range(at, len(cigar)):
        op, n = cigar[k]
        if op == "S":
            return None
        skip = offset if k == at else 0
        if op == "=":
            begin = max(skip, boundary + 1 - ref_at)
            if n - begin >= least:
                return read_at + begin + least, ref_at + begin + least
        read_at += n if op in "=XMI" else 0
        ref_at += n if op in "=XMDN" else 0
    return None


def call_indels(reads: DataFrame, variants: DataFrame, bin_size: int = 500) -> DataFrame:
    """(read_id, snp, allele, qv) of heterozygous indels under reads with `ref` (params.with_reference gives it).

    An insertion or deletion of the variant's place and length is the second allele, with the base quality there; where
    bases are aligned across the place, both alleles are compared. variants: as text.read_extraction_variants gives them.
    """
    from .link import interval_join

    v = variants.where("het = '1' AND type <> 0").select("chrom", F.col("pos").alias("vpos"), F.col("var_ix").alias("snp"), "allele1", "allele2", "type")
    j = interval_join(reads, v, ["chrom"], bin_size, "pos", "end", "vpos").select("read_id", "snp", "cigar", "seq", "qual", "ref", "pos", "vpos", "allele1", "allele2", "type")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b.itertuples():
                ops = [(o["op"], o["len"]) for o in x.cigar]
                seq, ref, at = x.seq.upper(), x.ref.upper(), x.vpos - x.pos
                q = r = 0
                solid = [k for k, (op, _) in enumerate(ops) if op != "H"]
                for k, (op, n) in enumerate(ops):
                    if op in "ID" and r == at and (n if op == "I" else -n) == x.type:
                        out.append((x.read_id, x.snp, 1, ord(x.qual[q]) - 33))
                        break
                    if op == "M" and r <= at < r + n - 1:
                        first = k == solid[0] or (k == solid[0] + 1 and ops[solid[0]][0] == "S")
                        last = k == solid[-1] or (len(solid) > 1 and k == solid[-2] and ops[solid[-1]][0] == "S")
                        found = compare(seq, ref, q, r, n, at, x.allele1, x.allele2, first, last)
                        if found:
                            out.append((x.read_id, x.snp, *found))
                        break
                    q += n if op in "MIS" else 0
                    r += n if op in "MDN" else 0
            yield pd.DataFrame(out, columns=["read_id", "snp", "allele", "qv"])

    return j.mapInPandas(run, CALLED)
