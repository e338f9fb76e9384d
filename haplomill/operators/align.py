"""Realignment of read windows to the haplotypes of a cluster of close variants.

Built-in functions can't express an alignment, so windows run through mapInPandas: each row is one read over one
cluster, rows are independent of each other and nothing is shuffled. All haplotypes of a cluster are scored at once,
as one numpy axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Alignment scores, emission and transition probabilities.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 2.0, -5.0, -2.0, -1.0
P_MATCH, P_MISMATCH = 0.97, 0.01
M_TO_M, M_TO_I, M_TO_D = 0.892, 0.071, 0.037
I_TO_M, I_TO_I = 0.740, 0.26
D_TO_M, D_TO_D = 0.88, 0.12

MOST_VARIANTS = 10
LEAST_WINDOW, MOST_WINDOW = 10, 200
CALLED = "read string, snp long, allele int, qv int"


def _padded(haps: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Upper-case bytes (haplotype, position), short ones filled with 0, and the lengths."""
    sizes = np.array([len(h) for h in haps])
    out = np.zeros((len(haps), max(sizes.max(initial=0), 1)), dtype=np.uint8)
    for row, h in zip(out, haps):
        row[: len(h)] = np.frombuffer(h.upper().encode("latin-1", "replace"), np.uint8)
    return out, sizes


def forward(read: str, haps: list[str]) -> np.ndarray:
    """log10 of the summed probability of all alignments of the whole read to each whole haplotype.

    States are match, insertion (a base of the read alone) and deletion; every row is scaled by its largest value, so
    nothing underflows. An empty read or haplotype has only gaps.
    """
    b, sizes = _padded(haps)
    n = b.shape[1]
    m, i, d = (np.zeros((n + 1, len(haps))) for _ in range(3))
    m[0] = 1
    for j in range(1, n + 1):
        d[j] = m[j - 1] * M_TO_D + d[j - 1] * D_TO_D
    scale = np.zeros(len(haps))
    for base in np.frombuffer(read.upper().encode("latin-1", "replace"), np.uint8):
        emit = np.where(b.T == base, P_MATCH, P_MISMATCH)
        m2, i2, d2 = np.zeros_like(m), m * M_TO_I + i * I_TO_I, np.zeros_like(d)
        m2[1:] = emit * (m[:-1] * M_TO_M + i[:-1] * I_TO_M + d[:-1] * D_TO_M)
        for j in range(1, n + 1):
            d2[j] = m2[j - 1] * M_TO_D + d2[j - 1] * D_TO_D
        top = np.maximum(np.maximum(m2.max(0), i2.max(0)), 1e-300)
        m, i, d = m2 / top, i2 / top, d2 / top
        scale += np.log10(top)
    at = (sizes, np.arange(len(haps)))
    return np.log10(np.maximum(m[at] + i[at] + d[at], 1e-300)) + scale


def best_score(read: str, haps: list[str]) -> np.ndarray:
    """Best affine-gap score of the whole read against each haplotype from its start; what follows the read is free.

    A gap of k bases costs GAP_OPEN + k * GAP_EXTEND.
    """
    b, sizes = _padded(haps)
    n = b.shape[1]
    low = -1e9
    first, more = GAP_OPEN + GAP_EXTEND, GAP_EXTEND
    outside = np.arange(n + 1)[:, None] > sizes[None, :]

    def across(m: np.ndarray, i: np.ndarray) -> np.ndarray:
        d = np.full_like(m, low)
        for j in range(1, n + 1):
            d[j] = np.maximum(np.maximum(m[j - 1], i[j - 1]) + first, d[j - 1] + more)
        return d

    m, i = np.full((n + 1, len(haps)), low), np.full((n + 1, len(haps)), low)
    m[0] = 0
    d = across(m, i)
    for base in np.frombuffer(read.upper().encode("latin-1", "replace"), np.uint8):
        m2, i2 = np.full_like(m, low), np.maximum(np.maximum(m, d) + first, i + more)
        m2[1:] = np.where(b.T == base, MATCH, MISMATCH) + np.maximum(np.maximum(m, i), d)[:-1]
        m, i = m2, i2
        d = across(m, i)
    return np.where(outside, low, np.maximum(np.maximum(m, i), d)).max(0)


def spelled(window: str, offsets: list[int], refs: list[str], alts: list[str]) -> list[str]:
    """The 2**n haplotypes of a window; bit k of a haplotype's number says that variant k has its alternative allele.

    offsets count from 0 in the window; variants come in rising order and don't overlap.
    """
    out = [""]
    at = 0
    for o, r, a in zip(offsets, refs, alts):
        keep = window[at:o]
        out = [h + keep + x for x in (r, a) for h in out]  # the later variant is the higher bit
        at = o + len(r)
    return [h + window[at:] for h in out]


def _log_sum(x: np.ndarray) -> float:
    top = x.max()
    return float(top + np.log10((10.0 ** (x - top)).sum()))


def posterior_calls(scores: np.ndarray, n: int, min_q: int = 6) -> list[tuple[int, int] | None]:
    """(allele, quality) of each of n variants from the log10 scores of 2**n haplotypes; None below min_q.

    The best haplotype, the lowest number among equals, gives the allele; the quality is what is left for the other.
    """
    total, best = _log_sum(scores), int(scores.argmax())
    number = np.arange(1 << n)
    out: list[tuple[int, int] | None] = []
    for k in range(n):
        allele = best >> k & 1
        other = _log_sum(scores[(number >> k & 1) != allele]) - total
        q = min(93, int(-10 * other))
        out.append((allele, q) if q >= min_q else None)
    return out


def realign(windows: DataFrame, summed: bool = True, min_q: int = 6) -> DataFrame:
    """CALLED, a row per call: windows has read, seq, window, snps, offsets, refs, alts (arrays of one cluster).

    summed: score by all alignments (long noisy reads), else by the best one. Rows with a null, without variants, with
    more than MOST_VARIANTS of them or with a sequence outside LEAST_WINDOW to MOST_WINDOW bases give no call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for read, seq, window, snps, offsets, refs, alts in pdf.itertuples(index=False, name=None):
                if any(x is None for x in (seq, window, snps, offsets, refs, alts)) or not 0 < len(snps) <= MOST_VARIANTS:
                    continue
                if not all(LEAST_WINDOW <= len(x) <= MOST_WINDOW for x in (seq, window)):
                    continue
                haps = spelled(window, offsets, refs, alts)
                found = posterior_calls((forward if summed else best_score)(seq, haps), len(snps), min_q)
                rows += [(read, int(s), *c) for s, c in zip(snps, found) if c is not None]
            yield pd.DataFrame(rows, columns=["read", "snp", "allele", "qv"])

    return windows.select("read", "seq", "window", "snps", "offsets", "refs", "alts").mapInPandas(run, CALLED)
