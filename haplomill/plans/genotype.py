"""Refining a phased component variant by variant: posteriors with flips, and phased or unphased genotypes.

Each variant sees the changes made to those before it, so a component is worked through in one task, as in phasing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .phase import Component, of_rows

GENOTYPES = ["0/0", "0/1", "1/1", "0|1", "1|0"]
# log10 priors of the five genotypes, and what is then added to them.
PRIORS = np.log10([0.9985, 0.001, 0.0005, 0.0005, 0.0005]) + np.array([-10.0, -3.0, -10.0, 0.0, 0.0])
HALF = np.log10(0.5)
SURE = 0.98
SWEEPS = 4

REFINED = "comp long, snp long, hap int, post_hap double, flipped boolean"
GENOTYPED = "comp long, snp long, hap int, genotype string, posterior double"


class State:
    """Fragment sums under a haplotype whose unphased variants (-1) add nothing; mates count as uncrossed."""

    def __init__(self, c: Component, hap):
        self.c, self.hap = c, np.asarray(hap, dtype=np.int8).copy()
        t0, t1 = c.terms(np.maximum(self.hap, 0))
        counts = self.hap[c.v] >= 0
        self.p0, self.p1 = np.bincount(c.f, t0 * counts, c.m), np.bincount(c.f, t1 * counts, c.m)

    def without(self, i: int):
        """(fragments, their sums without variant i, the variant's terms if its allele is 0)."""
        c, rows = self.c, self.c.rows_of[i]
        f = c.f[rows]
        t0 = np.where(c.a[rows] == 0, c.ok[rows], c.er[rows])
        t1 = np.where(c.a[rows] == 0, c.er[rows], c.ok[rows])
        b0, b1 = self.p0[f], self.p1[f]
        if self.hap[i] >= 0:
            own = (t0, t1) if self.hap[i] == 0 else (t1, t0)
            b0, b1 = b0 - own[0], b1 - own[1]
        return f, b0, b1, t0, t1

    def set(self, i: int, allele: int) -> None:
        f, b0, b1, t0, t1 = self.without(i)
        own = (0, 0) if allele < 0 else (t0, t1) if allele == 0 else (t1, t0)
        self.p0[f], self.p1[f], self.hap[i] = b0 + own[0], b1 + own[1], allele


def _total(x) -> float:
    return float(np.logaddexp.reduce(np.asarray(x) * np.log(10)) / np.log(10))


def sequential_posteriors(c: Component, hap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(haplotype, log10 posterior, flipped): in order, a variant flips where the flip has more than half the posterior."""
    hap = np.asarray(hap, dtype=np.int8).copy()
    post, flipped = np.zeros(c.n), np.zeros(c.n, dtype=bool)
    p, q = c.all_sums(hap)
    for i, rows in enumerate(c.rows_of):
        t, f = c.terms(hap, rows), c.f[rows]
        moved = [p[0][f] - t[0] + t[1], p[1][f] - t[1] + t[0]]
        u = c.crossed(*t, rows) if c.second is not None else t
        crossed = [q[0][f] - u[0] + u[1], q[1][f] - u[1] + u[0]]
        now, flip = c.mixture([x[f] for x in p], [x[f] for x in q], f).sum(), c.mixture(moved, crossed, f).sum()
        total = _total([now, flip])
        flipped[i] = flip - total > HALF
        post[i] = (flip if flipped[i] else now) - total
        if flipped[i]:
            hap[i] ^= 1
            for k in (0, 1):
                p[k][f], q[k][f] = moved[k], crossed[k]
    return hap, post, flipped


def homozygous_posteriors(c: Component, hap, priors) -> tuple[np.ndarray, np.ndarray, list]:
    """(haplotype, log10 posterior, '00', '11' or None): as above with four choices, equal alleles having the prior (log10)
    of each variant; the first of 00, 11 and the flip with more than half the posterior is taken."""
    s, post, equal = State(c, hap), np.zeros(c.n), [None] * c.n
    for i in range(c.n):
        _, b0, b1, t0, t1 = s.without(i)
        both = [c.ll(b0 + t0, b1 + t1).sum(), c.ll(b0 + t1, b1 + t0).sum()]
        prior = float(priors[i])
        het = np.log10(max(0.5 - 10.0**prior, 1e-300))
        x = [het + both[s.hap[i]], het + both[1 - s.hap[i]], prior + c.ll(b0 + t0, b1 + t0).sum(), prior + c.ll(b0 + t1, b1 + t1).sum()]
        y = np.array(x) - _total(x)
        take = next((k for k in (2, 3, 1) if y[k] > HALF), 0)
        post[i] = y[take]
        if take == 1:
            s.set(i, 1 - int(s.hap[i]))
        elif take > 1:
            equal[i] = "00" if take == 2 else "11"
    return s.hap, post, equal


def hypothetical_ll(c: Component, hap, equal: int | None = None, switch: int | None = None, without: int | None = None) -> np.ndarray:
    """Log-likelihood of each fragment with one variant's alleles equal on both copies, with a switch before a variant, or
    with a variant left out; variants by their place in the component. Mates count as uncrossed."""
    hap = np.asarray(hap, dtype=np.int8).copy()
    if switch is not None:
        hap[switch:] ^= 1
    t0, t1 = c.terms(hap)
    if equal is not None:
        t1 = np.where(c.v == equal, t0, t1)
    if without is not None:
        t0, t1 = t0 * (c.v != without), t1 * (c.v != without)
    return c.ll(np.bincount(c.f, t0, c.m), np.bincount(c.f, t1, c.m))


def switch_posteriors(c: Component, hap) -> np.ndarray:
    """Log10 posterior of no switch before each variant (0 before the first): with it against without it, over all fragments."""
    out = np.zeros(c.n)
    now = hypothetical_ll(c, hap).sum()
    for i in range(1, c.n):
        out[i] = now - _total([now, hypothetical_ll(c, hap, switch=i).sum()])
    return out


def scores(s: State, i: int) -> np.ndarray:
    """log10 of prior times likelihood of the five genotypes of a variant."""
    c, rows = s.c, s.c.rows_of[i]
    _, b0, b1, t0, t1 = s.without(i)
    ignored = (c.ll(b0, b1) + HALF).sum()
    zero = c.a[rows] == 0
    ok, er = c.ok[rows], c.er[rows]
    unphased = [np.where(zero, ok, er).sum(), HALF * len(rows), np.where(zero, er, ok).sum()]
    phased = [(c.ll(b0 + t0, b1 + t1) + HALF).sum(), (c.ll(b0 + t1, b1 + t0) + HALF).sum()]
    return np.array([*(x + ignored for x in unphased), *phased]) + PRIORS


def local_genotypes(c: Component, hap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(haplotype with -1 where unphased, genotype number, posterior) after at most SWEEPS sweeps.

    A variant takes a better genotype; one without phase gets phase only at a posterior of SURE.
    """
    s = State(c, hap)
    kind, sure = np.where(s.hap == 0, 3, np.where(s.hap == 1, 4, 1)), np.zeros(c.n)
    for _ in range(SWEEPS):
        moved = False
        for i in range(c.n):
            x = scores(s, i)
            best = int(x.argmax())
            if best != kind[i] and x[best] > x[kind[i]] and (kind[i] >= 3 or best < 3 or 10 ** (x[best] - _total(x)) >= SURE):
                moved |= best >= 3 or kind[i] >= 3
                kind[i] = best
                s.set(i, best - 3 if best >= 3 else -1)
            sure[i] = 10 ** (x[kind[i]] - _total(x))
        if not moved:
            break
    return s.hap, kind, sure


def _component(pdf: pd.DataFrame) -> tuple[Component, np.ndarray]:
    return of_rows(pdf), pdf.groupby("snp").hap.first().to_numpy()


def refine(calls: DataFrame, phased: DataFrame) -> DataFrame:
    """REFINED; phased has comp, snp, hap. Variants outside every component are not in the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, hap = _component(pdf)
        hap, post, flipped = sequential_posteriors(c, hap)
        return pd.DataFrame({"comp": pdf.comp.iloc[0], "snp": c.snps, "hap": hap.astype(np.int32), "post_hap": post, "flipped": flipped})

    return _rows(calls).join(phased.select("comp", "snp", "hap"), "snp").groupBy("comp").applyInPandas(run, REFINED)


def _rows(calls: DataFrame) -> DataFrame:
    return calls.select("frag", "snp", "allele", "qv", *[c for c in ("mate2_ix", "h") if c in calls.columns])


def call_homozygous(calls: DataFrame, phased: DataFrame, priors: DataFrame) -> DataFrame:
    """comp, snp, hap, post_hap, homozygous: as refine, with equal alleles as choices; priors: snp, homozygous_prior (log10)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, hap = _component(pdf)
        hap, post, equal = homozygous_posteriors(c, hap, pdf.groupby("snp").homozygous_prior.first().to_numpy())
        return pd.DataFrame({"comp": pdf.comp.iloc[0], "snp": c.snps, "hap": hap.astype(np.int32), "post_hap": post, "homozygous": equal})

    rows = _rows(calls).join(phased.select("comp", "snp", "hap"), "snp").join(priors.select("snp", "homozygous_prior"), "snp")
    return rows.groupBy("comp").applyInPandas(run, "comp long, snp long, hap int, post_hap double, homozygous string")


def switch_scores(calls: DataFrame, phased: DataFrame) -> DataFrame:
    """comp, snp, post_notsw of every phased variant."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, hap = _component(pdf)
        return pd.DataFrame({"comp": pdf.comp.iloc[0], "snp": c.snps, "post_notsw": switch_posteriors(c, hap)})

    return _rows(calls).join(phased.select("comp", "snp", "hap"), "snp").groupBy("comp").applyInPandas(run, "comp long, snp long, post_notsw double")


def genotype(calls: DataFrame, phased: DataFrame) -> DataFrame:
    """GENOTYPED; hap is null where the genotype has no phase."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, hap = _component(pdf)
        hap, kind, sure = local_genotypes(c, hap)
        return pd.DataFrame({"comp": pdf.comp.iloc[0], "snp": c.snps, "hap": pd.array([int(h) if h >= 0 else None for h in hap], dtype="Int32"), "genotype": [GENOTYPES[k] for k in kind], "posterior": sure})

    return calls.select("frag", "snp", "allele", "qv").join(phased.select("comp", "snp", "hap"), "snp").groupBy("comp").applyInPandas(run, GENOTYPED)
