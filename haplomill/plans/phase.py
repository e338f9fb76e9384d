"""Maximum-likelihood phasing of connected components.

A component is the unit in which haplotypes are defined, so its calls meet in one task; components run in parallel.
Within one, a haplotype is improved by single flips and by greedy max-cuts: cuts begin at edges that the haplotype
contradicts, variants are added to the shore that the likelihoods of their fragments favour, and the other shore is
flipped if the likelihood of the fragments gains by it. An exact check follows in narrow components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.calls import adjacent_edges
from .components import connected_components

PHASED = "comp long, snp long, hap int, ll double"
NARROW = 10  # components of so many variants at most are checked against all haplotypes
NEVER = -80.0  # fixed: log10 probability of crossing where nothing is known


class Component:
    """The calls of a component. With crossing probabilities, a fragment is a mixture of one whose mates lie on the same
    haplotype and one whose second mate (variants from mate2 on) lies on the other."""

    def __init__(self, frag, snp, allele, qv, mate2=None, h=None):
        self.snps, self.v = np.unique(snp, return_inverse=True)
        _, self.f = np.unique(frag, return_inverse=True)
        self.a = np.asarray(allele, dtype=np.int8)
        e = 10.0 ** (-np.asarray(qv, dtype=float) / 10)
        self.ok, self.er = np.log10(np.clip(1 - e, 1e-12, 1)), np.log10(np.clip(e, 1e-12, 1))
        self.n, self.m = len(self.snps), int(self.f.max()) + 1
        order = np.argsort(self.v, kind="stable")
        self.rows_of = np.split(order, np.cumsum(np.bincount(self.v, minlength=self.n))[:-1])
        self.calls_of = np.split(np.argsort(self.f, kind="stable"), np.cumsum(np.bincount(self.f, minlength=self.m))[:-1])
        self.edges = self._edges()
        self.second = None
        if h is not None:
            log_h = np.full(self.m, NEVER)
            log_h[self.f] = np.where(np.isnan(h), NEVER, h)
            mate2 = np.where(np.isnan(mate2), np.inf, np.asarray(mate2, dtype=float))
            self.second = np.asarray(snp) >= mate2
            self.mixed = np.log10(-np.expm1(np.minimum(log_h, -1e-12) * np.log(10))), log_h

    def _edges(self):
        """Log-odds that two variants of a fragment carry equal alleles, summed over fragments; all pairs of its calls."""
        order = np.lexsort((self.v, self.f))
        f, v, a = self.f[order], self.v[order], self.a[order]
        e = 10.0 ** self.er[order]
        parts, held, d, first = [], 0, 0, np.arange(len(f))
        while True:
            d += 1
            first = first[first + d < len(f)]
            first = first[f[first] == f[first + d]]
            if not len(first):
                break
            i, j = first, first + d
            alike = (1 - e[i]) * (1 - e[j]) + e[i] * e[j]
            w = np.log10(alike / np.maximum(1 - alike, 1e-12)) * np.where(a[i] == a[j], 1, -1)
            parts.append((v[i] * self.n + v[j], w))
            held += len(i)
            if held > 5_000_000:
                parts = [self._added(parts)]
                held = len(parts[0][0])
        if not parts:
            return [], [], []
        key, w = self._added(parts)
        return key // self.n, key % self.n, w

    @staticmethod
    def _added(parts):
        key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(at, weights=np.concatenate([w for _, w in parts]))

    def terms(self, hap, rows=slice(None)):
        match = self.a[rows] == hap[self.v[rows]]
        return np.where(match, self.ok[rows], self.er[rows]), np.where(match, self.er[rows], self.ok[rows])

    def sums(self, hap):
        t0, t1 = self.terms(hap)
        return np.bincount(self.f, t0, self.m), np.bincount(self.f, t1, self.m)

    def crossed(self, t0, t1, rows=slice(None)):
        """The terms of calls if the mates lie on different haplotypes."""
        return np.where(self.second[rows], t1, t0), np.where(self.second[rows], t0, t1)

    @staticmethod
    def ll(p0, p1):
        return np.logaddexp(p0 * np.log(10), p1 * np.log(10)) / np.log(10)

    def mixture(self, p, q, f=slice(None)):
        """Log-likelihoods of fragments from their sums as they are (p) and with mates on different haplotypes (q)."""
        if self.second is None:
            return self.ll(*p)
        return self.ll(self.ll(*p) + self.mixed[0][f], self.ll(*q) + self.mixed[1][f])

    def all_sums(self, hap):
        t = self.terms(hap)
        p = np.bincount(self.f, t[0], self.m), np.bincount(self.f, t[1], self.m)
        if self.second is None:
            return p, p
        u = self.crossed(*t)
        return p, (np.bincount(self.f, u[0], self.m), np.bincount(self.f, u[1], self.m))

    def score(self, hap):
        return float(self.mixture(*self.all_sums(hap)).sum())

    def spanning_start(self):
        """Follow the strongest edges first."""
        i, j, w = self.edges
        root, sign = np.arange(self.n), np.zeros(self.n, dtype=np.int8)
        members = {k: [k] for k in range(self.n)}
        for k in np.argsort(-np.abs(w)):
            a, b = root[i[k]], root[j[k]]
            if a == b:
                continue
            differ = int(sign[i[k]] != sign[j[k]]) != int(w[k] < 0)
            if len(members[a]) < len(members[b]):
                a, b = b, a
            for x in members.pop(b):
                root[x] = a
                sign[x] ^= differ
                members[a].append(x)
        return sign.copy()

    def flips(self, hap):
        p, q = self.all_sums(hap)
        now = self.mixture(p, q)
        gained = False
        for i, rows in enumerate(self.rows_of):
            t, f = self.terms(hap, rows), self.f[rows]
            moved = [p[0][f] - t[0] + t[1], p[1][f] - t[1] + t[0]]
            crossed = moved
            if self.second is not None:
                u = self.crossed(*t, rows)
                crossed = [q[0][f] - u[0] + u[1], q[1][f] - u[1] + u[0]]
            new = self.mixture(moved, crossed, f)
            if new.sum() > now[f].sum() + 1e-9:
                hap[i] ^= 1
                for k in (0, 1):
                    p[k][f] = moved[k]
                    if self.second is not None:
                        q[k][f] = crossed[k]
                now[f] = new
                gained = True
        return gained

    def agreement(self, hap):
        """The weight by which hap agrees with each edge."""
        i, j, w = self.edges
        return np.where(hap[i] == hap[j], w, -w)

    def cut(self, hap, start, other=None):
        """One greedy cut from a variant, or from two on opposite shores; the second shore as a mask.

        The variant whose place is clearest comes next. Its pull is how much likelier its fragments are, given their calls
        on both shores so far, with the variant as hap has it than with its other allele; what is placed updates the
        likelihoods of its fragments, and these the pulls of their other variants.
        """
        import heapq

        t = self.terms(hap)
        u = t if self.second is None else self.crossed(*t)
        sums = [np.zeros(self.m) for _ in range(4)]
        gain, shore, pull = np.zeros(len(self.f)), np.zeros(self.n, dtype=np.int8), np.zeros(self.n)
        heap: list[tuple[float, int]] = []

        def place(v, s):
            shore[v] = s
            rows = self.rows_of[v]
            for k, x in enumerate((*t, *u) if s > 0 else (t[1], t[0], u[1], u[0])):
                sums[k][self.f[rows]] += x[rows]
            near = np.concatenate([self.calls_of[f] for f in self.f[rows]])
            near = near[shore[self.v[near]] == 0]
            if not len(near):
                return
            f = self.f[near]
            base = [x[f] for x in sums]
            kept = self.mixture((base[0] + t[0][near], base[1] + t[1][near]), (base[2] + u[0][near], base[3] + u[1][near]), f)
            turned = self.mixture((base[0] + t[1][near], base[1] + t[0][near]), (base[2] + u[1][near], base[3] + u[0][near]), f)
            np.add.at(pull, self.v[near], kept - turned - gain[near])
            gain[near] = kept - turned
            for b in set(self.v[near].tolist()):
                heapq.heappush(heap, (-abs(pull[b]), b))

        place(start, 1)
        if other is not None:
            place(other, -1)
        while heap:
            p, v = heapq.heappop(heap)
            if not shore[v] and -p == abs(pull[v]):
                place(v, 1 if pull[v] >= 0 else -1)
        return shore == -1

    def optimum(self):
        """The best of all haplotypes and its score; the first variant's allele is 0, as the complement scores the same."""
        def moves(t):
            by = np.zeros((self.m, self.n))
            np.add.at(by, (self.f, self.v), t[1] - t[0])
            return by.T

        zero = np.zeros(self.n, dtype=np.int8)
        t = self.terms(zero)
        p, q = self.all_sums(zero)
        kept = moves(t)
        crossed = kept if self.second is None else moves(self.crossed(*t))
        top, found, step = -np.inf, None, max(1, 1_000_000 // self.m)
        for first in range(0, 1 << (self.n - 1), step):
            masks = np.arange(first, min(first + step, 1 << (self.n - 1)))
            haps = (masks[:, None] << 1 >> np.arange(self.n)) & 1
            x, y = haps @ kept, haps @ crossed
            values = self.mixture((p[0] + x, p[1] - x), (q[0] + y, q[1] - y)).sum(axis=1)
            k = int(values.argmax())
            if values[k] > top:
                top, found = float(values[k]), haps[k].astype(np.int8)
        return found, top

    def solve(self, patience: int = 5, passes: int = 10_000):
        """Flips and at most one cut in each pass, until more than `patience` passes in turn bring no gain.

        The search of a narrow component ends as soon as no haplotype is better; where it stays below, the best one is taken.

        A pass starts cuts from the edges that the haplotype contradicts most, one more than `patience`, then from
        max(1, n / 10) random edges or variants. It ends once more than `patience` of them were no better than the best one
        so far, and the best is taken if it brings a gain.
        """
        hap = self.spanning_start()
        if not len(self.edges[0]):
            return hap, self.score(hap)
        proven, goal = self.optimum() if self.n <= NARROW else (None, np.inf)
        i, j, _ = self.edges
        drawn = np.random.default_rng(self.n)
        best, failed, agree = self.score(hap), 0, None
        for _ in range(passes):
            if self.flips(hap):
                agree = None
            now = max(best, self.score(hap))
            if now >= goal - 1e-9:
                best = now
                break
            starts = []
            if agree is None:  # else the haplotype is that of the last pass, where these starts failed
                agree = self.agreement(hap)
                starts = [(i[k], j[k]) for k in np.argsort(agree, kind="stable")[: patience + 1]]
            for k in drawn.integers(0, len(i), max(1, self.n // 10)):
                starts.append((i[k], j[k]) if agree[k] < 1 else (drawn.integers(0, self.n), None))
            top, found, vain = -np.inf, None, 0
            for start in starts:
                trial = hap.copy()
                trial[self.cut(hap, *start)] ^= 1
                value = self.score(trial)
                if value > top + 1e-9:
                    top, found = value, trial
                else:
                    vain += 1
                if vain > patience:
                    break
            if top > now + 1e-9:
                hap, now, agree = found, top, None
            failed = 0 if now > best + 1e-9 else failed + 1
            best = now
            if failed > patience:
                break
        if proven is not None and goal > best + 1e-9:
            hap, best = proven, self.score(proven)
        return hap ^ hap[0], best


def of_rows(pdf: pd.DataFrame) -> Component:
    """The component of rows frag, snp, allele, qv, and mate2_ix and h where mates may cross."""
    more = (pdf.mate2_ix.to_numpy(float), pdf.h.to_numpy(float)) if "h" in pdf.columns else ()
    return Component(pdf.frag.to_numpy(), pdf.snp.to_numpy(), pdf.allele.to_numpy(), pdf.qv.to_numpy(), *more)


def phase(calls: DataFrame, patience: int = 5) -> DataFrame:
    """(comp, snp, hap, ll): haplotype of every variant in a component, its first variant's allele being 0.

    Where calls have mate2_ix and h (log10), the mates of a fragment lie on different haplotypes with that probability.
    """
    comps = connected_components(adjacent_edges(calls)).select(F.col("node").alias("snp"), F.col("component").alias("comp"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = of_rows(pdf)
        hap, ll = c.solve(patience)
        return pd.DataFrame({"comp": pdf.comp.iloc[0], "snp": c.snps, "hap": hap.astype(np.int32), "ll": ll})

    return calls.join(comps, "snp").groupBy("comp").applyInPandas(run, PHASED)


def exact_phase(calls: DataFrame, comp, width: int) -> DataFrame:
    """Best haplotype of narrow components by enumeration; ties go to the lowest mask. Bit k is the k-th variant's allele."""
    from ..operators.likelihood import log_err, log_ok, log_sum

    t = calls.withColumn("comp", comp)
    f = t.groupBy("comp", "frag").agg(F.collect_list(F.struct((F.col("snp") % width).alias("k"), "allele", log_ok().alias("ok"), log_err().alias("er"))).alias("c"))
    at = f.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** (width - 1) - 1))))

    def side(flip):
        return F.aggregate("c", F.lit(0.0), lambda s, x: s + F.when((x.allele == (F.floor(F.col("mask") / F.pow(F.lit(2), x.k)) % 2)) == F.lit(not flip), x.ok).otherwise(x.er))

    s = at.select("comp", "mask", log_sum(side(False), side(True)).alias("ll")).groupBy("comp", "mask").agg(F.round(F.sum("ll"), 6).alias("ll"))
    best = s.groupBy("comp").agg(F.max(F.struct("ll", (-F.col("mask")).alias("neg"))).alias("b"))
    return best.select("comp", (-F.col("b.neg")).alias("mask"), F.col("b.ll").alias("ll"))


def block_table(calls: DataFrame) -> DataFrame:
    """One row per component: first and last index, variants, fragments (by their first variant)."""
    comps = connected_components(adjacent_edges(calls)).select(F.col("node").alias("snp"), F.col("component").alias("comp"))
    b = comps.groupBy("comp").agg(F.min("snp").alias("first_ix"), F.max("snp").alias("last_ix"), F.count("*").alias("phased"))
    first = calls.groupBy("frag").agg(F.min("snp").alias("snp")).join(comps, "snp").groupBy("comp").agg(F.count("*").alias("fragments"))
    return b.join(first, "comp", "left").select("comp", "first_ix", "last_ix", "phased", F.coalesce("fragments", F.lit(0)).alias("fragments"))
