import numpy as np

from haplomill.plans import genotype as G
from haplomill.plans.phase import Component


def planted(n=8, frags=60, seed=4, hom=()):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, n)
    rows = []
    for f in range(frags):
        at, side = rng.integers(0, n - 3), f % 2
        for v in range(at, at + 4):
            a = 1 if v in hom else int(truth[v]) ^ side
            rows.append((f, v, a ^ int(rng.random() < 0.01), 20))
    return truth, rows


def test_sums_follow_changes_and_flips_repair():
    truth, rows = planted()
    c = Component(*map(np.array, zip(*rows)))
    wrong = truth.copy()
    wrong[3] ^= 1
    hap, post, flipped = G.sequential_posteriors(c, wrong)
    assert (hap == truth).all() and flipped.tolist() == [i == 3 for i in range(8)] and (post > np.log10(0.9)).all()
    s = G.State(c, truth)
    for i, a in ((2, -1), (5, 1), (2, 0), (2, -1)):
        s.set(i, a)
    fresh = G.State(c, s.hap)
    assert np.allclose(s.p0, fresh.p0) and np.allclose(s.p1, fresh.p1)


def test_genotypes(spark):
    truth, rows = planted(frags=200, hom=(6,))  # at a few calls the priors favour a mixed genotype
    calls = spark.createDataFrame(rows, "frag long, snp long, allele int, qv int")
    phased = spark.createDataFrame([(0, v, int(truth[v])) for v in range(8)], "comp long, snp long, hap int")
    found = {r.snp: r for r in G.genotype(calls, phased).collect()}
    assert found[6].genotype == "1/1" and found[6].hap is None
    assert all(found[v].hap == truth[v] and found[v].genotype == ("1|0" if truth[v] else "0|1") for v in range(8) if v != 6)
    assert {r.snp: r.hap for r in G.refine(calls, phased).where("snp <> 6").collect()} == {v: int(truth[v]) for v in range(8) if v != 6}
    assert G.refine(calls.limit(0), phased).count() == 0
