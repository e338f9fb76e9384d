import itertools
import math
import random

import numpy as np

from haplomill.operators import align as A


def every_path(read, hap):
    """Sum over all alignments, by recursion on states."""
    def go(i, j, state):
        total = 1.0 if (i, j) == (len(read), len(hap)) else 0.0
        to = {"m": (A.M_TO_M, A.M_TO_I, A.M_TO_D), "i": (A.I_TO_M, A.I_TO_I, 0), "d": (A.D_TO_M, 0, A.D_TO_D)}[state]
        if i < len(read) and j < len(hap):
            total += to[0] * (A.P_MATCH if read[i] == hap[j] else A.P_MISMATCH) * go(i + 1, j + 1, "m")
        if i < len(read) and to[1]:
            total += to[1] * go(i + 1, j, "i")
        if j < len(hap) and to[2]:
            total += to[2] * go(i, j + 1, "d")
        return total
    return math.log10(go(0, 0, "m"))


def best_path(read, hap):
    def go(i, j, state):
        out = [0.0] if i == len(read) else []
        if i < len(read) and j < len(hap):
            out.append((A.MATCH if read[i] == hap[j] else A.MISMATCH) + go(i + 1, j + 1, "m"))
        if i < len(read):
            out.append(A.GAP_EXTEND + (0 if state == "i" else A.GAP_OPEN) + go(i + 1, j, "i"))
        if j < len(hap):
            out.append(A.GAP_EXTEND + (0 if state == "d" else A.GAP_OPEN) + go(i, j + 1, "d"))
        return max(out)
    return go(0, 0, "m")


def test_scores_equal_enumeration():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 5)))
    for _ in range(25):
        read, haps = word(), [word() for _ in range(3)]
        assert np.allclose(A.forward(read, haps), [every_path(read, h) for h in haps])
        assert np.allclose(A.best_score(read, haps), [best_path(read, h) for h in haps])


def test_spelled_haplotypes():
    assert A.spelled("AACCGG", [1, 3], ["A", "CG"], ["T", "C"]) == ["AACCGG", "ATCCGG", "AACCG", "ATCCG"]


def test_long_windows_stay_finite():
    assert np.isfinite(A.forward("ACGT" * 50, ["TGCA" * 50, "A"])).all()


def test_realign(spark):
    window = "ACGTTGCAAGCTTAGGCATC"
    haps = A.spelled(window, [5, 12], ["G", "T"], ["C", "TA"])
    rows = [(f"r{k}", h, window, [7, 8], [5, 12], ["G", "T"], ["C", "TA"]) for k, h in enumerate(haps)]
    rows += [("null", None, window, [7], [5], ["G"], ["C"]), ("short", "ACG", window, [7], [5], ["G"], ["C"]), ("none", window, window, [], [], [], [])]
    df = spark.createDataFrame(rows, "read string, seq string, window string, snps array<long>, offsets array<int>, refs array<string>, alts array<string>")
    for summed in (True, False):
        found = {(r.read, r.snp): r.allele for r in A.realign(df, summed).collect()}
        assert found == {(f"r{k}", 7 + b): k >> b & 1 for k, b in itertools.product(range(4), range(2))}
    assert A.realign(df.limit(0)).count() == 0
