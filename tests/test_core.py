"""Haplotype operators against hand-made cases and plain models."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from haplomill.operators import calls as C, evaluate as E, likelihood as L, link as J
from haplomill.plans.components import connected_components
from haplomill.plans.phase import Component, phase
from haplomill.sources import text as T


def model_w4(v):
    on, run = 1 - v[0], 1
    while run < len(v) and v[run] != v[run - 1]:
        run += 1
    last, sw, mm = (run - 1) % 2 == 1, 0, 0
    for x in v[1:]:
        if x == on:
            on = 1 - on
            if last:
                mm, sw, last = mm + 1, max(0, sw - 1), False
            else:
                sw, last = sw + 1, True
        else:
            last = False
    return (max(0, sw - 1), mm + 1) if last else (sw, mm)


def test_switch_mismatch(spark):
    rng = np.random.default_rng(3)
    blocks = {b: rng.integers(0, 2, rng.integers(1, 12)).tolist() for b in range(200)}
    df = spark.createDataFrame([(b, i, int(x)) for b, v in blocks.items() for i, x in enumerate(v)], "block int, snp int, match int")
    for r in E.block_errors(df).collect():
        assert (r.switches, r.mismatches) == model_w4(blocks[r.block])


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 1), (40, 30), (30, 20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 30: 20, 40: 20}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_path(spark):
    n = 200
    got = connected_components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.agg(F.countDistinct("component"), F.count("*")).first()[:] == (1, n)


def test_phase_is_optimal_on_small_components():
    rng = np.random.default_rng(1)
    for _ in range(15):
        n = 7
        truth, rows = rng.integers(0, 2, n), []
        for f in range(25):
            at = np.sort(rng.choice(n, 3, replace=False))
            rows += [(f, s, int(truth[s] ^ (f & 1) ^ (rng.random() < 0.1)), 10) for s in at]
        c = Component(*map(np.array, zip(*rows)))
        best = max(c.score(np.array((0, *h), dtype=np.int8)) for h in itertools.product((0, 1), repeat=c.n - 1))
        assert c.solve()[1] >= best - 1e-6


def test_phase_planted(spark):
    rows = [(f, s, (s * 7 % 11 % 2) ^ (f & 1), 30) for f in range(30) for s in range(f % 8, f % 8 + 3)]
    got = {r.snp: r.hap for r in phase(spark.createDataFrame(rows, "frag long, snp long, allele int, qv int")).collect()}
    assert all(got[s] == (s * 7 % 11 % 2) ^ 0 for s in got)


def test_molecule_gap(spark):
    reads = spark.createDataFrame([("G", 0), ("G", 20_000), ("G", 40_001), ("A", 5)], "bx string, pos long")
    got = sorted(r[:] for r in J.molecule_extents(reads, 20_000, ["bx"]).collect())
    assert got == [("A", 1, 5, 5, 1), ("G", 1, 0, 20_000, 2), ("G", 2, 40_001, 40_001, 1)]


def test_consensus_rules(spark):
    raw = spark.createDataFrame([(1, 0, 1, 20), (1, 0, 1, 20), (1, 1, 0, 20), (1, 1, 1, 20), (1, 2, 1, 50)], "frag long, snp long, allele int, qv int")
    assert sorted(r[:] for r in C.summed_consensus(raw).collect()) == [(1, 0, 1, 40), (1, 2, 1, 50)]


def test_fragment_file(spark, tmp_path):
    p = tmp_path / "f.txt"
    p.write_text("1 r1 5 011 III\n2 r2 1 11 4 01 5II5\n")
    p.write_text("1 r1 5 011 III\n2 r2 1 11 4 01 5II5\n0 none\n")
    f, c = T.read_fragments(spark, str(p))
    assert sorted(r[:] for r in c.collect()) == [(0, 4, 0, 40), (0, 5, 1, 40), (0, 6, 1, 40), (1, 0, 1, 20), (1, 1, 1, 40), (1, 3, 0, 40), (1, 4, 1, 20)]
    assert sorted(r.line for r in C.fragment_lines(c).collect()) == ["1 0 5 011 III", "2 1 1 11 4 01 5II5"]
    new = tmp_path / "n.txt"
    new.write_text("2 hic1_MP 1 9 250000 3 0 9 1 II\n")
    f, c = T.read_fragments(spark, str(new))
    assert f.first()[:] == (0, "hic1_MP", 1, 8, 250000)


def test_variants_and_reads(spark, tmp_path):
    v = tmp_path / "v.vcf"
    v.write_text("##x\n#CHROM\n" + "".join(f"chr1\t{p}\t.\tA\tT\t.\tPASS\t.\tGT:GQ\t{g}:30\n" for p, g in ((100, "0/1"), (105, "0/0"), (110, "0|1"))))
    variants = T.read_variants(spark, str(v))
    assert [r[:] for r in variants.orderBy("var_ix").select("var_ix", "pos", "het", "homozygous_prior").collect()] == [(0, 100, True, -3.0), (1, 105, False, -3.0), (2, 110, True, -3.0)]
    s = tmp_path / "r.sam"
    seq = "NNTNNNNNNNNNA" + "N" * 7
    s.write_text("@HD\n" + f"r1\t0\tchr1\t98\t60\t13M2I5M\t*\t0\t0\t{seq}\t{'5' * 20}\tBX:Z:GGG\n" + f"r2\t256\tchr1\t98\t60\t20M\t*\t0\t0\t{seq}\t{'5' * 20}\n")
    got = sorted(r[:4] for r in T.call_snps(T.read_sam(spark, str(s)), variants).collect())
    assert got == [("r1", 0, 1, 20), ("r1", 2, 0, 20)]


def test_entry_without_corpus_operators():
    import __spark_entry__ as e

    assert "components" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def noisy(seed, n=11, frags=14, k=4, err=0.3):
    rng = np.random.default_rng(seed)
    truth, rows = rng.integers(0, 2, n), []
    for f in range(frags):
        at = np.sort(rng.choice(n, k, replace=False))
        rows += [(f, int(s), int(truth[s] ^ (f & 1) ^ (rng.random() < err)), 10) for s in at]
    return Component(*map(np.array, zip(*rows)))


def test_search_goes_on_after_a_pass_without_gain():
    for seed in (17, 23, 34, 104, 139):
        c = noisy(seed)
        best = max(c.score(np.array((0, *h), dtype=np.int8)) for h in itertools.product((0, 1), repeat=c.n - 1))
        assert c.solve()[1] >= best - 1e-6


def test_edges_are_all_pairs_of_a_fragment():
    c = Component(np.repeat([0, 1], 20), np.tile(np.arange(20), 2), np.zeros(40, int), np.full(40, 20))
    assert len(c.edges[0]) == 190 and np.allclose(c.edges[2], c.edges[2][0])


def test_switches_are_scored_at_every_variant_inside_a_fragment(spark):
    # variant 5 has only a fragment of one call, variants 3 and 12 lie outside every other fragment
    drawn = np.random.default_rng(5)
    lone = [(100, 5, 1, 12), (101, 3, 0, 9), (102, 12, 1, 20)]
    rows = [(f, int(s), int(drawn.integers(0, 2)), int(drawn.integers(5, 40))) for f in range(8) for s in drawn.choice([4, 6, 7, 9, 11], 3, replace=False)] + lone
    hap = lambda s: s % 2
    want = {}
    for i in {r[1] for r in rows}:
        stay, turn = [], []
        for f in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == f]
            if min(r[1] for r in own) < i <= max(r[1] for r in own):
                for into, late in ((stay, 0), (turn, 1)):
                    p = [sum(np.log10(1 - 10 ** (-q / 10)) if (a == hap(s)) ^ (side and s < i or (side ^ late) and s >= i) else -q / 10 for _, s, a, q in own) for side in (0, 1)]
                    into.append(np.log10(sum(10 ** np.array(p))))
        if stay:
            want[i] = sum(turn) - np.log10(10 ** sum(stay) + 10 ** sum(turn))
    got = {r.snp: r.post_switch for r in L.switch_posterior(spark.createDataFrame(rows, "frag long, snp long, allele int, qv int"), hap, F.lit(0).cast("long")).collect()}
    assert set(got) == set(want) and 5 in got and not {3, 12} & set(got)
    assert all(abs(got[i] - want[i]) < 1e-4 for i in want)


def enumerated(c):
    return max(c.score(np.array((0, *h), dtype=np.int8)) for h in itertools.product((0, 1), repeat=c.n - 1))


def test_narrow_components_get_their_best_haplotype():
    for seed in (3467, 4008, 4453, 5028, 5885):  # the search alone stays below the best
        drawn = np.random.default_rng(seed)
        rows = [(f, int(s), int(drawn.integers(0, 2)), int(drawn.integers(5, 41))) for f in range(10) for s in sorted(drawn.choice(6, int(drawn.integers(2, 7)), replace=False))]
        c = Component(*map(np.array, zip(*rows)))
        hap, ll = c.solve()
        assert abs(ll - enumerated(c)) < 1e-9 and abs(c.score(hap) - ll) < 1e-9


def test_best_of_all_haplotypes_with_crossing_mates():
    for seed in range(5):
        drawn = np.random.default_rng(seed)
        rows = [(f, int(s), int(drawn.integers(0, 2)), int(drawn.integers(5, 41)), 3.0 if f % 3 else np.nan, -0.7 if f % 3 else np.nan) for f in range(9) for s in sorted(drawn.choice(6, 3, replace=False))]
        c = Component(*map(np.array, zip(*rows)))
        hap, ll = c.optimum()
        assert hap[0] == 0 and abs(ll - enumerated(c)) < 1e-9 and abs(c.score(hap) - ll) < 1e-9 and abs(c.solve()[1] - ll) < 1e-9


def test_loci_of_several_components_are_rounded_once(spark, tmp_path):
    from haplomill import catalog

    rows = [(12 * k + j, 2 * j + i, k + 41 * i, float(1 + (k * (5 + i) + 11 * j + 3 * i) % 30)) for k in range(60) for j in (0, 1) for i in (0, 1)]
    spark.createDataFrame([(*r, i, "N") for i, r in enumerate(rows)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_linenumber int, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.block: r.ll for r in catalog.QUERIES["maxcut_narrow"](spark, str(tmp_path)).collect()}
    assert got == {r.comp: r.ll for r in catalog.QUERIES["exact_ml_phase"](spark, str(tmp_path)).collect()} and len(got) == 60
