"""Evaluation of files against a plain model, pruning, reports, crossing rates, simulation, repair, estimates and indels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haplomill.__main__ import main
from haplomill.functions import alleles
from haplomill.operators import clusters, evaluate, hic, indels, params, repair
from haplomill.plans import genotype
from haplomill.plans.phase import Component, phase
from haplomill.sources import simulate, text


def lead_of(known, rows, copy):
    """Alternations at the beginning of rows, until one that a side doesn't know."""
    n, before = 0, None
    for pos, pair in rows:
        x, y = known.get(pos, "--")[0], pair[copy]
        if "-" in (x, y):
            if before is None:
                continue
            return n
        if before is not None:
            if (x == y) == before:
                return n
            n += 1
        before = x == y
    return n


def model(truth, assembly):
    """(switches, mismatches, flat, possible switches, possible mismatches) of blocks [(pos, 'ab')], by the stated rules."""
    total = np.zeros(5, int)
    for t in truth:
        known = dict(t)
        for a in assembly:
            per_copy = []
            for copy in (0, 1):
                on = last = None
                sw = mm = 0
                for i, (pos, pair) in enumerate(a):
                    x, y = known.get(pos, "--")[0], pair[copy]
                    if "-" in (x, y) or set(known[pos]) != set(pair):
                        continue
                    if on is None:
                        on, last = x != y, lead_of(known, a[i:], copy) % 2 == 1
                    elif (x != y) != on:
                        on = not on
                        sw, mm, last = (max(0, sw - 1), mm + 1, False) if last else (sw + 1, mm, True)
                    else:
                        last = False
                if last:
                    sw, mm = max(0, sw - 1), mm + 1
                per_copy.append((sw, mm))
            best = per_copy[0] if per_copy[0][0] < per_copy[1][0] else per_copy[1]
            same = [(known[p][0], pair) for p, pair in a if p in known and "-" not in known[p] + pair and set(known[p]) == set(pair)]
            n = len(same)
            total += [*best, min(sum(x != pair[k] for x, pair in same) for k in (0, 1)), max(0, n - 3) if n >= 4 else 0, n if n >= 2 else 0]
    return total.tolist()


def test_blocks_against_a_plain_model(spark):
    rng = random.Random(3)
    for trial in range(6):
        cut = lambda n: [list(range(i, min(i + n, 60))) for i in range(0, 60, n)]
        pairs = lambda p: rng.choice(["01", "10"]) if rng.random() > 0.1 else rng.choice(["--", "02", "20", "12"])
        truth = [[(p, pairs(p)) for p in b if rng.random() > 0.15] for b in cut(rng.choice((60, 25)))]
        assembly = [[(p, pairs(p) if rng.random() < 0.4 else "01") for p in b] for b in cut(rng.choice((9, 20)))]
        frame = lambda blocks: spark.createDataFrame([(str(i), p, "chr1", 100 + p, x[0], x[1], "A", "T", None) for i, b in enumerate(blocks) for p, x in b], "block string, snp long, chrom string, pos long, a1 string, a2 string, ref string, alt1 string, alt2 string")
        got = evaluate.compared(evaluate.aligned(frame(truth), frame(assembly))).agg(F.sum("switches"), F.sum("mismatches"), F.sum("flat"), F.sum(F.when(F.col("known") >= 4, F.col("known") - 3).otherwise(0)), F.sum(F.when(F.col("known") >= 2, F.col("known")).otherwise(0))).first()
        assert list(got) == model(truth, assembly), trial


def variant(pos, genotype, form="GT", ref="A", alt="T", chrom="chr1"):
    return f"{chrom}\t{pos}\t.\t{ref}\t{alt}\t.\tPASS\t.\t{form}\t{genotype}\n"


def test_files_are_evaluated(spark, tmp_path):
    v, t, b = tmp_path / "v.vcf", tmp_path / "t.vcf", tmp_path / "b.txt"
    genotypes = ["0|1", "0|1", "1|0", "0|1", "1|0", "0|1", "0/1", "1|1", "0|1"]
    v.write_text("".join(variant(100 * (i + 1), "0/1" if g != "1|1" else g) for i, g in enumerate(genotypes)) + variant(1000, "0/1", ref="AT", alt="A"))
    t.write_text("".join(variant(100 * (i + 1), f"{g}:{'9' if i < 8 else '.'}", "GT:PS", chrom="1") for i, g in enumerate(genotypes)))
    row = lambda i, x: f"{i}\t{x[0]}\t{x[1]}\tchr1\t{100 * i}\tA\tT\t0/1\t0\t.\t{50 if i != 4 else 3}.00\t4\n"
    b.write_text("BLOCK: offset: 1 len: 6 phased: 6 SPAN: 500 fragments 3\n" + "".join(row(i + 1, x) for i, x in enumerate(("01", "01", "10", "10", "01", "--"))) + "******** \nBLOCK: offset: 7 len: 1\n" + row(7, "01"))
    variants, truth = text.read_variants(spark, str(v)), evaluate.phased_blocks(text.read_variants(spark, str(t)))
    found = evaluate.assembled(text.read_blocks(spark, str(b)), variants)
    assert sorted(r.snp for r in found.collect()) == [0, 1, 2, 3, 4, 5] and sorted(r.snp for r in truth.collect()) == [0, 1, 2, 3, 4, 5]
    r = evaluate.report(truth, found, variants).first()
    assert (r.switches, r.mismatches, r.flat, r.phased, r.het_snps, r.most_phased, r.N50) == (1, 0, 2, 5, 8, 5, 400)
    main(["evaluate", "--VCF", str(v), "--blocks", str(b), "--truth_VCF", str(t), "--output", str(tmp_path / "e"), "--largest"])
    shown = [x.value for x in spark.read.text(str(tmp_path / "e")).collect()]
    assert shown[0].split() == ["switch", "rate:", "0.5"] and shown[3].split()[-1] == "5" and len(shown) == 7
    main(["prune", "--blocks", str(b), "--output", str(tmp_path / "p")])
    got = "\n".join(x.value for x in spark.read.text(str(tmp_path / "p")).collect()).split("\n")
    assert got[0] == "BLOCK: offset: 1 len: 6 phased: 4 SPAN: 500 fragments 0" and [x.split("\t")[0] for x in got[1:]] == ["1", "2", "3", "5"]
    v.write_text(v.read_text().replace("\t300\t", "\t301\t"))
    with pytest.raises(Exception, match="differ at variant 3"):
        evaluate.assembled(text.read_blocks(spark, str(b)), text.read_variants(spark, str(v))).collect()
    again = spark.createDataFrame([("a", 1, 2, 3, 4, 5), ("b", 1, 0, 1, 4, 5)], "contig string, switches int, mismatches int, flat int, poss_sw int, poss_mm int")
    assert evaluate.added_reports(again).first()[:4] == (["a", "b"], 2, 2, 4)
    with pytest.raises(Exception, match="twice"):
        evaluate.added_reports(again.withColumn("contig", F.lit("a"))).collect()


def test_block_files_split_and_prune(spark):
    rows = spark.createDataFrame([(0, i, "0", "1", q, p) for i, (q, p) in enumerate(((99.0, 99.0), (5.0, 99.0), (5.0, 3.0), (99.0, 99.0), (5.0, 99.0)))], "block long, snp long, a1 string, a2 string, switch_q double, mismatch_q double")
    got = [(r.snp, r.a1, r.part) for r in text.prune_blocks(rows).orderBy("snp").collect()]
    assert got == [(0, "0", 0), (1, "0", 0), (2, "-", 1), (3, "0", 1), (4, "0", 2)]
    probabilities = [(0.1, 0.9, 0.9), (0.1, 0.9, 0.9), (0.9, 0.1, 0.1), (0.9, 0.1, 0.9), (0.1, 0.9, 0.9)]
    p = spark.createDataFrame([(0, i, "0", "1", *x) for i, x in enumerate(probabilities)], "block long, snp long, a1 string, a2 string, transition double, posterior double, emission double")
    assert [(r.a1, r.part) for r in text.prune_by_probability(p, 0.5, 0.5).orderBy("snp").collect()] == [("0", 0), ("0", 0), ("-", 1), ("0", 1), ("0", 2)]


def test_block_lines_name_copies(spark):
    variants = spark.createDataFrame([(i, "c", 100 * i, "A", "T,C" if i == 2 else "T", g, g) for i, g in enumerate(("0/1", "0/1", "1/2", "0/1", "0/1"))], "var_ix long, chrom string, pos int, ref string, alt string, genotype string, sample string")
    calls = spark.createDataFrame([(f, s, 0, 20) for f in range(3) for s in range(5) if (s < 3) == (f < 2)], "frag long, snp long, allele int, qv int")
    phased = spark.createDataFrame([(0, 0, 1, 0.0, -0.001), (0, 1, 0, -0.0001, -2.0), (0, 2, 1, -0.5, 0.0), (3, 3, 0, 0.0, 0.0), (3, 4, 1, 0.0, 0.0)], "comp long, snp long, hap int, post_hap double, post_notsw double")
    got = "\n".join(r.value for r in text.block_lines(phased, variants, calls).orderBy("comp").collect()).split("\n")
    assert got[0] == "BLOCK: offset: 1 len: 3 phased: 3 SPAN: 200 fragments 2" and got[4] == "******** " and got[5].endswith("fragments 1") and len(got) == 8
    assert [x.split("\t")[1:3] for x in got[1:4]] == [["0", "1"], ["1", "0"], ["-", "-"]] and got[1].split("\t")[8:] == ["0", "26.38", "100.00", "2"]
    open_ = "\n".join(r.value for r in text.block_lines(phased, variants, calls, None).orderBy("comp").collect()).split("\n")
    assert open_[3].split("\t")[1:3] == ["1", "2"] and open_[3].split("\t")[8] == "."
    parts = {r.snp: r.comp for r in text.split_blocks(phased).collect()}
    assert parts == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3}


def test_distances_and_coverage(spark):
    rows = spark.createDataFrame([("t", "b", i, x, y) for i, (x, y) in enumerate(zip("0000000000", "0011010001"))], "t_block string, block string, snp long, x string, y1 string").withColumn("y2", (1 - F.col("y1").cast("int")).cast("string"))
    assert sorted((r["at"], r.length) for r in evaluate.switch_distances(rows).collect()) == [(4, 2), (6, 1)]
    spans = [(i, a, a + n) for i, (a, n) in enumerate((random.Random(1).randint(0, 300), k) for k in range(0, 90, 3))] + [(99, 10, 290)]
    variants = spark.range(0, 320, 3).withColumnRenamed("id", "snp")
    got = {r.snp: r.n for r in evaluate.gap_coverage(spark.createDataFrame(spans, "frag long, first long, last long"), variants, 50).collect()}
    assert got == {s: sum(a <= s <= b for _, a, b in spans) for s in range(0, 320, 3)}
    curve = spark.createDataFrame([(i, 3.0 + 2 * i - 0.5 * i * i) for i in range(12)], "bin long, rate double")
    assert all(abs(r.smooth - r.rate) < 1e-9 for r in evaluate.smoothed(curve).collect())
    noisy = np.random.default_rng(0).normal(size=15)
    fit = {r.bin: r.smooth for r in evaluate.smoothed(spark.createDataFrame([(i, float(x)) for i, x in enumerate(noisy)], "bin long, rate double"), 5, 2).collect()}
    assert all(abs(fit[i] - np.polyval(np.polyfit(range(5), noisy[max(0, min(10, i - 2)) : max(0, min(10, i - 2)) + 5], 2), i - max(0, min(10, i - 2)))) < 1e-9 for i in range(15))
    blocks = spark.createDataFrame([(0, 5), (1, 30), (2, 10), (3, 50)], "comp long, span long")
    assert evaluate.log_n50(blocks).first().log_n50 == 50
    runs = lambda x: spark.createDataFrame([("m", v) for v in x], "tool string, value double")
    assert evaluate.improvement(runs([10.0, 12.0]), runs([5.0, 6.0]), ["tool"], "value").first().percent == 50.0


def test_homozygous_and_hypothetical_likelihoods():
    rng = np.random.default_rng(2)
    frag, snp = np.repeat(np.arange(12), 4), np.concatenate([np.sort(rng.choice(6, 4, replace=False)) for _ in range(12)])
    allele, qv = rng.integers(0, 2, 48), rng.integers(6, 30, 48)
    allele[snp == 3] = 1
    c = Component(frag, snp, allele, qv)
    hap = np.array([0, 1, 0, 1, 0, 1], np.int8)

    def ll(one, two, left_out=None):
        out = np.zeros(12)
        for f in range(12):
            sides = [sum(np.log10(1 - 10 ** (-q / 10)) if a == h[s] else -q / 10 for g, s, a, q in zip(frag, snp, allele, qv) if g == f and s != left_out) for h in (one, two)]
            out[f] = np.log10(10 ** sides[0] + 10 ** sides[1])
        return out

    assert np.allclose(genotype.hypothetical_ll(c, hap), ll(hap, 1 - hap))
    same = 1 - hap
    same[3] = hap[3]
    assert np.allclose(genotype.hypothetical_ll(c, hap, equal=3), ll(hap, same))
    turned = hap.copy()
    turned[2:] ^= 1
    assert np.allclose(genotype.hypothetical_ll(c, hap, switch=2), ll(turned, 1 - turned))
    assert np.allclose(genotype.hypothetical_ll(c, hap, without=4), ll(hap, 1 - hap, 4))
    _, post, equal = genotype.homozygous_posteriors(c, hap, np.full(6, -0.5))
    assert equal[3] == "11" and set(equal[:3]) <= {None, "00", "11"} and (post <= 1e-9).all()
    assert genotype.homozygous_posteriors(c, hap, np.full(6, -80.0))[2] == [None] * 6


def test_crossed_mates(spark):
    """A quarter of far mates lie on the other haplotype: the phase is found, and the rate with it."""
    rng = np.random.default_rng(7)
    truth, calls, fragments = rng.integers(0, 2, 40), [], []
    for f in range(1500):
        a = int(rng.integers(0, 40))
        far = f % 2 == 0
        b = int(rng.integers(0, 40)) if far else min(39, a + int(rng.integers(1, 3)))
        a, b = min(a, b), max(a, b)
        if a == b:
            continue
        copy = int(rng.integers(0, 2))
        crossed = far and rng.random() < 0.25
        fragments.append((f, b, 12_000 if far else 2_000))
        for s, side in ((a, copy), (b, copy ^ crossed)):
            calls.append((f, s, int(truth[s] ^ side ^ (rng.random() < 0.01)), 20))
    fragments = spark.createDataFrame(fragments, "frag long, mate2_ix long, isize long")
    df = spark.createDataFrame(calls, "frag long, snp long, allele int, qv int")
    phased, rates = hic.crossing_em(fragments, df)
    hap = np.array([r.hap for r in phased.orderBy("snp").collect()])
    assert (hap == truth).all() or (hap == 1 - truth).all()
    assert len(hap) == 40 and rates.where("bin = 2").count() == 1
    known = spark.createDataFrame([(i, 0, str(x)) for i, x in enumerate(truth)], "snp long, block long, a1 string")
    by_truth = {r.bin: r for r in hic.known_phase_rates(fragments, df, known, 5000, 100, 4000).collect()}
    assert by_truth[0].rate < 0.05 and abs(by_truth[2].rate - 0.25) < 0.05 and by_truth[2].total == by_truth[2].mates
    direct = hic.estimated(hic.countable(hic.mate_calls(fragments, df), phased, df.groupBy("snp").agg(F.count("*").alias("n"))), 5000, 100)
    assert abs({r.bin: r.rate for r in direct.collect()}[2] - 0.25) < 0.06
    lines = [r.value for r in text.crossing_model_lines(direct).orderBy("bin").collect()]
    assert lines[0].startswith("0-5000\t0.0") and len(lines) == 3
    h = {r.frag: r.h for r in hic.with_crossing(fragments.unionByName(spark.createDataFrame([(9999, None, None)], fragments.schema)), direct).collect()}
    assert h[9999] == -80.0 and abs(h[0] - np.log10(0.25)) < 0.15


def test_mixture_score_equals_its_definition():
    rng = np.random.default_rng(4)
    frag, snp, allele, qv = np.repeat(np.arange(8), 3), np.tile([0, 1, 2], 8), rng.integers(0, 2, 24), np.full(24, 15)
    mate2, h = np.where(frag % 2 == 0, 2, np.nan), np.where(frag % 2 == 0, -1.0, np.nan)
    c = Component(frag, snp, allele, qv, mate2, h)
    ok, er = np.log10(1 - 10**-1.5), -1.5
    for hap in np.ndindex(2, 2, 2):
        want = 0.0
        for f in range(8):
            m = [allele[3 * f + k] == hap[k] for k in range(3)]
            one = lambda bits: np.log10(10 ** sum(ok if b else er for b in bits) + 10 ** sum(er if b else ok for b in bits))
            plain, crossed = one(m), one([m[0], m[1], not m[2]])
            want += np.log10(10 ** plain * 0.9 + 10 ** crossed * 0.1) if f % 2 == 0 else plain
        hap = np.array(hap, np.int8)
        assert abs(c.score(hap) - want) < 1e-9
        c.flips(hap)


def test_simulated_data_is_phased(spark, tmp_path):
    s = simulate.Settings(4000, 8.0, 300_000, 0.02, 0.05, 0.0, 0.002)
    sites = simulate.variants(spark, s).cache()
    rows = sites.orderBy("snp").collect()
    assert 500 < len(rows) < 700 and [r.snp for r in rows] == list(range(len(rows))) and all(a.pos < b.pos for a, b in zip(rows, rows[1:])) and all(r.ref != r.alt for r in rows)
    calls = simulate.calls(spark, s, sites).cache()
    wrong = calls.join(sites, "snp").groupBy("frag").agg(F.sum((F.col("allele") == F.col("hap")).cast("int")).alias("k"), F.count("*").alias("n")).select(F.least("k", F.col("n") - F.col("k")).alias("e"), "n").agg(F.sum("e") / F.sum("n")).first()[0]
    assert wrong < 0.02 and abs(calls.count() / len(rows) / 8 - 1) < 0.3
    found = phase(calls).join(sites.withColumnRenamed("hap", "truth"), "snp").groupBy("comp").agg(F.sum((F.col("hap") == F.col("truth")).cast("int")).alias("k"), F.count("*").alias("n"))
    share = found.select(F.sum(F.greatest("k", F.col("n") - F.col("k"))) / F.sum("n")).first()[0]
    assert share > 0.98
    again = simulate.calls(spark.newSession(), s, sites.repartition(5))
    assert again.exceptAll(calls).count() == 0
    mates = simulate.Settings(200, 4.0, 300_000, 0.0, hic_span=20_000, snp_rate=0.004)
    assert simulate.calls(spark, mates, simulate.variants(spark, mates)).count() > 50
    main(["simulate", "--output", str(tmp_path / "s"), "--read_length", "3000", "--ref_length", "60000", "--snp_rate", "0.003", "--switch", "0.01"])
    main(["phase", "--fragments", str(tmp_path / "s.frags"), "--VCF", str(tmp_path / "s.vcf"), "--output", str(tmp_path / "o"), "--error_analysis", "--tags"])
    main(["evaluate", "--VCF", str(tmp_path / "s.vcf"), "--blocks", str(tmp_path / "o"), "--truth_VCF", str(tmp_path / "s.vcf"), "--output", str(tmp_path / "e")])
    shown = {r.value.split(":")[0]: float(r.value.split()[-1]) for r in spark.read.text(str(tmp_path / "e")).collect()}
    assert shown["switch rate"] < 0.05 and shown["mismatch rate"] < 0.05 and shown["phased count"] > 50
    assert all(len(r.value.split()) == 4 for r in spark.read.text(str(tmp_path / "o.tags")).collect())


def sam(name, flag, chrom, pos, cigar, seq, tags="", mapq=60, back=False):
    return "\t".join([name, str(flag | 16 * back), chrom, str(pos), str(mapq), cigar, "*", "0", "0", seq, "I" * len(seq), *([tags] if tags else [])]) + "\n"


def test_chimeras_are_repaired(spark, tmp_path):
    one, two = tmp_path / "1.sam", tmp_path / "2.sam"
    # read a: mate 1 has a second piece right behind mate 2, on the other strand; read b is plain; read c lacks a mate
    one.write_text(sam("a", 0, "c1", 5000, "6M4S", "ACGTACGGGG", "MD:Z:6") + sam("a", 2048, "c2", 120, "6S4M", "ACGTACGGGG", "MD:Z:4") + sam("b", 0, "c1", 10, "4M", "ACGT", "MD:Z:4") + sam("c", 0, "c1", 10, "4M", "ACGT"))
    two.write_text(sam("a", 0, "c2", 100, "10M", "TTTTTTTTTT", "MD:Z:3A6", back=True) + sam("b", 0, "c1", 300, "4M", "ACGT", "MD:Z:4", back=True))
    got = {(r.read_id, r.value.split("\t")[2], r.repaired): r.value.split("\t") for r in repair.repair(repair.read_alignments(spark, str(one), str(two))).collect()}
    assert set(got) == {("a", "c1", 0), ("a", "c2", 1), ("b", "c1", 0)}
    fixed = got["a", "c2", 1]
    assert fixed[3] == "100" and fixed[5] == "10M10N4M" and fixed[9] == "TTTTTTTTTTGGGG" and "XD:Z:3A10" in fixed and "XX:i:1" in fixed and not any(t.startswith("MD") for t in fixed[11:])
    flag = int(fixed[1])
    assert flag & 1 and flag & 2 and flag & 16 and not flag & 2048
    main(["repair", "--first", str(one), "--second", str(two), "--output", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() == 4
    assert repair.joined_md("5A0", "3^AC2") == "5A3^AC2" and repair.joined_ops([("S", 3), ("M", 4)], [("M", 2), ("I", 1)], 0) == [("M", 6), ("I", 1)]


def test_parameter_estimates(spark, tmp_path):
    ref = "".join(random.Random(5).choices("ACGT", k=300))
    fa = tmp_path / "r.fa"
    fa.write_text(">c1 x\n" + "\n".join(ref[i : i + 70] for i in range(0, 300, 70)) + "\n>c2\nACGT\n")
    rows, emit, step = [], {}, {}
    rng = random.Random(6)
    for i in range(40):
        at, ops, seq, r = rng.randint(0, 200), [], "", 0
        for op, n in (("S", 3), ("M", 20), (rng.choice("ID"), rng.randint(1, 12)), ("M", 15)):
            piece = "".join(c if rng.random() > 0.1 else rng.choice("ACGTN") for c in ref[at + r : at + r + n]) if op == "M" else "A" * n if op in "SI" else ""
            back = i % 3 == 0
            if op == "M":
                for x, y in zip(ref[at + r : at + r + n], piece):
                    if y != "N":
                        x, y = ("ACGT"[3 - "ACGT".index(z)] for z in (x, y)) if back else (x, y)
                        emit[x, y] = emit.get((x, y), 0) + 1
                step["M", "M"] = step.get(("M", "M"), 0) + n - 1
                if ops and ops[-1][0] in "ID":
                    step[ops[-1][0], "M"] = step.get((ops[-1][0], "M"), 0) + 1
            elif op in "ID":
                step["M", op] = step.get(("M", op), 0) + 1
                if 1 < n < 10:
                    step[op, op] = step.get((op, op), 0) + n - 1
            ops.append((op, n))
            seq += piece
            r += n if op in "MD" else 0
        rows.append((f"r{i}", 16 if i % 3 == 0 else 0, "c1", at + 1, 60, [(n, op) for op, n in ops], seq, "I" * len(seq)))
    reads = spark.createDataFrame(rows, "read_id string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, seq string, qual string")
    fasta = text.read_fasta(spark, str(fa))
    assert [(r.chrom, r.start) for r in fasta.orderBy("chrom", "line").collect()] == [("c1", 1 + 70 * i) for i in range(5)] + [("c2", 1)]
    met = params.with_reference(reads, fasta)
    assert all(r.ref == ref[r.pos - 1 : r.end] for r in met.collect()) and met.count() == 40
    got = {(r.kind, r.a, r.b): r.n for r in params.alignment_counts(met).collect()}
    assert got == {("E", *k): n for k, n in emit.items()} | {("T", *k): n for k, n in step.items() if n}
    p = params.estimated(reads, fasta, useful=10)
    assert abs(p["E"][0, 0] - (emit["A", "A"] + 1) / sum(n for (x, _), n in emit.items() if x == "A")) < 1e-12 and p["T"].shape == (3, 3)
    assert params.estimated(reads, fasta) is None


def test_indels_under_reads(spark, tmp_path):
    rng = random.Random(9)
    ref = "".join(rng.choice("ACGT") for _ in range(100)) + "GCTTTTTTCA" + "".join(rng.choice("ACGT") for _ in range(90))
    assert indels.right_shift("AATTTTC", 2, "AT", "A") == 3 and indels.right_shift("AATTTTC", 2, "A", "AT") == 4 and indels.right_shift("ACGT", 1, "A", "T") == 0 and indels.right_shift("GACACT", 1, "G", "GAC") == 4
    anchor = ref[59]
    inserted = "GATTACA"
    v = tmp_path / "v.vcf"
    v.write_text(variant(60, "0/1", ref=anchor, alt=anchor + inserted, chrom="c1") + variant(150, "0/1", ref=ref[149:155], alt=ref[149], chrom="c1"))
    fa = tmp_path / "r.fa"
    fa.write_text(">c1\n" + ref + "\n")
    listed = text.read_extraction_variants(spark, str(v))
    read = lambda n, at, ops, seq: (n, 0, "c1", at + 1, 60, [(k, op) for op, k in ops], seq, "5" * len(seq))
    rows = [read("plain", 30, [("M", 80)], ref[30:110]), read("shown", 30, [("M", 30), ("I", 7), ("M", 30)], ref[30:60] + inserted + ref[60:90]), read("hidden", 50, [("M", 40)], ref[50:60] + inserted + ref[60:83]),
            read("gone", 130, [("M", 20), ("D", 5), ("M", 20)], ref[130:150] + ref[155:175]), read("kept", 130, [("M", 50)], ref[130:180])]
    reads = spark.createDataFrame(rows, "read_id string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, seq string, qual string")
    got = {(r.read_id, r.snp): (r.allele, r.qv) for r in indels.call_indels(params.with_reference(reads, text.read_fasta(spark, str(fa))), listed).collect()}
    assert got["plain", 0] == (0, 20) and got["shown", 0] == (1, 20) and got["gone", 1] == (1, 20) and got["kept", 1] == (0, 20)
    assert got.get(("hidden", 0), (1, 20))[0] == 1
    cigar = indels.extended_cigar([("S", 2), ("M", 12), ("I", 1), ("M", 10)], "NNACGTACGTACGTTACGTACGTAC", "ACGTACGAACGTACGTACGTAC")
    assert cigar == [("S", 2), ("=", 7), ("X", 1), ("=", 4), ("I", 1), ("=", 10)]
    assert indels.left_anchor(cigar, 5, 9, 15, 12) == (16, 13) and indels.left_anchor(cigar, 5, 3, 15, 12) is None and indels.left_anchor([("=", 20), ("X", 1)], 1, 0, 20, 20) == (12, 12)
    assert indels.right_anchor(cigar, 3, 2, 10, 8, 10) == (23, 20) and indels.right_anchor(cigar, 5, 5, 15, 12, 17) is None


def test_clusters(spark):
    rng = random.Random(2)
    pos = sorted(rng.sample(range(1, 900), 120))
    got = {r.snp: r.cluster for r in clusters.variant_clusters(spark.createDataFrame([(i, "c", p) for i, p in enumerate(pos)], "snp long, chrom string, pos long")).collect()}
    want, first, n = {}, 0, 0
    for i, p in enumerate(pos):
        if i and (p - pos[i - 1] > 20 or n == 10):
            first, n = i, 0
        want[i], n = first, n + 1
    assert got == want
    reads = [("r%d" % i, "c", p, 0, 100, 60) for i, p in enumerate((1, 50, 300, 500, 900, 50_000, 90_000, 90_100))] + [("x", "c", 60, 1024, 100, 60), ("y", "c", 70, 0, -5, 60), ("z", "c", 200_000, 0, 5, 0)]
    c = clusters.read_clusters(spark.createDataFrame(reads, "read_id string, chrom string, pos long, flag int, isize int, mapq int"))
    g = {r.cluster: (r.length, r.reads, r.grade, r.mean) for r in clusters.graded(c).collect()}
    assert g == {1: (899, 5, "good", 224.75), 50_000: (0, 1, "singleton", None), 90_000: (100, 2, "weak", None), 200_000: (0, 0, "repeat", None)}
    calls = [("k", s, a, q) for s, a, q in ((1, 0, 30), (1, 0, 40), (1, 1, 5), (2, 1, 10), (3, 1, 20), (4, 0, 30), (5, 1, 3))] + [("h", s, a, 20) for s in (1, 2) for a in (0, 1)] + [("one", 1, 1, 20)]
    got = sorted(r[:] for r in clusters.cluster_consensus(spark.createDataFrame(calls, "cluster string, snp long, allele int, qv int")).collect())
    assert got == [("k", 1, 0, 60), ("k", 2, 1, 10), ("k", 3, 1, 20), ("k", 4, 0, 30)]


def test_allele_functions(spark):
    rows = [("A", "T,G", "0/2"), ("ACC", "ATTCC", "0/1"), ("A", "C", "1/2")]
    df = spark.createDataFrame(rows, "ref string, alt string, gt string")
    p = alleles.allele_pair(F.col("ref"), F.col("alt"), F.col("gt"))
    assert [(r.p.allele1, r.p.allele2) for r in df.select(p.alias("p")).collect()] == [("A", "G"), ("ACC", "ATTCC"), ("C", "")]
    t = alleles.trimmed(F.col("ref"), F.col("alt"))
    assert [(r.t.allele1, r.t.allele2) for r in df.select(t.alias("t")).collect()] == [("A", "T,G"), ("A", "ATT"), ("A", "C")]
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first().x

    def hashed(word, size):
        h = 5381
        for ch in word.encode():
            h = h * 33 + ch
            h = h % size if h >= size else h
        return h

    assert value(alleles.bucket(F.lit("chr21"), 9973)) == hashed("chr21", 9973) and value(alleles.bucket(F.lit(""), 100)) == 5381
    assert [value(alleles.contig(F.lit(x))) for x in ("chr7", "7", "chrX", "hs1")] == ["7", "7", "X", "s1"]
    assert [value(alleles.base_index(F.lit(x))) for x in ("A", "t", "N", "")] == [1, 4, 0, 0]
    assert value(alleles.distinct_kmers(F.lit("ACGTT"), 3)) and not value(alleles.distinct_kmers(F.lit("ACGACG"), 3))
    r = spark.range(10_000).select(alleles.uniform(3, F.col("id")).alias("u"), alleles.interval(3, F.lit(2), F.lit(5), F.col("id")).alias("k")).agg(F.avg("u"), F.min("u"), F.max("u"), F.min("k"), F.max("k")).first()
    assert abs(r[0] - 0.5) < 0.02 and r[1] >= 0 and r[2] < 1 and r[3:] == (2, 4)
    assert alleles.binary_flag("1") == 1
    with pytest.raises(ValueError):
        alleles.binary_flag("2")


def test_contigs_are_evaluated_together(spark, tmp_path):
    rng, files = random.Random(4), {"v": [], "b": []}
    for c in ("chr1", "chr2"):
        v, b = tmp_path / f"{c}.vcf", tmp_path / f"{c}.txt"
        g = [rng.choice(("0|1", "1|0")) for _ in range(12)]
        v.write_text("".join(variant(100 * (i + 1), x, chrom=c) for i, x in enumerate(g)))
        flip = 5 if c == "chr1" else 12  # one switch on chr1
        b.write_text("BLOCK: x\n" + "".join(f"{i + 1}\t{x[0 if i < flip else 2]}\t{x[2 if i < flip else 0]}\t{c}\t{100 * (i + 1)}\tA\tT\t{x}\t0\t.\t50.00\t4\n" for i, x in enumerate(g)))
        files["v"].append(str(v))
        files["b"].append(str(b))
    out = str(tmp_path / "e")
    main(["evaluate", "--VCF", *files["v"], "--blocks", *files["b"], "--truth_VCF", *files["v"], "--output", out])
    shown = {r.value.split(":")[0]: float(r.value.split()[-1]) for r in spark.read.text(out).collect()}
    assert shown["switch rate"] == round(1 / 18, 6) and shown["mismatch rate"] == 0 and shown["phased count"] == 24 and shown["N50"] == 1100
    main(["evaluate", "--VCF", *files["v"], "--truth_blocks", *files["b"], "--output", out])
    assert {r.value.split(":")[0]: float(r.value.split()[-1]) for r in spark.read.text(out).collect()}["switch rate"] == round(1 / 18, 6)
    with pytest.raises(ValueError, match="several files"):
        main(["evaluate", "--VCF", files["v"][0], files["v"][0], "--truth_VCF", *files["v"], "--output", out])
    with pytest.raises(SystemExit):
        main(["evaluate", "--VCF", *files["v"], "--blocks", files["b"][0], "--truth_VCF", *files["v"], "--output", out])


def test_reads_are_realigned(spark, tmp_path):
    rng = random.Random(12)
    ref = "".join(rng.choices("ACGT", k=300))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    sites = [(100, ref[99], other[ref[99]]), (108, ref[107], other[ref[107]]), (112, ref[111], ref[111] + "GATC"), (200, ref[199], other[ref[199]])]
    v, fa = tmp_path / "v.vcf", tmp_path / "r.fa"
    v.write_text("".join(variant(p, "0/1", ref=a, alt=b, chrom="c1") for p, a, b in sites))
    fa.write_text(">c1\n" + "\n".join(ref[i : i + 60] for i in range(0, 300, 60)) + "\n")

    def copy(alleles, at, end):
        out, r = "", at
        for (p, a, b), x in sorted(zip(sites, alleles)):
            if r <= p - 1 < end:
                out += ref[r : p - 1] + (b if x else a)
                r = p - 1 + len(a)
        return out + ref[r:end]

    rows, want = [], {}
    for i, alleles in enumerate(((0, 0, 0, 0), (1, 0, 0, 1), (0, 1, 1, 0), (1, 1, 1, 1))):
        seq = copy(alleles, 60, 260)
        ops = [(112 - 60, "M"), (4, "I"), (260 - 112, "M")] if alleles[2] else [(200, "M")]
        rows.append((f"r{i}", 0, "c1", 61, 60, ops, seq, "5" * len(seq)))
        want |= {(f"r{i}", k): x for k, x in enumerate(alleles)}
    reads = spark.createDataFrame(rows, "read_id string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, seq string, qual string")
    from haplomill.operators import realign

    seen, listed = params.with_reference(reads, text.read_fasta(spark, str(fa))), text.read_extraction_variants(spark, str(v))
    for summed in (False, True):
        got = {(r.read_id, r.snp): r.allele for r in realign.realigned_calls(seen, listed, summed, True).collect()}
        assert got == {k: x for k, x in want.items() if k in got} and len(got) >= 14
        plain = realign.realigned_calls(seen, listed, summed).collect()
        assert {r.snp for r in plain} == {0, 1, 3}
    w = realign.windows(seen, listed, indels=True).collect()
    assert {tuple(r.snps) for r in w} >= {(3,)} and all(ref.find(r.window) >= 0 and r.window[r.offsets[0]] == r.refs[0][0] for r in w)
    s = tmp_path / "r.sam"
    s.write_text("".join(f"{n}\t{f}\t{c}\t{p}\t{m}\t{''.join(f'{k}{o}' for k, o in ops)}\t*\t0\t0\t{q}\t{u}\n" for n, f, c, p, m, ops, q, u in rows))
    main(["extract", "--VCF", str(v), "--bam", str(s), "--ref", str(fa), "--realign_variants", "--output", str(tmp_path / "f")])
    lines = [r.value.split() for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert sorted(x[1] for x in lines) == ["r0", "r1", "r2", "r3"] and all(x[0] == "2" and len(x) == 10 for x in lines)


def test_one_sample_of_many(spark):
    rows = ["1\t5\t.\tA\tT\t.\t.\t.\tGT\t0/1\t1/1", "2\t6\t.\tA\tT\t.\t.\t.\tGT\t0/0\t1|0:3", "3\t7\t.\tA\tT\t.\t.\t.\tGT\t0/1"]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    assert [r.value for r in text.one_sample(df, 10).collect()] == ["chr2\t6\t.\tA\tT\t.\t.\t.\tGT\t1|0:3"]


def test_streams(spark, tmp_path):
    from haplomill.streaming import molecules as S

    rows = [(b, f"2024-01-01 00:{m:02d}:00") for b, m in (("g", 0), ("g", 5), ("g", 30), ("h", 2), ("z", 59))]
    spark.createDataFrame(rows, "bx string, t string").selectExpr("bx", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("bx string, ts timestamp").parquet(str(tmp_path / "e"))
    got = sorted((r.bx, r.start.minute, r.end.minute, r.n_reads) for r in S.drained(S.stream_molecules(stream, "10 minutes", "0 seconds"), "m").collect())
    assert got == [("g", 0, 5, 2), ("g", 30, 30, 1), ("h", 2, 2, 1)]  # z's molecule may still go on
    bins = S.drained(S.stream_bins(spark.readStream.schema("bx string, ts timestamp").parquet(str(tmp_path / "e")), "20 minutes", "0 seconds"), "b")
    assert sorted((r.bx, r.start.minute, r.n) for r in bins.collect()) == [("g", 0, 2), ("g", 20, 1), ("h", 0, 1)]
    pair = lambda: spark.readStream.schema("bx string, ts timestamp").parquet(str(tmp_path / "e")).withColumnRenamed("bx", "read")
    m = S.drained(S.stream_mates(pair(), pair(), "6 minutes"), "p").where("t1 < t2")
    assert [(r.read, r.t1.minute, r.t2.minute) for r in m.collect()] == [("g", 0, 5)]
