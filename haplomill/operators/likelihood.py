"""Fragment likelihoods against a haplotype, posteriors of variants and switches, read tags, genotypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.phred import log_diff, log_err, log_ok, log_sum

HALF = 0.3010299956639812  # -log10(1/2)


def terms(calls: DataFrame, hap) -> DataFrame:
    """calls with t0 and t1: what a call adds if its fragment comes from the haplotype or from its complement."""
    match = F.col("allele") == hap(F.col("snp"))
    return calls.withColumn("t0", F.when(match, log_ok()).otherwise(log_err())).withColumn("t1", F.when(match, log_err()).otherwise(log_ok()))


def fragment_ll(calls: DataFrame, hap, min_qv: int = 6) -> DataFrame:
    p = terms(calls.where(F.col("qv") >= min_qv), hap).groupBy("frag").agg(F.sum("t0").alias("p0"), F.sum("t1").alias("p1"), F.min("snp").alias("first_snp"))
    return p.withColumn("ll", log_sum(F.col("p0"), F.col("p1")))


def hic_ll(calls: DataFrame, hap, mates: DataFrame, min_qv: int = 6) -> DataFrame:
    """Mixture of normal and haplotype-crossing mates; mates has (frag, mate2, h = log10 of the crossing probability)."""
    t = terms(calls.where(F.col("qv") >= min_qv), hap).join(mates, "frag")
    second = F.col("snp") >= F.col("mate2")
    p = t.groupBy("frag").agg(F.sum("t0").alias("p0"), F.sum("t1").alias("p1"), F.sum(F.when(second, F.col("t1")).otherwise(F.col("t0"))).alias("q0"), F.sum(F.when(second, F.col("t0")).otherwise(F.col("t1"))).alias("q1"), F.max("h").alias("h"))
    normal = log_sum(F.col("p0"), F.col("p1")) + log_diff(F.lit(0.0), F.col("h"))
    return p.withColumn("ll", log_sum(normal, log_sum(F.col("q0"), F.col("q1")) + F.col("h")))


def read_tags(calls: DataFrame, hap, least: float = 0.95) -> DataFrame:
    f = fragment_ll(calls, hap)
    top, low = F.greatest("p0", "p1"), F.least("p0", "p1")
    return f.where(F.pow(F.lit(10.0), top - F.col("ll")) >= least).select("frag", F.when(F.col("p0") > F.col("p1"), 0).otherwise(1).alias("hp"), F.floor(F.round(10 * (F.col("ll") - low), 6)).cast("long").alias("pq"))


def fragment_tags(calls: DataFrame, phased: DataFrame, least: float = 0.95, min_qv: int = 6) -> DataFrame:
    """frag, ps, hp, pq of the fragments that belong to one copy with a posterior of at least `least`.

    phased: snp, comp, hap, first_pos; ps is the position at which the block of a fragment's first usable call begins.
    """
    j = calls.where(F.col("qv") >= min_qv).join(phased.where("hap IS NOT NULL").select("snp", "hap", "first_pos"), "snp")
    match = F.col("allele") == F.col("hap")
    f = j.groupBy("frag").agg(F.sum(F.when(match, log_ok()).otherwise(log_err())).alias("p0"), F.sum(F.when(match, log_err()).otherwise(log_ok())).alias("p1"), F.min_by("first_pos", "snp").alias("ps"))
    f = f.withColumn("ll", log_sum(F.col("p0"), F.col("p1")))
    sure = F.pow(F.lit(10.0), F.greatest("p0", "p1") - F.col("ll")) >= least
    return f.where(sure).select("frag", "ps", F.when(F.col("p0") > F.col("p1"), 0).otherwise(1).alias("hp"), F.floor(F.round(10 * (F.col("ll") - F.least("p0", "p1")), 6)).cast("long").alias("pq"))


def variant_posterior(calls: DataFrame, hap, threshold: float = 0.8) -> DataFrame:
    """One-shot form: log posterior of each variant's phase and of its flip, given all others as in hap."""
    t = terms(calls, hap)
    f = t.groupBy("frag").agg(F.sum("t0").alias("p0"), F.sum("t1").alias("p1"))
    j = t.join(f, "frag")
    now = log_sum(F.col("p0"), F.col("p1"))
    flipped = log_sum(F.col("p0") - F.col("t0") + F.col("t1"), F.col("p1") - F.col("t1") + F.col("t0"))
    s = j.groupBy("snp").agg(F.sum(now).alias("a"), F.sum(flipped).alias("b"))
    total = log_sum(F.col("a"), F.col("b"))
    return s.select("snp", (F.round(F.col("a") - total, 4) + 0.0).alias("post_hap"), (F.round(F.col("b") - total, 4) + 0.0).alias("post_flip"), (F.round(F.col("a") - total, 4) < F.log10(F.lit(threshold))).alias("pruned"))


def switch_posterior(calls: DataFrame, hap, comp) -> DataFrame:
    """Log posterior of a switch before each variant; only fragments that span it count.

    Between two neighbouring calls of a fragment every switch means the same to it. So each such stretch adds its terms at
    its beginning and takes them off at its end, summed per variant, and running sums along a component give the totals at
    all its variants with a call: rows are at most twice the calls, however many variants a fragment spans.
    """
    t = terms(calls, hap).withColumn("comp", comp)
    w = Window.partitionBy("frag", "comp").orderBy("snp")
    whole = Window.partitionBy("frag", "comp")
    late = F.sum(F.col("t1") - F.col("t0")).over(Window.partitionBy("frag", "comp").orderBy(F.desc("snp")).rowsBetween(Window.unboundedPreceding, 0))
    c = t.select("comp", "snp", F.lag("snp").over(w).alias("before"), late.alias("d"), F.sum("t0").over(whole).alias("p0"), F.sum("t1").over(whole).alias("p1"))
    x, y = log_sum(F.col("p0"), F.col("p1")), log_sum(F.col("p0") + F.col("d"), F.col("p1") - F.col("d"))
    gap = c.select("comp", "snp", "before", x.alias("x"), y.alias("y"))
    ends = F.array(F.struct(F.col("before").alias("at"), F.col("x").alias("x"), F.col("y").alias("y"), F.lit(1).alias("n")), F.struct(F.col("snp").alias("at"), (-F.col("x")).alias("x"), (-F.col("y")).alias("y"), F.lit(-1).alias("n")))
    # a fragment's first call changes no sum, but its variant may lie inside another fragment's stretch
    spot = F.array(F.struct(F.col("snp").alias("at"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n")))
    ends = F.when(F.col("before").isNull(), spot).otherwise(ends)
    deltas = gap.select("comp", F.explode(ends).alias("e")).groupBy("comp", F.col("e.at").alias("snp")).agg(F.sum("e.x").alias("x"), F.sum("e.y").alias("y"), F.sum("e.n").alias("n"))
    before = Window.partitionBy("comp").orderBy("snp").rowsBetween(Window.unboundedPreceding, -1)
    s = deltas.select("comp", "snp", F.sum("x").over(before).alias("a"), F.sum("y").over(before).alias("b"), F.sum("n").over(before).alias("n")).where("n > 0")
    return s.select("comp", "snp", (F.round(F.col("b") - log_sum(F.col("a"), F.col("b")), 4) + 0.0).alias("post_switch"))


def genotype_likelihoods(calls: DataFrame) -> DataFrame:
    ok, er = log_ok(), log_err()
    return calls.groupBy("snp").agg(
        F.round(F.sum(F.when(F.col("allele") == 0, ok).otherwise(er)), 6).alias("gll0"), F.round(-HALF * F.count("*"), 6).alias("gll1"),
        F.round(F.sum(F.when(F.col("allele") == 0, er).otherwise(ok)), 6).alias("gll2"), F.count_if(F.col("allele") == 0).alias("ac0"), F.count_if(F.col("allele") == 1).alias("ac1"))


def best_genotype(calls: DataFrame, priors: tuple[float, float, float] = (0.9985, 0.001, 0.0005)) -> DataFrame:
    g = genotype_likelihoods(calls)
    for i, p in enumerate(priors):
        g = g.withColumn(f"s{i}", F.col(f"gll{i}") + F.log10(F.lit(p)))
    top = F.greatest("s0", "s1", "s2")
    total = log_sum(log_sum(F.col("s0"), F.col("s1")), F.col("s2"))
    return g.select("snp", F.when(F.col("s0") == top, "0/0").when(F.col("s1") == top, "0/1").otherwise("1/1").alias("genotype"), (F.round(top - total, 4) + 0.0).alias("posterior"))


def hypothetical(calls: DataFrame, hap) -> DataFrame:
    """frag, snp, ll (as it is), ll_equal (the variant has its first copy's allele on both), ll_without (the call left out)."""
    t = terms(calls, hap)
    w = Window.partitionBy("frag")
    t = t.withColumn("p0", F.sum("t0").over(w)).withColumn("p1", F.sum("t1").over(w))
    return t.select("frag", "snp", log_sum(F.col("p0"), F.col("p1")).alias("ll"), log_sum(F.col("p0"), F.col("p1") - F.col("t1") + F.col("t0")).alias("ll_equal"), log_sum(F.col("p0") - F.col("t0"), F.col("p1") - F.col("t1")).alias("ll_without"))


def _by_allele(calls: DataFrame, hap) -> DataFrame:
    """Each call with its fragment's sums without it (b0, b1) and its own terms for the alleles 0 (z0) and 1 (z1)."""
    t = terms(calls, hap)
    w = Window.partitionBy("frag")
    t = t.withColumn("b0", F.sum("t0").over(w) - F.col("t0")).withColumn("b1", F.sum("t1").over(w) - F.col("t1"))
    return t.withColumn("z0", F.when(F.col("allele") == 0, log_ok()).otherwise(log_err())).withColumn("z1", F.when(F.col("allele") == 0, log_err()).otherwise(log_ok()))


def homozygous_posterior(calls: DataFrame, hap, prior: float = -2.0) -> DataFrame:
    """snp and log posteriors of its phase, of the flip, of 0/0 and of 1/1, all other variants as in hap (one-shot form);
    prior: log10 of the chance of each homozygous genotype."""
    t = _by_allele(calls, hap)
    ll = lambda x, y: F.sum(log_sum(F.col("b0") + F.col(x), F.col("b1") + F.col(y)))
    s = t.groupBy("snp").agg(ll("z0", "z1").alias("l0"), ll("z1", "z0").alias("l1"), ll("z0", "z0").alias("l00"), ll("z1", "z1").alias("l11"))
    het = log_diff(F.lit(-HALF), F.lit(prior))
    own = hap(F.col("snp")) == 0
    s = s.select("snp", (F.when(own, F.col("l0")).otherwise(F.col("l1")) + het).alias("a"), (F.when(own, F.col("l1")).otherwise(F.col("l0")) + het).alias("b"), (F.col("l00") + prior).alias("c"), (F.col("l11") + prior).alias("d"))
    total = log_sum(log_sum(F.col("a"), F.col("b")), log_sum(F.col("c"), F.col("d")))
    return s.select("snp", *[(F.round(F.col(x) - total, 4) + 0.0).alias(n) for x, n in (("a", "post_hap"), ("b", "post_flip"), ("c", "post_00"), ("d", "post_11"))])


#: Genotypes and their log10 priors, after what is added to the unphased ones.
FIVE = ("0/0", "0/1", "1/1", "0|1", "1|0")
FIVE_PRIORS = (0.9985, 0.001, 0.0005, 0.0005, 0.0005)
FIVE_ADDED = (-10.0, -3.0, -10.0, 0.0, 0.0)


def five_genotypes(calls: DataFrame, hap) -> DataFrame:
    """snp, genotype, posterior (log10) of the best of five genotypes, all other variants as in hap (one-shot form): three
    without phase, to whom the fragments say as much as without the variant, and two with it."""
    t = _by_allele(calls, hap)
    without = F.sum(log_sum(F.col("b0"), F.col("b1")) - HALF)
    phased = lambda x, y: F.sum(log_sum(F.col("b0") + F.col(x), F.col("b1") + F.col(y)) - HALF)
    s = t.groupBy("snp").agg((F.sum("z0") + without).alias("g0"), (without - HALF * F.count("*")).alias("g1"), (F.sum("z1") + without).alias("g2"), phased("z0", "z1").alias("g3"), phased("z1", "z0").alias("g4"))
    scores = [F.round(F.col(f"g{i}") + F.log10(F.lit(p)) + a, 6) for i, (p, a) in enumerate(zip(FIVE_PRIORS, FIVE_ADDED))]
    s = s.select("snp", *[x.alias(f"s{i}") for i, x in enumerate(scores)])
    top = F.greatest(*[F.col(f"s{i}") for i in range(5)])
    name = F.lit(None).cast("string")
    for i in reversed(range(5)):
        name = F.when(F.col(f"s{i}") == top, FIVE[i]).otherwise(name)
    total = top + F.log10(sum((F.pow(F.lit(10.0), F.col(f"s{i}") - top) for i in range(5)), F.lit(0.0)))
    return s.select("snp", name.alias("genotype"), (F.round(top - total, 4) + 0.0).alias("posterior"))
