"""Mate pairs that may cross haplotypes: crossing probabilities by insert size, estimated along with the phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .calls import adjacent_edges
from .link import crossing_bins, pooled_bins

BIN = 5000
# Least posterior of a variant that counts, and the log probability of a bin without data.
SURE, NEVER = 0.99, -80.0


def mate_calls(fragments: DataFrame, calls: DataFrame) -> DataFrame:
    """frag, isize, s1, a1, q1 (first call), s2, a2, q2 (first call of the second mate), n (calls) of fragments with mates."""
    first = F.min(F.struct("snp", "allele", "qv"))
    j = calls.join(fragments.where("mate2_ix IS NOT NULL AND isize IS NOT NULL").select("frag", "mate2_ix", "isize"), "frag")
    g = j.groupBy("frag", "isize").agg(first.alias("x"), F.min(F.when(F.col("snp") == F.col("mate2_ix"), F.struct("snp", "allele", "qv"))).alias("y"), F.count("*").alias("n"))
    return g.where("n >= 2 AND y IS NOT NULL").select("frag", "isize", F.col("x.snp").alias("s1"), F.col("x.allele").alias("a1"), F.col("x.qv").alias("q1"), F.col("y.snp").alias("s2"), F.col("y.allele").alias("a2"), F.col("y.qv").alias("q2"), "n")


def countable(mates: DataFrame, phased: DataFrame, coverage: DataFrame) -> DataFrame:
    """Mates with h1, h2: both variants phased for sure, in one block, and covered by more than one fragment.

    phased: snp, comp, hap, post_hap; coverage: snp, n.
    """
    sure = phased.where(F.col("post_hap") >= F.log10(F.lit(SURE))).join(coverage.where("n > 1").select("snp"), "snp").select("snp", "comp", "hap")
    end = lambda k: sure.select(F.col("snp").alias(f"s{k}"), F.col("comp").alias(f"c{k}"), F.col("hap").alias(f"h{k}"))
    return mates.join(end(1), "s1").join(end(2), "s2").where("c1 = c2").drop("c1", "c2")


def estimated(mates: DataFrame, bin_size: int = BIN, least: int = 500, reach: int = 800) -> DataFrame:
    """(bin, rate) of crossing, pooled over neighbouring bins; mates as countable() gives them."""
    match = (F.col("a1") == F.col("a2")) == (F.col("h1") == F.col("h2"))
    # in terms of a haplotype that is 0 throughout, a call that fits the phase is a 0 and one that doesn't is a 1
    flat = mates.select("isize", F.lit(0).alias("s1"), F.lit(0).alias("a1"), "q1", F.lit(0).alias("s2"), (~match).cast("int").alias("a2"), "q2")
    return pooled_bins(crossing_bins(flat, lambda s: F.lit(0), bin_size), least, reach)


def with_crossing(fragments: DataFrame, rates: DataFrame, bin_size: int = BIN) -> DataFrame:
    """fragments with h, the log10 probability that their mates lie on different haplotypes: that of their insert size's bin,
    NEVER without mates or data. Bins are few, so the planner sends them to all tasks."""
    b = rates.select(F.col("bin").cast("long").alias("_bin"), F.when(F.col("rate") > 0, F.log10("rate")).alias("_h"))
    j = fragments.withColumn("_bin", F.when(F.col("mate2_ix").isNotNull(), F.floor(F.col("isize") / bin_size)).cast("long")).join(b, "_bin", "left")
    return j.withColumn("h", F.coalesce("_h", F.lit(NEVER))).drop("_bin", "_h")


def known_phase_rates(fragments: DataFrame, calls: DataFrame, phase: DataFrame, bin_size: int = 50_000, least: int = 500, cap: int = 2_000_000) -> DataFrame:
    """(bin, rate, mates, pooled, total): crossing rates of mates of exactly two calls, from a given phase (snp, block, a1).

    A bin is pooled with its neighbours, one more on both sides at a time and at least once, until more than `least` mates
    or `cap` bases are covered; total counts all mates of the bin.
    """
    m = mate_calls(fragments, calls)
    end = lambda k: phase.where("a1 IN ('0', '1')").select(F.col("snp").alias(f"s{k}"), F.col("block").alias(f"c{k}"), F.col("a1").cast("int").alias(f"h{k}"))
    two = m.where("n = 2").join(end(1), "s1").join(end(2), "s2").where("c1 = c2")
    match = (F.col("a1") == F.col("a2")) == (F.col("h1") == F.col("h2"))
    flat = two.select("isize", F.lit(0).alias("s1"), F.lit(0).alias("a1"), "q1", F.lit(0).alias("s2"), (~match).cast("int").alias("a2"), "q2")
    bins = crossing_bins(flat, lambda s: F.lit(0), bin_size)
    total = fragments.where("mate2_ix IS NOT NULL AND isize IS NOT NULL").groupBy(F.floor(F.col("isize") / bin_size).alias("bin")).agg(F.count("*").alias("total"))
    grid = total.join(bins, "bin", "left").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct(F.coalesce("crossings", F.lit(0.0)).alias("c"), F.coalesce("n", F.lit(0)).alias("n"), "total")))).alias("m"), F.max("bin").alias("top"))  # a fixed grid
    every = grid.select("m", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bin"))
    near = lambda k: F.sequence(F.greatest(F.lit(0), F.col("bin") - k), F.least(F.col("top"), F.col("bin") + k))
    sum_of = lambda k, f: F.aggregate(near(k), F.lit(0.0), lambda s, i: s + F.coalesce(F.try_element_at("m", i).getField(f).cast("double"), F.lit(0.0)))
    wide = lambda k: F.size(near(k)) * bin_size
    enough = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("top"), F.lit(1)).cast("long")), lambda k: (sum_of(k, "n") > least) | (wide(k) > cap) | ((F.col("bin") - k <= 0) & (F.col("bin") + k >= F.col("top"))))
    k = F.coalesce(F.try_element_at(enough, F.lit(1)), F.greatest(F.col("top"), F.lit(1)))
    own = F.try_element_at("m", F.col("bin"))
    return every.withColumn("k", k).select("bin", F.round(F.coalesce(F.try_divide(sum_of(F.col("k"), "c"), sum_of(F.col("k"), "n")), F.lit(0.0)), 6).alias("rate"), F.coalesce(own.n, F.lit(0)).alias("mates"), sum_of(F.col("k"), "n").cast("long").alias("pooled"), F.coalesce(own.total, F.lit(0)).alias("total"))


def crossing_em(fragments: DataFrame, calls: DataFrame, rounds: int = 100, bin_size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """(phased, rates): phase and crossing rates that fit each other; phased has comp, snp, hap, ll, post_hap.

    The first phase takes all mates as uncrossed. Then rates are estimated from what is phased for sure, and the phase is
    found anew with them, until a round brings no better total likelihood. A round's phase is cut in shared storage; only
    its total likelihood goes to the driver.
    """
    from ..plans.genotype import refine
    from ..plans.phase import phase
    from ..storage import cut

    calls, best, kept = cut(calls, "calls"), None, None
    mates, covered = cut(mate_calls(fragments, calls), "mates"), calls.groupBy("snp").agg(F.count("*").alias("n"))
    crossing = fragments.select("frag", "mate2_ix", "isize").withColumn("h", F.lit(NEVER))
    rates = None
    for _ in range(rounds):
        with_h = calls.join(crossing.select("frag", "mate2_ix", "h"), "frag", "left") if rates is not None else calls
        found = cut(phase(with_h), "phase")
        total = found.groupBy("comp").agg(F.max("ll").alias("ll")).agg(F.sum("ll").alias("t")).first().t or 0.0
        if best is not None and total <= best + 1e-6:
            break
        phased = cut(refine(with_h, found).join(found.select("snp", "ll"), "snp"), "refined")
        best, kept = total, (phased, rates)
        rates = cut(estimated(countable(mates, phased, covered), bin_size), "rates")
        crossing = with_crossing(fragments.select("frag", "mate2_ix", "isize"), rates, bin_size)
    phased, used = kept
    return phased, rates if used is None else used


def mate_edges(calls: DataFrame) -> DataFrame:
    """Edges of a graph of mates: neighbouring calls of each fragment, as any other fragment's."""
    return adjacent_edges(calls)
