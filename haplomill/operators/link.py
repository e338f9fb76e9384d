"""Interval joins, molecules of barcoded reads, mate pairs and crossing-probability bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def interval_join(spans: DataFrame, points: DataFrame, keys: list[str], bin_size: int, start: str = "start", end: str = "end", pos: str = "pos") -> DataFrame:
    """spans x points with start <= pos <= end and equal keys: an equi-join on position bins, then the exact test."""
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    marked = points.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    return binned.join(marked, [*keys, "_bin"]).where(F.col(pos).between(F.col(start), F.col(end))).drop("_bin")


def molecules(reads: DataFrame, gap: int, keys: list[str], pos: str = "pos") -> DataFrame:
    """reads with a running molecule number per key: a new one where the start lies more than gap after the last."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) <= gap, 0).otherwise(1)
    return reads.withColumn("_new", new).withColumn("mol", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def molecule_extents(reads: DataFrame, gap: int, keys: list[str], pos: str = "pos") -> DataFrame:
    return molecules(reads, gap, keys, pos).groupBy(*keys, "mol").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n_reads"))


def mate_pairs(reads: DataFrame) -> DataFrame:
    """One row per read with two mates (mate = 0 or 1): first index of each and the absolute distance."""
    g = reads.groupBy("read").agg(F.min(F.when(F.col("mate") == 0, F.col("pos"))).alias("first"), F.min(F.when(F.col("mate") == 1, F.col("pos"))).alias("second"))
    return g.where("first IS NOT NULL AND second IS NOT NULL").withColumn("isize", F.abs(F.col("second") - F.col("first")))


def crossing_bins(mates: DataFrame, hap, bin_size: int) -> DataFrame:
    """Expected crossings and counts per insert-size bin; mates has isize, a1, s1, q1 and a2, s2, q2 of both mates."""
    e1, e2 = F.pow(F.lit(10.0), -F.col("q1") / 10), F.pow(F.lit(10.0), -F.col("q2") / 10)
    match = (F.col("a1") == F.col("a2")) == (hap(F.col("s1")) == hap(F.col("s2")))
    p = F.when(match, (1 - e1) * e2 + (1 - e2) * e1).otherwise((1 - e1) * (1 - e2) + e1 * e2)
    return mates.groupBy(F.floor(F.col("isize") / bin_size).alias("bin")).agg(F.round(F.sum(p), 6).alias("crossings"), F.count("*").alias("n"))


def pooled_bins(bins: DataFrame, least: int = 500, reach: int = 800) -> DataFrame:
    """Each bin's rate over the smallest symmetric neighbourhood with at least `least` mates, at most `reach` bins.

    The bins are a fixed grid of insert sizes (a few hundred rows whatever the data), so one array holds them.
    """
    arr = bins.agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("crossings", "n")))).alias("m"), F.max("bin").alias("top"))
    every = arr.select("m", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bin"))
    near = lambda k: F.sequence(F.greatest(F.lit(0), F.col("bin") - k), F.least(F.col("top"), F.col("bin") + k))
    total = lambda k, f: F.aggregate(near(k), F.lit(0.0), lambda s, i: s + F.coalesce(F.try_element_at("m", i).getField(f).cast("double"), F.lit(0.0)))
    enough = F.filter(F.sequence(F.lit(0).cast("long"), F.least(F.lit(reach).cast("long"), F.col("top"))), lambda k: (total(k, "n") >= least) | ((k >= 1) & (2 * k + 1 >= reach)))
    k = F.coalesce(F.try_element_at(enough, F.lit(1)), F.col("top"))
    out = every.withColumn("k", k)
    return out.select("bin", "k", F.round(total(F.col("k"), "crossings") / F.nullif(total(F.col("k"), "n"), F.lit(0.0)), 6).alias("rate"))
