"""Clusters of close variants and of close reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Reach and size of a cluster of variants, least distance between clusters of reads.
NEAR, MOST = 20, 10
READ_GAP = 10_000


def variant_clusters(variants: DataFrame, near: int = NEAR, most: int = MOST) -> DataFrame:
    """variants with `cluster`, the first index of their cluster: one ends where the next variant lies more than `near` bases
    on, or holds `most` already."""
    w = Window.partitionBy("chrom").orderBy("pos", "snp")
    far = F.when(F.col("pos") - F.lag("pos").over(w) <= near, 0).otherwise(1)
    run = variants.withColumn("_far", far).withColumn("_run", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("chrom", "_run").orderBy("pos", "snp")
    part = run.withColumn("_part", F.floor((F.row_number().over(own) - 1) / most))
    return part.withColumn("cluster", F.min("snp").over(Window.partitionBy("chrom", "_run", "_part"))).drop("_far", "_run", "_part")


def read_clusters(reads: DataFrame, gap: int = READ_GAP) -> DataFrame:
    """reads with `cluster`, the position at which their cluster begins: a new one at a distance of gap or more. Second mates
    (negative insert size) and duplicates are left out."""
    fine = reads.where((F.col("isize") >= 0) & (F.col("flag").bitwiseAND(F.lit(1024)) == 0))
    w = Window.partitionBy("chrom").orderBy("pos", "read_id")
    new = F.when(F.col("pos") - F.lag("pos").over(w) < gap, 0).otherwise(1)
    run = fine.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("cluster", F.min("pos").over(Window.partitionBy("chrom", "_run"))).drop("_new", "_run")


def graded(clusters: DataFrame) -> DataFrame:
    """chrom, cluster, length, reads, mean, std (of the distances between neighbours), grade of each read cluster.

    A distance counts if the read that ends it has a mapping quality, and `reads` counts those with one.
    """
    w = Window.partitionBy("chrom", "cluster").orderBy("pos", "read_id")
    d = clusters.withColumn("d", F.when(F.col("mapq") > 0, F.col("pos") - F.lag("pos").over(w)).cast("double"))
    g = d.groupBy("chrom", "cluster").agg((F.max("pos") - F.min("pos")).alias("length"), F.count_if(F.col("mapq") > 0).alias("reads"), F.avg("d").alias("m"), F.avg(F.col("d") * F.col("d")).alias("q"))
    enough = F.col("reads") >= 5
    grade = F.when(enough, "good").when(F.col("reads") == 0, "repeat").when(F.col("reads") == 1, "singleton").otherwise("weak")
    return g.select("chrom", "cluster", "length", "reads", F.when(enough, F.round("m", 4)).alias("mean"), F.when(enough, F.round(F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))), 4)).alias("std"), grade.alias("grade"))


def cluster_consensus(calls: DataFrame, min_qv: int = 6, cap: int = 60) -> DataFrame:
    """(cluster, snp, allele, qv): the allele of each variant of a cluster of reads that most of its calls have.

    An allele needs more calls and more quality than the other, which may have one call; its quality is the difference,
    at most cap and at least min_qv. A cluster is left out if two neighbouring calls in order of variant and allele
    differ on two variants or on a third of them, or if it has fewer than two variants, before or after.
    """
    one = calls.groupBy("cluster", "snp").agg(*[f for a in (0, 1) for f in (F.count_if(F.col("allele") == a).alias(f"n{a}"), F.sum(F.when(F.col("allele") == a, F.col("qv")).otherwise(0)).alias(f"q{a}"))])
    mixed = one.groupBy("cluster").agg(F.count_if((F.col("n0") > 0) & (F.col("n1") > 0)).alias("het"), F.count("*").alias("k"))
    fine = mixed.where("het < 2 AND het * 3 < k AND k >= 2").select("cluster")
    better = lambda a, b: (F.col(f"n{a}") > F.col(f"n{b}")) & (F.col(f"n{b}") <= 1) & (F.col(f"q{a}") > F.col(f"q{b}"))
    named = one.withColumn("allele", F.when(better(0, 1), 0).when(better(1, 0), 1)).where("allele IS NOT NULL").withColumn("qv", F.least(F.abs(F.col("q0") - F.col("q1")), F.lit(cap)).cast("int")).where(F.col("qv") >= min_qv)
    named = named.join(fine, "cluster", "left_semi")
    two = named.groupBy("cluster").agg(F.count("*").alias("k")).where("k >= 2").select("cluster")
    return named.join(two, "cluster", "left_semi").select("cluster", "snp", "allele", "qv")
