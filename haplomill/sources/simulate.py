"""Simulated diploid data: variants, haplotypes and fragments with switch, missing and miscall errors.

Every draw is a hash of the seed and of what it is drawn for, so tables of any size come out alike under any
partitioning, and a lost task draws the same again. Nothing is generated on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.alleles import interval, uniform
from ..operators.extract import typed_lines
from ..operators.link import interval_join

STRETCH = 100_000


@dataclass(frozen=True)
class Settings:
    """Rates as shares; lengths in bases. hic_span > 0 gives mate pairs of read_length each, up to hic_span apart."""

    read_length: int
    coverage: float
    ref_length: int = 250_000_000
    miscall: float = 0.02
    missing: float = 0.0
    switch: float = 0.0
    snp_rate: float = 0.0008
    hic_span: int = 0
    seed: int = 1

    @property
    def reads(self) -> int:
        bases = (2 if self.hic_span else 1) * self.read_length
        return int(self.coverage * self.ref_length / (bases * (1 - self.missing) * (1 - 2 / 3 * self.miscall)))

    @property
    def quality(self) -> int:
        return 93 if self.miscall < 10**-9.3 else int(-10 * math.log10(self.miscall))


def variants(spark: SparkSession, s: Settings) -> DataFrame:
    """snp, pos, hap (allele of the first copy), ref, alt: a base is variable with probability snp_rate."""
    at = spark.range(s.ref_length).where(uniform(s.seed, F.lit("site"), F.col("id")) < s.snp_rate).select(F.col("id").alias("pos"), F.floor(F.col("id") / STRETCH).alias("part"))
    counts = at.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per stretch
    own = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    v = at.withColumn("own", own).join(counts, "part").select((F.col("base") + F.col("own")).alias("snp"), "pos")
    ref = interval(s.seed, F.lit(0), F.lit(4), F.lit("ref"), F.col("pos"))
    alt = F.pmod(ref + interval(s.seed, F.lit(1), F.lit(4), F.lit("alt"), F.col("pos")), F.lit(4))
    base = lambda c: F.substring(F.lit("ATGC"), (c + 1).cast("int"), F.lit(1))
    return v.select("snp", "pos", (uniform(s.seed, F.lit("hap"), F.col("pos")) < 0.5).cast("int").alias("hap"), base(ref).alias("ref"), base(alt).alias("alt"))


def calls(spark: SparkSession, s: Settings, sites: DataFrame) -> DataFrame:
    """frag, snp, allele, qv: what is left of the reads that cover two variants, before and after errors.

    A fragment switches copies before a call with probability switch / (calls - 1); a call is missing, or miscalled:
    a third of miscalls show the other allele, the rest are dropped.
    """
    draw = lambda what, *more: uniform(s.seed, F.lit(what), F.col("frag"), *more)
    length = interval(s.seed, F.lit(2 * s.read_length + 2), F.lit(max(s.hic_span, 2 * s.read_length + 3)), F.lit("length"), F.col("frag")) if s.hic_span else F.lit(s.read_length)
    reads = spark.range(s.reads + 1).select(F.col("id").alias("frag")).withColumn("length", length)
    reads = reads.withColumn("start", F.floor(draw("start") * (s.ref_length - F.col("length"))).cast("long")).withColumn("end", F.col("start") + F.col("length")).withColumn("copy", (draw("copy") < 0.5).cast("int"))
    if s.hic_span:
        ends = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + s.read_length - 1).alias("b")), F.struct((F.col("end") - s.read_length).alias("a"), F.col("end").alias("b")))
        reads = reads.select("frag", "copy", F.explode(ends).alias("x")).select("frag", "copy", F.col("x.a").alias("start"), F.col("x.b").alias("end"))
    on = interval_join(reads, sites.withColumn("k", F.lit(1)).drop("k"), [], 10_000).select("frag", "copy", "snp", "hap")
    w = Window.partitionBy("frag")
    n = F.count("*").over(w)
    on = on.withColumn("n", n).where("n >= 2").withColumn("allele", F.when(F.col("copy") == 0, F.col("hap")).otherwise(1 - F.col("hap")))
    if s.switch:
        turn = (draw("switch", F.col("snp")) < F.lit(s.switch) / (F.col("n") - 1)).cast("int")
        on = on.withColumn("turn", turn).withColumn("turned", F.sum("turn").over(w.orderBy("snp").rowsBetween(Window.unboundedPreceding, 0)) % 2).withColumn("allele", F.when(F.col("turned") == 1, 1 - F.col("allele")).otherwise(F.col("allele")))
    wrong = draw("miscall", F.col("snp")) < s.miscall
    other = draw("other", F.col("snp")) < 1 / 3
    kept = on.where(draw("missing", F.col("snp")) >= s.missing).where(~wrong | other).withColumn("allele", F.when(wrong, 1 - F.col("allele")).otherwise(F.col("allele")).cast("int"))
    return kept.withColumn("left", F.count("*").over(w)).where("left >= 2").select("frag", "snp", "allele", F.lit(s.quality).alias("qv"))


def fragment_lines(found: DataFrame) -> DataFrame:
    """(first, line) in the old layout."""
    named = found.select(F.concat(F.lit("FRAG"), F.col("frag").cast("string")).alias("name"), "snp", "allele", "qv")
    none = F.lit(None)
    return typed_lines(named.select("name").distinct().select("name", none.cast("long").alias("mate2_ix"), none.cast("long").alias("isize"), none.cast("string").alias("barcode")), named, new_format=False)


def variant_lines(sites: DataFrame, s: Settings, contig: str = "sim_chrom") -> DataFrame:
    """(snp, value) of a variant file with phased genotypes; its header has snp -1."""
    head = "\n".join(["##fileformat=VCFv4.1", f"##contig=<ID={contig},length={s.ref_length}>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"])
    rows = sites.select("snp", F.concat_ws("\t", F.lit(contig), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("100"), F.lit("PASS"), F.lit("."), F.lit("GT"), F.concat_ws("|", F.col("hap").cast("string"), (1 - F.col("hap")).cast("string"))).alias("value"))
    return sites.sparkSession.createDataFrame([(-1, head)], "snp long, value string").unionByName(rows)
