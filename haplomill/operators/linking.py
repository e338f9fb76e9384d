"""Linking fragments of barcoded reads into fragments of whole molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .calls import summed_consensus
from .extract import in_order, typed_lines
from .link import molecules


def barcoded(reads: DataFrame, min_mapq: int = 20, tagged: bool = False) -> DataFrame:
    """Mapped, primary, passing, unduplicated reads of at least min_mapq with a barcode (and a molecule tag, if asked for)."""
    fine = reads.where((F.col("flag").bitwiseAND(F.lit(1796)) == 0) & (F.col("mapq") >= min_mapq)).where("bx IS NOT NULL")
    return fine.where("mi IS NOT NULL") if tagged else fine


def molecule_spans(reads: DataFrame, gap: int = 20_000, tagged: bool = False) -> DataFrame:
    """chrom, bx, mol, start (from 0), stop (one past the last base), n_reads of each molecule; reads have pos and end (from 1).

    A new molecule begins where a read starts more than gap after the read before it, or by the molecule tag; mol rises
    with the start within a barcode and contig.
    """
    r = barcoded(reads, tagged=tagged).select("chrom", "bx", "mi", (F.col("pos") - 1).alias("start"), F.col("end").alias("stop"))
    r = r.withColumn("mol", F.col("mi")) if tagged else molecules(r, gap, ["chrom", "bx"], "start")
    return r.groupBy("chrom", "bx", "mol").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_reads"))


def link(fragments: DataFrame, calls: DataFrame, variants: DataFrame, spans: DataFrame, cap: int = 40, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(fragments, calls) linked, by a new frag; fragments in: frag, name, barcode; calls in: frag, snp, allele, qv.

    A fragment belongs to the first molecule of its barcode, by start, that covers one of its calls; calls outside the
    molecule go. Calls of a molecule on one variant add up their qualities to at most cap if they agree, and go if not. A
    fragment without a molecule stays as it is. Results of fewer than `least` calls are left out. A fragment whose calls
    lie on more than one contig is left out, as indices of a contig are read alone.
    """
    at = calls.join(variants.select(F.col("var_ix").alias("snp"), "chrom", (F.col("pos") - 1).alias("pos")), "snp")
    one = at.groupBy("frag").agg(F.min("chrom").alias("c"), F.max("chrom").alias("d")).where("c = d").select("frag")
    at = at.join(one, "frag", "left_semi").join(fragments.select("frag", "barcode"), "frag")
    inside = at.where("barcode IS NOT NULL").join(spans, (at.barcode == spans.bx) & (at.chrom == spans.chrom) & at.pos.between(spans.start, spans.stop - 1)).select(
        "frag", "snp", "allele", "qv", spans.chrom, "bx", "mol", "start", "stop")
    own = inside.groupBy("frag").agg(F.min(F.struct("start", "stop", "mol")).alias("m"))
    taken = inside.join(own, "frag").where((F.col("start") == F.col("m.start")) & (F.col("stop") == F.col("m.stop")) & (F.col("mol") == F.col("m.mol")))
    name = F.concat(F.col("chrom"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), (F.col("stop") + 1).cast("string"), F.lit(":"), F.col("bx"))
    key = lambda x, named: F.struct(x.alias("key"), named.alias("name"))
    molecule_calls = summed_consensus(taken.select(key(F.concat_ws(" ", name, F.col("mol").cast("string")), name).alias("f"), "snp", "allele", "qv").withColumnRenamed("f", "frag"), cap)
    # the anti-join: fragments that no molecule took
    alone = at.join(own.select("frag"), "frag", "left_anti").join(fragments.select("frag", "name"), "frag").select(key(F.concat(F.lit("#"), F.col("frag").cast("string")), F.col("name")).alias("frag"), "snp", "allele", "qv")
    linked = molecule_calls.unionByName(alone)
    enough = linked.groupBy("frag").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    none = F.lit(None)
    kept = linked.join(enough.select("frag"), "frag", "left_semi").select(F.col("frag.key").alias("frag"), "snp", "allele", "qv")
    return enough.select(F.col("frag.key").alias("frag"), F.col("frag.name").alias("name"), none.cast("long").alias("mate2_ix"), none.cast("long").alias("isize"), none.cast("string").alias("barcode")), kept


def unlinked(fragments: DataFrame, linked: DataFrame) -> DataFrame:
    """Fragments whose name stands in no linked one: passed through, not lost."""
    return fragments.join(linked.select("frag"), "frag", "left_anti")


def linked_lines(fragments: DataFrame, calls: DataFrame) -> DataFrame:
    return in_order(typed_lines(fragments, calls, key="frag"))
