"""From read-level allele calls to fragments: read filters and routes, mate pairs, fragment lines.

calls of reads: read_id, snp, allele, qv, and optionally mate (0 or 1), isize, barcode. A fragment is a read or a pair
of mates; its calls meet by key and are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.phred import to_char


def on_known_contigs(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """Reads on contigs that hold a variant; contigs are few, but their number is left to the planner."""
    return reads.join(variants.select("chrom").distinct(), "chrom", "left_semi")


def routed(reads: DataFrame, min_isize: int = 0, max_isize: int = 1000) -> DataFrame:
    """reads with `single`: whether a read is taken alone (its mate is unmapped, on another contig or too near or far)."""
    size = F.abs("isize")
    alone = (F.col("flag").bitwiseAND(F.lit(8)) != 0) | (size > max_isize) | (size < min_isize) | (F.col("isize") == 0)
    alone = alone | (F.col("flag").bitwiseAND(F.lit(1)) == 0) | ~F.col("chrom").eqNullSafe(F.col("mate_chrom"))
    return reads.withColumn("single", F.coalesce(alone, F.lit(True)))


def paired_only(reads: DataFrame) -> DataFrame:
    return reads.where(~F.col("single"))


def pair_fragments(calls: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(fragments, calls) of mates: read_id is the pair's name, mate its half.

    fragments: name, mate2_ix, isize, barcode. Mates on disjoint ranges of variants become one fragment that knows where
    its second half begins, named with the suffix _MP; overlapping mates are merged: an agreeing variant keeps its best
    quality, a contradicted one goes, and the merged fragment has neither mate index nor insert size. Fragments of fewer
    than `least` calls are left out.
    """
    span = lambda m, f: f(F.when(F.col("mate") == m, F.col("snp")))
    pairs = calls.groupBy("read_id").agg(span(0, F.min).alias("a0"), span(0, F.max).alias("b0"), span(1, F.min).alias("a1"), span(1, F.max).alias("b1"), F.max(F.abs("isize")).alias("isize"), F.min("barcode").alias("barcode"))
    apart = F.coalesce((F.col("b0") < F.col("a1")) | (F.col("b1") < F.col("a0")), F.lit(False))
    pairs = pairs.select("read_id", F.when(apart, F.concat("read_id", F.lit("_MP"))).otherwise(F.col("read_id")).alias("name"), F.when(apart, F.greatest("a0", "a1")).alias("mate2_ix"), F.when(apart, F.col("isize")).alias("isize"), "barcode")
    merged = calls.groupBy("read_id", "snp").agg(F.min("allele").alias("allele"), F.max("allele").alias("top"), F.max("qv").alias("qv")).where("allele = top").drop("top")
    enough = merged.groupBy("read_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("read_id")
    kept = pairs.join(enough, "read_id")
    return kept.drop("read_id"), merged.join(kept.select("read_id", "name"), "read_id").select("name", "snp", "allele", "qv")


def single_fragments(calls: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(fragments, calls) of reads taken alone, as pair_fragments gives them."""
    g = calls.groupBy(F.col("read_id").alias("name")).agg(F.count("*").alias("n"), F.min("barcode").alias("barcode")).where(F.col("n") >= least)
    none = F.lit(None).cast("long")
    return g.select("name", none.alias("mate2_ix"), none.alias("isize"), "barcode"), calls.select(F.col("read_id").alias("name"), "snp", "allele", "qv").join(g.select("name"), "name")


def blocks_text(calls: DataFrame, key: str = "name") -> DataFrame:
    """key, n_blocks, body (index and alleles of each run of consecutive indices), quals, first (index), n (calls)."""
    w = Window.partitionBy(key).orderBy("snp")
    runs = calls.withColumn("_run", F.col("snp") - F.row_number().over(w))
    some = runs.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("snp", "allele", "qv"))).alias("c"))
    part = F.struct(F.col("c")[0].snp.alias("at"), F.array_join(F.transform("c", lambda x: x.allele.cast("string")), "").alias("h"), F.array_join(F.transform("c", lambda x: to_char(x.qv)), "").alias("q"))
    whole = some.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("b"))
    return whole.select(
        key, F.size("b").alias("n_blocks"), F.array_join(F.transform("b", lambda x: F.concat_ws(" ", (x["at"] + 1).cast("string"), x.h)), " ").alias("body"),
        F.array_join(F.transform("b", lambda x: x.q), "").alias("quals"), F.col("b")[0]["at"].alias("first"), F.aggregate("b", F.lit(0), lambda s, x: s + F.length(x.h)).alias("n"))


def typed_lines(fragments: DataFrame, calls: DataFrame, data_type: int = 0, new_format: bool = True, key: str = "name") -> DataFrame:
    """(first, line): one line per fragment, in the order of neither; key joins fragments and calls.

    data_type 0 or 1 gives type, index of the second mate (counted from 1) and insert size, -1 where there is none; 2
    gives the barcode (or NULL) instead. The old format has none of these.
    """
    t = fragments.join(blocks_text(calls, key), key)
    if data_type == 2:
        head = F.concat_ws(" ", F.lit("2"), F.coalesce("barcode", F.lit("NULL")), F.lit("-1"))
    else:
        head = F.concat_ws(" ", F.lit(str(data_type)), F.coalesce(F.col("mate2_ix") + 1, F.lit(-1)).cast("string"), F.coalesce("isize", F.lit(-1)).cast("string"))
    parts = [F.col("n_blocks").cast("string"), "name", *([head] if new_format or data_type == 2 else []), "body", "quals"]
    return t.select("first", F.concat_ws(" ", *parts).alias("line"))


def spelled_lines(fragments: DataFrame, calls: DataFrame) -> DataFrame:
    """(first, line) with each call as index:allele:quality, for reading by eye."""
    t = calls.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("snp", "allele", "qv"))).alias("c"))
    runs = F.aggregate("c", F.struct(F.lit(-2).cast("long").alias("p"), F.lit(0).alias("n")), lambda s, x: F.struct(x.snp.cast("long").alias("p"), (s.n + (x.snp != s.p + 1).cast("int")).alias("n")), lambda s: s.n)
    body = F.array_join(F.transform("c", lambda x: F.concat_ws(":", (x.snp + 1).cast("string"), x.allele.cast("string"), x.qv.cast("string"))), " ")
    return fragments.join(t, "name").select(F.col("c")[0].snp.alias("first"), F.concat_ws(" ", runs.cast("string"), "name", body).alias("line"))


def in_order(lines: DataFrame) -> DataFrame:
    """Lines by first index, then text: a range partitioning, so nothing is sorted in one place."""
    return lines.orderBy("first", "line").select(F.col("line").alias("value"))


def usable(calls: DataFrame, variants: DataFrame, min_qv: int = 6, least: int = 2) -> DataFrame:
    """Calls on heterozygous variants of at least min_qv, of fragments that keep `least` of them; each is a run of its own."""
    fine = calls.where(F.col("qv") >= min_qv).join(variants.where("het").select(F.col("var_ix").alias("snp")), "snp", "left_semi")
    return fine.join(fine.groupBy("frag").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("frag"), "frag", "left_semi")


def on_contig(calls: DataFrame, variants: DataFrame, chrom: str) -> DataFrame:
    """Calls of the fragments that have no call off a contig."""
    off = calls.join(variants.where(F.col("chrom") == chrom).select(F.col("var_ix").alias("snp")), "snp", "left_anti").select("frag").distinct()
    return calls.join(off, "frag", "left_anti")


def near_enough(fragments: DataFrame, max_isize: int) -> DataFrame:
    return fragments.where(F.coalesce("isize", F.lit(-1)) < max_isize)


def sampled(fragments: DataFrame, share: float, seed: int = 1, key: str = "frag") -> DataFrame:
    """A share of the fragments, the same ones in every run and under every partitioning."""
    from ..functions.alleles import uniform

    return fragments.where(uniform(seed, F.col(key)) < share)


def checked_bounds(calls: DataFrame, variants: int) -> DataFrame:
    """calls; a call beyond the last variant stops the run."""
    late = F.raise_error(F.concat(F.lit("a fragment names variant "), (F.col("snp") + 1).cast("string"), F.lit(f", but there are {variants}"))).cast("boolean")
    return calls.where(F.when((F.col("snp") >= variants) | (F.col("snp") < 0), late).otherwise(F.lit(True)))


def by_first(fragments: DataFrame, calls: DataFrame) -> DataFrame:
    """Fragments with their first and last index, in that order."""
    return fragments.join(calls.groupBy("frag").agg(F.min("snp").alias("first"), F.max("snp").alias("last")), "frag").orderBy("first", "last", "frag")
