"""Text sources and sinks: variant files, fragment files (both layouts), SAM text, FASTA, crossing models, blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import alleles as A
from ..functions.phred import from_char, quality


def numbered(spark: SparkSession, path: str, keep=None) -> DataFrame:
    """(ix, value): the lines of a text file that pass keep, numbered from 0 in file order.

    Lines are counted per file part first and offset by the parts before, so nothing is sorted in one place.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    lines = lines if keep is None else lines.where(keep(F.col("value")))
    parts = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"))  # a row per part of a file
    before = parts.select("_f", "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = Window.partitionBy("_f", "_b").orderBy("_m")
    return lines.withColumn("_r", F.row_number().over(own)).join(F.broadcast(before), ["_f", "_b"]).select((F.col("_o") + F.col("_r") - 1).alias("ix"), "value")


def under_headers(spark: SparkSession, path: str, keep, is_head) -> DataFrame:
    """(ix, value, head, title): the lines that pass keep under the last line before them that is_head holds for, with
    that line's number and text; header lines themselves are left out.

    The last header is carried along within each part of a file and handed over between parts (a row each), so there is
    neither one order over all lines nor a join of lines with headers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    lines = lines.where(keep(F.col("value")))
    own = Window.partitionBy("_f", "_b").orderBy("_m")
    lines = lines.withColumn("_r", F.row_number().over(own)).withColumn("_h", F.when(is_head(F.col("value")), F.struct(F.col("_r").alias("r"), F.col("value").alias("t"))))
    parts = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.max("_h").alias("_last"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of a file
    parts = parts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    last = F.struct((F.col("_o") + F.col("_last.r") - 1).alias("r"), F.col("_last.t").alias("t"))
    parts = parts.select("_f", "_b", "_o", F.last(F.when(F.col("_last").isNotNull(), last), True).over(before).alias("_c"))
    x = lines.withColumn("_l", F.last("_h", True).over(own.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(parts), ["_f", "_b"])
    head = F.when(F.col("_l").isNotNull(), F.struct((F.col("_o") + F.col("_l.r") - 1).alias("r"), F.col("_l.t").alias("t"))).otherwise(F.col("_c"))
    return x.where("_h IS NULL").select((F.col("_o") + F.col("_r") - 1).alias("ix"), "value", head.r.alias("head"), head.t.alias("title")).where("head IS NOT NULL")


def count_variants(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).count()


def count_fragments(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(~F.col("value").startswith("0 ") & (F.trim("value") != "")).count()


def first_contig(spark: SparkSession, path: str) -> str | None:
    row = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) >= 5)).first()
    return row.value.split("\t")[0] if row else None


def read_extraction_variants(spark: SparkSession, path: str, sample_column: int = 9, triallelic: bool = False) -> DataFrame:
    """Variants as extraction sees them: var_ix, chrom, pos, ref, alt, genotype, allele1, allele2, type, het.

    GT has to come first in the format and name two alleles in 0, 1, 2, or the run stops. allele1 and allele2 are those
    the genotype stands for, without the bases both end with; type is their difference in length before that, and an
    indel's position is that of the base after its anchor. het: see functions.alleles.status.
    """
    x = numbered(spark, path, lambda v: ~v.startswith("#") & (F.trim(v) != "")).withColumn("c", F.split("value", "\t"))
    wrong = lambda said: F.raise_error(F.concat(F.lit(said + ": "), F.col("value"))).cast("boolean")
    gt = F.get("c", F.lit(sample_column))
    ok = F.when(F.size("c") <= sample_column, wrong("too few columns")).when(~F.get("c", F.lit(8)).startswith("GT"), wrong("GT doesn't come first")).when(~A.is_diploid(gt), wrong("not a diploid genotype")).otherwise(F.lit(True))
    x = x.where(ok).withColumn("p", A.allele_pair(F.get("c", F.lit(3)), F.get("c", F.lit(4)), gt))
    kind = (F.length("p.allele2") - F.length("p.allele1")).cast("int")
    x = x.withColumn("type", kind).withColumn("t", A.trimmed(F.col("p.allele1"), F.col("p.allele2")))
    return x.select(F.col("ix").alias("var_ix"), F.get("c", F.lit(0)).alias("chrom"), (F.get("c", F.lit(1)).cast("int") + (F.col("type") != 0).cast("int")).alias("pos"), F.get("c", F.lit(3)).alias("ref"), F.get("c", F.lit(4)).alias("alt"),
        F.substring(gt, 1, 3).alias("genotype"), F.col("t.allele1").alias("allele1"), F.col("t.allele2").alias("allele2"), "type", A.status(gt, triallelic).alias("het"))


def eligible(variants: DataFrame, homozygous: bool = False, indels: bool = False, triallelic: bool = False) -> DataFrame:
    """Variants that reads are compared with: het '1' (all but '3' with homozygous), '2' only single bases and if asked for."""
    het = F.col("het")
    fine = (het == "1") | (F.lit(homozygous) & (het != "3")) | ((het == "2") & F.lit(triallelic) & (F.col("type") == 0))
    return variants.where(fine & (F.lit(indels) | (F.col("type") == 0)))


def read_variants(spark: SparkSession, path: str, format_column: int = 8, sample_column: int = 9) -> DataFrame:
    """Variants by data line order: var_ix, chrom, pos, id, ref, alt, genotype, is_indel, homozygous_prior, het.

    A line of fewer than 10 columns, without a genotype or with another number of format than of sample fields stops the
    run; GQ gives the prior (-GQ/10), else -80. het: two different alleles in 0, 1, 2 with / or | between them.
    """
    x = numbered(spark, path, lambda v: ~v.startswith("#") & (F.trim(v) != "")).withColumn("c", F.split("value", "\t"))
    x = x.withColumn("f", F.split(F.get("c", F.lit(format_column)), ":")).withColumn("s", F.split(F.get("c", F.lit(sample_column)), ":"))
    field = lambda name: F.try_element_at("s", F.array_position("f", name).cast("int").cast("int") + F.when(F.array_position("f", name) > 0, 0).otherwise(10_000))
    gt = F.coalesce(field("GT"), F.raise_error(F.lit("a variant line has no genotype")).cast("string"))
    a1, a2 = F.substring(gt, 1, 1), F.substring(gt, 3, 1)
    alts = F.split(F.get("c", F.lit(4)), ",")
    wrong = lambda said: F.raise_error(F.concat(F.lit(said + ": "), F.col("value"))).cast("boolean")
    x = x.where(F.when(F.size("c") <= sample_column, wrong("fewer than 10 columns")).when(F.size("f") != F.size("s"), wrong("format and sample fields differ in number")).otherwise(F.lit(True)))
    return x.select(F.col("ix").alias("var_ix"), F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("int").alias("pos"), F.get("c", F.lit(2)).alias("id"), F.get("c", F.lit(3)).alias("ref"), F.get("c", F.lit(4)).alias("alt"), gt.alias("genotype"),
        ((F.length(F.get("c", F.lit(3))) != 1) | F.exists(alts, lambda a: F.length(a) != 1)).alias("is_indel"), F.coalesce(-field("GQ").cast("double") / 10, F.lit(-80.0)).alias("homozygous_prior"), ((a1 != a2) & A.is_diploid(gt)).alias("het"), F.get("c", F.lit(format_column)).alias("format"), F.get("c", F.lit(sample_column)).alias("sample"))


def read_fragment_files(spark: SparkSession, paths: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """(fragments, calls) of several files, of either layout each; numbers of a file follow those of the files before it."""
    both, upto = [], 0
    for i, path in enumerate(paths):
        shifted = [x.withColumn("frag", F.col("frag") + upto) for x in read_fragments(spark, path, **options)]
        both.append(shifted)
        upto += count_fragments(spark, path) if i + 1 < len(paths) else 0
    return tuple(reduce(DataFrame.unionByName, x) for x in zip(*both))


def read_fragments(spark: SparkSession, path: str, new_format: bool | None = None, barcodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(fragments, calls) of a fragment file; frag is the line's number.

    fragments: frag, name, data_type, mate2_ix, isize, and barcode where barcodes are read. calls: frag, snp (0-based), allele, qv. Lines of 0 blocks
    are skipped; unlinked barcode fragments (type 2) are refused, as phasing needs them linked first, unless barcodes is
    set: then they are all that is expected.
    """
    x = numbered(spark, path, lambda v: ~v.startswith("0 ") & (F.trim(v) != "")).withColumn("c", F.filter(F.split("value", " "), lambda v: v != ""))
    n = F.get("c", F.lit(0)).cast("int")
    new = F.size("c") == 6 + 2 * n if new_format is None else F.lit(new_format)
    head = F.when(new, 5).otherwise(2)
    x = x.withColumn("n", n).withColumn("new", new).withColumn("head", head)
    fits = F.size("c") == F.col("head") + 1 + 2 * F.col("n")
    ok = F.when(~fits, F.raise_error(F.lit("a fragment line has a wrong number of fields")).cast("boolean")).when(F.col("new") & (F.get("c", F.lit(2)) == "2") & F.lit(not barcodes), F.raise_error(F.lit("unlinked barcode fragments can't be phased")).cast("boolean")).when(F.lit(barcodes) & ~(F.col("new") & (F.get("c", F.lit(2)) == "2")), F.raise_error(F.lit("not an unlinked barcode fragment")).cast("boolean")).otherwise(F.lit(True))
    x = x.where(ok)
    one_based = lambda v: F.when((F.get("c", F.lit(2)) != "2") & (F.expr(f"try_cast({v} AS long)") > 0), F.expr(f"try_cast({v} AS long)") - 1)
    fragments = x.select(F.col("ix").alias("frag"), F.get("c", F.lit(1)).alias("name"), F.when(F.col("new"), F.get("c", F.lit(2)).cast("int")).otherwise(0).alias("data_type"), F.when(F.col("new"), one_based("c[3]")).alias("mate2_ix"), F.when(F.col("new") & (F.expr("try_cast(c[4] AS long)") >= 0), F.expr("try_cast(c[4] AS long)")).alias("isize"), *([F.when(F.get("c", F.lit(3)) != "NULL", F.get("c", F.lit(3))).alias("barcode")] if barcodes else []))
    blocks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.element_at("c", F.col("head") + 2 * k + 1).cast("long").alias("at"), F.element_at("c", F.col("head") + 2 * k + 2).alias("h")))
    flat = F.flatten(F.transform(blocks, lambda b: F.transform(F.sequence(F.lit(1), F.length(b.h)), lambda i: F.struct((b.at + i - 2).alias("snp"), F.substring(b.h, i, F.lit(1)).cast("int").alias("allele")))))
    calls = x.select(F.col("ix").alias("frag"), F.element_at("c", -1).alias("q"), F.posexplode(flat).alias("k", "x")).select("frag", F.col("x.snp").alias("snp"), F.col("x.allele").alias("allele"), from_char(F.substring(F.col("q"), F.col("k") + 1, F.lit(1))).alias("qv"))
    return fragments, calls


def convert_fragments(lines: DataFrame, to_new: bool) -> DataFrame:
    """Old to new layout (type 0, no mate, no insert size) or back, column value."""
    c = F.split("value", " ")
    body = F.concat(F.slice(c, 1, 2), F.array(F.lit("0"), F.lit("-1"), F.lit("-1")), F.slice(c, F.lit(3), F.size(c))) if to_new else F.concat(F.slice(c, 1, 2), F.slice(c, F.lit(6), F.size(c)))
    return lines.select(F.array_join(body, " ").alias("value"))


def read_sam(spark: SparkSession, path: str, min_mapq: int = 20, supplementary: bool = False) -> DataFrame:
    """Alignments of SAM text that are mapped, primary, passing, not duplicates and of at least min_mapq."""
    c = F.split("value", "\t")
    x = spark.read.text(path).where(~F.col("value").startswith("@")).select(c.alias("c"))
    tag = lambda t: F.regexp_extract(F.array_join(F.slice("c", F.lit(12), F.size("c")), "\t"), rf"(?:^|\t){t}:[A-Za-z]:([^\t]*)", 1)
    ops = F.arrays_zip(F.transform(F.regexp_extract_all(F.get("c", F.lit(5)), F.lit(r"(\d+)[MIDNSHP=X]"), 1), lambda v: v.cast("int")).alias("len"), F.transform(F.regexp_extract_all(F.get("c", F.lit(5)), F.lit(r"\d+([MIDNSHP=X])"), 1), lambda v: F.translate(v, "=X", "MM")).alias("op"))
    r = x.select(F.get("c", F.lit(0)).alias("read_id"), F.get("c", F.lit(1)).try_cast("int").alias("flag"), F.get("c", F.lit(2)).alias("chrom"), F.get("c", F.lit(3)).try_cast("int").alias("pos"), F.get("c", F.lit(4)).try_cast("int").alias("mapq"), ops.alias("cigar"), F.when(F.get("c", F.lit(6)) == "=", F.get("c", F.lit(2))).otherwise(F.get("c", F.lit(6))).alias("mate_chrom"), F.get("c", F.lit(7)).try_cast("int").alias("mate_pos"), F.get("c", F.lit(8)).try_cast("int").alias("isize"), F.get("c", F.lit(9)).alias("seq"), F.get("c", F.lit(10)).alias("qual"), F.nullif(tag("BX"), F.lit("")).alias("bx"), F.nullif(tag("MI"), F.lit("")).alias("mi"))
    mask = 1796 if supplementary else 1796 + 2048
    return r.where((F.col("flag").bitwiseAND(F.lit(mask)) == 0) & (F.col("mapq") >= min_mapq))


def aligned_pieces(reads: DataFrame) -> DataFrame:
    """reads with `pieces`: (ref start, read offset, length) of each aligned stretch, and `end`, the last reference base."""
    start = F.struct(F.col("pos").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,n:int>>").alias("p"))

    def step(s, x):
        m, ref, query = x.op == "M", x.op.isin("M", "D", "N"), x.op.isin("M", "I", "S")
        return F.struct((s.r + F.when(ref, x.len).otherwise(0)).cast("int").alias("r"), (s.q + F.when(query, x.len).otherwise(0)).cast("int").alias("q"), F.when(m, F.concat(s.p, F.array(F.struct(s.r.alias("r"), s.q.alias("q"), x.len.alias("n"))))).otherwise(s.p).alias("p"))

    return reads.withColumn("_a", F.aggregate("cigar", start, step)).select(*reads.columns, F.col("_a.p").alias("pieces"), (F.col("_a.r") - 1).alias("end"))


def call_snps(reads: DataFrame, variants: DataFrame, min_base: int = 13, bin_size: int = 500) -> DataFrame:
    """(read_id, snp, allele, qv) of heterozygous single-base variants under aligned reads; qv is capped by mapq."""
    from ..operators.link import interval_join

    v = variants.where("het AND NOT is_indel").select("chrom", F.col("pos").alias("vpos"), F.col("var_ix").alias("snp"), "ref", F.split("alt", ",")[0].alias("alt1"))
    j = interval_join(aligned_pieces(reads), v, ["chrom"], bin_size, "pos", "end", "vpos")
    piece = F.try_element_at(F.filter("pieces", lambda p: (p.r <= F.col("vpos")) & (F.col("vpos") < p.r + p.n)), F.lit(1))
    at = j.withColumn("_p", piece).where("_p IS NOT NULL").withColumn("_o", F.col("_p.q") + F.col("vpos") - F.col("_p.r") + 1)
    base, q = F.upper(F.substring(F.col("seq"), F.col("_o"), F.lit(1))), from_char(F.substring(F.col("qual"), F.col("_o"), F.lit(1)))
    called = at.select("read_id", "snp", F.when(base == F.upper("ref"), 0).when(base == F.upper("alt1"), 1).alias("allele"), q.alias("_q"), "mapq", "chrom", "pos", "bx")
    return called.where(F.col("allele").isNotNull() & (F.col("_q") >= min_base)).select("read_id", "snp", "allele", F.least("_q", "mapq").alias("qv"), "chrom", "pos", "bx")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, line, start, bases) of a FASTA file, upper case; start is the first base's position from 1; gz is read as well."""
    x = under_headers(spark, path, lambda v: F.trim(v) != "", lambda v: v.startswith(">"))
    x = x.select(F.regexp_extract("title", r"^>(\S+)", 1).alias("chrom"), (F.col("ix") - F.col("head") - 1).alias("line"), F.upper(F.trim("value")).alias("bases"))
    before = Window.partitionBy("chrom").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("start", F.coalesce(F.sum(F.length("bases")).over(before), F.lit(0)) + 1).select("chrom", "line", "start", "bases")


def by_contig(rows: DataFrame, path: str) -> DataFrame:
    """rows written as one folder per contig (column chrom) and read back; a later read of one contig opens its folder alone."""
    rows.write.partitionBy("chrom").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def one_sample(lines: DataFrame, column: int, prefix: str = "chr") -> DataFrame:
    """Variant lines (column value) with a single sample, that of a column from 0, heterozygous in it, contigs prefixed."""
    x = lines.select(F.split("value", "\t").alias("c"))
    gt = F.substring(F.get("c", F.lit(column)), 1, 3)
    kept = x.where(gt.isin("0/1", "1/0", "0|1", "1|0"))
    return kept.select(F.concat_ws("\t", F.concat(F.lit(prefix), F.get("c", F.lit(0))), F.slice("c", 2, 8), F.get("c", F.lit(column))).alias("value"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start from 0, end, barcode, n_reads) of an interval file; the last two are null where it has three columns."""
    c = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != "")).select(c.alias("c"))
    return x.select(F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("long").alias("start"), F.get("c", F.lit(2)).cast("long").alias("end"), F.try_element_at("c", F.lit(4)).alias("barcode"), F.try_element_at("c", F.lit(5)).cast("long").alias("n_reads"))


def interval_lines(spans: DataFrame) -> DataFrame:
    """Molecules as interval lines, by contig, start and end."""
    return spans.orderBy("chrom", "start", "stop", "bx").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("stop").cast("string"), "bx", F.col("n_reads").cast("string")).alias("value"))


def crossing_model_lines(rates: DataFrame, bin_size: int = 5000) -> DataFrame:
    """(bin, value): range of insert sizes and probability of each bin, from bin and rate; a bin without data has 0."""
    low = F.col("bin") * bin_size
    return rates.select("bin", F.concat_ws("\t", F.concat(low.cast("string"), F.lit("-"), (low + bin_size).cast("string")), F.format_string("%.6f", F.coalesce("rate", F.lit(0.0)))).alias("value"))


def read_crossing_model(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark, path, lambda v: F.trim(v) != "").select(F.col("ix").alias("bin"), F.split("value", "\t")[1].cast("double").alias("prob"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, snp 0-based, a1, a2, chrom, pos, ref, alt, sample, discrete, switch_q, mismatch_q, n) of a haplotype block file."""
    rows = under_headers(spark, path, lambda v: ~v.startswith("*") & (F.trim(v) != ""), lambda v: v.startswith("BLOCK"))
    c = F.split("value", "\t")
    number = lambda k: F.expr(f"try_cast(split(value, '\\t')[{k}] AS double)")
    at = lambda k: F.try_element_at(c, F.lit(k))
    return rows.select(F.col("head").alias("block"), (c[0].cast("long") - 1).alias("snp"), c[1].alias("a1"), c[2].alias("a2"), at(4).alias("chrom"), at(5).cast("int").alias("pos"), at(6).alias("ref"), at(7).alias("alt"),
        at(8).alias("sample"), at(9).alias("discrete"), F.when(F.size(c) > 9, number(9)).alias("switch_q"), F.when(F.size(c) > 10, number(10)).alias("mismatch_q"), F.coalesce(at(12).cast("long"), F.lit(0)).alias("n"))


def prune_blocks(rows: DataFrame, mismatch_q: float = 30, switch_q: float = 30, discrete: bool = False) -> DataFrame:
    """Alleles below the mismatch quality (or marked, with discrete) become '-'; a block splits before a row below the switch quality."""
    w = Window.partitionBy("block").orderBy("snp")
    rows = rows.withColumn("_n", F.row_number().over(w))
    split = ((F.coalesce("switch_q", F.lit(100.0)) < switch_q) & (F.col("_n") > 2)).cast("int")
    low = F.coalesce("mismatch_q", F.lit(100.0)) < mismatch_q
    low = low | (F.coalesce("discrete", F.lit("0")) == "1") if discrete else low
    return rows.withColumn("part", F.sum(split).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a1", F.when(low, "-").otherwise(F.col("a1"))).withColumn("a2", F.when(low, "-").otherwise(F.col("a2"))).drop("_n")


def prune_by_probability(rows: DataFrame, emission: float, split: float) -> DataFrame:
    """As prune_blocks for rows with transition, posterior and emission probabilities: '-' below the emission cutoff, a
    split below the transition cutoff, or, once a block, below it in the posterior."""
    w = Window.partitionBy("block").orderBy("snp")
    rows = rows.withColumn("_n", F.row_number().over(w))
    far = F.col("_n") > 2
    # the posterior splits where no split by it came before: the first row, after the second, that is low in it or in the transition
    hit = far & ((F.col("transition") < split) | (F.col("posterior") < split))
    first = F.coalesce(F.sum(hit.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    cut_here = (far & (F.col("transition") < split)) | (hit & first)
    low = F.col("emission") < emission
    return rows.withColumn("part", F.sum(cut_here.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a1", F.when(low, "-").otherwise(F.col("a1"))).withColumn("a2", F.when(low, "-").otherwise(F.col("a2"))).drop("_n")


def _header(first, last, k, span, fragments):
    return F.format_string("BLOCK: offset: %d len: %d phased: %d SPAN: %d fragments %d", first.cast("long"), (last - first + 1).cast("long"), k.cast("long"), span.cast("long"), fragments.cast("long"))


def _between(blocks: DataFrame, *order: str) -> DataFrame:
    """(order, value): block texts with a separator line before all but the first."""
    least = blocks.agg(F.min(F.struct(*order)).alias("m")).first()  # one row
    first = F.lit(True) if least is None or least.m is None else reduce(lambda a, b: a & b, [F.col(c) == x for c, x in zip(order, least.m)])
    return blocks.select(*order, F.when(first, F.col("text")).otherwise(F.concat(F.lit("******** \n"), F.col("text"))).alias("value"))


def pruned_block_lines(rows: DataFrame) -> DataFrame:
    """(block, part, value) of pruned and split rows: headers anew, rows without alleles dropped, blocks of fewer than two left out."""
    line = F.concat_ws("\t", (F.col("snp") + 1).cast("string"), "a1", "a2", "chrom", F.col("pos").cast("string"), "ref", "alt", "sample", F.coalesce("discrete", F.lit(".")),
        *[F.coalesce(F.format_string("%.2f", q), F.lit(".")) for q in (F.col("switch_q"), F.col("mismatch_q"))], F.col("n").cast("string"))
    kept = F.when((F.col("a1") != "-") & (F.col("a2") != "-"), F.struct("snp", line.alias("line")))
    g = rows.groupBy("block", "part").agg(F.min("snp").alias("a"), F.max("snp").alias("b"), (F.max("pos") - F.min("pos")).alias("span"), F.array_sort(F.collect_list(kept)).alias("l")).where(F.size("l") >= 2)
    return _between(g.withColumn("text", F.concat_ws("\n", _header(F.col("a") + 1, F.col("b") + 1, F.size("l"), F.col("span"), F.lit(0)), F.array_join(F.transform("l", lambda x: x.line), "\n"))), "block", "part")


def block_lines(phased: DataFrame, variants: DataFrame, calls: DataFrame, threshold: float | None = 0.8) -> DataFrame:
    """(comp, value): block file text, one row per block, with a separator line before all but the first.

    phased: comp, snp, hap, and optionally post_hap, post_notsw (log10) and homozygous ('00' or '11'). Alleles of a
    posterior below the threshold are '-' (threshold None prunes nothing and leaves the confidences open). The copies of
    a block are named so that its first variant has allele 0 on the first; a third allele is written by the genotype.
    fragments counts the fragments whose first call lies in the block.
    """
    phased = phased.select("comp", "snp", "hap", *[c for c in ("post_hap", "post_notsw", "homozygous") if c in phased.columns])
    comps = phased.select("snp", "comp")
    owned = calls.groupBy("frag").agg(F.min("snp").alias("snp")).join(comps, "snp").groupBy("comp").agg(F.count("*").alias("fragments"))
    first = phased.groupBy("comp").agg(F.min_by("hap", "snp").alias("lead"))
    rows = phased.join(variants.withColumnRenamed("var_ix", "snp"), "snp").join(calls.groupBy("snp").agg(F.count("*").alias("n")), "snp", "left").join(first, "comp")
    has = lambda c: F.col(c) if c in phased.columns else F.lit(None)
    g1, g2 = A.first_allele(F.col("genotype")), A.second_allele(F.col("genotype"))
    third = F.substring("genotype", 1, 3).contains("2")
    one = F.when(third, F.when(F.col("hap") == 0, g1).otherwise(g2)).otherwise(F.col("hap").cast("string"))
    two = F.when(third, F.when(F.col("hap") == 0, g2).otherwise(g1)).otherwise((1 - F.col("hap")).cast("string"))
    swapped = F.col("lead") != 0
    pruned = F.coalesce(has("post_hap").cast("double") < F.log10(F.lit(threshold)), F.lit(False)) if threshold is not None else F.lit(False)
    same = has("homozygous").cast("string")
    a = F.when(pruned, "-").when(same.isNotNull(), F.substring(same, 1, 1)).when(swapped, two).otherwise(one)
    b = F.when(pruned, "-").when(same.isNotNull(), F.substring(same, 2, 1)).when(swapped, one).otherwise(two)
    score = lambda c: F.when(has(c).cast("double").isNotNull(), F.format_string("%.2f", quality(has(c).cast("double")))).otherwise(".")
    marks = [F.lit("0"), score("post_notsw"), score("post_hap")] if threshold is not None else [F.lit("."), score("post_notsw"), F.lit(".")]
    line = F.concat_ws("\t", (F.col("snp") + 1).cast("string"), a, b, "chrom", F.col("pos").cast("string"), "ref", "alt", "sample", *marks, F.coalesce("n", F.lit(0)).cast("string"))
    g = rows.groupBy("comp").agg(F.min("snp").alias("a"), F.max("snp").alias("b"), F.count("*").alias("k"), (F.max("pos") - F.min("pos")).alias("span"), F.array_sort(F.collect_list(F.struct("snp", line.alias("line")))).alias("l"))
    g = g.join(owned, "comp", "left")
    head = _header(F.col("a") + 1, F.col("b") + 1, F.col("k"), F.col("span"), F.coalesce("fragments", F.lit(0)))
    return _between(g.withColumn("text", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x.line), "\n"))), "comp")


def split_blocks(phased: DataFrame, threshold: float = 0.8) -> DataFrame:
    """phased with comp split before each variant whose chance of no switch (post_notsw, log10) is below the threshold; parts
    are named by their first variant."""
    w = Window.partitionBy("comp").orderBy("snp")
    cut_here = F.coalesce(F.col("post_notsw") < F.log10(F.lit(threshold)), F.lit(False)) & (F.row_number().over(w) > 1)
    part = phased.withColumn("_c", cut_here.cast("int")).withColumn("_p", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.withColumn("comp", F.min("snp").over(Window.partitionBy("comp", "_p"))).drop("_c", "_p")


#: Tags that a phased variant keeps, and the tags written for it (fixed by the output format).
KEPT, WRITTEN = ("AD", "DP", "GQ"), ("PQ", "PD", "PS")
TAG_LINES = [
    '##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set: position of its first variant">',
    '##FORMAT=<ID=PQ,Number=1,Type=Integer,Description="Phred quality of the phase">',
    '##FORMAT=<ID=PD,Number=1,Type=Integer,Description="Fragments that cover the variant">',
]


def phased_variant_lines(spark: SparkSession, path: str, phased: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(part, ix, value): a variant file with phase; part 0 is its header, ix the order within a part.

    phased: snp (data line number), hap (0, 1 or null), first_pos and size of its block, post_hap (log10), n (fragments).
    A variant whose posterior is below the threshold gets ./. and one without a block of two keeps its genotype; both
    get an empty phase set. An unphased variant keeps all its other tags, a phased one those in KEPT.
    """
    head = numbered(spark, path, lambda v: v.startswith("#") & ~v.rlike("^##FORMAT=<ID=(PQ|PD|PS),"))
    head = head.select(F.lit(0).alias("part"), "ix", F.when(F.col("value").startswith("#CHROM"), F.concat(F.lit("\n".join(TAG_LINES) + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
    x = numbered(spark, path, lambda v: ~v.startswith("#") & (F.trim(v) != "")).join(phased, F.col("ix") == F.col("snp"), "left")
    x = x.withColumn("c", F.split("value", "\t")).withColumn("f", F.split(F.get("c", F.lit(8)), ":")).withColumn("s", F.split(F.get("c", F.lit(9)), ":"))
    gt = F.col("s")[0]
    a, b = F.substring(gt, 1, 1), F.substring(gt, 3, 1)
    third = (a == "2") | (b == "2")
    one, two = F.when(third, a).otherwise("0"), F.when(third, b).otherwise("1")
    in_block = F.coalesce(F.col("hap").isNotNull() & (F.col("size") >= 2), F.lit(False))
    kind = F.when(~in_block, 0).when(F.col("post_hap") < F.log10(F.lit(threshold)), 2).otherwise(1)
    x = x.withColumn("kind", kind).withColumn("gt", F.when(F.col("kind") == 0, F.concat(a, F.lit("/"), b)).when(F.col("kind") == 2, "./.").when(F.col("hap") == 0, F.concat_ws("|", one, two)).otherwise(F.concat_ws("|", two, one)))
    tags = F.filter(F.arrays_zip("f", "s"), lambda t: F.when(F.col("kind") == 0, ~t.f.isin("GT", *WRITTEN)).otherwise(t.f.isin(*KEPT)))
    x = x.withColumn("t", tags)
    # a certain phase has no logarithm of its error
    pq = F.floor(F.least(F.coalesce(-10 * F.log10(1 - F.pow(F.lit(10.0), F.col("post_hap"))), F.lit(100.0)), F.lit(100.0)) + 0.5).cast("string")
    written = F.when(F.col("kind") == 1, F.concat_ws(":", pq, F.col("n").cast("string"), F.col("first_pos").cast("string"))).otherwise(".")
    names = F.concat_ws(":", F.lit("GT"), F.transform("t", lambda t: t.f), F.when(F.col("kind") == 1, ":".join(WRITTEN)).otherwise("PS"))
    values = F.concat_ws(":", F.col("gt"), F.transform("t", lambda t: t.s), written)
    return head.unionByName(x.select(F.lit(1).alias("part"), "ix", F.concat_ws("\t", F.slice("c", 1, 8), names, values).alias("value")))


def call_indels(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """(read_id, snp, allele 1, qv): heterozygous indels that an alignment shows at their place and with their length.

    An indel stands one base after its anchor, so an equal key of contig, place and length joins the two sides.
    """
    start = F.struct(F.col("pos").alias("r"), F.lit(1).alias("q"), F.array().cast("array<struct<at:int,q:int,size:int>>").alias("p"))

    def step(s, x):
        size = F.when(x.op == "I", x.len).when(x.op == "D", -x.len)
        return F.struct((s.r + F.when(x.op.isin("M", "D", "N"), x.len).otherwise(0)).cast("int").alias("r"), (s.q + F.when(x.op.isin("M", "I", "S"), x.len).otherwise(0)).cast("int").alias("q"),
            F.when(size.isNotNull(), F.concat(s.p, F.array(F.struct(s.r.alias("at"), s.q.alias("q"), size.cast("int").alias("size"))))).otherwise(s.p).alias("p"))

    shown = reads.select("read_id", "chrom", "qual", F.explode(F.aggregate("cigar", start, step, lambda s: s.p)).alias("p")).select("read_id", "chrom", F.col("p.at").alias("at"), F.col("p.size").alias("size"), from_char(F.substring(F.col("qual"), F.col("p.q"), F.lit(1))).alias("qv"))
    known = variants.where("het").select("chrom", (F.col("pos") + 1).alias("at"), (F.length(F.split("alt", ",")[0]) - F.length("ref")).alias("size"), F.col("var_ix").alias("snp")).where("size <> 0")
    return shown.join(known, ["chrom", "at", "size"]).select("read_id", "snp", F.lit(1).alias("allele"), "qv")
