"""Command line: extract, link, phase, evaluate, prune, convert, crossing, repair, simulate."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.alleles import binary_flag
from .operators import evaluate, extract, hic, likelihood, linking, repair
from .operators.calls import coverage
from .plans import genotype
from .plans.phase import phase
from .sources import bam, simulate, text
from .storage import cut


def save(lines: DataFrame, path: str, *order: str) -> None:
    """Text parts in order, as a folder."""
    (lines.orderBy(*order) if order else lines).select("value").write.mode("overwrite").text(path)


def alignments(spark: SparkSession, paths: list[str], min_mapq: int, region: str | None = None, supplementary: bool = False) -> DataFrame:
    binary = [p for p in paths if p.endswith(".bam")]
    parts = [bam.read_bam(spark, binary, region, min_mapq, supplementary)] if binary else []
    for p in paths:
        if p not in binary:
            sam = text.read_sam(spark, p, min_mapq, supplementary)
            if region:
                name, first, last = bam.parsed_region(region)
                sam = text.aligned_pieces(sam).where((F.col("chrom") == name) & (F.col("pos") <= last) & (F.col("end") >= first)).select(*sam.columns)
            parts.append(sam.select(*[c.split()[0] for c in bam.RECORD.replace("array<struct<len:int,op:string>>", "x").split(", ")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phased_table(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """snp, comp, hap, post_hap, n, and first_pos and size of the block."""
    return placed(genotype.refine(calls, phase(calls)), calls, variants)


def placed(rows: DataFrame, calls: DataFrame, variants: DataFrame) -> DataFrame:
    rows = rows.join(variants.select(F.col("var_ix").alias("snp"), "pos"), "snp").join(coverage(calls), "snp", "left")
    blocks = rows.groupBy("comp").agg(F.min_by("pos", "snp").alias("first_pos"), F.count("*").alias("size"))
    return rows.join(blocks, "comp").drop("pos", "flipped")


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Fragments of alignments over the heterozygous single-base variants (and indels, with a reference) to OUTPUT."""
    listed = text.read_extraction_variants(spark, a.VCF, triallelic=a.triallelic)
    reads = extract.routed(extract.on_known_contigs(alignments(spark, a.bam, a.mmq, a.region, a.supplementary), listed), a.minIS, a.maxIS)
    reads = extract.paired_only(reads) if a.PEonly else reads
    v = text.eligible(listed, a.hom, False, a.triallelic).select("var_ix", "chrom", "pos", F.col("allele1").alias("ref"), F.col("allele2").alias("alt"), F.lit(True).alias("het"), F.lit(False).alias("is_indel"))
    mate = (F.col("flag").bitwiseAND(F.lit(128)) != 0).cast("int").alias("mate")
    keep = ("read_id", "snp", "allele", "qv")
    of = reads.withColumn("read_id", F.struct("read_id", mate, "isize", "bx", "single"))
    found = text.call_snps(of, v, a.mbq).select(*keep)
    if a.indels or a.realign_variants:
        from .operators import indels, params, realign

        alone = reads.where("single")
        seen = params.with_reference(alone, text.read_fasta(spark, a.ref))
        key = alone.select("read_id", F.struct("read_id", mate, "isize", "bx", "single").alias("k")).distinct()
        if a.realign_variants:  # single reads alone; pairs stay as they are aligned
            more, found = realign.realigned_calls(seen, listed, a.sumall, a.indels), found.where("NOT read_id.single")
        else:
            more = indels.call_indels(seen, listed)
        found = found.unionByName(more.join(key, "read_id").select(F.col("k").alias("read_id"), "snp", "allele", "qv"))
    calls = found.select("read_id.read_id", "read_id.mate", "read_id.isize", F.col("read_id.bx").alias("barcode"), "read_id.single", "snp", "allele", "qv")
    least = 1 if a.singlereads or a.barcodes else 2
    parts = [extract.single_fragments(calls.where("single"), least), extract.pair_fragments(calls.where("NOT single"), least)]
    lines = [extract.typed_lines(f, c, 2 if a.barcodes else 1 if a.hic else 0) for f, c in parts]
    extract.in_order(lines[0].unionByName(lines[1])).write.mode("overwrite").text(a.output)


def run_link(spark: SparkSession, a: argparse.Namespace) -> None:
    fragments, calls = text.read_fragments(spark, a.fragments, barcodes=True)
    spans = linking.molecule_spans(text.aligned_pieces(alignments(spark, a.bam, 20)), a.distance, a.use_tag)
    f, c = linking.link(fragments, calls, text.read_variants(spark, a.VCF), spans, a.maxbq, 1 if a.single_SNP_frags else 2)
    linking.linked_lines(f, c).write.mode("overwrite").text(a.output)


def run_phase(spark: SparkSession, a: argparse.Namespace) -> None:
    """Blocks to OUTPUT, and the variant file with phase to OUTPUT.phased.VCF; both are folders of text parts in order."""
    variants = text.read_variants(spark, a.VCF)
    fragments, calls = text.read_fragment_files(spark, [a.fragments, *([a.fragments2] if a.fragments2 else [])])
    calls = extract.checked_bounds(calls, text.count_variants(spark, a.VCF))
    if a.max_IS is not None:
        calls = calls.join(extract.near_enough(fragments, a.max_IS).select("frag"), "frag", "left_semi")
    known = variants.where("het" if not a.snvs_only else "het AND NOT is_indel").select(F.col("var_ix").alias("snp"))
    kept = cut(calls.where(F.col("qv") >= a.mbq).withColumn("qv", F.least("qv", F.lit(a.maxbq))).join(known, "snp", "left_semi"), "calls")
    if a.crossing:  # a known model instead of one estimated along with the phase
        rates = text.read_crossing_model(spark, a.crossing).withColumnRenamed("prob", "rate")
        with_h = cut(kept.join(hic.with_crossing(fragments.select("frag", "mate2_ix", "isize"), rates).select("frag", "mate2_ix", "h"), "frag", "left"), "mates")
        found = genotype.refine(with_h, cut(phase(with_h, a.converge), "phase"))
    elif a.hic:
        found, rates = hic.crossing_em(fragments, kept)
        save(text.crossing_model_lines(rates), a.output + ".crossing", "bin")
    else:
        first = cut(phase(kept, a.converge), "phase")
        found = genotype.call_homozygous(kept, first, variants.select(F.col("var_ix").alias("snp"), "homozygous_prior")) if a.call_homozygous else genotype.refine(kept, first)
    rows = cut(placed(found, kept, variants), "phased")
    blocks = rows
    if a.error_analysis or a.split_blocks:
        blocks = rows.join(genotype.switch_scores(kept, rows).select("snp", "post_notsw"), "snp")
        blocks = text.split_blocks(blocks, a.threshold) if a.split_blocks else blocks
    save(text.block_lines(blocks, variants, kept, None if a.skip_prune else a.threshold), a.output, "comp")
    if a.outvcf:
        save(text.phased_variant_lines(spark, a.VCF, rows, a.threshold), a.output + ".phased.VCF", "part", "ix")
    if a.genotyping:
        g = genotype.genotype(kept, rows).join(variants.select(F.col("var_ix").alias("snp"), "chrom", "pos"), "snp")
        save(g.select("snp", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "genotype", F.format_string("%.6f", "posterior")).alias("value")), a.output + ".genotypes", "snp")
    if a.tags:
        tags = likelihood.fragment_tags(kept, rows).join(fragments.select("frag", "name"), "frag")
        save(tags.select("name", F.concat_ws(" ", "name", F.col("ps").cast("string"), F.col("hp").cast("string"), F.col("pq").cast("string")).alias("value")), a.output + ".tags", "name")


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """One report over all contigs; the files of a contig stand at the same place of each list."""
    n = len(a.VCF)
    if any(len(x) != n for x in (a.blocks, a.truth_VCF, a.truth_blocks) if x):
        raise SystemExit("the lists of files differ in length")
    parts = []
    for i, path in enumerate(a.VCF):
        variants = text.read_variants(spark, path)
        truth = evaluate.phased_blocks(text.read_variants(spark, a.truth_VCF[i]), a.indels) if a.truth_VCF else evaluate.assembled(text.read_blocks(spark, a.truth_blocks[i]), variants, a.indels)
        found = evaluate.assembled(text.read_blocks(spark, a.blocks[i]), variants, a.indels) if a.blocks else evaluate.phased_blocks(variants, a.indels)
        parts.append((truth, evaluate.largest_block(found) if a.largest else found, variants))
    save(evaluate.report_lines(evaluate.report(*evaluate.together(parts), a.indels)).coalesce(1), a.output)


def run_prune(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = text.prune_blocks(text.read_blocks(spark, a.blocks), a.mismatch, a.switch, a.discrete)
    save(text.pruned_block_lines(rows), a.output, "block", "part")


def run_convert(spark: SparkSession, a: argparse.Namespace) -> None:
    text.convert_fragments(spark.read.text(a.fragments), a.to == "new").write.mode("overwrite").text(a.output)


def run_crossing(spark: SparkSession, a: argparse.Namespace) -> None:
    fragments, calls = text.read_fragments(spark, a.fragments)
    if a.blocks:
        truth = text.read_blocks(spark, a.blocks).select("block", "snp", "a1")
    else:
        truth = evaluate.phased_blocks(text.read_variants(spark, a.VCF), True).select("block", "snp", "a1")
    save(text.crossing_model_lines(hic.known_phase_rates(fragments, calls, truth, a.bin), a.bin), a.output, "bin")


def run_repair(spark: SparkSession, a: argparse.Namespace) -> None:
    save(repair.repair(repair.read_alignments(spark, a.first, a.second), a.min_mapq), a.output, "ord", "read_id", "value")


def run_simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    s = simulate.Settings(a.read_length, a.coverage, a.ref_length, a.miscall, a.missing, a.switch, a.snp_rate, a.hic_span, a.seed)
    sites = cut(simulate.variants(spark, s), "sites")
    save(simulate.variant_lines(sites, s), a.output + ".vcf", "snp")
    extract.in_order(simulate.fragment_lines(simulate.calls(spark, s, sites))).write.mode("overwrite").text(a.output + ".frags")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haplomill", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *needed: str) -> argparse.ArgumentParser:
        x = sub.add_parser(name)
        for n in (*needed, "output"):
            x.add_argument(f"--{n}", required=True)
        x.set_defaults(run=run)
        return x

    def flags(x: argparse.ArgumentParser, *names: str, default: bool = False) -> None:
        for n in names:
            x.add_argument(f"--{n}", type=lambda v: bool(binary_flag(v)), nargs="?", const=True, default=default)

    x = command("extract", run_extract, "VCF")
    x.add_argument("--bam", nargs="+", required=True, help="alignments, binary or text")
    x.add_argument("--ref", help="reference sequence, for indels")
    x.add_argument("--region")
    for n, v in (("mmq", 20), ("mbq", 13), ("minIS", 0), ("maxIS", 1000)):
        x.add_argument(f"--{n}", type=int, default=v)
    flags(x, "indels", "realign_variants", "sumall", "hom", "triallelic", "PEonly", "singlereads", "barcodes", "hic", "supplementary")
    x = command("link", run_link, "fragments", "VCF")
    x.add_argument("--bam", nargs="+", required=True)
    x.add_argument("--distance", type=int, default=20_000)
    x.add_argument("--maxbq", type=int, default=40)
    flags(x, "use_tag", "single_SNP_frags")
    x = command("phase", run_phase, "fragments", "VCF")
    x.add_argument("--fragments2")
    x.add_argument("--threshold", type=float, default=0.8, help="least posterior of a phase")
    x.add_argument("--mbq", type=int, default=6)
    x.add_argument("--maxbq", type=int, default=40)
    x.add_argument("--max_IS", type=int)
    x.add_argument("--converge", type=int, default=5, help="passes without gain that end a search")
    x.add_argument("--crossing", help="a file of crossing probabilities by insert size")
    flags(x, "hic", "skip_prune", "error_analysis", "split_blocks", "call_homozygous", "snvs_only", "tags", "genotyping")
    flags(x, "outvcf", default=True)
    x = command("evaluate", run_evaluate)
    x.add_argument("--VCF", nargs="+", required=True)
    x.add_argument("--blocks", nargs="+", help="assembled blocks; without them the phase of the variant file is evaluated")
    truth = x.add_mutually_exclusive_group(required=True)
    truth.add_argument("--truth_VCF", nargs="+")
    truth.add_argument("--truth_blocks", nargs="+")
    flags(x, "indels", "largest")
    x = command("prune", run_prune, "blocks")
    x.add_argument("--mismatch", type=float, default=30)
    x.add_argument("--switch", type=float, default=30)
    flags(x, "discrete")
    x = command("convert", run_convert, "fragments")
    x.add_argument("--to", choices=["new", "old"], default="new")
    x = command("crossing", run_crossing, "fragments")
    known = x.add_mutually_exclusive_group(required=True)
    known.add_argument("--VCF")
    known.add_argument("--blocks")
    x.add_argument("--bin", type=int, default=50_000)
    x = command("repair", run_repair, "first", "second")
    x.add_argument("--min_mapq", type=int, default=20)
    x = command("simulate", run_simulate)
    for n, t, v in (("read_length", int, 10_000), ("coverage", float, 5.0), ("ref_length", int, 250_000_000), ("miscall", float, 0.02), ("missing", float, 0.0), ("switch", float, 0.0), ("snp_rate", float, 0.0008), ("hic_span", int, 0), ("seed", int, 1)):
        x.add_argument(f"--{n}", type=t, default=v)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
