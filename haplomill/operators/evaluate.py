"""Errors of an assembly against a truth, and block statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.alleles import contig, is_diploid, uniform


def transitions(rows: DataFrame) -> DataFrame:
    """Changes of agreement along each block; rows: block, snp, match (0 or 1)."""
    w = Window.partitionBy("block").orderBy("snp")
    return rows.withColumn("_p", F.lag("match").over(w)).groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("_p") != F.col("match")).alias("changes"))


def flat_errors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.count("*").alias("n"), F.least(F.count_if(F.col("match") == 0), F.count_if(F.col("match") == 1)).alias("flat"))


def switch_mismatch(bits: Column, lead: Column | None = None) -> Column:
    """(switches, mismatches) of an ordered array of agreement bits; two switches in a row are one mismatch.

    lead: how many alternations the array begins with, if they aren't those of the bits themselves.
    """
    first = F.element_at(bits, 1)
    if lead is None:
        lead = F.aggregate(
            bits, F.struct(F.lit(-1).alias("v"), F.lit(-1).alias("n"), F.lit(True).alias("go")),
            lambda s, v: F.struct(v.cast("int").alias("v"), F.when(s.go & (s.v != v), s.n + 1).otherwise(s.n).alias("n"), (s.go & (s.v != v)).alias("go")), lambda s: s.n)
    start = F.struct((1 - first).cast("int").alias("on"), (lead % 2 == 1).alias("last"), F.lit(0).alias("sw"), F.lit(0).alias("mm"))

    def step(s, v):
        hit = v == s.on
        return F.struct(F.when(hit, 1 - s.on).otherwise(s.on).cast("int").alias("on"), (hit & ~s.last).alias("last"),
            F.when(hit & s.last, F.greatest(F.lit(0), s.sw - 1)).when(hit, s.sw + 1).otherwise(s.sw).cast("int").alias("sw"), F.when(hit & s.last, s.mm + 1).otherwise(s.mm).cast("int").alias("mm"))

    end = lambda s: F.struct(F.when(s.last, F.greatest(F.lit(0), s.sw - 1)).otherwise(s.sw).cast("int").alias("switches"), F.when(s.last, s.mm + 1).otherwise(s.mm).cast("int").alias("mismatches"))
    return F.aggregate(F.slice(bits, F.lit(2), F.size(bits)), start, step, end)


def block_errors(rows: DataFrame) -> DataFrame:
    """block, n, switches, mismatches, flat; a block is one unit of phase and its bits stay together."""
    g = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("snp", "match"))).alias("r"))
    bits = g.withColumn("v", F.transform("r", lambda x: x.match.cast("int")))
    ones = F.aggregate("v", F.lit(0), lambda s, x: s + x)
    e = bits.withColumn("e", switch_mismatch(F.col("v")))
    return e.select("block", F.size("v").alias("n"), F.col("e.switches").alias("switches"), F.col("e.mismatches").alias("mismatches"), F.least(ones, F.size("v") - ones).alias("flat"))


def error_rates(rows: DataFrame) -> DataFrame:
    e = block_errors(rows)
    s = e.agg(F.sum("switches").alias("switches"), F.sum("mismatches").alias("mismatches"), F.sum("flat").alias("flat"), F.sum(F.when(F.col("n") >= 4, F.col("n") - 3).otherwise(0)).alias("poss_sw"), F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("poss_mm"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return s.select("switches", "mismatches", "flat", rate("switches", "poss_sw").alias("switch_rate"), rate("mismatches", "poss_mm").alias("mismatch_rate"), rate("flat", "poss_mm").alias("flat_rate"))


def _first_over_half(blocks: DataFrame, order: str, weight: str, total) -> DataFrame:
    """Value of `order` of the first block, in falling order, at which the running weight exceeds half of total.

    Blocks are summed per distinct value first, so the single ordered pass is over values, not blocks.
    """
    per = blocks.groupBy(F.col(order).alias("x")).agg(F.sum(weight).alias("w"))
    w = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("run", F.sum("w").over(w)).crossJoin(F.broadcast(total)).where("run > total / 2").agg(F.max("x").alias("value"))


def n50(blocks: DataFrame) -> DataFrame:
    return _first_over_half(blocks, "span", "span", blocks.agg(F.sum("span").alias("total"))).select(F.col("value").alias("n50"))


def an50(blocks: DataFrame, het_snps: DataFrame) -> DataFrame:
    """het_snps: one row with column total. Adjusted span: span * phased / indices covered."""
    b = blocks.withColumn("adj", F.round(F.col("span") * F.col("phased") / (F.col("last_ix") - F.col("first_ix") + 1), 6))
    return _first_over_half(b, "adj", "phased", het_snps).select(F.coalesce("value", F.lit(0.0)).alias("an50"))


def median_span(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.median("span").alias("median_span"))


def largest_fraction(blocks: DataFrame, k: int = 100) -> DataFrame:
    """Share of all phased variants in the x largest blocks, x up to k."""
    top = blocks.orderBy(F.desc("phased"), "comp").limit(k)
    w = Window.orderBy(F.desc("phased"), "comp").rowsBetween(Window.unboundedPreceding, 0)
    return top.crossJoin(F.broadcast(blocks.agg(F.sum("phased").alias("total")))).select(F.row_number().over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"), F.round(F.sum("phased").over(w) / F.col("total"), 6).alias("fraction"))


def mec(calls: DataFrame, hap, per_block: bool = False) -> DataFrame:
    """Minimum error correction: the smaller count of disagreements with either copy, per fragment or per run of indices."""
    c = calls.withColumn("d", (F.col("allele") != hap(F.col("snp"))).cast("int")).withColumn("run", F.lit(0).cast("long"))
    if per_block:
        c = c.withColumn("run", F.col("snp") - F.row_number().over(Window.partitionBy("frag").orderBy("snp")))
    e = c.groupBy("frag", "run").agg(F.least(F.sum("d"), F.sum(1 - F.col("d"))).alias("e"))
    return e.groupBy("frag").agg(F.sum("e").alias("mec"))


def distance_accuracy(rows: DataFrame, bin_size: int, share: float = 1.0, seed: int = 1) -> DataFrame:
    """Share of pairs of a block phased alike in truth and assembly, by distance; blocks pair within themselves.

    share: on so much of the variants only, drawn by a hash; pairs grow with its square, so a long block is sampled.
    """
    rows = rows if share >= 1 else rows.where(uniform(seed, F.col("block"), F.col("snp")) < share)
    g = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("snp", "match"))).alias("r"))
    x = g.select("r", F.posexplode("r").alias("i", "x")).select("x", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("y"))
    return x.groupBy(F.floor((F.col("y.snp") - F.col("x.snp")) / bin_size).alias("bin")).agg(F.round(F.avg((F.col("x.match") == F.col("y.match")).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def evaluable(variants: DataFrame, indels: bool = False) -> DataFrame:
    """Heterozygous variants with at most two alternatives, of single bases unless indels are asked for, with alleles a0, a1, a2.

    Only the alleles that the genotype names have to be single bases. Positions stay as they are.
    """
    alts = F.split("alt", ",")
    v = variants.where(is_diploid(F.col("genotype")) & (F.substring("genotype", 1, 1) != F.substring("genotype", 3, 1)) & (F.size(alts) <= 2))
    v = v.withColumn("alt1", alts[0]).withColumn("alt2", F.try_element_at(alts, F.lit(2)))
    if not indels:
        named = lambda k: F.substring("genotype", 1, 3).contains(str(k))
        v = v.where((~named(0) | (F.length("ref") == 1)) & (~named(1) | (F.length("alt1") == 1)) & (~named(2) | F.coalesce(F.length("alt2") == 1, F.lit(False))))
    return v


def _longer(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("block").agg(F.count("*").alias("_k")).where("_k > 1").select("block"), "block", "left_semi")


def assembled(blocks: DataFrame, variants: DataFrame, indels: bool = False) -> DataFrame:
    """block, snp, chrom, pos, a1, a2, ref, alt1, alt2 of a block file's rows on evaluable variants, in blocks of more than one.

    A row whose contig or position isn't that of its variant stops the run.
    """
    v = evaluable(variants, indels).select(F.col("var_ix").alias("snp"), F.col("chrom").alias("_c"), F.col("pos").alias("_p"))
    j = blocks.join(v, "snp").where(F.size(F.split("alt", ",")) <= 2)
    wrong = F.raise_error(F.concat(F.lit("the block file and the variant file differ at variant "), (F.col("snp") + 1).cast("string"))).cast("boolean")
    j = j.where(F.when((contig(F.col("chrom")) != contig(F.col("_c"))) | (F.col("pos") != F.col("_p")), wrong).otherwise(F.lit(True)))
    alts = F.split("alt", ",")
    return _longer(j.select("block", "snp", "chrom", "pos", "a1", "a2", "ref", alts[0].alias("alt1"), F.try_element_at(alts, F.lit(2)).alias("alt2")))


def phased_blocks(variants: DataFrame, indels: bool = False) -> DataFrame:
    """The same of a phased variant file: genotypes with |, a block for each phase set, one per contig if no line has one.

    variants has format and sample; a variant without a phase set, or with '.', is left out where others have one.
    """
    ps = F.try_element_at(F.map_from_arrays(F.split("format", ":"), F.split("sample", ":")), F.lit("PS"))
    v = evaluable(variants, indels).withColumn("_ps", ps)
    any_set = variants.agg(F.max(F.array_contains(F.split("format", ":"), "PS")).alias("x")).first().x  # one row
    block = F.concat_ws(":", "chrom", "_ps") if any_set else F.col("chrom")
    v = v.where(F.substring("genotype", 2, 1) == "|")
    v = v.where(F.col("_ps").isNotNull() & (F.col("_ps") != ".")) if any_set else v
    return _longer(v.select(block.alias("block"), F.col("var_ix").alias("snp"), "chrom", "pos", F.substring("genotype", 1, 1).alias("a1"), F.substring("genotype", 3, 1).alias("a2"), "ref", "alt1", "alt2"))


def largest_block(rows: DataFrame) -> DataFrame:
    top = rows.groupBy("block").agg(F.count("*").alias("_n"), F.min("snp").alias("_s")).orderBy(F.desc("_n"), "_s").limit(1).select("block")
    return rows.join(F.broadcast(top), "block", "left_semi")  # one row


def aligned(truth: DataFrame, assembly: DataFrame) -> DataFrame:
    """One row per position and pair of a truth and an assembly block: t_block, block, k (row of the assembly block), pos, x,
    y1, y2 (alleles of the truth's first copy and of both assembled ones), ok (both sides know the same two alleles).

    Rows without an allele on one side are left out; k shows where they were.
    """
    w = Window.partitionBy("block").orderBy("snp")
    a = assembly.select("block", "snp", contig(F.col("chrom")).alias("c"), "pos", F.col("a1").alias("y1"), F.col("a2").alias("y2"), F.row_number().over(w).alias("k"), F.struct("ref", "alt1", "alt2").alias("s"))
    t = truth.select(F.col("block").alias("t_block"), contig(F.col("chrom")).alias("c"), "pos", F.col("a1").alias("x"), F.col("a2").alias("x2"), F.struct("ref", "alt1", "alt2").alias("u"))
    j = a.join(t, ["c", "pos"]).where("x <> '-' AND y1 <> '-' AND y2 <> '-'")
    alike = (F.array_sort(F.array_distinct(F.array("x", "x2"))) == F.array_sort(F.array_distinct(F.array("y1", "y2")))) & F.col("s").eqNullSafe(F.col("u"))
    return j.select("t_block", "block", "k", "snp", "pos", "x", "y1", "y2", alike.alias("ok"))


def compared(rows: DataFrame) -> DataFrame:
    """t_block, block, known, switches, mismatches, flat, different of each pair of blocks of aligned().

    Either copy is scored against the truth and the one with fewer switches counts (the second if equal). Where a block
    begins, a run of alternations decides whether they are mismatches or switches; that run ends at a row that one side
    doesn't know, whatever its alleles are called. All rows of a pair of blocks meet, as a switch is defined along them.
    """
    g = rows.groupBy("t_block", "block").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("x") == F.col("y1")).cast("int").alias("v1"), (F.col("x") == F.col("y2")).cast("int").alias("v2"), "ok"))).alias("r"))
    from_first = F.slice("r", F.greatest(F.array_position(F.transform("r", lambda e: e.ok), True).cast("int"), F.lit(1)), F.size("r"))
    g = g.withColumn("f", from_first).withColumn("s", F.filter("f", lambda e: e.ok)).withColumn("known", F.size("s"))

    def scored(v: str) -> Column:
        start = F.struct(F.col("f")[0].k.alias("k"), F.col("f")[0][v].alias("v"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def step(s, e):
            on = s.go & (e.k == s.k + 1) & (e[v] != s.v)
            return F.struct(e.k.alias("k"), e[v].alias("v"), F.when(on, s.n + 1).otherwise(s.n).alias("n"), on.alias("go"))

        lead = F.aggregate(F.slice("f", F.lit(2), F.size("f")), start, step, lambda s: s.n)
        return F.when(F.col("known") > 0, switch_mismatch(F.transform("s", lambda e: e[v]), lead))

    g = g.withColumn("e1", scored("v1")).withColumn("e2", scored("v2"))
    best = F.when(F.col("e1.switches") < F.col("e2.switches"), F.col("e1")).otherwise(F.col("e2"))
    wrong = lambda v: F.aggregate("s", F.lit(0), lambda n, e: n + 1 - e[v])
    return g.select("t_block", "block", "known", F.coalesce(best.switches, F.lit(0)).alias("switches"), F.coalesce(best.mismatches, F.lit(0)).alias("mismatches"),
        F.least(wrong("v1"), wrong("v2")).alias("flat"), (F.size("r") - F.size(F.filter("r", lambda e: e.ok))).alias("different"))


def report(truth: DataFrame, assembly: DataFrame, variants: DataFrame, indels: bool = False) -> DataFrame:
    """One row: switches, mismatches, flat, their rates, phased, het_snps, AN50, N50, most_phased (of a block), different."""
    e = compared(aligned(truth, assembly)).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("switches", "mismatches", "flat", "different")],
        F.coalesce(F.sum(F.when(F.col("known") >= 4, F.col("known") - 3)), F.lit(0)).alias("poss_sw"), F.coalesce(F.sum(F.when(F.col("known") >= 2, F.col("known"))), F.lit(0)).alias("poss_mm"))
    phased = assembly.where("a1 <> '-'")
    blocks = phased.groupBy("block").agg(F.min("snp").alias("first_ix"), F.max("snp").alias("last_ix"), F.count("*").alias("phased"), (F.max("pos") - F.min("pos")).alias("span"))
    het = evaluable(variants, indels).agg(F.count("*").alias("total"))
    one = e.crossJoin(het.withColumnRenamed("total", "het_snps")).crossJoin(blocks.agg(F.coalesce(F.sum("phased"), F.lit(0)).alias("phased"), F.coalesce(F.max("phased"), F.lit(0)).alias("most_phased")))  # one row each
    one = one.crossJoin(an50(blocks, het)).crossJoin(n50(blocks))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return one.select("switches", "mismatches", "flat", rate("switches", "poss_sw").alias("switch_rate"), rate("mismatches", "poss_mm").alias("mismatch_rate"), rate("flat", "poss_mm").alias("flat_rate"),
        "phased", "het_snps", F.col("an50").alias("AN50"), F.coalesce("n50", F.lit(0)).alias("N50"), "most_phased", "different")


def together(parts: list[tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(truth, assembly, variants) of several contigs as one: blocks and variants are numbered apart. A contig that stands in
    two of them stops the run."""
    both = None
    for i, (truth, found, variants) in enumerate(parts):
        named = [x.withColumn("block", F.concat(F.lit(f"{i}:"), F.col("block").cast("string"))).withColumn("snp", F.col("snp") + i * (1 << 40)) for x in (truth, found)]
        now = [*named, variants.withColumn("_file", F.lit(i))]
        both = now if both is None else [x.unionByName(y) for x, y in zip(both, now)]
    truth, found, variants = both
    twice = variants.groupBy(contig(F.col("chrom")).alias("c")).agg(F.countDistinct("_file").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"contig {twice.c} stands in several files")
    return truth, found, variants.drop("_file")


def added_reports(reports: DataFrame, key: str = "contig") -> DataFrame:
    """One row from reports of several contigs, each counted once; a contig that comes twice stops the run. Rows have the
    counts and the possible counts (poss_sw, poss_mm) of a contig."""
    again = F.raise_error(F.lit("a contig is reported twice")).cast("boolean")
    one = reports.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("switches", "mismatches", "flat", "poss_sw", "poss_mm")], F.count("*").alias("_n")).where(F.when(F.col("_n") > 1, again).otherwise(F.lit(True)))
    s = one.agg(F.array_sort(F.collect_set(key)).alias("contigs"), *[F.sum(c).alias(c) for c in ("switches", "mismatches", "flat", "poss_sw", "poss_mm")])
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return s.select("contigs", "switches", "mismatches", "flat", rate("switches", "poss_sw").alias("switch_rate"), rate("mismatches", "poss_mm").alias("mismatch_rate"), rate("flat", "poss_mm").alias("flat_rate"))


def report_lines(r: DataFrame) -> DataFrame:
    """A report as text, one measure a line."""
    shown = (("switch rate", "switch_rate"), ("mismatch rate", "mismatch_rate"), ("flat rate", "flat_rate"), ("phased count", "phased"), ("AN50", "AN50"), ("N50", "N50"), ("num snps max blk", "most_phased"))
    return r.select(F.explode(F.array(*[F.format_string("%-20s%s", F.lit(t + ":"), F.col(c).cast("string")) for t, c in shown])).alias("value"))


def switch_distances(rows: DataFrame) -> DataFrame:
    """(t_block, block, at, length): stretches of an assembled block on which its better copy disagrees with the truth and
    that end before the block does; at is the variant that ends one. rows: as aligned()."""
    better = rows.groupBy("t_block", "block").agg((F.sum((F.col("x") == F.col("y1")).cast("int")) > F.sum((F.col("x") == F.col("y2")).cast("int"))).alias("one"))
    j = rows.join(better, ["t_block", "block"]).withColumn("good", F.when(F.col("one"), F.col("x") == F.col("y1")).otherwise(F.col("x") == F.col("y2")))
    w = Window.partitionBy("t_block", "block").orderBy("snp")
    j = j.withColumn("seen", F.coalesce(F.sum((~F.col("good")).cast("int")).over(w), F.lit(0))).withColumn("before", F.lag("good").over(w))
    ends = j.where(F.col("good") & ~F.coalesce(F.col("before"), F.lit(True)))
    v = Window.partitionBy("t_block", "block").orderBy("snp")
    return ends.select("t_block", "block", F.col("snp").alias("at"), (F.col("seen") - F.coalesce(F.lag("seen").over(v), F.lit(0))).cast("long").alias("length"))


def gap_coverage(spans: DataFrame, variants: DataFrame, width: int = 100_000) -> DataFrame:
    """(snp, n) for each variant (column snp): how many fragments reach over it from their first to their last one.

    spans: frag, first, last. A fragment costs two rows however far it reaches; they are added up per index, and running
    sums go over stretches of `width` indices, each from what the stretches before it leave (a row a stretch).
    """
    ends = spans.select(F.col("first").alias("snp"), F.lit(1).alias("d")).unionByName(spans.select((F.col("last") + 1).alias("snp"), F.lit(-1).alias("d")))
    d = ends.unionByName(variants.select("snp", F.lit(0).alias("d"))).groupBy("snp").agg(F.sum("d").alias("d"), F.max((F.col("d") == 0).cast("int")).alias("asked"))
    d = d.withColumn("part", F.floor(F.col("snp") / width))
    parts = d.groupBy("part").agg(F.sum("d").alias("t")).select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("part").orderBy("snp").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("own", F.sum("d").over(w)).where("asked = 1").join(parts, "part").select("snp", (F.col("base") + F.col("own")).alias("n"))


def improvement(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean and standard deviation of both over replicates, percent): by how much the mean fell."""
    stat = lambda d, p: d.groupBy(*keys).agg(F.avg(value).alias(f"{p}_mean"), F.stddev_pop(value).alias(f"{p}_std"))
    j = stat(before, "before").join(stat(after, "after"), keys)
    return j.withColumn("percent", F.round(100 * F.try_divide(F.col("before_mean") - F.col("after_mean"), F.col("before_mean")), 6))


def smoothed(points: DataFrame, width: int = 5, order: int = 2, x: str = "bin", y: str = "rate") -> DataFrame:
    """points with `smooth`: the value at x of the polynomial that fits a window of `width` neighbours best; the ends of the
    series keep the window nearest to them. A curve has a few hundred points, so one ordered pass holds it."""
    import numpy as np

    half = width // 2
    offsets = np.arange(width)
    table = {i: np.linalg.pinv(np.vander(offsets - i, order + 1, increasing=True))[0].tolist() for i in range(width)}
    w = Window.orderBy(x)
    rows = points.withColumn("_r", F.row_number().over(w) - 1).crossJoin(F.broadcast(points.agg(F.count("*").alias("_n"))))
    at = F.greatest(F.lit(0), F.least(F.col("_n") - width, F.col("_r") - half))
    near = F.collect_list(y).over(w.rowsBetween(-width, width))
    lead = F.greatest(F.lit(0), F.col("_r") - width)
    rows = rows.withColumn("_at", at).withColumn("_w", near).withColumn("_w", F.slice("_w", (F.col("_at") - lead + 1).cast("int"), F.lit(width)))
    weights = F.element_at(F.array(*[F.array(*[F.lit(v) for v in table[i]]) for i in range(width)]), (F.col("_r") - F.col("_at") + 1).cast("int"))
    fit = F.aggregate(F.zip_with("_w", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.withColumn("smooth", F.when(F.col("_n") >= width, fit).otherwise(F.col(y))).drop("_r", "_n", "_at", "_w")


def log_n50(blocks: DataFrame) -> DataFrame:
    """N50 of the phased spans in block order instead of by size, as a running log prints it: the span at which the running
    sum passes half of all. Blocks are passed in order of comp; the value depends on that order."""
    w = Window.orderBy("comp").rowsBetween(Window.unboundedPreceding, 0)
    total = blocks.agg(F.sum("span").alias("total"))
    hit = blocks.withColumn("run", F.sum("span").over(w)).crossJoin(F.broadcast(total)).where("run > total / 2")
    return hit.agg(F.min_by("span", "comp").alias("log_n50"))
