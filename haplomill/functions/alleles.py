"""Column expressions for genotypes, alleles, contig names and reproducible random numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Genotypes that are read: two alleles in 0, 1, 2 (fixed by the input format).
DIPLOID = "^[012][/|][012](:|$)"
BASES = "ACGT"


def first_allele(gt: Column) -> Column:
    return F.substring(gt, 1, 1)


def second_allele(gt: Column) -> Column:
    return F.substring(gt, 3, 1)


def is_diploid(gt: Column) -> Column:
    return F.coalesce(gt.rlike(DIPLOID), F.lit(False))


def status(gt: Column, triallelic: bool = False) -> Column:
    """'1' for 0/1 and 0/2 (either order), '0' for equal alleles, '2' for 1/2 if tri-allelic variants are asked for, else '3'."""
    a, b = first_allele(gt), second_allele(gt)
    return F.when(a == b, "0").when((a == "0") | (b == "0"), "1").otherwise("2" if triallelic else "3")


def allele_pair(ref: Column, alt: Column, gt: Column) -> Column:
    """struct(allele1, allele2) that a genotype of 0, 1, 2 stands for: the reference and the alternative it names, or
    both alternatives if it names no reference; an alternative that the list lacks is empty."""
    alts = F.split(alt, ",")
    at = lambda k: F.coalesce(F.try_element_at(alts, F.lit(k)), F.lit(""))
    second, reference = F.substring(gt, 1, 3).contains("2"), F.substring(gt, 1, 3).contains("0")
    return F.struct(F.when(second & ~reference, at(1)).otherwise(ref).alias("allele1"), F.when(second, at(2)).otherwise(at(1)).alias("allele2"))


def trimmed(a: Column, b: Column) -> Column:
    """struct(allele1, allele2) without the bases that both end with; each keeps one at least."""
    x, y = F.reverse(a), F.reverse(b)
    most = F.greatest(F.least(F.length(a), F.length(b)) - 1, F.lit(0))
    step = lambda n, i: F.when((n == i - 1) & (F.substring(x, i, F.lit(1)) == F.substring(y, i, F.lit(1))), i).otherwise(n)
    same = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), step)).otherwise(F.lit(0))
    return F.struct(F.substring(a, F.lit(1), F.length(a) - same).alias("allele1"), F.substring(b, F.lit(1), F.length(b) - same).alias("allele2"))


def contig(name: Column) -> Column:
    """Contig names are equal but for letters c, h, r at their beginning."""
    return F.regexp_replace(name, "^[chr]+", "")


def base_index(base: Column) -> Column:
    """1 to 4 for A, C, G, T in either case, else 0."""
    return F.when(F.length(base) == 1, F.instr(F.lit(BASES), F.upper(base))).otherwise(0)


def bucket(text: Column, size: int) -> Column:
    """The string hash 33 * h + c from 5381, taken modulo size whenever it reaches it."""
    step = lambda h, c: F.when(h * 33 + F.ascii(c) >= size, (h * 33 + F.ascii(c)) % size).otherwise(h * 33 + F.ascii(c))
    return F.when(F.length(text) > 0, F.aggregate(F.split(text, ""), F.lit(5381).cast("long"), step)).otherwise(F.lit(5381).cast("long"))


def distinct_kmers(text: Column, k: int) -> Column:
    """Whether no stretch of k bases occurs twice."""
    kmers = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return (F.length(text) <= k) | (F.size(F.array_distinct(kmers)) == F.size(kmers))


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that the seed and the keys determine, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def interval(seed: int, low: Column, high: Column, *keys) -> Column:
    """A whole number in [low, high), likewise."""
    return (low + F.floor(uniform(seed, *keys) * (high - low))).cast("long")


def binary_flag(value: str) -> int:
    """0 or 1 of an option's text; anything else is refused."""
    if value not in ("0", "1"):
        raise ValueError(f"{value!r} is neither 0 nor 1")
    return int(value)
