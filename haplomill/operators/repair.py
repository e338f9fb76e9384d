"""Repair of chimeric mate pairs: a piece of one mate that aligned next to the other mate is joined to that one.

All alignments of a pair meet by read name (a few rows); pairs are independent of each other. Joining alignments edits
strings along their CIGARs, which built-in functions can't express, so a pair runs through applyInPandas.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Distance of a piece, bases by which it may overlap, and the flag bits kept or set.
NEAR, OVERLAP = 2000, 10
PAIRED, BOTH, BACK, MATE_BACK, FIRST, SECOND = 1, 2, 16, 32, 64, 128
SINGLE_BITS, PAIR_BITS = 1791, 4093
FIELDS = ("flag", "chrom", "pos", "mapq", "cigar", "mate_chrom", "mate_pos", "isize", "seq", "qual", "tags")
ROWS = "read_id string, mate int, ord int, flag int, chrom string, pos int, mapq int, cigar string, mate_chrom string, mate_pos int, isize int, seq string, qual string, tags string"
OUT = "read_id string, ord int, repaired int, value string"


def read_alignments(spark: SparkSession, first: str, second: str) -> DataFrame:
    """ROWS of two files of alignments, one per mate; ord is the order of a read's alignments, the primary one first."""
    def of(path: str, mate: int) -> DataFrame:
        from ..sources.text import numbered

        c = F.split("value", "\t")
        x = numbered(spark, path, lambda v: ~v.startswith("@") & (F.trim(v) != "")).select("ix", c.alias("c"))
        number = lambda k: F.get("c", F.lit(k)).try_cast("int")
        return x.select(F.get("c", F.lit(0)).alias("read_id"), F.lit(mate).alias("mate"), F.col("ix").cast("int").alias("ord"), number(1).alias("flag"), F.get("c", F.lit(2)).alias("chrom"), number(3).alias("pos"), number(4).alias("mapq"), F.get("c", F.lit(5)).alias("cigar"), F.get("c", F.lit(6)).alias("mate_chrom"), number(7).alias("mate_pos"), number(8).alias("isize"), F.get("c", F.lit(9)).alias("seq"), F.get("c", F.lit(10)).alias("qual"), F.array_join(F.slice("c", F.lit(12), F.size("c")), "\t").alias("tags"))

    return of(first, 1).unionByName(of(second, 2))


class Aligned:
    """One alignment; positions from 0, the end one past the last base."""

    def __init__(self, row):
        self.__dict__.update({f: getattr(row, f) for f in FIELDS})
        self.read_id, self.pos = row.read_id, row.pos - 1
        self.ops = [(op, int(n)) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", self.cigar)]
        self.tag = {t[:2]: t for t in (self.tags or "").split("\t") if t}

    def has(self, bit: int) -> bool:
        return bool(self.flag & bit)

    @property
    def end(self) -> int:
        return self.pos + sum(n for op, n in self.ops if op in "MDN=X")

    @property
    def aligned(self) -> tuple[int, int]:
        """First and one past the last base of the sequence that isn't clipped."""
        soft = [n if op == "S" else 0 for op, n in self.ops if op != "H"]
        return (soft[0] if soft else 0), len(self.seq) - (soft[-1] if len(soft) > 1 else 0)


def distance(a: Aligned, b: Aligned) -> float:
    """Bases between two alignments, negative if they overlap."""
    if a.chrom != b.chrom:
        return float("inf")
    first, second = (a, b) if a.pos < b.pos else (b, a)
    return second.pos - first.end


def template_length(a: Aligned, b: Aligned) -> int:
    return max(abs(x - y) for x in (a.pos, a.end) for y in (b.pos, b.end))


def matched(a: Aligned) -> set[int]:
    out, at = set(), 0
    for op, n in a.ops:
        if op == "M":
            out.update(range(at, at + n))
        at += n if op not in "DNH" else 0
    return out


def elsewhere(a: Aligned, b: Aligned, cutoff: int = OVERLAP) -> bool:
    """Whether two alignments of a read use other parts of it, but for fewer than cutoff bases."""
    return len(matched(a) & matched(b)) < cutoff


def joined_md(a: str, b: str) -> str:
    """Two mismatch strings as one: the number that ends the first and the one that begins the second are added."""
    tail, lead = re.search(r"\d*$", a), re.match(r"\d*", b)
    return a[: tail.start()] + str(int(tail.group() or 0) + int(lead.group() or 0)) + b[lead.end() :]


def joined_ops(a: list, b: list, gap: int) -> list:
    """Two CIGARs without clips, with a skip of gap bases between them; equal operations that touch are one."""
    a, b = ([x for x in ops if x[0] not in "SH"] for ops in (a, b))
    if gap:
        return [*a, ("N", gap), *b]
    return [*a[:-1], (b[0][0], a[-1][1] + b[0][1]), *b[1:]] if a[-1][0] == b[0][0] else a + b


def join(a: Aligned, b: Aligned, gap: int) -> Aligned:
    """a, with b joined to it on the side where it lies; a's own mismatch string becomes the tag XD."""
    first, second = (a, b) if a.pos < b.pos else (b, a)
    (i, j), (k, m) = first.aligned, second.aligned
    pos, mapq, ops = first.pos, max(a.mapq, b.mapq), joined_ops(first.ops, second.ops, gap)
    seq, qual = first.seq[i:j] + second.seq[k:m], first.qual[i:j] + second.qual[k:m]
    md = [x.tag.get("MD", "MD:Z:0")[5:] for x in (first, second)]
    a.pos, a.mapq, a.ops, a.seq, a.qual = pos, mapq, ops, seq, qual
    a.tag = {t: v for t, v in a.tag.items() if t not in ("MD", "AS", "XS")} | {"XD": "XD:Z:" + joined_md(*md)}
    return a


def _taken(own: list[Aligned], mate: Aligned, min_mapq: int, skip_first: bool) -> tuple[Aligned, list[Aligned], Aligned | None]:
    """(primary, alignments, piece): the first alignment of a read that lies next to its mate and isn't the read itself; if
    the primary one does, the next takes its place."""
    own, main = list(own), own[0]
    for i, piece in enumerate(own):
        if skip_first and i == 0:
            continue
        d = distance(piece, mate)
        if d < NEAR and elsewhere(main, piece) and piece.has(BACK) != mate.has(BACK) and min(mate.mapq, main.mapq) >= min_mapq:
            if d < 0:
                continue
            if i == 0:
                if len(own) == 1:
                    break
                main = own[1]
                own[0], own[1] = own[1], own[0]
            return main, own, piece
    return main, own, None


def repaired_pair(one: list[Aligned], two: list[Aligned], min_mapq: int = 20) -> list[tuple[Aligned, int]]:
    """(alignment, repaired) of both mates, with flags, mate tags and template length set anew; unmapped ones are left out."""
    a, b = one[0], two[0]
    done = [0, 0]
    if not a.has(4) and not b.has(4):
        a, one, piece = _taken(one, b, min_mapq, False)
        if piece is not None:
            b, done[1] = join(b, piece, int(distance(piece, b))), 1
        b, two, piece = _taken([b, *two[1:]], a, min_mapq, bool(done[1]))
        if piece is not None:
            a, done[0] = join(a, piece, int(distance(a, piece))), 1
    text = lambda x: "".join(f"{n}{op}" for op, n in x.ops) or "*"
    a.tag["MC"], b.tag["MC"] = f"MC:Z:{text(b)}", f"MC:Z:{text(a)}"
    for x, n in ((a, done[0]), (b, done[1])):
        x.tag["XX"] = f"XX:i:{n}"
        x.flag |= PAIRED
    if not a.has(4) and not b.has(4):
        for x, y in ((a, b), (b, a)):
            x.flag |= BOTH | (BACK if x.has(BACK) else 0) | (MATE_BACK if y.has(BACK) else 0)
        lead, rest = (a, b) if a.pos < b.pos else (b, a)
        lead.flag |= FIRST
        rest.flag |= SECOND
        if a.chrom == b.chrom:
            a.isize = b.isize = template_length(a, b)
    else:
        a.flag &= PAIR_BITS
        b.flag &= PAIR_BITS
    for x in (a, b):
        x.flag &= SINGLE_BITS
        x.cigar = text(x)
    return [(x, n) for x, n in ((a, done[0]), (b, done[1])) if not x.has(4)]


def repair(rows: DataFrame, min_mapq: int = 20) -> DataFrame:
    """OUT: the text lines of repaired pairs; a read without both mates is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mate", "ord"])
        one, two = ([Aligned(r) for r in pdf[pdf.mate == m].itertuples()] for m in (1, 2))
        found = repaired_pair(one, two, min_mapq) if one and two else []
        lines = ["\t".join([x.read_id, str(x.flag), x.chrom, str(x.pos + 1), str(x.mapq), x.cigar, x.mate_chrom, str(x.mate_pos), str(x.isize), x.seq, x.qual, *x.tag.values()]) for x, _ in found]
        names = pd.Series([x.read_id for x, _ in found], dtype=object)
        return pd.DataFrame({"read_id": names, "ord": pd.Series([int(pdf.ord.min())] * len(found), dtype="int32"), "repaired": pd.Series([n for _, n in found], dtype="int32"), "value": pd.Series(lines, dtype=object)})

    return rows.groupBy("read_id").applyInPandas(run, OUT)
