"""From alignments to linked fragments, through the command line and its parts."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from haplomill.__main__ import main
from haplomill.operators import extract, linking
from haplomill.sources import bam, text

LENGTH = 100


def lines_of(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def inputs(tmp_path, positions, reads, chrom="chr1"):
    """A variant file and a text alignment file: reads are (name, start, barcode, indices from 1 with the alternative, flag, isize)."""
    v = tmp_path / "v.vcf"
    v.write_text("".join(f"{chrom}\t{p}\t.\tA\tT\t.\tPASS\t.\tGT\t0/1\n" for p in positions))
    rows = []
    for name, start, bx, alts, flag, isize, mate_pos in reads:
        seq = ["N"] * LENGTH
        for k, p in enumerate(positions):
            if start <= p < start + LENGTH:
                seq[p - start] = "T" if k + 1 in alts else "A"
        rows.append(f"{name}\t{flag}\t{chrom}\t{start}\t60\t{LENGTH}M\t{'=' if isize else '*'}\t{mate_pos}\t{isize}\t{''.join(seq)}\t{'5' * LENGTH}\tBX:Z:{bx}\n")
    s = tmp_path / "r.sam"
    s.write_text("@HD\tVN:1.6\n" + "".join(rows))
    return str(v), str(s)


def linked(spark, tmp_path, positions, reads, single=True):
    v, s = inputs(tmp_path, positions, reads)
    main(["extract", "--VCF", v, "--bam", s, "--output", str(tmp_path / "f"), "--barcodes"])
    main(["link", "--fragments", str(tmp_path / "f"), "--VCF", v, "--bam", s, "--output", str(tmp_path / "l"), *(["--single_SNP_frags"] if single else [])])
    return lines_of(spark, tmp_path / "l")


def read(name, start, bx, *alts, flag=0, isize=0, mate_pos=0):
    return name, start, bx, alts, flag, isize, mate_pos


THREE = (2000, 5000, 10000)


@pytest.mark.parametrize("second, third, want", [((2,), (2,), "1 chr1:1950-10050:GGG 0 -1 -1 1 111 5I5"), ((), (), "1 chr1:1950-10050:GGG 0 -1 -1 1 101 5I5"), ((2,), (), "2 chr1:1950-10050:GGG 0 -1 -1 1 1 3 1 55")])
def test_overlapping_reads_of_a_molecule(spark, tmp_path, second, third, want):
    reads = [read("r1", 1950, "GGG", 1), read("r2", 4950, "GGG", *second), read("r3", 4950, "GGG", *third), read("r4", 9950, "GGG", 3)]
    assert linked(spark, tmp_path, THREE, reads) == [want]


def test_two_barcodes(spark, tmp_path):
    reads = [read("r1", 1950, "GGG", 1), read("r2", 4950, "GGG", 2), read("r3", 4950, "GGG", 2), read("r4", 4960, "AAA"), read("r5", 9950, "GGG", 5)]
    assert linked(spark, tmp_path, (2000, 5000, 5010, 5020, 10000), reads) == ["1 chr1:1950-10050:GGG 0 -1 -1 1 11001 5III5", "1 chr1:4960-5060:AAA 0 -1 -1 2 000 555"]


def test_molecules_end_at_a_gap_and_bad_reads_go(spark, tmp_path):
    reads = [read("r1", 1950, "GGG", 1), read("r2", 4950, "GGG", 2, flag=1024), read("r3", 30000, "GGG", 3)]
    assert linked(spark, tmp_path, (2000, 5000, 30050), reads) == ["1 chr1:1950-2050:GGG 0 -1 -1 1 1 5", "1 chr1:30000-30100:GGG 0 -1 -1 3 1 5"]
    assert linked(spark, tmp_path, (2000, 5000, 30050), reads, single=False) == []


def test_unlinked_fragments_pass_through(spark):
    fragments = spark.createDataFrame([(0, "a", "G"), (1, "b", None), (2, "c", "T")], "frag long, name string, barcode string")
    calls = spark.createDataFrame([(f, s, 1, 20) for f, s in ((0, 0), (0, 1), (1, 0), (1, 1), (2, 1), (2, 2))], "frag long, snp long, allele int, qv int")
    variants = spark.createDataFrame([(0, "c1", 100), (1, "c1", 200), (2, "c1", 300)], "var_ix long, chrom string, pos int")
    spans = spark.createDataFrame([("c1", "G", 1, 50, 150), ("c1", "G", 2, 160, 400)], "chrom string, bx string, mol long, start long, stop long")
    f, c = linking.link(fragments, calls, variants, spans)
    # a's second call lies outside its first molecule, which leaves one call; b and c have no molecule
    assert sorted(r.value for r in linking.linked_lines(f, c).collect()) == ["1 b 0 -1 -1 1 11 55", "1 c 0 -1 -1 2 11 55"]
    taken = spark.createDataFrame([(0,)], "frag long")
    assert sorted(r.frag for r in linking.unlinked(fragments, taken).collect()) == [1, 2]


def test_pairs(spark, tmp_path):
    calls = [("apart", m, s, 1, 20 + s, 300, None) for m, s in ((0, 0), (0, 1), (1, 5))] + [("over", 0, 1, 1, 10, 90, "B"), ("over", 0, 2, 0, 10, 90, "B"), ("over", 1, 2, 0, 30, -90, "B"), ("over", 1, 3, 1, 9, -90, "B")]
    calls += [("clash", 0, 1, 1, 10, 90, None), ("clash", 1, 1, 0, 10, -90, None), ("clash", 1, 2, 0, 10, -90, None)]
    df = spark.createDataFrame(calls, "read_id string, mate int, snp long, allele int, qv int, isize int, barcode string")
    f, c = extract.pair_fragments(df)
    assert [r.value for r in extract.in_order(extract.typed_lines(f, c, 1)).collect()] == ["2 apart_MP 1 6 300 1 11 6 1 56:", "1 over 1 -1 -1 2 101 +?*"]
    assert [r.value for r in extract.in_order(extract.typed_lines(f, c, 2)).collect()] == ["2 apart_MP 2 NULL -1 1 11 6 1 56:", "1 over 2 B -1 2 101 +?*"]
    assert [r.value for r in extract.in_order(extract.typed_lines(f, c, 0, False)).collect()] == ["2 apart_MP 1 11 6 1 56:", "1 over 2 101 +?*"]
    assert [r.value for r in extract.in_order(extract.spelled_lines(f, c)).collect()] == ["2 apart_MP 1:1:20 2:1:21 6:1:25", "1 over 2:1:10 3:0:30 4:1:9"]
    assert {r.name for r in extract.pair_fragments(df, 1)[0].collect()} == {"apart_MP", "over", "clash"}


def test_routes_and_contigs(spark):
    rows = [("a", 1 | 64, "c1", "c1", 300), ("b", 0, "c1", "*", 0), ("c", 1 | 8, "c1", "c1", 10), ("d", 1, "c1", "c2", 300), ("e", 1, "c1", "c1", -5000), ("f", 1, "c9", "c9", 100)]
    reads = spark.createDataFrame(rows, "read_id string, flag int, chrom string, mate_chrom string, isize int")
    got = {r.read_id: r.single for r in extract.routed(reads).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": True, "e": True, "f": False}
    assert {r.read_id for r in extract.paired_only(extract.routed(reads)).collect()} == {"a", "f"}
    assert {r.read_id for r in extract.on_known_contigs(reads, spark.createDataFrame([("c1",)], "chrom string")).collect()} == set("abcde")


def test_fragment_filters(spark):
    calls = spark.createDataFrame([(0, 0, 1, 20), (0, 1, 1, 3), (0, 2, 1, 20), (1, 2, 1, 20), (1, 3, 0, 20), (2, 9, 1, 20)], "frag long, snp long, allele int, qv int")
    variants = spark.createDataFrame([(0, "c1", True), (1, "c1", True), (2, "c1", True), (3, "c2", False)], "var_ix long, chrom string, het boolean")
    assert sorted((r.frag, r.snp) for r in extract.usable(calls, variants).collect()) == [(0, 0), (0, 2)]
    assert {r.frag for r in extract.on_contig(calls, variants, "c1").collect()} == {0}
    assert extract.checked_bounds(calls, 10).count() == 6
    with pytest.raises(Exception, match="names variant 10"):
        extract.checked_bounds(calls, 9).collect()
    many = spark.range(20_000).withColumnRenamed("id", "frag")
    n = extract.sampled(many, 0.25).count()
    assert 4600 < n < 5400 and extract.sampled(many.repartition(7), 0.25).count() == n
    fragments = spark.createDataFrame([(0, 10), (1, 900), (2, None)], "frag long, isize long")
    assert {r.frag for r in extract.near_enough(fragments, 100).collect()} == {0, 2}
    assert [r.frag for r in extract.by_first(fragments, calls).collect()] == [0, 1, 2]


def test_variants_for_extraction(spark, tmp_path):
    p = tmp_path / "v.vcf"
    row = "c1\t100\t.\t{}\t{}\t.\t.\t.\tGT:DP\t{}:3\n"
    p.write_text("".join(row.format(*x) for x in (("A", "T", "0/1"), ("A", "T,G", "0|2"), ("A", "T,G", "1/2"), ("CAAAA", "CAA", "1/0"), ("A", "T", "1/1"), ("AT", "ATG", "0/1"))))
    got = [(r.pos, r.allele1, r.allele2, r.type, r.het) for r in text.read_extraction_variants(spark, str(p)).orderBy("var_ix").collect()]
    assert got == [(100, "A", "T", 0, "1"), (100, "A", "G", 0, "1"), (100, "T", "G", 0, "3"), (101, "CAA", "C", -2, "1"), (100, "A", "T", 0, "0"), (101, "AT", "ATG", 1, "1")]
    v = text.read_extraction_variants(spark, str(p), triallelic=True)
    count = lambda **k: sorted(r.var_ix for r in text.eligible(v, **k).collect())
    assert count() == [0, 1] and count(triallelic=True) == [0, 1, 2] and count(indels=True) == [0, 1, 3, 5] and 4 in count(homozygous=True)
    for bad in ("./1", "0/3", "1", "0/0/1"):
        p.write_text(row.format("A", "T", bad))
        with pytest.raises(Exception, match="diploid"):
            text.read_extraction_variants(spark, str(p)).collect()
        assert not text.read_variants(spark, str(p)).first().het
    p.write_text("c1\t100\t.\tA\tT\t.\t.\t.\tDP:GT\t0/1:3\n")
    with pytest.raises(Exception, match="come first"):
        text.read_extraction_variants(spark, str(p)).collect()
    p.write_text("c1\t100\t.\tA\tT\t.\t.\t.\tGT:DP\t0/1\n")
    with pytest.raises(Exception, match="differ in number"):
        text.read_variants(spark, str(p)).collect()


def bgzf(data):
    out = b""
    for at in range(0, len(data), 700):  # small blocks, so that records span them
        z = zlib.compressobj(wbits=-15)
        body = z.compress(data[at : at + 700]) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[at : at + 700]), len(data[at : at + 700]))
    return out


def bam_bytes(rows, names=("chr1", "chr2")):
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(names)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000) for n in names)
    for name, flag, ref, pos, mapq, ops, seq, qual, tags in rows:
        packed = bytes("=ACMGRSVTWYHKDBN".index(a) << 4 | ("=ACMGRSVTWYHKDBN".index(b) if b else 0) for a, b in zip(seq[::2], [*seq[1::2], ""]))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in ops) + packed + qual + tags
        data += struct.pack("<i", len(body)) + body
    return bgzf(data)


def test_binary_alignments(spark, tmp_path):
    odd = [("r%d" % i, 0, i % 2, 10 + i, 60, [(3, "S"), (4, "="), (2, "X")], "ACGTNACGT", bytes(range(9)), b"NMi" + struct.pack("<i", 3) + b"BXZGGG-1\0" + b"XBBc" + struct.pack("<i", 3) + b"abc" + b"MIC\x07") for i in range(60)]
    odd += [("low", 0, 0, 5, 3, [(2, "M")], "AC", b"\1\2", b""), ("dup", 1024, 0, 5, 60, [(2, "M")], "AC", b"\1\2", b""), ("noq", 0, 0, 900, 60, [(3, "M")], "ACG", b"\xff" * 3, b"")]
    for n, part in (("a", odd[:30]), ("b", odd[30:])):
        (tmp_path / f"{n}.bam").write_bytes(bam_bytes(part))
    paths = [str(tmp_path / f"{n}.bam") for n in "ab"]
    got = {r.read_id: r for r in bam.read_bam(spark, paths).collect()}
    assert len(got) == 61 and "low" not in got and "dup" not in got
    r = got["r7"]
    assert (r.chrom, r.pos, r.seq, r.qual, r.bx, r.mi) == ("chr2", 17, "ACGTNACGT", "".join(chr(33 + i) for i in range(9)), "GGG-1", "7")
    assert [(o.len, o.op) for o in r.cigar] == [(3, "S"), (4, "M"), (2, "M")] and got["noq"].qual == "..."
    assert {r.read_id for r in bam.read_bam(spark, paths, "chr1:20-21").collect()} == {"r6", "r8", "r10"}
    assert bam.parsed_region("chr1:1,000") == ("chr1", 1000, 1 << 40)
    (tmp_path / "bad.bam").write_bytes(b"no")
    (tmp_path / "bad2.bam").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="BGZF"):
        bam.read_bam(spark, [str(tmp_path / "bad2.bam")]).collect()
    spans = linking.molecule_spans(text.aligned_pieces(bam.read_bam(spark, paths)), 20_000)
    assert sorted((r.chrom, r.start, r.stop, r.n_reads) for r in spans.collect()) == [("chr1", 9, 73, 30), ("chr2", 10, 74, 30)]
    assert [r.value for r in text.interval_lines(spans).collect()] == ["chr1\t9\t73\tGGG-1\t30", "chr2\t10\t74\tGGG-1\t30"]
    bed = tmp_path / "b.bed"
    bed.write_text("#x\nc1 5 9\nc1\t7\t12\tGGG\t3\n")
    assert [r[:] for r in text.read_bed(spark, str(bed)).orderBy("start").collect()] == [("c1", 5, 9, None, None), ("c1", 7, 12, "GGG", 3)]
