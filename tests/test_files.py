"""Phased variant files, indel calls and the command line."""

from haplomill.__main__ import main
from haplomill.sources import text as T

HEAD = '##x\n##FORMAT=<ID=PS,Number=1,Type=Integer,Description="old">\n#CHROM\tPOS\n'


def variant(pos, genotype, form="GT", ref="A", alt="T"):
    return f"chr1\t{pos}\t.\t{ref}\t{alt}\t.\tPASS\t.\t{form}\t{genotype}\n"


def test_phased_variant_lines(spark, tmp_path):
    p = tmp_path / "v.vcf"
    p.write_text(HEAD + variant(100, "0/1:9:7", "GT:GQ:XX") + variant(200, "1/2", alt="T,C") + variant(300, "0/1:5:4", "GT:DP:PS") + variant(400, "0/1:6:3", "GT:XX:PS") + variant(500, "0/1"))
    rows = [(0, 1, 100, 3, 0.0, 4), (1, 0, 100, 3, -0.01, 3), (2, 1, 100, 3, -0.5, 2), (4, 0, 500, 1, 0.0, 1)]
    phased = spark.createDataFrame(rows, "snp long, hap int, first_pos int, size long, post_hap double, n long")
    got = "\n".join(r.value for r in T.phased_variant_lines(spark, str(p), phased).orderBy("part", "ix").collect()).split("\n")
    assert got[0] == "##x" and got[1:4] == T.TAG_LINES and got[4] == "#CHROM\tPOS"
    assert [x.split("\t")[8:] for x in got[5:]] == [["GT:GQ:PQ:PD:PS", "1|0:9:100:4:100"], ["GT:PQ:PD:PS", "1|2:16:3:100"], ["GT:DP:PS", "./.:5:."], ["GT:XX:PS", "0/1:6:."], ["GT:PS", "0/1:."]]
    assert got[5].split("\t")[:8] == ["chr1", "100", ".", "A", "T", ".", "PASS", "."]


def test_indel_calls(spark, tmp_path):
    v = tmp_path / "v.vcf"
    v.write_text(variant(102, "0/1", ref="A", alt="ATT") + variant(106, "0/1", ref="ACC", alt="A") + variant(106, "0/1", ref="AC", alt="A") + variant(102, "0/0", ref="A", alt="ATT"))
    s = tmp_path / "r.sam"
    s.write_text("".join(f"{n}\t0\tchr1\t98\t60\t{c}\t*\t0\t0\t{'A' * 20}\t{q}\n" for n, c, q in (("r1", "5M2I4M2D9M", "IIIII5IIIII6IIIIIIII"), ("r2", "5M3I12M", "I" * 20), ("r3", "20M", "I" * 20))))
    got = sorted(r[:] for r in T.call_indels(T.read_sam(spark, str(s)), T.read_variants(spark, str(v))).collect())
    assert got == [("r1", 0, 1, 20), ("r1", 1, 1, 21)]


def test_command_line(spark, tmp_path):
    v, f, out = tmp_path / "v.vcf", tmp_path / "f.txt", str(tmp_path / "out")
    v.write_text(HEAD + "".join(variant(100 * (i + 1), "0/1") for i in range(4)))
    f.write_text("".join(f"1 r{i} 1 {h} III\n1 s{i} 2 {h[1:]}{t} III\n" for i, (h, t) in enumerate((("011", "0"), ("100", "1")) * 3)))
    main(["phase", "--fragments", str(f), "--VCF", str(v), "--output", out])
    blocks = [r.value for r in spark.read.text(out).collect()]
    assert blocks[0].startswith("BLOCK: offset: 1 len: 4 phased: 4 SPAN: 300")
    assert [x.split("\t")[1] for x in blocks[1:5]] == ["0", "1", "1", "0"]
    lines = [r.value for r in spark.read.text(out + ".phased.VCF").collect() if not r.value.startswith("#")]
    assert [x.split("\t")[9].split(":")[0] for x in lines] == ["0|1", "1|0", "1|0", "0|1"]
    main(["convert", "--fragments", str(f), "--output", str(tmp_path / "new")])
    assert "1 r0 0 -1 -1 1 011 III" in {r.value for r in spark.read.text(str(tmp_path / "new")).collect()}
