"""Queries over the driver's tables: text, extraction, linking, evaluation of blocks, crossing mates, clusters, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .catalog import BINS, CALLS, CALLS6, GAP, HAP, LSE, MATCH, MOLS, OK, ER, RAW, TERMS, _BIT, _mates, _simple, calls, hap, locus, raw_calls, reads, table, voted
from .functions import alleles as A
from .operators import clusters as K, evaluate as E, extract as X, hic as H, likelihood as L, link as J, linking as N
from .plans import phase as P
from .sources import text as T
from .storage import cut, scratch_path
from .streaming import molecules as S


# ---- text of variants and alignments ----

def _variant_rows(spark, d: str) -> DataFrame:
    """Lines of a variant file made of line items, split as a file's would be."""
    l = table(spark, d, "lineitem")
    pick = lambda col, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (col % len(x) + 1).cast("int"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")), F.col("l_orderkey").cast("string"), F.lit("."), pick(F.col("l_partkey"), "A", "CAAAA", "GTT", "T"),
        pick(F.col("l_suppkey"), "G", "CAA,T", "GTTTT", "C,GTT", "TT"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP"), F.concat(pick(F.col("l_orderkey") + F.col("l_linenumber"), "0/1", "0|2", "1/2", "1|1", "2/0", "1|0"), F.lit(":"), F.col("l_linenumber").cast("string")))
    return l.select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.split(line, "\t").alias("c"))


def _vcf_columns(spark, d: str) -> DataFrame:
    x = _variant_rows(spark, d).withColumn("gt", F.col("c")[9])
    x = x.withColumn("p", A.allele_pair(F.col("c")[3], F.col("c")[4], F.col("gt"))).withColumn("t", A.trimmed(F.col("p.allele1"), F.col("p.allele2")))
    kind = F.length("p.allele2") - F.length("p.allele1")
    return x.select("ok", "ln", A.contig(F.col("c")[0]).alias("contig"), (F.col("c")[1].cast("long") + (kind != 0).cast("int")).alias("pos"), F.substring("gt", 1, 3).alias("genotype"), F.col("t.allele1").alias("allele1"), F.col("t.allele2").alias("allele2"), kind.alias("type"), A.status(F.col("gt")).alias("het"))


ROWS = """v AS (SELECT l_orderkey ok, l_linenumber ln, 'chr' || l_suppkey%5 chrom, l_orderkey pos, ['A','CAAAA','GTT','T'][l_partkey%4+1] ref, ['G','CAA,T','GTTTT','C,GTT','TT'][l_suppkey%5+1] alt,
 ['0/1','0|2','1/2','1|1','2/0','1|0'][(l_orderkey+l_linenumber)%6+1] gt FROM lineitem)"""
_simple("vcf_columns", _vcf_columns, f"""WITH {ROWS}, p AS (SELECT *, CASE WHEN contains(gt,'2') AND NOT contains(gt,'0') THEN split_part(alt,',',1) ELSE ref END a1, CASE WHEN contains(gt,'2') THEN split_part(alt,',',2) ELSE split_part(alt,',',1) END a2 FROM v),
t AS (SELECT *, coalesce(list_max(list_filter(range(0, greatest(least(length(a1),length(a2)),1)), lambda k: right(a1,k)=right(a2,k))),0) k FROM p)
SELECT ok, ln, regexp_replace(chrom,'^[chr]+','') contig, pos + CASE WHEN length(a1)<>length(a2) THEN 1 ELSE 0 END pos, gt genotype, left(a1, length(a1)-k) allele1, left(a2, length(a2)-k) allele2, cast(length(a2)-length(a1) AS int) "type",
 CASE WHEN left(gt,1)=right(gt,1) THEN '0' WHEN contains(gt,'0') THEN '1' ELSE '3' END het FROM t""")


def _cigar_ops(spark, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    n = F.col("l_quantity").cast("int")
    cigar = F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit("S"), n.cast("string"), F.lit("="), (F.col("l_partkey") % 7 + 1).cast("string"), F.lit("I"), n.cast("string"), F.lit("X"), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("D9M2N4M3H"))
    size, op = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), 1), F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), 1)
    ops = F.arrays_zip(F.transform(size, lambda v: v.cast("int")).alias("len"), F.transform(op, lambda v: F.translate(v, "=X", "MM")).alias("op"))
    r = T.aligned_pieces(l.select("l_orderkey", "l_linenumber", F.col("l_orderkey").cast("int").alias("pos"), ops.alias("cigar")))
    return r.select("l_orderkey", "l_linenumber", "pos", "end", F.size("pieces").alias("pieces"), F.aggregate("pieces", F.lit(0), lambda s, p: s + p.n).alias("aligned"), F.element_at("pieces", -1).q.alias("last_offset"))


_simple("cigar_ops", _cigar_ops, """SELECT l_orderkey, l_linenumber, cast(l_orderkey AS int) pos, cast(l_orderkey + 2*cast(floor(l_quantity) AS int) + l_suppkey%5+1 + 15 - 1 AS int) "end", cast(4 AS int) pieces, cast(2*cast(floor(l_quantity) AS int)+13 AS int) aligned,
 cast(l_linenumber%3 + 2*cast(floor(l_quantity) AS int) + l_partkey%7+1 + 9 AS int) last_offset FROM lineitem""")


def _phase_sets(spark, d: str) -> DataFrame:
    v = _variant_rows(spark, d).select((F.col("ok") * 10 + F.col("ln")).alias("var_ix"), F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"), F.substring(F.col("c")[9], 1, 3).alias("genotype"),
        F.when(F.col("ln") % 4 == 0, "GT").otherwise("GT:PS").alias("format"), F.when(F.col("ln") % 4 == 0, F.col("c")[9].substr(1, 3)).otherwise(F.concat(F.col("c")[9].substr(1, 3), F.lit(":"), F.when(F.col("ln") == 7, ".").otherwise(F.floor(F.col("ok") / 100).cast("string")))).alias("sample"))
    return E.phased_blocks(v, True).select("block", "snp", "a1", "a2", "alt1", F.coalesce("alt2", F.lit("")).alias("alt2"))


_simple("phase_sets", _phase_sets, f"""WITH {ROWS}, e AS (SELECT chrom || ':' || cast(floor(ok/100) AS bigint) block, ok*10+ln snp, left(gt,1) a1, right(gt,1) a2, split_part(alt,',',1) alt1, split_part(alt,',',2) alt2 FROM v WHERE substr(gt,2,1)='|' AND left(gt,1)<>right(gt,1) AND ln%4<>0 AND ln<>7)
SELECT * FROM e WHERE block IN (SELECT block FROM e GROUP BY block HAVING count(*)>1)""")
_simple("name_buckets", lambda s, d: table(s, d, "part").select("p_partkey", A.bucket(F.col("p_name"), 9973).alias("bucket"), A.base_index(F.substring(F.upper("p_name"), 1, 1)).cast("int").alias("base"), A.distinct_kmers(F.col("p_name"), 2).alias("unlike")),
    """SELECT p_partkey, list_reduce(list_prepend(cast(5381 AS bigint), list_transform(string_split(p_name,''), lambda c: cast(ascii(c) AS bigint))), lambda h, c: CASE WHEN h*33+c>=9973 THEN (h*33+c)%9973 ELSE h*33+c END) bucket,
 cast(instr('ACGT', upper(left(p_name,1))) AS int) base, (SELECT count(DISTINCT substr(p_name, i, 2)) = count(*) FROM (SELECT unnest(range(1, length(p_name))) i)) unlike FROM part""")


# ---- reads to fragments ----

def _reads(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    at = lambda c, n: F.concat(F.lit("c"), (F.col(c) % n).cast("string"))
    return o.select(F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 16).cast("int").alias("flag"), at("o_custkey", 3).alias("chrom"), at("o_orderkey", 3).alias("mate_chrom"), (F.floor(F.col("o_totalprice") % 3000) - 1500).cast("int").alias("isize"), F.floor(F.col("o_totalprice") * 7).cast("long").alias("pos"), (F.col("o_orderkey") % 61).cast("int").alias("mapq"))


READS = "r AS (SELECT o_orderkey read_id, o_custkey%16 flag, 'c' || o_custkey%3 chrom, 'c' || o_orderkey%3 mate_chrom, cast(floor(o_totalprice%3000)-1500 AS int) isize, cast(floor(o_totalprice*7) AS bigint) pos, o_orderkey%61 mapq FROM orders)"
_simple("routed_reads", lambda s, d: X.routed(X.on_known_contigs(_reads(s, d), s.createDataFrame([("c0",), ("c2",)], "chrom string")), 5, 1000).select("read_id", "single"),
    f"WITH {READS} SELECT read_id, (flag&8)<>0 OR abs(isize)>1000 OR abs(isize)<5 OR isize=0 OR (flag&1)=0 OR chrom<>mate_chrom AS single FROM r WHERE chrom IN ('c0','c2')")


def _pairs(spark, d: str) -> DataFrame:
    c = raw_calls(spark, d)
    return c.select(F.concat(F.lit("f"), F.col("frag").cast("string")).alias("read_id"), (F.col("line") % 2).alias("mate"), "snp", "allele", "qv", (F.col("frag") % 997 - 500).cast("int").alias("isize"), F.lit(None).cast("string").alias("barcode")).groupBy("read_id", "mate", "snp", "isize", "barcode").agg(F.min("allele").alias("allele"), F.max("allele").alias("top"), F.max("qv").alias("qv")).where("allele = top").drop("top")


def _lines(name: str, of: str, runs: str, quals: str) -> str:
    return f"SELECT min(s) AS \"first\", count(*) || ' ' || {name} || ' ' || {of} || ' ' || string_agg((s+1) || ' ' || h, ' ' ORDER BY s) || ' ' || string_agg(q, '' ORDER BY s) line FROM {runs}"


_simple("pair_fragments", lambda s, d: X.typed_lines(*X.pair_fragments(_pairs(s, d)), 1), f"""WITH {RAW()}, m AS (SELECT 'f' || frag read_id, line%2 mate, snp, min(allele) allele, max(qv) qv, frag%997-500 isize FROM raw GROUP BY frag, line%2, snp HAVING count(DISTINCT allele)=1),
p AS (SELECT read_id, min(snp) FILTER (WHERE mate=0) a0, max(snp) FILTER (WHERE mate=0) b0, min(snp) FILTER (WHERE mate=1) a1, max(snp) FILTER (WHERE mate=1) b1, max(abs(isize)) isize FROM m GROUP BY read_id),
k AS (SELECT *, coalesce(b0<a1 OR b1<a0, false) apart FROM p), c AS (SELECT read_id, snp, min(allele) allele, max(qv) qv FROM m GROUP BY ALL HAVING count(DISTINCT allele)=1),
e AS (SELECT * FROM c WHERE read_id IN (SELECT read_id FROM c GROUP BY read_id HAVING count(*)>=2)), r AS (SELECT *, snp - row_number() OVER (PARTITION BY read_id ORDER BY snp) run FROM e),
b AS (SELECT read_id, min(snp) s, string_agg(cast(allele AS varchar), '' ORDER BY snp) h, string_agg(chr(33+least(qv,93)), '' ORDER BY snp) q FROM r GROUP BY read_id, run)
SELECT min(s) AS "first", count(*) || ' ' || read_id || CASE WHEN any_value(apart) THEN '_MP' ELSE '' END || ' 1 ' || CASE WHEN any_value(apart) THEN (greatest(any_value(a0),any_value(a1))+1) || ' ' || any_value(isize) ELSE '-1 -1' END || ' ' || string_agg((s+1) || ' ' || h, ' ' ORDER BY s) || ' ' || string_agg(q, '' ORDER BY s) line FROM b JOIN k USING (read_id) GROUP BY read_id""")
_simple("usable_calls", lambda s, d: X.usable(calls(s, d), calls(s, d).select(F.col("snp").alias("var_ix")).distinct().withColumn("het", F.col("var_ix") % 5 != 0), 12).select("frag", "snp", "qv"),
    CALLS + ", u AS (SELECT * FROM calls WHERE qv>=12 AND snp%5<>0) SELECT frag, snp, qv FROM u WHERE frag IN (SELECT frag FROM u GROUP BY frag HAVING count(*)>=2)")
_simple("calls_on_contig", lambda s, d: X.on_contig(calls(s, d), calls(s, d).select(F.col("snp").alias("var_ix")).distinct().withColumn("chrom", F.when(F.col("var_ix") % 9 == 0, "b").otherwise("a")), "a"),
    CALLS + " SELECT * FROM calls WHERE frag NOT IN (SELECT frag FROM calls WHERE snp%9=0)")


# ---- linking ----

def _linked(spark, d: str) -> DataFrame:
    r = reads(spark, d)
    at = r.select(F.col("read").alias("frag"), F.concat(F.lit("r"), F.col("read").cast("string")).alias("name"), F.when(F.col("read") % 5 != 0, F.concat(F.lit("b"), F.col("bx").cast("string"))).alias("barcode"), "pos", F.floor(F.col("pos") / 500).alias("v"))
    c = at.select("frag", F.explode(F.array(F.col("v"), F.col("v") + 1)).alias("snp"))
    c = c.select("frag", "snp", ((F.col("frag") % 3 == 0).cast("int") * (F.col("snp") % 2)).cast("int").alias("allele"), (F.col("frag") % 30 + 5).cast("int").alias("qv"))
    variants = c.select("snp").distinct().select(F.col("snp").alias("var_ix"), F.lit("c").alias("chrom"), (F.col("snp") * 500 + 100).alias("pos"))
    spans = r.select(F.lit("c").alias("chrom"), F.concat(F.lit("b"), F.col("bx").cast("string")).alias("bx"), "pos", (F.col("pos") + 99).alias("end"), F.lit(0).alias("flag"), F.lit(60).alias("mapq"), F.lit(None).cast("string").alias("mi"))
    f, linked = N.link(at.select("frag", "name", "barcode"), c, variants, N.molecule_spans(spans, GAP))
    return X.typed_lines(f, linked, key="frag")


_simple("linked_fragments", _linked, MOLS.format(GAP) + f""", f AS (SELECT read frag, 'r' || read AS name, CASE WHEN read%5<>0 THEN 'b' || bx END barcode, cast(floor(pos/500) AS bigint) v FROM r),
c AS (SELECT frag, snp, CASE WHEN frag%3=0 THEN snp%2 ELSE 0 END allele, frag%30+5 qv, snp*500+99 vpos FROM (SELECT frag, unnest([v, v+1]) snp FROM f)),
s AS (SELECT 'b' || bx bx, mol, min(pos)-1 "start", max(pos)+99 stop FROM m GROUP BY bx, mol),
i AS (SELECT c.*, s.mol, s."start", s.stop, s.bx FROM c JOIN f USING (frag) JOIN s ON s.bx=f.barcode AND vpos>=s."start" AND vpos<s.stop),
o AS (SELECT frag, min("start") AS lead FROM i GROUP BY frag), t AS (SELECT i.* FROM i JOIN o ON i.frag=o.frag AND i."start"=o.lead),
g AS (SELECT 'c:' || ("start"+1) || '-' || (stop+1) || ':' || bx AS name, 'm' || bx || ' ' || "start" AS key, snp, min(allele) allele, CASE WHEN count(*)=1 THEN max(qv) ELSE least(sum(qv),40) END qv FROM t GROUP BY ALL HAVING count(DISTINCT allele)=1),
a AS (SELECT name, key, snp, allele, qv FROM g UNION ALL SELECT f.name, 'f' || c.frag, snp, allele, qv FROM c JOIN f USING (frag) WHERE c.frag NOT IN (SELECT frag FROM o)),
e AS (SELECT * FROM a WHERE key IN (SELECT key FROM a GROUP BY key HAVING count(*)>=2)), n2 AS (SELECT *, snp - row_number() OVER (PARTITION BY key ORDER BY snp) run FROM e),
b AS (SELECT name, key, min(snp) s, string_agg(cast(allele AS varchar), '' ORDER BY snp) h, string_agg(chr(cast(33+least(qv,93) AS int)), '' ORDER BY snp) q FROM n2 GROUP BY name, key, run)
{_lines("name", "'0 -1 -1'", "b", "q")} GROUP BY name, key""")


# ---- evaluation ----

def _assembled(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """(truth, assembly): the planted haplotype in blocks of 30 and the vote in blocks of 12, with unknown and unlike alleles."""
    v = voted(spark, d).withColumn("a", F.when(F.col("match") == 1, hap(F.col("snp"))).otherwise(1 - hap(F.col("snp"))))
    named = lambda x, other, hidden: (F.when(hidden, "-").otherwise(x.cast("string")), F.when(hidden, "-").otherwise(other.cast("string")))
    a1, a2 = named(F.col("a"), F.when(F.col("snp") % 13 == 0, F.lit(2)).otherwise(1 - F.col("a")), F.col("snp") % 11 == 0)
    base = [F.lit("c1").alias("chrom"), (F.col("snp") * 10).alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt1"), F.lit(None).cast("string").alias("alt2")]
    assembly = v.select("block", "snp", a1.alias("a1"), a2.alias("a2"), *base)
    t = hap(F.col("snp"))
    truth = v.where("snp % 17 <> 0").select(F.floor(F.col("snp") / 30).alias("block"), "snp", t.cast("string").alias("a1"), (1 - t).cast("string").alias("a2"), *base)
    return truth, assembly


PAIRS = MATCH + f""", j AS (SELECT cast(floor(snp/30.0) AS bigint) t_block, block, row_number() OVER (PARTITION BY block ORDER BY snp) k, snp, match v, snp%13<>0 AS ok FROM rows_),
y AS (SELECT * FROM j WHERE snp%17<>0 AND snp%11<>0), f AS (SELECT t_block, block, min(k) FILTER (WHERE ok) k0 FROM y GROUP BY ALL),
z AS (SELECT y.*, f.k0, lag(k) OVER w pk, lag(v) OVER w pv FROM y JOIN f USING (t_block, block) WHERE y.k>=f.k0 WINDOW w AS (PARTITION BY t_block, block ORDER BY k)),
ru AS (SELECT t_block, block, count(*) FILTER (WHERE k>k0 AND good) lead FROM (SELECT *, bool_and(k=k0 OR (k=pk+1 AND v<>pv)) OVER (PARTITION BY t_block, block ORDER BY k) good FROM z) GROUP BY ALL),
o AS (SELECT t_block, block, v, row_number() OVER (PARTITION BY t_block, block ORDER BY k) i, count(*) OVER (PARTITION BY t_block, block) n FROM z WHERE ok),
st AS (SELECT o.t_block, o.block, o.i, o.n, 1-o.v AS sw_on, ru.lead%2=1 AS last, 0 sw, 0 mm FROM o JOIN ru USING (t_block, block) WHERE o.i=1
 UNION ALL SELECT o.t_block, o.block, o.i, o.n, CASE WHEN o.v=st.sw_on THEN 1-st.sw_on ELSE st.sw_on END, o.v=st.sw_on AND NOT st.last,
 CASE WHEN o.v=st.sw_on AND st.last THEN greatest(0,st.sw-1) WHEN o.v=st.sw_on THEN st.sw+1 ELSE st.sw END, CASE WHEN o.v=st.sw_on AND st.last THEN st.mm+1 ELSE st.mm END FROM st JOIN o ON o.t_block=st.t_block AND o.block=st.block AND o.i=st.i+1),
fin AS (SELECT t_block, block, n, CASE WHEN last THEN greatest(0,sw-1) ELSE sw END sw, CASE WHEN last THEN mm+1 ELSE mm END mm FROM st WHERE i=n),
pe AS (SELECT y.t_block, y.block, cast(count(*) FILTER (WHERE ok) AS int) known, cast(coalesce(any_value(fin.sw),0) AS int) switches, cast(coalesce(any_value(fin.mm),0) AS int) mismatches,
 cast(least(count(*) FILTER (WHERE ok AND v=0), count(*) FILTER (WHERE ok AND v=1)) AS int) flat, cast(count(*) FILTER (WHERE NOT ok) AS int) different FROM y LEFT JOIN fin ON fin.t_block=y.t_block AND fin.block=y.block GROUP BY ALL)"""
_simple("block_pair_errors", lambda s, d: E.compared(E.aligned(*_assembled(s, d))), PAIRS + " SELECT * FROM pe")


def _contig_reports(spark, d: str) -> DataFrame:
    e = E.compared(E.aligned(*_assembled(spark, d)))
    some = e.groupBy((F.col("t_block") % 3).alias("contig")).agg(*[F.sum(c).alias(c) for c in ("switches", "mismatches", "flat")], F.sum(F.when(F.col("known") >= 4, F.col("known") - 3).otherwise(0)).alias("poss_sw"), F.sum(F.when(F.col("known") >= 2, F.col("known")).otherwise(0)).alias("poss_mm"))
    return E.added_reports(some).withColumn("contigs", F.array_join("contigs", ","))


_simple("added_reports", _contig_reports, PAIRS + """ SELECT (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT t_block%3 c FROM pe)) contigs, cast(sum(switches) AS bigint) switches, cast(sum(mismatches) AS bigint) mismatches, cast(sum(flat) AS bigint) flat,
round(sum(switches)/sum(CASE WHEN known>=4 THEN known-3 ELSE 0 END),6) switch_rate, round(sum(mismatches)/sum(CASE WHEN known>=2 THEN known ELSE 0 END),6) mismatch_rate, round(sum(flat)/sum(CASE WHEN known>=2 THEN known ELSE 0 END),6) flat_rate FROM pe""")
_simple("largest_block", lambda s, d: E.largest_block(voted(s, d)), MATCH + " SELECT * FROM rows_ WHERE block = (SELECT block FROM rows_ GROUP BY block ORDER BY count(*) DESC, min(snp) LIMIT 1)")


def _agreeing(spark, d: str) -> DataFrame:
    v = voted(spark, d)
    return E.switch_distances(v.select(F.lit(0).alias("t_block"), "block", "snp", F.lit("1").alias("x"), F.col("match").cast("string").alias("y1"), (1 - F.col("match")).cast("string").alias("y2")))


_simple("switch_distances", _agreeing, MATCH + """, g AS (SELECT *, CASE WHEN 2*sum(match) OVER (PARTITION BY block) > count(*) OVER (PARTITION BY block) THEN match=1 ELSE match=0 END good FROM rows_),
h AS (SELECT *, count(*) FILTER (WHERE NOT good) OVER (PARTITION BY block ORDER BY snp) seen, lag(good) OVER (PARTITION BY block ORDER BY snp) p FROM g), e AS (SELECT * FROM h WHERE good AND NOT coalesce(p, true))
SELECT cast(0 AS int) t_block, block, snp AS "at", cast(seen - coalesce(lag(seen) OVER (PARTITION BY block ORDER BY snp),0) AS bigint) length FROM e""")
_simple("gap_coverage", lambda s, d: E.gap_coverage(calls(s, d).groupBy("frag").agg(F.min("snp").alias("first"), F.max("snp").alias("last")), calls(s, d).select("snp").distinct(), 1000),
    CALLS + ", s AS (SELECT frag, min(snp) a, max(snp) b FROM calls GROUP BY frag), v AS (SELECT DISTINCT snp FROM calls) SELECT v.snp, count(*) n FROM v JOIN s ON v.snp BETWEEN a AND b AND cast(floor(v.snp/12) AS bigint)=cast(floor(a/12) AS bigint) GROUP BY v.snp")


def _quality_rows(spark, d: str) -> DataFrame:
    g = calls(spark, d).groupBy("snp").agg(F.min("qv").alias("lo"), F.max("qv").alias("hi"))
    return g.select(locus().alias("block"), "snp", F.lit("0").alias("a1"), F.lit("1").alias("a2"), (F.col("hi") + F.col("snp") % 7 - 10).cast("double").alias("switch_q"), (F.col("lo") + 22).cast("double").alias("mismatch_q"), (F.col("hi") / 41).alias("transition"), (F.col("lo") / 20).alias("posterior"), (F.col("hi") / 45).alias("emission"))


QUALS = CALLS + ", q AS (SELECT snp, cast(floor(snp/12.0) AS bigint) block, min(qv) lo, max(qv) hi FROM calls GROUP BY snp), w AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY snp) n FROM q)"
_simple("pruned_blocks", lambda s, d: T.prune_blocks(_quality_rows(s, d)).select("block", "part", "snp", "a1", "a2"), QUALS + " SELECT block, cast(sum(CASE WHEN hi+snp%7-10<30 AND n>2 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY snp) AS bigint) part, snp, CASE WHEN lo+22<30 THEN '-' ELSE '0' END a1, CASE WHEN lo+22<30 THEN '-' ELSE '1' END a2 FROM w")
_simple("probability_pruning", lambda s, d: T.prune_by_probability(_quality_rows(s, d), 0.9, 0.9).select("block", "part", "snp", "a1"), QUALS + """, h AS (SELECT *, n>2 AND hi/41<0.9 tr, n>2 AND (hi/41<0.9 OR lo/20<0.9) hit FROM w),
k AS (SELECT *, coalesce(count(*) FILTER (WHERE hit) OVER (PARTITION BY block ORDER BY snp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)=0 fresh FROM h)
SELECT block, cast(sum(CASE WHEN tr OR (hit AND fresh) THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY snp) AS bigint) part, snp, CASE WHEN hi/45<0.9 THEN '-' ELSE '0' END a1 FROM k""")
_simple("pruned_block_text", lambda s, d: T.pruned_block_lines(T.prune_blocks(_quality_rows(s, d)).select("block", "part", "snp", "a1", "a2", F.lit("c").alias("chrom"), (F.col("snp") * 10).alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.lit("0/1").alias("sample"), F.lit("0").alias("discrete"), "switch_q", "mismatch_q", F.lit(1).alias("n"))).select("block", "part", F.regexp_replace("value", r"(?s)^\*+ \n", "").alias("text")),
    QUALS + """, p AS (SELECT *, cast(sum(CASE WHEN hi+snp%7-10<30 AND n>2 THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY snp) AS bigint) part FROM w)
SELECT block, part, 'BLOCK: offset: ' || (min(snp)+1) || ' len: ' || (max(snp)-min(snp)+1) || ' phased: ' || count(*) FILTER (WHERE lo+22>=30) || ' SPAN: ' || ((max(snp)-min(snp))*10) || ' fragments 0' || chr(10) ||
 string_agg((snp+1) || chr(9) || '0' || chr(9) || '1' || chr(9) || 'c' || chr(9) || (snp*10) || chr(9) || 'A' || chr(9) || 'T' || chr(9) || '0/1' || chr(9) || '0' || chr(9) || printf('%.2f', cast(hi+snp%7-10 AS double)) || chr(9) || printf('%.2f', cast(lo+22 AS double)) || chr(9) || '1', chr(10) ORDER BY snp) FILTER (WHERE lo+22>=30) "text"
FROM p GROUP BY block, part HAVING count(*) FILTER (WHERE lo+22>=30)>=2""")
_simple("split_blocks", lambda s, d: T.split_blocks(_quality_rows(s, d).select(F.col("block").alias("comp"), "snp", (F.col("switch_q") / 100 - 0.3).alias("post_notsw")), 0.8).select("snp", "comp"), QUALS + """, k AS (SELECT *, sum(CASE WHEN n>1 AND (hi+snp%7-10)/100.0-0.3<log10(0.8) THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY snp) p FROM w)
SELECT snp, min(snp) OVER (PARTITION BY block, p) comp FROM k""")


# ---- likelihoods ----

_LL = lambda a, b: LSE.format(a, b)
FRAGS = TERMS + ", p AS (SELECT frag, sum(t0) p0, sum(t1) p1 FROM terms GROUP BY frag)"
_simple("hypothetical_ll", lambda s, d: L.hypothetical(calls(s, d), hap).select("frag", "snp", *[F.round(c, 5).alias(c) for c in ("ll", "ll_equal", "ll_without")]),
    FRAGS + f" SELECT frag, snp, round({_LL('p0', 'p1')},5) ll, round({_LL('p0', '(p1-t1+t0)')},5) ll_equal, round({_LL('(p0-t0)', '(p1-t1)')},5) ll_without FROM terms JOIN p USING (frag)")
SIDES = FRAGS + f", z AS (SELECT snp, p0-t0 b0, p1-t1 b1, CASE WHEN allele=0 THEN {OK} ELSE {ER} END z0, CASE WHEN allele=0 THEN {ER} ELSE {OK} END z1 FROM terms JOIN p USING (frag))"
_side = lambda x, y: _LL(f"(b0+{x})", f"(b1+{y})")
_simple("homozygous_posterior", lambda s, d: L.homozygous_posterior(calls(s, d), hap), SIDES + f""", l AS (SELECT snp, sum({_side('z0', 'z1')}) l0, sum({_side('z1', 'z0')}) l1, sum({_side('z0', 'z0')}) l00, sum({_side('z1', 'z1')}) l11 FROM z GROUP BY snp),
x AS (SELECT snp, CASE WHEN {HAP.format('snp')}=0 THEN l0 ELSE l1 END + log10(0.5-0.01) a, CASE WHEN {HAP.format('snp')}=0 THEN l1 ELSE l0 END + log10(0.5-0.01) b, l00-2 c, l11-2 d FROM l), t AS (SELECT *, {_LL(_LL('a', 'b'), _LL('c', 'd'))} t FROM x)
SELECT snp, round(a-t,4)+cast(0 AS double) post_hap, round(b-t,4)+cast(0 AS double) post_flip, round(c-t,4)+cast(0 AS double) post_00, round(d-t,4)+cast(0 AS double) post_11 FROM t""")
_HALF = "0.3010299956639812::double"
_simple("five_genotypes", lambda s, d: L.five_genotypes(calls(s, d), hap), SIDES + f""", g AS (SELECT snp, sum({_side('0', '0')}-{_HALF}) w, sum(z0) a, sum(z1) b, count(*) n, sum({_side('z0', 'z1')}-{_HALF}) g3, sum({_side('z1', 'z0')}-{_HALF}) g4 FROM z GROUP BY snp),
s AS (SELECT snp, round(a+w+log10(0.9985)-10,6) s0, round(w-{_HALF}*n+log10(0.001)-3,6) s1, round(b+w+log10(0.0005)-10,6) s2, round(g3+log10(0.0005),6) s3, round(g4+log10(0.0005),6) s4 FROM g), t AS (SELECT *, greatest(s0,s1,s2,s3,s4) top FROM s)
SELECT snp, CASE top WHEN s0 THEN '0/0' WHEN s1 THEN '0/1' WHEN s2 THEN '1/1' WHEN s3 THEN '0|1' ELSE '1|0' END genotype, round(-log10(pow(10.0,s0-top)+pow(10.0,s1-top)+pow(10.0,s2-top)+pow(10.0,s3-top)+pow(10.0,s4-top)),4)+cast(0 AS double) posterior FROM t""")
_simple("fragment_tags", lambda s, d: L.fragment_tags(calls(s, d), calls(s, d).select("snp").distinct().withColumn("hap", hap(F.col("snp"))).withColumn("first_pos", locus() * 1200)),
    TERMS + f", f AS (SELECT frag, sum(t0) p0, sum(t1) p1, min(snp) s FROM terms WHERE qv>=6 GROUP BY frag), g AS (SELECT *, {_LL('p0', 'p1')} ll FROM f) SELECT frag, cast(floor(s/12.0) AS bigint)*1200 ps, CASE WHEN p0>p1 THEN 0 ELSE 1 END hp, cast(floor(round(10*(ll-least(p0,p1)),6)) AS bigint) pq FROM g WHERE pow(10.0, greatest(p0,p1)-ll)>=0.95")


def _narrow(spark, d: str) -> DataFrame:
    c = cut(calls(spark, d, 6), "calls")
    found = P.phase(c).select("comp", "ll").distinct()
    return found.groupBy(F.floor(F.col("comp") / 6).cast("long").alias("block")).agg(F.round(F.sum("ll"), 6).alias("ll"))


_simple("maxcut_narrow", _narrow, CALLS6 + f""", g AS (SELECT cast(floor(snp/6.0) AS bigint) comp, frag, mask, sum(CASE WHEN allele=({_BIT}) THEN {OK} ELSE {ER} END) a, sum(CASE WHEN allele=({_BIT}) THEN {ER} ELSE {OK} END) b
FROM calls, (SELECT unnest(range(32)) mask) GROUP BY ALL), s AS (SELECT comp, mask, sum({_LL('a', 'b')}) ll FROM g GROUP BY ALL) SELECT comp block, round(max(ll),6) ll FROM s WHERE comp IN (SELECT cast(floor(snp/6.0) AS bigint) FROM (SELECT frag, min(snp) snp FROM calls GROUP BY frag HAVING count(*)>=2)) GROUP BY comp""")


# ---- crossing mates ----

def _countable(spark, d: str) -> DataFrame:
    c = calls(spark, d)
    phased = L.variant_posterior(c, hap).select("snp", locus().alias("comp"), hap(F.col("snp")).alias("hap"), "post_hap")
    return H.countable(_mates(spark, d), phased, c.groupBy("snp").agg(F.count("*").alias("n")))


SURE = BINS.replace(CALLS, FRAGS, 1) + f""", vp AS (SELECT snp, count(*) n, sum({_LL('p0', 'p1')}) a, sum({_LL('(p0-t0+t1)', '(p1-t1+t0)')}) b FROM terms JOIN p USING (frag) GROUP BY snp),
ok AS (SELECT snp FROM vp WHERE n>1 AND round(a-{_LL('a', 'b')},4)>=log10(0.99)), cm AS (SELECT mm.* FROM mm JOIN ok x ON x.snp=s1 JOIN ok y ON y.snp=s2 WHERE floor(s1/12.0)=floor(s2/12.0))"""
_simple("countable_mates", lambda s, d: _countable(s, d).select("s1", "s2", "h1", "h2", "isize"), SURE + f" SELECT s1, s2, {HAP.format('s1')} h1, {HAP.format('s2')} h2, cast(isize AS bigint) isize FROM cm")
_Q1, _Q2 = "pow(10.0,-q1/10.0)", "pow(10.0,-q2/10.0)"
_simple("sure_crossings", lambda s, d: J.crossing_bins(_countable(s, d), hap, 5000), SURE + f" SELECT cast(floor(isize/5000) AS bigint) bin, round(sum(CASE WHEN (a1=a2)=({HAP.format('s1')}={HAP.format('s2')}) THEN (1-{_Q1})*{_Q2}+(1-{_Q2})*{_Q1} ELSE (1-{_Q1})*(1-{_Q2})+{_Q1}*{_Q2} END),6) crossings, count(*) n FROM cm GROUP BY 1")


def _assigned(spark, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("frag"), F.when(F.col("o_orderkey") % 4 != 0, F.lit(1).cast("long")).alias("mate2_ix"), F.floor("o_totalprice").cast("long").alias("isize"))
    rates = spark.range(60).select(F.col("id").alias("bin"), F.when(F.col("id") % 7 != 0, F.col("id") / 100).alias("rate"))
    return H.with_crossing(f, rates).select("frag", F.round("h", 6).alias("h"))


_simple("crossing_of_fragments", _assigned, "SELECT o_orderkey frag, CASE WHEN o_orderkey%4<>0 AND floor(o_totalprice/5000)<60 AND floor(o_totalprice/5000)%7<>0 THEN round(log10(floor(floor(o_totalprice)/5000)/100.0),6) ELSE -80.0 END h FROM orders")
_simple("near_fragments", lambda s, d: X.near_enough(table(s, d, "orders").select(F.col("o_orderkey").alias("frag"), F.when(F.col("o_orderkey") % 4 != 0, F.floor("o_totalprice").cast("long")).alias("isize")), 150_000).select("frag"),
    "SELECT o_orderkey frag FROM orders WHERE o_orderkey%4=0 OR floor(o_totalprice)<150000")


# ---- clusters ----

def _sites(spark, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("snp"), F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("chrom"), (F.col("p_partkey") * 9 + F.col("p_size") % 4 * 11).alias("pos"))


_simple("variant_clusters", lambda s, d: K.variant_clusters(_sites(s, d)).select("snp", "cluster"), """WITH s AS (SELECT p_partkey snp, p_partkey%3 chrom, p_partkey*9+p_size%4*11 pos FROM part), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, snp) <= 20 THEN 0 ELSE 1 END far FROM s),
r AS (SELECT *, sum(far) OVER (PARTITION BY chrom ORDER BY pos, snp ROWS UNBOUNDED PRECEDING) run FROM f), k AS (SELECT *, floor((row_number() OVER (PARTITION BY chrom, run ORDER BY pos, snp)-1)/10) part FROM r) SELECT snp, min(snp) OVER (PARTITION BY chrom, run, part) cluster FROM k""")
_simple("cluster_grades", lambda s, d: K.graded(K.read_clusters(_reads(s, d).withColumn("flag", F.when(F.col("flag") == 3, 1024).otherwise(0)), 1500)), f"""WITH {READS}, g AS (SELECT * FROM r WHERE isize>=0 AND flag<>3), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos, read_id) < 1500 THEN 0 ELSE 1 END new FROM g),
c AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos, read_id ROWS UNBOUNDED PRECEDING) run FROM n), k AS (SELECT *, min(pos) OVER (PARTITION BY chrom, run) cluster FROM c), d AS (SELECT *, CASE WHEN mapq>0 THEN cast(pos - lag(pos) OVER (PARTITION BY chrom, cluster ORDER BY pos, read_id) AS double) END d FROM k)
SELECT chrom, cluster, max(pos)-min(pos) length, count(*) FILTER (WHERE mapq>0) AS reads, CASE WHEN count(*) FILTER (WHERE mapq>0)>=5 THEN round(avg(d),4) END mean, CASE WHEN count(*) FILTER (WHERE mapq>0)>=5 THEN round(sqrt(greatest(avg(d*d)-avg(d)*avg(d),0)),4) END std,
CASE WHEN count(*) FILTER (WHERE mapq>0)>=5 THEN 'good' WHEN count(*) FILTER (WHERE mapq>0)=0 THEN 'repeat' WHEN count(*) FILTER (WHERE mapq>0)=1 THEN 'singleton' ELSE 'weak' END grade FROM d GROUP BY chrom, cluster""")
_simple("cluster_consensus", lambda s, d: K.cluster_consensus(raw_calls(s, d).select(F.floor(F.col("frag") / 4).alias("cluster"), "snp", ((F.col("allele") + F.col("frag")) % 2).cast("int").alias("allele"), "qv")), f"""WITH {RAW()}, o AS (SELECT cast(floor(frag/4) AS bigint) cluster, snp, count(*) FILTER (WHERE (allele+frag)%2=0) n0, count(*) FILTER (WHERE (allele+frag)%2=1) n1, coalesce(sum(qv) FILTER (WHERE (allele+frag)%2=0),0) q0, coalesce(sum(qv) FILTER (WHERE (allele+frag)%2=1),0) q1 FROM raw GROUP BY ALL),
f AS (SELECT cluster FROM o GROUP BY cluster HAVING count(*) FILTER (WHERE n0>0 AND n1>0)<2 AND count(*) FILTER (WHERE n0>0 AND n1>0)*3<count(*) AND count(*)>=2),
a AS (SELECT cluster, snp, CASE WHEN n0>n1 AND n1<=1 AND q0>q1 THEN 0 WHEN n1>n0 AND n0<=1 AND q1>q0 THEN 1 END allele, cast(least(abs(q0-q1),60) AS int) qv FROM o WHERE cluster IN (SELECT cluster FROM f)), k AS (SELECT * FROM a WHERE allele IS NOT NULL AND qv>=6)
SELECT cluster, snp, cast(allele AS int) allele, qv FROM k WHERE cluster IN (SELECT cluster FROM k GROUP BY cluster HAVING count(*)>=2)""")


# ---- replicates, files by contig, streams ----

def _improved(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 10).alias("setting"), "o_totalprice", "o_orderkey")
    return E.improvement(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["setting"], "o_totalprice").select("setting", *[F.round(c, 2).alias(c) for c in ("before_mean", "before_std", "after_mean", "after_std", "percent")])


_simple("improvement", _improved, """WITH o AS (SELECT o_custkey%10 setting, o_orderkey%2 k, avg(o_totalprice) m, stddev_pop(o_totalprice) s FROM orders GROUP BY ALL)
SELECT a.setting, round(a.m,2) before_mean, round(a.s,2) before_std, round(b.m,2) after_mean, round(b.s,2) after_std, round(100*(a.m-b.m)/a.m,2) percent FROM o a JOIN o b ON a.setting=b.setting AND a.k=0 AND b.k=1""")


def _by_contig(spark, d: str) -> DataFrame:
    return T.by_contig(_sites(spark, d), scratch_path(spark, "contigs"))


_simple("files_by_contig", _by_contig, "SELECT p_partkey snp, 'c' || p_partkey%3 chrom, p_partkey*9+p_size%4*11 pos FROM part")


def _stream(spark, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _streamed_mates(spark, d: str) -> DataFrame:
    side = lambda k: _stream(spark, d).where(F.col("event_id") % 2 == k).select(F.floor(F.col("event_id") / 2).cast("long").alias("read"), F.col("ts").cast("timestamp").alias("ts"))
    m = S.drained(S.stream_mates(side(0), side(1), "400000 seconds"), "mates")
    return m.select("read", F.unix_micros("t1").alias("t1"), F.unix_micros("t2").alias("t2"))


_simple("streaming_mates", _streamed_mates, "SELECT a.event_id//2 AS read, epoch_us(a.ts) t1, epoch_us(b.ts) t2 FROM events a JOIN events b ON a.event_id%2=0 AND b.event_id=a.event_id+1 AND b.ts BETWEEN a.ts - INTERVAL 400000 seconds AND a.ts + INTERVAL 400000 seconds")


def _streamed_bins(spark, d: str) -> DataFrame:
    e = _stream(spark, d).select(F.col("event_type").alias("bx"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drained(S.stream_bins(e, "1 day", "0 seconds"), "bins").select("bx", F.unix_seconds("start").alias("start"), "n")


_simple("streaming_bins", _streamed_bins, """WITH b AS (SELECT event_type bx, cast(floor(epoch(ts)/86400) AS bigint)*86400 s, count(*) n FROM events GROUP BY 1, 2) SELECT bx, s AS "start", n FROM b WHERE (s+86400)*1000 <= (SELECT epoch_ms(max(ts)) FROM events)""")


# ---- files: written as text in shared storage and read back ----

def _written(lines: DataFrame, name: str, *order: str) -> str:
    path = scratch_path(lines.sparkSession, name)
    (lines.orderBy(*order) if order else lines).select("value").write.text(path)
    return path


def _fragment_file(spark, d: str) -> DataFrame:
    c = calls(spark, d).withColumn("name", F.concat(F.lit("f"), F.col("frag").cast("string")))
    none = F.lit(None)
    f = c.select("name", (F.col("frag") % 2).alias("half")).distinct().select("name", "half", none.cast("long").alias("mate2_ix"), none.cast("long").alias("isize"), none.cast("string").alias("barcode"))
    paths = [_written(X.in_order(X.typed_lines(f.where(F.col("half") == k), c.select("name", "snp", "allele", "qv"), 0, bool(k))), f"fragments-{k}") for k in (0, 1)]
    fragments, found = T.read_fragment_files(spark, paths)
    return found.join(fragments.select("frag", "name"), "frag").select("name", "snp", "allele", "qv")


_simple("fragment_files", _fragment_file, CALLS + " SELECT 'f' || frag AS name, snp, allele, qv FROM calls")


def _variant_file(spark, d: str) -> str:
    rows = _variant_rows(spark, d)
    head = spark.createDataFrame([(-1, 0, "##fileformat=VCFv4.1")], "ok long, ln int, value string")
    return _written(rows.select("ok", "ln", F.array_join("c", "\t").alias("value")).unionByName(head), "variants", "ok", "ln", "value")


_simple("variant_file", lambda s, d: T.read_variants(s, _variant_file(s, d)).select("var_ix", "chrom", "pos", "ref", "alt", F.substring("genotype", 1, 3).alias("genotype"), "is_indel", "het"),
    f"WITH {ROWS} SELECT row_number() OVER (ORDER BY ok, ln, chrom, ref, alt) - 1 var_ix, chrom, cast(pos AS int) pos, ref, alt, gt genotype, length(ref)<>1 OR len(list_filter(string_split(alt,','), lambda a: length(a)<>1))>0 is_indel, left(gt,1)<>right(gt,1) het FROM v")


def _alignment_file(spark, d: str) -> str:
    l = table(spark, d, "lineitem")
    line = F.concat_ws("\t", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.when(F.col("l_suppkey") % 5 == 0, F.col("l_partkey") % 4096).otherwise(F.col("l_partkey") % 4 * 16).cast("string"),
        F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")), F.col("l_partkey").cast("string"), (F.col("l_partkey") % 41 + 10).cast("string"), F.lit("4S80M2I14M"), F.lit("="), F.lit("1"), F.lit("0"), F.repeat(F.lit("ACGT"), F.lit(25)), F.repeat(F.lit("5I"), F.lit(50)),
        F.concat(F.lit("BX:Z:b"), (F.col("l_orderkey") % 100).cast("string")))
    return _written(l.select(line.alias("value")).unionByName(spark.createDataFrame([("@HD\tVN:1.6",)], "value string")), "alignments")


ALIGNED = """l AS (SELECT l_orderkey || '-' || l_linenumber read_id, CASE WHEN l_suppkey%5=0 THEN l_partkey%4096 ELSE l_partkey%4*16 END flag, 'c' || l_orderkey%3 chrom, cast(l_partkey AS int) pos, cast(l_partkey%41+10 AS int) mapq, 'b' || l_orderkey%100 bx FROM lineitem),
a AS (SELECT * FROM l WHERE (flag & 3844)=0 AND mapq>=20)"""
_simple("alignment_file", lambda s, d: T.aligned_pieces(T.read_sam(s, _alignment_file(s, d))).select("read_id", "flag", "chrom", "pos", "mapq", "end", F.size("cigar").alias("ops"), "mate_chrom", "bx"),
    f"WITH {ALIGNED} SELECT read_id, cast(flag AS int) flag, chrom, pos, mapq, cast(pos+93 AS int) \"end\", cast(4 AS int) ops, chrom mate_chrom, bx FROM a")


def _called(spark, d: str) -> DataFrame:
    base = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    p = F.col("p_partkey")
    v = table(spark, d, "part").select(p.alias("var_ix"), F.concat(F.lit("c"), (p % 3).cast("string")).alias("chrom"), (p * 3).cast("int").alias("pos"), base(p).alias("ref"), base(p + 1).alias("alt"), (p % 7 != 0).alias("het"), F.lit(False).alias("is_indel"))
    return T.call_snps(T.read_sam(spark, _alignment_file(spark, d)), v, 21).select("read_id", "snp", "allele", "qv")


_simple("called_alleles", _called, f"""WITH {ALIGNED}, v AS (SELECT p_partkey snp, 'c' || p_partkey%3 chrom, p_partkey*3 vpos, substr('ACGT', cast(p_partkey%4+1 AS int), 1) r, substr('ACGT', cast((p_partkey+1)%4+1 AS int), 1) b FROM part WHERE p_partkey%7<>0),
j AS (SELECT *, CASE WHEN vpos-pos<80 THEN vpos-pos+4 ELSE vpos-pos+6 END o FROM a JOIN v ON a.chrom=v.chrom AND vpos BETWEEN pos AND pos+93),
k AS (SELECT *, substr('ACGT', cast(o%4+1 AS int), 1) base, CASE WHEN o%2=0 THEN 20 ELSE 40 END q FROM j) SELECT read_id, snp, cast(CASE WHEN base=r THEN 0 ELSE 1 END AS int) allele, cast(least(q, mapq) AS int) qv FROM k WHERE base IN (r, b) AND q>=21""")


def _sequence_file(spark, d: str) -> DataFrame:
    n = table(spark, d, "part").where("p_partkey <= 90").select((F.col("p_partkey") % 3).alias("k"), "p_partkey", F.lpad(F.lower(F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACGTACGTAC")), 7, "n").alias("value"))
    heads = spark.range(3).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("p_partkey"), F.concat(F.lit(">s"), F.col("id").cast("string"), F.lit(" contig")).alias("value"))
    return T.read_fasta(spark, _written(n.unionByName(heads), "sequence", "k", "p_partkey"))


_simple("sequence_file", _sequence_file, """WITH l AS (SELECT p_partkey%3 k, p_partkey, upper(lpad(lower(translate(cast(p_partkey AS varchar), '0123456789', 'ACGTACGTAC')), 7, 'n')) bases FROM part WHERE p_partkey<=90)
SELECT 's' || k chrom, row_number() OVER w - 1 line, (row_number() OVER w - 1)*7+1 "start", bases FROM l WINDOW w AS (PARTITION BY k ORDER BY p_partkey)""")


def _interval_file(spark, d: str) -> DataFrame:
    spans = N.molecule_spans(reads(spark, d).select(F.lit("c").alias("chrom"), F.concat(F.lit("b"), F.col("bx").cast("string")).alias("bx"), "pos", (F.col("pos") + 99).alias("end"), F.lit(0).alias("flag"), F.lit(60).alias("mapq"), F.lit(None).cast("string").alias("mi")), GAP)
    return T.read_bed(spark, _written(T.interval_lines(spans), "intervals"))


_simple("interval_file", _interval_file, MOLS.format(GAP) + " SELECT 'c' chrom, min(pos)-1 \"start\", max(pos)+99 \"end\", 'b' || bx barcode, count(*) n_reads FROM m GROUP BY bx, mol")
_simple("crossing_file", lambda s, d: T.read_crossing_model(s, _written(T.crossing_model_lines(s.range(50).select(F.col("id").alias("bin"), (F.col("id") / 100).alias("rate"))), "crossing", "bin")), "SELECT i bin, round(i/100.0,6)::double prob FROM range(50) t(i)")


def _block_file(spark, d: str) -> DataFrame:
    c = cut(calls(spark, d), "calls")
    post = L.variant_posterior(c, hap).select("snp", locus().alias("comp"), hap(F.col("snp")).cast("int").alias("hap"), "post_hap")
    v = post.select(F.col("snp").alias("var_ix"), F.lit("c").alias("chrom"), (F.col("snp") * 10).alias("pos"), F.lit("A").alias("ref"), F.lit("T").alias("alt"), F.lit("0/1").alias("genotype"), F.lit("0/1").alias("sample"))
    found = T.read_blocks(spark, _written(T.block_lines(post, v, c), "blocks", "comp"))
    return found.select("snp", "a1", "a2", "chrom", "pos", "ref", "alt", "sample", "discrete", "n", F.min("snp").over(Window.partitionBy("block")).alias("first"))


_simple("block_file", _block_file, FRAGS + f""", vp AS (SELECT snp, count(*) n, sum({_LL('p0', 'p1')}) a, sum({_LL('(p0-t0+t1)', '(p1-t1+t0)')}) b FROM terms JOIN p USING (frag) GROUP BY snp),
x AS (SELECT snp, n, {HAP.format('snp')} h, first_value({HAP.format('snp')}) OVER w lead, min(snp) OVER w f, round(a-{_LL('a', 'b')},4)<log10(0.8) low FROM vp WINDOW w AS (PARTITION BY floor(snp/12.0) ORDER BY snp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT snp, CASE WHEN low THEN '-' WHEN lead=0 THEN cast(h AS varchar) ELSE cast(1-h AS varchar) END a1, CASE WHEN low THEN '-' WHEN lead=0 THEN cast(1-h AS varchar) ELSE cast(h AS varchar) END a2, 'c' chrom, cast(snp*10 AS int) pos, 'A' ref, 'T' alt, '0/1' AS sample, '0' AS discrete, n, f AS "first" FROM x""")


def _phased_file(spark, d: str) -> DataFrame:
    path = _variant_file(spark, d)
    v = T.read_variants(spark, path)
    phased = v.where("het AND var_ix % 5 <> 0").select(F.col("var_ix").alias("snp"), (F.col("var_ix") % 2).cast("int").alias("hap"), (F.floor(F.col("var_ix") / 10) * 1000).alias("first_pos"), (F.col("var_ix") % 3).alias("size"), (-(F.col("var_ix") % 9) / 50).alias("post_hap"), (F.col("var_ix") % 8).alias("n"))
    lines = T.phased_variant_lines(spark, path, phased).where("part = 1")
    c = F.split("value", "\t")
    return lines.select("ix", F.get(c, F.lit(8)).alias("format"), F.get(c, F.lit(9)).alias("sample"))


_simple("phased_file", _phased_file, f"""WITH {ROWS}, x AS (SELECT *, row_number() OVER (ORDER BY ok, ln, chrom, ref, alt) - 1 ix FROM v), y AS (SELECT *, left(gt,1) a, right(gt,1) b, left(gt,1)<>right(gt,1) AND ix%5<>0 AND ix%3=2 inside, -(ix%9)/50.0 post FROM x),
z AS (SELECT *, CASE WHEN NOT inside THEN 0 WHEN post<log10(0.8) THEN 2 ELSE 1 END kind, CASE WHEN contains(gt,'2') THEN a ELSE '0' END one, CASE WHEN contains(gt,'2') THEN b ELSE '1' END two FROM y)
SELECT ix, CASE WHEN kind=1 THEN 'GT:DP:PQ:PD:PS' ELSE 'GT:DP:PS' END format, CASE kind WHEN 0 THEN a || '/' || b WHEN 2 THEN './.' ELSE CASE WHEN ix%2=0 THEN one || '|' || two ELSE two || '|' || one END END || ':' || ln || ':' ||
 CASE WHEN kind=1 THEN cast(cast(floor(CASE WHEN post=0 THEN 100.0 ELSE least(-10*log10(1-pow(10.0,post)),100.0) END + 0.5) AS bigint) AS varchar) || ':' || (ix%8) || ':' || (cast(floor(ix/10) AS bigint)*1000) ELSE '.' END AS "sample" FROM z""")
