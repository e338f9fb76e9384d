"""Queries over the driver's tables: allele calls are projected from lineitem by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import calls as C, evaluate as E, likelihood as L, link as J
from .operators.linking import unlinked
from .plans import genotype as G, phase as P
from .plans.components import connected_components
from .storage import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hap(snp):
    """Planted truth."""
    return (snp * 7) % 11 % 2


def raw_calls(spark, d: str, width: int = 12) -> DataFrame:
    l = table(spark, d, "lineitem")
    snp = F.floor(F.col("l_orderkey") / (2 * width)).cast("long") * width + F.col("l_partkey") % width
    return l.select(F.col("l_orderkey").alias("frag"), snp.alias("snp"),
        (((snp * 7) % 11 + F.col("l_orderkey") + F.when(F.col("l_suppkey") % 40 == 0, 1).otherwise(0)) % 2).cast("int").alias("allele"),
        (5 + F.col("l_quantity").cast("long") % 36).cast("int").alias("qv"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))


def calls(spark, d: str, width: int = 12) -> DataFrame:
    return C.consensus(raw_calls(spark, d, width))


def locus(col: str = "snp"):
    return F.floor(F.col(col) / 12).cast("long")


def RAW(width: int = 12) -> str:
    snp = f"cast(floor(l_orderkey/{2 * width}.0) as bigint)*{width} + l_partkey%{width}"
    return (f"raw AS (SELECT l_orderkey frag, {snp} snp, cast((({snp})*7 % 11 + l_orderkey + CASE WHEN l_suppkey%40=0 THEN 1 ELSE 0 END) % 2 AS int) allele, "
            "cast(5 + cast(floor(l_quantity) AS bigint)%36 AS int) qv, l_linenumber line, l_returnflag flag FROM lineitem)")


CALLS = f"WITH RECURSIVE {RAW()}, calls AS (SELECT frag, snp, min(allele) allele, max(qv) qv FROM raw GROUP BY frag, snp HAVING count(DISTINCT allele)=1)"
HAP = "(({0}*7)%11)%2"
OK, ER = "log10(1-pow(10.0,-qv/10.0))", "(-qv/10.0)"
LSE = "(greatest({0},{1}) + log10(1+pow(10.0, least({0},{1})-greatest({0},{1}))))"
TERMS = CALLS + f", terms AS (SELECT *, CASE WHEN allele={HAP.format('snp')} THEN {OK} ELSE {ER} END t0, CASE WHEN allele={HAP.format('snp')} THEN {ER} ELSE {OK} END t1 FROM calls)"
EDGES = CALLS + ", adj AS (SELECT DISTINCT snp a, lead(snp) OVER (PARTITION BY frag ORDER BY snp) b FROM calls), e AS (SELECT a, b FROM adj WHERE b IS NOT NULL UNION SELECT b, a FROM adj WHERE b IS NOT NULL)"
COMPS = EDGES + ", walk AS (SELECT DISTINCT a node, a lab FROM e UNION SELECT e.b, walk.lab FROM walk JOIN e ON e.a = walk.node), comps AS (SELECT node snp, min(lab) comp FROM walk GROUP BY node)"
MATCH = CALLS + f", rows_ AS (SELECT snp, cast(floor(snp/12.0) AS bigint) block, CASE WHEN (sum(CASE WHEN (allele=1) = (frag%2=0) THEN qv ELSE -qv END) > 0) = ({HAP.format('snp')}=1) THEN 1 ELSE 0 END AS match FROM calls GROUP BY snp)"


def voted(spark, d: str) -> DataFrame:
    """A quality-weighted vote phases each variant by strand; match: whether it agrees with the truth. block: locus."""
    v = calls(spark, d).groupBy("snp").agg(F.sum(F.when((F.col("allele") == 1) == (F.col("frag") % 2 == 0), F.col("qv")).otherwise(-F.col("qv"))).alias("s"))
    return v.select("snp", locus().alias("block"), ((F.col("s") > 0) == (hap(F.col("snp")) == 1)).cast("int").alias("match"))


def _simple(name: str, f, sql: str):
    query(name, sql)(f)


_simple("allele_calls", lambda s, d: calls(s, d), CALLS + " SELECT * FROM calls")
_simple("coverage_per_variant", lambda s, d: C.coverage(calls(s, d)), CALLS + " SELECT snp, count(*) n FROM calls GROUP BY snp")
_simple("allele_depth", lambda s, d: C.depth(calls(s, d)), CALLS + " SELECT snp, " + ", ".join(f"count(*) FILTER (WHERE allele={a} AND frag%2={r}) a{a}_{n}" for a in (0, 1) for r, n in ((0, "fwd"), (1, "rev"))) + " FROM calls GROUP BY snp")
_simple("informative_fragments", lambda s, d: C.informative(calls(s, d)), CALLS + " SELECT frag, count(*) n FROM calls GROUP BY frag HAVING count(*)>=2")
_simple("mean_calls_per_fragment", lambda s, d: C.mean_calls(calls(s, d)), CALLS + " SELECT round(avg(n),6) mean_calls, avg(n)>=3 long_reads FROM (SELECT count(*) n FROM calls GROUP BY frag)")
_simple("fragment_blocks", lambda s, d: C.fragment_lines(calls(s, d)), CALLS + """, r AS (SELECT *, snp - row_number() OVER (PARTITION BY frag ORDER BY snp) run FROM calls),
b AS (SELECT frag, min(snp) s, string_agg(cast(allele AS varchar), '' ORDER BY snp) h, string_agg(chr(33+least(qv,93)), '' ORDER BY snp) q FROM r GROUP BY frag, run)
SELECT frag, count(*) || ' ' || frag || ' ' || string_agg((s+1) || ' ' || h, ' ' ORDER BY s) || ' ' || string_agg(q, '' ORDER BY s) line FROM b GROUP BY frag""")
_simple("adjacent_edges", lambda s, d: C.adjacent_edges(calls(s, d)), CALLS + " SELECT a, b, count(*) n FROM (SELECT snp a, lead(snp) OVER (PARTITION BY frag ORDER BY snp) b FROM calls) WHERE b IS NOT NULL GROUP BY a, b")
_simple("pair_edges", lambda s, d: C.pair_edges(calls(s, d)), CALLS + " SELECT x.snp a, y.snp b, count(*) n FROM calls x JOIN calls y ON x.frag=y.frag AND x.snp<y.snp GROUP BY ALL")
_E1, _E2 = "pow(10.0,-x.qv/10.0)", "pow(10.0,-y.qv/10.0)"
WEIGHTS = CALLS + f""", k AS (SELECT frag, count(*) k FROM calls GROUP BY frag), w AS (SELECT x.snp a, y.snp b, round(sum(CASE WHEN (x.allele=y.allele)=({HAP.format('x.snp')}={HAP.format('y.snp')}) THEN 1 ELSE -1 END
 * log10(((1-{_E1})*(1-{_E2})+{_E1}*{_E2})/((1-{_E1})*{_E2}+{_E1}*(1-{_E2})))/(k-1)),6) weight FROM calls x JOIN calls y ON x.frag=y.frag AND x.snp<y.snp JOIN k ON k.frag=x.frag GROUP BY ALL)"""
_simple("edge_weights", lambda s, d: C.edge_weights(calls(s, d), hap), WEIGHTS + " SELECT * FROM w")
_simple("top5_edges", lambda s, d: C.top_edges(C.edge_weights(calls(s, d), hap), locus("a")), WEIGHTS + " SELECT * FROM (SELECT cast(floor(a/12.0) AS bigint) comp, cast(row_number() OVER (PARTITION BY floor(a/12.0) ORDER BY abs(weight) DESC, a, b) AS int) rank, a, b, weight FROM w) WHERE rank<=5")
_simple("components", lambda s, d: connected_components(C.adjacent_edges(calls(s, d))).select(F.col("node").alias("snp"), F.col("component").alias("comp")), COMPS + " SELECT snp, comp FROM comps")
_simple("block_table", lambda s, d: P.block_table(calls(s, d)), COMPS + """ SELECT b.*, coalesce(fragments,0) fragments FROM (SELECT comp, min(snp) first_ix, max(snp) last_ix, count(*) phased FROM comps GROUP BY comp) b
LEFT JOIN (SELECT comp, count(*) fragments FROM (SELECT frag, min(snp) snp FROM calls GROUP BY frag) JOIN comps USING (snp) GROUP BY comp) USING (comp)""")
FLL = TERMS + f", p AS (SELECT frag, sum(t0) p0, sum(t1) p1, min(snp) first_snp FROM terms WHERE qv>=6 GROUP BY frag), f AS (SELECT *, {LSE.format('p0', 'p1')} ll FROM p)"
_simple("fragment_ll", lambda s, d: L.fragment_ll(calls(s, d), hap).select("frag", F.round("ll", 6).alias("ll")), FLL + " SELECT frag, round(ll,6) ll FROM f")
_simple("component_score", lambda s, d: L.fragment_ll(calls(s, d), hap).groupBy(locus("first_snp").alias("comp")).agg(F.round(-F.sum("ll"), 4).alias("score")), FLL + " SELECT cast(floor(first_snp/12.0) AS bigint) comp, round(-sum(ll),4) score FROM f GROUP BY 1")
_simple("read_tags", lambda s, d: L.read_tags(calls(s, d), hap), FLL + " SELECT frag, CASE WHEN p0>p1 THEN 0 ELSE 1 END hp, cast(floor(round(10*(ll-least(p0,p1)),6)) AS bigint) pq FROM f WHERE pow(10.0, greatest(p0,p1)-ll)>=0.95")
_simple("hic_fragment_ll", lambda s, d: L.hic_ll(calls(s, d), hap, calls(s, d).groupBy("frag").agg((F.floor(F.min("snp") / 12) * 12 + 6).cast("long").alias("mate2"), F.lit(-2.0).alias("h"))).select("frag", F.round("ll", 6).alias("ll")),
    TERMS + f", g AS (SELECT frag, sum(t0) p0, sum(t1) p1, sum(CASE WHEN snp%12>=6 THEN t1 ELSE t0 END) q0, sum(CASE WHEN snp%12>=6 THEN t0 ELSE t1 END) q1 FROM terms WHERE qv>=6 GROUP BY frag), h AS (SELECT frag, {LSE.format('p0', 'p1')} + log10(0.99) x, {LSE.format('q0', 'q1')} - 2.0 y FROM g) SELECT frag, round({LSE.format('x', 'y')},6) ll FROM h")
_simple("variant_posterior", lambda s, d: L.variant_posterior(calls(s, d), hap), TERMS + f""", p AS (SELECT frag, sum(t0) p0, sum(t1) p1 FROM terms GROUP BY frag),
s AS (SELECT snp, sum({LSE.format('p0', 'p1')}) a, sum({LSE.format('(p0-t0+t1)', '(p1-t1+t0)')}) b FROM terms JOIN p USING (frag) GROUP BY snp)
SELECT snp, round(a-{LSE.format('a', 'b')},4)+cast(0 AS double) post_hap, round(b-{LSE.format('a', 'b')},4)+cast(0 AS double) post_flip, round(a-{LSE.format('a', 'b')},4)<log10(0.8) pruned FROM s""")
_simple("switch_posterior", lambda s, d: L.switch_posterior(calls(s, d), hap, locus()), TERMS + f""", f AS (SELECT frag, cast(floor(min(snp)/12.0) AS bigint) comp, min(snp) lo, max(snp) hi, sum(t0) p0, sum(t1) p1 FROM terms GROUP BY frag),
i AS (SELECT DISTINCT snp i, cast(floor(snp/12.0) AS bigint) comp FROM calls), d AS (SELECT f.comp, i.i, f.frag, any_value(p0) p0, any_value(p1) p1, sum(t1-t0) g FROM f JOIN i ON i.comp=f.comp AND i.i>lo AND i.i<=hi JOIN terms t ON t.frag=f.frag AND t.snp>=i.i GROUP BY ALL),
s AS (SELECT comp, i snp, sum({LSE.format('p0', 'p1')}) a, sum({LSE.format('(p0+g)', '(p1-g)')}) b FROM d GROUP BY ALL) SELECT comp, snp, round(b-{LSE.format('a', 'b')},4)+cast(0 AS double) post_switch FROM s""")
CALLS6 = f"WITH {RAW(6)}, calls AS (SELECT frag, snp, min(allele) allele, max(qv) qv FROM raw GROUP BY frag, snp HAVING count(DISTINCT allele)=1)"
_BIT = "(CAST(mask AS bigint) >> CAST(snp%6 AS int)) & 1"
_simple("exact_ml_phase", lambda s, d: P.exact_phase(calls(s, d, 6), F.floor(F.col("snp") / 6).cast("long"), 6), CALLS6 + f""", g AS (SELECT cast(floor(snp/6.0) AS bigint) comp, frag, mask, sum(CASE WHEN allele=({_BIT}) THEN {OK} ELSE {ER} END) a, sum(CASE WHEN allele=({_BIT}) THEN {ER} ELSE {OK} END) b
FROM calls, (SELECT unnest(range(32)) mask) GROUP BY ALL), s AS (SELECT comp, mask, round(sum({LSE.format('a', 'b')}),6) ll FROM g GROUP BY ALL) SELECT comp, cast(mask AS int) mask, ll FROM s QUALIFY row_number() OVER (PARTITION BY comp ORDER BY ll DESC, mask)=1""")


def _on_one_cut(f):
    """f(calls, phase) with the calls and the phase computed once."""
    def run(spark, d: str) -> DataFrame:
        c = cut(calls(spark, d), "calls")
        return f(c, cut(P.phase(c), "phase"))
    return run


query("maxcut_phase")(lambda s, d: P.phase(cut(calls(s, d), "calls")).withColumn("ll", F.round("ll", 6)))
query("refined_phase")(_on_one_cut(G.refine))
query("local_genotypes")(_on_one_cut(G.genotype))

def reads(spark, d: str) -> DataFrame:
    """Events as barcoded reads: user_id is the barcode, seconds are the position."""
    return table(spark, d, "events").select(F.col("user_id").alias("bx"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("pos"), F.col("event_id").alias("read"), F.col("event_type").alias("kind"))


MOLS = "WITH r AS (SELECT user_id bx, cast(floor(epoch(ts)) AS bigint) pos, event_id AS read, event_type kind FROM events), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY bx ORDER BY pos) <= {0} THEN 0 ELSE 1 END new FROM r), m AS (SELECT *, sum(new) OVER (PARTITION BY bx ORDER BY pos) mol FROM n)"
GAP = 20_000
_simple("molecules", lambda s, d: J.molecule_extents(reads(s, d), GAP, ["bx"]), MOLS.format(GAP) + ' SELECT bx, cast(mol AS bigint) mol, min(pos) "start", max(pos) "end", count(*) n_reads FROM m GROUP BY bx, mol')
_simple("molecules_session_window", lambda s, d: table(s, d, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp"))).groupBy(F.col("user_id").alias("bx"), F.session_window("t", f"{GAP} seconds")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n_reads")).select("bx", F.unix_seconds("a").alias("start"), F.unix_seconds("b").alias("end"), "n_reads"),
    MOLS.format(GAP) + ' SELECT bx, min(pos) "start", max(pos) "end", count(*) n_reads FROM m GROUP BY bx, mol')


def _barcoded(spark, d: str) -> DataFrame:
    m = J.molecules(reads(spark, d), GAP, ["bx"])
    return m.select((F.col("bx") * 100_000 + F.col("mol")).alias("frag"), (F.col("pos") % 50).alias("snp"), ((F.col("pos") % 50 + F.col("read") % 7 % 2 * (F.col("read") % 13 == 0).cast("int")) % 2).cast("int").alias("allele"), F.lit(20).alias("qv"))


_simple("molecule_consensus", lambda s, d: C.summed_consensus(_barcoded(s, d)), MOLS.format(GAP) + " SELECT cast(bx*100000+mol AS bigint) frag, pos%50 snp, min(cast((pos%50 + read%7%2*CASE WHEN read%13=0 THEN 1 ELSE 0 END)%2 AS int)) allele, cast(CASE WHEN count(*)=1 THEN 20 ELSE least(20*count(*),40) END AS int) qv FROM m GROUP BY 1,2 HAVING count(DISTINCT cast((pos%50 + read%7%2*CASE WHEN read%13=0 THEN 1 ELSE 0 END)%2 AS int))=1")
def _unlinked(spark, d: str) -> DataFrame:
    m = J.molecules(reads(spark, d), GAP, ["bx"])
    linked = m.join(m.groupBy("bx", "mol").agg(F.count("*").alias("n")).where("n > 1").select("bx", "mol"), ["bx", "mol"], "left_semi")
    return unlinked(reads(spark, d).withColumnRenamed("read", "frag"), linked.withColumnRenamed("read", "frag")).select(F.col("frag").alias("read"), "bx")


_simple("unlinked_fragments", _unlinked, MOLS.format(GAP) + " SELECT min(read) read, bx FROM m GROUP BY bx, mol HAVING count(*)=1")
_simple("reads_x_variants", lambda s, d: J.interval_join(
    table(s, d, "orders").select((F.col("o_custkey") % 5).alias("chrom"), F.col("o_orderkey").alias("read"), (F.col("o_custkey") * 40).alias("start"), (F.col("o_custkey") * 40 + F.floor(F.col("o_totalprice") / 2000)).cast("long").alias("end")),
    table(s, d, "part").select((F.col("p_partkey") % 5).alias("chrom"), (F.col("p_partkey") * 37).alias("pos")), ["chrom"], 500).select("chrom", "read", "pos"),
    "SELECT o_custkey%5 chrom, o_orderkey AS read, p_partkey*37 pos FROM orders JOIN part ON o_custkey%5=p_partkey%5 AND p_partkey*37 BETWEEN o_custkey*40 AND o_custkey*40+cast(floor(o_totalprice/2000) AS bigint)")
_simple("mate_pair_join", lambda s, d: J.mate_pairs(raw_calls(s, d).select(F.col("frag").alias("read"), (F.col("line") % 2).alias("mate"), F.col("snp").alias("pos"))),
    f"""WITH {RAW()}, g AS (SELECT frag AS read, min(snp) FILTER (WHERE line%2=0) "first", min(snp) FILTER (WHERE line%2=1) "second" FROM raw GROUP BY frag) SELECT read, "first", "second", abs("second"-"first") isize FROM g WHERE "first" IS NOT NULL AND "second" IS NOT NULL""")


def _mates(spark, d: str) -> DataFrame:
    c = calls(spark, d).groupBy("frag").agg(F.min(F.struct("snp", "allele", "qv")).alias("x"), F.max(F.struct("snp", "allele", "qv")).alias("y"), F.count("*").alias("n")).where("n >= 2")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("frag"), F.floor("o_totalprice").cast("long").alias("isize"))
    return c.join(o, "frag").select("isize", F.col("x.snp").alias("s1"), F.col("x.allele").alias("a1"), F.col("x.qv").alias("q1"), F.col("y.snp").alias("s2"), F.col("y.allele").alias("a2"), F.col("y.qv").alias("q2"))


_Q1, _Q2 = "pow(10.0,-q1/10.0)", "pow(10.0,-q2/10.0)"
BINS = CALLS + f""", mm AS (SELECT floor(o_totalprice) isize, min(snp) s1, arg_min(allele,snp) a1, arg_min(qv,snp) q1, max(snp) s2, arg_max(allele,snp) a2, arg_max(qv,snp) q2 FROM calls JOIN orders ON o_orderkey=frag GROUP BY frag, o_totalprice HAVING count(*)>=2),
bins AS (SELECT cast(floor(isize/5000) AS bigint) bin, round(sum(CASE WHEN (a1=a2)=({HAP.format('s1')}={HAP.format('s2')}) THEN (1-{_Q1})*{_Q2}+(1-{_Q2})*{_Q1} ELSE (1-{_Q1})*(1-{_Q2})+{_Q1}*{_Q2} END),6) crossings, count(*) n FROM mm GROUP BY 1)"""
_simple("htrans_bins", lambda s, d: J.crossing_bins(_mates(s, d), hap, 5000), BINS + " SELECT * FROM bins")
_simple("htrans_adaptive", lambda s, d: J.pooled_bins(J.crossing_bins(_mates(s, d), hap, 5000)), BINS + """, g AS (SELECT unnest(range(0, (SELECT max(bin)+1 FROM bins))) bin), k AS (SELECT unnest(range(0, 801)) k),
t AS (SELECT g.bin, k.k, coalesce(sum(n),0) n, coalesce(sum(crossings),0) c FROM g JOIN k ON k.k<=(SELECT max(bin) FROM bins) LEFT JOIN bins b ON b.bin BETWEEN g.bin-k.k AND g.bin+k.k GROUP BY ALL),
m AS (SELECT bin, coalesce(min(k) FILTER (WHERE n>=500 OR (k>=1 AND 2*k+1>=800)), max(k)) k FROM t GROUP BY bin) SELECT m.bin, cast(m.k AS bigint) k, round(c/nullif(n,0),6) rate FROM m JOIN t ON t.bin=m.bin AND t.k=m.k""")
_simple("switch_transitions", lambda s, d: E.transitions(voted(s, d)), MATCH + " SELECT block, count(*) n, count(*) FILTER (WHERE p<>match) changes FROM (SELECT *, lag(match) OVER (PARTITION BY block ORDER BY snp) p FROM rows_) GROUP BY block")
_simple("flat_error", lambda s, d: E.flat_errors(voted(s, d)), MATCH + " SELECT block, count(*) n, least(count(*) FILTER (WHERE match=0), count(*) FILTER (WHERE match=1)) flat FROM rows_ GROUP BY block")
W4 = MATCH + """, o AS (SELECT block, match v, row_number() OVER (PARTITION BY block ORDER BY snp) i, count(*) OVER (PARTITION BY block) n FROM rows_),
al AS (SELECT block, i, v, lag(v) OVER (PARTITION BY block ORDER BY i) p FROM o), ru AS (SELECT block, coalesce(min(i) FILTER (WHERE i>1 AND v=p), max(i)+1) - 2 r FROM al GROUP BY block),
st AS (SELECT o.block, o.i, o.n, 1-o.v AS sw_on, ru.r%2=1 AS last, 0 sw, 0 mm FROM o JOIN ru ON ru.block=o.block WHERE o.i=1
 UNION ALL SELECT o.block, o.i, o.n, CASE WHEN o.v=st.sw_on THEN 1-st.sw_on ELSE st.sw_on END, o.v=st.sw_on AND NOT st.last,
 CASE WHEN o.v=st.sw_on AND st.last THEN greatest(0,st.sw-1) WHEN o.v=st.sw_on THEN st.sw+1 ELSE st.sw END, CASE WHEN o.v=st.sw_on AND st.last THEN st.mm+1 ELSE st.mm END FROM st JOIN o ON o.block=st.block AND o.i=st.i+1),
fin AS (SELECT block, cast(n AS int) n, cast(CASE WHEN last THEN greatest(0,sw-1) ELSE sw END AS int) switches, cast(CASE WHEN last THEN mm+1 ELSE mm END AS int) mismatches FROM st WHERE i=n),
be AS (SELECT fin.*, cast(flat AS int) flat FROM fin JOIN (SELECT block, least(sum(match), count(*)-sum(match)) flat FROM rows_ GROUP BY block) USING (block))"""
_simple("block_errors", lambda s, d: E.block_errors(voted(s, d)), W4 + " SELECT * FROM be")
_simple("error_rates", lambda s, d: E.error_rates(voted(s, d)), W4 + """ SELECT cast(sum(switches) AS bigint) switches, cast(sum(mismatches) AS bigint) mismatches, cast(sum(flat) AS bigint) flat, round(sum(switches)/sum(CASE WHEN n>=4 THEN n-3 ELSE 0 END),6) switch_rate,
round(sum(mismatches)/sum(CASE WHEN n>=2 THEN n ELSE 0 END),6) mismatch_rate, round(sum(flat)/sum(CASE WHEN n>=2 THEN n ELSE 0 END),6) flat_rate FROM be""")


def _spans(spark, d: str) -> DataFrame:
    c = calls(spark, d)
    return c.groupBy(F.floor(F.col("snp") / 12).cast("long").alias("comp")).agg(F.min("snp").alias("first_ix"), F.max("snp").alias("last_ix"), F.countDistinct("snp").alias("phased"), (F.max("snp") * 100 + F.max("qv") - F.min("snp") * 100 - F.min("qv")).cast("long").alias("span"))


SPANS = CALLS + ", b AS (SELECT cast(floor(snp/12.0) AS bigint) comp, min(snp) first_ix, max(snp) last_ix, count(DISTINCT snp) phased, cast(max(snp)*100+max(qv)-min(snp)*100-min(qv) AS bigint) span FROM calls GROUP BY 1)"
_simple("n50", lambda s, d: E.n50(_spans(s, d)), SPANS + ", v AS (SELECT span, sum(span) w FROM b GROUP BY span) SELECT max(span) n50 FROM (SELECT span, sum(w) OVER (ORDER BY span DESC) run FROM v) WHERE run > (SELECT sum(span) FROM b)/2")
_simple("an50", lambda s, d: E.an50(_spans(s, d), calls(s, d).agg(F.countDistinct("snp").alias("total"))), SPANS + ", a AS (SELECT round(span*phased/(last_ix-first_ix+1),6) adj, phased FROM b), v AS (SELECT adj, sum(phased) w FROM a GROUP BY adj) SELECT coalesce(max(adj),0.0) an50 FROM (SELECT adj, sum(w) OVER (ORDER BY adj DESC) run FROM v) WHERE run > (SELECT count(DISTINCT snp) FROM calls)/2")
_simple("median_span", lambda s, d: E.median_span(_spans(s, d)), SPANS + " SELECT median(span) median_span FROM b")
_simple("largest_blocks_fraction", lambda s, d: E.largest_fraction(_spans(s, d)), SPANS + " SELECT cast(row_number() OVER o AS int) x, round(sum(phased) OVER (ORDER BY phased DESC, comp ROWS UNBOUNDED PRECEDING)/(SELECT sum(phased) FROM b),6) fraction FROM b WINDOW o AS (ORDER BY phased DESC, comp) QUALIFY row_number() OVER o<=100")
_simple("mec_per_fragment", lambda s, d: E.mec(calls(s, d), hap), CALLS + f" SELECT frag, cast(least(sum(CASE WHEN allele<>{HAP.format('snp')} THEN 1 ELSE 0 END), sum(CASE WHEN allele={HAP.format('snp')} THEN 1 ELSE 0 END)) AS bigint) mec FROM calls GROUP BY frag")
_simple("mec_per_block", lambda s, d: E.mec(calls(s, d), hap, True), CALLS + f", r AS (SELECT *, snp-row_number() OVER (PARTITION BY frag ORDER BY snp) run FROM calls), x AS (SELECT frag, least(sum(CASE WHEN allele<>{HAP.format('snp')} THEN 1 ELSE 0 END), sum(CASE WHEN allele={HAP.format('snp')} THEN 1 ELSE 0 END)) e FROM r GROUP BY frag, run) SELECT frag, cast(sum(e) AS bigint) mec FROM x GROUP BY frag")
_simple("missing_rate", lambda s, d: calls(s, d).groupBy("snp").agg(F.max("qv").alias("q")).agg(F.round(1 - F.count_if(F.col("q") >= 20) / F.count("*"), 6).alias("missing_rate")), CALLS + " SELECT round(1-count(*) FILTER (WHERE q>=20)/count(*),6) missing_rate FROM (SELECT max(qv) q FROM calls GROUP BY snp)")
_simple("distance_accuracy", lambda s, d: E.distance_accuracy(voted(s, d), 3), MATCH + " SELECT cast(floor((y.snp-x.snp)/3) AS bigint) bin, round(avg(CASE WHEN x.match=y.match THEN 1 ELSE 0 END),6) accuracy, count(*) n FROM rows_ x JOIN rows_ y ON x.block=y.block AND x.snp<y.snp GROUP BY 1")
GENO = CALLS + f", g AS (SELECT snp, round(sum(CASE WHEN allele=0 THEN {OK} ELSE {ER} END),6) gll0, round(cast(-0.3010299956639812 AS double)*count(*),6) gll1, round(sum(CASE WHEN allele=0 THEN {ER} ELSE {OK} END),6) gll2, count(*) FILTER (WHERE allele=0) ac0, count(*) FILTER (WHERE allele=1) ac1 FROM calls GROUP BY snp)"
_simple("genotype_likelihoods", lambda s, d: L.genotype_likelihoods(calls(s, d)), GENO + " SELECT * FROM g")
_L012 = LSE.format(LSE.format("s0", "s1"), "s2")
_simple("best_genotype", lambda s, d: L.best_genotype(calls(s, d)), GENO + f", s AS (SELECT snp, gll0+log10(0.9985) s0, gll1+log10(0.001) s1, gll2+log10(0.0005) s2 FROM g) SELECT snp, CASE WHEN s0=greatest(s0,s1,s2) THEN '0/0' WHEN s1=greatest(s0,s1,s2) THEN '0/1' ELSE '1/1' END genotype, round(greatest(s0,s1,s2)-{_L012},4)+cast(0 AS double) posterior FROM s")
_simple("union_technologies", lambda s, d: C.consensus(raw_calls(s, d).where("flag = 'A'").unionByName(raw_calls(s, d).where("flag = 'N'"))), f"WITH {RAW()} SELECT frag, snp, min(allele) allele, max(qv) qv FROM raw WHERE flag IN ('A','N') GROUP BY frag, snp HAVING count(DISTINCT allele)=1")
_simple("common_phased", lambda s, d: raw_calls(s, d).where("flag = 'A'").select("snp").intersect(raw_calls(s, d).where("flag = 'R'").select("snp")), f"WITH {RAW()} SELECT snp FROM raw WHERE flag='A' INTERSECT SELECT snp FROM raw WHERE flag='R'")
_simple("mean_miscall_rate", lambda s, d: calls(s, d).agg(F.round(F.avg(F.pow(F.lit(10.0), -F.col("qv") / 10)), 6).alias("rate")), CALLS + " SELECT round(avg(pow(10.0,-qv/10.0)),6) rate FROM calls")

from . import catalog_files  # noqa: E402, F401  registers the queries on reads, files, links and evaluation
