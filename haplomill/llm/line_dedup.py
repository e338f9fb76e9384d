"""Line deduplication by site-relative frequency.

For each host, the pages that contain a line are counted (once per page) and divided by the host's pages; lines
above the boilerplate ratio are dropped from all its pages. Only 128-bit hashes of lines are shuffled, combined
before the shuffle, so a line or host that holds a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, table

RATIO, LEAST_PAGES = 0.1, 5
#: Up to so many boilerplate lines in all, and in a host, go to every task; beyond that they are joined by hash.
BROADCAST_LINES, HOST_LINES = 100_000, 2_000


def _hashes(lines: Column) -> Column:
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(_host, h): hashes of the lines on more than ratio of their host's pages and on at least least_pages."""
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.array_distinct(_hashes(F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("_h"))
    # one pass: the host's page total is counted as one more "line" of each page
    marked = pages.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), "_h")).alias("h"))
    counts = marked.groupBy("_host", "h").agg(F.count("*").alias("n"))
    totals = counts.where(F.col("h").isNull()).select("_host", F.col("n").alias("total"))
    often = counts.where(F.col("h").isNotNull() & (F.col("n") >= least_pages))
    return often.join(totals, "_host").where(F.col("n") > F.col("total") * ratio).select("_host", "h")


def drop_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the boilerplate lines out of text, and with n_lines and n_dropped.

    Lines are the stretches between line feeds, compared whole; empty lines are never counted nor dropped. A null
    text stays null (0 lines), a null host is the host ''; a page left without lines keeps an empty text; texts of any
    length are split whole; repeated rows each count as a page; other columns pass through unchanged, whatever their
    names, but own columns n_lines and n_dropped are replaced; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _cleaned(docs, keep, host, ratio, least_pages, broadcast_lines).select("row.*", "n_lines", "n_dropped")


def cleaned(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the boilerplate lines out of text and all other columns unchanged; else as drop_lines."""
    return _cleaned(docs, docs.columns, host, ratio, least_pages, broadcast_lines).select("row.*")


def _cleaned(docs: DataFrame, keep: list[str], host: str, ratio: float, least_pages: int, broadcast_lines: int) -> DataFrame:
    """(row struct of the columns keep, n_lines, n_dropped); in a struct, no name can clash with those used here."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    host = "host"
    found = cut(boilerplate(docs, host, ratio, least_pages), "boilerplate")
    size = found.groupBy("_host").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    own = F.coalesce(F.col(host), F.lit(""))
    lines = F.split("text", "\n", -1)
    if (size.n or 0) <= broadcast_lines and (size.most or 0) <= HOST_LINES:
        listed = F.broadcast(found.groupBy("_host").agg(F.collect_set("h").alias("_bad")))
        joined = docs.withColumn("_own", own).join(listed, F.col("_own") == F.col("_host"), "left")
    else:
        # what a page holds of its host's boilerplate, joined by hash and gathered per distinct page
        key = [own.alias("_own"), F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit("page"), F.col("text")).alias("_k2")]
        asked = docs.where(F.col("text").isNotNull()).select(*key, F.explode(F.array_distinct(_hashes(lines))).alias("h")).distinct()
        listed = found.select("_host", F.col("h").alias("_line"))
        held = asked.join(listed, (F.col("_own") == F.col("_host")) & (F.col("h") == F.col("_line"))).groupBy("_own", "_k1", "_k2").agg(F.collect_set("_line").alias("_bad"))
        joined = docs.select("*", *key).join(held.withColumnsRenamed({"_own": "_o", "_k1": "_j1", "_k2": "_j2"}), (F.col("_own") == F.col("_o")) & (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")), "left")
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains(F.col("_bad"), _hash(x)))
    some = joined.withColumn("_kept", F.when(F.col("_bad").isNull(), lines).otherwise(kept))
    text = F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    return some.select(F.col("row").withField("text", text).alias("row"), n.alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("_kept")).alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs)


SQL = """
WITH l AS (SELECT k, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT row_number() OVER () AS k, * FROM documents) WHERE text IS NOT NULL),
c AS (SELECT host, line, count(DISTINCT k) AS n FROM l WHERE line <> '' GROUP BY host, line),
t AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT host, line FROM c JOIN t USING (host) WHERE n >= 5 AND n > total * cast(0.1 AS double)),
g AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE b.line IS NOT NULL) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept
  FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line GROUP BY k)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN kept END AS text, cast(coalesce(n_lines, 0) AS int) AS n_lines, cast(coalesce(n_dropped, 0) AS int) AS n_dropped
FROM (SELECT row_number() OVER () AS k, * FROM documents) d LEFT JOIN g USING (k)
"""
