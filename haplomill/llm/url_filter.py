"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL is expanded only into the (host suffix, path prefix) lengths that occur among the rules, as
Safe-Browsing-like lists do. An expression's SHA-256 digest is cut to 4 bytes, and expressions and rules are joined on
these alone; the full digest is compared on what met, and the longest confirmed rule wins. Of a URL only two hashes
go through the join, combined before the shuffle. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Rules of the registered query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    rows = ", ".join("({})".format(", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(rule_host, rule_path, rule_verdict)")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict.

    Null or scheme-less URLs have an empty host and path; only a rule that is empty throughout fits them. Equal rules
    with different verdicts: block wins. The longest rule wins, among equally long ones the one with the longer host. An
    empty rule path fits every path, an empty rule host every host. URLs of any length are read whole. Repeated rows
    come out as often as they went in; other columns are ignored; without rules, and for URLs that none fits, the
    verdict is the default; an empty table gives an empty result.
    """
    listed = (
        rules.select(F.coalesce(F.translate("rule_host", _UPPER, _LOWER), F.lit("")).alias("rh"), F.coalesce("rule_path", F.lit("")).alias("rp"), F.col("rule_verdict").alias("rv"))
        .groupBy("rh", "rp").agg(F.max(F.coalesce("rv", F.lit("allow"))).alias("rv"))
        .withColumn("digest", _digest(F.col("rh"), F.col("rp")))
        .withColumn("short", F.substring("digest", 1, 8))
        .withColumn("rule", F.concat("rh", "rp"))
    )
    # the lengths that occur are a few small integers; only they are expanded
    shape = listed.agg(
        F.collect_set(F.when(F.col("rh") == "", 0).otherwise(F.size(F.split("rh", r"\.")))).alias("labels"),
        F.collect_set(F.length("rp")).alias("lengths"), F.count("*").alias("n"),
    ).first()
    url = F.coalesce(F.col(url_col), F.lit(""))
    one = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"), F.xxhash64(url).alias("_k1"), F.xxhash64(F.lit("url"), url).alias("_k2"))
    if not shape.n:
        return one.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("_host", r"\.")
    suffixes = F.filter(
        F.transform(F.array(*[F.lit(x) for x in sorted(shape.labels)]), lambda k: F.when(k == 0, F.lit("")).when((F.size(parts) >= k) & (F.col("_host") != ""), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))),
        lambda x: x.isNotNull(),
    )
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in sorted(shape.lengths)]), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    asked = one.select("_k1", "_k2", F.explode(digests).alias("_digest")).withColumn("_short", F.substring("_digest", 1, 8))
    side = F.broadcast(listed) if shape.n <= BROADCAST_RULES else listed
    # short prefixes meet; then the full digest confirms, and the longest confirmed rule of a URL takes precedence
    met = asked.join(side, F.col("_short") == F.col("short")).withColumn("_confirmed", F.col("_digest") == F.col("digest"))
    best = met.groupBy("_k1", "_k2").agg(F.max(F.when(F.col("_confirmed"), F.struct(F.length("rule").alias("len"), F.length("rh").alias("hl"), "rv", "rule"))).alias("_m")).where("_m IS NOT NULL")
    judged = one.join(best, ["_k1", "_k2"], "left")
    return judged.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_m.rule").alias("rule"), F.coalesce(F.col("_m.rv"), F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, RULES))


SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id,
  translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT u.k, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.k ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.k = m.k AND m.n = 1
"""
