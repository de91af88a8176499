"""URL filters: host-suffix and path-prefix expressions joined with a rule table on short hash prefixes.

Each distinct URL is expanded into every host suffix (up to the longest rule host) combined with every path prefix of a
length that some rule has, so a rule fits exactly if one expression equals it.  Expressions meet rules in an equi-join on
the first 32 bits of their SHA-256; full digests confirm; of the rules that fit, the longest (host and path together,
then host) wins.

Defined results: a null url or one without ``://`` has empty host and path, no rule and the default verdict; URLs of any
length are expanded whole; repeated rows get the same verdict; an empty table gives an empty result; extra columns pass
through unless they are named host, path, rule or verdict, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"
SHORT = 8  # hex digits
#: Rule tables of up to so many rows (under 200 bytes each) are broadcast.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; nothing for a null url or one without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every host suffix of at most ``labels`` labels with every path prefix of one of ``lengths`` characters."""
    suffixes = let(
        F.split(host, "\\."),
        lambda p: F.transform(
            F.sequence(F.greatest(F.size(p) - labels + 1, F.lit(1)), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")
        ),
    )
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """host, path, verdict with the digest of host and path."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "host string, path string, verdict string")
    rule = F.concat("host", "path")
    return df.select("host", "path", "verdict", rule.alias("rule"), F.sha2(rule, 256).alias("digest"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    table = rule_table(pages.sparkSession, rules)
    labels = F.size(F.split("host", "\\."))
    facts = table.agg(F.count("*"), F.max(labels), F.collect_set(F.length("path"))).first()  # path lengths: at most as many as the longest path
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not facts[0]:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = pages.select("host", "path").where("host <> ''").distinct()
    wanted = urls.select("host", "path", F.explode(F.array_distinct(expressions(F.col("host"), F.col("path"), facts[1], sorted(facts[2])))).alias("e"))
    wanted = wanted.select("host", "path", F.sha2("e", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    table = table.select("rule", "verdict", F.length("host").alias("host_length"), F.col("digest").alias("full"), F.substring("digest", 1, SHORT).alias("short"))
    if facts[0] <= BROADCAST_RULES:
        table = F.broadcast(table)
    fits = wanted.join(table, "short").where("digest = full")
    best = F.max(F.struct(F.length("rule"), "host_length", "rule", "verdict")).alias("best")
    found = fits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")
    out = pages.join(found, ["host", "path"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), f AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND f.n = 1
"""
