"""URL filtering by host and path rules (DataFrame functions only).

Every distinct (host, path) is expanded into expressions: each suffix of the host at a
label boundary, combined with each prefix of the path of a length that some rule has.
The set of rule path lengths is what makes the expansion exact for any rule path. An
expression is looked up by the first four bytes of its SHA-256 in an equi-join with the
rules; equality of the full digests confirms a hit, and the longest rule wins.

Defined cases: a null URL or one without ``://`` has empty host and path; an empty path
starts with no rule path but the empty one; URLs no rule fits get the default verdict and
a null rule; of rules of equal length the one that sorts first wins, and of one rule
given twice with both verdicts, block. Repeated rows each get their verdict. Columns host,
path, rule and verdict of the input are replaced, no others are touched.

Only (host, path) pairs that some rule fits have a verdict of their own. They are
broadcast back to the pages if a count allows it; else the pairs that many pages share are
broadcast (their number is bounded by their share) and the others joined by a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch, unused

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: Rule tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Up to so many fitting (host, path) pairs are broadcast to the pages.
BROADCAST_PAIRS = 500_000
#: Share of all pages above which a (host, path) pair is broadcast in any case.
HOT_SHARE = 0.0005

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url):
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; clashing columns are replaced."""
    prepared = (
        rules.select("rule_host", "rule_path", "rule_verdict")
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("full", 1, 8))
        .withColumn("rule_text", F.concat("rule_host", "rule_path"))
    )
    lengths = [r[0] for r in rules.select(F.length("rule_path")).dropna().distinct().collect()]
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        prepared = F.broadcast(prepared)
    pages = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]))
    expanded = (
        pages.groupBy("host", "path")
        .agg(F.count(F.lit(1)).alias("pages"))
        .select("host", "path", "pages", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "pages", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("own", _digest(F.col("suffix"), F.col("prefix")))
    )
    hits = expanded.join(prepared, F.substring("own", 1, 8) == F.col("short")).where("own = full")
    best = hits.groupBy("host", "path", "pages").agg(
        F.min(F.struct((-F.length("rule_text")).alias("n"), F.col("rule_text"), F.col("rule_verdict"))).alias("best")
    )
    best = Scratch(pages.sparkSession, "urls").save(best, "best")
    h, p, n, top = unused(pages, "h", "p", "n", "top")
    best = best.select(F.col("host").alias(h), F.col("path").alias(p), F.col("pages").alias(n), F.col("best").alias(top))
    same = (F.col("host") == F.col(h)) & (F.col("path") == F.col(p))
    if best.count() <= BROADCAST_PAIRS:
        joined = pages.join(F.broadcast(best), same, "left")
    else:
        often = pages.groupBy("host", "path").count().where(F.col("count") > max(1000, int(pages.count() * HOT_SHARE)))
        often = often.select(F.col("host").alias(h), F.col("path").alias(p))
        often = often.join(best, [h, p], "left")  # at most 1 / HOT_SHARE pairs, also those that no rule fits
        hot = pages.join(F.broadcast(often), same)
        joined = hot.unionByName(pages.join(F.broadcast(often), same, "left_anti").join(best, same, "left"))
    return (
        joined.withColumn("rule", F.col(f"{top}.rule_text"))
        .withColumn("verdict", F.coalesce(f"{top}.rule_verdict", F.lit(default)))
        .drop(h, p, n, top)
    )


def op3_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rule_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.*, h || q AS rule, v,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
