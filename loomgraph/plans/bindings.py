"""The relations of the library bound to the driver's tables, as frames and as SQL.

The prerequisite graph is made of the parts: p needs p div 2, p div 4 and
(size * 7919) mod p, always smaller keys, so it is acyclic. Parts of size over 40 are
algorithms, up to 10 assumed, the others concepts. Line items are endpoints: a supplier
publishes the part of a returned item as a topic and subscribes to the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read


def requires(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p"), F.col("p_size").cast("long").alias("s"))
    a = p.where("p >= 2").selectExpr("p as src", "p div 2 as dst")
    b = p.where("p >= 4").selectExpr("p as src", "p div 4 as dst")
    c = p.where("p >= 2").selectExpr("p as src", "(s * 7919) % p as dst")
    return a.unionByName(b).unionByName(c).distinct()


def nodes(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") > 40, "algorithm").otherwise("concept")
    tier = F.when(F.col("p_size") <= 10, "assumed").otherwise("statement")
    return p.select(F.col("p_partkey").cast("long").alias("id"), kind.alias("type"), tier.alias("tier"), F.col("p_name").alias("name"))


def endpoints(spark, sf_dir, where: str = "true") -> DataFrame:
    return read(spark, sf_dir, "lineitem").where(where).select(
        F.col("l_suppkey").cast("long").alias("component"),
        F.col("l_partkey").cast("long").alias("topic"),
        F.when(F.col("l_returnflag") == "R", "publishes").otherwise("subscribes").alias("role"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence"),
        (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("ord"),
    )


REQ = """req AS (SELECT DISTINCT src, dst FROM (
  SELECT p_partkey::BIGINT AS src, (p_partkey // 2)::BIGINT AS dst FROM part WHERE p_partkey >= 2
  UNION ALL SELECT p_partkey::BIGINT, (p_partkey // 4)::BIGINT FROM part WHERE p_partkey >= 4
  UNION ALL SELECT p_partkey::BIGINT, ((p_size::BIGINT * 7919) % p_partkey)::BIGINT FROM part WHERE p_partkey >= 2))"""
NODES = """nodes AS (SELECT p_partkey::BIGINT AS id, CASE WHEN p_size > 40 THEN 'algorithm' ELSE 'concept' END AS type,
  CASE WHEN p_size <= 10 THEN 'assumed' ELSE 'statement' END AS tier, p_name AS name FROM part)"""
ENDS = """ends AS (SELECT l_suppkey::BIGINT AS component, l_partkey::BIGINT AS topic,
  CASE WHEN l_returnflag = 'R' THEN 'publishes' ELSE 'subscribes' END AS role,
  l_orderkey || ':' || l_linenumber AS evidence, l_orderkey::BIGINT * 10 + l_linenumber AS ord FROM lineitem)"""
