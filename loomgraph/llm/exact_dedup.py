"""Exact deduplication with a heavy-hitter split (DataFrame and SQL functions only).

Two texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` is
replaced by one space. The digest of that text is computed once per row and written to a
narrow table (id and 32 bytes). Misra-Gries summaries of the digests
(``approx_top_k_accumulate``, the frequent-items variant with counters that shrink
together) name every digest that holds more than ``support`` of the rows, at most
``1 / support`` candidates: one summary for each task, merged per group of tasks and then
once more. An exact aggregation verifies the candidates and finds their winners. That
table has a fixed row bound, so it is broadcast and the frequent copies never enter a
shuffle. The remaining digests are few each and use an ordinary one.

Defined cases: a null text is the empty text; rows that share id and text count as one
document, all marked alike; a null id never wins against a non-null one; an empty input
gives an empty output; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch, unused

#: Share of all rows above which a digest is taken out of the shuffle.
SUPPORT = 0.002
#: Groups of tasks whose summaries are merged before the last merge.
SUMMARY_GROUPS = 256
#: Up to so many losers with their digests (some 80 bytes each) are broadcast.
BROADCAST_LOST = 1_000_000


def normalised(text):
    """The text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def frequent_hashes(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(h): 64-bit hashes of the digests that may hold more than ``support`` of the rows.

    A summary of m counters is off by 3.5 / m of the rows at most, so every digest above
    the support is among the candidates; there are at most 1 / support of them.
    """
    counters = 1 << max(4, int(8 / support).bit_length())
    hashed = digests.select(F.xxhash64("digest").alias("h"), F.pmod(F.spark_partition_id(), F.lit(SUMMARY_GROUPS)).alias("part"))
    parts = hashed.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(h, {counters})").alias("s"))
    merged = parts.groupBy(F.lit("all").alias("whole")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {int(1 / support)})")).alias("t"))
    return top.select(F.col("t.item").alias("h"))


def _split(docs: DataFrame, id_col: str, text_col: str, support: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heavy, light, winners): rows (id, digest, keep_id, group_size) of frequent and other digests."""
    scratch = Scratch(docs.sparkSession, "exact")
    digests = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    digests = scratch.save(digests, "digests")
    # At most 1 / support rows, whatever the input: broadcast both ways.
    winners = (
        digests.join(F.broadcast(frequent_hashes(digests, support)), F.xxhash64("digest") == F.col("h"))
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.lit(True).alias("hot"))
    )
    winners = scratch.save(winners, "winners")
    marked = digests.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("hot").select("id", "digest", "keep_id", "group_size")
    same = Window.partitionBy("digest")
    light = marked.where("hot is null").select(
        "id", "digest", F.min("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size")
    )
    return heavy, light, winners


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Per row: id, keep_id, group_size, kept and the digest's hexadecimal form."""
    heavy, light, _ = _split(docs, id_col, text_col, support)
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller id has, all columns kept.

    Rows without an id stay: there is no telling which of them a group would keep. Losers of
    frequent digests are told by the broadcast winners. The others' ids and digests are
    broadcast as well if a count allows it, so that texts stay where they are; else the
    texts go through one shuffle.
    """
    _, light, winners = _split(docs, id_col, text_col, support)
    own, keep, hot, lost, gone = unused(docs, "own", "keep", "hot", "lost", "gone")
    losers = light.where("id <> keep_id").select(F.col("id").alias(lost), F.col("digest").alias(gone)).distinct()
    losers = Scratch(docs.sparkSession, "exact").save(losers, "losers")
    if losers.count() <= BROADCAST_LOST:
        losers = F.broadcast(losers)
    first = winners.select(F.col("digest").alias(hot), F.col("keep_id").alias(keep))
    digested = docs.withColumn(own, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    left = digested.join(F.broadcast(first), (F.col(own) == F.col(hot)) & (F.col(id_col) != F.col(keep)), "left_anti")
    return left.join(losers, (F.col(id_col) == F.col(lost)) & (F.col(own) == F.col(gone)), "left_anti").drop(own)


def op6_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
