"""Writers: exports, keyed overwrites, accumulating flags and resumable work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import KeyedTable

#: Order of tiers in exports; it differs from the order in which they are documented.
TIER_RANK = {"assumed": 0, "statement": 1, "derivation": 2, "claim": 3}
STATE_RANK = {"": 0, "declared": 1, "read": 2, "demonstrated": 3}


def rank(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def export_nodes(nodes: DataFrame, depth: DataFrame, reuse: DataFrame, cost: DataFrame, profile: DataFrame, notes: DataFrame, project: str) -> DataFrame:
    """The denormalised node relation: a star of left joins with defaults.

    nodes (id, name, type, tier), depth (id, depth), reuse (id, n), cost (id, cost), profile
    (id, state), notes (id, project, why); a note of another project is left blank. Each part may
    have a row for every node, so none is broadcast, however small its files are.
    """
    j = nodes
    for part in (depth, reuse.withColumnRenamed("n", "reuse"), cost, profile, notes):
        j = j.join(part.hint("merge"), "id", "left")
    return j.select(
        "id", "name", "type", "tier", rank(F.col("tier"), TIER_RANK).alias("tier_rank"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("reuse", F.lit(0)).alias("reuse"), F.coalesce("cost", F.lit(0)).alias("cost"),
        F.coalesce("state", F.lit("")).alias("state"), rank(F.coalesce("state", F.lit("")), STATE_RANK).alias("state_rank"), F.when(F.col("project") == project, F.col("why")).alias("why"),
    )


def export_edges(edges: DataFrame, why: DataFrame) -> DataFrame:
    """edges (src, dst, rel) with their rationale (src, dst, why), empty where there is none."""
    return edges.join(why.select("src", "dst", "why"), ["src", "dst"], "left").withColumn("why", F.coalesce("why", F.lit("")))


def strip_private(rows: DataFrame, field: str, project: str, allowed: list[str]) -> DataFrame:
    """Blanks a field of rows that belong to a project which is not in the allow-list."""
    own = F.coalesce(F.col(project), F.lit(""))
    return rows.withColumn(field, F.when((own == "") | own.isin(*allowed), F.col(field)))


def library_gate(excerpts: DataFrame, dependencies: DataFrame, components: DataFrame) -> DataFrame:
    """excerpts (library, ...) of libraries that the project depends on (name) or a component uses (library)."""
    used = dependencies.select(F.col("name").alias("library")).unionByName(components.select("library")).where("library <> ''").distinct()
    return excerpts.join(used, "library", "left_semi")


def cited_documents(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """documents (document, ...) that a node (id, sources) cites."""
    return documents.join(nodes.select(F.explode("sources").alias("document")).distinct(), "document", "left_semi")


def export_summary(nodes: DataFrame, edges: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """One row beside the exported tables: root, max_depth, max_level, and how many nodes, edges and documents there are.

    ``max_level`` is one below the deepest level that the root reaches, where unreached nodes are drawn.
    """
    n = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.coalesce(F.max("level"), F.lit(1)).alias("max_level"), F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    d = documents.agg(F.count(F.lit(1)).alias("documents"))
    one = [x.withColumn("_k", F.lit(1)) for x in (n, e, d)]  # a row each
    return one[0].join(one[1], "_k").join(one[2], "_k").select(F.lit(root).alias("root"), "max_depth", "max_level", "nodes", "edges", "documents")


def write_json(frame: DataFrame, path: str) -> None:
    frame.select(F.to_json(F.struct(*frame.columns)).alias("value")).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """The one writer of the curated edges: overwritten whole, sorted by cluster, source and target.

    Files hold successive ranges of that order, each written by a task of its own.
    """
    order = ["cluster", "src", "dst"]
    edges.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def append_flags(old: DataFrame, new: DataFrame, round_: int) -> DataFrame:
    """Flags of earlier rounds and those of this one, which replace its own former ones."""
    return old.where(F.col("round") < round_).unionByName(new.withColumn("round", F.lit(round_)))


def upsert(frame: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Keyed overwrite: the rows of every key that ``frame`` has are replaced by its own, others untouched."""
    KeyedTable(frame.sparkSession, path, key, buckets).merge(frame)


def resume(todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], buckets: int = 64) -> int:
    """Does what is not in the keyed table at ``path`` yet and adds it, whole or not at all; returns how many keys it did."""
    return KeyedTable(todo.sparkSession, path, key, buckets).resume(todo, work)


def library_slice(sources: DataFrame, pins: DataFrame) -> DataFrame:
    """Pinned line ranges (path, first, last) of sources (path, text) with their licence notice; a bad range or no notice raises."""
    from ..functions.text import header_notice

    j = pins.join(sources, "path").withColumn("lines", F.split("text", "\n")).withColumn("notice", header_notice(F.col("text")))
    bad = F.when((F.col("first") < 1) | (F.col("last") > F.size("lines")) | (F.col("first") > F.col("last")), "bad range").when(F.col("notice").isNull(), "no licence notice")
    checked = j.withColumn("lines", F.when(bad.isNull(), F.col("lines")).otherwise(F.raise_error(F.concat(bad, F.lit(" in "), F.col("path")))))
    return checked.select("path", "first", "last", "notice", F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n").alias("excerpt"))


def holders(sources: DataFrame) -> DataFrame:
    """(line, ord): distinct copyright lines in order of appearance; sources (ord, text)."""
    lines = sources.select("ord", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    line = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[ */#]+", ""), r"\s+", " "))
    return lines.withColumn("line", line).where(F.col("line").startswith("Copyright")).groupBy("line").agg(F.min(F.struct("ord", "p")).alias("o")).select("line", "o.ord")
