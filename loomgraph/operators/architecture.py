"""From a project's components to the graph: proposals, their gate, and attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BRIEF_PROBLEMS
from ..functions.text import slug
from . import relate


class NotConfirmed(ValueError):
    """A proposal that nobody has confirmed, or that leaves components unplaced."""


def propose(components: DataFrame, library: DataFrame, domains: DataFrame) -> DataFrame:
    """components (component, plugin, library, executable) -> (component, algorithms, subsystem, unclassified).

    The plugin, ``library/executable`` and the library are looked up in turn in ``library``
    (key, items); a key with an empty list ends the search. The subsystem is that of the
    first algorithm in ``domains`` (algorithm, subsystem), else ``Other``.
    """
    c = components.withColumn("_exact", F.concat_ws("/", "library", "executable"))
    found = relate.priority_lookup(c, ["plugin", "_exact", "library"], library)
    a = found.withColumn("algorithm", F.try_element_at("found", F.lit(1)))
    j = a.join(domains.select("algorithm", F.col("subsystem").alias("_sub")), "algorithm", "left")
    none = F.coalesce(F.size("found"), F.lit(0)) <= 0
    return j.select("component", F.col("found").alias("algorithms"), F.when(~none, F.coalesce("_sub", F.lit("Other"))).alias("subsystem"), none.alias("unclassified"))


def propose_from_brief(brief: DataFrame) -> DataFrame:
    """brief (component, subsystem, algorithms) -> the same columns as ``propose``, as stated."""
    return brief.select("component", "algorithms", "subsystem", (F.coalesce(F.size("algorithms"), F.lit(0)) <= 0).alias("unclassified"))


def gate(proposal: DataFrame, confirmed: bool) -> DataFrame:
    """The proposal itself, unless it is unconfirmed, has no subsystem or leaves components unclassified."""
    if not confirmed:
        raise NotConfirmed("the proposal is not confirmed")
    lost = [r[0] for r in proposal.where("unclassified").select("component").orderBy("component").limit(20).collect()]
    if lost:
        raise NotConfirmed("unclassified: " + ", ".join(lost))
    if proposal.where("subsystem is not null").isEmpty():
        raise NotConfirmed("no subsystems")
    return proposal


def attach(proposal: DataFrame, nodes: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project: system contains subsystems contain components use algorithms.

    Ids are ``sys``, ``sys__slug``; an algorithm that ``nodes`` (id, type) lacks raises.
    """
    uses = proposal.select("component", "subsystem", F.explode("algorithms").alias("algorithm"))
    missing = uses.join(nodes.select(F.col("id").alias("algorithm")), "algorithm", "left_anti").select("algorithm").distinct().limit(20).collect()
    if missing:
        raise ValueError("unknown algorithms: " + ", ".join(sorted(r[0] for r in missing)))
    top = F.lit(project)
    sub = F.concat(top, F.lit("__"), slug(F.col("subsystem")))
    com = F.concat(top, F.lit("__"), slug(F.col("component")))
    s = proposal.select("subsystem").distinct()
    system = s.select(top.alias("id"), F.lit("system").alias("type"), top.alias("name")).distinct()
    n = system.unionByName(s.select(sub.alias("id"), F.lit("subsystem").alias("type"), F.col("subsystem").alias("name"))).unionByName(
        proposal.select(com.alias("id"), F.lit("component").alias("type"), F.col("component").alias("name")).distinct()
    )
    e = s.select(top.alias("src"), sub.alias("dst"), F.lit("contains").alias("rel")).unionByName(
        proposal.select(sub.alias("src"), com.alias("dst"), F.lit("contains").alias("rel")).distinct()
    ).unionByName(uses.select(com.alias("src"), F.col("algorithm").alias("dst"), F.lit("uses").alias("rel")).distinct())
    return n, e


def brief_unknown(described: DataFrame, grouped: DataFrame, algorithms: DataFrame, nodes: DataFrame, cited: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(problem, name): what a hand-written brief claims that is not there.

    described (component), grouped (component) by the subsystems, algorithms (algorithm)
    against nodes (id), and, where a repository is at hand, cited (path) against files (path).
    """
    a, b = described.select(F.col("component").alias("name")).distinct(), grouped.select(F.col("component").alias("name")).distinct()
    checks = [b.join(a, "name", "left_anti"), a.join(b, "name", "left_anti"), algorithms.select(F.col("algorithm").alias("name")).distinct().join(nodes.select(F.col("id").alias("name")), "name", "left_anti")]
    if cited is not None:
        checks.append(cited.select(F.col("path").alias("name")).distinct().join(files.select(F.col("path").alias("name")), "name", "left_anti"))
    out = None
    for problem, found in zip(BRIEF_PROBLEMS, checks):
        rows = found.select(F.lit(problem).alias("problem"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def build_scope(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): the given nodes and everything that they require."""
    from .reachability import reachable

    return reachable(edges, ids).unionByName(ids.where("id is null").select("id").distinct())
