"""Connected components of an edge relation, by labels that only ever fall.

Each round gives every vertex the least label among its own and its neighbours', then
lets each vertex take its label's label (pointer jumping), so labels spread along paths in
a number of rounds about logarithmic in their length. Labels are written to the shared
folder every round, which cuts the lineage. Labels of vertices with very many edges, and of
labels that very many vertices have, are broadcast (at most ``1 / HOT_SHARE`` of either), so
no task gets a hub's edges or a large component whole. An empty edge relation has no vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch, hot_keys, split_join, width_for

MAX_ROUNDS = 200


def connected_components(edges: DataFrame, scratch: Scratch | None = None, name: str = "cc") -> DataFrame:
    """``edges`` (a long, b long) in one direction or both -> (id, component), the least id.

    Vertices are those with an edge; self-loops count. Nulls are ignored.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = edges.select("a", "b").dropna()
    both = scratch.save(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    n = both.count()
    width = width_for(n)
    hubs = hot_keys(both, "b", n)
    labels = scratch.save(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), f"{name}-0", width
    )
    for k in range(1, MAX_ROUNDS):
        near = split_join(both, labels.toDF("b", "l"), "b", hubs).groupBy("a").agg(F.min("l").alias("m")).toDF("id", "m")
        spread = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.toDF("label", "next")  # every label is a vertex, so no row is lost
        common = hot_keys(labels, "label", n)
        moved = split_join(spread, jump, "label", common).select("id", "was", F.least("label", "next").alias("label"))
        moved = scratch.save(moved, f"{name}-{k}", width)
        done = moved.where("was <> label").isEmpty()
        labels = moved.select("id", "label")
        scratch.drop(f"{name}-{k - 1}")
        if done:
            scratch.drop(f"{name}-edges")
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
