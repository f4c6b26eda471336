"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Vectors are compared only within one label (and one dimension). Per label, spherical
k-means is fitted on a bounded sample and assigns every vector to the cell of its nearest
centroid. Two vectors with cosine >= t are at most ``d = sqrt(2 - 2t)`` apart, so a vector x
of cell a can have a partner in cell c only if ``(c - a) . x >= -|c - a| d``; x is then also
a guest of c (of the later of the two cells, so a pair meets once). Cells are cut into
blocks of about ``BLOCK`` vectors, and each pair of blocks is one matrix product in double
precision. A product returns counts of links per vector and a spanning forest of its
links, never the links themselves. No pair is lost, whatever the centroids are; they only
decide how many products are needed.

Equal vectors of a label are compared once and counted with their multiplicity. One row
of each component, the one with the smallest vec_id, is kept.

Defined cases: a null label, or a vector that is null, empty, zero or holds a null or
non-finite component: no links, component of its own, kept; rows that share a vec_id are
different vectors; a null vec_id is never the smallest; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch
from ..operators.components import connected_components

#: Vectors per cell and per block of a product, about; sample of the fit per centroid.
CELL, BLOCK, SAMPLE = 4096, 1024, 64
MAX_CELLS = 512
#: Numbers in the sample of one label at most.
SAMPLE_NUMBERS = 4_000_000


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors; starts from vectors evenly spread over the rows."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-12] = sums[size > 1e-12] / size[size > 1e-12, None]
    return centres


def guests(x: np.ndarray, centres: np.ndarray, threshold: float):
    """(own cell, rows of guests, their cells): every cell after the own one that may hold a partner."""
    dots = x @ centres.T
    own = dots.argmax(axis=1)
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    reach = np.sqrt(2 - 2 * threshold)
    may = dots - dots[np.arange(len(x)), own][:, None] >= -gaps[own] * reach - 1e-9
    may &= np.arange(len(centres))[None, :] > own[:, None]
    return own, *np.nonzero(may)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    e = F.col("embedding")
    sound = (
        F.col("label").isNotNull()
        & e.isNotNull()
        & (F.size(e) > 0)
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(e, lambda v: v != 0)
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    nodes = rows.where("sound").groupBy("label", "embedding").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "*"), "nodes")
    sizes = scratch.save(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")), "sizes")
    cells = F.least(F.ceil(F.col("size") / CELL), F.lit(MAX_CELLS))
    sizes = sizes.select("label", "dim", "size", cells.alias("cells"), F.ceil(F.col("size") / 8192).alias("salts"))
    placed = nodes.select("node", "label", "dim", "embedding").join(sizes, ["label", "dim"])
    wanted = F.least(F.col("cells") * SAMPLE, F.floor(F.lit(SAMPLE_NUMBERS) / F.col("dim")))
    sample = placed.where(F.pmod(F.xxhash64("embedding"), F.col("size")) < wanted)

    def fit(key, part):
        part = part.sort_values("node")
        centres = spherical_kmeans(unit(part["embedding"]), int(part["cells"].iloc[0]))
        return pd.DataFrame({"label": key[0], "dim": key[1], "cell": range(len(centres)), "centre": list(centres)})

    kind = nodes.schema["label"].dataType.simpleString()
    centres = scratch.save(sample.groupBy("label", "dim").applyInPandas(fit, f"label {kind}, dim int, cell int, centre array<double>"), "centres")
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    spread = centres.join(sizes, ["label", "dim"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    spread = scratch.save(spread.select("label", "dim", "salt", "cell", "centre"), "spread")

    def assign(left, right):
        if not len(left):
            return pd.DataFrame({"node": [], "cell": [], "guest": []})
        if not len(right):  # the sample missed this label: one cell
            return pd.DataFrame({"node": left["node"], "cell": 0, "guest": False})
        own, who, where = guests(unit(left["embedding"]), np.stack(right.sort_values("cell")["centre"]), threshold)
        node = left["node"].to_numpy()
        return pd.DataFrame({"node": np.concatenate([node, node[who]]), "cell": np.concatenate([own, where]), "guest": np.arange(len(own) + len(who)) >= len(own)})

    assigned = scratch.save(
        salted.groupBy("label", "dim", "salt").cogroup(spread.groupBy("label", "dim", "salt")).applyInPandas(assign, "node long, cell int, guest boolean"), "assigned"
    )
    members = assigned.join(nodes, "node")
    fill = members.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocked = members.join(fill, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    tasks = blocked.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = tasks.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def product(key, part):
        x, node = unit(part["embedding"]), part["node"].to_numpy()
        guest, copies = part["guest"].to_numpy(), part["copies"].to_numpy()
        i, j = key[3], key[4]
        left = np.flatnonzero(part["block"].to_numpy() == i)
        right = left if i == j else np.flatnonzero(part["block"].to_numpy() == j)
        close = x[left] @ x[right].T >= threshold
        close &= ~(guest[left][:, None] & guest[right][None, :])
        if i == j:
            np.fill_diagonal(close, False)
        links = np.zeros(len(x), np.int64)
        links[left] += close @ copies[right]
        if i != j:
            links[right] += copies[left] @ close
        pairs = forest(node, left, right, close)
        some = links > 0
        return pd.DataFrame(
            {"a": np.concatenate([node[some], pairs[:, 0]]), "b": np.concatenate([np.full(some.sum(), -1), pairs[:, 1]]), "links": np.concatenate([links[some], np.zeros(len(pairs), np.int64)])}
        )

    columns = ["label", "dim", "cell", "i", "j"]
    found = scratch.save(
        tasks.select(*columns, "block", "node", "guest", "copies", "embedding").groupBy(*columns).applyInPandas(product, "a long, b long, links long"), "found"
    )
    groups = connected_components(found.where("b >= 0").select("a", "b"), scratch).toDF("node", "component")
    named = groups.join(nodes.select("node", "first"), "node")
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    counts = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = (
        nodes.join(counts, "node", "left")
        .join(groups.join(names, "component"), "node", "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("name", "first").alias("component"))
    )
    good = rows.where("sound").join(known, ["label", "embedding"]).select("id", "links", "component")
    bad = rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    return good.unionByName(bad).select(
        F.col("id").alias(id_col),
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def forest(node: np.ndarray, left: np.ndarray, right: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Pairs of nodes that connect what ``close`` (left x right) connects, no more than needed."""
    root = list(range(len(node)))

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for a, row in zip(left.tolist(), close):
        for b in right[row].tolist():
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((node[a], node[b]))
    return np.array(out, np.int64).reshape(-1, 2)


def op2_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id,
       (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links,
       c.m AS component_id,
       e.vec_id = c.m AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = e.vec_id
"""
