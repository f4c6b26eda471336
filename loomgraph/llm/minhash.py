"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

Documents are linked when the Jaccard similarity of their sets of five-word shingles
reaches ``percent`` hundredths. The steps:

1. One pass over the texts computes, per row, the set's size, a 128-bit digest of the whole
   set, four 16-bit MinHash symbols for each of ``chunks_for(percent)`` chunks and ``BITS``
   one-bit MinHashes. Rows with the same set collapse to a node named by the smallest doc_id.
2. Multi-index join. Two signatures that differ in at most ``2 * chunks - 1`` symbols differ
   in at most one symbol of some chunk (pigeonhole); enumerating the one allowed error, by
   leaving out each symbol of a chunk in turn, gives four exact keys per chunk, and every
   such pair meets under a key. Keys that one node has are dropped first.
3. Stars. Under each key one member is the hub, the same for all keys where it can be; a node
   is held against the nearest hubs by signature, at most ``HUBS`` of them, and confirmed
   links make a first round of components. So a group of near copies costs one comparison
   or two for each copy. This round only saves work: what it leaves is found by the next.
4. All other pairs of different components. Nodes that share keys fall into families. Within
   a family signatures are compared in memory, in blocks; a block pair lists its near pairs
   if they are few for its nodes, else its family is marked as dense. Across families the
   join lists pairs, under the first key that they share only, if close in size and in both
   signatures; a key of many nodes is joined in blocks.
5. Confirmation on full sets. A task gets the texts of two blocks of nodes and the listed
   pairs between them, or all members of a dense family's two blocks, which it compares by
   signature and confirms, most similar first, skipping what is connected. So a text is sent
   once per block pair, and a task returns a spanning forest of its links.
6. Components over the nodes; rows take the component of their set, those of frequent sets
   by a broadcast.

The number of chunks is the least from 8 up that a pair at the threshold exceeds with
probability under 1e-5 (4e-6 for 85 with 8 chunks, 9e-6 for 80 with 11), the bit bound is
passed with about 1e-5; pairs above the threshold escape far less often. Links below it
can't come out.

Defined cases: null or blank texts have an empty set and link with nothing; texts of
fewer than five words are one shingle; rows that share a doc_id are one document, linked
to all that any of them links to; rows with a null doc_id are left unlinked (component
null, kept); further columns are ignored; an empty input gives an empty output.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.tables import hot_keys, Scratch, split_join, unused, width_for
from ..operators.components import connected_components

WORDS = 5
#: Least number of chunks, and the probability with which a pair at the threshold may exceed the symbol bound.
CHUNKS, ESCAPE = 8, 1e-5
BITS = 256
#: Hubs that a node is held against in the first round.
HUBS = 2
#: Nodes of a block when signatures are compared, and of a key that is joined whole.
SIGNATURE_NODES = 4096
#: Listed pairs of a block pair per node, beyond which its family counts as dense.
DENSE = 8
#: Words of text and nodes that a block of the confirmation holds, about.
BLOCK_WORDS, BLOCK_NODES = 500_000, 1000
#: Share of all rows above which a set's component is broadcast to its rows.
HOT_SHARE = 0.001
#: Up to so many ids of nodes with near ones are broadcast to the scan of the texts.
BROADCAST_IDS = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_ODD = (np.random.default_rng(20240229).integers(0, 2**31, BITS, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]

#: Bits of the other symbols, for each symbol of a chunk that is left out.
_KEEP = [int(np.int64(~np.int64(np.uint64(0xFFFF << 16 * j).astype(np.int64)))) for j in range(4)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    ``bytes.lower`` touches A-Z only and ``bytes.split`` cuts at exactly
    ``[\\x20\\x09-\\x0D]+``, which is the definition of a word here.
    """
    words = text.encode().lower().split() if text else []
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if n else [], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = n - WORDS + 1
    s = w[:m] * _MIX[0]
    for k in range(1, WORDS):
        s ^= s >> np.uint64(29)
        s *= _MIX[1]
        s += w[k : m + k] * _MIX[k]
    s ^= s >> np.uint64(32)
    s *= _MIX[2]
    s ^= s >> np.uint64(29)
    return np.unique(s)


@lru_cache
def chunks_for(percent: int) -> int:
    """Chunks so that a pair at the threshold differs in 2 * chunks symbols or more with at most probability ESCAPE."""
    q = 1 - percent / 100
    c = CHUNKS
    while c < BITS // 4 and sum(comb(4 * c, k) * q**k * (1 - q) ** (4 * c - k) for k in range(2 * c, 4 * c + 1)) > ESCAPE:
        c += 1
    return c


def signature(hashes: np.ndarray, chunks: int = CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """(``chunks`` longs of four 16-bit symbols, BITS / 64 longs of one-bit MinHashes)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (_ODD * x[None, at : at + 2048]).min(axis=1), out=least)
    mixed = least * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    symbols = (mixed[: 4 * chunks] >> np.uint32(16)).astype("<u2").view("<i8")
    bits = np.packbits((mixed >> np.uint32(13) & np.uint32(1)).astype(bool)).view("<i8")
    return symbols, bits


def bit_bound(percent: int) -> int:
    """Largest accepted distance of one-bit signatures: the mean at the threshold and 4.5 deviations."""
    p = (1 - percent / 100) / 2
    return int(BITS * p + 4.5 * (BITS * p * (1 - p)) ** 0.5)


def _columns(chunks: int) -> list[str]:
    return [*(f"c{k}" for k in range(chunks)), *(f"s{k}" for k in range(BITS // 64))]


def _signatures(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    names = ["id", "n", "set_hi", "set_lo", *_columns(chunks)]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for b in batches:
            for part in range(0, b.num_rows, 256):
                x = b.slice(part, 256)
                rows = []
                for doc, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    h = shingles(text)
                    if len(h):
                        digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8")
                        rows.append((doc, len(h), *digest, *np.concatenate(signature(h, chunks))))
                    else:
                        rows.append((doc, 0, *[None] * (len(names) - 2)))
                yield pa.record_batch([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in zip(*rows)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _families(nodes: DataFrame, chunks: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(met, families, hot): shared keys (key, chunk, gap, id, hub), (id, family), and keys (key) of very many nodes.

    The hub of a key is its member of the least hash. A family is a neighbourhood of the
    graph of nodes and shared keys: two rounds of passing on the least hub. It only decides
    where pairs are compared, not which.
    """
    key = [
        F.struct(F.lit(i).cast("byte").alias("chunk"), F.lit(j).cast("byte").alias("gap"), F.xxhash64(F.lit(4 * i + j), F.col(f"c{i}").bitwiseAND(F.lit(_KEEP[j]))).alias("key"))
        for i in range(chunks)
        for j in range(4)
    ]
    keys = nodes.select("id", F.explode(F.array(*key)).alias("k")).select("id", "k.*")
    first = F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id").alias("hub"))).alias("h")
    busy = scratch.save(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), first).where("m > 1").select("key", "h.hub", "m"), "busy")
    hot = busy.where(F.col("m") > max(tables.HOT_ROWS, nodes.count() * tables.HOT_SHARE)).select("key")  # at most 4 * chunks / HOT_SHARE
    hot = None if hot.isEmpty() else hot
    met = scratch.save(split_join(keys, busy.drop("m"), "key", hot).select("key", "id", "chunk", "gap", "hub"), "met")
    width = width_for(met.count())
    near = met.groupBy("id").agg(F.min("hub").alias("label"))
    least = met.select("key", "id").join(near, "id").groupBy("key").agg(F.min("label").alias("label"))
    families = split_join(met.select("key", "id"), least, "key", hot).groupBy("id").agg(F.min("label").alias("family"))
    return met, scratch.save(families, "families", width), hot


def _close(percent: int, chunks: int):
    """Distance of the one-bit signatures of x and y, and the conditions for a pair to be near."""
    bits = sum((F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(1, BITS // 64)), F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))))
    equal = [_equal(i) for i in range(chunks)]
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    return bits, sizes & (bits <= bit_bound(percent)) & (sum(equal[1:], equal[0]) > 2 * chunks)


def _same(i: int, j: int):
    """Whether symbol j of chunk i is equal."""
    return (F.col(f"x.c{i}").bitwiseXOR(F.col(f"y.c{i}"))).bitwiseAND(F.lit(~_KEEP[j])) == 0


def _equal(i: int):
    return sum((_same(i, j).cast("int") for j in range(1, 4)), _same(i, 0).cast("int"))


def _star_pairs(nodes: DataFrame, met: DataFrame, percent: int, chunks: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of a node and its nearest hubs, near by signature."""
    whole = F.struct("id", "n", *_columns(chunks))
    spokes = scratch.save(met.where("id <> hub").select(F.col("id").alias("spoke"), "hub").distinct(), "spokes")
    own = spokes.join(nodes.select(F.col("id").alias("spoke"), whole.alias("x")), "spoke")
    hubs = nodes.select(F.col("id").alias("hub"), whole.alias("y"))
    joined = split_join(own, hubs, "hub", hot_keys(spokes, "hub", spokes.count()))
    bits, near = _close(percent, chunks)
    some = joined.where(near).select(F.col("spoke").alias("id"), F.struct(bits.alias("d"), F.col("hub")).alias("h"))
    # A node has four hubs for each chunk at most.
    best = some.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("h")), 1, HUBS).alias("h"))
    return scratch.save(best.select(F.col("id").alias("a"), F.explode("h.hub").alias("b")), "stars")


def _cross_pairs(placed: DataFrame, met: DataFrame, hot: DataFrame | None, percent: int, chunks: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of different families and components that the multi-index join finds, once each."""
    width = width_for(met.count())
    own = met.select("key", "chunk", "gap", "id").join(placed.select("id", "family", "label"), "id")
    mixed = own.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("m"))
    mixed = mixed.where("lo < hi and l1 < l2").select("key", F.ceil(F.col("m") / SIGNATURE_NODES).alias("blocks"))
    ready = split_join(own, mixed, "key", hot).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    ready = ready.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ready = ready.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    ready = scratch.save(ready.join(placed.select("id", "n", *_columns(chunks)), "id"), "mixed", width)
    x, y = ready.alias("x"), ready.alias("y")

    # The first chunk with at most one error, and in it the first symbol that may be left out.
    earlier = F.lit(True)
    first = F.lit(False)
    for i in range(chunks):
        gap = F.when(_equal(i) == 4, F.lit(0))
        for j in range(4):
            gap = gap.when(~_same(i, j), F.lit(j))
        first = first | (earlier & (F.col("x.chunk") == i) & (F.col("x.gap") == gap))
        earlier = earlier & (_equal(i) < 3)
    pair = (
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.i") == F.col("y.i"))
        & (F.col("x.j") == F.col("y.j"))
        & (F.col("x.chunk") == F.col("y.chunk"))
        & (F.col("x.gap") == F.col("y.gap"))
        & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.family") != F.col("y.family"))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("x.i") == F.col("x.j")) | (F.col("x.block") != F.col("y.block")))
        & _close(percent, chunks)[1]
        & first
    )
    return scratch.save(x.join(y, pair).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "cross")


def near_in_blocks(part, percent: int, chunks: int):
    """Near pairs of different labels within each (family, i, j) of a pandas frame, or a mark of density.

    Returns arrays (family, a, b); a and b are -1 for a dense family.
    """
    part = part.sort_values(["family", "i", "j"], kind="stable")
    family, i, j = (part[c].to_numpy() for c in ("family", "i", "j"))
    symbols = np.ascontiguousarray(part[[f"c{k}" for k in range(chunks)]].to_numpy(np.int64)).view(np.uint16)
    bits = np.ascontiguousarray(part[[f"s{k}" for k in range(BITS // 64)]].to_numpy(np.int64)).view(np.uint64)
    ids, size, label, block = (part[c].to_numpy() for c in ("id", "n", "label", "block"))
    cuts = np.flatnonzero((np.diff(family) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    bound = bit_bound(percent)
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
        found: list[tuple] = []
        count = 0
        alone = i[lo] == j[lo]
        for k in range(lo, hi):
            if alone:
                rest = np.arange(k + 1, hi)
            elif block[k] == i[k]:
                rest = np.flatnonzero(block[lo:hi] == j[k]) + lo
            else:
                continue
            rest = rest[(label[rest] != label[k]) & (100 * size[rest] >= percent * size[k]) & (100 * size[k] >= percent * size[rest])]
            rest = rest[np.bitwise_count(bits[rest] ^ bits[k]).sum(axis=1) <= bound]
            rest = rest[(symbols[rest] != symbols[k]).sum(axis=1) < 2 * chunks]
            count += len(rest)
            if count > DENSE * (hi - lo) + 64:
                found = [(family[lo], -1, -1)]
                break
            found += [(family[lo], ids[k], ids[r]) for r in rest]
        out += found
    return out


def _family_pairs(placed: DataFrame, percent: int, chunks: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs, dense): near pairs (a, b) within families, and the families (family) that have too many to list."""
    room = placed.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2")
    room = room.select("family", F.ceil(F.col("m") / SIGNATURE_NODES).alias("blocks"))
    cells = placed.join(room, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    cells = scratch.save(cells, "cells", width_for(placed.count()))
    # Small families share a group: some thousand nodes each, whole (family, i, j) cells.
    groups = cells.count() // SIGNATURE_NODES + 1

    def run(part):
        import pandas as pd

        return pd.DataFrame(near_in_blocks(part, percent, chunks), columns=["family", "a", "b"], dtype="int64")

    grouped = cells.withColumn("group", F.pmod(F.xxhash64("family", "i", "j"), F.lit(groups)))
    found = scratch.save(grouped.groupBy("group").applyInPandas(run, "family long, a long, b long"), "inner")
    dense = scratch.save(found.where("a = -1").select("family").distinct(), "dense")
    return found.where("a <> -1").join(dense, "family", "left_anti").select("a", "b"), dense


def _confirm(docs: DataFrame, placed: DataFrame, pairs: DataFrame, dense: DataFrame | None, percent: int, chunks: int, id_col: str, text_col: str, scratch: Scratch, name: str) -> DataFrame:
    """A spanning forest, per task, of the links that full sets confirm.

    A task is a pair of blocks of families with the listed pairs between them, or a pair of
    blocks of one dense family, whose members are all compared. Small tasks share a group.
    """
    spark = docs.sparkSession
    room = placed.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_WORDS), F.ceil(F.count(F.lit(1)) / BLOCK_NODES)).alias("blocks"))
    blocks = placed.select("id", "family", "label", "n").join(room, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    at = scratch.save(blocks, f"{name}-blocks", width_for(placed.count()))
    place = at.select("id", F.xxhash64("family", "block").alias("place"))
    listed = pairs.join(place.toDF("a", "pa"), "a").join(place.toDF("b", "pb"), "b")
    listed = scratch.save(listed.select("a", "b", F.xxhash64(F.lit(1), F.least("pa", "pb"), F.greatest("pa", "pb")).alias("task")), f"{name}-listed")
    need = listed.select("task", F.col("a").alias("id")).unionByName(listed.select("task", F.col("b").alias("id"))).distinct().withColumn("side", F.lit(3))
    if dense is not None:
        inner = at.join(dense, "family", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        need = need.unionByName(inner.select(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "id", side.alias("side")))
    need = scratch.save(need.join(at.select("id", "label", "n"), "id"), f"{name}-need")
    ids = need.select("id").distinct()
    words = need.agg(F.sum("n")).first()[0] or 0
    groups = F.pmod(F.col("task"), F.lit(words // BLOCK_WORDS + 1))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    if ids.count() <= BROADCAST_IDS:  # else the texts that nothing needs go through the shuffle as well
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    loaded = need.drop("n").join(texts, "id").withColumn("group", groups)
    again = spark.read.schema(listed.schema).parquet(scratch.path(f"{name}-listed")).withColumn("group", groups)

    def check(left, right):
        import pandas as pd

        found = []
        wanted = {t: p[["a", "b"]].to_numpy() for t, p in right.groupby("task")}
        for task, part in left.groupby("task"):
            ids, side = part["id"].to_numpy(), part["side"].to_numpy()
            sets = [shingles(t) for t in part["text"]]
            if (side == 3).any():
                found += linked_pairs(ids, sets, wanted.get(task, np.empty((0, 2), np.int64)), percent)
            else:
                found += linked_blocks(ids, sets, side, percent, chunks, part["label"].to_numpy())
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return scratch.save(loaded.groupBy("group").cogroup(again.groupBy("group")).applyInPandas(check, "a long, b long"), f"{name}-links")


def linked_pairs(ids: np.ndarray, sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Those of the listed pairs that are links, without the ones that close a cycle."""
    where: dict[int, list[int]] = {}
    for k, i in enumerate(ids.tolist()):
        where.setdefault(i, []).append(k)
    root: dict[int, int] = {}

    def find(v):
        while (p := root.get(v, v)) != v:
            root[v] = root.get(p, p)
            v = p
        return v

    found = []
    for a, b in pairs.tolist():
        ra, rb = find(a), find(b)
        if ra != rb and any(similar(sets[x], sets[y], percent) for x in where.get(a, ()) for y in where.get(b, ())):
            root[max(ra, rb)] = min(ra, rb)
            found.append((a, b))
    return found


def linked_blocks(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, chunks: int, known: np.ndarray) -> list[tuple[int, int]]:
    """Links between all members (side 0) or between sides 1 and 2, without those that close a cycle.

    Members of one ``known`` label are connected already.
    """
    if len(ids) < 2:
        return []
    size = np.array([len(s) for s in sets])
    symbols, bits = zip(*(signature(s, chunks) for s in sets))
    symbols = np.stack(symbols).view(np.uint16)
    bits = np.stack(bits).view(np.uint64)
    label = np.unique(known, return_inverse=True)[1]
    bound = bit_bound(percent)
    found = []
    for i in np.flatnonzero(side < 2).tolist():
        rest = np.arange(i + 1, len(ids)) if side[i] == 0 else np.flatnonzero(side == 2)
        rest = rest[label[rest] != label[i]]
        rest = rest[(100 * size[rest] >= percent * size[i]) & (100 * size[i] >= percent * size[rest])]
        distance = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1)
        close = distance <= bound
        rest, distance = rest[close], distance[close]
        close = (symbols[rest] != symbols[i]).sum(axis=1) < 2 * chunks
        rest = rest[close][np.argsort(distance[close], kind="stable")]
        for j in rest.tolist():
            if label[j] != label[i] and similar(sets[i], sets[j], percent):
                label[label == label[j]] = label[i]
                found.append((int(ids[i]), int(ids[j])))
    return found


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    if not len(x) or not len(y):
        return False
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id and kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    chunks = chunks_for(percent)
    carried = _columns(chunks)
    signed = scratch.save(_signatures(docs, id_col, text_col, chunks), "signed")
    known = signed.where("id is not null and n > 0")
    nodes = known.groupBy("set_hi", "set_lo").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in carried))
    nodes = scratch.save(nodes, "nodes")
    met, families, hot = _families(nodes, chunks, scratch)

    # First round: nodes and hubs.
    placed = families.join(nodes.select("id", "n", *carried), "id")
    stars = _star_pairs(nodes, met, percent, chunks, scratch)
    links = _confirm(docs, placed.withColumn("label", F.col("id")), stars, None, percent, chunks, id_col, text_col, scratch, "star")
    first = connected_components(links, scratch, "first")

    # Second round: everything between different components.
    labelled = placed.join(first.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = scratch.save(labelled, "labelled", width_for(families.count()))
    inner, dense = _family_pairs(labelled, percent, chunks, scratch)
    cross = _cross_pairs(labelled, met, hot, percent, chunks, scratch)
    links = _confirm(docs, labelled, inner.unionByName(cross), dense, percent, chunks, id_col, text_col, scratch, "rest")
    now = nodes.select("id", "set_hi", "set_lo", "copies").join(first, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    now = scratch.save(now, "now")
    name = now.select("id", "label")
    edges = links.join(name.toDF("a", "la"), "a").join(name.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    edges = edges.unionByName(_shared_ids(known, now, scratch))
    last = connected_components(edges, scratch, "last").withColumnRenamed("id", "label")
    sets = now.join(last, "label", "left").select("set_hi", "set_lo", "copies", F.coalesce("component", "label").alias("component"))
    sets = scratch.save(sets, "sets")

    # Rows take their set's component; sets of many rows, at most 1 / HOT_SHARE, are broadcast.
    often = F.col("copies") > max(1000, int(known.count() * HOT_SHARE))
    hot = F.broadcast(sets.where(often).drop("copies"))
    row = known.select("id", "n", "set_hi", "set_lo")
    on = ["set_hi", "set_lo"]
    found = row.join(hot, on).unionByName(row.join(hot, on, "left_anti").join(sets.where(~often).drop("copies"), on))
    plain = signed.where("id is null or n = 0").select("id", "n", F.col("id").alias("component"))
    result = scratch.save(found.select("id", "n", "component").unionByName(plain), "result")
    scratch.drop_but("result")
    return result.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("component").eqNullSafe(F.col("id")).alias("kept"),
    )


def _shared_ids(known: DataFrame, now: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between the labels of the sets that rows of one doc_id have."""
    own = F.struct("set_hi", "set_lo")
    mixed = known.groupBy("id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo < hi").select("id")
    mixed = scratch.save(mixed, "mixed-ids")
    rows = known.select("id", "set_hi", "set_lo").join(mixed, "id", "left_semi").join(now.select("set_hi", "set_lo", "label"), ["set_hi", "set_lo"])
    rows = scratch.save(rows.select("id", "label").distinct(), "shared")
    least = rows.groupBy("id").agg(F.min("label").alias("a"))
    return rows.join(least, "id").where("a <> label").select("a", F.col("label").alias("b")).distinct()


def deduplicate(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose group holds a smaller id; all columns kept."""
    groups = near_duplicates(docs, percent, id_col, text_col)
    name = unused(docs, "lost")[0]
    lost = groups.where("not kept").select(F.col(id_col).alias(name)).distinct()
    if lost.count() <= BROADCAST_IDS:  # else the texts go through a shuffle
        lost = F.broadcast(lost)
    return docs.join(lost, F.col(id_col) == F.col(name), "left_anti")


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
