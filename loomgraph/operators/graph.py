"""Prerequisite-graph operators.

Edges are frames ``(src, dst)``, some with ``ord`` (insertion order) or ``rel``. Fixpoints
are semi-naive: a round joins only the newest rows with the edges, removes what is known
and writes the rest to the shared folder, so that plans stay short and the state is never
on the driver. Orders that are sequential by nature (priority topological order, cycle
demotion) run in one group per target over that target's own closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import REJECTIONS
from ..sources.tables import Scratch, running_total, small
from . import reachability

MAX_ROUNDS = 10_000
#: Up to so many pairs (two ids each) of a closure's round are broadcast.
CANDIDATES = 1_000_000
#: Layers of leaves that one table of a peeling takes off.
LAYERS = 4
#: Prerequisites of a node above which the reduction marks what lies below them, not pair by pair.
HUB = 1000
#: Sources that ask for an end from which its label goes up the edges, not theirs down.
POPULAR = 1000
#: Nodes of one block of a path whose order is found in one task.
BLOCK = 100_000


class CycleError(ValueError):
    """A relation that has to be acyclic holds a cycle."""


def closure(edges: DataFrame, roots: DataFrame | None = None, stop: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(src, dst, hops): every dst reachable from a root, with the least number of edges.

    ``roots`` (id) restricts the sources; nodes in ``stop`` (id) are reached, not passed.
    Cycles end by themselves since only new pairs go on; a root on a cycle reaches itself.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "closure")
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("dst")).distinct()
    if stop is not None:
        step = step.join(stop.select(F.col("id").alias("mid")).distinct(), "mid", "left_anti")
    step = scratch.save(step, "step")
    first = edges.select("src", "dst").distinct()
    if roots is not None:
        first = first.join(roots.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    new = scratch.save(first.withColumn("hops", F.lit(1)), "d1")
    paths = [scratch.path("d1")]
    for k in range(2, max_rounds + 1):
        if new.isEmpty():
            break
        known = spark.read.schema(new.schema).parquet(*paths)
        near = new.select("src", F.col("dst").alias("mid")).join(step, "mid").select("src", "dst").distinct()
        near = scratch.save(near, f"near{k}")
        # Few candidates go to the known pairs, so that those are read but not shuffled.
        old = known.select("src", "dst").join(small(near, CANDIDATES), ["src", "dst"], "left_semi")
        new = scratch.save(near.join(old, ["src", "dst"], "left_anti").withColumn("hops", F.lit(k)), f"d{k}")
        scratch.drop(f"near{k}")
        paths.append(scratch.path(f"d{k}"))
    else:
        raise CycleError(f"closure did not settle in {max_rounds} rounds")
    return spark.read.schema(new.schema).parquet(*paths)


def dependents(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(id, dependent): everything that reaches a root, by closure of the reversed edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(back, roots).select(F.col("src").alias("id"), F.col("dst").alias("dependent"))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, target) -> (alias, target) with chains followed to their ends.

    Pointer jumping, so a chain of n takes about log n rounds; names on an alias cycle
    resolve to the least name of the cycle.
    """
    scratch = Scratch(aliases.sparkSession, "alias")
    now = scratch.save(aliases.groupBy("alias").agg(F.min("target").alias("target")), "a0")
    for k in range(1, 64):
        hop = now.select(F.col("alias").alias("target"), F.col("target").alias("next"))
        after = now.join(hop, "target", "left").select("alias", F.col("target").alias("was"), F.coalesce("next", "target").alias("target"))
        after = scratch.save(after, f"a{k}")
        now = after.select("alias", "target")
        if after.where("was <> target").isEmpty():
            break
    ring = now.join(now.select(F.col("alias").alias("target")).distinct(), "target", "left_semi")
    if ring.isEmpty():
        return now
    walk = closure(aliases.select(F.col("alias").alias("src"), F.col("target").alias("dst")))
    loops = walk.where("src = dst").select(F.col("src").alias("dst"))
    least = walk.join(loops, "dst", "left_semi").groupBy(F.col("src").alias("alias")).agg(F.min("dst").alias("least"))
    return now.join(least, "alias", "left").select("alias", F.coalesce("least", "target").alias("target"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(id, weight): distinct edges into each node that has one."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("weight"))


def syllabus(edges: DataFrame, targets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(target, pos, id): the prerequisites of each target in order of learning.

    Of the nodes whose included prerequisites are all out already, the one with the
    largest in-degree over the whole graph comes next, the smaller id first. The set work
    is distributed; only the order of one target's closure runs in one group.
    """
    reach = closure(edges, targets).select(F.col("src").alias("target"), F.col("dst").alias("id")).where("target <> id")
    if known is not None:
        reach = reach.join(known.select("id").distinct(), "id", "left_anti")
    weighted = reach.join(in_degree(edges), "id", "left").select("target", "id", F.coalesce("weight", F.lit(0)).alias("weight"))
    inner = weighted.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("needs")).distinct(), "id", "left")
    inside = reach.select(F.col("target").alias("t2"), F.col("id").alias("needs2"))
    kept = inner.join(inside, (inner["target"] == inside["t2"]) & (inner["needs"] == inside["needs2"]), "left")
    rows = kept.groupBy("target", "id", "weight").agg(F.collect_set("needs2").alias("needs"))
    kind = dict(edges.dtypes)["src"]

    def order(pdf):
        import heapq

        import pandas as pd

        weight = dict(zip(pdf["id"], pdf["weight"]))
        left = {i: len(n) for i, n in zip(pdf["id"], pdf["needs"])}
        users: dict = {}
        for i, needs in zip(pdf["id"], pdf["needs"]):
            for n in needs:
                users.setdefault(n, []).append(i)
        ready = [(-weight[i], i) for i, k in left.items() if not k]
        heapq.heapify(ready)
        out = []
        while ready:
            i = heapq.heappop(ready)[1]
            out.append(i)
            for u in users.get(i, ()):
                left[u] -= 1
                if not left[u]:
                    heapq.heappush(ready, (-weight[u], u))
        if len(out) < len(left):
            raise CycleError(f"the prerequisites of {pdf['target'].iloc[0]} hold a cycle")
        return pd.DataFrame({"target": pdf["target"].iloc[0], "pos": range(1, len(out) + 1), "id": out})

    return rows.groupBy("target").applyInPandas(order, f"target {kind}, pos int, id {kind}")


def shortest_chain(edges: DataFrame, src, dst, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(pos, id) of one shortest path; ties go to the edges that come first by ``ord``.

    Empty if there is none; the node itself if both ends are one. The frontier carries
    its paths, one for each node reached, and stops at dst.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "chain")
    kind = dict(edges.dtypes)["src"]
    step = scratch.save(edges.groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.min("ord").alias("ord")), "step")
    front = spark.createDataFrame([(src, [], [src])], f"id {kind}, ords array<bigint>, path array<{kind}>")
    paths = []
    for k in range(max_rounds):
        front = scratch.save(front, f"f{k}")
        paths.append(scratch.path(f"f{k}"))
        if front.isEmpty() or not front.where(F.col("id") == F.lit(dst)).isEmpty():
            break
        seen = spark.read.schema(front.schema).parquet(*paths).select("id")
        grown = front.join(step, front["id"] == step["at"]).select(
            F.col("to").alias("id"), F.concat("ords", F.array(F.col("ord").cast("long"))).alias("ords"), F.concat("path", F.array("to")).alias("path")
        )
        best = grown.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("ords", "path")).alias("b"))
        front = best.select("id", "b.ords", "b.path")
    return front.where(F.col("id") == F.lit(dst)).select(F.posexplode("path").alias("pos", "id"))


def transitive_reduction(edges: DataFrame, exempt: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The edges that no longer path replaces; edges out of ``exempt`` nodes (id) all stay.

    An edge is replaced if any end of its source's edges leads to its own end: a question
    about two nodes, asked once for all sources that share it (``_leading``), or of the
    reachability index where ``labels`` are given. Nodes with more than ``HUB`` edges would
    ask about all pairs of them; there, what lies below the edges' ends is marked by packed
    labels of the hubs, and a marked end has a longer path.
    """
    scratch = Scratch(edges.sparkSession, "reduction")
    e = scratch.save(edges.select("src", "dst").distinct(), "edges")
    asked = e if exempt is None else e.join(exempt.select(F.col("id").alias("src")).distinct(), "src", "left_anti")
    busy = asked.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    plain = asked.join(busy.where(F.col("n").between(2, HUB)).select("src"), "src", "left_semi")
    if labels is not None:
        redundant = reachability.holding(plain, e, labels, least=2)
    else:
        each = scratch.save(plain.join(plain.select("src", F.col("dst").alias("via")), "src").select("src", "dst", "via"), "each")
        led = _leading(each.select(F.col("via").alias("src"), "dst").distinct(), e, scratch)
        redundant = each.join(led.select(F.col("src").alias("via"), "dst"), ["via", "dst"], "left_semi").select("src", "dst").distinct()
    hubs = asked.join(busy.where(F.col("n") > HUB).select("src"), "src", "left_semi")
    if not hubs.isEmpty():
        words, numbers = reachability.reaching(e, hubs.select(F.col("dst").alias("id"), F.col("src").alias("hub")), "hub", own=False)
        marked = hubs.join(numbers.withColumnRenamed("hub", "src"), "src").join(words.withColumnRenamed("id", "dst"), ["dst", "bucket"])
        redundant = redundant.unionByName(marked.where("getbit(word, bit) = 1").select("src", "dst"))
    return e.join(redundant, ["src", "dst"], "left_anti")


def _leading(pairs: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The different pairs (src, dst) that a path of one edge or more joins, each once.

    Labels go packed, along edges that lead to where they are asked for: of the dsts that most
    srcs ask for (``POPULAR`` and more, one bucket) up the edges, of the
    srcs of all other pairs down.
    """
    pairs = scratch.save(pairs.select("src", "dst"), "pairs")
    most = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= POPULAR)
    most = F.broadcast(scratch.save(most.orderBy(F.desc("n"), "dst").limit(reachability.WORD).select("dst"), "most"))
    out = []
    up, down = pairs.join(most, "dst", "left_semi"), pairs.join(most, "dst", "left_anti")
    if not most.isEmpty():
        words, numbers = reachability.reaching(edges, most.select(F.col("dst").alias("id"), "dst"), "dst", back=True, own=False)
        met = up.join(F.broadcast(numbers), "dst").join(words.withColumnRenamed("id", "src"), ["src", "bucket"])
        out.append(met.where("getbit(word, bit) = 1").select("src", "dst"))
    starts = down.select(F.col("src").alias("id"), "src").distinct()
    inner = edges.join(reachability.reachable(edges, starts).select(F.col("id").alias("src")), "src", "left_semi")
    words, numbers = reachability.reaching(inner, starts, "src", own=False)
    met = down.join(numbers, "src").join(words.withColumnRenamed("id", "dst"), ["dst", "bucket"])
    out.append(met.where("getbit(word, bit) = 1").select("src", "dst"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def algorithms_under(hierarchy: DataFrame, algorithms: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): algorithms below each root by contains/uses edges, not passing any.

    A root that is an algorithm itself is its own only answer.
    """
    a = algorithms.select("id").distinct()
    plain = roots.select("id").distinct().join(a, "id", "left_anti")
    below = closure(hierarchy, plain, stop=a).select(F.col("src").alias("root"), F.col("dst").alias("id"))
    own = roots.select("id").distinct().join(a, "id", "left_semi").select(F.col("id").alias("root"), "id")
    return below.join(a, "id", "left_semi").select("root", "id").unionByName(own)


def floor(nodes: DataFrame, known: DataFrame | None = None, not_known: DataFrame | None = None) -> DataFrame:
    """(id): what a reader needs no path to: assumed nodes (id, tier) but those that the reader denies, and what the reader knows."""
    base = nodes.where(F.col("tier") == "assumed").select("id")
    if not_known is not None:
        base = base.join(not_known.select("id").distinct(), "id", "left_anti")
    return base if known is None else base.unionByName(known.select("id")).distinct()


def learning_path(edges: DataFrame, algorithms: DataFrame, known: DataFrame, node: DataFrame | None = None) -> DataFrame:
    """(pos, id): syllabuses of the algorithms (id) in order of id, each node at its first place.

    Every algorithm follows its own prerequisites, unless known. Without any algorithm the
    path is the syllabus of ``node`` (id) itself.

    No syllabus is made: of a set that holds whatever its nodes need, the order of learning is
    that of all nodes, left to the set. So a node lies under the first algorithm that reaches
    it, and there in the order of all (``_places``).
    """
    if node is not None and algorithms.isEmpty():
        return syllabus(edges, node, known).select("pos", "id")
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    scratch = Scratch(spark, "path")
    e = scratch.save(edges.select("src", "dst").dropna().distinct(), "edges")
    goals = algorithms.select(F.col("id").cast(kind).alias("id")).dropna().distinct()
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).unionByName(goals).distinct()
    seeds = ends.join(goals.select("id", F.col("id").alias("value")), "id", "left")
    first = reachability.extreme(e.toDF("at", "to"), seeds, scratch, "first", largest=False).where("value is not null")
    needed = first.join(known.select("id").distinct(), "id", "left_anti").join(in_degree(e), "id", "left")
    needed = needed.select("id", F.col("value").alias("target"), F.struct((-F.coalesce("weight", F.lit(0))).alias("weight"), "id").alias("at"), F.lit(1).alias("one"))
    nodes = scratch.save(running_total(needed, "at", "one", "rank").select("id", "target", "rank"), "nodes")
    number = nodes.select("id", "rank")
    inner = e.join(number.toDF("src", "at"), "src").join(number.toDF("dst", "to"), "dst").select("at", "to")
    placed = _places(nodes.select("rank"), scratch.save(inner, "inner"), scratch)
    if placed is None:
        return _path_of_each(edges, goals, known)
    own = (F.col("id") == F.col("target")).alias("own")
    rows = nodes.join(placed, "rank").select("id", F.struct("target", own, "key", "place").alias("at"), F.lit(1).alias("one"))
    return running_total(rows, "at", "one", "pos").select(F.col("pos").cast("int").alias("pos"), "id")


def _path_of_each(edges: DataFrame, algorithms: DataFrame, known: DataFrame) -> DataFrame:
    """The path where a cycle is in the way: each algorithm's own syllabus, which may do without the cycle, or raises."""
    each = syllabus(edges, algorithms, known).select("target", "pos", "id")
    last = algorithms.select(F.col("id").alias("target"), F.lit(2_147_483_647).alias("pos"), "id")
    rows = each.unionByName(last.join(known.select("id").distinct(), "id", "left_anti").select("target", "pos", "id"))
    first = rows.groupBy("id").agg(F.min(F.struct("target", "pos")).alias("at"))
    return running_total(first.withColumn("one", F.lit(1)), "at", "one", "place").select(F.col("place").cast("int").alias("pos"), "id")


def _places(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(rank, key, place), by which all nodes (rank) lie in order of learning; nothing if the edges (at, to) hold a cycle.

    The least rank whose prerequisites are out comes next. A node has to wait for the largest
    rank below it, its own among them: no node that waits for a larger one comes before it.
    Those that wait for one rank are a block, which begins with that node; a large block falls
    into blocks in the same way when that node is taken off. So the blocks' keys are in order,
    and what is left in a block of at most ``BLOCK`` nodes is ordered in one task.
    """
    seeds = nodes.select(F.col("rank").alias("id"), F.col("rank").alias("value"))
    waits = reachability.extreme(edges.select(F.col("to").alias("at"), F.col("at").alias("to")), seeds, scratch, "waits")
    now = scratch.save(waits.select(F.col("id").alias("rank"), F.array("value").alias("key")), "keys0")

    def within(rows):
        a, b = rows.select(F.col("rank").alias("at"), F.col("key").alias("_a")), rows.select(F.col("rank").alias("to"), F.col("key").alias("_b"))
        return edges.join(a, "at").join(b, "to").where("_a = _b").select("at", "to")

    inside = scratch.save(within(now), "inside0")
    if not reachability.strong_components(inside.toDF("src", "dst")).isEmpty():
        return None
    for k in range(1, MAX_ROUNDS):
        sizes = scratch.save(now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{k}")
        large = sizes.where(F.col("n") > BLOCK).select("key")
        if large.isEmpty():
            break
        rest = now.where("rank <> element_at(key, -1)").join(large, "key", "left_semi")
        rest = scratch.save(rest, f"rest{k}")
        inside = scratch.save(within(rest), f"split{k}")
        split = reachability.extreme(inside.select(F.col("to").alias("at"), F.col("at").alias("to")), rest.select(F.col("rank").alias("id"), F.col("rank").alias("value")), scratch, f"waits{k}-")
        longer = now.join(split.select(F.col("id").alias("rank"), "value"), "rank", "left")
        now = scratch.save(longer.select("rank", F.when(F.col("value").isNull(), F.col("key")).otherwise(F.concat("key", F.array("value"))).alias("key")), f"keys{k}")
    blocks = now.join(sizes.select("key"), "key", "left_semi")
    several = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-blocks.count() // BLOCK)) * 4))
    needs = within(blocks).groupBy(F.col("at").alias("rank")).agg(F.collect_list("to").alias("needs"))

    def order(pdf):
        import heapq

        import pandas as pd

        left, users = {}, {}
        for i, needs in zip(pdf["rank"].tolist(), pdf["needs"]):
            left[i] = 0 if needs is None else len(needs)
            for n in () if needs is None else needs.tolist():
                users.setdefault(n, []).append(i)
        ready = [i for i, k in left.items() if not k]
        heapq.heapify(ready)
        out = []
        while ready:
            out.append(heapq.heappop(ready))
            for u in users.get(out[-1], ()):
                left[u] -= 1
                if not left[u]:
                    heapq.heappush(ready, u)
        return pd.DataFrame({"rank": out, "place": range(len(out))}, dtype="int64")

    # Blocks that share a task don't need each other, so each is in its own order there.
    found = blocks.select("rank", several.alias("task")).join(needs, "rank", "left").groupBy("task").applyInPandas(order, "rank long, place long")
    return now.join(found, "rank", "left").select("rank", "key", F.coalesce("place", F.lit(0)).alias("place"))


def depths(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, depth): edges on the longest path below each node, leaves 0; raises on cycles.

    Leaves are peeled, ``LAYERS`` layers to a table: an edge goes with the layer of its end,
    and a node lies above the last of its edges to go. Each edge leaves the tables once gone.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "depth")
    e = scratch.save(edges.select("src", "dst").distinct(), "edges")
    left, gone = e, []
    for k in range(max_rounds):
        now = left.withColumn("depth", F.lit(None).cast("int"))
        for layer in range(1, LAYERS + 1):
            inner = now.where("depth is null").select(F.col("src").alias("dst")).distinct().withColumn("inner", F.lit(True))
            leaf = F.col("depth").isNull() & F.col("inner").isNull()
            now = now.join(inner, "dst", "left").select("src", "dst", F.when(leaf, k * LAYERS + layer).otherwise(F.col("depth")).alias("depth"))
        now = scratch.save(now, f"l{k}")
        gone.append(scratch.path(f"l{k}"))
        if now.where("depth is not null").isEmpty():
            if not now.isEmpty():
                raise CycleError("the relation holds a cycle")
            break
        left = now.where("depth is null").select("src", "dst")
    else:
        raise CycleError(f"peeling did not end in {max_rounds} rounds")
    above = spark.read.schema(now.schema).parquet(*gone).groupBy(F.col("src").alias("id")).agg(F.max("depth").alias("depth"))
    every = e.select(F.col("dst").alias("id")) if nodes is None else e.select(F.col("dst").alias("id")).unionByName(nodes.select("id"))
    return every.distinct().join(above, "id", "full_outer").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def levels(edges: DataFrame, nodes: DataFrame, root, components: DataFrame | None = None, supporting: DataFrame | None = None) -> DataFrame:
    """(id, level): hops from the root over all edges; unreachable nodes one below the deepest.

    ``supporting`` nodes (id) have no parent; they are drawn at the level of the highest of
    the ``components`` (id), 2 if there is none.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    start = spark.createDataFrame([(root,)], f"id {kind}")
    hops = closure(edges, start).where("src <> dst").select(F.col("dst").alias("id"), F.col("hops").alias("level"))
    hops = hops.unionByName(start.select("id", F.lit(0).alias("level")))
    deepest = hops.agg(F.max("level").alias("deepest"))
    out = nodes.select("id").distinct().join(hops, "id", "left").crossJoin(F.broadcast(deepest)).select("id", F.coalesce("level", F.col("deepest") + 1).alias("level"))
    if supporting is None:
        return out
    extra = supporting.select("id").distinct()
    own = out.join(components.select("id").distinct(), "id", "left_semi") if components is not None else out.limit(0)
    top = own.join(extra, "id", "left_anti").agg(F.coalesce(F.min("level"), F.lit(2)).alias("top"))
    marked = out.join(extra.withColumn("extra", F.lit(True)), "id", "left").crossJoin(F.broadcast(top))
    return marked.select("id", F.when(F.col("extra"), F.col("top")).otherwise(F.col("level")).alias("level"))


GLOBAL_TYPES = ("algorithm", "concept", "technique", "failure_mode")
PROJECT_TYPES = ("system", "subsystem", "component")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, src, dst): edges (src, dst, rel) that break the layer rules over nodes (id, type).

    contains leaves a project node and ends at no concept or technique; uses goes from a
    project node to an algorithm; requires ends at a global node; no requires edge lies on a cycle.
    """
    typed = edges.join(nodes.select(F.col("id").alias("src"), F.col("type").alias("st")), "src", "left").join(nodes.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst", "left")
    project = F.col("st").isin(*PROJECT_TYPES)
    bad = (
        F.when(F.col("st").isNull() | F.col("dt").isNull(), "unknown end")
        .when((F.col("rel") == "contains") & ~(project & ~F.col("dt").isin("concept", "technique")), "contains outside the architecture")
        .when((F.col("rel") == "uses") & ~(project & (F.col("dt") == "algorithm")), "uses something else than an algorithm")
        .when((F.col("rel") == "requires") & ~F.col("dt").isin(*GLOBAL_TYPES), "requires outside the canon")
    )
    needs = edges.where("rel = 'requires'").select("src", "dst").distinct()
    rings = cyclic_edges(needs).select(F.lit("requires on a cycle").alias("rule"), "src", "dst")
    return typed.withColumn("rule", bad).where("rule is not null").select("rule", "src", "dst").unionByName(rings)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes (id, tier) that are not assumed and have no edge of any relation."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.where(~F.col("tier").eqNullSafe("assumed")).join(ends, "id", "left_anti").select("id")


def merge_nodes(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges (src, dst, rel) with every losing node (alias) replaced by its survivor (target).

    Chains of merges are followed; self-edges that arise go, and equal edges become one.
    """
    full = resolve_aliases(merges)
    out = edges
    for end in ("src", "dst"):
        out = out.join(full.select(F.col("alias").alias(end), F.col("target").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out.where("src <> dst").select("src", "dst", "rel").distinct()


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges that lie on a cycle, each with its strong component: both ends share it."""
    own = reachability.strong_components(edges)
    at = edges.join(own.select(F.col("id").alias("src"), F.col("component").alias("_a")), "src").join(own.select(F.col("id").alias("dst"), F.col("component").alias("_b")), "dst")
    return at.where("_a = _b").select(*edges.columns, F.col("_a").alias("component"))


def add_edges(batch: DataFrame, nodes: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, ord) taken in order -> (src, dst, ord, rel, demoted).

    Both ends are resolved by ``aliases`` (alias, target) first; an end that is none of the
    ``nodes`` (id) raises, as does a self-edge. An edge that would close a cycle of requires
    edges becomes related_to; of equal edges the first one counts. Only edges within cycles
    of the whole batch can be demoted; those are found as its strong components, and each
    component is folded in order in a group of its own, under an incrementally kept
    topological order, so an edge that fits the order costs nothing.
    """
    if aliases is not None:
        full = resolve_aliases(aliases)
        for end in ("src", "dst"):
            batch = batch.join(full.select(F.col("alias").alias(end), F.col("target").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    if nodes is not None:
        ends = batch.select(F.col("src").alias("id")).unionByName(batch.select(F.col("dst").alias("id"))).distinct()
        lost = ends.join(nodes.select("id"), "id", "left_anti").limit(20).collect()
        if lost:
            raise KeyError("unknown nodes: " + ", ".join(sorted(str(r["id"]) for r in lost)))
    if not batch.where("src = dst").isEmpty():
        raise ValueError("a node can't require itself")
    kind = dict(batch.dtypes)["src"]
    first = batch.groupBy("src", "dst").agg(F.min("ord").alias("ord"))
    placed = cyclic_edges(first)

    def fold(pdf):
        import pandas as pd

        order = sorted(range(len(pdf)), key=lambda k: _plain(pdf["ord"].iloc[k]))
        found = demotions(zip(pdf["src"].iloc[order], pdf["dst"].iloc[order]))
        return pd.DataFrame(found, columns=["src", "dst"])

    demoted = placed.groupBy("component").applyInPandas(fold, f"src {kind}, dst {kind}").withColumn("demoted", F.lit(True))
    out = first.join(demoted, ["src", "dst"], "left").withColumn("demoted", F.coalesce("demoted", F.lit(False)))
    return out.select("src", "dst", "ord", F.when(F.col("demoted"), "related_to").otherwise("requires").alias("rel"), "demoted")


def demotions(edges) -> list[tuple]:
    """Those of the edges, taken in order, that close a cycle with those before them that don't.

    Nodes hold places such that every edge goes upwards. An edge that goes downwards searches
    only between its ends' places, and moves what it finds.
    """
    place: dict = {}
    out: dict = {}
    into: dict = {}
    bad = []

    def reach(start, step, inside):
        found, stack = {start}, [start]
        while stack:
            for n in step.get(stack.pop(), ()):
                if n not in found and inside(place[n]):
                    found.add(n)
                    stack.append(n)
        return found

    for s, d in edges:
        for n in (s, d):
            place.setdefault(n, len(place))
        low, high = place[d], place[s]
        if low < high:
            above = reach(d, out, lambda p: p <= high)  # noqa: B023
            if s in above:
                bad.append((s, d))
                continue
            below = reach(s, into, lambda p: p >= low)  # noqa: B023
            moved = sorted(below, key=place.get) + sorted(above, key=place.get)
            for n, p in zip(moved, sorted(place[n] for n in moved)):
                place[n] = p
        out.setdefault(s, []).append(d)
        into.setdefault(d, []).append(s)
    return bad


def _plain(value):
    """A struct that pandas holds as a mapping or row, as a tuple; other values as they are."""
    return tuple(value.values()) if isinstance(value, dict) else tuple(value) if isinstance(value, (tuple, list)) else value


def merge_proposals(proposals: DataFrame, nodes: DataFrame, dropped: DataFrame, existing: DataFrame, cap: int = 5, aliases: DataFrame | None = None) -> DataFrame:
    """Proposed edges (cluster, ord, src, dst) -> the same with ``status`` and ``reason``.

    Merged ids are resolved by ``aliases`` (alias, target) before anything is tested. Reasons
    come in the order of ``REJECTIONS``. Taken in (cluster, ord) order, the first ``cap``
    different targets of a source are taken, demoted ones among them; a copy of a taken edge
    is a duplicate, every other eligible edge is over the cap. ``existing`` edges only take
    part in cycles: a taken edge that closes one with edges before it is demoted.
    """
    if aliases is not None:
        full = resolve_aliases(aliases)
        for end in ("src", "dst"):
            proposals = proposals.join(full.select(F.col("alias").alias(end), F.col("target").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    n = nodes.select("id", "type", "tier")
    p = (
        proposals.join(n.select(F.col("id").alias("src"), F.col("type").alias("st"), F.col("tier").alias("sr")), "src", "left")
        .join(n.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst", "left")
        .join(dropped.select("src", "dst").distinct().withColumn("gone", F.lit(True)), ["src", "dst"], "left")
    )
    tests = (F.col("st").isNull(), F.col("dt").isNull(), F.col("src") == F.col("dst"), F.col("sr") == "assumed", F.col("st") == "algorithm", F.col("gone"))
    early = F.lit(None).cast("string")
    for test, reason in reversed(list(zip(tests, REJECTIONS))):
        early = F.when(test, reason).otherwise(early)
    p = p.withColumn("early", early).withColumn("open", F.col("early").isNull())
    at = F.struct("cluster", "ord")
    pair = Window.partitionBy("src", "dst", "open")
    p = p.withColumn("first", F.min(at).over(pair)).withColumn("copy", F.row_number().over(pair.orderBy("cluster", "ord")))
    p = p.withColumn("rank", F.dense_rank().over(Window.partitionBy("src", "open").orderBy("first")))
    late = F.when(F.col("rank") > cap, F.lit(f"{REJECTIONS[7]} {cap}")).when(F.col("copy") > 1, F.lit(REJECTIONS[6]))
    scratch = Scratch(proposals.sparkSession, "proposals")
    p = scratch.save(p.select("cluster", "ord", "src", "dst", F.coalesce("early", late).alias("reason")), "p")
    taken = p.where("reason is null")
    base = existing.select("src", "dst", F.struct(F.lit("").alias("cluster"), F.lit(-1).cast("long").alias("ord")).alias("ord"))
    batch = base.unionByName(taken.select("src", "dst", F.struct(F.col("cluster").cast("string").alias("cluster"), F.col("ord").cast("long").alias("ord")).alias("ord")))
    demoted = add_edges(batch).where("demoted").select("src", "dst", F.lit(True).alias("demoted"))
    out = p.join(demoted, ["src", "dst"], "left")
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("demoted"), "demoted").otherwise("accepted")
    return out.select("cluster", "ord", "src", "dst", status.alias("status"), "reason")


def amend(nodes: DataFrame, edges: DataFrame, *, drop: DataFrame | None = None, retarget: DataFrame | None = None, add: DataFrame | None = None, retier: DataFrame | None = None, merge: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Applies amendments in their fixed order: drops, retargets, additions, retiers, merges.

    nodes (id, type, tier), edges (src, dst, rel). ``drop`` (src, dst) removes all relations
    of a pair; ``retarget`` (src, old_dst, dst); ``add`` (src, dst, rel); ``retier`` (id, tier);
    ``merge`` (alias, target). Additions, retiers and merges that name unknown nodes raise one
    error listing them all; a merge whose loser is gone already is fine.
    """
    wrong = []
    known = nodes.select("id").distinct()

    def unknown(frame, column, what):
        missing = frame.select(F.col(column).alias("id")).join(known, "id", "left_anti").distinct().limit(50).collect()
        wrong.extend(f"{what}: {r['id']}" for r in missing)

    if drop is not None:
        edges = edges.join(drop.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    if retarget is not None:
        edges = edges.join(retarget.select("src", F.col("old_dst").alias("dst")).distinct(), ["src", "dst"], "left_anti")
        edges = edges.unionByName(retarget.select("src", "dst", F.lit("requires").alias("rel")))
    if add is not None:
        unknown(add, "src", "add_edges")
        unknown(add, "dst", "add_edges")
        edges = edges.unionByName(add.select("src", "dst", F.coalesce("rel", F.lit("requires")).alias("rel")))
    if retier is not None:
        unknown(retier, "id", "retier")
        nodes = nodes.join(retier.select("id", F.col("tier").alias("_tier")), "id", "left").withColumn("tier", F.coalesce("_tier", "tier")).drop("_tier")
    edges = edges.distinct()
    if merge is not None:
        unknown(merge, "target", "merge")
        edges = merge_nodes(edges, merge)
        nodes = nodes.join(merge.select(F.col("alias").alias("id")), "id", "left_anti")
    if wrong:
        raise ValueError("amendments that can't be applied: " + "; ".join(sorted(set(wrong))))
    return nodes, edges


def reuse_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n): algorithms whose closure holds a node, zeros kept; nodes (id, type)."""
    counts = reachability.counts_above(edges, nodes.where("type = 'algorithm'"))
    return nodes.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
