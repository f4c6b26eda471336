"""Reachability without pairs, against plain Python on random graphs."""

import random
from collections import Counter

import pytest

from loomgraph.operators import graph as g
from loomgraph.operators import profile as p
from loomgraph.operators import reachability as r
from loomgraph.operators import relate


def frame(spark, pairs, kind="long"):
    return spark.createDataFrame(list(pairs), f"src {kind}, dst {kind}")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id long")


def below(pairs):
    """Node -> what a path of one edge or more leads to."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {}
    for a in out:
        seen, stack = set(), list(out[a])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        found[a] = seen
    return found


def some_graph(seed, nodes=70, edges=110, acyclic=False):
    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)}
    return {(max(a, b), min(a, b)) for a, b in pairs if a != b} if acyclic else pairs


@pytest.mark.parametrize("acyclic", [True, False])
def test_pairs_by_index(spark, acyclic):
    pairs = some_graph(4, acyclic=acyclic)
    want = below(pairs)
    every = [(a, b) for a in range(72) for b in range(72)]
    edges = frame(spark, pairs)
    labels = r.index(edges)
    got = {tuple(x) for x in r.holding(frame(spark, every + every[:50]), edges, labels).collect()}
    assert got == {(a, b) for a in want for b in want[a]}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    two = {tuple(x) for x in r.holding(frame(spark, every), edges, labels, least=2).collect()}
    assert two == {(a, b) for a in out for m in out[a] for b in want.get(m, ())}
    # The index alone has to refuse most pairs that no path joins.
    marked = [labels.select([labels["id"].alias(f"{s}id")] + [labels[c].alias(f"{s}{c}") for c in r.LABELS]) for s in ("a_", "b_")]
    allowed = frame(spark, every).join(marked[0], r.F.col("src") == r.F.col("a_id")).join(marked[1], r.F.col("dst") == r.F.col("b_id")).where(r._may("a_", "b_"))
    passed = {tuple(x) for x in allowed.select("src", "dst").collect()}
    apart = {(a, b) for a, b in every if a != b} - got
    assert got - {(a, a) for a in range(72)} <= passed and len(passed & apart) < len(apart) / 3


def test_node_sets_and_words(spark):
    pairs = some_graph(9, nodes=300, edges=400)
    want = below(pairs)
    assert {x.id for x in r.reachable(frame(spark, pairs), ids(spark, [3, 5, 9999])).collect()} == {3, 5, 9999} | want.get(3, set()) | want.get(5, set())
    seeds = spark.createDataFrame([(k, f"s{k % 150}") for k in range(300)], "id long, label string")
    for back in (False, True):
        words, numbers = r.reaching(frame(spark, pairs), seeds, "label", back=back)
        got = {(x.label, x.id) for x in r.unpacked(words).join(numbers, ["bucket", "bit"]).collect()}
        over = below({(b, a) for a, b in pairs}) if back else want
        assert got == {(f"s{k % 150}", d) for k in range(300) for d in {k} | over.get(k, set())}
        assert words.count() < len(got) / 5


@pytest.mark.parametrize("edges", [60, 200])
def test_strong_components(spark, edges):
    pairs = some_graph(edges, nodes=60, edges=edges)
    want = below(pairs)
    least = {a: min(b for b in want[a] if a in want.get(b, ())) for a in want if a in want[a]}
    assert dict(r.strong_components(frame(spark, pairs)).collect()) == least
    lie = {(a, b) for a, b in pairs if a in want.get(b, ())}
    assert {(x.src, x.dst) for x in g.cyclic_edges(frame(spark, pairs)).collect()} == lie


def test_very_many_rings(spark):
    """A hundred thousand rings of three, each with a tail in and a tail out."""
    k = spark.range(100_000).selectExpr("id * 5 as a")
    edges = k.selectExpr("a as src", "a + 1 as dst").union(k.selectExpr("a + 1", "a + 2")).union(k.selectExpr("a + 2", "a")).union(k.selectExpr("a + 3", "a")).union(k.selectExpr("a + 2", "a + 4"))
    found = r.strong_components(edges)
    assert found.count() == 300_000 and found.where("component <> id - id % 5 or id % 5 > 2").count() == 0
    nodes = edges.selectExpr("src as id").union(edges.selectExpr("dst")).distinct().selectExpr("id", "'concept' as type")
    assert g.violations(nodes, edges.selectExpr("src", "dst", "'requires' as rel")).count() == 300_000


def test_no_edges_at_all(spark):
    none = frame(spark, [])
    assert r.strong_components(none).count() == 0 and r.index(none).count() == 0
    assert r.holding(frame(spark, [(1, 2)]), none).count() == 0 and g.depths(none).count() == 0
    assert dict(g.depths(none, ids(spark, [7])).collect()) == {7: 0}
    assert {x.id for x in r.reachable(none, ids(spark, [1])).collect()} == {1}


def test_depth_of_a_long_chain(spark):
    got = dict(g.depths(frame(spark, [(k + 1, k) for k in range(90)] + [(90, 3)])).collect())
    assert got == {k: k for k in range(91)}


@pytest.mark.parametrize("hub", [1000, 2])
def test_reduction_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(g, "HUB", hub)
    pairs = some_graph(12, nodes=40, edges=150, acyclic=True)
    want = below(pairs)
    kept = {(a, b) for a, b in pairs if not any(m != b and (a, m) in pairs and b in want.get(m, ()) for m in range(40))}
    assert {tuple(x) for x in g.transitive_reduction(frame(spark, pairs)).collect()} == kept


@pytest.mark.parametrize("popular, acyclic", [(1000, True), (3, True), (3, False)])
def test_reduction_asks_no_index(spark, monkeypatch, popular, acyclic):
    """Questions go as packed labels, of ends that many ask for upwards; no search of pairs."""
    monkeypatch.setattr(g, "POPULAR", popular)
    monkeypatch.setattr(r, "index", None)
    pairs = some_graph(13, nodes=40, edges=150, acyclic=acyclic)
    found, n = below(pairs), Counter(a for a, _ in pairs)  # an only edge stays, cycle or not
    kept = {(a, b) for a, b in pairs if n[a] == 1 or not any((a, m) in pairs and b in found.get(m, ()) for m in range(40))}
    assert {tuple(x) for x in g.transitive_reduction(frame(spark, pairs)).collect()} == kept


def test_reopens_reach_entries_from_both_sides(spark):
    rng = random.Random(8)
    pairs = some_graph(21, nodes=200, edges=320)
    over = below({(b, a) for a, b in pairs})
    events = [(rng.randrange(30), rng.randrange(200), k, f"t{k}", rng.choice(["mark", "mark", "reopen", "deny"]), rng.choice(["declared", "read"])) for k in range(3000)]
    last = {}
    marked = {(u, n) for u, n, _, _, action, _ in events if action == "mark"}
    for u, n, k, at, action, _ in events:
        if action == "reopen":
            for d in over.get(n, ()):
                if (u, d) in marked:
                    last[u, d] = max(last.get((u, d), (-1, "")), (k, at))
    frame_ = spark.createDataFrame(events, "user long, node long, ord long, at string, action string, state string")
    assert {(x.user, x.node): (x.ord, x.at) for x in p.suspicions(frame_, frame(spark, pairs)).collect()} == last and len(last) > 100


def test_components_reaching_of_a_project(spark):
    uses = spark.createDataFrame([("rig.a", 1), ("rig.b", 2), ("other", 1)], "component string, algorithm long")
    edges = frame(spark, [(1, 5), (5, 6), (2, 6), (7, 1)])
    got = {tuple(x) for x in relate.components_reaching(uses, edges, "rig").collect()}
    assert got == {("rig.a", 1), ("rig.a", 5), ("rig.a", 6), ("rig.b", 2), ("rig.b", 6)}
    assert relate.components_reaching(uses, edges).count() == 8


@pytest.mark.parametrize("rows", [10_000, 3])
def test_components_of_hubs(spark, monkeypatch, rows):
    """A star, a path and random edges; with a low bound most vertices and labels count as hot."""
    from loomgraph.operators.components import connected_components
    from loomgraph.sources import tables

    monkeypatch.setattr(tables, "HOT_ROWS", rows)
    rng = random.Random(5)
    pairs = [(1000, k) for k in range(200)] + [(k, k + 1) for k in range(300, 340)] + [(400 + rng.randrange(80), 400 + rng.randrange(80)) for _ in range(60)]
    root = {v: v for p_ in pairs for v in p_}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert dict(got.collect()) == {v: find(v) for v in root}


def test_many_labels_go_layer_by_layer_and_cycles_in_rounds(spark, monkeypatch):
    """Layers send each word along each step once; both ways list the same pairs and counts."""
    rounds = []
    plain = r.spread
    monkeypatch.setattr(r, "MANY", 70)
    monkeypatch.setattr(r, "spread", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    edges = [(k, k // 2) for k in range(2, 90)] + [(k, k * 7919 % k if k % 5 else k // 3) for k in range(3, 90)]
    for extra in ([], [(1, 80)]):
        want = below(edges + extra)
        e = frame(spark, edges + extra)
        rounds.clear()
        assert sorted(map(tuple, r.pairs(e).collect())) == sorted((a, b) for a in want for b in want[a])
        assert bool(rounds) == bool(extra)
        if extra:
            continue
        assert {x.id: x.n for x in r.counts_below(e).collect()} == {a: len(b) for a, b in want.items()}
        roots = spark.createDataFrame([(k,) for k in range(20, 90, 3)], "id long")
        above = {}
        for a in range(20, 90, 3):
            for b in want[a]:
                above[b] = above.get(b, 0) + 1
        assert {x.id: x.n for x in r.counts_above(e, roots).collect()} == above


def test_mean_curve_counts_items_of_the_same_seeds_together(spark):
    """A thousand items held by the same seeds go through the trials as one; a null item counts as one, a null seed holds nothing."""
    import hashlib

    from loomgraph.operators import windows as w

    held = {("s%d" % s, "i%d" % i) for i in range(1000) for s in range(4) if i % 3 == 0 and s < 2 or i % 3 == 1 and s > 0} | {("s3", None), ("s2", "x")}
    rows = spark.createDataFrame([*held, (None, "lost")], "seed string, item string")
    seeds, want = [None, *sorted({s for s, _ in held})], {}
    for t in range(20):
        order = sorted(seeds, key=lambda s: (hashlib.md5(":".join(x for x in ("7", str(t), s) if x is not None).encode()).hexdigest(), s or ""))
        seen = set()
        for k, s in enumerate(order, 1):
            seen |= {i for o, i in held if o == s}
            want[k] = want.get(k, 0) + len(seen) / 20
    curve = w.mean_curve(rows, 20)
    assert {r.k: round(r.mean_size, 6) for r in curve.collect()} == {k: round(v, 6) for k, v in want.items()}
    assert "bit_xor" in curve._jdf.queryExecution().toString()


def test_build_scope_takes_nodes_and_no_pairs(spark, monkeypatch):
    from loomgraph.operators import architecture

    monkeypatch.setattr(g, "closure", None)
    got = architecture.build_scope(ids(spark, [5, 7, 7, 99, None]), frame(spark, [(5, 4), (4, 3), (3, 5), (8, 7), (7, 3)]))
    assert sorted((x.id for x in got.collect()), key=str) == sorted([5, 7, 99, None, 4, 3], key=str)


def test_families_take_the_first_label_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(g, "closure", None)
    own = spark.createDataFrame([("f%d" % k, k, k) for k in range(70)] + [("a", 200, 0), ("z", 300, 69)], "family string, root long, prio int")
    edges = frame(spark, [(k, 400) for k in range(63, 70)] + [(300, 401), (69, 401), (200, 402), (0, 402), (402, 403)])
    got = {x.id: x.family for x in relate.families(ids(spark, [400, 401, 402, 403, 5, 999, 300]), own, edges).collect()}
    assert got == {400: "f63", 401: "f69", 402: "a", 403: "a", 5: "f5", 300: "z"}


def test_vocabulary_keeps_no_more_of_a_target_than_its_list(spark, monkeypatch):
    from loomgraph.operators import generation

    monkeypatch.setattr(g, "closure", None)
    nodes = spark.createDataFrame([(k, "concept") for k in range(30)], "id long, type string")
    edges = frame(spark, [(k, k - 1) for k in range(1, 12)] + [(20, 11), (21, 2)])
    got = {}
    for x in generation.candidate_vocabulary(edges, nodes, ids(spark, [20, 21, 25]), ("0",), few=4, limit=5).collect():
        got.setdefault(x.target, {})[x.place] = x.id
    assert got == {20: dict(enumerate((1, 2, 3, 4, 5), 1)), 21: dict(enumerate(range(5), 1)), 25: dict(enumerate(range(5), 1))}


def test_holes_of_few_items_ask_no_index(spark, monkeypatch):
    from loomgraph.operators import quality

    edges = some_graph(5, nodes=30, edges=45)
    asked = [(a, b) for a in range(30) for b in range(0, 30, 4)] + [(3, 77), (88, 4)]
    want = sorted((a, b) for a, b in asked if a != b and b != 8 and b not in below(edges).get(a, ()))
    monkeypatch.setattr(r, "index", None)
    got = quality.holes(spark.createDataFrame(asked, "id long, item long"), frame(spark, edges), ids(spark, [8]))
    assert sorted(map(tuple, got.collect())) == want


def test_owners_from_pairs_that_end_at_owners_alone(spark, monkeypatch):
    """Titles and sections may repeat; only prerequisites with a pinned document are listed."""
    from loomgraph.operators import records

    monkeypatch.setattr(g, "closure", None)
    reach = r.pairs(frame(spark, [(3, 2), (2, 1), (3, 1), (4, 3)]), ids(spark, [3, 4]), ids(spark, [1, 3, 3]))
    assert sorted(map(tuple, reach.collect())) == [(3, 1), (4, 1), (4, 3)]
    titles = spark.createDataFrame([(1, "d#x"), (1, "d#y"), (3, "e#x")], "id long, title string")
    documents = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", "2")], "document string, section string")
    got = records.owners(reach.withColumnsRenamed({"src": "id", "dst": "needs"}), titles, documents)
    assert sorted(map(tuple, got.collect())) == [(3, 1, "d", "1"), (3, 1, "d", "2"), (4, 1, "d", "1"), (4, 1, "d", "2")]


def test_layers_read_their_band_alone_and_bits_become_rows_in_one_loop(spark, monkeypatch):
    """A layer's job reads no more than the tables of its band, whatever lies above; labels are listed without interpreted lambdas."""
    import re

    read, save = {}, r.Scratch.save

    def spy(self, frame, name, width=None):
        if re.fullmatch(r"layer\d+", name):
            read[name] = {t for f in frame.inputFiles() for t in re.findall(r"/(layer\d+)/", f)}
        return save(self, frame, name, width)

    monkeypatch.setattr(r, "MANY", 2)
    monkeypatch.setattr(r.Scratch, "save", spy)
    edges = [(k, k - 1) for k in range(1, 16)] + [(k, k * 7919 % k if k % 2 else k // 3) for k in range(2, 16)] + [(40, 15), (41, 15)]
    want = below(edges)
    uses = spark.createDataFrame([(f"c{k % 7}", k) for k in [*range(3, 16), 40, 41, 77] * 2], "component string, algorithm long")
    got = relate.components_reaching(uses, frame(spark, edges))
    assert sorted(map(tuple, got.collect())) == sorted({(f"c{k % 7}", d) for k in [*range(3, 16), 40, 41, 77] for d in {k} | want.get(k, set())})
    assert len(read) == 17 and max(map(len, read.values())) < 6
    assert not re.search(r"lambdafunction\([^,]*getbit", got._jdf.queryExecution().toString())


def test_tables_of_many_nodes_are_not_broadcast_because_their_files_are_small(spark, tmp_path):
    from loomgraph.sources.tables import small

    def joins(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        return {k for k in ("BroadcastHashJoin", "SortMergeJoin") if k in plan}

    spark.range(1000).write.parquet(f"{tmp_path}/ids")
    every = spark.read.parquet(f"{tmp_path}/ids")
    edges = every.selectExpr("id src", "id div 2 dst")
    assert joins(r._sources(edges, every)) == {"SortMergeJoin"} and r._sources(edges, every).count() == 1000
    assert joins(edges.join(small(every.withColumnRenamed("id", "src"), 999), "src")) == {"SortMergeJoin"}
    assert joins(edges.join(small(every.withColumnRenamed("id", "src"), 1000), "src")) == {"BroadcastHashJoin"}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_documents_of_owners_go_with_the_packed_labels(spark, monkeypatch, few):
    """A title stands for its document; titles and sections may repeat, and a node may have two documents."""
    from loomgraph.operators import records

    monkeypatch.setattr(r, "INTO", few)
    monkeypatch.setattr(r, "NAMED", few)
    titles = spark.createDataFrame([(1, "d#x"), (1, "d#y"), (1, "e"), (3, "none#x"), (2, "e#x"), (9, "d")], "id long, title string")
    documents = spark.createDataFrame([("d", "1"), ("d", "1"), ("d", "2"), ("e", "7")], "document string, section string")
    got = records.owners_below(frame(spark, [(3, 2), (2, 1), (3, 1), (4, 3)]), ids(spark, [3, 4, 4]), titles, documents)
    assert got.columns == ["id", "owner", "document", "section"]
    assert sorted(map(tuple, got.collect())) == sorted((k, *x) for k in (3, 4) for x in [(1, "d", "1"), (1, "d", "2"), (1, "e", "7"), (2, "e", "7")])


def test_parts_of_an_export_are_not_broadcast_because_their_files_are_small(spark, tmp_path):
    from loomgraph.sources import sinks

    spark.range(40).write.parquet(f"{tmp_path}/ids")
    every = spark.read.parquet(f"{tmp_path}/ids")
    nodes = every.selectExpr("id", "'n' name", "'concept' type", "if(id = 3, 'claim', 'assumed') tier")
    parts = [every.where("id < 30").selectExpr("id", f"id {name}") for name in ("depth", "n", "cost")]
    profile, notes = every.where("id % 2 = 0").selectExpr("id", "'read' state"), every.where("id % 3 = 0").selectExpr("id", "if(id = 3, 'mine', 'other') project", "'so' why")
    got = sinks.export_nodes(nodes, *parts, profile, notes, "mine")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(k, k if k < 30 else 0, "" if k % 2 else "read", 0 if k % 2 else 2, "so" if k == 3 else None, 3 if k == 3 else 0) for k in range(40)}
    assert {(x.id, x.depth, x.state, x.state_rank, x.why, x.tier_rank) for x in got.collect()} == want
    assert all(x.depth == x.reuse == x.cost for x in got.collect())
