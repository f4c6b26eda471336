"""Graph operators on small graphs and against plain Python on random ones."""

import random

import pytest

from loomgraph.operators import graph as g


def frame(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


CHAIN = [("e", "d"), ("d", "c"), ("c", "b"), ("b", "a")]


def test_closure_of_a_chain_and_a_cycle(spark):
    got = {(r.src, r.dst): r.hops for r in g.closure(frame(spark, CHAIN)).collect()}
    assert len(got) == 10 and got[("e", "a")] == 4
    ring = g.closure(frame(spark, [("a", "b"), ("b", "c"), ("c", "a")]), ids(spark, "a")).collect()
    assert {(r.src, r.dst, r.hops) for r in ring} == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3)}
    assert g.closure(frame(spark, [])).count() == 0


def test_closure_against_python(spark):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(110)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = set()
    for a in out:
        seen, stack = set(), list(out[a])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        want |= {(a, x) for x in seen}
    assert {(r.src, r.dst) for r in g.closure(frame(spark, pairs)).collect()} == want


def test_syllabus_order_floor_and_cycles(spark):
    e = frame(spark, CHAIN + [("e", "x"), ("d", "x")])
    order = [r.id for r in g.syllabus(e, ids(spark, "e")).orderBy("pos").collect()]
    assert order == ["x", "a", "b", "c", "d"]
    assert [r.id for r in g.syllabus(e, ids(spark, "e"), ids(spark, "bx")).orderBy("pos").collect()] == ["a", "c", "d"]
    assert g.syllabus(e, ids(spark, "a")).count() == 0
    with pytest.raises(Exception, match="cycle"):
        g.syllabus(frame(spark, [("t", "a"), ("a", "b"), ("b", "a")]), ids(spark, "t")).collect()


def test_the_priority_is_taken_again_after_each_pop(spark):
    # p is freed by a and outranks b, which was ready before.
    e = frame(spark, [("t", "a"), ("t", "b"), ("t", "p"), ("p", "a"), ("u", "p"), ("v", "p"), ("w", "a"), ("x", "a"), ("y", "a")])
    assert [r.id for r in g.syllabus(e, ids(spark, "t")).orderBy("pos").collect()] == ["a", "p", "b"]


def test_shortest_chain(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 0), ("b", "d", 2), ("c", "d", 3), ("d", "e", 4)], "src string, dst string, ord long")
    assert [r.id for r in g.shortest_chain(e, "a", "e").orderBy("pos").collect()] == ["a", "c", "d", "e"]
    assert [r.id for r in g.shortest_chain(e, "a", "a").collect()] == ["a"]
    assert g.shortest_chain(e, "e", "a").count() == 0


def test_reduction_keeps_exempt_sources(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    assert {tuple(r) for r in g.transitive_reduction(e).collect()} == {("a", "b"), ("b", "c")}
    assert g.transitive_reduction(e, ids(spark, "a")).count() == 3


def test_aliases_follow_chains_and_end_on_cycles(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "y")], "alias string, target string")
    assert dict(g.resolve_aliases(a).collect()) == {"a": "d", "b": "d", "c": "d", "x": "x", "y": "x", "z": "x"}


def test_adding_edges_demotes_what_closes_a_cycle(spark):
    rng = random.Random(3)
    for trial in range(3):
        batch = []
        for k in range(60):
            a, b = rng.sample(range(12), 2)
            batch.append((a, b, k))
        out, want = {}, {}
        for a, b, _ in batch:
            if (a, b) in want:
                continue
            seen, stack = {b}, [b]
            while stack:
                for n in out.get(stack.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        stack.append(n)
            want[(a, b)] = a in seen
            if a not in seen:
                out.setdefault(a, []).append(b)
        got = {(r.src, r.dst): r.demoted for r in g.add_edges(spark.createDataFrame(batch, "src int, dst int, ord int")).collect()}
        assert got == want and any(want.values())
    with pytest.raises(ValueError):
        g.add_edges(spark.createDataFrame([(1, 1, 0)], "src int, dst int, ord int"))


def test_merging_nodes(spark):
    e = spark.createDataFrame([("a", "b", "requires"), ("c", "b", "requires"), ("a", "c", "requires")], "src string, dst string, rel string")
    m = spark.createDataFrame([("c", "a")], "alias string, target string")
    assert [tuple(r) for r in g.merge_nodes(e, m).collect()] == [("a", "b", "requires")]


def test_depths_levels_orphans_and_cycles(spark):
    e = frame(spark, CHAIN + [("e", "a")])
    assert dict(g.depths(e).collect()) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert dict(g.levels(e, ids(spark, "abcdez"), "e").collect()) == {"e": 0, "d": 1, "a": 1, "c": 2, "b": 3, "z": 4}
    helped = g.levels(e, ids(spark, "abcdez"), "e", ids(spark, "az"), ids(spark, "z"))
    assert dict(helped.collect()) == {"e": 0, "d": 1, "a": 1, "c": 2, "b": 3, "z": 1}
    assert dict(g.levels(e, ids(spark, "ez"), "e", ids(spark, []), ids(spark, "z")).collect())["z"] == 2
    with pytest.raises(g.CycleError):
        g.depths(frame(spark, [("a", "b"), ("b", "a"), ("b", "c")]))
    n = spark.createDataFrame([("a", "assumed"), ("z", "statement"), ("y", None)], "id string, tier string")
    assert {r.id for r in g.orphans(n, e).collect()} == {"z", "y"}


def test_algorithms_under_stops_at_them(spark):
    e = frame(spark, [("s", "c"), ("c", "x"), ("x", "y")])
    assert {tuple(r) for r in g.algorithms_under(e, ids(spark, "xy"), ids(spark, "sx")).collect()} == {("s", "x"), ("x", "x")}


def test_learning_path_is_by_algorithm(spark):
    e = frame(spark, [("m", "b"), ("k", "a"), ("k", "b")])
    path = g.learning_path(e, ids(spark, "mk"), ids(spark, [])).orderBy("pos").collect()
    assert [r.id for r in path] == ["b", "a", "k", "m"]
    nodes = spark.createDataFrame([("a", "assumed"), ("b", "assumed"), ("k", "statement")], "id string, tier string")
    floor = g.floor(nodes, known=ids(spark, "q"), not_known=ids(spark, "b"))
    assert {r.id for r in floor.collect()} == {"a", "q"}
    assert [r.id for r in g.learning_path(e, ids(spark, "k"), floor).orderBy("pos").collect()] == ["b", "k"]
    assert [r.id for r in g.learning_path(e, ids(spark, []), ids(spark, []), ids(spark, "k")).orderBy("pos").collect()] == ["b", "a"]


def test_learning_path_makes_no_syllabus_without_a_cycle(spark, monkeypatch):
    """The path of all algorithms is that of their syllabuses, however small the blocks are that one task orders."""
    rng = random.Random(4)
    own = list(range(1, 70))
    rng.shuffle(own)
    pairs = {(own[i], own[rng.randrange(max(0, i - 12), i)]) for i in range(1, 69) for _ in range(3)}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    goals, known = (spark.createDataFrame([(k,) for k in own[a::b]], "id long") for a, b in ((5, 6), (3, 11)))
    want = [(r.pos, r.id) for r in g._path_of_each(e, goals, known).orderBy("pos").collect()]
    monkeypatch.setattr(g, "syllabus", None)
    for block in (100_000, 2):
        monkeypatch.setattr(g, "BLOCK", block)
        assert [(r.pos, r.id) for r in g.learning_path(e, goals, known).orderBy("pos").collect()] == want


def test_learning_path_past_a_cycle(spark):
    """A cycle through the algorithm alone is none of its prerequisites; another one raises."""
    e = frame(spark, [("k", "a"), ("a", "k"), ("a", "b")])
    assert [r.id for r in g.learning_path(e, ids(spark, "k"), ids(spark, [])).orderBy("pos").collect()] == ["b", "a", "k"]
    with pytest.raises(Exception, match="cycle"):
        g.learning_path(frame(spark, [("m", "k"), ("k", "a"), ("a", "k")]), ids(spark, "m"), ids(spark, [])).collect()


def test_proposals_reject_in_order_and_demoted_edges_use_the_cap(spark):
    nodes = spark.createDataFrame([(x, "concept", "statement") for x in "abcdefgh"] + [("alg", "algorithm", "derivation"), ("floor", "concept", "assumed")], "id string, type string, tier string")
    rows = [("c1", 0, "b", "a"), ("c1", 1, "zz", "a"), ("c1", 2, "a", "zz"), ("c1", 3, "a", "a"), ("c1", 4, "floor", "a"), ("c1", 5, "alg", "a"), ("c1", 6, "a", "h"), ("c1", 7, "b", "a"), ("c2", 0, "a", "b")]
    rows += [("c3", k, "a", x) for k, x in enumerate("cdefg")]
    p = spark.createDataFrame(rows, "cluster string, ord long, src string, dst string")
    out = {(r.cluster, r.ord): (r.status, r.reason) for r in g.merge_proposals(p, nodes, frame(spark, [("a", "h")]), frame(spark, [])).collect()}
    assert [out[("c1", k)][1] for k in range(1, 8)] == ["unknown source id", "unknown target id", "self-edge", "edge out of a floor node", "edge out of a seed algorithm", "dropped by amendment", "duplicate"]
    assert out[("c1", 0)][0] == "accepted" and out[("c2", 0)][0] == "demoted"
    assert [out[("c3", k)][0] for k in range(5)] == ["accepted"] * 4 + ["rejected"] and out[("c3", 4)][1] == "over branching cap of 5"


def test_proposals_against_python(spark):
    """Merged ids, duplicates, the cap and demotions in one sequence, as a loop takes them."""
    rng = random.Random(23)
    names = [f"n{k}" for k in range(14)]
    nodes = [(n, "algorithm" if k == 0 else "concept", "assumed" if k == 1 else "statement") for k, n in enumerate(names)]
    merged = {"m1": "n5", "m2": "m1", "m3": "zz"}
    there = [("n9", "n3"), ("n3", "n12"), ("n5", "n6")]
    gone = {("n4", "n7")}
    rows = [(f"c{k % 4}", k, rng.choice([*names, *merged, "q"]), rng.choice([*names, *merged, "q"])) for k in range(260)]
    out, taken, count, want = {}, set(), {}, {}
    for a, b in there:
        out.setdefault(a, set()).add(b)

    def reaches(a, b):
        seen, stack = {a}, [a]
        while stack:
            for x in out.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return b in seen

    kind = {n: (t, r_) for n, t, r_ in nodes}
    for c, k, a, b in sorted(rows):
        while a in merged:
            a = merged[a]
        while b in merged:
            b = merged[b]
        tests = [(a not in kind, 0), (b not in kind, 1), (a == b, 2), (kind.get(a, "  ")[1] == "assumed", 3), (kind.get(a, "  ")[0] == "algorithm", 4), ((a, b) in gone, 5), ((a, b) in taken, 6), (count.get(a, 0) >= 5, 7)]
        hit = next((i for ok, i in tests if ok), None)
        if hit is not None:
            want[c, k] = ("rejected", g.REJECTIONS[hit] + (" 5" if hit == 7 else ""))
            continue
        taken.add((a, b))
        count[a] = count.get(a, 0) + 1
        want[c, k] = ("demoted" if reaches(b, a) else "accepted", None)
        if want[c, k][0] == "accepted":
            out.setdefault(a, set()).add(b)
    p = spark.createDataFrame(rows, "cluster string, ord long, src string, dst string")
    n = spark.createDataFrame(nodes, "id string, type string, tier string")
    aliases = spark.createDataFrame(list(merged.items()), "alias string, target string")
    got = {(r.cluster, r.ord): (r.status, r.reason) for r in g.merge_proposals(p, n, frame(spark, gone), frame(spark, there), aliases=aliases).collect()}
    assert got == want and {s for s, _ in want.values()} == {"rejected", "accepted", "demoted"}


def test_edges_are_added_under_current_names(spark):
    batch = spark.createDataFrame([("old", "b", 0), ("b", "a", 1)], "src string, dst string, ord int")
    aliases = spark.createDataFrame([("old", "a")], "alias string, target string")
    got = {(r.src, r.dst): r.rel for r in g.add_edges(batch, ids(spark, "ab"), aliases).collect()}
    assert got == {("a", "b"): "requires", ("b", "a"): "related_to"}
    with pytest.raises(KeyError, match="b"):
        g.add_edges(batch, ids(spark, "a"), aliases)


def test_amendments_list_all_that_cannot_be_applied(spark):
    n = spark.createDataFrame([("a", "concept", "statement"), ("b", "concept", "statement")], "id string, type string, tier string")
    e = spark.createDataFrame([("a", "b", "requires")], "src string, dst string, rel string")
    with pytest.raises(ValueError, match="retier: q.*|merge: r"):
        g.amend(n, e, retier=spark.createDataFrame([("q", "claim")], "id string, tier string"), merge=spark.createDataFrame([("a", "r")], "alias string, target string"))
    nodes, edges = g.amend(n, e, drop=frame(spark, [("a", "b")]), add=spark.createDataFrame([("b", "a", None)], "src string, dst string, rel string"), retier=spark.createDataFrame([("b", "claim")], "id string, tier string"))
    assert [tuple(r) for r in edges.collect()] == [("b", "a", "requires")] and {r.id: r.tier for r in nodes.collect()} == {"a": "statement", "b": "claim"}


def test_layer_rules(spark):
    n = spark.createDataFrame([("s", "system"), ("c", "component"), ("x", "algorithm"), ("k", "concept")], "id string, type string")
    e = spark.createDataFrame([("s", "c", "contains"), ("c", "x", "uses"), ("x", "k", "requires"), ("c", "k", "uses"), ("k", "c", "requires"), ("s", "k", "contains"), ("s", "q", "uses")], "src string, dst string, rel string")
    assert {(r.src, r.dst) for r in g.violations(n, e).collect()} == {("c", "k"), ("k", "c"), ("s", "k"), ("s", "q")}
    e = spark.createDataFrame([("s", "x", "contains"), ("c", "k", "requires"), ("k", "x", "requires"), ("x", "k", "requires"), ("x", "s", "contains")], "src string, dst string, rel string")
    assert {(r.rule, r.src, r.dst) for r in g.violations(n, e).collect()} == {("contains outside the architecture", "x", "s"), ("requires on a cycle", "k", "x"), ("requires on a cycle", "x", "k")}
