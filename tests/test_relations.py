"""Joins, windows, guards, state and exercises on small relations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as t
from loomgraph.operators import architecture, exercises, generation
from loomgraph.operators import profile as p
from loomgraph.operators import quality as q
from loomgraph.operators import relate as r
from loomgraph.operators import windows as w

ENDS = "component string, topic string, role string, evidence string, ord long"


def one(spark, column, **values):
    f = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))
    return f.select(column.alias("x")).first()["x"]


def test_links_and_one_sided(spark):
    ends = spark.createDataFrame(
        [("a", "t", "publishes", "e2", 2), ("a", "t", "publishes", "e1", 1), ("b", "t", "subscribes", "s1", 3), ("b", "t", "subscribes", "s2", 4), ("a", "t", "subscribes", "self", 5), ("c", "u", "publishes", "x", 6), ("d", "v", "subscribes", "y", 7), ("f", "w", "both", "z", 8)],
        ENDS,
    )
    assert [tuple(x) for x in r.links(ends).collect()] == [("a", "b", "t", "e1", "s1")]
    unread, unfed = r.one_sided(ends)
    assert {x.topic for x in unread.collect()} == {"u"} and {x.topic for x in unfed.collect()} == {"v"}


def test_topic_resolution(spark):
    maps = F.array(F.struct(F.lit("/in").alias("inside"), F.lit("first").alias("outside")), F.struct(F.lit("in").alias("inside"), F.lit("/last").alias("outside")))
    assert one(spark, r.resolve_topic(F.col("n"), maps), n="in") == "/last"
    assert one(spark, r.resolve_topic(F.col("n"), maps), n="other") == "/other"


def test_endpoint_sources(spark):
    kind = f"component string, executable string, argument string, remappings {r.REMAPPINGS}, ord long"
    a = spark.createDataFrame([("c", "parameter_bridge", "/t@a/B[c.D", [], 0), ("c", "parameter_bridge", "u@a/B]c.D", [("/u", "x")], 1), ("c", "parameter_bridge", "v@a/B@c.D", [], 2), ("c", "parameter_bridge", "--flag", [], 3), ("d", "other", "w@a/B[c.D", [], 4)], kind)
    assert {(x.topic, x.role) for x in r.bridge_endpoints(a).collect()} == {("/t", "publishes"), ("/x", "subscribes"), ("/v", "publishes"), ("/v", "subscribes")}
    kind = f"component string, name string, value string, source string, remappings {r.REMAPPINGS}, ord long"
    params = spark.createDataFrame([("c", "output", "'/cmd'", "p.yaml", [("cmd", "/go")], 0), ("c", "scan", " /scan ", "p.yaml", [], 1), ("c", "rate", "5", "p.yaml", [], 2), ("c", "router", "/in", "p.yaml", [], 3)], kind)
    assert {(x.topic, x.role, x.evidence) for x in r.parameter_endpoints(params).collect()} == {("/go", "publishes", "p.yaml output"), ("/scan", "subscribes", "p.yaml scan"), ("/in", "subscribes", "p.yaml router")}
    comps = spark.createDataFrame([("c", "lib", "exe", [("scan", "/front")])], f"component string, library string, executable string, remappings {r.REMAPPINGS}")
    defaults = spark.createDataFrame([("lib/exe", "scan", "subscribes", 0)], "key string, topic string, role string, ord long")
    found = r.library_endpoints(comps, defaults).first()
    assert found["topic"] == "/front" and found["evidence"] == "lib/exe default 'scan'"
    code = "class N:\n  def __init__(self):\n    self.create_publisher(T, 'scan', 10)\n    self.create_subscription(T, topic='/imu', callback=f)\n    self.create_publisher(T, name, 1)\n    create_publisher(T, 'free')\n"
    files = spark.createDataFrame([("src/exe.py", code), ("src/other.py", code), ("bad/exe.py", "def (")], "path string, text string")
    assert {(x.component, x.topic, x.role, x.evidence) for x in r.code_endpoints(comps, files).collect()} == {("c", "/front", "publishes", "src/exe.py:3 create_publisher"), ("c", "/imu", "subscribes", "src/exe.py:4 create_subscription")}


def test_containment_in_lots_agrees_with_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc.") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts = ["".join(rng.choice("abc.") for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["é" + "a" * 20]
    needles = spark.createDataFrame([(x,) for x in sorted(set(words))], "w string")
    hay = spark.createDataFrame([(x,) for x in sorted(set(texts))], "x string")
    want = {(x, w_) for x in texts for w_ in words if w_ and w_ in x}
    for at_once in (1000, 1):
        got = r.containing(needles, "w", hay, "x", at_once)
        assert sorted((y.x, y.w) for y in got.collect()) == sorted(want)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_launch_files_find_their_nodes(spark):
    comps = spark.createDataFrame([("a", "launch/nav.launch.py"), ("b", "config/nav.yaml"), ("c", "x/rsp.launch.xml")], "component string, source string")
    nodes = spark.createDataFrame(
        [("n1", "nav.launch.py", "launch/nav.launch.py", True, False), ("n2", "main", "launch/nav.launch.py", True, False), ("n3", "started by nav.launch.py here", "README", False, False), ("n4", "rsp.launch.xml", "x/rsp.launch.xml", True, True), ("n5", "the rsp.launch.xml", None, False, False)],
        "id string, label string, source_file string, deterministic boolean, external boolean",
    )
    from loomgraph.operators import records

    assert {tuple(x) for x in records.launched_by(comps, nodes).collect()} == {("a", "n1"), ("a", "n3"), ("c", "n5")}


def test_flows_leave_a_component_and_are_confirmed_by_topics(spark):
    edges = spark.createDataFrame([("m", "c", "calls", "X", 0), ("m", "o", "calls", "X", 1), ("o", "m", "calls", "Y", 2), ("c", "q", "contains", "X", 3), ("c", "lib", "calls", "X", 4), ("c", "gone", "calls", "X", 5), ("q", "c", "rationale_for", "Z", 6)], "src string, dst string, relation string, confidence string, ord long")
    owners = spark.createDataFrame([("A", "m"), ("A", "c"), ("B", "o"), ("C", "q")], "component string, id string")
    nodes = spark.createDataFrame([("m", False), ("c", False), ("o", False), ("q", False), ("lib", True)], "id string, external boolean")
    flow = r.flows(edges, owners, nodes)
    assert {(x.component, x.src, x.dst, x.relation, x.other) for x in flow.collect()} == {("A", "m", "o", "calls", "o"), ("B", "m", "o", "calls", "m"), ("A", "q", "c", "rationale_for", "q"), ("C", "q", "c", "rationale_for", "c")}
    linked = spark.createDataFrame([("B", "A", "/t", "", ""), ("A", "B", "/s", "", "")], "pub string, sub string, topic string, pub_evidence string, sub_evidence string")
    assert {tuple(x) for x in r.confirm_flows(flow, owners, linked).collect()} == {("A", "B", "calls", "X", "/s,/t", True), ("A", "C", "rationale_for", "Z", "", False)}


def test_name_matching(spark):
    comps = spark.createDataFrame([("SmacPlanner", "planner"), ("Other", "planner"), ("solo", "solo_node")], "component string, executable string")
    files = spark.createDataFrame([("src/smac_planner.cpp",), ("src/planner.cpp",), ("a/solo_node.py",)], "file string")
    assert {tuple(x) for x in r.stem_matches(comps, files).collect()} == {("SmacPlanner", "src/smac_planner.cpp"), ("solo", "a/solo_node.py")}
    names = spark.createDataFrame([("SmacPlanner",), ("ekf",)], "name string")
    labels = spark.createDataFrame([("the planner called smac",), ("runs ekf",), ("smacplanner here",), ("smac only",)], "label string")
    assert r.label_matches(names, labels).count() == 3


def test_priority_lookup_stops_at_an_empty_list(spark):
    table = spark.createDataFrame([("lib/exe", []), ("lib", ["ekf"]), ("plug", ["mpc"])], "key string, items array<string>")
    comps = spark.createDataFrame([("a", None, "lib", "exe"), ("b", None, "lib", "other"), ("c", "plug", "lib", "exe"), ("d", None, "none", "x")], "component string, plugin string, library string, executable string")
    domains = spark.createDataFrame([("ekf", "Localisation")], "algorithm string, subsystem string")
    got = {x.component: (x.subsystem, x.unclassified) for x in architecture.propose(comps, table, domains).collect()}
    assert got == {"a": (None, True), "b": ("Localisation", False), "c": ("Other", False), "d": (None, True)}


def test_gate_and_attachment(spark):
    ok = spark.createDataFrame([("My Node", ["ekf"], "Localisation", False)], "component string, algorithms array<string>, subsystem string, unclassified boolean")
    with pytest.raises(architecture.NotConfirmed):
        architecture.gate(ok, False)
    with pytest.raises(architecture.NotConfirmed, match="My Node"):
        architecture.gate(ok.withColumn("unclassified", F.lit(True)), True)
    nodes = spark.createDataFrame([("ekf", "algorithm")], "id string, type string")
    n, e = architecture.attach(architecture.gate(ok, True), nodes, "robot")
    assert {x.id for x in n.collect()} == {"robot", "robot__localisation", "robot__my_node"}
    assert {(x.src, x.dst, x.rel) for x in e.collect()} == {("robot", "robot__localisation", "contains"), ("robot__localisation", "robot__my_node", "contains"), ("robot__my_node", "ekf", "uses")}
    with pytest.raises(ValueError, match="ekf"):
        architecture.attach(ok, nodes.limit(0), "robot")


def test_evidence_claims_by_proximity(spark):
    lines = [("d", "a.py", 0, k, "rate here" if k in (3, 6, 20) else "planner" if k in (5, 15) else "-") for k in range(1, 25)]
    f = spark.createDataFrame(lines, "doc string, path string, rank int, ln int, text string")
    terms = spark.createDataFrame([("rate", 2, 0), ("planner", 1, 1)], "term string, strength int, prio int")
    got = r.evidence(f, terms).orderBy("place").collect()
    assert [(x.term, x.ln, x["first"], x["last"]) for x in got] == [("rate", 3, 1, 8), ("planner", 15, 10, 20)]


def test_evidence_is_folded_by_columns_and_agrees_with_a_loop(spark):
    rng = random.Random(9)
    terms = [("ab", 2, 0), ("ba", 2, 1), ("aa", 1, 2), ("bb", 1, 3), ("b", 1, 4)]
    lines = [(d, f"f{f}.py", f, k, "".join(rng.choice("abc-") for _ in range(4))) for d in "xyz" for f in (0, 1) for k in range(1, 60)]
    want = set()
    for d in "xyz":
        spans = []
        for f in (0, 1):
            claimed = []
            for term, strength, _ in terms:
                free = [k for dd, _, ff, k, text in lines if (dd, ff) == (d, f) and term in text and all(abs(k - c) > 5 for c in claimed)]
                if free:
                    claimed.append(free[0])
                    spans.append((f, -strength, f"f{f}.py", free[0], term))
        want |= {(d, path, ln, term, k) for k, (_, _, path, ln, term) in enumerate(sorted(spans)[:3], 1)}
    f = spark.createDataFrame(lines, "doc string, path string, rank int, ln int, text string")
    out = r.evidence(f, spark.createDataFrame(terms, "term string, strength int, prio int"))
    assert {(x.doc, x.path, x.ln, x.term, x.place) for x in out.collect()} == want
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_gathered_in_tasks_of_bounded_size(spark, monkeypatch):
    """Pairs cost the shuffle one id, however few fit a task or a list, and are those of the join."""
    rng = random.Random(6)
    rows = sorted({(rng.randrange(30), rng.randrange(9) ** 2 // 8, rng.choice(["publishes", "subscribes", "both"])) for _ in range(300)})
    ends = spark.createDataFrame([(c, t, role, f"e{k}", k) for k, (c, t, role) in enumerate(rows)], "component long, topic long, role string, evidence string, ord long")
    want = sorted(tuple(x) for x in r.topic_edges(r.links(ends)).collect())
    on = {(c, t) for c, t, _ in rows}
    shared = sorted((a, b, sum((a, t) in on and (b, t) in on for t in range(9))) for a in range(30) for b in range(a + 1, 30))
    for pairs, listed in ((4_000_000, 2_000), (40, 3)):
        monkeypatch.setattr(r, "PAIRS", pairs)
        monkeypatch.setattr(r, "LISTED", listed)
        assert sorted(tuple(x) for x in r.topic_edges_of(ends).collect()) == want
        assert sorted(tuple(x) for x in r.dataflow(ends).collect()) == [x for x in shared if x[2]]


def test_sections_and_notation(spark):
    refs = spark.createDataFrame([(1, "3.1", "see there"), (2, "3.1.2", "see ekf"), (3, "9", "no"), (4, "3", "x")], "ref_id int, number string, text string")
    owners = spark.createDataFrame([("ekf", "kalman", "3.1", 1), ("mpc", "control", "3.2", 2)], "owner string, name string, section string, prio int")
    assert {(x.ref_id, x.owner) for x in r.section_owners(refs, owners).collect()} == {(1, "ekf"), (4, "ekf")}
    symbols = spark.createDataFrame([("n", r"\mathbf{x}_k", "the control input", "F"), ("n", "q", "state", "F")], "id string, symbol string, meaning string, family string")
    conv = spark.createDataFrame([("F", "x", "state", 1), ("F", "u", "control|input", 2)], "family string, letter string, pattern string, prio int")
    assert [tuple(x) for x in r.notation_conflicts(symbols, conv).collect()] == [("n", r"\mathbf{x}_k", "u")]


def test_stale_paths(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "path string, hash string")
    b = spark.createDataFrame([("x", "2"), ("y", "1"), ("n", "1")], "path string, hash string")
    assert {x.path: x.state for x in r.stale_paths(a, b).collect()} == {"x": "changed", "n": "new"}


def test_best_window_against_python(spark):
    rng = random.Random(5)
    docs = [(100, None), (101, ""), (102, "\n \t\n" * 80)]
    for k in range(60):
        docs.append((k, "\n".join(rng.choice(["", "\t ", "a" * rng.randint(1, 60), "x = y " * rng.randint(1, 5), "proof of it", " == Derivation ==", "= Deriving x"]) for _ in range(rng.randint(1, 25)))))
    got = {x.doc: (x["first"], x["last"], x.score, x.headed) for x in w.best_window(spark.createDataFrame(docs, "doc int, text string"), ["proof"], 120).collect()}
    for k, text in docs:
        text = text or ""

        def score(s):
            heading = s.strip().startswith("=") and s.strip().lstrip("=").strip().lower().startswith(("proof", "derivation", "deriving"))
            return 3 * ("proof" in s.lower()) + s.count("=") + s.count("\\") + 400 * heading

        ps = text.split("\n")
        if len(text) <= 120:
            assert got[k] == (1, len(ps), sum(map(score, ps)), False)
            continue
        ps = [s for s in ps if s.strip()]
        room = max(120 - len("\n".join(ps[:2])), 60)
        best = (-1, 0, 1)
        for i in range(len(ps)):
            used, j = 0, i
            while j < len(ps) and used + len(ps[j]) <= room:
                used += len(ps[j]) + 1
                j += 1
            if j > i and sum(map(score, ps[i:j])) > best[0]:
                best = (sum(map(score, ps[i:j])), i, j)
        assert got[k] == (best[1] + 1, best[2], max(best[0], 0), best[1] > 2), (k, ps)


def test_a_heading_outweighs_formulas(spark):
    text = "\n".join(["intro one", "intro two", "x = y = z = w " * 20, "plain " * 20, "== Derivation ==", "so it follows " * 5, "end " * 30])
    row = w.best_window(spark.createDataFrame([(1, text)], "doc int, text string"), budget=200).first()
    assert (row["first"], row["last"], row["headed"]) == (4, 5, True) and row["score"] >= 400


def test_windows_on_small_rows(spark):
    rows = spark.createDataFrame([("a", k, c) for k, c in enumerate([3, 4, 5, 1])], "g string, k int, c int")
    assert [x.k for x in w.budget_take(rows, "g", "k", F.col("c"), 8).collect()] == [0, 1]
    assert [x.k for x in w.capped(rows, "g", ["k"], 2).collect()] == [0, 1]
    heads = spark.createDataFrame([("d", 1, 2), ("d", 5, 3), ("d", 9, 2), ("d", 12, 1)], "doc string, pos long, level int")
    assert {x.pos: x.stop for x in w.extents(heads).collect()} == {1: 9, 5: 9, 9: 12, 12: None}
    kinds = spark.createDataFrame([("p", "x", 1), ("p", "x", 2), ("p", "y", 3), ("p", "x", 4)], "g string, kind string, o int")
    assert [x.o for x in w.round_robin(kinds, "g", "kind", "o", 3).orderBy("place").collect()] == [1, 3, 2]
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c")], "pos int, item string")
    assert [(x.canon_size, x.added, x.added_pct) for x in w.saturation(items).orderBy("pos").collect()] == [(2, 2, 100.0), (2, 0, 0.0), (3, 1, 50.0)]
    assert one(spark, w.common_prefix(F.col("n")), n=["smac_a", "smac_bc", "smac_"]) == "smac_"


def test_mean_curve_uses_the_stated_orders(spark):
    import hashlib

    items = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s2", "b"), ("s3", "c")], "seed string, item string")
    got = {x.k: x.mean_size for x in w.mean_curve(items, trials=20).collect()}
    total = {1: 0, 2: 0, 3: 0}
    have = {"s1": {"a", "b"}, "s2": {"b"}, "s3": {"c"}}
    for trial in range(20):
        order = sorted(have, key=lambda s: hashlib.md5(f"7:{trial}:{s}".encode()).hexdigest())
        for k in (1, 2, 3):
            total[k] += len(set().union(*(have[s] for s in order[:k])))
    assert got == {k: v / 20 for k, v in total.items()}


def test_passages_without_terms_and_with_other_white_space(spark):
    long = "the tion " * 12
    docs = spark.createDataFrame([(1, f"\t{long}\r\nshort\n \t" + "x" * 79 + "\t\t")], "doc int, text string")
    assert w.passages(docs, []).count() == 0
    assert [(x.pos, x.passage) for x in w.passages(docs, ["tion", "x"]).collect()] == [(0, long.strip())]


def test_masks_and_exercises(spark):
    steps = spark.createDataFrame([("d", 1, "alpha beta gamma"), ("d", 2, "beta delta epsilon zeta"), ("d", 3, "by step 1 we get alpha")], "doc string, n int, text string")
    u = w.unique_tokens(steps.withColumnRenamed("n", "item"))
    masks = w.rank_masks(u)
    assert [x.item for x in masks.orderBy("place").collect()][0] == 2
    leaks = w.forward_leaks(steps)
    assert [(x.n, x.leak) for x in leaks.collect()] == [(1, 3)]
    odd = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "misstep 1, Step2 and STEP  02"), ("d", 4, "step 1.5 steps 2")], "doc string, n int, text string")
    assert sorted((x.n, x.leak) for x in w.forward_leaks(odd).collect()) == [(1, 4), (2, 3)]
    ex = exercises.step_exercises(steps, leaks, spark.createDataFrame([("d", 1, 1)], "doc string, item int, place int")).first()
    assert ex.question == "[1] ???\n[2] beta delta epsilon zeta\n[3] ???" and ex.answer == "alpha beta gamma"
    sym = spark.createDataFrame([("d", 1, "x, y", "the state of it"), ("d", 2, "u", "some control input value")], "doc string, item int, symbol string, meaning string")
    su = w.unique_tokens(sym.select("doc", "item", F.col("meaning").alias("text")))
    by_symbol = exercises.symbol_exercises(sym, spark.createDataFrame([("d", "x evolves")], "doc string, statement string"), su)
    assert by_symbol.count() >= 1
    sheet = exercises.worksheet(exercises.exercises_for(ex and exercises.step_exercises(steps, leaks, masks), by_symbol)).first()["worksheet"]
    assert sheet.startswith("# Questions\n1. ") and "# Answers" in sheet


def test_profile_fold_against_python(spark):
    rng = random.Random(9)
    edges = spark.createDataFrame([(3, 2), (2, 1)], "src long, dst long")
    rows = []
    for k in range(600):
        a = rng.choice(["mark", "mark", "mark", "deny", "reopen"])
        rows.append((rng.randrange(8), rng.randrange(1, 4), k, f"t{k:04}", a, rng.choice(p.STATES) if a == "mark" else None))
    events = spark.createDataFrame(rows, "user long, node long, ord long, at string, action string, state string")
    got = {(x.user, x.node): (x.state, x.at, x.suspect, x.denied) for x in p.fold(p.with_suspicions(events, edges)).collect()}
    entry, denied = {}, {}
    up = {1: (2, 3), 2: (3,), 3: ()}
    for u, n, _, at, a, s in rows:
        if a == "mark":
            denied.pop((u, n), None)
            old = entry.get((u, n))
            if old and p.STATES.index(old[0]) > p.STATES.index(s):
                entry[(u, n)] = (old[0], old[1], False)
            else:
                entry[(u, n)] = (s, at, False)
        else:
            entry.pop((u, n), None)
            if a == "deny":
                denied[(u, n)] = True
            for d in up[n] if a == "reopen" else ():
                if (u, d) in entry:
                    entry[(u, d)] = (*entry[(u, d)][:2], True)
    want = {k: (*entry.get(k, (None, None, False)), denied.get(k, False)) for k in entry.keys() | denied.keys()}
    assert got == want


def test_guards(spark):
    cites = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1")], "id string, cite string")
    src = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, source string")
    assert {tuple(x) for x in q.ungrounded(cites, src).collect()} == {("a", "s2"), ("b", "s1")}
    claims = spark.createDataFrame([("a", ["f", "g"]), ("b", []), ("c", None), ("d", ["f"])], "id string, evidence array<string>")
    assert {x.id: x.missing for x in q.unsupported(claims, spark.createDataFrame([("f",)], "path string")).collect()} == {"a": "g", "b": "", "c": ""}
    notes = spark.createDataFrame([("a", "symbol", "y"), ("a", "symbol", "z"), ("a", "file", "x.py"), ("a", "file", None)], "id string, kind string, value string")
    allowed = spark.createDataFrame([("a", "symbol", "x, y")], "id string, kind string, value string")
    assert {x.value for x in q.invented(notes, allowed).collect()} == {"z", "x.py"}
    assert one(spark, q.claims_of(F.col("s"), "always"), s="It always works. Fine; always so. No") == ["It always works.", "always so."]


def test_text_functions(spark):
    assert one(spark, t.slug(F.col("s")), s=" Smac Planner-2D! ") == "smac_planner_2d"
    assert one(spark, t.camel_words(F.col("s")), s="SmacPlanner2D_node") == ["smac", "planner2", "d", "node"]
    assert one(spark, t.trim_sentence(F.col("s"), 20), s="One two three. Four five six") == "One two three. \u2026"
    assert one(spark, t.trim_sentence(F.col("s"), 20), s="short") == "short"
    assert one(spark, t.trim_sentence(F.col("s"), 20), s="\tOne two three.\nFour five six\n") == "One two three. \u2026"
    assert one(spark, t.header_notice(F.col("s")), s="/* (c) me */ int x;") is None
    assert one(spark, t.header_notice(F.col("s")), s="\n/*\n * Copyright me\n *   and you \n */ int x;") == "Copyright me\n  and you"
    assert one(spark, t.redact(F.col("s"), ("abc",)), s="?key=A-b_1&x=abc") == "?key=***&x=***"
    assert one(spark, t.outer_json(F.col("s")), s=' {"a": "}"} ') == '{"a": "}"}'
    states = {(p, q_, a): one(spark, t.earned_state(F.col("p"), F.col("q"), F.col("a")), p=p, q=q_, a=a) for p, q_, a in [(0, 1, 1), (1, 1, 1), (1, 1, 2), (2, 2, 2), (2, 3, 3)]}
    assert states == {(0, 1, 1): None, (1, 1, 1): "demonstrated", (1, 1, 2): "read", (2, 2, 2): "demonstrated", (2, 3, 3): "read"}
    assert one(spark, t.outer_json(F.col("s")), s='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'
    assert one(spark, t.display_title(F.col("s")), s="the_pid_of_a_map") == "The PID of A Map"
    assert one(spark, t.bare_letter(F.col("s")), s=r"\mathbf{P}_k") == "P"


def test_generation_stages(spark):
    rows = spark.createDataFrame([("a", "about ekf"), ("b", None)], "id string, prompt string")
    got = generation.complete_all(rows, generation.stub({"ekf": 'sure: {"kind": "definition"}'})).select("id", "reply")
    parsed = {x.id: (x.status, x.record.kind if x.record else None) for x in generation.replies_to_rows(got.na.fill(""), "kind string").collect()}
    assert parsed["a"] == ("ok", "definition") and parsed["b"][0] == "no object"
    assert generation.json_of("x {\"a\": 1} y") == {"a": 1}

    def out(_):
        raise generation.QuotaExhausted

    both = generation.rotating([out, lambda s: s + "!"])
    assert both("x") == "x!" and both("y") == "y!"
    with pytest.raises(generation.Dropped):
        generation.rotating([out])("x")
    calls, waits = [], []

    def flaky(s):
        calls.append(s)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert generation.rotating([flaky], sleeper=waits.append)("x") == "ok" and waits == [1.0, 2.0]
    assert generation.json_of('```json\n{"a": "}"}\n```') == {"a": "}"}
    edges = spark.createDataFrame([("t", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(x, "concept") for x in "abcdefghijkl"] + [("t", "algorithm")], "id string, type string")
    v = generation.candidate_vocabulary(edges, nodes, spark.createDataFrame([("t",)], "id string"), limit=5)
    assert [x.id for x in v.orderBy("place").collect()] == list("abcde")
    passages = spark.createDataFrame([("t", 1, "p" * 10), ("t", 2, "q" * 10)], "id string, place int, text string")
    prompt = generation.prompts(spark.createDataFrame([("t", "Tracker")], "id string, name string"), v, passages, budget=15).first()["prompt"]
    assert "Tracker" in prompt and "a, b, c, d, e" in prompt and "q" not in prompt


def test_invocations_of_one_item_stay_in_their_tasks(spark):
    """What all steps invoke meets the ids once, so no join is by the items of all invocations."""
    from loomgraph.plans import registry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = registry.QUERIES["d1_check"](spark, "/root/testdata/sf0.001")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    alone = [x for x in plan.splitlines() if re.search(r"Join \[item#\d+L\], ", x)]
    assert alone and not [x for x in alone if "SortMerge" in x]
    assert {r["unknown"] for r in out.where("id % 2 = 0").collect()} == {"1000000000"}
