"""Queries over whole tables, beside plain Python on the smallest tables."""

import os
from collections import defaultdict

from loomgraph.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


def needs():
    """Part -> the parts it needs at once."""
    out = defaultdict(set)
    for p in table("part"):
        k = p["p_partkey"]
        if k >= 2:
            out[k] |= {k // 2, p["p_size"] * 7919 % k}
        if k >= 4:
            out[k].add(k // 4)
    return out


def reach(edges):
    """Part -> every part below it."""
    out = {}
    for k in sorted(edges):  # a part needs smaller keys only
        out[k] = set(edges[k]).union(*(out.get(d, ()) for d in edges[k]))
    return out


def test_joins_over_all_line_items(spark):
    items = table("lineitem")
    on, using = defaultdict(set), defaultdict(set)
    for x in items:
        s, p = x["l_suppkey"], x["l_partkey"]
        on[p].add(s)
        using[f"c{s}"].add(p)
    shared = defaultdict(int)
    for c in on.values():
        for a in c:
            for b in c:
                if a < b:
                    shared[a, b] += 1
    assert sorted(rows(spark, "j2_dataflow")) == sorted((a, b, n) for (a, b), n in shared.items())
    below = reach(needs())
    want = {(c, d) for c, ps in using.items() for p in ps for d in {p} | below.get(p, set())}
    got = rows(spark, "j18_components_reaching")
    assert len(got) == len(want) and set(got) == want


def test_closures_from_all_parts(spark):
    below = reach(needs())
    assert sorted(rows(spark, "g3_closure_targets")) == sorted((k, d) for k, ds in below.items() for d in ds)
    assert sorted(rows(spark, "g19_closure_cost")) == sorted((k, len(ds)) for k, ds in below.items())
    parts = {p["p_partkey"] for p in table("part")}
    owned = {(k, d, f"doc{d % 7}", s) for k, ds in below.items() for d in ds & parts if d % 3 == 0 and d % 7 < 4 for s in ("1.1", "2.3")}
    got = registry.QUERIES["j24_owners"](spark, SF).select("id", "owner", "document", "section").collect()
    assert len(got) >= len(owned) and owned <= {tuple(r) for r in got}
    costs = {r["id"]: r["cost"] for r in registry.QUERIES["k1_export_nodes"](spark, SF).select("id", "cost").collect()}
    assert costs == {k: len(below.get(k, ())) for k in parts}


def test_every_line_item_has_its_row(spark):
    items = table("lineitem")
    topics = [(x["l_orderkey"] * 10 + x["l_linenumber"], f"/to{x['l_suppkey']}" if x["l_linenumber"] % 2 else f"/part{x['l_partkey']}") for x in items]
    assert sorted(rows(spark, "j21_resolve_topic")) == sorted(topics)
    order = sorted((x["l_orderkey"], x["l_linenumber"], x["l_partkey"]) for x in items)
    assert sorted(rows(spark, "o4_line_order")) == order
    assert {r[0] for r in rows(spark, "j25_section_refs")} <= {t[0] for t in topics}


def test_paths_and_reports_over_all_parts(spark):
    edges, parts = needs(), {p["p_partkey"]: p["p_size"] for p in table("part")}
    below, known = reach(edges), {k for k, size in parts.items() if size <= 10 and k % 6}
    weight = defaultdict(int)
    for ds in edges.values():
        for d in ds:
            weight[d] += 1
    want, seen = [], set()
    for target in sorted(k for k, size in parts.items() if size > 40):
        left, order = below.get(target, set()) - known, []
        while left:
            order.append(min((k for k in left if not edges.get(k, set()) & left), key=lambda k: (-weight[k], k)))
            left = left - {order[-1]}
        for k in [*order, target]:
            if k not in seen and k not in known:
                seen.add(k)
                want.append(k)
    assert sorted(rows(spark, "g8_learning_path")) == list(enumerate(want, 1))
    holes = {(k, size * 3) for k, size in parts.items() if k != size * 3 and size % 10 and size * 3 not in below.get(k, ())}
    assert set(rows(spark, "j11_holes")) == holes
    assert {r["id"] for r in registry.QUERIES["d1_check"](spark, SF).collect()} == set(parts)


def test_grounding_reads_all_documents(spark):
    best = defaultdict(list)
    for d in table("documents"):
        best[d["doc_id"] % 100].append((d["n_chars"] >= (350 if d["doc_id"] % 3 == 0 else 1200), d["doc_id"] % 11 == 0, d["doc_id"]))
    want = set()
    for k in range(100):
        good = [i for ok, _, i in best[k] if ok]
        state = "known_absent" if k % 25 == 7 else "grounded" if good else "error" if any(e for _, e, _ in best[k]) else "ungrounded"
        want.add((k, state, str(min(good)) if good else None))
    got = registry.QUERIES["a9_grounding"](spark, SF).select("id", "state", "best").collect()
    assert len(got) == 100 and {tuple(r) for r in got} == want


def test_reopened_nodes_flag_the_same_by_all_edges(spark):
    from loomgraph.operators import profile
    from loomgraph.plans.bindings import requires
    from loomgraph.plans.state import profile_events

    events = profile_events(spark.read.parquet(f"{SF}/events.parquet"))
    every = profile.fold(profile.with_suspicions(events, requires(spark, SF)))
    assert sorted(map(repr, every.collect())) == sorted(repr(r) for r in registry.QUERIES["t3_reopen"](spark, SF).collect())


def test_identifiers_are_tokens_as_a_whole(spark):
    import re

    from loomgraph.operators import quality

    shape = r"\b[a-z][a-z0-9]*(?:[_/][a-z0-9]+)+(?:\.[a-z0-9]+)*\b"
    texts = ["see config/nav.yaml and launch/main.py", "nav_params.yaml, nav_params", "map_server knows restaurant", "éa_b c_dé x_y.z_w a__b 9a_b", "localization.launch.py in a/b.launch.py."]
    prose = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    names = spark.createDataFrame([("map_server",)], "name string")
    got = {tuple(r) for r in quality.invented_tokens(prose, names).collect()}
    assert {(0, "config/nav.yaml"), (0, "launch/main.py"), (1, "nav_params.yaml"), (1, "nav_params")} <= got
    assert got == {(i, t) for i, x in enumerate(texts) for t in re.findall(shape, x)} - {(2, "map_server")}
