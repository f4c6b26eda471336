"""Parsers, repository scans, documents, web texts, sinks and streams."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import profile as p
from loomgraph.sources import documents, parsers, repository, sinks, web
from loomgraph.sources.keyed import KeyedTable
from loomgraph.streaming import events as s

PARAMS = """# comment
planner_node:
  ros__parameters:
    rate: 20.0   # Hz
    weights: [1.0, 0.0,
      0.0, 1.0]
    topic: /cmd_vel
/**:
  use_sim: true
"""


def test_parameters(spark):
    def parameters(text):
        rows = repository.parameters(spark.createDataFrame([("x/config/a.yaml", text)], "path string, text string")).orderBy("ord").collect()
        assert [r["ord"] for r in rows] == list(range(len(rows)))
        return [(r["scope"], r["name"], r["value"]) for r in rows]

    assert parameters(PARAMS) == [("planner_node", "rate", "20.0"), ("planner_node", "weights", "[1.0, 0.0, 0.0, 1.0]"), ("planner_node", "topic", "/cmd_vel"), ("/**", "use_sim", "true")]
    assert parameters("a: |\n  text\nb: [1,\n2") == [("", "b", "[1, 2")]


def test_decoding():
    assert parsers.decode("h\xe9".encode("utf-16")) == "h\xe9"
    assert parsers.decode(b"\xef\xbb\xbfx") == "x"
    assert parsers.decode(b"h\xe9") == "h\xe9"


def test_manifests_and_requirements():
    xml = '<package><name>nav</name><depend version_eq="1.2">core</depend><exec_depend>rviz</exec_depend></package>'
    assert parsers.package_manifest(xml) == ("nav", [("core", "1.2"), ("rviz", None)])
    assert parsers.package_manifest("<broken") == (None, [])
    assert list(parsers.requirements("NumPy==1.26\n-e .\nscipy >= 1.0 # x\nplain\n")) == [("numpy", "1.26"), ("scipy", "1.0"), ("plain", None)]


LAUNCH = """
params = os.path.join(get_share("x"), "config", "nav.yaml")
def make():
    return [Node(package="nav", executable="planner_node", name="planner_node", parameters=[params, extra], remappings=[("in", "/out")], arguments=["a@b[c"]),
            Node(package=LaunchConfiguration("p"), executable="e2")]
"""


def test_launch_files():
    first, second = parsers.launch_python(LAUNCH)
    assert first["param_files"] == ["nav.yaml"] and first["remappings"] == [("in", "/out")] and first["unresolved"] == []
    assert second["package"] is None and second["executable"] == "e2"
    (third,) = parsers.launch_python("f = ['a.yaml', 'b.yaml']\nNode(package='p', parameters=[f, LaunchConfiguration('c'), {'x': 1}])\nComposableNode(package='q')")
    assert third["param_files"] == ["a.yaml"] and third["unresolved"] == ["LaunchConfiguration"]
    assert parsers.launch_python("def (") == []
    late = "def f():\n    Node(package='p', parameters=[[join(x, 'in.yaml')], v, 'top.yaml', ['t.txt']], remappings=[['a', 'b'], ('c',), ('d', e), ('f', 'g')], arguments=[x, 'y'])\nNode(executable='first')\nv = join(join('deep.yaml'), 'near.yml')\na = b = 'no.yaml'"
    one, two = parsers.launch_python(late)
    assert (one["executable"], one["param_files"]) == ("first", [])
    assert two["param_files"] == ["near.yml", "top.yaml", "in.yaml"] and two["remappings"] == [("f", "g")] and two["arguments"] == ["y"]
    (node,) = parsers.launch_xml('<launch><node pkg="a" exec="b" name="c"><param from="p.yaml"/><remap from="x" to="y"/></node></launch>')
    (other,) = parsers.launch_xml('<launch><node package="a" executable="b"><param from="p.txt"/></node></launch>')
    assert (other["package"], other["executable"], other["param_files"]) == ("a", "b", [])
    assert node["param_files"] == ["p.yaml"] and node["remappings"] == [("x", "y")]
    assert parsers.launch_xml("<launch>") == []
    outer, inner = parsers.launch_xml('<launch><param from="free.yaml"/><node pkg="" package="a" type="b" args="x y"><node name="i"><param from="q.yml"/></node></node></launch>')
    assert (outer["package"], outer["executable"], outer["arguments"], outer["param_files"]) == ("a", "b", ["x", "y"], ["q.yml"]) and inner["param_files"] == ["q.yml"]


@pytest.fixture()
def repo(spark, tmp_path):
    files = {
        "nav/package.xml": "<package><name>nav</name><depend>core</depend></package>",
        "requirements.txt": "numpy==1.26\n",
        "nav/config/nav.yaml": PARAMS,
        "other/config/nav.yaml": "lonely:\n  gain: 3\n  plugin: nav::SmacPlanner\n",
        "nav/launch/main.launch.py": LAUNCH,
        "nav/tool.py": '"""Tool."""\nimport os, numpy\nfrom helper import f\nclass Tool:\n    """A tool."""\n    def run(self): pass\ndef _hidden(): pass\n',
        "nav/helper.py": "def f(): pass\n",
        "build/skip.py": "class Skipped: pass\n",
    }
    for name, text in files.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return repository.read_files(spark, f"file://{tmp_path}/repo")


def test_repository(repo):
    assert {r.path for r in repo.select("path").collect()} >= {"nav/package.xml", "nav/tool.py"} and repo.where("path like 'build%'").count() == 0
    assert dict(repository.dependencies(repo).collect()) == {"core": None, "numpy": "1.26"}
    assert {(r.kind, r.name) for r in repository.code_units(repo).where("path = 'nav/tool.py'").collect()} == {("module", "tool"), ("class", "Tool"), ("function", "run")}
    assert [r.module for r in repository.foreign_imports(repo).collect()] == ["numpy"]
    assert repository.index_files(repo).where("path = 'nav/helper.py'").first()["language"] == "python"
    got = {r.component: (r.package, [x["name"] for x in r.parameters]) for r in repository.components(repo).collect()}
    assert got["planner_node"] == ("nav", ["rate", "weights", "topic", "use_sim"])
    assert got["lonely"] == (None, ["gain", "plugin"]) and got["e2"] == (None, [])
    assert [tuple(r) for r in repository.plugins(repository.parameters(repo)).collect()] == [("SmacPlanner", "nav")]


def test_documents(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))
        return f"file://{tmp_path}/{name}"

    seeds = put("seeds.json", {"base": {"concepts": ["set"]}, "seeds": [{"id": "ekf", "name": "EKF", "domain": "d", "concepts": ["set", "mean"], "techniques": ["expand"]}]})
    edges = put("edges.json", {"edges": [{"from": "mean", "to": "set", "cluster": "c", "why": "w"}, {"from": "mean", "to": "nowhere"}]})
    amend = put("amend.json", {"add_concepts": ["sum"], "add_edges": [{"from": "mean", "to": "sum"}], "retier": [{"id": "sum", "tier": "claim"}]})
    nodes, e = documents.build_graph(spark, seeds, edges, amend)
    assert {r.id: (r.type, r.tier) for r in nodes.collect()} == {"set": ("concept", "assumed"), "ekf": ("algorithm", "derivation"), "mean": ("concept", "statement"), "expand": ("technique", "statement"), "sum": ("concept", "claim")}
    assert {(r.src, r.dst) for r in e.collect()} == {("ekf", "set"), ("ekf", "mean"), ("ekf", "expand"), ("mean", "set"), ("mean", "sum")}
    assert documents.canon_edges(spark, f"file://{tmp_path}/none.json").count() == 0
    assert dict(documents.alias_titles(spark, put("alias.json", {"aliases": {"a": [], "b": ["B"]}})).collect()) == {"a": [], "b": ["B"]}
    libs, _ = documents.library_map(spark, put("lib.json", {"libraries": {"x": [], "y": ["z"]}, "domain_subsystem": {"d": "S"}}))
    assert {r.key: r["items"] for r in libs.collect()} == {"x": [], "y": ["z"]}
    b = documents.brief(spark, put("brief.json", {"project": "p", "subsystems": {"S": ["c"]}, "components": {"c": {"algorithms": ["ekf"], "files": ["f"]}}}))
    assert [tuple(r) for r in b.collect()] == [("c", "S", ["ekf"], ["f"])]
    entries, denied = documents.profile(spark, put("prof.json", {"entries": [{"node_id": "a", "state": "read", "at": "2024-01-01T00:00:00+00:00"}], "denied": {"b": "2024"}}))
    assert entries.first()["node_id"] == "a" and denied.first()["node_id"] == "b"
    topics = documents.library_topics(spark, put("topics.json", {"p/e": {"publishes": ["a"], "subscribes": ["b", "c"]}}))
    assert {(r.topic, r.role) for r in topics.collect()} == {("a", "publishes"), ("b", "subscribes"), ("c", "subscribes")}
    env = tmp_path / "env"
    env.write_text("A=1\n# x\nB='2'\n")
    assert documents.environment(str(env), {"A": "0"}) == {"A": "0", "B": "2"}


def test_code_graph_and_sheets(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "n", "label": "L", "source_file": "/r/a.py"}], "edges": [{"source": "n", "target": "n", "relation": "calls", "confidence": "EXTRACTED"}]}))
    nodes, edges = repository.code_graph(spark, f"file://{tmp_path}/g.json", "/r")
    assert nodes.first()["source_file"] == "a.py" and edges.first()["is_fact"]
    folder = tmp_path / "sheets"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"node_id": "a", "check": {"ok": True}}))
    (folder / "b.json").write_text("{broken")
    rows = {r.node_id: r for r in repository.sheets(spark, f"file://{folder}").collect()}
    assert rows["a"].check.ok and rows["a"].steps is None and rows[None]["_corrupt_record"]
    (tmp_path / "p.json").write_text(json.dumps({"cluster": "c", "edges": [{"from": "a", "to": "b"}], "inbound": [{"from": "x", "to": "a"}]}))
    assert [(r.ord, r.src) for r in repository.proposals(spark, f"file://{tmp_path}/p.json").collect()] == [(0, "a"), (1, "x")]


HTML = "<html><head><style>x</style></head><body><nav>menu</nav><h2>Proof</h2><p>Let <math alttext='a=b'><mi>a</mi></math> hold.</p><h3>Part</h3><p>more&nbsp;text</p><h2>Next</h2>end</body></html>"


def test_html_and_sections(spark):
    text = web.plain_text(HTML)
    assert text == "== Proof ==\nLet $a=b$ hold.\n=== Part ===\nmore text\n== Next ==\nend"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    got = {r.title: r.body for r in web.sections(docs).collect()}
    assert got == {"Proof": "Let $a=b$ hold.\n=== Part ===\nmore text", "Part": "more text", "Next": "end"}
    pins = spark.createDataFrame([("d", "proof")], "doc string, section string")
    assert web.pinned_section(docs, pins).first()["body"].startswith("Let")
    with pytest.raises(Exception, match="no section"):
        web.pinned_section(docs, pins.withColumn("section", F.lit("absent"))).collect()
    assert spark.range(1).select(web.ascii_slug(F.lit("Caf\xe9 d'Or--2")).alias("s")).first()["s"] == "cafe_d_or_2"


def test_a_batch_of_pages_is_not_held_as_strings(spark):
    import tracemalloc

    import pyarrow as pa

    pages = pa.array([None, HTML, ""] + [f"<p>{k}</p>" + "x" * 10_000 for k in range(2000)])
    tracemalloc.start()
    got = web.plain_texts(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000 and got.nbytes > 19_000_000
    assert got.to_pylist() == [web.plain_text(x) for x in pages.to_pylist()]
    assert [r.t for r in spark.createDataFrame([(HTML,), (None,)], "h string").select(web.html_text("h").alias("t")).collect()] == [web.plain_text(HTML), ""]


def test_retrieval(spark):
    bodies = spark.createDataFrame([("t", json.dumps({"query": {"pages": {"7": {"title": "T", "extract": "long text"}, "-1": {"title": "none"}, "8": {"title": "D", "extract": "D may refer to:"}}}}))], "title string, body string")
    assert [r.id for r in web.encyclopedia(bodies).collect()] == ["7"]
    nodes = spark.createDataFrame([("a", "Kalman Filter"), ("b", "B"), ("c", "C")], "id string, name string")
    aliases = spark.createDataFrame([("b", [])], "id string, titles array<string>")
    sources = spark.createDataFrame([("Kalman filter", "s1", "x" * 1300, None), ("C", "s2", "short", None)], "title string, source string, text string, kind string")
    assert {r.id: (r.source, r.state) for r in web.retrieve(nodes, aliases, sources).collect()} == {"a": ("s1", "grounded"), "b": (None, "known_absent"), "c": (None, "ungrounded")}
    consumers = spark.createDataFrame([("c", "a", 1)], "id string, consumer string, place int")
    own = spark.createDataFrame([("a", "s1", "word C " * 20 + "\nshort c")], "id string, source string, text string")
    assert web.ground_from_consumers(nodes.where("id = 'c'"), consumers, own).first()["derived"] == "s1#c"
    states = spark.createDataFrame([("a", "error", None), ("b", "grounded", "x")], "id string, state string, source string")
    again = spark.createDataFrame([("a", "grounded", "y"), ("b", "grounded", "z")], "id string, state string, source string")
    assert {r.id: r.source for r in web.retry(states, again).collect()} == {"a": "y", "b": "x"}
    tries = []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return b"ok"

    assert web.fetch("u", flaky, sleeper=lambda _: None) == b"ok" and len(tries) == 3


def test_atom(spark, tmp_path):
    path = tmp_path / "feed.xml"
    path.write_text("<feed><entry><id>i</id><title>T</title><summary>S</summary></entry></feed>")
    assert [tuple(r) for r in web.atom_entries(spark, f"file://{path}").collect()] == [("i", "T", "S")]


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    work = lambda f: f.withColumn("w", F.col("v") * 2)
    assert sinks.resume(rows, f"{at}/r", "k", work) == 2
    assert sinks.resume(rows.unionByName(spark.createDataFrame([("c", 3)], "k string, v int")), f"{at}/r", "k", work) == 1
    assert sinks.resume(rows, f"{at}/r", "k", work) == 0 and KeyedTable(spark, f"{at}/r", "k").read().count() == 3
    sinks.upsert(rows, f"{at}/u", "k")
    sinks.upsert(spark.createDataFrame([("a", 9)], "k string, v int"), f"{at}/u", "k")
    assert dict((r.k, r.v) for r in KeyedTable(spark, f"{at}/u", "k").read().collect()) == {"a": 9, "b": 2}
    old = spark.createDataFrame([("x", 1), ("y", 2)], "flag string, round int")
    assert {(r.flag, r["round"]) for r in sinks.append_flags(old, spark.createDataFrame([("z",)], "flag string"), 2).collect()} == {("x", 1), ("z", 2)}
    src = spark.createDataFrame([("p", "/* Copyright me */\nl2\nl3")], "path string, text string")
    pin = spark.createDataFrame([("p", 2, 3)], "path string, first int, last int")
    assert sinks.library_slice(src, pin).first()["excerpt"] == "l2\nl3"
    for bad in (pin.withColumn("last", F.lit(9)), pin):
        text = src if bad is not pin else src.withColumn("text", F.lit("no notice\nx\ny"))
        with pytest.raises(Exception, match="bad range|no licence notice"):
            sinks.library_slice(text, bad).collect()
    assert [r.line for r in sinks.holders(spark.createDataFrame([(1, "# Copyright A\n# Copyright B"), (2, "// Copyright A")], "ord int, text string")).orderBy("ord").collect()] == ["Copyright A", "Copyright B"]
    private = spark.createDataFrame([("note", "p1"), ("note", "p2")], "why string, project string")
    assert [r.why for r in sinks.strip_private(private, "why", "project", ["p1"]).orderBy("project").collect()] == ["note", None]


def test_parsers_get_their_files_in_many_tasks(spark):
    files = spark.range(300, numPartitions=1).selectExpr("concat('src/m', id, '.py') AS path", "concat('import n', id) AS text")
    assert repository.dealt_out(files, 10).rdd.getNumPartitions() == 30
    assert repository.foreign_imports(files).count() == 300
    tasks = repository.dealt_out(files).groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 1


def test_stream_state_equals_batch(spark, tmp_path):
    rows = [(k % 3, k % 4, k, f"t{k:03}", ("mark", "deny", "mark", "reopen", "mark")[k % 5], p.STATES[k % 3] if k % 5 in (0, 2, 4) else None) for k in range(120)]
    events = spark.createDataFrame(rows, "user long, node long, ord long, at string, action string, state string")
    events.coalesce(1).write.parquet(f"file://{tmp_path}/events")
    out = s.run_to_table(s.profiles(s.stream(spark, f"file://{tmp_path}/events")), "update", "test")
    last = out.groupBy("user", "node").agg(F.max_by(F.struct("state", "at", "denied"), "_batch").alias("v")).select("user", "node", "v.*")
    got = {tuple(r) for r in last.where("state is not null or denied").collect()}
    assert got == {tuple(r) for r in p.fold(events).select("user", "node", "state", "at", "denied").collect()}


def test_late_events_change_a_stream_entry_as_in_their_place(spark):
    rng = random.Random(5)
    actions = ["mark", "mark", "mark", "suspect", "reopen", "deny"]
    rows = [(1, k % 20, k, f"t{k:03}", a, rng.choice(p.STATES) if a == "mark" else None) for k, a in enumerate(rng.choices(actions, k=160))]
    columns = ["user", "node", "ord", "at", "action", "state"]
    late = rng.sample(rows, len(rows))
    states, last = {}, {}
    for batch in (late[:50], late[50:90], late[90:]):
        for node, part in pd.DataFrame(batch, columns=columns).groupby("node"):
            state = states.setdefault(node, SimpleNamespace(exists=False, get=None))
            state.update = lambda value, state=state: state.__dict__.update(exists=True, get=value)
            (entry,) = pd.concat(s.fold_profile((1, node), iter([part[:2], part[2:]]), state)).to_dict("records")
            last[node] = entry
    got = {(n, e["state"], e["at"], e["suspect"], e["denied"]) for n, e in last.items() if e["state"] or e["denied"]}
    events = spark.createDataFrame(rows, "user long, node long, ord long, at string, action string, state string")
    want = {tuple(r) for r in p.fold(events).select("node", "state", "at", "suspect", "denied").collect()}
    assert got == want and {True, False} == {w[3] for w in want} == {w[4] for w in want}
