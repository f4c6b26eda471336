"""Source queries: rows of the driver's tables made into files and documents, and parsed back.

Parsers get their files as rows; readers of documents get folders of files in the shared
folder, one for each supplier, customer or part, as many as the table has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture
from ..sources import changes, documents, repository, sinks, web
from ..sources.tables import Scratch, read
from .registry import query


def _files(frame, path, text):
    return frame.select(F.expr(path).alias("path"), F.expr(text).alias("text"))


def _folder(spark, frame, name: str, text) -> str:
    """A folder with one file for each row of a frame with ``k``."""
    scratch = Scratch(spark, "documents")
    own = frame.select(F.concat(F.lit("d"), "k", F.lit(".json")).alias("path"), text.alias("text"))
    changes.write_files(own, scratch.path(name))
    return scratch.path(name)


def _suppliers(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"))


@query("""SELECT 'a' || s_suppkey || '/config/p.yaml' AS path, 0 AS ord, 'node_' || s_nationkey AS scope, 'rate' AS name, s_suppkey || '.5' AS value FROM supplier
  UNION ALL SELECT 'a' || s_suppkey || '/config/p.yaml', 1, 'node_' || s_nationkey, 'matrix', '[1, ' || s_nationkey || ', 3]' FROM supplier
  UNION ALL SELECT 'a' || s_suppkey || '/config/p.yaml', 2, '/**', 'name', split_part(s_name, '#', 1) FROM supplier""")
def s3_parameters(spark, sf_dir):
    text = "concat('node_', n, ':\\n  rate: ', k, '.5 # Hz\\n\\n  matrix: [1, ', n, ',\\n    3]\\n/**:\\n  name: ', name, '\\n  - item\\n')"
    return repository.parameters(_files(_suppliers(spark, sf_dir), "concat('a', k, '/config/p.yaml')", text)).select("path", "ord", "scope", "name", "value")


@query("""WITH d AS (SELECT 'dep' || s_nationkey AS name, (s_suppkey % 9)::VARCHAR AS version, 'p' || s_suppkey || '/package.xml' AS path FROM supplier WHERE s_suppkey % 10 <> 7
    UNION ALL SELECT 'run' || s_suppkey % 7, NULL, 'p' || s_suppkey || '/package.xml' FROM supplier WHERE s_suppkey % 10 <> 7)
  SELECT name, arg_max(version, path) AS version FROM d GROUP BY name""")
def s4_manifests(spark, sf_dir):
    body = "concat('<package><name>', name, '</name><depend version_eq=\"', k % 9, '\">dep', n, '</depend><exec_depend> run', k % 7, ' </exec_depend>', if(k % 10 = 7, '', '</package>'))"
    return repository.dependencies(_files(_suppliers(spark, sf_dir), "concat('p', k, '/package.xml')", body))


@query("""WITH d AS (SELECT 'lib' || p_size AS name, (p_partkey % 5) || '.1' AS version, 'r' || p_partkey || '/requirements-dev.txt' AS path FROM part
    UNION ALL SELECT 'plain.' || p_partkey % 11, '2.' || p_partkey % 3, 'r' || p_partkey || '/requirements-dev.txt' FROM part)
  SELECT name, arg_max(version, path) AS version FROM d GROUP BY name""")
def s5_requirements(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return repository.dependencies(_files(p, "concat('r', k, '/requirements-dev.txt')", "concat('Lib', s, '==', k % 5, '.1\\n# comment\\n-e .\\nPlain.', k % 11, '[x] >= 2.', k % 3, ' ; os\\n')"))


def _launched(nodes):
    pairs = F.array_join(F.transform("remappings", lambda r: F.concat(r["inside"], F.lit(">"), r["outside"])), ",")
    joined = [F.array_join(c, ",").alias(c) for c in ("param_files", "arguments", "unresolved")]
    return nodes.select("path", "ord", "package", "executable", "name", joined[0], pairs.alias("remappings"), *joined[1:])


@query("""SELECT 'l' || c_custkey || '/launch/a.launch.py' AS path, i AS ord, 'p' || c_nationkey AS package, CASE i WHEN 0 THEN 'e' || c_custkey % 6 END AS executable, 'n' || c_custkey || '_' || i AS name,
    CASE i WHEN 0 THEN 'c' || c_custkey % 20 || '.yaml,own.yml' ELSE '' END AS param_files, CASE i WHEN 0 THEN 'in>/t' || c_custkey % 8 ELSE '' END AS remappings, CASE i WHEN 0 THEN 'x@y' ELSE '' END AS arguments,
    CASE i WHEN 0 THEN 'LaunchConfiguration' ELSE '' END AS unresolved FROM customer, (SELECT unnest([0, 1]) AS i) WHERE c_custkey % 7 <> 3""")
def s6_launch_python(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    text = """concat('cfg = os.path.join(share, "config", "c', k % 20, '.yaml")\\nout = [Node(package="p', n, '", executable="e', k % 6, '", name="n', k, '_0", parameters=[cfg, "own.yml", {"a": 1}, LaunchConfiguration("q")], remappings=[("in", "/t',
      k % 8, '"), (a, "b")], arguments=["x@y", z]),\\n Node(package="p', n, '", executable=pick(), name="n', k, '_1")]\\n', if(k % 7 = 3, 'def (', ''))"""
    return _launched(repository.launch_nodes(_files(c, "concat('l', k, '/launch/a.launch.py')", text)))


@query("""SELECT 'l' || c_custkey || '/nav.launch' AS path, i AS ord, 'p' || c_nationkey AS package, CASE i WHEN 0 THEN 'e' || c_custkey % 6 ELSE 'other' END AS executable, CASE i WHEN 0 THEN 'n' || c_custkey END AS name,
    CASE i WHEN 0 THEN 'c' || c_custkey % 20 || '.yaml' ELSE '' END AS param_files, CASE i WHEN 0 THEN 'in>/t' || c_custkey % 8 ELSE '' END AS remappings, CASE i WHEN 0 THEN 'a,b' ELSE '' END AS arguments, '' AS unresolved
  FROM customer, (SELECT unnest([0, 1]) AS i) WHERE c_custkey % 9 <> 4""")
def s7_launch_xml(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    text = """concat('<launch><node pkg="p', n, '" exec="e', k % 6, '" name="n', k, '" args="a  b"><param from="c', k % 20, '.yaml"/><param name="x" value="y.yaml"/><remap from="in" to="/t', k % 8, '"/></node><group><node package="p', n,
      '" type="other"/></group>', if(k % 9 = 4, '', '</launch>'))"""
    return _launched(repository.launch_nodes(_files(c, "concat('l', k, '/nav.launch')", text)))


_UNITS = "concat('\"\"\"Part of ', s, '.\\n\\n  More.\"\"\"\\nimport os, lib', k % 13, '.x\\nfrom mod', k % 4, ' import y\\nfrom . import z\\nclass C', k, ':\\n    \"\"\"Has one.\"\"\"\\n    def run(self): pass\\ndef _hidden(): pass\\nasync def f', k, '(): pass\\n', if(k % 6 = 5, 'x = (', ''))"


def _sources(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    return _files(p, "concat('src/m', k, '.py')", _UNITS).unionByName(_files(spark.range(2), "concat('tools/mod', id, '.py')", "'x = 1'"))


@query("""WITH u AS (SELECT 'src/m' || p_partkey || '.py' AS path, i AS ord, CASE i WHEN 0 THEN 'module' WHEN 1 THEN 'class' ELSE 'function' END AS kind, CASE i WHEN 0 THEN 'm' || p_partkey WHEN 1 THEN 'C' || p_partkey WHEN 2 THEN 'f' || p_partkey ELSE 'run' END AS name,
    CASE i WHEN 0 THEN 'Part of ' || p_size || '. More.' WHEN 1 THEN 'Has one.' ELSE '' END AS doc FROM part, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE p_partkey % 6 <> 5
    UNION ALL SELECT 'tools/mod' || i || '.py', 0, 'module', 'mod' || i, '' FROM (SELECT unnest([0, 1]) AS i))
  SELECT path, ord::INTEGER AS ord, kind, name, doc FROM u ORDER BY path, ord LIMIT 120""")
def s8_code_units(spark, sf_dir):
    """The first units in path order, as many as a scan lists."""
    return repository.code_units(_sources(spark, sf_dir))


@query("SELECT DISTINCT 'lib' || p_partkey % 13 AS module FROM part WHERE p_partkey % 6 <> 5 UNION SELECT DISTINCT 'mod' || p_partkey % 4 FROM part WHERE p_partkey % 6 <> 5 AND p_partkey % 4 > 1")
def s8_foreign_imports(spark, sf_dir):
    return repository.foreign_imports(_sources(spark, sf_dir))


@query("""SELECT 's' || s_suppkey AS source, 'src/f' || s_nationkey || '.py' AS source_file, 's' || (s_suppkey // 2) AS target, 'calls' AS relation, s_suppkey % 3 = 0 AS is_fact FROM supplier""")
def s10_code_graph(spark, sf_dir):
    node = F.array(F.struct(F.concat(F.lit("s"), "k").alias("id"), F.col("name").alias("label"), F.concat(F.lit("/repo/src/f"), "n", F.lit(".py")).alias("source_file")))
    edge = F.array(F.struct(F.concat(F.lit("s"), "k").alias("source"), F.concat(F.lit("s"), F.expr("k div 2")).alias("target"), F.lit("calls").alias("relation"), F.when(F.col("k") % 3 == 0, "EXTRACTED").otherwise("INFERRED").alias("confidence")))
    text = F.when(F.col("k") % 5 == 0, F.to_json(F.struct(node.alias("nodes"), edge.alias("edges")))).otherwise(F.to_json(F.struct(node.alias("nodes"), edge.alias("links"))))
    nodes, edges = repository.code_graph(spark, _folder(spark, _suppliers(spark, sf_dir), "graph", text), "/repo")
    return edges.join(nodes.select(F.col("id").alias("source"), "source_file"), "source").select("source", "source_file", "target", "relation", "is_fact")


@query("""SELECT 'k' || s_suppkey AS id, 'N ' || s_suppkey AS name, 'd' || s_nationkey AS domain, CASE i WHEN 2 THEN 't' || s_suppkey % 5 ELSE 'c' || (s_suppkey + i) % 9 END AS item, CASE i WHEN 2 THEN 'technique' ELSE 'concept' END AS kind
  FROM supplier, (SELECT unnest([0, 1, 2]) AS i)""")
def s11_seeds(spark, sf_dir):
    k = F.col("k")
    seed = F.struct(
        F.concat(F.lit("k"), k).alias("id"), F.concat(F.lit("N "), k).alias("name"), F.concat(F.lit("d"), "n").alias("domain"),
        F.array(F.concat(F.lit("c"), k % 9), F.concat(F.lit("c"), (k + 1) % 9)).alias("concepts"), F.array(F.concat(F.lit("t"), k % 5)).alias("techniques"),
    )
    text = F.to_json(F.struct(F.struct(F.array(F.lit("set")).alias("concepts")).alias("base"), F.array(seed).alias("seeds")))
    return documents.seeds(spark, _folder(spark, _suppliers(spark, sf_dir), "seeds", text))[1].select("id", "name", "domain", "item", "kind")


def _pairs(k, n):
    """Two edges as JSON texts, with keys that are words of the language."""
    return F.concat(F.lit('{"from":"a'), k, F.lit('","to":"b'), n, F.lit('","cluster":"c'), n, F.lit('","why":"w'), k, F.lit('"},{"from":"b'), n, F.lit('","to":"z'), k % 4, F.lit('"}'))


@query("""SELECT 0 AS ord, 'a' || s_suppkey AS src, 'b' || s_nationkey AS dst, 'c' || s_nationkey AS cluster, 'w' || s_suppkey AS why FROM supplier UNION ALL SELECT 1, 'b' || s_nationkey, 'z' || s_suppkey % 4, NULL, NULL FROM supplier""")
def s11_canon_edges(spark, sf_dir):
    text = F.concat(F.lit('{"edges":['), _pairs(F.col("k"), F.col("n")), F.lit("]}"))
    return documents.canon_edges(spark, _folder(spark, _suppliers(spark, sf_dir), "edges", text))


@query("""SELECT 'c' || s_suppkey AS cluster, 0 AS ord, 'a' || s_suppkey AS src, 'b' || s_nationkey AS dst, 'w' || s_suppkey AS why FROM supplier UNION ALL SELECT 'c' || s_suppkey, 1, 'b' || s_nationkey, 'z' || s_suppkey % 4, NULL FROM supplier
  UNION ALL SELECT 'c' || s_suppkey, 2, 'x', 'a' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 3 = 0""")
def s12_proposals(spark, sf_dir):
    k = F.col("k")
    inbound = F.when(k % 3 == 0, F.concat(F.lit(',"inbound":[{"from":"x","to":"a'), k, F.lit('"}]'))).otherwise("")
    text = F.concat(F.lit('{"cluster":"c'), k, F.lit('","edges":['), _pairs(k, F.col("n")), F.lit("]"), inbound, F.lit("}"))
    return repository.proposals(spark, _folder(spark, _suppliers(spark, sf_dir), "proposals", text))


@query("""SELECT 'c' || s_suppkey || '_' || i AS component, CASE i WHEN 0 THEN 'S' || s_nationkey END AS subsystem, CASE i WHEN 0 THEN 'ekf' ELSE '' END AS algorithms, 'f' || s_suppkey || '.py' AS files FROM supplier, (SELECT unnest([0, 1]) AS i)""")
def s13_brief(spark, sf_dir):
    k = F.col("k")
    one = F.concat(F.lit('{"subsystems":{"S'), "n", F.lit('":["c'), k, F.lit('_0"]},"components":{"c'), k, F.lit('_0":{"algorithms":["ekf"],"files":["f'), k, F.lit('.py"]},"c'), k, F.lit('_1":{"algorithms":[],"files":["f'), k, F.lit('.py"]}}}'))
    b = documents.brief(spark, _folder(spark, _suppliers(spark, sf_dir), "briefs", one))
    return b.select("component", "subsystem", F.array_join("algorithms", ",").alias("algorithms"), F.array_join("files", ",").alias("files"))


@query("""SELECT 'n' || s_suppkey AS node_id, 'read' AS state, '2024-01-01T00:00:00+00:00' AS "at", s_suppkey % 2 = 0 AS suspect FROM supplier UNION ALL SELECT 'm' || s_nationkey || '_' || s_suppkey, NULL, NULL, NULL FROM supplier""")
def s14_profile(spark, sf_dir):
    entry = F.concat(F.lit('{"entries":[{"node_id":"n'), "k", F.lit('","state":"read","at":"2024-01-01T00:00:00+00:00","suspect":'), (F.col("k") % 2 == 0).cast("string"), F.lit('}],"denied":{"m'), "n", F.lit("_"), "k", F.lit('":"2024"}}'))
    entries, denied = documents.profile(spark, _folder(spark, _suppliers(spark, sf_dir), "profiles", entry))
    return entries.select("node_id", "state", "at", "suspect").unionByName(denied, allowMissingColumns=True)


@query("SELECT 'a' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name || '|T' || s_nationkey END AS titles FROM supplier")
def s15_alias_titles(spark, sf_dir):
    titles = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("name", F.concat(F.lit("T"), "n")))
    text = F.to_json(F.struct(F.create_map(F.concat(F.lit("a"), "k"), titles).alias("aliases")))
    found = documents.alias_titles(spark, _folder(spark, _suppliers(spark, sf_dir), "aliases", text))
    return found.select("id", F.size("titles").alias("n"), F.array_join("titles", "|").alias("titles"))


@query("""SELECT 'family' || s_nationkey AS family, 'r' || s_suppkey || i AS root, 'x' || j AS letter, 'mean ' || s_suppkey AS means, CASE j WHEN 0 THEN 'pat' ELSE '' END AS pattern FROM supplier, (SELECT unnest(['a', 'b']) AS i), (SELECT unnest([0, 1]) AS j)""")
def s15_conventions(spark, sf_dir):
    def symbol(j, more):
        return F.concat(F.lit(f'{{"symbol":"x{j}","means":"mean '), "k", F.lit('"' + more + "}"))

    family = F.concat(F.lit('{"families":[{"family":"family'), "n", F.lit('","roots":["r'), "k", F.lit('a","r'), "k", F.lit('b"],"symbols":['), symbol(0, ',"recognise":"pat"'), F.lit(","), symbol(1, ""), F.lit("]}]}"))
    return documents.conventions(spark, _folder(spark, _suppliers(spark, sf_dir), "notation", family)).drop("prio")


@query("""SELECT 'lib' || s_suppkey || '/exe' AS key, 'topic' || i AS topic, CASE WHEN i = 0 THEN 'publishes' ELSE 'subscribes' END AS role, CASE WHEN i = 2 THEN 1 ELSE 0 END AS ord FROM supplier, (SELECT unnest([0, 1, 2]) AS i) WHERE i < 2 OR s_suppkey % 2 = 1""")
def s15_library_topics(spark, sf_dir):
    subs = F.when(F.col("k") % 2 == 1, '"topic1","topic2"').otherwise('"topic1"')
    text = F.concat(F.lit('{"lib'), "k", F.lit('/exe":{"publishes":["topic0"],"subscribes":['), subs, F.lit("]}}"))
    return documents.library_topics(spark, _folder(spark, _suppliers(spark, sf_dir), "topics", text))


@query("""SELECT 'lib' || s_suppkey AS key, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'alg' || s_nationkey END AS items FROM supplier""")
def s15_library_map(spark, sf_dir):
    items = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("alg"), "n")))
    text = F.to_json(F.struct(F.create_map(F.concat(F.lit("lib"), "k"), items).alias("libraries"), F.create_map(F.concat(F.lit("d"), "n"), F.lit("S")).alias("domain_subsystem")))
    libraries, _ = documents.library_map(spark, _folder(spark, _suppliers(spark, sf_dir), "libraries", text))
    return libraries.select("key", F.array_join("items", ",").alias("items"))


@query("SELECT doc_id AS title, doc_id::VARCHAR AS id, 'Article ' || doc_id AS article, text FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 11 <> 5 AND doc_id % 11 <> 7 AND trim(text) <> ''")
def s17_encyclopedia(spark, sf_dir):
    i, text = F.col("doc_id"), F.col("text")
    page = F.struct(
        F.concat(F.lit("Article "), i).alias("title"),
        F.when(i % 11 == 3, "").when(i % 11 == 5, F.concat(F.lit("It may refer to:\n"), F.substring(text, 1, 99))).otherwise(text).alias("extract"),
        F.when(i % 11 == 7, F.create_map(F.lit("disambiguation"), F.lit(""))).alias("pageprops"),
    )
    pages = F.map_concat(F.create_map(i.cast("string"), page), F.create_map(F.lit("-1"), page))
    return web.encyclopedia(read(spark, sf_dir, "documents").select(i.alias("title"), F.to_json(F.struct(F.struct(pages.alias("pages")).alias("query"))).alias("body")))


@query("SELECT 'http://x/' || s_suppkey AS id, 'Title of ' || s_name AS title, CASE WHEN i = 0 THEN 'Summary & ' || s_nationkey END AS summary FROM supplier, (SELECT unnest([0, 1]) AS i)")
def s18_atom(spark, sf_dir):
    def entry(summary):
        return F.concat(F.lit("<entry><id>http://x/"), "k", F.lit("</id><title>Title of "), "name", F.lit("</title>"), summary, F.lit("</entry>"))

    feed = F.concat(F.lit("<feed><title>all</title>"), entry(F.concat(F.lit("<summary>Summary &amp; "), "n", F.lit("</summary>"))), entry(F.lit("")), F.lit("</feed>"))
    return web.atom_entries(spark, _folder(spark, _suppliers(spark, sf_dir), "feeds", feed))


@query("SELECT doc_id AS doc, 'proof' AS section, string_split(text, chr(10))[1] || chr(10) || '=== More ===' || chr(10) || 'z' AS body FROM documents")
def s19_pinned_section(spark, sf_dir):
    text = F.concat(F.lit("== Start ==\nx\n== Proof of it ==\n"), F.split("text", "\n")[0], F.lit("\n=== More ===\nz\n== End ==\nq"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"))
    return web.pinned_section(d, d.select("doc", F.lit("proof").alias("section")))


@query("SELECT 'n' || s_suppkey AS node_id, CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE 'derivation' END AS kind, CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE s_suppkey % 2 = 0 END AS ok, s_nationkey::INTEGER AS steps FROM supplier WHERE s_suppkey % 7 <> 3")
def s23_sheets(spark, sf_dir):
    """Records with absent keys have nulls; unreadable ones are left out here by their mark."""
    k = F.col("k")
    head = F.concat(F.lit('{"node_id":"n'), k, F.lit('"'))
    body = F.when(k % 5 == 2, "").otherwise(F.concat(F.lit(',"kind":"derivation","check":{"ok":'), (k % 2 == 0).cast("string"), F.lit("}")))
    step = F.concat(F.lit(',"steps":[{"n":'), F.col("n"), F.lit("}]"))
    text = F.when(k % 7 == 3, "{broken").otherwise(F.concat(head, body, step, F.lit("}")))
    rows = repository.sheets(spark, _folder(spark, _suppliers(spark, sf_dir), "sheets", text)).where("node_id is not null")
    return rows.select("node_id", "kind", "check.ok", F.col("steps")[0]["n"].alias("steps"))


@query("SELECT DISTINCT 'Cls' || p_partkey % 5 AS component, 'lib' || p_size AS library FROM part WHERE p_partkey % 3 > 0")
def j27_plugins(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 1, "planner_plugin").when(k % 3 == 2, "Plugin").otherwise("rate")
    value = F.concat(F.lit("'lib"), "p_size", F.when(k % 2 == 0, "::").otherwise("/"), F.lit("Cls"), k % 5, F.lit("'"))
    return repository.plugins(read(spark, sf_dir, "part").select(name.alias("name"), value.alias("value")))


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 50 AS j FROM supplier), f AS (SELECT DISTINCT j FROM s),
  own AS (SELECT 'n' || k AS component, 'p' || k % 9 AS package, 'e' || k % 4 AS executable, CASE WHEN k = j THEN 'gain,rate' ELSE 'rate' END AS parameters, 'b/config/p' || j || '.yaml' AS sources FROM s),
  loose AS (SELECT 'n' || j AS component, NULL AS package, NULL AS executable, 'gain' AS parameters, 'b/config/p' || j || '.yaml' AS sources FROM f WHERE j NOT IN (SELECT k FROM s) UNION ALL SELECT 'lonely' || j, NULL, NULL, 'x', 'b/config/p' || j || '.yaml' FROM f)
  SELECT * FROM own UNION ALL SELECT * FROM loose""")
def j28_components(spark, sf_dir):
    """Launch files pass shared parameter files; what no node claims is a component of its own."""
    s = _suppliers(spark, sf_dir)
    launch = _files(s, "concat('a', k, '/launch/main.launch.py')", "concat('Node(package=\"p', k % 9, '\", executable=\"e', k % 4, '\", name=\"n', k, '\", parameters=[\"config/p', k % 50, '.yaml\"])')")
    shared = s.select((F.col("k") % 50).alias("j")).distinct()
    files = _files(shared, "concat('b/config/p', j, '.yaml')", "concat('n', j, ':\\n  gain: 1\\n/**:\\n  rate: 2\\nlonely', j, ':\\n  x: 3\\n')")
    c = repository.components(launch.unionByName(files))
    return c.select("component", "package", "executable", F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("parameters"), F.array_join("sources", ",").alias("sources"))


@query("SELECT 'c' || s_suppkey AS component, 'S' || s_nationkey AS subsystem, 'ekf' AS algorithms FROM supplier")
def p16_gate(spark, sf_dir):
    """A confirmed proposal that leaves nothing unclassified passes whole."""
    brief = _suppliers(spark, sf_dir).select(F.concat(F.lit("c"), "k").alias("component"), F.concat(F.lit("S"), "n").alias("subsystem"), F.array(F.lit("ekf")).alias("algorithms"))
    return architecture.gate(architecture.propose_from_brief(brief), True).select("component", "subsystem", F.array_join("algorithms", ",").alias("algorithms"))


@query("SELECT o_orderkey AS id, o_orderpriority AS kind, o_totalprice AS price FROM orders")
def k10_write_json(spark, sf_dir):
    path = Scratch(spark, "json").path("rows")
    sinks.write_json(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("price")), path)
    return spark.read.schema("id long, kind string, price double").json(path)
