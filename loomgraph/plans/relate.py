"""Join queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fixed import CONTENT_STOPWORDS, GENERIC_WORDS, TECHNIQUE_STOPWORDS
from ..operators import graph as g
from ..operators import relate as r
from ..sources import changes
from ..sources.tables import Scratch, read
from .bindings import ENDS, REQ, endpoints, requires
from .registry import query

_FIRST = """fe AS (SELECT component, topic, role, arg_min(evidence, ord) AS evidence FROM ends GROUP BY ALL)"""
_LINKS = f"""{ENDS}, {_FIRST}, links AS (SELECT p.component AS pub, s.component AS sub, p.topic, p.evidence AS pub_evidence, s.evidence AS sub_evidence
  FROM fe p JOIN fe s ON p.topic = s.topic AND p.component <> s.component WHERE p.role = 'publishes' AND s.role = 'subscribes')"""


@query(f"WITH {_LINKS} SELECT * FROM links")
def j1_links(spark, sf_dir):
    return r.links(endpoints(spark, sf_dir))


@query(f"WITH {ENDS}, n AS (SELECT DISTINCT component, topic FROM ends) SELECT a.component AS a, b.component AS b, count(*) AS topics FROM n a JOIN n b ON a.topic = b.topic AND a.component < b.component GROUP BY ALL")
def j2_dataflow(spark, sf_dir):
    return r.dataflow(endpoints(spark, sf_dir))


_SIDES = """ends AS (SELECT c_custkey AS component, '/t' || (c_custkey * 7 % 1000) AS topic, CASE WHEN c_nationkey % 2 = 0 THEN 'publishes' ELSE 'subscribes' END AS role, c_name AS evidence, c_custkey AS ord FROM customer)"""


def _sides(spark, sf_dir):
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(c.alias("component"), F.concat(F.lit("/t"), c * 7 % 1000).alias("topic"), F.when(F.col("c_nationkey") % 2 == 0, "publishes").otherwise("subscribes").alias("role"), F.col("c_name").alias("evidence"), c.alias("ord"))


@query(f"WITH {_SIDES} SELECT component, topic, role, evidence, ord FROM ends WHERE role = 'publishes' AND topic NOT IN (SELECT topic FROM ends WHERE role = 'subscribes')")
def j3_unread(spark, sf_dir):
    return r.one_sided(_sides(spark, sf_dir))[0].select("component", "topic", "role", "evidence", "ord")


@query(f"WITH {_SIDES} SELECT component, topic, role, evidence, ord FROM ends WHERE role = 'subscribes' AND topic NOT IN (SELECT topic FROM ends WHERE role = 'publishes')")
def j3_unfed(spark, sf_dir):
    return r.one_sided(_sides(spark, sf_dir))[1].select("component", "topic", "role", "evidence", "ord")


@query(f"""WITH {_LINKS}, g AS (SELECT pub, sub, list_sort(list(DISTINCT topic::VARCHAR)) AS ts FROM links GROUP BY pub, sub)
  SELECT pub, sub, len(ts)::INTEGER AS n, array_to_string(ts, ', ') AS topics, pub || ' feeds ' || sub || ' through ' || array_to_string(ts, ', ') AS sentence FROM g""")
def j22_topic_edges(spark, sf_dir):
    return r.topic_edges_of(endpoints(spark, sf_dir))


@query(f"WITH {_LINKS} SELECT DISTINCT '- ' || pub || ' publishes ' || topic || '; ' || sub || ' reads it (' || sub_evidence || ')' AS line FROM links WHERE sub IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)")
def j32_upstream(spark, sf_dir):
    names = read(spark, sf_dir, "supplier").where("s_nationkey = 7").select(F.col("s_suppkey").cast("long").alias("component"))
    return r.upstream(r.links(endpoints(spark, sf_dir)), names)


@query("""WITH n AS (SELECT p_name AS component, p_brand AS executable FROM part),
  o AS (SELECT component, executable, count(*) OVER (PARTITION BY executable) AS k FROM n),
  names AS (SELECT component, component AS name FROM o UNION SELECT component, executable FROM o WHERE k = 1),
  f AS (SELECT DISTINCT 'src/' || replace(p_name, ' ', '_') || '.cpp' AS file, replace(p_name, ' ', '_') AS stem FROM part)
  SELECT DISTINCT component, file FROM names JOIN f ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(stem), '[^a-z0-9]', '', 'g')""")
def j5_stem_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    files = part.select(F.concat(F.lit("src/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".cpp")).alias("file")).distinct()
    return r.stem_matches(part.select(F.col("p_name").alias("component"), F.col("p_brand").alias("executable")), files)


@query("""WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part), l AS (SELECT DISTINCT p_name || ' ' || p_type AS label FROM part),
  nw AS (SELECT name, list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM n),
  lw AS (SELECT label, list_filter(regexp_split_to_array(lower(regexp_replace(label, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM l)
  SELECT name, label FROM nw, lw WHERE (len(nw.ws) > 0 AND list_has_all(lw.ws, nw.ws)) OR list_contains(lw.ws, regexp_replace(lower(name), '[^a-z0-9]', '', 'g'))""".replace("\\\\", "\\"))
def j6_label_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("name")).unionByName(part.select(F.col("p_brand").alias("name"))).distinct()
    return r.label_matches(names, part.select(F.concat_ws(" ", "p_name", "p_type").alias("label")))


@query("""SELECT k AS custkey, CASE WHEN l THEN 'left' ELSE 'right' END AS side FROM (
  SELECT coalesce(c_custkey, o_custkey) AS k, c_custkey IS NOT NULL AS l, o_custkey IS NOT NULL AS r
  FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey) WHERE NOT (l AND r)""")
def j4_both_side_misses(spark, sf_dir):
    a = read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    b = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return r.both_side_misses(a, b, "custkey")


_FLOW = """e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'shares_data_with' ELSE 'contains' END AS relation,
    l_linestatus AS confidence, l_orderkey::BIGINT * 10 + l_linenumber AS ord FROM lineitem),
  o AS (SELECT 'c' || (s_suppkey % 20) AS component, 's' || s_suppkey AS id FROM supplier UNION SELECT 'c' || (p_partkey % 20), 'p' || p_partkey FROM part WHERE p_partkey % 3 > 0),
  gn AS (SELECT 'p' || p_partkey AS id, p_partkey % 7 = 0 AS ext FROM part WHERE p_partkey % 13 > 0 UNION ALL SELECT 's' || s_suppkey, FALSE FROM supplier),
  t AS (SELECT component, e.*, dst AS other FROM e JOIN o ON o.id = src UNION ALL SELECT component, e.*, src AS other FROM e JOIN o ON o.id = dst),
  w AS (SELECT * FROM t WHERE relation IN ('calls', 'shares_data_with', 'rationale_for') AND (component, other) NOT IN (SELECT (component, id) FROM o) AND other IN (SELECT id FROM gn WHERE NOT ext)),
  fl AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY component, least(src, dst), greatest(src, dst), relation ORDER BY ord, src, dst, confidence) = 1)"""


def _flow_parts(spark, sf_dir):
    def name(mark, column):
        return F.concat(F.lit(mark), F.col(column))

    flag = F.col("l_returnflag")
    relation = F.when(flag == "A", "calls").when(flag == "N", "shares_data_with").otherwise("contains")
    edges = read(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), relation.alias("relation"), F.col("l_linestatus").alias("confidence"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("ord"))
    s, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    owners = s.select(F.concat(F.lit("c"), F.col("s_suppkey") % 20).alias("component"), name("s", "s_suppkey").alias("id")).unionByName(p.where("p_partkey % 3 > 0").select(F.concat(F.lit("c"), F.col("p_partkey") % 20).alias("component"), name("p", "p_partkey").alias("id")))
    nodes_ = p.where("p_partkey % 13 > 0").select(name("p", "p_partkey").alias("id"), (F.col("p_partkey") % 7 == 0).alias("external")).unionByName(s.select(name("s", "s_suppkey").alias("id"), F.lit(False).alias("external")))
    return edges, owners, nodes_


@query(f"WITH {_FLOW} SELECT component, src, dst, relation, confidence, ord, other FROM fl")
def j8_flows(spark, sf_dir):
    return r.flows(*_flow_parts(spark, sf_dir))


@query(f"""WITH {_FLOW}, en AS (SELECT DISTINCT 'c' || (l_suppkey % 20) AS component, '/t' || l_partkey % 50 AS topic, l_returnflag = 'R' AS pub FROM lineitem),
  ln AS (SELECT least(a.component, b.component) AS a, greatest(a.component, b.component) AS b, array_to_string(list_sort(list(DISTINCT a.topic)), ',') AS topics FROM en a JOIN en b ON a.topic = b.topic AND a.component <> b.component AND a.pub AND NOT b.pub GROUP BY 1, 2),
  m AS (SELECT fl.*, o.component AS other_c FROM fl JOIN o ON o.id = other AND o.component <> fl.component),
  f AS (SELECT least(component, other_c) AS a, greatest(component, other_c) AS b, relation, confidence FROM m QUALIFY row_number() OVER (PARTITION BY least(component, other_c), greatest(component, other_c), relation ORDER BY component, ord, confidence) = 1)
  SELECT f.a, f.b, f.relation, f.confidence, coalesce(topics, '') AS topics, topics IS NOT NULL AS confirmed FROM f LEFT JOIN ln ON ln.a = f.a AND ln.b = f.b""")
def j9_confirmed(spark, sf_dir):
    edges, owners, nodes_ = _flow_parts(spark, sf_dir)
    li = read(spark, sf_dir, "lineitem")
    ends = li.select(F.concat(F.lit("c"), F.col("l_suppkey") % 20).alias("component"), F.concat(F.lit("/t"), F.col("l_partkey") % 50).alias("topic"), F.when(F.col("l_returnflag") == "R", "publishes").otherwise("subscribes").alias("role"), F.lit("").alias("evidence"), F.col("l_orderkey").alias("ord"))
    return r.confirm_flows(r.flows(edges, owners, nodes_), owners, r.links(ends))


@query(f"WITH RECURSIVE {REQ}, k AS (SELECT p_partkey::BIGINT AS id FROM part WHERE p_size > 5) SELECT DISTINCT id FROM (SELECT src AS id FROM req UNION SELECT dst FROM req) WHERE id NOT IN (SELECT id FROM k)")
def j19_supporting(spark, sf_dir):
    return r.supporting(requires(spark, sf_dir), read(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").cast("long").alias("id")))


@query("""WITH t(key, items) AS (VALUES ('3', []::VARCHAR[]), ('5', ['a', 'b']), ('click', ['c']), ('view', ['d', 'e']), ('u7', ['f'])),
  e AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type, 'u' || (user_id % 10) AS u FROM events)
  SELECT event_id, CASE WHEN a.key IS NOT NULL THEN array_to_string(a.items, ',') WHEN b.key IS NOT NULL THEN array_to_string(b.items, ',') WHEN c.key IS NOT NULL THEN array_to_string(c.items, ',') END AS found,
    NOT coalesce(len(CASE WHEN a.key IS NOT NULL THEN a.items WHEN b.key IS NOT NULL THEN b.items ELSE c.items END), 0) > 0 AS unclassified
  FROM e LEFT JOIN t a ON a.key = e.k LEFT JOIN t b ON b.key = e.event_type LEFT JOIN t c ON c.key = e.u""")
def j16_priority_lookup(spark, sf_dir):
    table = spark.createDataFrame([("3", []), ("5", ["a", "b"]), ("click", ["c"]), ("view", ["d", "e"]), ("u7", ["f"])], "key string, items array<string>")
    e = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type", F.concat(F.lit("u"), F.col("user_id") % 10).alias("u"))
    found = r.priority_lookup(e, ["k", "event_type", "u"], F.broadcast(table))
    return found.select("event_id", F.array_join("found", ",").alias("found"), (F.coalesce(F.size("found"), F.lit(0)) <= 0).alias("unclassified"))


@query("""WITH ids AS (SELECT lower(replace(n_name, ' ', '_')) || CASE WHEN n_nationkey % 3 = 0 THEN '_x' ELSE '' END AS id, n_name AS name FROM nation WHERE n_nationkey % 2 = 0),
  al AS (SELECT lower(replace(n_name, ' ', '_')) AS alias, 'alias_' || n_nationkey AS target FROM nation WHERE n_nationkey % 5 = 0),
  q AS (SELECT n_name AS name, replace(lower(n_name), ' ', '_') AS s FROM nation)
  SELECT q.name, coalesce(a.id, al.target, c.id) AS resolved FROM q LEFT JOIN ids a ON a.id = s LEFT JOIN al ON al.alias = s LEFT JOIN ids c ON lower(c.name) = lower(q.name)""")
def j17_name_cascade(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    base = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    ids = n.where("n_nationkey % 2 = 0").select(F.concat(base, F.when(F.col("n_nationkey") % 3 == 0, "_x").otherwise("")).alias("id"), F.col("n_name").alias("name"))
    al = n.where("n_nationkey % 5 = 0").select(base.alias("alias"), F.concat(F.lit("alias_"), F.col("n_nationkey")).alias("target"))
    return r.name_cascade(n.select(F.col("n_name").alias("name")), ids, al).select("name", "resolved")


@query(f"""WITH RECURSIVE {REQ}, r AS (SELECT src, dst FROM req UNION SELECT r.src, req.dst FROM r JOIN req ON req.src = r.dst),
  u AS (SELECT 'c' || l_suppkey AS component, l_partkey::BIGINT AS algorithm FROM lineitem)
  SELECT DISTINCT component, dst AS node FROM u JOIN r ON r.src = algorithm UNION SELECT component, algorithm FROM u""")
def j18_components_reaching(spark, sf_dir):
    uses = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey")).alias("component"), F.col("l_partkey").cast("long").alias("algorithm"))
    return r.components_reaching(uses, requires(spark, sf_dir), "c")


@query("""WITH o AS (SELECT 'own' || n_nationkey AS owner, lower(n_name) AS name, (n_nationkey % 4 + 1) || '.' || (n_nationkey % 3 + 1) AS section, n_nationkey AS prio FROM nation),
  q AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 5 + 1)::VARCHAR ELSE (l_partkey % 5 + 1) || '.' || (l_suppkey % 4 + 1) || '.' || l_linenumber END AS number,
          'see ' || CASE WHEN l_linenumber = 3 THEN 'own' || (l_partkey % 25) ELSE 'there' END AS text FROM lineitem),
  h AS (SELECT q.*, o.* FROM q JOIN o ON number = section OR starts_with(section, number || '.') OR starts_with(number, section || '.')),
  b AS (SELECT *, row_number() OVER (PARTITION BY ref_id, number, text ORDER BY prio, owner) AS k FROM h)
  SELECT DISTINCT ref_id, number, owner, section FROM b WHERE k = 1 AND NOT contains(lower(text), lower(owner)) AND NOT contains(lower(text), name)""")
def j25_section_refs(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    owners = n.select(F.concat(F.lit("own"), F.col("n_nationkey")).alias("owner"), F.lower("n_name").alias("name"), F.concat(F.col("n_nationkey") % 4 + 1, F.lit("."), F.col("n_nationkey") % 3 + 1).alias("section"), F.col("n_nationkey").alias("prio"))
    li = read(spark, sf_dir, "lineitem")
    number = F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") % 5 + 1).cast("string")).otherwise(F.concat(F.col("l_partkey") % 5 + 1, F.lit("."), F.col("l_suppkey") % 4 + 1, F.lit("."), F.col("l_linenumber")))
    text = F.concat(F.lit("see "), F.when(F.col("l_linenumber") == 3, F.concat(F.lit("own"), F.col("l_partkey") % 25)).otherwise("there"))
    return r.section_owners(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), number.alias("number"), text.alias("text")), owners)


@query("""WITH c(family, letter, pattern, prio) AS (VALUES ('N', 'x', 'automobile', 1), ('N', 'u', 'building', 2), ('N', 'z', 'furniture|household', 3)),
  s AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'x_k' WHEN 1 THEN 'u' WHEN 2 THEN 'z_1' ELSE 'q' END AS symbol, lower(c_mktsegment) AS meaning, substr(CASE c_custkey % 4 WHEN 0 THEN 'x_k' WHEN 1 THEN 'u' WHEN 2 THEN 'z_1' ELSE 'q' END, 1, 1) AS own FROM customer),
  h AS (SELECT s.*, letter, row_number() OVER (PARTITION BY id, symbol ORDER BY prio, letter) AS k FROM s JOIN c ON letter <> own AND regexp_matches(meaning, pattern) WHERE own IN ('x', 'u', 'z'))
  SELECT id, symbol, letter AS clashes_with FROM h WHERE k = 1""")
def j26_notation(spark, sf_dir):
    conventions = spark.createDataFrame([("N", "x", "automobile", 1), ("N", "u", "building", 2), ("N", "z", "furniture|household", 3)], "family string, letter string, pattern string, prio int")
    symbol = F.element_at(F.array(*map(F.lit, ("x_k", "u", "z_1", "q"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), symbol.alias("symbol"), F.col("c_mktsegment").alias("meaning"), F.lit("N").alias("family"))
    return r.notation_conflicts(s, conventions)


_LINES = """lines AS (SELECT doc_id AS doc, i AS ln, arr[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents), LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i))"""


def lines_of(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return d.select("doc", (F.col("p") + 1).alias("ln"), "text")


_WORD = r"regexp_extract(text, '^\s*([A-Za-z_][A-Za-z0-9_]*)', 1)"


@query(f"WITH {_LINES}, h AS (SELECT doc, ln, {_WORD} AS name FROM lines) SELECT h.doc, h.ln::INTEGER AS ln, l.ln::INTEGER AS from_ln FROM h JOIN h l ON l.doc = h.doc AND l.ln BETWEEN h.ln - 15 AND h.ln - 1 AND l.name = h.name WHERE h.name <> ''")
def j31_lookback(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    hits = lines.select("doc", "ln", F.regexp_extract("text", r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name")).where("name <> ''")
    return r.look_back(lines, hits)


@query(rf"""WITH {_LINES}, x AS (SELECT doc, ln, CASE WHEN ln % 3 = 0 THEN text || ' covariance_m = gain_' || (ln % 5) ELSE text END AS text FROM lines)
  SELECT doc, ln::INTEGER AS ln, regexp_extract(trim(text), 'covariance\w*\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$', 1) AS name FROM x WHERE regexp_matches(trim(text), 'covariance\w*\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$')""")
def j31_assignments(spark, sf_dir):
    text = F.when(F.col("ln") % 3 == 0, F.concat("text", F.lit(" covariance_m = gain_"), F.col("ln") % 5)).otherwise(F.col("text"))
    return r.covariance_assignments(lines_of(spark, sf_dir).withColumn("text", text))


@query(rf"""WITH RECURSIVE {_LINES}, w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), tw AS (SELECT right(w, 3) AS term, 2 AS strength FROM w UNION SELECT w, 1 FROM w),
  te AS (SELECT term, strength, row_number() OVER (ORDER BY strength DESC, term) AS prio FROM tw),
  u AS (SELECT doc, ln, lower(text) AS low FROM lines WHERE NOT regexp_matches(text, '^\s*(#|//|\*|import\b|from\b\s+\S+\s+import\b|\s*<!--)')),
  h AS (SELECT doc, prio, list_sort(list(ln)) AS lns FROM u JOIN te ON contains(low, term) GROUP BY doc, prio),
  st AS (SELECT doc, 0::BIGINT AS k, []::BIGINT[] AS claimed, NULL::BIGINT AS pick FROM (SELECT DISTINCT doc FROM h)
    UNION ALL SELECT doc, k, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END, pick FROM (
      SELECT st.doc, st.k + 1 AS k, claimed, list_filter(h.lns, lambda l: len(list_filter(claimed, lambda c: abs(l - c) <= 5)) = 0)[1] AS pick
      FROM st LEFT JOIN h ON h.doc = st.doc AND h.prio = st.k + 1 WHERE st.k < (SELECT count(*) FROM te))),
  sp AS (SELECT doc, pick AS ln, term, row_number() OVER (PARTITION BY doc ORDER BY strength DESC, pick) AS place FROM st JOIN te ON prio = k WHERE pick IS NOT NULL)
  SELECT doc, 'text' AS path, ln::INTEGER AS ln, term, place::INTEGER AS place, greatest(ln - 5, 1)::INTEGER AS first, (ln + 5)::INTEGER AS last FROM sp WHERE place <= 3""")
def j29_neighbourhood(spark, sf_dir):
    """The words of all parts' names, and as parameters their last three letters, in all documents."""
    lines = lines_of(spark, sf_dir).withColumn("path", F.lit("text")).withColumn("rank", F.lit(0))
    words = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    both = words.select(F.right("term", F.lit(3)).alias("term"), F.lit(2).alias("strength")).unionByName(words.select("term", F.lit(1).alias("strength"))).distinct()
    terms = both.select("term", "strength", F.row_number().over(Window.orderBy(F.desc("strength"), "term")).alias("prio"))
    return r.evidence(lines, terms).select("doc", "path", "ln", "term", "place", "first", "last")


@query("""WITH b AS (SELECT 'docs/' || (doc_id % 50) || '/' || doc_id || '.md' AS path, text AS t FROM documents WHERE doc_id % 10 <> 3),
  n AS (SELECT 'docs/' || (doc_id % 50) || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 10 <> 4)
  SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS state, substr(sha256(n.t), 1, 16) AS hash, n.t AS text
  FROM b FULL JOIN n ON b.path = n.path WHERE b.t IS DISTINCT FROM n.t""")
def s1_changes(spark, sf_dir):
    """Documents as files that are read, changed, and read again: the second reading."""
    scratch = Scratch(spark, "files")
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    own = d.withColumn("path", F.concat(F.lit("docs/"), i % 50, F.lit("/"), i, F.lit(".md")))
    changes.write_files(own.where(i % 10 != 3), scratch.path("repo"))
    first = changes.changes(spark, scratch.path("repo"), scratch.path("state"), 10_000_000)
    changes.write_files(own.where(i % 10 == 4).withColumn("text", F.lit(None).cast("string")), scratch.path("repo"))
    changes.write_files(own.where((i % 10 != 4) & ((i % 7 == 0) | (i % 10 == 3))).withColumn("text", F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), scratch.path("repo"))
    return changes.changes(spark, scratch.path("repo"), scratch.path("state"), 10_000_000).select(*first.columns)


@query("""WITH b AS (SELECT doc_id::VARCHAR AS path, substr(sha256(text), 1, 16) AS h FROM documents WHERE doc_id % 10 <> 3),
  n AS (SELECT doc_id::VARCHAR AS path, substr(sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END), 1, 16) AS h FROM documents WHERE doc_id % 10 <> 4)
  SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM b FULL JOIN n ON b.path = n.path WHERE b.h IS DISTINCT FROM n.h""")
def j33_stale(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    before = d.where("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    now = d.where("doc_id % 10 <> 4").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return r.stale_paths(r.file_hashes(before), r.file_hashes(now))


@query("SELECT doc_id AS path, substr(sha256(text), 1, 16) AS hash FROM documents")
def a11_hashes(spark, sf_dir):
    return r.file_hashes(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN '/part' || l_partkey ELSE '/to' || l_suppkey END AS topic FROM lineitem""")
def j21_resolve_topic(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    name = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "/").otherwise(""), F.lit("part"), F.col("l_partkey"))
    inside = F.when(F.col("l_linenumber") % 2 == 0, "other").otherwise(F.concat(F.lit("part"), F.col("l_partkey")))
    maps = F.array(F.struct(inside.alias("inside"), F.lit("lost").alias("outside")), F.struct(inside.alias("inside"), F.concat(F.lit("to"), F.col("l_suppkey")).alias("outside")))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), r.resolve_topic(name, maps).alias("topic"))


@query("""WITH a AS (SELECT *, 't' || c_nationkey || '@a/B' || CASE c_custkey % 3 WHEN 0 THEN '[' WHEN 1 THEN ']' ELSE '@' END || 'c.D' AS argument, CASE WHEN c_custkey % 4 = 0 THEN '/r' ELSE '/t' END || c_nationkey AS topic FROM customer WHERE c_custkey % 5 > 0)
  SELECT c_custkey AS component, topic, unnest(CASE c_custkey % 3 WHEN 0 THEN ['publishes'] WHEN 1 THEN ['subscribes'] ELSE ['publishes', 'subscribes'] END) AS role, 'bridge argument ' || argument AS evidence FROM a""")
def j20_bridge_endpoints(spark, sf_dir):
    c = F.col("c_custkey")
    mark = F.element_at(F.array(*map(F.lit, "[]@")), (c % 3 + 1).cast("int"))
    own = F.array(F.struct(F.concat(F.lit("/t"), F.col("c_nationkey")).alias("inside"), F.concat(F.lit("r"), F.col("c_nationkey")).alias("outside")))
    a = read(spark, sf_dir, "customer").select(
        c.alias("component"), F.when(c % 5 > 0, "parameter_bridge").otherwise("other").alias("executable"), F.concat(F.lit("t"), F.col("c_nationkey"), F.lit("@a/B"), mark, F.lit("c.D")).alias("argument"),
        F.when(c % 4 == 0, own).otherwise(F.array().cast(r.REMAPPINGS)).alias("remappings"), c.alias("ord"),
    )
    return r.bridge_endpoints(a).select("component", "topic", "role", "evidence")


@query("""SELECT p_partkey AS component, CASE WHEN p_partkey % 4 = 0 THEN '/to' || p_size ELSE '/in' || p_size END AS topic, CASE WHEN p_partkey % 3 = 0 THEN 'publishes' ELSE 'subscribes' END AS role,
  'nav.yaml ' || CASE WHEN p_partkey % 3 = 0 THEN 'cmd_out' ELSE 'scan_router' END AS evidence FROM part WHERE p_partkey % 5 > 0""")
def j20_parameter_endpoints(spark, sf_dir):
    p = F.col("p_partkey")
    own = F.array(F.struct(F.concat(F.lit("in"), F.col("p_size")).alias("inside"), F.concat(F.lit("/to"), F.col("p_size")).alias("outside")))
    value = F.when(p % 5 > 0, F.concat(F.lit(" '/in"), F.col("p_size"), F.lit("' "))).otherwise(F.lit("0.5"))
    rows = read(spark, sf_dir, "part").select(
        p.alias("component"), F.when(p % 3 == 0, "cmd_out").otherwise("scan_router").alias("name"), value.alias("value"), F.lit("nav.yaml").alias("source"), F.when(p % 4 == 0, own).otherwise(F.array().cast(r.REMAPPINGS)).alias("remappings"), p.alias("ord")
    )
    return r.parameter_endpoints(rows).select("component", "topic", "role", "evidence")


@query("""SELECT s_suppkey AS component, CASE WHEN s_suppkey % 2 = 0 THEN '/odom' || s_nationkey ELSE '/odom' END AS topic, CASE WHEN t = 1 THEN 'publishes' ELSE 'subscribes' END AS role,
  'src/n' || s_suppkey || '.py:' || (CASE WHEN t = 1 THEN 2 ELSE 3 END) || CASE WHEN t = 1 THEN ' create_publisher' ELSE ' create_subscription' END AS evidence FROM supplier, (SELECT unnest([1, 2]) AS t) WHERE s_suppkey % 3 > 0""")
def j20_code_endpoints(spark, sf_dir):
    s = F.col("s_suppkey")
    node = F.concat(F.lit("n"), s)
    text = F.when(s % 3 > 0, "def f(self):\n    self.create_publisher(Odometry, 'odom', 10)\n    self.create_subscription(Odometry, topic='odom', callback=g)\n    self.create_timer(1, 'x')\n").otherwise("def (")
    rows = read(spark, sf_dir, "supplier")
    own = F.array(F.struct(F.lit("/odom").alias("inside"), F.concat(F.lit("/odom"), F.col("s_nationkey")).alias("outside")))
    comps = rows.select(s.alias("component"), node.alias("executable"), F.when(s % 2 == 0, own).otherwise(F.array().cast(r.REMAPPINGS)).alias("remappings"))
    files = rows.select(F.concat(F.lit("src/"), node, F.lit(".py")).alias("path"), text.alias("text"))
    return r.code_endpoints(comps, files).select("component", "topic", "role", "evidence")


@query(f"""WITH RECURSIVE {REQ}, c AS (SELECT p_partkey::BIGINT AS root, 'f' || (p_size % 3) AS family, p_size % 3 AS prio FROM part WHERE p_size > 45),
  b AS (SELECT root, root AS id FROM c UNION SELECT b.root, req.dst FROM b JOIN req ON req.src = b.id)
  SELECT id, arg_min(family, prio) AS family FROM b JOIN c USING (root) WHERE id IN (SELECT p_partkey FROM part) GROUP BY id""")
def j26_family(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    own = p.where("p_size > 45").select(F.concat(F.lit("f"), F.col("p_size") % 3).alias("family"), F.col("p_partkey").cast("long").alias("root"), (F.col("p_size") % 3).alias("prio"))
    return r.families(p.select(F.col("p_partkey").cast("long").alias("id")), own, requires(spark, sf_dir))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]', '_', 'g'), '_') AS slug FROM part")
def f1_slug(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(replace(p_type, ' ', '') || p_brand, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS words FROM part")
def f3_tokens(spark, sf_dir):
    name = F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.col("p_brand"))
    spaced = t.camel_words(name)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(spaced, " ").alias("words"))


@query("SELECT p_partkey AS id, split_part(p_name, ' ', 1) || lower(substr(p_name, length(split_part(p_name, ' ', 1)) + 1)) AS variant FROM part")
def f7_title_variants(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.title_variant(F.col("p_name")).alias("variant"))


@query(r"""WITH h AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 200) AS head FROM documents),
  g AS (SELECT *, replace(head, '.' || chr(10), '. ') AS flat FROM h),
  c AS (SELECT *, CASE WHEN contains(flat, '. ') THEN 200 - strpos(reverse(flat), ' .') ELSE 0 END AS stop FROM g)
  SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN stop - 1 > 80 THEN substr(head, 1, stop) || ' \u2026' ELSE regexp_replace(head, '\s+$', '') || ' \u2026' END AS short FROM c""".replace("\\u2026", "\u2026"))
def f9_trim(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.trim_sentence(F.col("text"), 200).alias("short"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'PID of the Map' WHEN 1 THEN 'The LQR For Planning' ELSE 'Particle Filter' END AS title FROM supplier""")
def g20_title(spark, sf_dir):
    ident = F.element_at(F.array(*map(F.lit, ("pid_of_the_map", "the_lqr_for_planning", "particle_filter"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), t.display_title(ident).alias("title"))


_GENERIC = "[" + ", ".join(f"'{w}'" for w in sorted(GENERIC_WORDS)) + "]"


@query(f"""WITH n AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name || ' Matrix Kalman ' || p_brand), '[a-z]+') AS ws FROM part),
  x AS (SELECT id, i - 1 AS ord, ws[i] AS term, 1 AS strength FROM n, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
  w AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY ord)) - 1 AS ord, term, strength FROM x WHERE length(term) > 4 AND NOT list_contains({_GENERIC}, term)),
  u AS (SELECT p_partkey AS id, 0 AS ord, p_brand AS term, 2 AS strength FROM part UNION ALL SELECT p_partkey, 1, 'kalman', 2 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT * FROM w),
  f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id, lower(term) ORDER BY strength DESC, ord) = 1)
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY strength DESC, ord, term))::INTEGER AS prio, term, strength FROM f""")
def f6_terms(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    knobs = p.select(F.col("p_partkey").alias("id"), F.lit(0).alias("ord"), F.col("p_brand").alias("parameter")).unionByName(
        p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(1).alias("ord"), F.lit("kalman").alias("parameter"))
    )
    return r.terms_for(p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" Matrix Kalman "), "p_brand").alias("name")), knobs)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]{{2,}})', 1), lambda w: NOT list_contains({_list(CONTENT_STOPWORDS)}, w)))), ' ') AS tokens FROM conversations""")
def f4_content_tokens(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(t.content_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' of the Method (' || p_brand || ')'), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_list(TECHNIQUE_STOPWORDS)}, w)))), ' ') AS terms FROM part""")
def f5_technique_terms(spark, sf_dir):
    name = F.concat("p_name", F.lit(" of the Method ("), "p_brand", F.lit(")"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(t.technique_terms(name), " ").alias("terms"))


@query("SELECT vec_id, array_to_string(list_filter(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > 0 THEN 'v' || i ELSE '' END), lambda x: x <> ''), ',') AS fused FROM embeddings")
def f12_flags(spark, sf_dir):
    e = F.col("embedding")
    names = F.transform(F.sequence(F.lit(1), F.size(e)), lambda i: F.concat(F.lit("v"), i.cast("string")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(t.flags(F.transform(e, lambda x: x > 0), names), ",").alias("fused"))


@query(r"""WITH s AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '\mathbf{R}_t' WHEN 1 THEN 'R_k' WHEN 2 THEN ' x' WHEN 3 THEN 'rate' ELSE '\bm{Q}' END AS symbol FROM customer)
  SELECT id, CASE id % 5 WHEN 0 THEN 'R' WHEN 1 THEN 'R' WHEN 2 THEN 'x' WHEN 3 THEN '' ELSE 'Q' END AS letter FROM s""")
def f13_letter(spark, sf_dir):
    symbol = F.element_at(F.array(*map(F.lit, (r"\mathbf{R}_t", "R_k", " x", "rate", r"\bm{Q}"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), t.bare_letter(symbol).alias("letter"))


@query("SELECT s_suppkey AS id, 'arxiv:' || s_nationkey AS document, s_nationkey || '.' || (s_suppkey % 9) || ',' || (s_suppkey % 4) AS numbers FROM supplier")
def f14_numbers(spark, sf_dir):
    s = F.col("s_suppkey")
    number = F.concat(F.col("s_nationkey").cast("string"), F.lit("."), (s % 9).cast("string"))
    text = F.concat(F.lit("See Section "), number, F.lit(" and sec. "), (s % 4).cast("string"), F.lit(", not step 3."))
    return read(spark, sf_dir, "supplier").select(s.alias("id"), t.base_document(F.concat(F.lit("arxiv:"), F.col("s_nationkey"), F.lit("#"), s)).alias("document"), F.array_join(t.section_numbers(text), ",").alias("numbers"))


@query("SELECT event_id, props AS object FROM events")
def f17_outer_json(spark, sf_dir):
    i = F.col("event_id") % 3
    reply = F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 1, F.concat(F.lit("Here: "), "props", F.lit(" as asked."))).otherwise(F.concat(F.lit(" "), "props", F.lit("\n")))
    return read(spark, sf_dir, "events").select("event_id", t.outer_json(reply).alias("object"))


@query("SELECT page_id, 'GET ' || url || '?a=1&key=*** and api_key=*** done' AS line FROM pages")
def f18_redact(spark, sf_dir):
    p = F.col("page_id").cast("string")
    line = F.concat(F.lit("GET "), "url", F.lit("?a=1&key="), p, F.lit("-x_Y and api_key=AB"), p, F.lit(" done"))
    return read(spark, sf_dir, "pages").select("page_id", t.redact(line).alias("line"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Copyright ' || source || chr(10) || 'All of it, ' || lang END AS notice FROM documents")
def f20_notice(spark, sf_dir):
    i = F.col("doc_id")
    who = F.when(i % 3 > 0, "Copyright ").otherwise("By ")
    text = F.concat(F.lit("\n/*\n * "), who, "source", F.lit("  \n * All of it, "), "lang", F.lit("\n */\nint x; /* later */\n"), "text")
    return read(spark, sf_dir, "documents").select("doc_id", t.header_notice(text).alias("notice"))


@query(f"WITH {_LINES} SELECT doc, count(*) FILTER (WHERE regexp_matches(x, '^\\s*(#|//|\\*|import\\b|from\\b\\s+\\S+\\s+import\\b|<!--)')) AS never, count(*) AS lines FROM (SELECT doc, CASE ln % 7 WHEN 0 THEN '  # ' WHEN 1 THEN 'import ' WHEN 2 THEN 'from a import b ' WHEN 3 THEN 'importance ' ELSE '' END || text AS x FROM lines) GROUP BY doc".replace("\\\\", "\\"))
def p10_never_evidence(spark, sf_dir):
    from ..functions.fixed import NEVER_EVIDENCE

    k = F.col("ln") % 7
    text = F.concat(F.when(k == 0, "  # ").when(k == 1, "import ").when(k == 2, "from a import b ").when(k == 3, "importance ").otherwise(""), "text")
    return lines_of(spark, sf_dir).groupBy("doc").agg(F.count_if(text.rlike(NEVER_EVIDENCE)).alias("never"), F.count(F.lit(1)).alias("lines"))
