"""Graph queries over the synthetic prerequisite graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import reachability
from ..sources.tables import read
from .bindings import NODES, REQ, nodes, requires
from .registry import query

def _last(spark, sf_dir):
    return read(spark, sf_dir, "part").agg(F.max("p_partkey").cast("long").alias("id"))


@query(f"""WITH RECURSIVE {REQ}, r AS (SELECT src, dst FROM req
  UNION SELECT r.src, req.dst FROM r JOIN req ON r.dst = req.src) SELECT src, dst FROM r""")
def g3_closure_targets(spark, sf_dir):
    return reachability.pairs(requires(spark, sf_dir))


@query(f"""WITH RECURSIVE {REQ}, r AS (SELECT src, dst FROM req
  UNION SELECT r.src, req.dst FROM r JOIN req ON r.dst = req.src) SELECT src AS id, count(*) AS cost FROM r GROUP BY src""")
def g19_closure_cost(spark, sf_dir):
    return reachability.counts_below(requires(spark, sf_dir)).withColumnRenamed("n", "cost")


_ORDER = """deg AS (SELECT dst AS id, count(*) AS w FROM req GROUP BY dst),
  included AS (SELECT id, row_number() OVER (ORDER BY -coalesce(w, 0), id) AS rank FROM {set} LEFT JOIN deg USING (id)),
  needs AS (SELECT i.id, i.rank, coalesce(list(e.dst) FILTER (WHERE j.id IS NOT NULL), []) AS needs
            FROM included i LEFT JOIN req e ON e.src = i.id LEFT JOIN included j ON j.id = e.dst GROUP BY i.id, i.rank),
  walk(step, done, pick) AS (
    SELECT 0, []::BIGINT[], NULL::BIGINT
    UNION ALL
    SELECT w.step + 1, list_append(w.done, n.pick), n.pick
    FROM walk w, LATERAL (SELECT arg_min(id, rank) AS pick FROM needs
       WHERE NOT list_contains(w.done, id) AND len(list_filter(needs.needs, lambda x: NOT list_contains(w.done, x))) = 0) n
    WHERE n.pick IS NOT NULL)"""


@query(f"""WITH RECURSIVE {REQ}, t AS (SELECT max(p_partkey)::BIGINT AS id FROM part),
  r AS (SELECT e.dst AS id FROM req e JOIN t ON e.src = t.id UNION SELECT e.dst FROM r JOIN req e ON e.src = r.id),
  {_ORDER.format(set='r')}
  SELECT t.id AS target, step::INTEGER AS pos, pick AS id FROM walk, t WHERE pick IS NOT NULL""")
def g4_syllabus(spark, sf_dir):
    return g.syllabus(requires(spark, sf_dir), _last(spark, sf_dir))


@query(f"""WITH RECURSIVE {REQ}, e AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS ord FROM req),
  w(id, n, ords, path) AS (SELECT max(p_partkey)::BIGINT, 0, []::BIGINT[], [max(p_partkey)::BIGINT] FROM part
    UNION ALL SELECT e.dst, n + 1, list_append(ords, e.ord), list_append(path, e.dst) FROM w JOIN e ON e.src = w.id
    WHERE n < 14 AND e.dst >= 3 AND w.id <> 3),
  b AS (SELECT path FROM w WHERE id = 3 ORDER BY n, ords LIMIT 1)
  SELECT (i - 1)::INTEGER AS pos, path[i] AS id FROM b, LATERAL (SELECT unnest(range(1, len(path) + 1)) AS i)""")
def g5_chain(spark, sf_dir):
    e = requires(spark, sf_dir).withColumn("ord", F.col("src") * 2**31 + F.col("dst"))  # in order of (src, dst)
    return g.shortest_chain(e, _last(spark, sf_dir).first()["id"], 3)


@query(f"""WITH RECURSIVE {REQ}, r AS (SELECT src, dst FROM req UNION SELECT r.src, req.dst FROM r JOIN req ON r.dst = req.src)
  SELECT e.src, e.dst FROM req e JOIN part p ON p.p_partkey = e.src
  WHERE p.p_size > 40 OR NOT EXISTS (SELECT 1 FROM req m JOIN r ON r.src = m.dst WHERE m.src = e.src AND r.dst = e.dst)""")
def g6_reduction(spark, sf_dir):
    return g.transitive_reduction(requires(spark, sf_dir), nodes(spark, sf_dir).where("type = 'algorithm'"))


@query("""SELECT DISTINCT 'r' || n_regionkey AS root, 'p' || l_partkey AS id
  FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40""")
def g7_algorithms_under(spark, sf_dir):
    def edge(frame, a, ka, b, kb):
        return frame.select(F.concat(F.lit(a), F.col(ka)).alias("src"), F.concat(F.lit(b), F.col(kb)).alias("dst"))

    hierarchy = (
        edge(read(spark, sf_dir, "nation"), "r", "n_regionkey", "n", "n_nationkey")
        .unionByName(edge(read(spark, sf_dir, "customer"), "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(edge(read(spark, sf_dir, "orders"), "c", "o_custkey", "o", "o_orderkey"))
        .unionByName(edge(read(spark, sf_dir, "lineitem"), "o", "l_orderkey", "p", "l_partkey"))
    )
    algorithms = read(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("id"))
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"))
    return g.algorithms_under(hierarchy, algorithms, roots)


@query()
def g8_learning_path(spark, sf_dir):
    """All algorithms, for a reader who denies every sixth assumed node; held against plain Python in the tests."""
    n = nodes(spark, sf_dir)
    known = g.floor(n, not_known=n.where("id % 6 = 0"))
    return g.learning_path(requires(spark, sf_dir), n.where("type = 'algorithm'"), known)


@query("""WITH RECURSIVE n AS (SELECT 'n' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'algorithm' WHEN 2 THEN 'concept' ELSE 'component' END AS type FROM nation),
  e AS (SELECT 'n' || a.n_nationkey AS src, 'n' || b.n_nationkey AS dst, CASE (a.n_nationkey + b.n_nationkey) % 3 WHEN 0 THEN 'contains' WHEN 1 THEN 'uses' ELSE 'requires' END AS rel
        FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey),
  t AS (SELECT e.*, s.type AS st, d.type AS dt FROM e JOIN n s ON s.id = src JOIN n d ON d.id = dst),
  r AS (SELECT src, dst FROM e WHERE rel = 'requires' UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst AND e.rel = 'requires')
  SELECT rule, src, dst FROM (SELECT src, dst, CASE
    WHEN rel = 'contains' AND (st NOT IN ('system','subsystem','component') OR dt IN ('concept','technique')) THEN 'contains outside the architecture'
    WHEN rel = 'uses' AND (st NOT IN ('system','subsystem','component') OR dt <> 'algorithm') THEN 'uses something else than an algorithm'
    WHEN rel = 'requires' AND dt NOT IN ('algorithm','concept','technique','failure_mode') THEN 'requires outside the canon' END AS rule FROM t) WHERE rule IS NOT NULL
  UNION ALL SELECT 'requires on a cycle', src, dst FROM e WHERE rel = 'requires' AND EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src)""")
def g9_layer_violations(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("system", "algorithm", "concept", "component"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    n = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), kind.alias("type"))
    a = nation.select(F.col("n_nationkey").alias("a"), "n_regionkey")
    b = nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    rel = F.element_at(F.array(*map(F.lit, ("contains", "uses", "requires"))), ((F.col("a") + F.col("b")) % 3 + 1).cast("int"))
    e = a.join(b, "n_regionkey").select(F.concat(F.lit("n"), F.col("a")).alias("src"), F.concat(F.lit("n"), F.col("b")).alias("dst"), rel.alias("rel"))
    return g.violations(n, e)


@query(f"""WITH {REQ}, {NODES}, used AS (SELECT l_partkey::BIGINT AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)
  SELECT id FROM nodes WHERE tier <> 'assumed' AND id NOT IN (SELECT id FROM used)""")
def g10_orphans(spark, sf_dir):
    used = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    part_ends = used.select(F.col("dst").alias("src"), "dst")
    return g.orphans(nodes(spark, sf_dir), part_ends)


@query(f"""WITH RECURSIVE {REQ}, s AS (SELECT id, 0 AS k FROM (SELECT src AS id FROM req UNION SELECT dst FROM req)
  UNION SELECT req.src, k + 1 FROM s JOIN req ON req.dst = s.id) SELECT id, max(k)::INTEGER AS depth FROM s GROUP BY id""")
def g15_depth(spark, sf_dir):
    return g.depths(requires(spark, sf_dir))


@query("""WITH h AS (SELECT 'r' || r_regionkey AS id, 1 AS level FROM region
    UNION ALL SELECT 'n' || n_nationkey, 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 3 FROM customer
    UNION ALL SELECT 'o' || o_orderkey, 4 FROM orders UNION ALL SELECT 'root', 0)
  SELECT id, level::INTEGER AS level FROM h UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 5 END FROM supplier""")
def g16_level(spark, sf_dir):
    def edge(frame, a, ka, b, kb):
        return frame.select(F.concat(F.lit(a), F.col(ka)).alias("src"), F.concat(F.lit(b), F.col(kb)).alias("dst"))

    top = read(spark, sf_dir, "region").select(F.lit("root").alias("src"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("dst"))
    e = (
        top.unionByName(edge(read(spark, sf_dir, "nation"), "r", "n_regionkey", "n", "n_nationkey"))
        .unionByName(edge(read(spark, sf_dir, "customer"), "n", "c_nationkey", "c", "c_custkey"))
        .unionByName(edge(read(spark, sf_dir, "orders"), "c", "o_custkey", "o", "o_orderkey"))
    )
    far = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"))
    every = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).unionByName(far)
    customers = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    helping = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"))
    return g.levels(e, every, "root", customers, helping)


@query(f"""WITH RECURSIVE {REQ}, r AS (SELECT dst AS id, src AS dependent FROM req WHERE dst IN (3, 17, 60)
  UNION SELECT r.id, req.src FROM r JOIN req ON req.dst = r.dependent) SELECT id, dependent FROM r""")
def g17_dependents(spark, sf_dir):
    return g.dependents(requires(spark, sf_dir), spark.createDataFrame([(3,), (17,), (60,)], "id long"))


@query("""WITH RECURSIVE a AS (SELECT n_nationkey AS alias, min(n_nationkey) FILTER (WHERE TRUE) AS x FROM nation GROUP BY 1),
  nxt AS (SELECT n_nationkey AS alias, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS target FROM nation),
  r AS (SELECT alias, target FROM nxt WHERE target IS NOT NULL UNION SELECT r.alias, n.target FROM r JOIN nxt n ON n.alias = r.target WHERE n.target IS NOT NULL)
  SELECT alias, max(target) AS target FROM r GROUP BY alias""")
def g1_alias_resolve(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("alias"), F.lead("n_nationkey").over(w).alias("target"))
    return g.resolve_aliases(nation.where("target is not null"))


@query(f"""WITH {REQ}, m AS (SELECT p_partkey::BIGINT AS alias, (p_partkey - 1)::BIGINT AS target FROM part WHERE p_partkey % 10 = 1)
  SELECT DISTINCT s AS src, d AS dst, 'requires' AS rel FROM (SELECT coalesce(a.target, src) AS s, coalesce(b.target, dst) AS d
    FROM req LEFT JOIN m a ON a.alias = src LEFT JOIN m b ON b.alias = dst) WHERE s <> d""")
def g11_merge_node(spark, sf_dir):
    e = requires(spark, sf_dir).withColumn("rel", F.lit("requires"))
    merges = read(spark, sf_dir, "part").where("p_partkey % 10 = 1").select(F.col("p_partkey").cast("long").alias("alias"), (F.col("p_partkey") - 1).cast("long").alias("target"))
    return g.merge_nodes(e, merges)


@query(f"""WITH RECURSIVE {REQ}, back AS (SELECT 1::BIGINT AS src, max(p_partkey)::BIGINT AS dst FROM part),
  r AS (SELECT src, dst FROM req WHERE src = (SELECT dst FROM back) UNION SELECT r.src, req.dst FROM r JOIN req ON r.dst = req.src)
  SELECT src, dst, 'requires' AS rel, FALSE AS demoted FROM req
  UNION ALL SELECT src, dst, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.dst = back.src) THEN 'related_to' ELSE 'requires' END,
    EXISTS (SELECT 1 FROM r WHERE r.dst = back.src) FROM back""")
def g2_demotions(spark, sf_dir):
    e = requires(spark, sf_dir).withColumn("ord", F.col("src") * 1_000_000 + F.col("dst"))
    back = _last(spark, sf_dir).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(2**60).alias("ord"))
    # Every fiftieth source under a former name: it is resolved before anything else.
    named = e.withColumn("src", F.when(F.col("src") % 50 == 0, -F.col("src")).otherwise(F.col("src")))
    aliases = e.where("src % 50 = 0").select((-F.col("src")).alias("alias"), F.col("src").alias("target")).distinct()
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return g.add_edges(named.unionByName(back), ids, aliases).select("src", "dst", "rel", "demoted")


@query("""WITH x AS (SELECT o_custkey % 7 AS cluster, o_orderkey AS ord, o_orderkey % 200 AS src, o_custkey % 200 AS dst FROM orders),
  p AS (SELECT cluster, ord, CASE WHEN src BETWEEN 190 AND 194 THEN src - 190 ELSE src END AS src, CASE WHEN dst BETWEEN 190 AND 194 THEN dst - 190 ELSE dst END AS dst FROM x),
  n AS (SELECT i AS id, CASE WHEN i % 20 = 0 THEN 'algorithm' ELSE 'concept' END AS type, CASE WHEN i % 10 = 3 THEN 'assumed' ELSE 'statement' END AS tier
        FROM (SELECT unnest(range(0, 190)) AS i)),
  q AS (SELECT p.*, CASE WHEN s.id IS NULL THEN 'unknown source id' WHEN d.id IS NULL THEN 'unknown target id' WHEN src = dst THEN 'self-edge'
          WHEN s.tier = 'assumed' THEN 'edge out of a floor node' WHEN s.type = 'algorithm' THEN 'edge out of a seed algorithm'
          WHEN src % 9 = 4 AND dst % 2 = 0 THEN 'dropped by amendment' WHEN src < dst THEN 'dropped by amendment' END AS early
        FROM p LEFT JOIN n s ON s.id = src LEFT JOIN n d ON d.id = dst),
  f AS (SELECT src, dst, min({'c': cluster, 'o': ord}) AS first FROM q WHERE early IS NULL GROUP BY src, dst),
  g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY first) AS place FROM f),
  v AS (SELECT q.cluster, q.ord, q.src, q.dst, coalesce(early, CASE WHEN place > 5 THEN 'over branching cap of 5' WHEN first <> {'c': cluster, 'o': ord} THEN 'duplicate' END) AS reason FROM q LEFT JOIN g ON g.src = q.src AND g.dst = q.dst AND early IS NULL)
  SELECT cluster, ord, src, dst, CASE WHEN reason IS NULL THEN CASE WHEN src = 189 THEN 'demoted' ELSE 'accepted' END ELSE 'rejected' END AS status, reason FROM v""")
def g14_merge_reasons(spark, sf_dir):
    p = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("cluster"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 200).alias("src"), (F.col("o_custkey") % 200).alias("dst"))
    i = F.col("id")
    n = spark.range(190).select("id", F.when(i % 20 == 0, "algorithm").otherwise("concept").alias("type"), F.when(i % 10 == 3, "assumed").otherwise("statement").alias("tier"))
    aliases = spark.range(190, 195).select(i.alias("alias"), (i - 190).alias("target"))
    kind = dict(p.dtypes)["src"]
    aliases = aliases.select(*(F.col(c).cast(kind).alias(c) for c in aliases.columns))
    ends = [F.when(F.col(c).between(190, 194), F.col(c) - 190).otherwise(F.col(c)).alias(c) for c in ("src", "dst")]
    # Edges to larger ids count as dropped, so proposals alone make no cycle; the graph there is already
    # has an edge from every node to 189, so all that leaves 189 closes one.
    dropped = p.select(*ends).where("(src % 9 = 4 and dst % 2 = 0) or src < dst")
    there = spark.range(189).select(i.cast(kind).alias("src"), F.lit(189).cast(kind).alias("dst"))
    return g.merge_proposals(p, n, dropped, there, aliases=aliases)


@query(f"""WITH RECURSIVE {REQ}, {NODES}, r AS (SELECT src, dst FROM req WHERE src IN (SELECT id FROM nodes WHERE type = 'algorithm')
  UNION SELECT r.src, req.dst FROM r JOIN req ON r.dst = req.src)
  SELECT n.id, count(DISTINCT r.src) AS n FROM nodes n LEFT JOIN r ON r.dst = n.id GROUP BY n.id""")
def a3_reuse_counts(spark, sf_dir):
    return g.reuse_counts(requires(spark, sf_dir), nodes(spark, sf_dir))


@query(f"WITH {REQ} SELECT dst AS id, count(*) AS weight FROM req GROUP BY dst")
def a4_in_degree(spark, sf_dir):
    return g.in_degree(requires(spark, sf_dir))


@query(f"""WITH {REQ}, {NODES}, d AS (SELECT src, dst FROM req WHERE src % 5 = 0 AND dst % 3 = 0),
  k AS (SELECT src, dst FROM req WHERE (src, dst) NOT IN (SELECT (src, dst) FROM d)),
  t AS (SELECT src, dst AS old_dst, dst + 1 AS dst FROM k WHERE src % 7 = 3 AND dst + 1 < src),
  a AS (SELECT src, dst FROM k WHERE (src, dst) NOT IN (SELECT (src, old_dst) FROM t) UNION SELECT src, dst FROM t)
  SELECT DISTINCT src, dst, 'requires' AS rel FROM a""")
def g13_amendments(spark, sf_dir):
    e = requires(spark, sf_dir).withColumn("rel", F.lit("requires"))
    drop = e.where("src % 5 = 0 and dst % 3 = 0")
    kept = e.where("not (src % 5 = 0 and dst % 3 = 0)")
    retarget = kept.where("src % 7 = 3 and dst + 1 < src").select("src", F.col("dst").alias("old_dst"), (F.col("dst") + 1).alias("dst"))
    return g.amend(nodes(spark, sf_dir), e, drop=drop, retarget=retarget)[1]


@query(f"""WITH RECURSIVE {REQ}, k AS (SELECT p_partkey::BIGINT AS id FROM part WHERE p_size > 45), r AS (SELECT id FROM k UNION SELECT req.dst FROM r JOIN req ON req.src = r.id) SELECT id FROM r""")
def j34_build_scope(spark, sf_dir):
    from ..operators.architecture import build_scope

    return build_scope(read(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").cast("long").alias("id")), requires(spark, sf_dir))


@query("""WITH c AS (SELECT 's' || n_regionkey AS subsystem, n_name AS component, ['a' || (n_nationkey % 3), 'a' || (n_nationkey % 4)] AS algs FROM nation),
  x AS (SELECT DISTINCT subsystem, component, lower(replace(component, ' ', '_')) AS slug, unnest(algs) AS a FROM c)
  SELECT DISTINCT 'robot' AS src, 'robot__' || subsystem AS dst, 'contains' AS rel FROM c UNION ALL SELECT DISTINCT 'robot__' || subsystem, 'robot__' || slug, 'contains' FROM x UNION ALL SELECT DISTINCT 'robot__' || slug, a, 'uses' FROM x""")
def g18_attach(spark, sf_dir):
    from ..operators.architecture import attach

    k = F.col("n_nationkey")
    algorithms = F.array(F.concat(F.lit("a"), k % 3), F.concat(F.lit("a"), k % 4))
    proposal = read(spark, sf_dir, "nation").select(F.col("n_name").alias("component"), F.concat(F.lit("s"), F.col("n_regionkey")).alias("subsystem"), algorithms.alias("algorithms"))
    known = spark.range(4).select(F.concat(F.lit("a"), "id").alias("id"), F.lit("algorithm").alias("type"))
    return attach(proposal, known, "robot")[1]


@query(f"""WITH RECURSIVE {REQ}, {NODES}, t AS (SELECT id FROM nodes WHERE type = 'algorithm'), r AS (SELECT t.id AS target, req.dst AS id FROM t JOIN req ON req.src = t.id UNION SELECT r.target, req.dst FROM r JOIN req ON req.src = r.id),
  own AS (SELECT target, id FROM r WHERE id NOT IN (1, 2)), size AS (SELECT t.id AS target, count(own.id) AS n FROM t LEFT JOIN own ON own.target = t.id GROUP BY t.id),
  every AS (SELECT target, id FROM own WHERE target IN (SELECT target FROM size WHERE n >= 8) UNION ALL SELECT target, nodes.id FROM size JOIN nodes ON n < 8 AND nodes.type IN ('concept', 'technique') AND nodes.id <> target)
  SELECT target, (row_number() OVER (PARTITION BY target ORDER BY id))::INTEGER AS place, id FROM every QUALIFY place <= 60""")
def w11_vocabulary(spark, sf_dir):
    from ..operators.generation import candidate_vocabulary

    n = nodes(spark, sf_dir)
    return candidate_vocabulary(requires(spark, sf_dir), n, n.where("type = 'algorithm'"), ("1", "2"))
