"""Guard queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources.tables import read
from .bindings import REQ, requires
from .registry import query


@query("""WITH c AS (SELECT doc_id AS id, 's' || (doc_id % 7) AS cite FROM documents UNION SELECT doc_id, 's' || (n_chars % 9) FROM documents),
  s AS (SELECT doc_id AS id, 's' || (doc_id % 7) AS source FROM labels) SELECT c.id, c.cite FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = c.id AND s.source = c.cite)""")
def j10_ungrounded(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    c = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("doc_id") % 7).alias("cite")).unionByName(d.select(F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("n_chars") % 9).alias("cite")))
    s = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("doc_id") % 7).alias("source"))
    return q.ungrounded(c, s)


@query(f"""WITH RECURSIVE {REQ}, i AS (SELECT DISTINCT p_partkey::BIGINT AS id, (p_size * 3)::BIGINT AS item FROM part),
  r AS (SELECT src, dst FROM req UNION SELECT r.src, req.dst FROM r JOIN req ON req.src = r.dst)
  SELECT id, item FROM i WHERE id <> item AND item % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = i.id AND r.dst = i.item)""")
def j11_holes(spark, sf_dir):
    i = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), (F.col("p_size") * 3).cast("long").alias("item"))
    known = spark.range(0, 1000, 10).select("id")
    return q.holes(i, requires(spark, sf_dir), known)


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['f' || (o_custkey % 50), 'f' || (o_orderkey % 60)] END AS evidence FROM orders),
  f AS (SELECT 'f' || i AS path FROM (SELECT unnest(range(0, 48)) AS i))
  SELECT id, array_to_string(list_sort(list_distinct(list_filter(evidence, lambda e: NOT e IN (SELECT path FROM f)))), ',') AS missing FROM c WHERE FALSE
  UNION ALL SELECT id, array_to_string(list_sort(list(DISTINCT e)), ',') FROM (SELECT id, unnest(evidence) AS e FROM c) WHERE e NOT IN (SELECT path FROM f) GROUP BY id
  UNION ALL SELECT id, '' FROM c WHERE len(evidence) = 0""".replace("""SELECT id, array_to_string(list_sort(list_distinct(list_filter(evidence, lambda e: NOT e IN (SELECT path FROM f)))), ',') AS missing FROM c WHERE FALSE
  UNION ALL SELECT id, array_to_string(list_sort(list(DISTINCT e)), ',') FROM""", "SELECT id, array_to_string(list_sort(list(DISTINCT e)), ',') AS missing FROM"))
def j12_unsupported(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    paths = F.array(F.concat(F.lit("f"), F.col("o_custkey") % 50), F.concat(F.lit("f"), F.col("o_orderkey") % 60))
    c = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).otherwise(paths).alias("evidence"))
    return q.unsupported(c, spark.range(48).select(F.concat(F.lit("f"), "id").alias("path")))


@query("""WITH n AS (SELECT DISTINCT o_custkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'symbol' ELSE 'parameter' END AS kind, 'v' || (o_orderkey % 6) AS value FROM orders),
  a AS (SELECT c_custkey AS id, 'symbol' AS kind, unnest(['v' || (c_custkey % 6), 'v2']) AS value FROM customer UNION SELECT c_custkey, 'parameter', 'v' || (c_custkey % 3) FROM customer)
  SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = n.id AND a.kind = n.kind AND a.value = n.value)""")
def j13_invented(spark, sf_dir):
    n = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "symbol").otherwise("parameter").alias("kind"), F.concat(F.lit("v"), F.col("o_orderkey") % 6).alias("value"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    allowed = c.select("id", F.lit("symbol").alias("kind"), F.concat(F.lit("v"), F.col("id") % 6, F.lit(", v2")).alias("value")).unionByName(c.select("id", F.lit("parameter").alias("kind"), F.concat(F.lit("v"), F.col("id") % 3).alias("value")))
    return q.invented(n, allowed)


_SHAPE = r"\b[a-z][a-z0-9]*(?:[_/][a-z0-9]+)+(?:\.[a-z0-9]+)*\b"


@query(f"""WITH k AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text || ' by nav_' || (doc_id % 40) || ' in config/part' || (n_chars % 90) || '.launch.py, as Map_' || doc_id, '{_SHAPE}')) AS token FROM documents),
  n AS (SELECT 'nav_' || (item_id % 25) AS name FROM benchmark UNION SELECT 'config/part' || (item_id % 80) || '.launch.py' FROM benchmark) SELECT id, token FROM k WHERE token NOT IN (SELECT name FROM n)""")
def j14_invented_tokens(spark, sf_dir):
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    said = F.concat("text", F.lit(" by nav_"), F.col("doc_id") % 40, F.lit(" in config/part"), F.col("n_chars") % 90, F.lit(".launch.py, as Map_"), F.col("doc_id"))
    names = b.select(F.concat(F.lit("nav_"), F.col("item_id") % 25).alias("name")).unionByName(b.select(F.concat(F.lit("config/part"), F.col("item_id") % 80, F.lit(".launch.py")).alias("name")))
    return q.invented_tokens(d.select(F.col("doc_id").alias("id"), said.alias("text")), names)


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def j15_diff(spark, sf_dir):
    from ..operators.relate import both_side_misses

    a = read(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"))
    return both_side_misses(a, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


def _sheets(spark, sf_dir):
    i = F.col("p_partkey")
    step = F.struct(F.lit(1).alias("n"), F.array((i % 7).cast("long"), F.lit(10**9).cast("long")).alias("invokes"), F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), i % 3))).alias("cites"))
    steps = F.when(i % 2 == 0, F.array(step)).otherwise(F.array().cast("array<struct<n:int,invokes:array<bigint>,cites:array<string>>>"))
    return read(spark, sf_dir, "part").select(
        i.cast("long").alias("id"),
        F.when(i % 2 == 0, "derivation").otherwise("definition").alias("kind"),
        F.when(i % 4 == 0, "definition").otherwise("derivation").alias("expected"),
        (i % 13 != 0).alias("grounded"),
        F.when(i % 3 == 0, "").otherwise("it is").alias("statement"),
        (i % 6).alias("n_symbols"),
        (i % 5).alias("n_properties"),
        steps.alias("steps"),
        F.array(F.concat(F.lit("s"), i % 4)).alias("property_cites"),
    )


@query(f"""WITH RECURSIVE {REQ}, s AS (SELECT p_partkey::BIGINT AS id, p_partkey AS i, p_partkey % 2 = 0 AS der FROM part),
  src AS (SELECT id, 's' || (i % 3) AS source FROM s UNION ALL SELECT id, 's3' FROM s WHERE i % 3 = 1),
  c AS (SELECT id, 's' || (i % 3) AS cite FROM s WHERE der AND i % 5 <> 0 UNION SELECT id, 's' || (i % 4) FROM s),
  bad AS (SELECT id, array_to_string(list_sort(list(cite)), ',') AS u FROM c WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.id = c.id AND src.source = c.cite) GROUP BY id),
  r AS (SELECT src, dst FROM req UNION SELECT r.src, req.dst FROM r JOIN req ON req.src = r.dst),
  h AS (SELECT id, (i % 7)::VARCHAR AS hole FROM s WHERE der AND id <> i % 7 AND i % 7 <> 3 AND NOT EXISTS (SELECT 1 FROM r WHERE r.src = s.id AND r.dst = s.i % 7)),
  x AS (SELECT s.*, coalesce(bad.u, '') AS ungrounded, CASE WHEN der AND i % 5 = 0 THEN '1' ELSE '' END AS uncited, CASE WHEN der THEN '1000000000' ELSE '' END AS unknown, coalesce(h.hole, '') AS holes,
    array_to_string(list_filter([CASE WHEN NOT der AND i % 3 = 0 THEN 'no statement' END, CASE WHEN NOT der AND i % 5 = 0 THEN 'no properties' END, CASE WHEN i % 6 = 0 THEN 'no symbols' END,
      CASE WHEN der AND i % 4 = 0 THEN 'unexpected kind' END], lambda z: z IS NOT NULL), '; ') AS shape, CASE WHEN NOT der THEN 'no source derives it' ELSE '' END AS notes
    FROM s LEFT JOIN bad USING (id) LEFT JOIN h USING (id))
  SELECT id, ungrounded, uncited, unknown, holes, shape, notes, FALSE AS vacuous, ungrounded = '' AND uncited = '' AND shape = '' AND i % 13 <> 0 AS ok FROM x""")
def d1_check(spark, sf_dir):
    s = _sheets(spark, sf_dir)
    src = s.select("id", F.concat(F.lit("s"), F.col("id") % 3).alias("source")).unionByName(s.where("id % 3 = 1").select("id", F.lit("s3").alias("source")))
    ids = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return q.check_sheets(s, src, requires(spark, sf_dir), spark.createDataFrame([(3,)], "id long"), ids)


@query("""SELECT doc_id AS id, (quality % 2) IS DISTINCT FROM toxic AS changed, (quality = 1) IS DISTINCT FROM (toxic = 0) AS flipped, NOT coalesce(toxic = 0, FALSE) AS failing FROM labels""")
def d5_recheck_diff(spark, sf_dir):
    lab = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    before = lab.select("id", (F.col("quality") % 2).alias("v"), (F.col("quality") == 1).alias("ok"))
    return q.recheck(before, lab.select("id", F.col("toxic").alias("v"), (F.col("toxic") == 0).alias("ok")), ["v"])
