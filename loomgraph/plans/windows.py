"""Aggregation and window queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fixed import CONTENT_STOPWORDS, DEFINES, MOVES
from ..operators import quality as q
from ..operators import windows as w
from ..sources.tables import read
from .bindings import REQ, nodes, requires
from .registry import query
from .relate import lines_of


@query("SELECT l_partkey AS item, count(DISTINCT o_custkey) AS seeds FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey")
def a2_reuse(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("seed"))
    return w.reuse(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")).join(o, "l_orderkey"))


_SEEDS = """items AS (SELECT o_custkey AS pos, l_partkey AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  f AS (SELECT item, min(pos) AS pos FROM items GROUP BY item), c AS (SELECT pos, count(*) AS added FROM f GROUP BY pos),
  p AS (SELECT p.pos, coalesce(added, 0) AS added FROM (SELECT DISTINCT pos FROM items) p LEFT JOIN c USING (pos)),
  s AS (SELECT pos, (sum(added) OVER (ORDER BY pos))::BIGINT AS canon_size, added FROM p)"""


def _curve(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("pos"))
    return w.saturation(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")).join(o, "l_orderkey"))


@query(f"WITH {_SEEDS} SELECT pos, canon_size, added, CASE WHEN canon_size = added THEN 100.0 ELSE 100.0::DOUBLE * added / (canon_size - added) END::DOUBLE AS added_pct FROM s")
def a5_saturation(spark, sf_dir):
    return _curve(spark, sf_dir)


@query("""WITH i AS (SELECT DISTINCT o_orderpriority AS seed, l_partkey AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  o AS (SELECT trial, seed, row_number() OVER (PARTITION BY trial ORDER BY md5('7:' || trial || ':' || seed), seed) AS k FROM (SELECT DISTINCT seed FROM i), (SELECT unnest(range(500)) AS trial)),
  f AS (SELECT trial, item, min(k) AS k FROM o JOIN i USING (seed) GROUP BY trial, item), c AS (SELECT trial, k, count(*) AS added FROM f GROUP BY trial, k),
  s AS (SELECT o.trial, o.k, sum(coalesce(added, 0)) OVER (PARTITION BY o.trial ORDER BY o.k) AS size FROM o LEFT JOIN c ON c.trial = o.trial AND c.k = o.k)
  SELECT k::INTEGER AS k, round(avg(size), 6) AS mean_size FROM s GROUP BY k""")
def a6_mean_curve(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("seed"))
    curve = w.mean_curve(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")).join(o, "l_orderkey"))
    return curve.select("k", F.round("mean_size", 6).alias("mean_size"))


@query(f"WITH {_SEEDS} SELECT pos, canon_size, lag(canon_size) OVER (ORDER BY pos) AS before, CASE WHEN canon_size = added THEN 100.0 ELSE 100.0::DOUBLE * added / (canon_size - added) END < 5 AS flat FROM s")
def a13_growth(spark, sf_dir):
    return w.growth(_curve(spark, sf_dir))


@query("SELECT lang, quality::INTEGER AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (quality))")
def a7_state_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return w.state_rollup(d, "lang", "quality").select("lang", "quality", "n")


@query("""SELECT name, n, array_to_string(us, ',') AS users FROM (SELECT substr(text, 1, 40) AS name, count(DISTINCT doc_id) AS n, list_sort(list(DISTINCT doc_id::VARCHAR)) AS us FROM documents GROUP BY 1) WHERE n > 1""")
def a8_corroborated(spark, sf_dir):
    return w.corroborated(read(spark, sf_dir, "documents").select(F.substring("text", 1, 40).alias("name"), F.col("doc_id").cast("string").alias("user")))


@query("""WITH s AS (SELECT doc_id % 100 AS id, doc_id AS ord, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'derived' END AS kind, doc_id % 11 = 0 AS error FROM documents),
  g AS (SELECT id, bool_or(error) AS error, min(ord) FILTER (WHERE n_chars >= CASE WHEN kind = 'derived' THEN 350 ELSE 1200 END) AS best FROM s GROUP BY id)
  SELECT i AS id, CASE WHEN i % 25 = 7 THEN 'known_absent' WHEN best IS NOT NULL THEN 'grounded' WHEN error THEN 'error' ELSE 'ungrounded' END AS state, best::VARCHAR AS best
  FROM (SELECT unnest(range(0, 100)) AS i) LEFT JOIN g ON g.id = i""")
def a9_grounding(spark, sf_dir):
    i = F.col("doc_id")
    s = read(spark, sf_dir, "documents").select((i % 100).alias("id"), i.cast("string").alias("source"), i.alias("ord"), "n_chars", F.when(i % 3 == 0, "derived").alias("kind"), (i % 11 == 0).alias("error"))
    n = spark.range(100)
    aliases = n.select("id", F.when(F.col("id") % 25 == 7, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("titles")).where("id % 2 = 1 or id % 25 = 7")
    return w.grounding_states(n, s, aliases)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 5")
def w1_branching_cap(spark, sf_dir):
    return w.capped(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("""WITH p AS (SELECT doc_id AS doc, i - 1 AS pos, regexp_replace(arr[i], '^\\s+|\\s+$', '', 'g') AS passage FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents), LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i)),
  c AS (SELECT *, (length(lower(passage)) - length(replace(lower(passage), 'tion', ''))) // 4 AS a, (length(lower(passage)) - length(replace(lower(passage), 'the ', ''))) // 4 AS b, (length(lower(passage)) - length(replace(lower(passage), 'que', ''))) // 3 AS d FROM p WHERE length(passage) >= 80),
  s AS (SELECT doc, pos, passage, (a > 0)::INTEGER + (b > 0)::INTEGER + (d > 0)::INTEGER AS hits, a + b + d AS occurrences FROM c)
  SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY hits DESC, occurrences DESC, pos))::INTEGER AS place, pos::INTEGER AS pos, hits, occurrences::INTEGER AS occurrences, passage FROM s WHERE hits >= 1
  QUALIFY place <= 4""")
def w2_passages(spark, sf_dir):
    return w.passages(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), ["tion", "the ", "que"])


_HEADED = "CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || ' == Derivation of it ==' || chr(10) || 'x = y' ELSE text END"


@query(f"""WITH t AS (SELECT doc_id AS doc, {_HEADED} AS text FROM documents), d AS (SELECT doc, text, CASE WHEN length(text) <= 2000 THEN string_split(text, chr(10)) ELSE list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '\\S')) END AS ps FROM t),
  x AS (SELECT doc, length(text) <= 2000 AS whole, len(ps) AS n, i, length(ps[i]) AS len,
          CASE WHEN contains(lower(ps[i]), 'proof') THEN 3 ELSE 0 END + CASE WHEN contains(lower(ps[i]), 'ing') THEN 3 ELSE 0 END + length(ps[i]) - length(replace(ps[i], '=', '')) + CASE WHEN regexp_matches(ps[i], '(?i)^\\s*=+\\s*(proof|derivation|deriving)') THEN 400 ELSE 0 END AS score,
          greatest(2000 - length(ps[1]) - CASE WHEN len(ps) > 1 THEN 1 + length(ps[2]) ELSE 0 END, 1000) AS room
        FROM d, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)),
  c AS (SELECT *, sum(len + 1) OVER (PARTITION BY doc ORDER BY i) AS cost, sum(score) OVER (PARTITION BY doc ORDER BY i) AS gain FROM x),
  p AS (SELECT a.doc, a.i AS first, max(b.i) AS last FROM c a JOIN c b ON a.doc = b.doc AND b.i >= a.i AND b.cost - (a.cost - a.len - 1) - 1 <= a.room WHERE NOT a.whole GROUP BY 1, 2),
  v AS (SELECT p.doc, p.first, p.last, b.gain - a.gain + a.score AS score FROM p JOIN c a ON a.doc = p.doc AND a.i = p.first JOIN c b ON b.doc = p.doc AND b.i = p.last),
  k AS (SELECT doc, first, last, score FROM v QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, first) = 1)
  SELECT d.doc, coalesce(k.first, 1)::INTEGER AS first, CASE WHEN length(d.text) <= 2000 THEN len(d.ps) ELSE coalesce(k.last, 1) END::INTEGER AS last,
    coalesce(k.score, CASE WHEN length(d.text) <= 2000 THEN (SELECT sum(score) FROM x WHERE x.doc = d.doc) ELSE 0 END)::BIGINT AS score, coalesce(k.first, 1) > 3 AS headed FROM d LEFT JOIN k ON k.doc = d.doc""")
def w3_best_window(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n == Derivation of it ==\nx = y"))).otherwise(F.col("text"))
    return w.best_window(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text")), ("proof", "ing"), 2000)


@query("SELECT conv_id, turn, length(text) AS n FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 900")
def w4_budget_take(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return w.budget_take(c, "conv_id", "turn", F.col("n"), 900)


_HEADS = "h AS (SELECT l_orderkey AS doc, l_partkey * 10 + l_linenumber AS pos, 1 + (l_quantity::BIGINT % 3) AS level FROM lineitem)"


@query(f"WITH {_HEADS}, u AS (SELECT DISTINCT * FROM h) SELECT doc, pos, level, (SELECT min(b.pos) FROM u b WHERE b.doc = a.doc AND b.pos > a.pos AND b.level <= a.level) AS stop FROM u a")
def w5_sections(spark, sf_dir):
    h = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), (1 + F.col("l_quantity").cast("long") % 3).alias("level")).distinct()
    return w.extents(h)


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS scope FROM events")
def w6_carry_forward(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return w.carry_forward(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "scope").select("event_id", "scope")


#: A document with brackets, keys and comments planted, by document and line.
_PLANTED = """pl AS (SELECT doc_id AS doc, i AS ln, CASE WHEN (doc_id + i) % 11 = 3 THEN 'node_' || (i % 7) || ':' WHEN (doc_id + i) % 7 = 1 THEN 'gain' || i || ': [1.0, ' || substr(l, 1, 20)
    WHEN (doc_id + i) % 7 = 2 THEN '  - [' || substr(l, 1, 5) WHEN (doc_id + i) % 7 = 4 THEN '  ' || substr(l, 1, 9) || '] # ' || l WHEN (doc_id + i) % 7 = 5 THEN '  rate_' || i || ' : ' || l ELSE l END AS text
  FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


@query(rf"""WITH RECURSIVE {_PLANTED}, c AS (SELECT doc, ln, rtrim(split_part(text, '#', 1), {_BLANKS}) AS x FROM pl),
  k AS (SELECT doc, ln, x, ltrim(x, {_BLANKS}) AS bare, row_number() OVER (PARTITION BY doc ORDER BY ln) AS n, regexp_extract(x, '^([A-Za-z_/*"''][^:\s]*)\s*:$', 1) AS key,
    regexp_extract(x, '^\s*([A-Za-z_][\w/]*)\s*:\s*(\S.*)$', 1) AS name, regexp_extract(x, '^\s*([A-Za-z_][\w/]*)\s*:\s*(\S.*)$', 2) AS value,
    length(x) - length(replace(x, '[', '')) - length(x) + length(replace(x, ']', '')) AS step FROM c WHERE trim(x, {_BLANKS}) <> ''),
  st AS (SELECT doc, 0::BIGINT AS n, '' AS scope, 0::BIGINT AS depth, NULL::BIGINT AS spot, '' AS name, '' AS part FROM (SELECT DISTINCT doc FROM k)
    UNION ALL SELECT k.doc, k.n, CASE WHEN st.depth <= 0 AND key <> '' THEN key ELSE scope END,
      CASE WHEN st.depth > 0 THEN greatest(st.depth + step, 0) WHEN key = '' AND k.name <> '' AND value NOT IN ('|', '>') THEN greatest(step, 0) ELSE 0 END,
      CASE WHEN st.depth > 0 THEN spot WHEN key = '' AND k.name <> '' AND value NOT IN ('|', '>') THEN k.ln END,
      CASE WHEN st.depth > 0 THEN st.name ELSE k.name END, CASE WHEN st.depth > 0 THEN bare ELSE value END
    FROM st JOIN k ON k.doc = st.doc AND k.n = st.n + 1)
  SELECT doc, spot::INTEGER AS ln, any_value(scope) AS scope, any_value(name) AS name, string_agg(part, ' ' ORDER BY n) AS value FROM st WHERE spot IS NOT NULL GROUP BY doc, spot""")
def w6_folded_values(spark, sf_dir):
    text, i = F.col("text"), F.col("doc") + F.col("ln")
    planted = (
        F.when(i % 11 == 3, F.concat(F.lit("node_"), F.col("ln") % 7, F.lit(":")))
        .when(i % 7 == 1, F.concat(F.lit("gain"), "ln", F.lit(": [1.0, "), F.substring(text, 1, 20)))
        .when(i % 7 == 2, F.concat(F.lit("  - ["), F.substring(text, 1, 5)))
        .when(i % 7 == 4, F.concat(F.lit("  "), F.substring(text, 1, 9), F.lit("] # "), text))
        .when(i % 7 == 5, F.concat(F.lit("  rate_"), "ln", F.lit(" : "), text))
        .otherwise(text)
    )
    return w.folded_values(lines_of(spark, sf_dir).withColumn("text", planted))


STOP = "[" + ", ".join(f"'{w}'" for w in sorted(CONTENT_STOPWORDS)) + "]"
_TOK = f"""st AS (SELECT unnest({STOP}) AS w),
  tok AS (SELECT DISTINCT conv_id AS doc, turn AS item, unnest(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]{{2,}})', 1)) AS token FROM conversations),
  ok AS (SELECT * FROM tok WHERE token NOT IN (SELECT w FROM st)),
  un AS (SELECT doc, item, token FROM ok QUALIFY count(*) OVER (PARTITION BY doc, token) = 1),
  g AS (SELECT doc, item, count(*) AS n, array_to_string(list_sort(list(token)), ' ') AS tokens FROM un GROUP BY doc, item)"""


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("item"), "text")


@query(f"WITH {_TOK} SELECT * FROM g")
def w7_unique_tokens(spark, sf_dir):
    return w.unique_tokens(_turns(spark, sf_dir))


@query(f"WITH {_TOK} SELECT doc, item, n, (row_number() OVER (PARTITION BY doc ORDER BY n DESC, item DESC))::INTEGER AS place FROM g WHERE n >= 2")
def w9_rank_masks(spark, sf_dir):
    return w.rank_masks(w.unique_tokens(_turns(spark, sf_dir)))


@query("""WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events)
  SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY rn, first, event_id))::INTEGER AS place FROM r QUALIFY place <= 6""")
def w8_round_robin(spark, sf_dir):
    return w.round_robin(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id")


@query("""WITH s AS (SELECT conv_id AS doc, turn::INTEGER AS n, text || CASE WHEN turn % 3 = 2 THEN ' see Step ' || (turn - 1) || ' and step0, misstep 1' ELSE '' END AS text FROM conversations),
  m AS (SELECT DISTINCT doc, n AS leak, unnest(regexp_extract_all(text, '(?i)\\bstep\\s*([0-9]+)\\b', 1))::INTEGER AS n FROM s)
  SELECT s.doc, s.n, m.leak FROM s JOIN m ON s.doc = m.doc AND s.n = m.n WHERE leak > s.n""")
def w10_forward_leaks(spark, sf_dir):
    extra = F.when(F.col("turn") % 3 == 2, F.concat(F.lit(" see Step "), (F.col("turn") - 1).cast("string"), F.lit(" and step0, misstep 1"))).otherwise("")
    return w.forward_leaks(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("n"), F.concat("text", extra).alias("text")))


@query(f"""WITH {REQ} SELECT dst AS id, src AS consumer, (row_number() OVER (PARTITION BY dst ORDER BY CASE WHEN p_size > 40 THEN 0 ELSE 1 END, src))::INTEGER AS place FROM req JOIN part ON p_partkey = src QUALIFY place <= 6""")
def w12_consumers(spark, sf_dir):
    return w.consumers(requires(spark, sf_dir), nodes(spark, sf_dir))


@query("""SELECT l_suppkey AS doc, l_partkey AS k, (row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey * 10 + l_linenumber), l_partkey))::INTEGER AS place FROM (SELECT l_suppkey, l_partkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS l_orderkey, 0 AS l_linenumber FROM lineitem) GROUP BY l_suppkey, l_partkey""")
def w15_distinct_in_order(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("k"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("ord"))
    return w.distinct_in_order(li, ["doc"], "k", "ord")


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: 'v'), ',') <> '' AND len(embedding) - 1 >= 8 AS is_matrix FROM embeddings")
def p3_is_matrix(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", t.is_matrix(F.array_join(F.transform("embedding", lambda x: F.lit("v")), ",")).alias("is_matrix"))


@query("SELECT vec_id, 8 AS side, round(list_sum(list_transform(range(8), lambda i: embedding[(i * 9 + 1)::BIGINT]::DOUBLE)), 6) AS trace, TRUE AS off_diagonal FROM embeddings")
def f11_matrix_diag(spark, sf_dir):
    m = t.matrix_view(F.col("embedding"))
    trace = F.aggregate(m["diagonal"], F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", m["side"].alias("side"), F.round(trace, 6).alias("trace"), m["off_diagonal"].alias("off_diagonal"))


@query("SELECT doc_id, n_chars >= CASE WHEN source = 'src3' THEN 350 ELSE 1200 END AS substantive FROM documents")
def p5_substantive(spark, sf_dir):
    kind = F.when(F.col("source") == "src3", "derived")
    return read(spark, sf_dir, "documents").select("doc_id", w.substantive(F.col("n_chars"), kind).alias("substantive"))


@query("SELECT doc_id, doc_id % 50 = 0 OR (length(t) < 6000 AND contains(lower(substr(t, 1, 400)), 'may refer to')) AS disambiguation FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'X may refer to ' ELSE '' END || text AS t FROM documents)")
def p6_disambiguation(spark, sf_dir):
    text = F.concat(F.when(F.col("doc_id") % 4 == 1, "X may refer to ").otherwise(""), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", w.disambiguation(text, F.col("doc_id") % 50 == 0).alias("disambiguation"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(text, '([.;])[ \\t-\\r]+', '\\1\x01', 'g'), '\x01'), lambda s: regexp_matches(s, 'tion')), '|') AS claims FROM conversations".replace("\\t-\\r", "\\t-\\r"))
def p13_claims(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(q.claims_of(F.col("text"), "tion"), "|").alias("claims"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'unreadable' WHEN quality IS NULL THEN 'predates kind branching' WHEN quality = 1 AND doc_id % 4 = 0 THEN 'definition with no properties'
    WHEN quality = 1 AND toxic = 1 THEN 'technique stated instead of performed' WHEN doc_id % 7 = 0 THEN 'every step invokes only floor-level trivia'
    WHEN quality = 0 AND doc_id % 5 > 0 AND doc_id % 3 = 0 THEN 'no substantive invocations, closure check was vacuous' END AS reason FROM documents LEFT JOIN labels USING (doc_id)""")
def p19_prune_reason(spark, sf_dir):
    i = F.col("doc_id")
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("quality") == 1, "definition").when(F.col("quality") == 0, "derivation")
    trivial = F.when(i % 3 == 0, F.array(F.lit("index_notation"))).otherwise(F.array(F.lit("index_notation"), F.lit("chain_rule")))
    steps = F.slice(F.array(*[F.struct(trivial.alias("invokes"))] * 4), 1, (i % 5).cast("int"))
    return d.select("doc_id", q.prune_reason(F.col("n_chars") == 0, kind, i % 4, F.col("toxic") == 1, i % 7 == 0, F.size(steps), q.useful_steps(steps)).alias("reason"))


@query("""SELECT conv_id, turn, substr(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g'), ' '), 1, 300) AS line FROM conversations""")
def f16_excerpt(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.one_line(F.col("text")).alias("line"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 >= 1 + o_orderkey % 3 AND o_custkey % 4 >= 1 + o_orderkey % 3 THEN 'demonstrated' ELSE 'read' END AS state FROM orders")
def f23_earned_state(spark, sf_dir):
    passed, presented, available = F.col("o_custkey") % 4, F.col("o_orderkey") % 4, 1 + F.col("o_orderkey") % 3
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.earned_state(passed, presented, available).alias("state"))


@query(f"""WITH s AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Derivation' WHEN 1 THEN 'Proof by it' ELSE 'Proof' END AS title, lower(text || CASE doc_id % 4 WHEN 0 THEN ' It is called a map. It is defined to be so.' WHEN 1 THEN ' substitute and expand' ELSE '' END) AS body FROM documents)
  SELECT id, title <> 'Proof by it' AND NOT (len(regexp_extract_all(body, '{DEFINES}')) >= 2 AND len(regexp_extract_all(body, '{DEFINES}')) > len(regexp_extract_all(body, '{MOVES}'))) AS derives FROM s""")
def f22_source_derives(spark, sf_dir):
    i = F.col("doc_id")
    title = F.when(i % 3 == 0, "Derivation").when(i % 3 == 1, "Proof by it").otherwise("Proof")
    extra = F.when(i % 4 == 0, " It is called a map. It is defined to be so.").when(i % 4 == 1, " substitute and expand").otherwise("")
    return q.source_derives(read(spark, sf_dir, "documents").select(i.alias("id"), title.alias("title"), F.concat("text", extra).alias("body")))


_KINDS = f"""{REQ}, pn AS (SELECT p_partkey::BIGINT AS id, p_size % 10 = 0 AS tech, p_size % 4 = 0 AS whole, p_partkey % 9 = 0 AS derives FROM part WHERE p_partkey % 12 <> 11),
  al AS (SELECT p_partkey::BIGINT AS id FROM part), k AS (SELECT al.id, pn.id IS NOT NULL AS node, coalesce(tech, FALSE) OR EXISTS (SELECT 1 FROM req JOIN pn q ON q.id = req.dst WHERE req.src = al.id AND q.tech) AS structural, al.id % 9 = 0 AS derives, whole
  FROM al LEFT JOIN pn ON pn.id = al.id)"""


def _canon(spark, sf_dir):
    """Parts but each twelfth as nodes, and the ids of all."""
    p, i = read(spark, sf_dir, "part"), F.col("p_partkey").cast("long").alias("id")
    tier = F.when(F.col("p_size") % 4 == 0, "derivation").otherwise("statement")
    n = p.where("p_partkey % 12 <> 11").select(i, F.when(F.col("p_size") % 10 == 0, "technique").otherwise("concept").alias("type"), tier.alias("tier"))
    return n, p.select(i)


@query(f"WITH {_KINDS} SELECT id, CASE WHEN NOT node OR structural OR derives THEN 'derivation' ELSE 'definition' END AS expected FROM k")
def f21_expected_kind(spark, sf_dir):
    n, every = _canon(spark, sf_dir)
    return q.expected_kind(n, requires(spark, sf_dir), every.select("id", (F.col("id") % 9 == 0).alias("derives")))


@query(f"WITH {_KINDS} SELECT id, node AND NOT structural AND NOT whole AS suffices FROM k")
def p12_statement_suffices(spark, sf_dir):
    n, every = _canon(spark, sf_dir)
    return q.statement_suffices(n, requires(spark, sf_dir), every)


@query(f"WITH {_KINDS} SELECT id, (NOT node OR structural) AND (id % 5 < 2 OR id % 3 > 0) AS needs FROM k")
def p12_needs_better_sources(spark, sf_dir):
    n, every = _canon(spark, sf_dir)
    records = every.select("id", F.when(F.col("id") % 5 < 2, "definition").otherwise("derivation").alias("kind"), F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False).alias("grounded"))
    return q.needs_better_sources(records, n, requires(spark, sf_dir))


@query("SELECT doc_id AS doc, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY doc_id")
def s9_line_counts(spark, sf_dir):
    return lines_of(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_TOK} SELECT doc, count(*) AS n FROM g WHERE n >= 2 GROUP BY doc")
def a10_available(spark, sf_dir):
    from ..operators.exercises import available

    return available(_turns(spark, sf_dir))


@query("""WITH m AS (SELECT p_brand AS brand, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY p_brand)
  SELECT brand, substr(a, 1, len(list_filter(range(1, length(a) + 1), lambda k: substr(a, 1, k::INTEGER) = substr(b, 1, k::INTEGER)))::INTEGER) AS prefix FROM m""")
def w13_common_prefix(spark, sf_dir):
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array(F.min("p_name"), F.max("p_name")).alias("names"))
    return p.select("brand", w.common_prefix(F.col("names")).alias("prefix"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 > 0 AND o_custkey % 4 = 0 AND o_custkey % 2 = 0 AS thin FROM orders")
def p14_thin(spark, sf_dir):
    def some(n):
        return F.slice(F.array(*map(F.lit, "abcd")), 1, n.cast("int"))

    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), q.thin(some(F.col("o_orderkey") % 3), some(F.col("o_custkey") % 4), some(F.col("o_custkey") % 2)).alias("thin"))
