"""State, exercise, export, web and streaming queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import exercises as x
from ..operators import graph as g
from ..operators import profile as p
from ..operators import reachability
from ..operators import windows as w
from ..sources import sinks, web
from ..sources.tables import read
from ..streaming import events as s
from ..streaming import readers
from .bindings import NODES, REQ, nodes, requires
from .registry import query
from .windows import STOP


def profile_events(frame, nodes_: int = 40):
    """events -> profile events: one node per (user, k modulo ``nodes_``)."""
    kind = F.col("event_type")
    action = F.when(kind == "error", "deny").when(kind == "click", "reopen").otherwise("mark")
    state = F.when(kind == "signup", "declared").when(kind == "view", "read").when(kind == "purchase", "demonstrated")
    node = (F.get_json_object("props", "$.k").cast("long") % nodes_).alias("node")
    return frame.select(F.col("user_id").alias("user"), node, F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), action.alias("action"), state.alias("state"))


_EVENTS = """ev AS (SELECT user_id AS "user", json_extract_string(props, '$.k')::BIGINT % 40 AS node, event_id AS ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tm,
    CASE event_type WHEN 'error' THEN 'deny' WHEN 'click' THEN 'reopen' ELSE 'mark' END AS action,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS s FROM events)"""


def _fold(events, suspects):
    return f"""WITH RECURSIVE {REQ}, {_EVENTS}, {suspects},
  num AS (SELECT *, row_number() OVER (PARTITION BY "user", node ORDER BY ord, action DESC) AS k FROM {events}),
  st("user", node, k, s, tm, suspect, denied) AS (
    SELECT DISTINCT "user", node, 0::BIGINT, -1, NULL::VARCHAR, FALSE, FALSE FROM num
    UNION ALL
    SELECT n."user", n.node, n.k,
      CASE WHEN n.action IN ('deny', 'reopen') THEN -1 WHEN n.action = 'mark' AND n.s >= st.s THEN n.s ELSE st.s END,
      CASE WHEN n.action IN ('deny', 'reopen') THEN NULL WHEN n.action = 'mark' AND n.s >= st.s THEN n.tm ELSE st.tm END,
      CASE WHEN n.action IN ('deny', 'reopen', 'mark') THEN FALSE ELSE st.s >= 0 END,
      CASE WHEN n.action = 'mark' THEN FALSE WHEN n.action = 'deny' THEN TRUE ELSE st.denied END
    FROM st JOIN num n ON n."user" = st."user" AND n.node = st.node AND n.k = st.k + 1),
  fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY "user", node ORDER BY k DESC) = 1),
  prof AS (SELECT "user", node, ['declared', 'read', 'demonstrated'][s + 1] AS state, tm AS "at", suspect, denied FROM fin WHERE s >= 0 OR denied)"""


_PLAIN = _fold("ev", "none AS (SELECT 1)")
_WITH_DEPENDENTS = _fold(
    "alle",
    """own AS (SELECT DISTINCT node FROM ev),
  up AS (SELECT dst AS node, src AS dependent FROM req JOIN own ON own.node = dst UNION SELECT up.node, req.src FROM up JOIN req ON req.dst = up.dependent),
  alle AS (SELECT "user", node, ord, tm, action, s FROM ev UNION ALL
    SELECT ev."user", up.dependent, ev.ord, ev.tm, 'suspect', NULL FROM ev JOIN (SELECT * FROM up WHERE dependent IN (SELECT node FROM own)) up ON up.node = ev.node WHERE ev.action = 'reopen')""",
)


@query(f"{_PLAIN} SELECT * FROM prof")
def t1_profile_fold(spark, sf_dir):
    return p.fold(profile_events(read(spark, sf_dir, "events")))


@query(f"{_WITH_DEPENDENTS} SELECT * FROM prof")
def t3_reopen(spark, sf_dir):
    return p.fold(p.with_suspicions(profile_events(read(spark, sf_dir, "events")), requires(spark, sf_dir)))


@query(f"""{_PLAIN} SELECT "user", node FROM prof WHERE state IN ('read', 'demonstrated') AND NOT suspect""")
def t4_known(spark, sf_dir):
    return p.known(p.fold(profile_events(read(spark, sf_dir, "events"))), "read")


@query(f"""{_PLAIN} SELECT "user", node FROM prof WHERE denied""")
def t2_denied(spark, sf_dir):
    return p.not_known(p.fold(profile_events(read(spark, sf_dir, "events"))))


@query(f"""{_PLAIN} SELECT "user", node, "at" FROM prof WHERE state IS NOT NULL AND "at"::TIMESTAMP < (SELECT max(ts)::DATE FROM events) - INTERVAL 10 DAY""")
def t5_stale(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    now = str(e.agg(F.max("ts").cast("date")).first()[0])
    return p.stale(p.fold(profile_events(e)), now, 10)


@query(f"""{_PLAIN} SELECT "user", node, state, "at", (row_number() OVER (PARTITION BY "user" ORDER BY CASE state WHEN 'declared' THEN 0 WHEN 'read' THEN 1 ELSE 2 END, "at", node))::INTEGER AS place FROM prof WHERE state IS NOT NULL""")
def o3_weakest_first(spark, sf_dir):
    return p.weakest_first(p.fold(profile_events(read(spark, sf_dir, "events"))))


@query(f"""{_PLAIN} SELECT "user", node, CASE WHEN s >= 0 THEN ['declared', 'read', 'demonstrated'][s + 1] END AS state, tm AS "at", denied FROM fin""")
def stream_profile(spark, sf_dir):
    out = s.run_to_table(s.profiles(profile_events(s.stream(spark, f"{sf_dir}/events.parquet"))), "update", "profile", readers.ROCKSDB)
    last = out.groupBy("user", "node").agg(F.max_by(F.struct("state", "at", "denied"), "_batch").alias("v"))
    return last.select("user", "node", "v.state", "v.at", "v.denied")


@query(f"{_WITH_DEPENDENTS} SELECT * FROM prof")
def stream_suspicions(spark, sf_dir):
    """The profiles of ``t3_reopen`` from a stream of the same events."""
    under = readers.below(requires(spark, sf_dir), spark.range(40))
    events = profile_events(s.stream(spark, f"{sf_dir}/events.parquet"))
    out = s.run_to_table(readers.profiles(events, under), "update", "readers", readers.ROCKSDB)
    last = out.groupBy("user", "node").agg(F.max_by(F.struct("state", "at", "suspect", "denied"), "_batch").alias("v"))
    return last.select("user", "node", "v.state", "v.at", "v.suspect", "v.denied").where("state is not null or denied")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    out = s.run_to_table(s.windowed(s.stream(spark, f"{sf_dir}/events.parquet")), "complete", "windows")
    return out.withColumn("total", F.round("total", 4))


_STEPS = """st AS (SELECT conv_id AS doc, turn::INTEGER AS n, text FROM conversations)"""


def _steps(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("n"), "text")


@query(
    f"""WITH sw AS (SELECT unnest({STOP}) AS w),
  tok AS (SELECT DISTINCT conv_id AS doc, turn::INTEGER AS item, unnest(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]{{2,}})', 1)) AS token FROM conversations),
  un AS (SELECT doc, item FROM (SELECT * FROM tok WHERE token NOT IN (SELECT w FROM sw) QUALIFY count(*) OVER (PARTITION BY doc, token) = 1)),
  g AS (SELECT doc, item, count(*) AS k FROM un GROUP BY ALL HAVING count(*) >= 2),
  best AS (SELECT doc, item, row_number() OVER (PARTITION BY doc ORDER BY k DESC, item DESC) AS place FROM g QUALIFY place <= 2)
  SELECT b.doc, b.place::INTEGER AS place, b.item AS n, string_agg(CASE WHEN c.turn = b.item THEN '[' || c.turn || '] ???' ELSE '[' || c.turn || '] ' || c.text END, chr(10) ORDER BY c.turn) AS question,
    max(c.text) FILTER (WHERE c.turn = b.item) AS answer, b.item::VARCHAR AS hidden FROM best b JOIN conversations c ON c.conv_id = b.doc GROUP BY b.doc, b.place, b.item"""
)
def e1_masked_steps(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    masks = w.rank_masks(w.unique_tokens(steps.withColumnRenamed("n", "item"))).where("place <= 2")
    return x.step_exercises(steps, w.forward_leaks(steps), masks)


@query("""WITH b AS (SELECT c_custkey % 50 AS doc, c_custkey AS k, c_mktsegment FROM customer), s AS (SELECT doc, 0 AS r, 'step' AS kind, (row_number() OVER (PARTITION BY doc ORDER BY k)) AS p, 'q' || k AS question, c_mktsegment AS answer FROM b WHERE k % 3 = 0),
  y AS (SELECT doc, 1 AS r, 'symbol' AS kind, (row_number() OVER (PARTITION BY doc ORDER BY k)) AS p, 's' || k AS question, c_mktsegment AS answer FROM b WHERE k % 5 = 0)
  SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY r, p))::INTEGER AS place, kind, question, answer FROM (SELECT * FROM s UNION ALL SELECT * FROM y) QUALIFY place <= 3""")
def e3_exercises(spark, sf_dir):
    from pyspark.sql import Window

    b = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("doc"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("answer"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("k")).alias("place")

    def rows(cond, mark):
        return b.where(cond).select("doc", place, F.concat(F.lit(mark), F.col("k")).alias("question"), "answer")

    return x.exercises_for(rows("k % 3 = 0", "q"), rows("k % 5 = 0", "s"))


@query(f"""WITH RECURSIVE {REQ}, {NODES}, dd AS (SELECT id, 0 AS k FROM (SELECT src AS id FROM req UNION SELECT dst FROM req) UNION SELECT req.src, k + 1 FROM dd JOIN req ON req.dst = dd.id),
  d AS (SELECT id, max(k) AS depth FROM dd GROUP BY id), r AS (SELECT src, dst FROM req UNION SELECT r.src, req.dst FROM r JOIN req ON r.dst = req.src),
  c AS (SELECT src AS id, count(*) AS cost FROM r GROUP BY src), u AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS reuse FROM lineitem GROUP BY l_partkey)
  SELECT n.id, n.name, n.type, n.tier, CASE tier WHEN 'assumed' THEN 0 ELSE 1 END AS tier_rank, coalesce(depth, 0)::INTEGER AS depth, coalesce(reuse, 0) AS reuse, coalesce(cost, 0) AS cost,
    CASE n.id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'declared' ELSE '' END AS state, CASE n.id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS state_rank, CASE WHEN n.id % 6 = 0 THEN 'because' END AS why
  FROM nodes n LEFT JOIN d USING (id) LEFT JOIN c USING (id) LEFT JOIN u USING (id)""")
def k1_export_nodes(spark, sf_dir):
    n, e = nodes(spark, sf_dir), requires(spark, sf_dir)
    cost = reachability.counts_below(e, n).withColumnRenamed("n", "cost")
    use = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("n"))
    profile = n.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "read").otherwise("declared").alias("state"))
    notes = n.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "mine").otherwise("other").alias("project"), F.lit("because").alias("why"))
    return sinks.export_nodes(n, g.depths(e), use, cost, profile, notes, "mine")


@query(f"""WITH RECURSIVE {REQ}, {NODES}, dd AS (SELECT id, 0 AS k FROM (SELECT src AS id FROM req UNION SELECT dst FROM req) UNION SELECT req.src, k + 1 FROM dd JOIN req ON req.dst = dd.id)
  SELECT 'robot' AS root, max(k)::INTEGER AS max_depth, 4::INTEGER AS max_level, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM req) AS edges, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'F') AS documents FROM dd""")
def k1_export_summary(spark, sf_dir):
    n, e, o = nodes(spark, sf_dir), requires(spark, sf_dir), read(spark, sf_dir, "orders")
    drawn = n.join(g.depths(e), "id", "left").withColumn("level", (F.col("id") % 5).cast("int"))
    documents = sinks.cited_documents(o.where("o_orderstatus = 'F'").select(F.array("o_orderpriority").alias("sources")), o.select(F.col("o_orderpriority").alias("document")).distinct())
    return sinks.export_summary(drawn, e, documents, "robot")


@query("SELECT doc_id, replace(replace(replace(text, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS safe FROM documents")
def k2_html_safe(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.html_safe(F.col("text")).alias("safe"))


@query()
def f8_html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.html_text("html").alias("text"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t-\\r]+', ' ', 'g'), ' ') AS title FROM pages")
def f10_page_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


@query()
def f2_ascii_slug(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", web.ascii_slug(F.substring("text", 1, 60)).alias("slug"))


@query("""WITH h AS (SELECT page_id AS page, regexp_extract_all(html, 'href=["''](https?://[^"'']+)["'']', 1) AS u FROM (SELECT page_id, replace(replace(replace(html, 'href="/t', 'href="https://a.example.com/t'), 'href="/a', 'href="https://b.example.org/a'), 'href="/', 'href="https://c.example.net/') AS html FROM pages)), r AS (SELECT page, i AS ord, u[i] AS url FROM h, LATERAL (SELECT unnest(range(1, len(u) + 1)) AS i)),
  k AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM r WHERE NOT regexp_matches(url, '(?i)(web\\.archive\\.org|books\\.google|amazon\\.|youtube\\.com|twitter\\.com|facebook\\.com|/rss|\\.xml$|archive\\.today)')),
  c AS (SELECT *, CASE WHEN contains(url, 'example.org') THEN 1 WHEN contains(url, 'example.com') THEN 2 WHEN contains(url, 'example.net') THEN 3 END AS rank, CASE WHEN contains(url, 'example.org') THEN 'course' WHEN contains(url, 'example.com') THEN 'paper' WHEN contains(url, 'example.net') THEN 'code' END AS kind, regexp_extract(url, '^https?://([^?#]*)', 1) AS key FROM k),
  f AS (SELECT page, key, min({'d': rank, 'o': ord}) AS ord, arg_min(url, {'d': rank, 'o': ord}) AS url, arg_min(kind, {'d': rank, 'o': ord}) AS kind FROM c WHERE kind IS NOT NULL GROUP BY page, key),
  n AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY ord) AS rn, min(ord) OVER (PARTITION BY page, kind) AS first FROM f),
  w AS (SELECT page, (row_number() OVER (PARTITION BY page ORDER BY rn, first, ord))::INTEGER AS place, url, kind FROM n QUALIFY place <= 6),
  l AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) AS seg FROM w),
  m AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN seg = '' THEN host ELSE seg END, '(?i)[.](pdf|html?|php|aspx)$', ''), '[_+-]+', ' ', 'g'), ' ') AS stem FROM l)
  SELECT page, place, url, kind, CASE WHEN stem = '' THEN host ELSE stem || ' \u2014 ' || host END AS title FROM m""")
def s20_external_links(spark, sf_dir):
    html = F.col("html")
    for a, b in (("t", "a.example.com/t"), ("a", "b.example.org/a"), ("", "c.example.net/")):
        html = F.replace(html, F.lit(f'href="/{a}'), F.lit(f'href="https://{b}'))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), html.alias("html"))
    return web.external_links(pages, (("example.org", "course"), ("example.com", "paper"), ("example.net", "code")))


@query("""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://arxiv.org/abs/2001.1' WHEN 1 THEN 'https://doi.org/10.1/x' WHEN 2 THEN url || '.pdf' WHEN 3 THEN 'https://www.jstor.org/stable/1' WHEN 4 THEN 'http://b.org/isbn/9780131103627' ELSE url END AS url FROM pages)
  SELECT page_id, CASE WHEN regexp_matches(lower(url), 'arxiv\\.org/(abs|pdf)/') THEN 'arxiv' WHEN regexp_matches(lower(url), '(doi\\.org/|/doi/)10\\.') THEN 'doi' WHEN contains(lower(url), 'jstor.org/stable/') THEN 'jstor'
    WHEN regexp_matches(lower(url), 'isbn[:/=]?[0-9x-]{10,}') THEN 'isbn' WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'pdf' ELSE 'page' END AS kind FROM u""")
def s21_citation_kind(spark, sf_dir):
    i = F.col("page_id") % 6
    url = F.when(i == 0, "https://arxiv.org/abs/2001.1").when(i == 1, "https://doi.org/10.1/x").when(i == 2, F.concat("url", F.lit(".pdf"))).when(i == 3, "https://www.jstor.org/stable/1").when(i == 4, "http://b.org/isbn/9780131103627").otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", web.citation_kind(url).alias("kind"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://arxiv.org/pdf/2001.0' || page_id || 'v2.pdf' WHEN 1 THEN 'https://doi.org/10.1/x%2F' || page_id || '?q' WHEN 2 THEN 'https://www.jstor.org/stable/' || page_id WHEN 3 THEN 'http://b.org/isbn/978-0131103' || (100 + page_id % 900) ELSE url END AS url FROM pages)
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2001.0' || page_id WHEN 1 THEN '10.1/x/' || page_id WHEN 2 THEN '10.2307/' || page_id WHEN 3 THEN '9780131103' || (100 + page_id % 900) END AS key FROM u""")
def s21_citation_key(spark, sf_dir):
    p = F.col("page_id")
    k, text = p % 5, p.cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://arxiv.org/pdf/2001.0"), text, F.lit("v2.pdf"))).when(k == 1, F.concat(F.lit("https://doi.org/10.1/x%2F"), text, F.lit("?q")))
    url = url.when(k == 2, F.concat(F.lit("https://www.jstor.org/stable/"), text)).when(k == 3, F.concat(F.lit("http://b.org/isbn/978-0131103"), (100 + p % 900).cast("string"))).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", web.citation_key(url).alias("key"))
