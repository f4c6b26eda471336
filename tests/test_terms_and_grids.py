"""Many terms in many lines, popular topics, folded values and heading extents, against plain Python."""

import random
import re
import time

import pytest

from loomgraph.operators import quality as q
from loomgraph.operators import relate as r
from loomgraph.operators import windows as w


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_terms_in_texts(spark, at_once):
    rng = random.Random(6)
    texts = [("".join(rng.choice("abc \n") for _ in range(rng.randrange(0, 60))), k) for k in range(200)] + [(None, 200), ("", 201), ("abab" * 50_000, 202)]
    terms = [("".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))), k) for k in range(60)] + [("ab", 99)]
    got = r.containing(spark.createDataFrame(terms, "term string, t int"), "term", spark.createDataFrame(texts, "text string, _held int").withColumnRenamed("_held", "k"), "text", at_once)
    assert sorted((x.t, x.k) for x in got.collect()) == sorted((t, k) for term, t in terms for text, k in texts if term and text and term in text)
    assert got.columns == ["text", "k", "term", "t"]
    none = r.containing(spark.createDataFrame([], "term string"), "term", spark.createDataFrame(texts, "text string, k int"), "text")
    assert none.count() == 0


def test_terms_of_a_whole_table_read_each_line_once(spark):
    needles = spark.range(20_000).selectExpr("concat('n', id, '.') as term")
    lines = spark.range(20_000).selectExpr("id", "concat('says n', id % 997, '. and n', id % 10, 'x') as text")
    assert r.containing(needles, "term", lines, "text").where("term = concat('n', id % 997, '.')").count() == 20_000


@pytest.mark.parametrize("most", [4_000_000, 50])
def test_grid_join(spark, most):
    left = spark.range(600).selectExpr("id as a", "if(id % 2 = 0, 0, id % 40) as k")
    right = spark.range(500).selectExpr("id as b", "if(id % 3 = 0, 0, id % 50) as k")
    plain = left.join(right, "k").select("a", "b", "k")
    grid = r.grid_join(left, right, "k", most).select("a", "b", "k")
    assert plain.exceptAll(grid).count() == 0 and grid.exceptAll(plain).count() == 0


def test_no_task_makes_all_links_of_a_popular_topic(spark):
    """Half of all endpoints on one topic: its pairs come from blocks, none of them over the bound."""
    ends = spark.range(4000).selectExpr("id as component", "if(id % 2 = 0, 'hot', concat('t', id % 300)) as topic", "if(id % 4 < 2, 'publishes', 'subscribes') as role", "'e' as evidence", "id as ord")
    pubs, subs = ends.where("role = 'publishes'").select("component", "topic"), ends.where("role = 'subscribes'").select(ends["component"].alias("to"), "topic")
    busy = r.popular(pubs, subs, "topic", 10_000).collect()
    assert [x.topic for x in busy] == ["hot"] and (busy[0]["_rows"], busy[0]["_cols"]) == (10, 10)
    assert r.links(ends).where("topic = 'hot'").count() == 1000 * 1000
    flow = {(x.a, x.b): x.topics for x in r.dataflow(ends.where("component < 60")).collect()}
    assert flow[0, 2] == 1 and len(flow) == 30 * 29 // 2 and (0, 1) not in flow


PARAMETERS = """
/**:
  ros__parameters:
    # a comment
    rate: 10.0   # more
    matrix: [1.0, 0.0,
             0.0, 1.0]  # end
    nested: [[1,
      2],
      [3, 4],

      deep: [5
    ]]
    closed: ]]
    after: x
- [a list, opened
not_inside: 1
filter:
  key: [
filter_in_value:
  ]
  empty:
  block: |
  text: "quoted # cut
  last: [never closed
  gone: 1
"""


def values_of(text):
    """(scope, name, value) of a text: each value takes the fewest following lines that close what it opens."""
    lines = [x for x in (line.partition("#")[0].rstrip() for line in text.splitlines()) if x.strip()]
    scope, out, k = "", [], 0
    while k < len(lines):
        line, k = lines[k], k + 1
        key, value = re.fullmatch(r"([A-Za-z_/*\"'][^:\s]*)\s*:", line), re.fullmatch(r"\s*([A-Za-z_][\w/]*)\s*:\s*(\S.*)", line)
        if key:
            scope = key[1].strip("\"'")
        elif value and value[2] not in "|>":
            taken = [value[2]]
            while (whole := " ".join(taken)).count("[") > whole.count("]") and k < len(lines):
                taken.append(lines[k].strip())
                k += 1
            out.append((scope, value[1], " ".join(taken)))
    return out


def test_folded_values(spark):
    rng = random.Random(4)
    pieces = ["a: 1", "b: [1", "  c: ]", "- [x", "]", "]]", "[", "top:", "/**:", "# no", "  d: |", "plain words", "e: [[2", "", "  ", "f: [3] # [", "g:", "]["]
    texts = [PARAMETERS, "", "]\n]\nx: [\ny: 2"] + ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    lines = [(k, n, line) for k, text in enumerate(texts) for n, line in enumerate(text.splitlines())]
    got = w.folded_values(spark.createDataFrame(lines, "doc int, ln int, text string").repartition(3)).orderBy("doc", "ln").collect()
    want = [(k, *p) for k, text in enumerate(texts) for p in values_of(text)]
    assert [(x.doc, x.scope, x.name, x.value) for x in got] == want
    assert w.folded_values(spark.createDataFrame([], "doc int, ln int, text string")).count() == 0


def test_extents(spark):
    rng = random.Random(2)
    rows = [(d, pos, rng.randrange(1, 7)) for d in range(5) for pos in rng.sample(range(1000), 120)]
    got = {(x.doc, x.pos): x.stop for x in w.extents(spark.createDataFrame(rows, "doc int, pos long, level int")).collect()}
    assert got == {(d, p): min((b for e, b, k in rows if e == d and b > p and k <= lv), default=None) for d, p, lv in rows}
    began = time.time()
    many = spark.range(1_000_000).selectExpr("0 as doc", "id as pos", "cast(1 + id % 6 as int) as level")
    assert w.extents(many).agg({"stop": "count"}).first()[0] == 999_996
    assert time.time() - began < 60


def test_kinds_of_what_is_no_node(spark):
    n = spark.createDataFrame([("t", "technique", "statement"), ("a", "concept", "statement"), ("b", "concept", "derivation"), ("c", None, None)], "id string, type string, tier string")
    e = spark.createDataFrame([("b", "a")], "src string, dst string")
    asked = spark.createDataFrame([("a",), ("zz",)], "id string")
    none = spark.createDataFrame([], "id string, derives boolean")
    assert dict(q.expected_kind(n, e, none, asked).collect()) == {"t": "derivation", "a": "definition", "b": "definition", "c": "definition", "zz": "derivation"}
    assert dict(q.statement_suffices(n, e, asked).collect()) == {"t": False, "a": True, "b": False, "c": True, "zz": False}
    records = spark.createDataFrame([("t", "definition", True), ("zz", "derivation", True), ("a", "definition", None)], "id string, kind string, grounded boolean")
    assert dict(q.needs_better_sources(records, n, e).collect()) == {"t": True, "zz": False, "a": False}
