"""Joins of components, topics, code, documents and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fixed import BRIDGE, FLOW_RELATIONS, GENERIC_WORDS, NEVER_EVIDENCE, OUTPUT_NAME, TOPIC, WIRING_FILE
from ..functions.terms import terms_in
from ..sources.tables import Scratch, small


#: Pairs that one task makes where they are grouped by their ends, and rows of a key in one list.
PAIRS, LISTED = 4_000_000, 2_000


def distinct_endpoints(ends: DataFrame) -> DataFrame:
    """One row for each (component, topic, role) with the evidence that comes first by ``ord``."""
    return ends.groupBy("component", "topic", "role").agg(F.min(F.struct("ord", "evidence")).alias("e")).select("component", "topic", "role", "e.ord", "e.evidence")


def links(ends: DataFrame) -> DataFrame:
    """(pub, sub, topic, pub_evidence, sub_evidence): publishers and other subscribers of a topic.

    Endpoints are reduced to their first evidence before the join, so that it makes each
    link once; the role ``both`` counts on either side.
    """
    e = distinct_endpoints(ends)
    pubs = e.where("role in ('publishes', 'both')").groupBy("component", "topic").agg(F.min(F.struct("ord", "evidence")).alias("e"))
    subs = e.where("role in ('subscribes', 'both')").groupBy("component", "topic").agg(F.min(F.struct("ord", "evidence")).alias("e"))
    p = pubs.select(F.col("component").alias("pub"), "topic", F.col("e.evidence").alias("pub_evidence"))
    s = subs.select(F.col("component").alias("sub"), "topic", F.col("e.evidence").alias("sub_evidence"))
    return grid_join(p, s, "topic").where("pub <> sub").select("pub", "sub", "topic", "pub_evidence", "sub_evidence")


def one_sided(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unread, unfed): endpoints whose topic nobody subscribes to, or nobody publishes to."""
    pubs, subs = ends.where("role in ('publishes', 'both')"), ends.where("role in ('subscribes', 'both')")
    return pubs.join(subs.select("topic").distinct(), "topic", "left_anti"), subs.join(pubs.select("topic").distinct(), "topic", "left_anti")


def dataflow(ends: DataFrame) -> DataFrame:
    """(a, b, topics): unordered pairs of components a < b that share topics."""
    e = Scratch(ends.sparkSession, "dataflow").save(ends.select("component", "topic").distinct(), "ends")
    met = gathered(e.toDF("a", "topic"), e.toDF("b", "topic"), "topic", lambda a, b: a < b)
    return met.groupBy("a", "_cut", "b").agg(F.count(F.lit(1)).alias("topics")).select("a", "b", "topics")


def topic_edges(linked: DataFrame) -> DataFrame:
    """(pub, sub, n, topics, sentence): links, each once as ``links`` makes them, grouped by pair, topics sorted."""
    return _sentences(linked, "pub", "sub")


def topic_edges_of(ends: DataFrame) -> DataFrame:
    """``topic_edges`` of the ``links`` of endpoints (component, topic, role), without the links' evidence."""
    e = Scratch(ends.sparkSession, "topics").save(ends.select("component", "topic", "role").distinct(), "ends")
    pubs = e.where("role in ('publishes', 'both')").select(F.col("component").alias("pub"), "topic").distinct()
    subs = e.where("role in ('subscribes', 'both')").select(F.col("component").alias("sub"), "topic").distinct()
    return _sentences(gathered(pubs, subs, "topic", lambda p, s: p != s), "pub", "_cut", "sub")


def _sentences(linked: DataFrame, *keys: str) -> DataFrame:
    g = linked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("topic").cast("string"))).alias("topics"))
    joined = F.array_join("topics", ", ")
    return g.select("pub", "sub", F.size("topics").alias("n"), joined.alias("topics"), F.concat(F.col("pub").cast("string"), F.lit(" feeds "), F.col("sub").cast("string"), F.lit(" through "), joined).alias("sentence"))


def gathered(left: DataFrame, right: DataFrame, key: str, keep) -> DataFrame:
    """left (one, key) and right (other, key), each row once -> (one, _cut, other, key): the pairs of a key that ``keep`` takes, laid by (one, _cut).

    The others of a key go in lists of about ``LISTED``, so that a pair is one id in the
    shuffle, and there are as many tasks as the pairs need, about ``PAIRS`` in each. An
    other is in one cut, so groups of (one, _cut, other) need no further shuffle.
    """
    spark = left.sparkSession
    one, other = (next(c for c in f.columns if c != key) for f in (left, right))
    rows = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    loads = Scratch(spark, "gathered").save(left.join(rows, key).groupBy(one).agg(F.sum("_n").alias("_load")), "loads")
    width = max(spark.sparkContext.defaultParallelism, -(-(loads.agg(F.sum("_load")).first()[0] or 0) // PAIRS))
    busy = small(loads.where(F.col("_load") > PAIRS).select(one, F.ceil(F.col("_load") / PAIRS).alias("_cuts")))
    long = small(rows.where(F.col("_n") > LISTED).select(key, F.ceil(F.col("_n") / LISTED).alias("_parts")))
    part = F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1)))
    lists = right.join(long, key, "left").groupBy(key, part.alias("_part")).agg(F.collect_list(other).alias("_others"))
    met = grid_join(left, lists, key, LISTED).join(busy, one, "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1).cast("long")))
    met = met.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)))
    own = F.filter("_others", lambda o: keep(F.col(one), o) & ((F.col("_cuts") == 1) | (F.pmod(F.xxhash64(o), F.col("_cuts")) == F.col("_cut"))))
    met = met.select(one, "_cut", key, own.alias("_others")).where(F.size("_others") > 0)
    return met.repartition(width, one, "_cut").select(one, "_cut", F.explode("_others").alias(other), key)


def upstream(linked: DataFrame, names: DataFrame) -> DataFrame:
    """links and names (component) -> (line): who sends each topic that the components read, each line once."""
    text = F.concat(F.lit("- "), F.col("pub").cast("string"), F.lit(" publishes "), F.col("topic").cast("string"), F.lit("; "), F.col("sub").cast("string"), F.lit(" reads it ("), F.col("sub_evidence"), F.lit(")"))
    return linked.join(names.select(F.col("component").alias("sub")).distinct(), "sub", "left_semi").select(text.alias("line")).distinct()


def resolve_topic(name: Column, remappings: Column) -> Column:
    """A topic name after remapping (array of (inside, outside)), always with a leading slash.

    A name with a slash takes the last remapping of exactly that name, else every name
    takes the last one of it with or without the slash.
    """
    bare = F.regexp_replace(name, "^/+", "")
    exact = F.filter(remappings, lambda r: r["inside"] == name)
    either = F.filter(remappings, lambda r: F.regexp_replace(r["inside"], "^/+", "") == bare)
    to = F.when(name.startswith("/") & (F.size(exact) > 0), F.element_at(exact, -1)["outside"]).when(F.size(either) > 0, F.element_at(either, -1)["outside"]).otherwise(name)
    return F.when(to.startswith("/"), to).otherwise(F.concat(F.lit("/"), to))


#: The type of ``remappings`` in component rows.
REMAPPINGS = "array<struct<inside:string,outside:string>>"


def bridge_endpoints(arguments: DataFrame) -> DataFrame:
    """(component, executable, argument, remappings, ord) bridge specifications -> endpoints.

    ``TOPIC@TYPE[TYPE`` publishes, ``TOPIC@TYPE]TYPE`` subscribes, ``TOPIC@TYPE@TYPE`` does both;
    only the bridge's own executable counts.
    """
    topic, mark = F.regexp_extract("argument", BRIDGE, 1), F.regexp_extract("argument", BRIDGE, 2)
    roles = F.when(mark == "[", F.array(F.lit("publishes"))).when(mark == "]", F.array(F.lit("subscribes"))).otherwise(F.array(F.lit("publishes"), F.lit("subscribes")))
    own = arguments.where((F.col("executable") == "parameter_bridge") & (topic != ""))
    return own.select("component", resolve_topic(topic, F.col("remappings")).alias("topic"), F.explode(roles).alias("role"), F.concat(F.lit("bridge argument "), "argument").alias("evidence"), "ord")


def parameter_endpoints(parameters: DataFrame) -> DataFrame:
    """Endpoints from parameters (component, name, value, source, remappings, ord) whose value is a topic.

    Names that speak of an output are publishers, the others subscribers.
    """
    role = F.when(F.lower("name").rlike(OUTPUT_NAME), "publishes").otherwise("subscribes")
    value = F.regexp_replace(t.strip(F.col("value")), "^[\"']+|[\"']+$", "")
    topic = resolve_topic(value, F.col("remappings"))
    return parameters.where(value.rlike(TOPIC)).select("component", topic.alias("topic"), role.alias("role"), F.concat("source", F.lit(" "), "name").alias("evidence"), "ord")


def code_endpoints(components: DataFrame, files: DataFrame) -> DataFrame:
    """Endpoints that components (component, executable, remappings) open in their own modules.

    files (path, text): a module is a ``.py`` file named as the executable. Its syntax tree
    is read, never run: ``create_publisher(type, topic)`` and ``create_subscription``.
    """
    import pyarrow as pa

    modules = files.where(F.col("path").endswith(".py")).withColumn("executable", F.regexp_extract("path", r"([^/]+)\.py$", 1))
    modules = modules.join(components.select("executable").distinct(), "executable", "left_semi").select("executable", "path", "text")

    def run(batches):
        from ..sources.parsers import topic_calls

        for b in batches:
            rows = [(e, p, *c) for e, p, text in zip(*(x.to_pylist() for x in b.columns)) for c in topic_calls(text or "")]
            yield pa.record_batch([pa.array([r[k] for r in rows], ty) for k, ty in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["executable", "path", "topic", "role", "line", "method"])

    calls = modules.mapInArrow(run, "executable string, path string, topic string, role string, line long, method string")
    evidence = F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "method")
    return calls.join(components, "executable").select("component", resolve_topic(F.col("topic"), F.col("remappings")).alias("topic"), "role", evidence.alias("evidence"), F.col("line").alias("ord"))


def containing(needles: DataFrame, needle: str, hay: DataFrame, text: str, at_once: int = 100_000) -> DataFrame:
    """The join of ``needles`` and ``hay`` on ``text`` containing ``needle``, without a product of both.

    An automaton over the needles reads each text once, however many needles there are. It
    is broadcast, so it takes ``at_once`` of them at most; more are dealt into as many lots by
    their hashes, each a pass over the texts. Texts that hold no needle end there, and the
    others meet the needles by equality.
    """
    own = needles.where(F.length(needle) > 0)
    words = own.select(needle).distinct()
    lots = -(-words.count() // at_once)
    keyed = small(own, at_once)
    found = []
    for k in range(lots):
        terms = [r[0] for r in words.where(F.pmod(F.xxhash64(needle), F.lit(lots)) == k).collect()]
        hits = hay.withColumn("_held", F.explode(terms_in(hay.sparkSession, text, terms)))
        found.append(hits.join(keyed, F.col("_held") == F.col(needle)).drop("_held"))
    if not found:
        return hay.join(own, F.col(text) == F.col(needle)).limit(0)
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def popular(left: DataFrame, right: DataFrame, key: str, most: int) -> DataFrame:
    """(key, _rows, _cols): keys that join more than ``most`` pairs, with blocks of about the root of ``most`` rows of either side.

    The number of such keys is at most that of the pairs over ``most``.
    """
    side = max(1, int(most**0.5))
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_r")), key)
    busy = counts.where(F.col("_l") * F.col("_r") > most)
    return busy.select(key, F.ceil(F.col("_l") / side).alias("_rows"), F.ceil(F.col("_r") / side).alias("_cols"))


def grid_join(left: DataFrame, right: DataFrame, key: str, most: int = 4_000_000) -> DataFrame:
    """The equi-join of two frames on ``key``, popular keys by a grid of blocks.

    A key with more than ``most`` pairs is cut into blocks of rows and of columns; each block
    of one side goes to all of the other, so no task makes more than about ``most`` pairs of
    one key. The rows are those of the plain join.
    """
    busy = small(popular(left, right, key, most))
    rows = left.join(busy, key, "left").withColumn("_row", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_rows")), F.lit(0).cast("long")))
    rows = rows.withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_cols"), F.lit(1)) - 1))).drop("_rows", "_cols")
    cols = right.join(busy, key, "left").withColumn("_col", F.coalesce(F.pmod(F.xxhash64(*right.columns), F.col("_cols")), F.lit(0).cast("long")))
    cols = cols.withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_rows"), F.lit(1)) - 1))).drop("_rows", "_cols")
    return rows.join(cols, [key, "_row", "_col"]).drop("_row", "_col")


def library_endpoints(components: DataFrame, defaults: DataFrame) -> DataFrame:
    """Endpoints of components (component, library, executable, remappings) by library defaults
    (key, topic, role, ord), where the key is ``library/executable``; topics are remapped."""
    key = F.concat_ws("/", "library", "executable")
    joined = components.withColumn("key", key).join(defaults, "key")
    return joined.select("component", resolve_topic(F.col("topic"), F.col("remappings")).alias("topic"), "role", F.concat("key", F.lit(" default '"), "topic", F.lit("'")).alias("evidence"), "ord")


def stem_matches(components: DataFrame, files: DataFrame) -> DataFrame:
    """(component, file): components (component, executable) and files (file) of equal compacted names.

    An executable counts as a name only if no other component has it.
    """
    alone = F.count(F.lit(1)).over(Window.partitionBy("executable")) == 1
    names = components.withColumn("names", F.array_distinct(F.array_compact(F.array("component", F.when(alone, F.col("executable"))))))
    names = names.select("component", F.explode("names").alias("name")).select("component", t.compact(F.col("name")).alias("stem"))
    stems = files.select("file", t.compact(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)).alias("stem"))
    return names.where("stem <> ''").join(stems, "stem").select("component", "file").distinct()


def label_matches(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, label): all words of a name occur in a label, or its compacted form is one of them.

    Words are exploded and counted, so the containment test is an equi-join on words.
    """
    n = names.select("name", t.camel_words(F.col("name")).alias("words")).distinct()
    label = labels.select("label", t.camel_words(F.col("label")).alias("words")).distinct()
    lw = label.select("label", F.explode("words").alias("word"))
    by_words = (
        n.select("name", F.size("words").alias("need"), F.explode("words").alias("word"))
        .join(lw, "word")
        .groupBy("name", "label", "need")
        .agg(F.count(F.lit(1)).alias("got"))
        .where("got = need")
        .select("name", "label")
    )
    whole = n.select("name", t.compact(F.col("name")).alias("word")).join(lw, "word").select("name", "label")
    return by_words.unionByName(whole).distinct()


def both_side_misses(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two frames has."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def flows(edges: DataFrame, owners: DataFrame, nodes: DataFrame, relations: tuple[str, ...] = FLOW_RELATIONS) -> DataFrame:
    """Edges that leave a component for another part of the system.

    edges (src, dst, relation, confidence, ord), owners (component, id), nodes (id, external)
    -> (component, src, dst, relation, confidence, ord, other): of a component's edges between
    the same two nodes with one relation the first; the other end is none of its own nodes,
    exists and is not external.
    """
    e = edges.where(F.col("relation").isin(*relations))
    own = owners.select("component", "id").distinct()
    out = e.join(own.withColumnRenamed("id", "src"), "src").withColumn("other", F.col("dst"))
    into = e.join(own.withColumnRenamed("id", "dst"), "dst").withColumn("other", F.col("src"))
    away = out.unionByName(into).join(own.withColumnRenamed("id", "other"), ["component", "other"], "left_anti")
    known = away.join(nodes.where("not external").select(F.col("id").alias("other")).distinct(), "other", "left_semi")
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    first = known.groupBy("component", *pair, "relation").agg(F.min(F.struct("ord", "src", "dst", "confidence", "other")).alias("f"))
    return first.select("component", "f.src", "f.dst", "relation", "f.confidence", "f.ord", "f.other")


def confirm_flows(flow: DataFrame, owners: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b, relation, confidence, topics, confirmed): pairs of components with a flow, and the topics that link them either way.

    Of a pair's flows of one relation the first counts, by component and order.
    """
    pair = linked.select(F.least("pub", "sub").alias("a"), F.greatest("pub", "sub").alias("b"), F.col("topic").cast("string").alias("topic")).distinct()
    topics = pair.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics"))
    met = flow.join(owners.select(F.col("component").alias("to"), F.col("id").alias("other")).distinct(), "other").where("to <> component")
    first = met.groupBy(F.least("component", "to").alias("a"), F.greatest("component", "to").alias("b"), "relation").agg(F.min(F.struct("component", "ord", "confidence")).alias("f"))
    return first.join(topics, ["a", "b"], "left").select("a", "b", "relation", "f.confidence", F.coalesce("topics", F.lit("")).alias("topics"), F.col("topics").isNotNull().alias("confirmed"))


def components_reaching(uses: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """uses (component, algorithm) -> (component, node): components whose algorithm is a node or requires it.

    Only components whose names begin with ``project``, if given. Components go down the
    edges (src, dst) packed, 64 to a word, so no closure of the algorithms is listed.
    """
    from . import reachability

    own = uses if project is None else uses.where(F.col("component").startswith(project))
    words, numbers = reachability.reaching(edges, own.select(F.col("algorithm").alias("id"), "component"), "component")
    return reachability.labelled(words, numbers, "component").select("component", F.col("id").alias("node"))


def supporting(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(id): ends of edges that are no known node."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(known.select("id").distinct(), "id", "left_anti")


def priority_lookup(rows: DataFrame, keys: list[str], table: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the list of the first key that ``table`` (key, items) has.

    A key that is present with an empty list ends the search with nothing.
    """
    table = table.select("key", "items")
    out, order = rows, []
    for k, c in enumerate(keys):
        hit = table.select(F.col("key").alias(c), F.struct("items").alias(f"_hit{k}"))
        out = out.join(hit, c, "left")
        order.append(f"_hit{k}")
    return out.withColumn("found", F.coalesce(*order)["items"]).drop(*order)


def name_cascade(rows: DataFrame, ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (name) with ``resolved``: by slug as an id, by alias, by display name; else null."""
    words = F.regexp_replace(F.lower("name"), "[ -]", "_")
    a = ids.select(F.col("id").alias("_slug"), F.col("id").alias("_by_id"))
    b = aliases.select(F.col("alias").alias("_slug"), F.col("target").alias("_by_alias"))
    c = ids.select(F.lower("name").alias("_lower"), F.col("id").alias("_by_name")).groupBy("_lower").agg(F.min("_by_name").alias("_by_name"))
    joined = rows.withColumn("_slug", words).withColumn("_lower", F.lower("name")).join(a, "_slug", "left").join(b, "_slug", "left").join(c, "_lower", "left")
    return joined.withColumn("resolved", F.coalesce("_by_id", "_by_alias", "_by_name")).drop("_slug", "_lower", "_by_id", "_by_alias", "_by_name")


def section_owners(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """refs (ref_id, number, text) and owners (owner, name, section, prio) -> dangling references.

    An owner covers a number that equals its section, is an ancestor of it or lies below it.
    The covering owner of the least prio counts; a text that names it is no hand-off. The
    prefix-range join is an equi-join on the shorter number, both sides exploded into
    their ancestors.
    """
    parts = F.split("number", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws(".", F.slice(parts, 1, k)))
    r = refs.withColumn("k", F.explode(up)).select("ref_id", "number", "text", "k")
    parts_o = F.split("section", r"\.")
    up_o = F.transform(F.sequence(F.lit(1), F.size(parts_o)), lambda k: F.concat_ws(".", F.slice(parts_o, 1, k)))
    o = owners.withColumn("k", F.explode(up_o)).select("owner", "name", "section", "prio", "k")
    hit = r.join(o, "k").where((F.col("k") == F.col("number")) | (F.col("k") == F.col("section")))
    best = hit.groupBy("ref_id", "number", "text").agg(F.min(F.struct("prio", "owner", "name", "section")).alias("b"))
    named = F.lower("text").contains(F.lower("b.owner")) | F.lower("text").contains(F.lower("b.name"))
    return best.where(~named).select("ref_id", "number", "b.owner", "b.section").distinct()


def families(nodes: DataFrame, conventions: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), conventions (family, root, prio), edges -> (id, family): the first family one of whose roots is the node or requires it."""
    from . import reachability

    # Families go down the edges as packed labels, numbered in order; a node's lowest bit is the first of them.
    words, numbers = reachability.reaching(edges, conventions.select(F.col("root").alias("id"), F.struct("prio", "family").alias("f")), "f")
    lowest = F.bit_count(F.expr("(word & -word) - 1")).cast("int")
    low = words.withColumn("bit", F.when(F.col("word") == F.lit(-(2**63)), reachability.WORD - 1).otherwise(lowest))
    named = low.groupBy("id").agg(F.min(F.struct("bucket", "bit")).alias("at")).select("id", "at.bucket", "at.bit").join(small(numbers), ["bucket", "bit"])
    return nodes.select("id").distinct().join(named, "id").select("id", "f.family")


def notation_conflicts(symbols: DataFrame, conventions: DataFrame) -> DataFrame:
    """symbols (id, symbol, meaning, family) and conventions (family, letter, pattern, prio) -> clashes.

    A symbol whose bare letter belongs to its family's convention clashes with the first
    other letter of the family whose pattern its meaning matches.
    """
    s = symbols.withColumn("own", t.bare_letter(F.col("symbol")))
    c = conventions.select("family", "letter").distinct()
    mine = s.join(c.withColumnRenamed("letter", "own"), ["family", "own"], "left_semi")
    other = conventions.where("pattern <> ''").select("family", F.col("letter").alias("other"), "pattern", "prio")
    clash = mine.join(small(other), "family").where((F.col("own") != F.col("other")) & F.regexp_like(F.lower("meaning"), F.col("pattern")))
    return clash.groupBy("id", "symbol").agg(F.min(F.struct("prio", "other")).alias("b")).select("id", "symbol", F.col("b.other").alias("clashes_with"))


def look_back(lines: DataFrame, hits: DataFrame, reach: int = 15) -> DataFrame:
    """hits (doc, ln, name) -> (doc, ln, from_ln): lines (doc, ln, text) up to ``reach`` before that begin with the name as a word.

    White space may come before it. The range join is an equi-join on (doc, block of
    ``reach`` lines, first word), each hit in the two blocks that its range can touch.
    """
    first = F.regexp_extract("text", r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
    l = lines.select("doc", F.col("ln").alias("from_ln"), first.alias("name"), F.floor(F.col("ln") / reach).alias("blk")).where("name <> ''")
    h = hits.withColumn("blk", F.explode(F.array(F.floor(F.col("ln") / reach), F.floor(F.col("ln") / reach) - 1)))
    near = (F.col("from_ln") >= F.col("ln") - reach) & (F.col("from_ln") < F.col("ln"))
    return h.join(l, ["doc", "blk", "name"]).where(near).select("doc", "ln", "from_ln")


def covariance_assignments(lines: DataFrame) -> DataFrame:
    """lines (doc, ln, text) -> (doc, ln, name): the name that a covariance is set to at a line's end."""
    name = F.regexp_extract(t.strip(F.col("text")), r"covariance\w*\s*=\s*([A-Za-z_][A-Za-z0-9_]*)\s*$", 1)
    return lines.select("doc", "ln", name.alias("name")).where("name <> ''")


def stale_paths(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state): changed, new or deleted, by hashes (path, hash) of two scans."""
    b, n = before.select("path", F.col("hash").alias("h1")), now.select("path", F.col("hash").alias("h2"))
    j = b.join(n, "path", "full_outer").where(~F.col("h1").eqNullSafe(F.col("h2")))
    return j.select("path", F.when(F.col("h1").isNull(), "new").when(F.col("h2").isNull(), "deleted").otherwise("changed").alias("state"))


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, hash): the first 16 hexadecimal digits of the SHA-256 of the content."""
    return files.select("path", F.substring(F.sha2(F.col("content"), 256), 1, 16).alias("hash"))


def terms_for(nodes: DataFrame, knobs: DataFrame) -> DataFrame:
    """nodes (id, name), knobs (id, ord, parameter) -> (id, prio, term, strength): what to search for.

    Parameters come first, then the words of a name over four letters that are not
    generic; of terms that differ in case alone the first counts.
    """
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]+)"), F.lit(1)), lambda w: (F.length(w) > 4) & ~w.isin(*sorted(GENERIC_WORDS)))
    named = nodes.select("id", F.posexplode(words).alias("ord", "term"), F.lit(1).alias("strength"))
    own = knobs.where(F.trim("parameter") != "").select("id", F.col("ord").cast("int").alias("ord"), F.trim("parameter").alias("term"), F.lit(2).alias("strength"))
    first = own.unionByName(named).groupBy("id", F.lower("term").alias("_l")).agg(F.min(F.struct((-F.col("strength")).alias("s"), "ord", "term")).alias("t"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("t"))
    return first.select("id", place.alias("prio"), F.col("t.term").alias("term"), (-F.col("t.s")).alias("strength"))


def evidence(lines: DataFrame, terms: DataFrame, gap: int = 5, context: int = 5, limit: int = 3, reached: bool = True) -> DataFrame:
    """lines (doc, path, rank, ln, text), terms (term, strength, prio) -> best spans per doc.

    Terms go in order of prio, parameters with strength 2 and words of a name with 1, which
    don't count in tests, manifests and launch files, nor at all unless the project's
    components reach the node (``reached``). In each file of a doc a term claims its first line that is
    not within ``gap`` lines of one claimed before; the spans of a doc are ranked by file
    rank, strength and path, and ``limit`` of them stay. Only lines that hold a term reach
    the ordered step, one array per (doc, path), folded by columns alone.
    """
    usable = lines.where(~F.col("text").rlike(NEVER_EVIDENCE)).withColumn("_low", F.lower("text"))
    weak_in_wiring = (F.col("strength") < 2) & F.col("path").rlike(WIRING_FILE)
    wanted = terms if reached else terms.where("strength >= 2")
    found = containing(wanted.withColumn("_term", F.lower("term")), "_term", usable, "_low")
    hits = found.where(~weak_in_wiring)
    hit = F.struct(*(F.col(c).cast("int").alias(c) for c in ("prio", "strength")), "term", *(F.col(c).cast("int").alias(c) for c in ("ln", "rank")))
    own = hits.groupBy("doc", "path").agg(F.array_sort(F.collect_list(hit)).alias("_hits"))

    def claim(spans, h):
        """The hit becomes a span if its term has none yet and no span is near; a term's hits follow each other."""
        last = F.get(spans, F.size(spans) - 1)
        done = F.coalesce((last["prio"] == h["prio"]) & (last["strength"] == h["strength"]) & (last["term"] == h["term"]), F.lit(False))
        return F.when(done | F.exists(spans, lambda c: F.abs(h["ln"] - c["ln"]) <= gap), spans).otherwise(F.concat(spans, F.array(h)))

    spans = own.select("doc", "path", F.inline(F.aggregate("_hits", F.slice("_hits", 1, 0), claim)))
    best = Window.partitionBy("doc").orderBy("rank", F.desc("strength"), "path", "ln")
    kept = spans.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return kept.select("doc", "path", "ln", "term", "place", F.greatest(F.col("ln") - context, F.lit(1)).alias("first"), (F.col("ln") + context).alias("last"))
