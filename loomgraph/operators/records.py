"""Small predicates, selections, panels and reports over nodes, components and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fixed import LAUNCH_FILE, TELLING
from ..sources.tables import small
from . import relate
from .graph import GLOBAL_TYPES
from .relate import containing

_ID = r"^[a-z][a-z0-9_]*$"


def valid_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): ids in lower snake case with a name, and the others with a reason."""
    reason = F.when(~F.coalesce(F.col("id").rlike(_ID), F.lit(False)), "bad id").when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name")
    marked = nodes.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def is_global(kind: Column) -> Column:
    return kind.isin(*GLOBAL_TYPES)


def glue(components: DataFrame, parameters: DataFrame) -> DataFrame:
    """Components without any parameter."""
    return components.join(parameters.select("component").distinct(), "component", "left_anti")


def facts(edges: DataFrame) -> DataFrame:
    """Edges that were extracted rather than inferred."""
    return edges.where(F.col("confidence").eqNullSafe("EXTRACTED"))


def outside(paths: Column, skipped: tuple[str, ...]) -> Column:
    """Whether no folder of a path is one of the skipped ones."""
    return ~F.arrays_overlap(F.split(paths, "/"), F.array(*map(F.lit, skipped)))


def counts_by(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def rate(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """(by, n, hits, percent): the share of rows that hit, rounded to a tenth."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return g.withColumn("percent", F.round(100.0 * F.col("hits") / F.col("n"), 1))


def reason_samples(rows: DataFrame, key: Column, order: str, limit: int = 6) -> DataFrame:
    """(reason, n, samples): counts by reason and the first few keys; the others are never gathered."""
    w = Window.partitionBy("reason").orderBy(order)
    ranked = rows.where("reason is not null").select("reason", key.cast("string").alias("k"), F.row_number().over(w).alias("rn"))
    g = ranked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("rn") <= limit, F.struct("rn", "k")))).alias("s"))
    return g.select("reason", "n", F.array_join(F.transform("s", lambda x: x["k"]), ",").alias("samples"))


def topic_summary(ends: DataFrame) -> DataFrame:
    """One row: links, their topics, stated endpoints, and endpoints that only one side has (unread, unfed)."""
    unread, unfed = relate.one_sided(ends)
    linked = relate.links(ends).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("topic").alias("topics"))
    counts = [linked, *(x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((ends, "endpoints"), (unread, "unread"), (unfed, "unfed")))]
    one = [x.withColumn("_k", F.lit(1)) for x in counts]  # a row each
    out = one[0]
    for x in one[1:]:
        out = out.join(x, "_k")
    return out.drop("_k")


def topic_report(ends: DataFrame) -> DataFrame:
    """(section, topic, component, other, evidence, other_evidence): every link, then what nobody reads, then what nobody feeds."""
    unread, unfed = relate.one_sided(ends)
    found = relate.links(ends).select(F.lit("links").alias("section"), "topic", F.col("pub").alias("component"), F.col("sub").alias("other"), F.col("pub_evidence").alias("evidence"), F.col("sub_evidence").alias("other_evidence"))
    for name, rows in (("unread", unread), ("unfed", unfed)):
        found = found.unionByName(rows.select(F.lit(name).alias("section"), "topic", "component", "evidence"), allowMissingColumns=True)
    return found


def merge_report(merged: DataFrame, limit: int = 6) -> DataFrame:
    """Merged proposals (cluster, ord, src, dst, status, reason) -> (status, reason, n, samples): counts, and the first edges of each.

    Samples are ``src -> dst`` by cluster and order, ``limit`` of them; ``more`` counts the others.
    """
    w = Window.partitionBy("status", "reason").orderBy("cluster", "ord")
    edge = F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"))
    ranked = merged.select("status", "reason", edge.alias("edge"), F.row_number().over(w).alias("place"))
    g = ranked.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= limit, F.struct("place", "edge")))).alias("s"))
    return g.select("status", "reason", "n", F.array_join(F.transform("s", lambda x: x["edge"]), "; ").alias("samples"), F.greatest(F.col("n") - limit, F.lit(0)).alias("more"))


def spans_for(spans: DataFrame, node: str, is_algorithm: bool) -> DataFrame:
    """spans (id, ...) of library sources that a note on a node may show: all for an algorithm that the library implements, else its own."""
    return spans if is_algorithm else spans.where(F.col("id") == node)


def targets(nodes: DataFrame, sheets: DataFrame, tier: str | None = None, names: list[str] | None = None, failing: bool = False) -> DataFrame:
    """Nodes to generate records for: named ones, failing ones, a tier's, else all without a record."""
    if names:
        return nodes.where(F.col("id").isin(*names))
    if failing:  # a record without a verdict counts as fine
        return nodes.join(sheets.where(~F.coalesce("ok", F.lit(True))).select("id"), "id", "left_semi")
    rest = nodes if tier is None else nodes.where(F.col("tier") == tier)
    return rest.join(sheets.select("id"), "id", "left_anti")


def launched_by(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """components (component, source) and nodes (id, label, source_file, deterministic, external) -> (component, id).

    Nodes for the launch files that start a component: one of the code that is the file
    itself, or a described one whose label holds the file's name.
    """
    name = F.regexp_extract("source", r"([^/]+)$", 1)
    files = components.where(F.col("source").rlike(LAUNCH_FILE)).select("component", "source", name.alias("name")).distinct()
    own = nodes.where("not external")
    exact = own.where("deterministic").join(files, (F.col("source_file") == F.col("source")) & (F.col("label") == F.col("name"))).select("component", "id")
    named = containing(files.select("name").distinct(), "name", own.where("not deterministic").select("id", "label"), "label")
    return exact.unionByName(named.join(files, "name").select("component", "id")).distinct()


def panels(components: DataFrame, matches: DataFrame) -> DataFrame:
    """(component, files): every component with its matched files, empty where there are none."""
    m = matches.groupBy("component").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return components.select("component").distinct().join(m, "component", "left").select("component", F.array_join(F.coalesce("files", F.array().cast("array<string>")), ",").alias("files"))


def owners(reach: DataFrame, aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """reach (id, needs), aliases (id, title), documents (document, section) -> (id, owner, document, section).

    A title ``document#part`` of a prerequisite owns the sections pinned for the document.
    ``reach`` holds each pair once, so that the rows, far more than its own, need no comparison.
    """
    a = aliases.select(F.col("id").alias("owner"), t.base_document(F.col("title")).alias("document")).distinct()
    owned = a.join(documents.select("document", "section").distinct(), "document")
    return reach.select("id", F.col("needs").alias("owner")).join(small(owned, 200_000), "owner").select("id", "owner", "document", "section")


def owners_below(edges: DataFrame, roots: DataFrame, aliases: DataFrame, documents: DataFrame) -> DataFrame:
    """``owners`` of the roots (id) by all paths of edges (src, dst).

    A title's document goes with the packed labels of its node, so pairs meet the pinned
    documents alone and no table of titles or nodes is broadcast.
    """
    from . import reachability

    pinned = documents.select("document", "section").distinct()
    titled = aliases.select("id", t.base_document(F.col("title")).alias("document")).join(small(pinned.select("document").distinct()), "document", "left_semi")
    reach = reachability.pairs(edges, roots, titled.select("id", "document"))
    return reach.join(small(pinned), "document").select(F.col("src").alias("id"), F.col("dst").alias("owner"), "document", "section")


def excerpts(spans: DataFrame, parameters: DataFrame, budget: int) -> DataFrame:
    """spans (node, ord, path, start, term, lines, own), parameters (node, name) -> (node, place, block).

    A node's own spans are shown whole. Of the others, every line that names a parameter as
    a word (an underscore may follow) is shown with four lines before and one after. Blocks
    are taken in that order until the first that overflows the budget of characters.
    """
    quoted = F.regexp_replace("name", r"([^A-Za-z0-9_])", r"\\$1")
    names = parameters.where("name <> ''").select("node", quoted.alias("q")).groupBy("node").agg(F.array_join(F.collect_set("q"), "|").alias("q"))
    s = spans.join(names, "node", "left")
    pattern = F.concat(F.lit(r"\b(?:"), "q", F.lit(r")_?\b"))
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    hits = F.when(F.col("own"), F.array(F.lit(-1))).when((F.size("lines") > 0) & F.col("q").isNotNull(), F.filter(at, lambda i: F.regexp_like(F.get("lines", i), pattern)))
    e = s.withColumn("hit", F.explode(hits))
    whole = F.concat(F.lit("-"), F.col("start") + F.size("lines") - 1, F.lit("  ("), F.coalesce("term", F.lit("")), F.lit(")\n"), F.array_join("lines", "\n"))
    first = F.greatest(F.col("hit") - 4, F.lit(0))
    near = F.concat(F.lit("\n"), F.array_join(F.slice("lines", first + 1, F.col("hit") + 2 - first), "\n"))
    block = F.concat("path", F.lit(":"), F.when(F.col("own"), F.concat(F.col("start").cast("string"), whole)).otherwise(F.concat((F.col("start") + F.col("hit")).cast("string"), near)))
    b = e.select("node", F.struct((~F.col("own")).alias("rest"), "ord", "hit").alias("at_"), block.alias("block"))
    w = Window.partitionBy("node").orderBy("at_")
    shown = b.withColumn("spent", F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return shown.where(F.col("spent") <= budget).select("node", "place", "block")


def render_components(names: DataFrame, parameters: DataFrame, limit: int = 22) -> DataFrame:
    """(slug, line): parameters of components named by slug, telling ones first, matrices last among them.

    Both sides are joined on the slug, so names in camel case keep their parameters.
    """
    p = parameters.withColumn("slug", t.slug(F.col("component")))
    telling = F.when(F.lower("name").rlike(TELLING), 0).otherwise(1)
    w = Window.partitionBy("slug").orderBy(telling, F.when(t.is_matrix(F.col("value")), 1).otherwise(0), "name", "value")
    top = p.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    g = top.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat("name", F.lit("="), "value").alias("s")))).alias("x"))
    j = names.select(t.slug(F.col("name")).alias("slug")).distinct().join(g, "slug", "left")
    return j.select("slug", F.coalesce(F.array_join(F.transform("x", lambda v: v["s"]), ", "), F.lit("")).alias("line"))


def match_ignoring_case(wanted: DataFrame, components: DataFrame, done: DataFrame) -> DataFrame:
    """(component): those named in any case that are not stored yet."""
    w = wanted.select(F.lower("name").alias("_l")).distinct()
    return components.withColumn("_l", F.lower("component")).join(w, "_l", "left_semi").drop("_l").join(done.select("component"), "component", "left_anti")


def line_order(location: Column) -> Column:
    """The number in a location such as ``L11``, for numeric order."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(location, r"\D", ""), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def last_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One row for each key, that of the highest order."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def with_messages(report: DataFrame, messages: DataFrame) -> DataFrame:
    """A report (id, shape, ok) with further messages (id, message) appended to its shape; any fails it."""
    m = messages.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("_more"))
    j = report.join(m, "id", "left")
    shape = F.concat_ws("; ", F.nullif(F.col("shape"), F.lit("")), "_more")
    return j.withColumn("shape", shape).withColumn("ok", F.col("ok") & F.col("_more").isNull()).drop("_more")


def scan_scope(units: DataFrame, files: DataFrame, excluded: tuple[str, ...] = (), limit: int = 120) -> DataFrame:
    """(files_scanned, files_skipped, total, kept, complete, caveat) of a scan that keeps the first ``limit`` units.

    files (path, skipped): a scan is complete only if no file was skipped and every unit kept.
    """
    g = units.agg(F.count(F.lit(1)).alias("total"))
    f = files.agg(F.count_if(~F.col("skipped")).alias("files_scanned"), F.count_if("skipped").alias("files_skipped"))
    kept = F.least(F.col("total"), F.lit(limit))
    complete = (F.col("files_skipped") == 0) & (F.col("total") <= limit)
    said = F.concat(F.lit("partial scan: "), kept.cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" code units from "), F.col("files_scanned").cast("string"), F.lit(" files"))
    skipped = F.lit(f", skipped {', '.join(sorted(excluded))}" if excluded else "")
    one = g.withColumn("k", F.lit(1)).join(f.withColumn("k", F.lit(1)), "k")  # a row each
    return one.select("files_scanned", "files_skipped", "total", kept.alias("kept"), complete.alias("complete"), F.when(complete, "").otherwise(F.concat(said, skipped)).alias("caveat"))
