"""Guards of derived records: every check is an anti-join or a higher-order function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFINES, DERIVATION_TITLE, MOVES, OUT_OF_SCOPE_TITLE, PRUNE_REASONS, UNINFORMATIVE
from ..sources.tables import Scratch, small
from . import reachability

def ungrounded(cites: DataFrame, sources: DataFrame) -> DataFrame:
    """cites (id, cite) and sources (id, source) -> citations without a retrieved source."""
    return cites.select("id", "cite").distinct().join(sources.select("id", F.col("source").alias("cite")).distinct(), ["id", "cite"], "left_anti")


def holes(invoked: DataFrame, edges: DataFrame, known: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """invoked (id, item) -> items outside the closure of id, not known and not id itself.

    Few different items go up the edges as packed labels. Else each pair is a question to the
    reachability index (``labels``, made here if not given).
    """
    asked = invoked.select("id", "item").distinct().where("id <> item")
    # An item that many ask for meets what is known once.
    items = asked.select("item").distinct().join(known.select(F.col("id").alias("item")).distinct(), "item", "left_anti")
    items = small(Scratch(invoked.sparkSession, "holes").save(items, "items"))
    asked = asked.join(items, "item", "left_semi")
    if labels is None and items.limit(reachability.MANY + 1).count() <= reachability.MANY:
        words, numbers = reachability.reaching(edges, items.select(F.col("item").alias("id"), "item"), "item", back=True, own=False)
        met = asked.join(F.broadcast(numbers), "item").join(words, ["id", "bucket"])
        return asked.join(met.where("getbit(word, bit) = 1").select("id", "item"), ["id", "item"], "left_anti").select("id", "item")
    held = reachability.holding(asked.select(F.col("id").alias("src"), F.col("item").alias("dst")), edges, labels)
    return asked.join(held.select(F.col("src").alias("id"), F.col("dst").alias("item")), ["id", "item"], "left_anti").select("id", "item")


def unsupported(claims: DataFrame, files: DataFrame) -> DataFrame:
    """claims (id, evidence array) -> (id, missing): evidence that is no file; none at all fails too."""
    e = claims.select("id", F.explode_outer("evidence").alias("path"))
    lost = e.where("path is not null").join(files.select("path").distinct(), "path", "left_anti").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("missing"))
    none = claims.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0).select("id", F.lit("").alias("missing"))
    return lost.unionByName(none)


def invented(notes: DataFrame, allowed: DataFrame) -> DataFrame:
    """notes (id, kind, value) and allowed (id, kind, value) -> values a note made up.

    A symbol may also be one part of an allowed comma-separated symbol list.
    """
    whole = allowed.select("id", "kind", "value")
    parts = allowed.where("kind = 'symbol'").select("id", "kind", F.explode(F.split("value", " *, *")).alias("value"))
    return notes.select("id", "kind", "value").where("value is not null").distinct().join(whole.unionByName(parts).distinct(), ["id", "kind", "value"], "left_anti")


#: Segments joined by _ or /, with dotted suffixes: snake_case names and paths, never a part of a longer word.
IDENTIFIER = r"(?<![\p{L}\p{N}_])([a-z][a-z0-9]*(?:[_/][a-z0-9]+)+(?:\.[a-z0-9]+)*)(?![\p{L}\p{N}_])"


def invented_tokens(prose: DataFrame, names: DataFrame, pattern: str = IDENTIFIER) -> DataFrame:
    """prose (id, text) -> (id, token): identifier-shaped tokens that are no known name.

    Names are those of parameters, files, components and algorithms, and the words of
    parameter values; tokens and names are compared as they are written.
    """
    tok = prose.select("id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("token")).distinct()
    return tok.join(names.select(F.col("name").alias("token")).distinct(), "token", "left_anti").select("id", "token")


def claims_of(text: Column, pattern: str) -> Column:
    """Sentences (cut after ``.`` or ``;`` and space) that match a pattern."""
    return F.filter(F.split(text, r"(?<=[.;])[ \t-\r]+"), lambda s: s.rlike(pattern))


def thin(components: Column, concrete: Column, knobs: Column) -> Column:
    """A note on components with neither concrete symbols nor knobs."""
    return (F.size(components) > 0) & (F.size(concrete) <= 0) & (F.size(knobs) <= 0)


def check_sheets(sheets: DataFrame, sources: DataFrame, edges: DataFrame, known: DataFrame, ids: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The report of each record (id, kind, expected, grounded, statement, n_symbols, n_properties, steps).

    ``steps`` is an array of (n, invokes, cites); properties cite through ``property_cites``.
    Per id: ungrounded and uncited, unknown and holes, shape messages, vacuous, ok. Holes,
    unknown invocations and notes never fail a record.
    """
    step = sheets.select("id", F.explode("steps").alias("s")).select("id", "s.n", "s.invokes", "s.cites")
    cites = step.select("id", F.explode("cites").alias("cite")).unionByName(sheets.select("id", F.explode("property_cites").alias("cite")))
    bad = ungrounded(cites, sources).groupBy("id").agg(F.array_sort(F.collect_list("cite")).alias("ungrounded"))
    invoked = step.select("id", F.explode("invokes").alias("item")).distinct()
    # Many steps invoke few items: each item meets the ids once, so no task gets all that invoke one.
    met = invoked.select("item").distinct().join(ids.select(F.col("id").alias("item")).distinct(), "item", "left_semi")
    met = small(Scratch(sheets.sparkSession, "sheets").save(met, "met"))
    unknown = invoked.join(met, "item", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("unknown"))
    resolved = invoked.join(met, "item", "left_semi")
    useful = resolved.where(~F.col("item").cast("string").isin(*UNINFORMATIVE)).groupBy("id").agg(F.count(F.lit(1)).alias("useful"))
    hole = holes(resolved, edges, known, labels).groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("holes"))
    s = sheets.join(bad, "id", "left").join(unknown, "id", "left").join(hole, "id", "left").join(useful, "id", "left")
    n_steps = F.coalesce(F.size("steps"), F.lit(0))
    uncited = F.transform(F.filter("steps", lambda x: F.size(x["cites"]) <= 0), lambda x: x["n"])
    shape = F.array_compact(
        F.array(
            F.when(F.col("kind").eqNullSafe("definition") & (F.coalesce(F.trim("statement"), F.lit("")) == ""), "no statement"),
            F.when(F.col("kind").eqNullSafe("definition") & (F.col("n_properties") == 0), "no properties"),
            F.when(F.col("kind").eqNullSafe("definition") & (n_steps > 0), "a definition has no steps"),
            F.when(F.col("kind").eqNullSafe("derivation") & (n_steps <= 0), "no steps"),
            F.when(F.col("n_symbols") == 0, "no symbols"),
            F.when(~F.col("kind").eqNullSafe(F.col("expected")) & ~(F.col("expected").eqNullSafe("derivation") & F.col("kind").eqNullSafe("definition")), "unexpected kind"),
        )
    )
    notes = F.when(F.col("expected").eqNullSafe("derivation") & F.col("kind").eqNullSafe("definition"), "no source derives it").otherwise("")
    s = s.withColumn("uncited", uncited).withColumn("shape", shape).withColumn("vacuous", (n_steps > 0) & (F.coalesce("useful", F.lit(0)) == 0))
    ok = F.col("ungrounded").isNull() & (F.size("uncited") <= 0) & (F.size("shape") == 0) & ~F.col("vacuous") & F.coalesce("grounded", F.lit(False))

    def joined(c):
        return F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)

    return s.select("id", joined("ungrounded"), F.array_join(F.transform("uncited", lambda n: n.cast("string")), ",").alias("uncited"), joined("unknown"), joined("holes"), F.array_join("shape", "; ").alias("shape"), notes.alias("notes"), "vacuous", ok.alias("ok"))


def recheck(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(id, changed, flipped, failing): reports of two checks, compared null-safely; rows that only one has are left alone."""
    b = before.select("id", F.struct(*columns).alias("b"), F.col("ok").alias("ok1"))
    a = after.select("id", F.struct(*columns).alias("a"), F.col("ok").alias("ok2"))
    j = b.join(a, "id")
    return j.select("id", (~F.col("b").eqNullSafe(F.col("a"))).alias("changed"), (~F.col("ok1").eqNullSafe(F.col("ok2"))).alias("flipped"), (~F.coalesce("ok2", F.lit(False))).alias("failing"))


def prune_reason(corrupt: Column, kind: Column, n_properties: Column, technique: Column, vacuous: Column, n_steps: Column, n_useful: Column) -> Column:
    """Why a record goes: the first of six reasons, null to keep it.

    ``technique`` says whether the record's node is one, ``vacuous`` what its check found,
    ``n_useful`` how many of its steps invoke something that identifies anything.
    """
    definition, derivation = kind.eqNullSafe("definition"), kind.eqNullSafe("derivation")
    tests = (
        corrupt,
        kind.isNull(),
        definition & (F.coalesce(n_properties, F.lit(0)) == 0),
        definition & F.coalesce(technique, F.lit(False)),
        F.coalesce(vacuous, F.lit(False)),
        derivation & (F.coalesce(n_steps, F.lit(0)) > 0) & (F.coalesce(n_useful, F.lit(0)) == 0),
    )
    out = F.lit(None).cast("string")
    for test, reason in reversed(list(zip(tests, PRUNE_REASONS))):
        out = F.when(test, reason).otherwise(out)
    return out


def useful_steps(steps: Column) -> Column:
    """How many steps (an array of structs with ``invokes``) invoke something that identifies anything."""
    return F.size(F.filter(steps, lambda s: F.size(F.filter(s["invokes"], lambda i: ~i.isin(*UNINFORMATIVE))) > 0))


def source_derives(sections: DataFrame, title: str = DERIVATION_TITLE, out_of_scope: str = OUT_OF_SCOPE_TITLE) -> DataFrame:
    """sections (id, title, body) -> (id, derives): any derivation section that is not mere definition."""
    own = sections.where(F.col("title").rlike(title) & ~F.col("title").rlike(out_of_scope))
    low = F.lower("body")
    defines, moves = F.regexp_count(low, F.lit(DEFINES)), F.regexp_count(low, F.lit(MOVES))
    yes = own.where(~((defines >= 2) & (defines > moves))).select("id").distinct().withColumn("derives", F.lit(True))
    return sections.select("id").distinct().join(yes, "id", "left").select("id", F.coalesce("derives", F.lit(False)).alias("derives"))


def expected_kind(nodes: DataFrame, edges: DataFrame, derives: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """nodes (id, type) -> (id, expected): techniques, nodes that require a technique and nodes whose source derives them are derivations.

    So is everything in ``asked`` (id) or ``derives`` (id, derives) that is no node: nothing says that it is less.
    """
    tech = nodes.where("type = 'technique'").select(F.col("id").alias("dst"))
    needs = edges.join(tech, "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("needs", F.lit(True))
    ids = derives.select("id") if asked is None else derives.select("id").unionByName(asked.select("id"))
    every = nodes.select("id", F.coalesce("type", F.lit("")).alias("type")).join(ids.distinct(), "id", "full_outer")
    j = every.join(needs, "id", "left").join(derives.groupBy("id").agg(F.max("derives").alias("derives")), "id", "left")
    yes = F.col("type").isNull() | (F.col("type") == "technique") | F.coalesce("needs", F.lit(False)) | F.coalesce("derives", F.lit(False))
    return j.select("id", F.when(yes, "derivation").otherwise("definition").alias("expected"))


def statement_suffices(nodes: DataFrame, edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """nodes (id, type, tier) -> (id, suffices): the graph alone asks only for a node's statement.

    It is no technique, requires none and its tier is not derivation; no source is read. What
    is in ``asked`` (id) and no node has no statement that would do.
    """
    structural = expected_kind(nodes, edges, nodes.select("id", F.lit(False).alias("derives")), asked)
    tiers = nodes.select("id", F.coalesce("tier", F.lit("")).alias("tier"))
    return structural.join(tiers, "id", "left").select("id", ((F.col("expected") == "definition") & (F.col("tier") != "derivation")).alias("suffices"))


def needs_better_sources(records: DataFrame, nodes: DataFrame, edges: DataFrame, derives: DataFrame | None = None) -> DataFrame:
    """records (id, kind, grounded) -> (id, needs): a derivation is expected and the sources did not carry it.

    The record is a definition, or no source grounds it. A node's own sources count for what
    is expected only where ``derives`` (id, derives) is given.
    """
    ids = records.select("id").distinct()
    said = ids.withColumn("derives", F.lit(False)) if derives is None else derives
    expected = expected_kind(nodes, edges, said, ids)
    short = F.col("kind").eqNullSafe("definition") | ~F.coalesce("grounded", F.lit(False))
    return records.join(expected, "id").select("id", ((F.col("expected") == "derivation") & short).alias("needs"))
