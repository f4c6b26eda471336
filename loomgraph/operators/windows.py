"""Aggregations and window-shaped operators."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fixed import DERIVATION_HEADING, DERIVATION_MARKERS, DISAMBIGUATION_PHRASES, HEADING_BONUS
from ..sources.tables import Scratch, running_total

_HEADING = re.compile(DERIVATION_HEADING)


def capped(rows: DataFrame, by: str, order: list, cap: int = 5) -> DataFrame:
    """The first ``cap`` rows of each ``by`` in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def distinct_in_order(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """(by, key, place): distinct keys of each group, numbered by their first occurrence."""
    first = rows.groupBy(*by, key).agg(F.min(order).alias("_at"))
    return first.select(*by, key, F.row_number().over(Window.partitionBy(*by).orderBy("_at")).alias("place"))


def reuse(items: DataFrame) -> DataFrame:
    """(item, seeds): seeds (seed, item) that hold each item, distinct within a seed."""
    return items.select("seed", "item").distinct().groupBy("item").agg(F.count(F.lit(1)).alias("seeds"))


def saturation(items: DataFrame) -> DataFrame:
    """(pos, canon_size, added, added_pct): distinct items of seeds at positions up to each.

    Each item counts at its first position; that leaves one row per position before the
    running sum.
    """
    first = items.groupBy("item").agg(F.min("pos").alias("pos"))
    added = items.select("pos").distinct().join(first.groupBy("pos").agg(F.count(F.lit(1)).alias("added")), "pos", "left").select("pos", F.coalesce("added", F.lit(0)).alias("added"))
    out = running_total(added, "pos", "added", "canon_size").select("pos", "canon_size", "added")
    return out.withColumn("added_pct", t.added_percent(F.col("canon_size"), F.col("added")))


def mean_curve(items: DataFrame, trials: int = 500, seed: int = 7) -> DataFrame:
    """(k, mean_size): canon size after k seeds, averaged over shuffled orders of the seeds.

    A trial's order is that of a hash of the trial and the seed's name, so the orders are
    made where the rows are and are the same on every cluster. Items that the same seeds hold
    come at the same places, so each trial takes one of them and counts all: a kind of items
    is known by the number of its seeds and two 64-bit sums of their hashes.
    """
    each = items.select("seed").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    drawn = F.md5(F.concat_ws(":", F.lit(seed), "trial", F.col("seed").cast("string")))
    orders = each.withColumn("k", F.row_number().over(Window.partitionBy("trial").orderBy(drawn, "seed")))
    held = Scratch(items.sparkSession, "curve").save(items.where("seed is not null").select("seed", "item").distinct(), "held")
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("seed")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "seed")).alias("b")]
    kinds = held.groupBy("item").agg(*marks).groupBy("n", "a", "b").agg(F.min("item").alias("one"), F.count(F.lit(1)).alias("items"))
    few = held.join(kinds, F.col("item").eqNullSafe(F.col("one"))).select("seed", "item", "items")
    first = orders.join(few, "seed").groupBy("trial", "item", "items").agg(F.min("k").alias("k"))
    added = first.groupBy("trial", "k").agg(F.sum("items").alias("added"))
    full = orders.select("trial", "k").join(added, ["trial", "k"], "left").na.fill(0, ["added"])
    size = F.sum("added").over(Window.partitionBy("trial").orderBy("k"))
    return full.select("trial", "k", size.alias("size")).groupBy("k").agg(F.avg("size").alias("mean_size"))


def state_rollup(rows: DataFrame, kind: str, state: str) -> DataFrame:
    """(kind, state, n): counts by state and by kind and state; kind is null for the former."""
    fine = rows.groupBy(kind, state).agg(F.count(F.lit(1)).alias("n"))
    return fine.unionByName(fine.groupBy(state).agg(F.sum("n").alias("n")).withColumn(kind, F.lit(None).cast(dict(rows.dtypes)[kind])))


def corroborated(uses: DataFrame) -> DataFrame:
    """(name, n, users): names with their distinct users, those with more than one."""
    g = uses.select("name", "user").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("user")).alias("users"))
    return g.where("n > 1").select("name", "n", F.array_join("users", ",").alias("users"))


def grounding_states(nodes: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """nodes (id), sources (id, source, ord, n_chars, kind, error), aliases (id, titles) -> (id, state, best).

    known_absent for an empty alias list; error where retrieval failed; grounded with any
    substantive source, best the first of them; else ungrounded.
    """
    good = substantive(F.col("n_chars"), F.col("kind"))
    s = sources.groupBy("id").agg(F.max(F.coalesce(F.col("error"), F.lit(False))).alias("error"), F.min(F.when(good, F.struct("ord", "source"))).alias("b"))
    j = nodes.select("id").join(s, "id", "left").join(aliases.select("id", F.size("titles").alias("titles")), "id", "left")
    state = F.when(F.col("titles") == 0, "known_absent").when(F.col("b").isNotNull(), "grounded").when(F.col("error"), "error").otherwise("ungrounded")
    return j.select("id", state.alias("state"), F.col("b.source").alias("best"))


def substantive(n_chars: Column, kind: Column) -> Column:
    """1200 characters or more, 350 for derived sources."""
    return n_chars >= F.when(kind.eqNullSafe("derived"), 350).otherwise(1200)


def disambiguation(text: Column, flag: Column) -> Column:
    """A flagged page, or a short one whose first 400 characters say that it may refer to several things."""
    head = F.lower(F.substring(text, 1, 400))
    phrase = head.contains(DISAMBIGUATION_PHRASES[0])
    for p in DISAMBIGUATION_PHRASES[1:]:
        phrase = phrase | head.contains(p)
    return F.coalesce(flag, F.lit(False)) | ((F.length(text) < 6000) & phrase)


def passages(docs: DataFrame, terms: list[str], limit: int = 4, min_hits: int = 1, min_chars: int = 80) -> DataFrame:
    """docs (doc, text) -> (doc, place, pos, hits, occurrences, passage): best paragraphs by terms.

    A paragraph is a stripped line of ``min_chars`` or more; distinct terms count first,
    then occurrences (as substrings of the lower-case text), then the earlier place.
    Without terms there is no passage.
    """
    p = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "passage")).withColumn("passage", t.strip(F.col("passage"))).where(F.length("passage") >= min_chars)
    low = F.lower("passage")
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in terms]
    hits = sum((F.when(c > 0, 1).otherwise(0) for c in counts), F.lit(0))
    total = sum(counts, F.lit(0)).cast("int")
    scored = p.withColumn("hits", hits).withColumn("occurrences", total).where((F.col("hits") >= min_hits) & F.lit(bool(terms)))
    best = Window.partitionBy("doc").orderBy(F.desc("hits"), F.desc("occurrences"), "pos")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("doc", "place", "pos", "hits", "occurrences", "passage")


def best_region(text: str | None, markers: tuple[str, ...], budget: int) -> tuple[int, int, int, bool]:
    """(first, last, score, headed) for one text; see ``best_window``."""
    text = text or ""
    low_marks = tuple(markers)

    def score(p):
        low = p.lower()
        bonus = HEADING_BONUS if "=" in p and _HEADING.match(p) else 0
        return sum(3 for m in low_marks if m in low) + p.count("=") + p.count("\\") + bonus

    parts = text.split("\n")
    if len(text) <= budget:
        return 1, len(parts), sum(map(score, parts)), False
    parts = [p for p in parts if p.strip()]
    if not parts:
        return 1, 1, 0, False
    room = max(budget - len("\n".join(parts[:2])), budget // 2)
    size = [len(p) for p in parts]
    gain = [score(p) for p in parts]
    best, end, used, total = (-1, 0, 1), 0, 0, 0
    for start in range(len(parts)):
        if end < start:  # nothing fitted from the start before
            end, used, total = start, 0, 0
        while end < len(parts) and used + size[end] <= room:
            used += size[end] + 1
            total += gain[end]
            end += 1
        if end > start:
            if total > best[0]:
                best = (total, start, end)
            used -= size[start] + 1
            total -= gain[start]
    return best[1] + 1, best[2], max(best[0], 0), best[1] > 2


def best_window(docs: DataFrame, markers: tuple[str, ...] = DERIVATION_MARKERS, budget: int = 24_000) -> DataFrame:
    """docs (doc, text) -> (doc, first, last, score, headed): the best contiguous paragraphs within a budget.

    Texts within the budget are one window of everything. Otherwise blank paragraphs go,
    the window's own budget is what the first two paragraphs leave, half of all at least, and
    from each start the window grows while the paragraph fits, at a cost of its length and
    one. A paragraph scores for markers, signs of formulas and, by far most, as the heading
    of a derivation. Highest total wins, the earliest start on ties; if none fits, the first
    paragraph. ``headed`` says that the window starts after the third paragraph, so that the
    first two go before it. Two ends move over a text's paragraphs, so work is linear.
    """

    @F.pandas_udf("first int, last int, score long, headed boolean")
    def region(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_region(x, tuple(markers), budget) for x in texts], columns=["first", "last", "score", "headed"])

    return docs.select("doc", region("text").alias("b")).select("doc", "b.first", "b.last", "b.score", "b.headed")


def budget_take(rows: DataFrame, by: str, order: str, cost: Column, budget: int) -> DataFrame:
    """Rows of each group in order up to the first that overflows the budget (none after it)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_spent", F.sum(cost).over(w)).where(F.col("_spent") <= budget).drop("_spent")


def extents(headings: DataFrame) -> DataFrame:
    """headings (doc, pos, level) -> with ``stop``: the next heading of the same or a higher rank, null at the end.

    Read from the end, the nearest heading of each rank or above is the last one seen, so the
    six windows share one sort and grow by a row at a time: work is linear in a document's headings.
    """
    later = Window.partitionBy("doc").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, -1)
    nearest = {k: F.last(F.when(F.col("level") <= k, F.col("pos")), ignorenulls=True).over(later) for k in range(1, 7)}
    stop = F.lit(None).cast("long")
    for k, at in nearest.items():
        stop = F.when(F.col("level") == k, at).otherwise(stop)
    return headings.withColumn("stop", stop)


def carry_forward(rows: DataFrame, by: str, order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row of a group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


#: A bare key at the left edge, and a name with a value, in lines without comments.
_SCOPE, _VALUE = r"^([A-Za-z_/*\"'][^:\s]*)\s*:$", r"^\s*([A-Za-z_][\w/]*)\s*:\s*(\S.*)$"


def folded_values(lines: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """lines (doc, ln, text) of YAML-like files -> (doc, ln, scope, name, value): their parameters.

    What follows a number sign goes, and so do blank lines. A value with more opening than
    closing brackets takes the lines after it until they are closed, joined by spaces; a bare
    key at the left edge outside such a value is the scope of what follows.

    Gaps and islands over a running depth: the sum of the lines' brackets less its least
    value so far is the depth of what is open, since a depth under zero starts again at zero.
    A line that opens brackets without being a value counts only inside an open one. Which
    do is found from below: at first none, then those with something open before them, until
    no more are found; each round is two windows per document.
    """
    from ..sources.tables import Scratch

    scratch = Scratch(lines.sparkSession, "folded")
    text = F.rtrim(F.substring_index("text", "#", 1), F.lit(t.BLANKS))
    kept = lines.select("doc", "ln", text.alias("text")).where(t.strip(text) != "")
    scope, name, value = F.regexp_extract("text", _SCOPE, 1), F.regexp_extract("text", _VALUE, 1), F.regexp_extract("text", _VALUE, 2)
    opens = F.length(F.translate("text", "]", "")) - F.length(F.translate("text", "[]", ""))
    closes = F.length(F.translate("text", "[", "")) - F.length(F.translate("text", "[]", ""))
    rows = kept.select("doc", "ln", "text", scope.alias("scope"), name.alias("name"), value.alias("value"), (opens - closes).alias("step"))
    rows = rows.withColumn("name", F.when(F.col("value").isin("", "|", ">"), "").otherwise(F.col("name")))
    rows = scratch.save(rows.withColumn("counts", (F.col("name") != "") | (F.col("step") <= 0)), "r0")
    up = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc").orderBy("ln")
    for k in range(1, max_rounds):
        total = rows.withColumn("sum", F.sum(F.when(F.col("counts"), F.col("step")).otherwise(0)).over(up))
        depth = total.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(up)))
        inside = depth.withColumn("inside", F.coalesce(F.lag("depth").over(before) > 0, F.lit(False)))
        rows = scratch.save(inside.withColumn("fresh", ~F.col("counts") & F.col("inside")).withColumn("counts", F.col("counts") | F.col("inside")).drop("sum", "depth"), f"r{k}")
        if rows.where("fresh").isEmpty():
            break
        rows = rows.drop("inside", "fresh")
    outside = ~F.col("inside")
    head = outside & (F.col("name") != "") & (F.col("scope") == "")
    marked = rows.withColumn("island", F.last(F.when(outside, F.col("ln")), ignorenulls=True).over(up))
    marked = marked.withColumn("under", F.coalesce(F.last(F.when(outside & (F.col("scope") != ""), F.col("scope")), ignorenulls=True).over(up), F.lit("")))
    lines_of_value = F.array_sort(F.collect_list(F.struct("ln", F.when(outside, F.col("value")).otherwise(t.strip(F.col("text"))).alias("part"))))
    islands = marked.groupBy("doc", F.col("island").alias("ln")).agg(F.max(F.when(head, F.struct("under", "name"))).alias("head"), lines_of_value.alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["part"]), " ")
    bare = F.regexp_replace("head.under", "^[\"']+|[\"']+$", "")
    return islands.where("head is not null").select("doc", "ln", bare.alias("scope"), "head.name", whole.alias("value"))


def round_robin(rows: DataFrame, by: str, kind: str, order: str, limit: int = 6) -> DataFrame:
    """One row per kind and round, kinds by first occurrence, ``limit`` rows of each group."""
    r = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by, kind).orderBy(order))).withColumn("_first", F.min(order).over(Window.partitionBy(by, kind)))
    return r.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_rn", "_first", order))).where(F.col("place") <= limit).drop("_rn", "_first")


def unique_tokens(items: DataFrame) -> DataFrame:
    """items (doc, item, text) -> (doc, item, n, tokens): content tokens that no other item of the doc has."""
    tok = items.select("doc", "item", F.explode(t.content_tokens(F.col("text"))).alias("token")).distinct()
    alone = tok.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("k"), F.min("item").alias("item")).where("k = 1")
    return alone.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("token")), " ").alias("tokens"))


def rank_masks(unique: DataFrame, minimum: int = 2) -> DataFrame:
    """Maskable items by number of unique tokens; of equal ones the later item first."""
    w = Window.partitionBy("doc").orderBy(F.desc("n"), F.desc("item"))
    return unique.where(F.col("n") >= minimum).select("doc", "item", "n", F.row_number().over(w).alias("place"))


def forward_leaks(steps: DataFrame) -> DataFrame:
    """steps (doc, n, text) -> (doc, n, leak): later steps that name an earlier one as "step N", the word on its own, with or without space."""
    named = steps.select("doc", F.col("n").alias("leak"), F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\bstep\s*([0-9]+)\b"), F.lit(1))).alias("named"))
    refs = named.select("doc", "leak", F.try_to_number(F.regexp_replace("named", "^0+(?=.)", ""), F.lit("999999999")).cast("int").alias("n")).distinct()
    return steps.select("doc", "n").join(refs, ["doc", "n"]).where("leak > n")


def consumers(edges: DataFrame, nodes: DataFrame, limit: int = 6) -> DataFrame:
    """(id, consumer, place): nodes that require each node, algorithms first, then by id."""
    e = edges.select(F.col("dst").alias("id"), F.col("src").alias("consumer")).distinct().join(nodes.select(F.col("id").alias("consumer"), "type"), "consumer")
    w = Window.partitionBy("id").orderBy(F.when(F.col("type") == "algorithm", 0).otherwise(1), "consumer")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("id", "consumer", "place")


def common_prefix(names: Column) -> Column:
    """The longest common prefix of an array of strings."""
    def shorter(a, b):
        n = F.least(F.length(a), F.length(b))
        same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
        return F.substring(a, F.lit(1), F.element_at(same, -1))

    return F.aggregate(names, F.element_at(names, 1), shorter)


def growth(curve: DataFrame, limit: float = 5.0) -> DataFrame:
    """saturation rows with the previous size and whether growth fell under ``limit`` per cent."""
    before = F.nullif(F.col("canon_size") - F.col("added"), F.lit(0))
    return curve.select("pos", "canon_size", before.alias("before"), (F.col("added_pct") < limit).alias("flat"))
