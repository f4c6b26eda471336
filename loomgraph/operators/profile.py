"""Reader-state operators: an event-sourced profile folded by aggregates.

Events are (user, node, ord, at, action, state) with action mark, deny, reopen or suspect.
A mark clears a denial; a weaker mark than the entry only clears suspicion, an equal or
stronger one replaces it. deny and reopen delete the entry, deny also sets the denial;
suspect flags an entry that is there. The fold has a closed form over the last reset, so
it needs no ordered group: strength is the strongest mark since the last reset, its time
that of the last such mark, suspicion and denial depend on which event came last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import reachability

STATES = ("declared", "read", "demonstrated")


def strength(state: Column) -> Column:
    out = F.lit(-1)
    for k, s in enumerate(STATES):
        out = F.when(state == s, k).otherwise(out)
    return out


def suspicions(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(user, node, ord, at): for each node that a user has marked, the user's last reopen below it.

    Only such a suspicion changes an entry: one without a mark has none to flag, and of several
    the last decides. The search is held in from both sides: it starts at the marked nodes,
    and among the nodes below them it takes the reopened ones upwards, 64 to a word. Users'
    reopened nodes are words as well, so a user's mark meets the reopens by one ``and`` per word.
    """
    marked = events.where("action = 'mark'").select("user", "node").dropna().distinct()
    again = events.where("action = 'reopen'").groupBy("user", "node").agg(F.max(F.struct("ord", "at")).alias("last")).dropna()
    below = reachability.reachable(edges, marked.select(F.col("node").alias("id")).distinct())
    inner = edges.join(below.select(F.col("id").alias("src")), "src", "left_semi")
    seeds = again.select(F.col("node").alias("id"), F.col("node").alias("reopened")).distinct()
    words, numbers = reachability.reaching(inner, seeds, "reopened", back=True, own=False)
    users = again.join(numbers.withColumnRenamed("reopened", "node"), "node")
    asked = reachability.packed(users, ["user"]).withColumnRenamed("word", "asked")
    met = marked.join(words.withColumnRenamed("id", "node"), "node").join(asked, ["user", "bucket"])
    hits = met.withColumn("word", F.col("word").bitwiseAND(F.col("asked"))).where("word <> 0").select("user", "node", "bucket", "word")
    cause = users.select("user", "bucket", "bit", "last")
    found = reachability.unpacked(hits).join(cause, ["user", "bucket", "bit"]).groupBy("user", "node").agg(F.max("last").alias("last"))
    return found.select("user", "node", "last.ord", "last.at")


def with_suspicions(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the suspect events that reopened nodes make of entries of what depends on them."""
    derived = suspicions(events, edges).select("user", "node", "ord", "at", F.lit("suspect").alias("action"), F.lit(None).cast("string").alias("state"))
    return events.select("user", "node", "ord", "at", "action", "state").unionByName(derived)


def fold(events: DataFrame) -> DataFrame:
    """(user, node, state, at, suspect, denied): the profile after all events."""
    w = Window.partitionBy("user", "node")
    action = F.col("action")
    e = events.withColumn("reset", F.max(F.when(action.isin("deny", "reopen"), F.col("ord"))).over(w))
    live = (action == "mark") & (F.col("reset").isNull() | (F.col("ord") > F.col("reset")))
    best = F.max(F.when(live, F.struct(strength(F.col("state")).alias("s"), F.col("ord"), F.col("at")))).alias("best")
    out = e.groupBy("user", "node").agg(
        best,
        F.max(F.when(live, F.col("ord"))).alias("last_mark"),
        F.max(F.when(action == "mark", F.col("ord"))).alias("any_mark"),
        F.max(F.when(action == "suspect", F.col("ord"))).alias("last_suspect"),
        F.max(F.when(action == "deny", F.col("ord"))).alias("last_deny"),
    )
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("best.s") + 1).cast("int"))
    suspect = F.col("best").isNotNull() & F.coalesce(F.col("last_suspect") > F.col("last_mark"), F.lit(False))
    denied = F.col("last_deny").isNotNull() & (F.col("any_mark").isNull() | (F.col("last_deny") > F.col("any_mark")))
    out = out.select("user", "node", F.when(F.col("best").isNotNull(), state).alias("state"), F.col("best.at").alias("at"), suspect.alias("suspect"), denied.alias("denied"))
    return out.where("state is not null or denied")


def known(profile: DataFrame, minimum: str = "declared", include_suspect: bool = False) -> DataFrame:
    """(user, node) of entries of a state or a stronger one, suspect ones left out unless asked for."""
    ok = strength(F.col("state")) >= STATES.index(minimum)
    return profile.where(ok & (F.lit(include_suspect) | ~F.col("suspect"))).select("user", "node")


def not_known(profile: DataFrame) -> DataFrame:
    return profile.where("denied").select("user", "node")


def stale(profile: DataFrame, now: str, days: int = 180) -> DataFrame:
    """(user, node, at) of entries strictly older than ``days`` before ``now``; unreadable times are skipped."""
    limit = F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))
    at = F.col("at") if dict(profile.dtypes)["at"].startswith("timestamp") else F.try_to_timestamp("at")
    return profile.where(F.col("state").isNotNull() & (at < limit)).select("user", "node", "at")


def weakest_first(profile: DataFrame) -> DataFrame:
    """Entries with their place per user: the weakest first, then the oldest."""
    w = Window.partitionBy("user").orderBy(strength(F.col("state")), "at", "node")
    return profile.where("state is not null").select("user", "node", "state", "at", F.row_number().over(w).alias("place"))
