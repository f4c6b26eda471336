"""Reader profiles kept per user in a stream: suspicions are made there, entries go stale by timers.

State of a user is a map from nodes to the last order numbers of what happened to them.
A reopened node makes suspect what depends on it, so each event carries what lies below its
node: a static table, packed 64 nodes to a word, that the stream is joined with. A mark
keeps its node's words in the state; a reopen is one bit to look up in the words of the
user's other nodes. Everything kept is a maximum, so late events and other batches give
the same entries. With a time limit, an event-time timer goes off when an entry has aged
that long and is still the one it was set for.

Without one, and where a reopened node has few dependents among the nodes that profiles may
hold, each reopen is handed on to those as a suspicion and the state is an aggregate of
maxima per user and node, by columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import reachability
from ..operators.profile import STATES
from ..sources.tables import Scratch
from . import events as plain

#: Sessions that run these queries need this state store.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

OUT = "user long, node long, state string, at string, suspect boolean, denied boolean, stale boolean"
_LAST = ["deny", "reopen", "suspect"]
_KEPT = ", ".join([*(f"{a} long" for a in _LAST), *(f"{s} long, {s}_at string" for s in STATES), "number long", "below binary"])
_FRESH = (-1, -1, -1, *[-1, None] * len(STATES), -1, None)
_NUMBER, _BELOW = len(_FRESH) - 2, len(_FRESH) - 1
#: Dependents of a node up to which its reopens are handed on as events.
HANDED = 64


def below(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (id) that profiles may hold -> (node, number, below): their numbers, and those of the nodes below them.

    ``below`` is an array of (bucket, word) structs; number is 64 * bucket + bit.
    """
    ids = nodes.select("id").distinct()
    inner = edges.join(reachability.reachable(edges, ids).select(F.col("id").alias("src")), "src", "left_semi")
    words, numbers = reachability.reaching(inner, ids.select("id", F.col("id").alias("label")), "label", back=True, own=False)
    lists = words.groupBy(F.col("id").alias("node")).agg(F.collect_list(F.struct(F.col("bucket").cast("long").alias("bucket"), "word")).alias("below"))
    numbered = numbers.select(F.col("label").alias("node"), (F.col("bucket") * reachability.WORD + F.col("bit")).cast("long").alias("number"))
    return numbered.join(lists, "node", "left")


def dependents(under: DataFrame, most: int | None = None) -> DataFrame | None:
    """``below(..)`` -> (node, above): the nodes that profiles may hold and that lead to each; nothing if one has over ``most``.

    Counts are by bits of the packed words, so the pairs are made only where they are few.
    """
    words = under.select("node", F.inline("below"))
    if most is not None:
        bits = words.groupBy("bucket").agg(F.array(*(F.sum(F.getbit("word", F.lit(k)).cast("long")) for k in range(reachability.WORD))).alias("n"))
        if not bits.where(F.array_max("n") > most).isEmpty():
            return None
    pairs = reachability.unpacked(words).select(F.col("node").alias("above"), (F.col("bucket") * reachability.WORD + F.col("bit")).alias("number"))
    return pairs.join(under.select("node", "number"), "number").groupBy("node").agg(F.collect_list("above").alias("above"))


def _handed_on(events: DataFrame, above: DataFrame) -> DataFrame:
    """Entries of the events and of the suspicions that reopens make, a streaming aggregate."""
    joined = events.join(above, "node", "left")
    handed = F.when(F.col("action") == "reopen", F.transform("above", lambda a: F.struct(a.alias("node"), F.lit("suspect").alias("action"))))
    own = F.array(F.struct("node", "action"))
    each = joined.select("user", "ord", "at", "state", F.explode(F.concat(own, F.coalesce(handed, F.slice(own, 1, 0)))).alias("e"))
    entries = plain.profiles(each.select("user", "e.node", "ord", "at", "e.action", "state"))
    return entries.select("user", "node", "state", "at", "suspect", "denied", F.lit(False).alias("stale"))


def _holds(packed: bytes | None, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers the packed (bucket, word) pairs hold."""
    if not packed:
        return np.zeros(len(numbers), bool)
    pairs = np.frombuffer(packed, np.int64).reshape(-1, 2)
    at = np.searchsorted(pairs[:, 0], numbers // 64)
    at[at == len(pairs)] = 0
    return (pairs[at, 0] == numbers // 64) & ((pairs[at, 1].view(np.uint64) >> (numbers % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _packed(words) -> bytes | None:
    if words is None or not len(words):
        return None
    pairs = np.array([(w["bucket"], w["word"]) for w in words], np.int64)
    return pairs[np.argsort(pairs[:, 0])].tobytes()


class Profile(StatefulProcessor):
    """Entries of one user; ``days`` is the age at which they go stale, nothing for never."""

    def __init__(self, days: int | None):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getMapState("nodes", "node long", _KEPT)

    def _entry(self, user: int, node: int, rec: tuple, reopened: tuple[np.ndarray, np.ndarray], stale: bool = False) -> tuple:
        deny, reopen, suspect, *marks = rec[:_NUMBER]
        orders, ats = marks[::2], marks[1::2]
        live = [s for s, o in enumerate(orders) if o > max(deny, reopen)]
        denied = deny > max(orders)
        if not live:
            return (user, node, None, None, False, denied, stale)
        numbers, when = reopened
        met = when[_holds(rec[_BELOW], numbers)]
        last = max(suspect, int(met.max()) if len(met) else -1)
        return (user, node, STATES[live[-1]], ats[live[-1]], last > max(orders[s] for s in live), denied, stale)

    @staticmethod
    def _reopened(every: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the user's reopened nodes, and when they were last."""
        found = [(r[_NUMBER], r[1]) for r in every.values() if r[1] >= 0 and r[_NUMBER] >= 0]
        return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _all(self) -> dict[int, tuple]:
        return {k[0]: tuple(v) for k, v in self.nodes.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        user, every = int(key[0]), self._all()
        touched, again = set(), False
        for part in rows:
            for r in part.itertuples():
                node = int(r.node)
                rec = list(every.get(node, _FRESH))
                if rec[_NUMBER] < 0 and not pd.isna(r.number):
                    rec[_NUMBER], rec[_BELOW] = int(r.number), _packed(r.below)
                if r.action == "mark":
                    k = len(_LAST) + 2 * STATES.index(r.state)
                    if r.ord > rec[k]:
                        rec[k : k + 2] = int(r.ord), r.at
                elif r.action in _LAST:
                    k = _LAST.index(r.action)
                    rec[k] = max(rec[k], int(r.ord))
                    again = again or r.action == "reopen"
                every[node] = tuple(rec)
                touched.add(node)
        for node in touched:
            self.nodes.updateValue((node,), every[node])
        reopened = self._reopened(every)
        out = [self._entry(user, n, every[n], reopened) for n in (every if again else touched)]
        if self.days is not None:
            for e in out:
                if e[2] is not None and e[1] in touched:
                    due = self._due(e[3])
                    if due > timerValues.getCurrentWatermarkInMs():
                        self.handle.registerTimer(due)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def _due(self, at: str) -> int:
        return int((pd.Timestamp(at, tz="UTC") + pd.Timedelta(days=self.days)).timestamp() * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        every, now = self._all(), expiredTimerInfo.getExpiryTimeInMs()
        reopened = self._reopened(every)
        entries = [self._entry(int(key[0]), n, rec, reopened, stale=True) for n, rec in every.items()]
        due = [e for e in entries if e[2] is not None and self._due(e[3]) == now]
        if due:
            yield pd.DataFrame(due, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def profiles(events: DataFrame, under: DataFrame, days: int | None = None, late: str = "1 day") -> DataFrame:
    """Events (user, node, ord, at, action, state) and ``below(..)`` -> entries whenever they change.

    ``ord`` is 0 or more. With ``days``, events need a timestamp column ``ts``; an entry that is
    older than so many days by the watermark (``late`` behind the latest event) comes again
    with ``stale`` true. Events that are later than that are dropped by the stream then.
    """
    if days is None:
        under = Scratch(under.sparkSession, "under").save(under, "under")
        above = dependents(under, HANDED)
        if above is not None:
            return _handed_on(events, above)
    joined = events.join(under, "node", "left")
    columns = ["user", "node", "ord", "at", "action", "state", "number", "below"]
    if days is not None:
        joined = joined.withWatermark("ts", late)
        columns.append("ts")
    grouped = joined.select(*columns).groupBy("user")
    return grouped.transformWithStateInPandas(Profile(days), OUT, "update", "none" if days is None else "eventTime")
