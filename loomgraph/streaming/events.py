"""Structured Streaming forms of the state operators, and windowed event counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.profile import STATES
from ..sources.tables import Scratch

_KINDS = ("deny", "reopen", "suspect")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream; ``path`` may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    frame = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    zoneless = [c for c, kind in frame.dtypes if kind == "timestamp_ntz"]  # watermarks need instants
    return frame.withColumns({c: frame[c].cast("timestamp") for c in zoneless})


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per tumbling window, under a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) per session of a user."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fold_profile(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes the events of one (user, node) into its state, in whatever order they come.

    The state holds the last ``ord`` of each kind of event and of a mark of each strength
    (-1 for none yet), so a late event changes an entry just as it would have in its place,
    and the entries are those of ``operators.profile.fold`` over the same events.
    """
    last = list(state.get) if state.exists else [-1, -1, -1, *[-1, None] * len(STATES)]
    for part in parts:
        for r in part.itertuples():
            if r.action == "mark":
                k = 3 + 2 * STATES.index(r.state)
                if r.ord > last[k]:
                    last[k : k + 2] = int(r.ord), r.at
            elif r.action in _KINDS:
                k = _KINDS.index(r.action)
                last[k] = max(last[k], int(r.ord))
    state.update(tuple(last))
    deny, reopen, suspect, marks = *last[:3], last[3::2]
    live = [s for s, o in enumerate(marks) if o > max(deny, reopen)]
    entry = {"user": key[0], "node": key[1], "state": None, "at": None, "suspect": False, "denied": deny > max(marks), "upto": max(deny, reopen, suspect, *marks)}
    if live:
        entry |= {"state": STATES[live[-1]], "at": last[4 + 2 * live[-1]], "suspect": suspect > max(marks[s] for s in live)}
    yield pd.DataFrame([entry])


def profiles(events: DataFrame) -> DataFrame:
    """Events (user, node, ord, at, action, state) -> updated entries, the state kept per (user, node).

    ``ord`` is 0 or more. Suspicions are events of their own, as ``with_suspicions`` derives
    them. All that ``fold_profile`` keeps is the last of something, so the state is an
    aggregate of maxima, by columns alone.
    """
    def last(of, when):
        return F.max(F.when(when, of))

    kinds = [F.coalesce(last(F.col("ord"), F.col("action") == a), F.lit(-1).cast("long")).alias(f"_{a}") for a in _KINDS]
    marks = [last(F.struct("ord", "at"), (F.col("action") == "mark") & (F.col("state") == s)).alias(f"_{s}") for s in STATES]
    kept = events.groupBy("user", "node").agg(*kinds, *marks)
    order = {s: F.coalesce(F.col(f"_{s}.ord"), F.lit(-1).cast("long")) for s in STATES}
    marked, ended = F.greatest(*order.values()), F.greatest("_deny", "_reopen")
    state, at = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in STATES:  # the strongest that is live
        state = F.when(order[s] > ended, s).otherwise(state)
        at = F.when(order[s] > ended, F.col(f"_{s}.at")).otherwise(at)
    suspect = (marked > ended) & (F.col("_suspect") > marked)
    every = F.greatest("_deny", "_reopen", "_suspect", *order.values())
    return kept.select("user", "node", state.alias("state"), at.alias("at"), suspect.alias("suspect"), (F.col("_deny") > marked).alias("denied"), every.alias("upto"))


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str] | None):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(frame: DataFrame, mode: str, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a streaming query over what is there and returns what it wrote, under settings that it needs.

    Each micro-batch goes to a folder of its own, so a batch done twice overwrites itself;
    in complete mode the last batch is the result.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, f"stream-{name}")
    last = [-1]

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(scratch.path(f"out/{number}"))
        last[0] = max(last[0], number)

    with settings(spark, conf):
        q = frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], frame.schema)
    if mode == "complete":
        return spark.read.parquet(scratch.path(f"out/{last[0]}")).drop("_batch")
    return spark.read.parquet(*[scratch.path(f"out/{k}") for k in range(last[0] + 1)])
