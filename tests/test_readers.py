"""Reader profiles in a stream: the batch fold's entries whatever the batches, and timers of staleness."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import profile as p
from loomgraph.streaming import events as s
from loomgraph.streaming import readers

EVENTS = "user long, node long, ord long, at string, action string, state string"


def stream_of(spark, folder, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_suspicions_whatever_the_batches(spark, tmp_path):
    rng = random.Random(11)
    edges = spark.createDataFrame(sorted({(rng.randrange(5, 90), rng.randrange(0, 60)) for _ in range(160)} | {(3, 80), (80, 3)}), "src long, dst long").where("src <> dst")
    rows = [(rng.randrange(4), rng.randrange(90), k, f"2024-01-{1 + k // 30:02d}", *rng.choice([("mark", "declared"), ("mark", "read"), ("mark", "demonstrated"), ("reopen", None), ("deny", None), ("suspect", None)])) for k in range(700)]
    want = {(r.user, r.node): (r.state, r.at, r.suspect, r.denied) for r in p.fold(p.with_suspicions(spark.createDataFrame(rows, EVENTS), edges)).collect()}
    assert sum(v[2] for v in want.values()) > 30
    under = readers.below(edges, spark.range(90))
    rng.shuffle(rows)  # late events, too
    parts = [rows[k : k + 180] for k in range(0, 700, 180)]
    out = s.run_to_table(readers.profiles(stream_of(spark, tmp_path / "e", parts, EVENTS), under), "update", "test", readers.ROCKSDB)
    last = out.groupBy("user", "node").agg(F.max_by(F.struct("state", "at", "suspect", "denied"), "_batch").alias("v")).select("user", "node", "v.*")
    assert out.select("_batch").distinct().count() == 4
    assert {(r.user, r.node): (r.state, r.at, r.suspect, r.denied) for r in last.collect() if r.state or r.denied} == want


def test_few_dependents_get_suspicions_without_python(spark, tmp_path):
    rng = random.Random(13)
    edges = spark.createDataFrame(sorted({(rng.randrange(5, 90), rng.randrange(0, 60)) for _ in range(110)} | {(3, 80), (80, 3)}), "src long, dst long").where("src <> dst")
    rows = [(rng.randrange(3), rng.randrange(95), k, f"2024-01-{1 + k // 30:02d}", *rng.choice([("mark", "read"), ("mark", "demonstrated"), ("reopen", None), ("deny", None), ("suspect", None)])) for k in range(500)]
    want = {(r.user, r.node): (r.state, r.at, r.suspect, r.denied) for r in p.fold(p.with_suspicions(spark.createDataFrame(rows, EVENTS), edges)).collect()}
    assert sum(v[2] for v in want.values()) > 20
    rng.shuffle(rows)  # late events, too
    entries = readers.profiles(stream_of(spark, tmp_path / "e", [rows[:200], rows[200:350], rows[350:]], EVENTS), readers.below(edges, spark.range(90)))
    assert "InPandas" not in entries._jdf.queryExecution().analyzed().toString()
    out = s.run_to_table(entries, "update", "test", readers.ROCKSDB)
    last = out.groupBy("user", "node").agg(F.max_by(F.struct("state", "at", "suspect", "denied"), "_batch").alias("v")).select("user", "node", "v.*")
    assert {(r.user, r.node): (r.state, r.at, r.suspect, r.denied) for r in last.collect() if r.state or r.denied} == want


def test_profile_stream_is_an_aggregate_whatever_the_batches(spark, tmp_path):
    rng = random.Random(12)
    rows = [(rng.randrange(3), rng.randrange(8), k, f"2024-01-{1 + k // 10:02d}", *rng.choice([("mark", "declared"), ("mark", "read"), ("mark", "demonstrated"), ("reopen", None), ("deny", None), ("suspect", None)])) for k in range(200)]
    want = {(r.user, r.node, r.state, r.at, r.suspect, r.denied) for r in p.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    rng.shuffle(rows)  # late events, too
    entries = s.profiles(stream_of(spark, tmp_path / "e", [rows[:80], rows[80:150], rows[150:]], EVENTS))
    assert "InPandas" not in entries._jdf.queryExecution().analyzed().toString()
    out = s.run_to_table(entries, "update", "test", readers.ROCKSDB)
    last = out.groupBy("user", "node").agg(F.max_by(F.struct("state", "at", "suspect", "denied"), "_batch").alias("v")).select("user", "node", "v.*")
    assert out.select("_batch").distinct().count() == 3
    assert {tuple(r) for r in last.collect() if r.state or r.denied} == want


def test_entries_go_stale_by_timers(spark, tmp_path):
    schema = EVENTS + ", ts timestamp"

    def event(day, node, action="mark", state="read"):
        import datetime

        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)
        return (1, node, day * 10 + node % 10, at.strftime("%Y-%m-%d %H:%M:%S"), action, state if action == "mark" else None, at)

    parts = [[event(0, 1), event(0, 2), event(1, 3)], [event(8, 2)], [event(9, 3, "deny"), event(12, 4)], [event(30, 5)], [event(31, 5)]]
    under = readers.below(spark.createDataFrame([], "src long, dst long"), spark.range(9))
    out = s.run_to_table(readers.profiles(stream_of(spark, tmp_path / "e", parts, schema), under, days=10), "update", "test", readers.ROCKSDB)
    stale = {(r.node, r.at[:10]) for r in out.where("stale").collect()}
    # Node 1 ages, node 2 counts from its second mark, node 3 is denied before it is old, node 5 is young.
    assert stale == {(1, "2024-01-01"), (2, "2024-01-09"), (4, "2024-01-13")}
