"""Keyed tables: buckets, atomic merges, conflicts and clean-up."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import keyed


def rows_of(table):
    return {r["k"]: r["v"] for r in table.read().collect()}


def files_below(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merging_many_keys(spark, tmp_path):
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k")
    every = spark.range(100_000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    assert table.merge(every) == 1 and len(files_below(tmp_path)) == 64
    before = files_below(tmp_path)
    assert table.merge(spark.createDataFrame([(7, 1), (200_000, 1)], "k long, v int"), drop=spark.createDataFrame([(8,)], "k long")) == 2
    new = files_below(tmp_path) - before
    assert 1 <= len(new) <= 3  # only the buckets that the three keys fall into
    got = rows_of(table)
    assert len(got) == 100_000 and got[7] == 1 and got[200_000] == 1 and 8 not in got and got[9] == 0
    assert rows_of(keyed.KeyedTable(spark, f"file://{tmp_path}/t", "k", buckets=3)) == got  # as it was made
    assert table.read(1).count() == 100_000 and {r["v"] for r in table.read(1).collect()} == {0}
    assert {tuple(r) for r in table.lookup(spark.createDataFrame([(7,), (8,), (-1,)], "k long")).collect()} == {(7, 1)}
    assert table.vacuum() == 0  # the first merge's files are still named for most buckets
    table.merge(every.withColumn("v", F.lit(5)))
    assert table.vacuum() == 2 and len(files_below(tmp_path)) <= 64 and table.read().where("v <> 5").count() == 1


def test_a_killed_writer_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    table.merge(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int"))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.merge(spark.createDataFrame([("a", 9)], "k string, v int"))
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2), ("b", 3)] and table.version() == 1
    table.merge(spark.createDataFrame([("b", 4)], "k string, v int"))
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 4)]
    assert table.vacuum() >= 1 and rows_of(table) == {"a": 1, "b": 4}


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    one, two = (keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 4) for _ in range(2))
    one.merge(spark.createDataFrame([("a", 1)], "k string, v int"))
    commit = keyed.KeyedTable._commit

    def slow(self, version, manifest):
        with monkeypatch.context() as m:
            m.setattr(keyed.KeyedTable, "_commit", commit)
            one.merge(spark.createDataFrame([("b", 2)], "k string, v int"))
        commit(self, version, manifest)

    with monkeypatch.context() as m:
        m.setattr(keyed.KeyedTable, "_commit", slow)
        with pytest.raises(keyed.ConflictError):
            two.merge(spark.createDataFrame([("c", 3)], "k string, v int"))
    assert rows_of(two) == {"a": 1, "b": 2} and two.version() == 2
    assert two.merge(spark.createDataFrame([("c", 3)], "k string, v int")) == 3 and rows_of(one) == {"a": 1, "b": 2, "c": 3}


def test_empty_merges_and_resumed_work(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k", 4)
    with pytest.raises(FileNotFoundError):
        table.read()
    none = spark.createDataFrame([], "k string, v int")
    assert table.merge(none) == 1 and table.merge(none) == 1 and table.read().count() == 0
    done = []

    def work(todo):
        done.append(sorted(r["k"] for r in todo.collect()))
        return todo

    rows = spark.createDataFrame([("a", 1), (None, 0)], "k string, v int").where("k is not null")
    assert table.resume(rows, work) == 1 and table.resume(rows.unionByName(spark.createDataFrame([("c", 3)], "k string, v int")), work) == 1
    assert table.resume(rows, work) == 0 and done == [["a"], ["c"]] and rows_of(table) == {"a": 1, "c": 3}
