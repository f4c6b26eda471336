"""Table access and durable scratch tables.

Intermediate results that must not be recomputed (or whose lineage has to be cut) are
written as Parquet below the folder named by ``spark.checkpoint.dir``, which every
executor shares. An executor can then be lost without losing them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else the context's; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Named Parquet tables of one operator call in the shared folder.

    ``save`` writes a frame and returns it as read back; ``drop`` removes a table that
    nothing reads any more. Tables that the returned lazy result still reads stay.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomgraph/{owner}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str, width: int | None = None) -> DataFrame:
        """Writes a table, in at most ``width`` tasks and files where that is given."""
        path = self.path(name)
        if width is not None:
            frame = frame.coalesce(width)
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Removes all tables of this call but the named ones."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(root):
            if status.getPath().getName() not in names:
                system.delete(status.getPath(), True)


def unused(frame: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``frame`` has it in any case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def width_for(rows: int, each: int = 200_000, least: int = 4) -> int:
    """Tasks for so many rows: files and tasks in proportion to the data, not to a setting."""
    return max(least, -(-rows // each))


def small(frame: DataFrame, rows: int = 100_000) -> DataFrame:
    """``frame`` marked for broadcast if a count shows at most ``rows`` rows, else for a merge join.

    Unmarked it would still be broadcast where its files, which may pack many rows into a
    byte, are smaller than the session's threshold.
    """
    from pyspark.sql import functions as F

    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame.hint("merge")


#: A key is hot with more rows than this and than this share of all.
HOT_ROWS, HOT_SHARE = 10_000, 0.001


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame | None:
    """(key): keys with so many of the ``total`` rows that one task should not get them all, 1 / HOT_SHARE at most; nothing if there is none."""
    from pyspark.sql import functions as F

    bound = max(HOT_ROWS, total * HOT_SHARE)
    if total <= bound:
        return None
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(key)
    hot = Scratch(rows.sparkSession, "hot").save(hot, key)
    return None if hot.isEmpty() else hot


def split_join(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The inner join on ``key`` with a side that has a row for each key at most.

    The side's rows of hot keys (at most 1 / HOT_SHARE) are broadcast, so ``rows`` of those
    keys stay where they are; the others are shuffled.
    """
    from pyspark.sql import functions as F

    if hot is None:
        return rows.join(side, key)
    few = F.broadcast(hot)
    near = rows.join(F.broadcast(side.join(few, key, "left_semi")), key)
    return near.unionByName(rows.join(few, key, "left_anti").join(side, key))


def running_total(frame: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``frame`` with the running sum of ``value`` along ``order``, without one task for all rows.

    Rows are range-partitioned and written with their partition's number; the partitions'
    sums give each one its offset, and the window runs within a partition. Rows of equal
    order fall into one partition and count together.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    scratch = Scratch(frame.sparkSession, "running")
    parts = scratch.save(frame.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))  # a row for each partition
    offsets = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_part").orderBy(order))
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, inner + F.col("_before")).drop("_part", "_before")
