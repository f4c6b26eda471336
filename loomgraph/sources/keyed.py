"""Keyed tables: hash buckets of Parquet files that a manifest names.

A merge rewrites the buckets that its keys fall into, into new files, and then writes a
manifest that names the new files for these buckets and the old ones for all others. A
manifest is written under another name and renamed last, and only if no other writer made
that version in the meantime. So a reader sees a merge whole or not at all, a writer that
is killed leaves the old rows, and keys cost no folders of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer made the next version first."""


class KeyedTable:
    """A table at ``path`` whose rows are replaced by ``key``, in ``buckets`` buckets (fixed when it is made).

    A bucket is read and written by one task, so their number should grow with the table:
    a hundred megabytes each or so. The manifest has an entry per bucket.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = (self._manifest() or {}).get("buckets", buckets)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The number of the last merge, 0 before the first."""
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int | None = None) -> dict | None:
        version = self.version() if version is None else version
        if not version:
            return None
        stream = self._fs.open(self._at(f"manifest/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        """Writes a manifest aside and renames it; raises if its version is there already."""
        aside, name = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/{version:012d}.json")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri() if name.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE  # an existing version is never overwritten
        try:
            context.rename(aside, name, options)
        except Exception as e:
            if self._fs.exists(name):
                self._fs.delete(aside, False)
                raise ConflictError(f"version {version} of {self.path} is there already") from e
            raise

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _files(self, manifest: dict, buckets=None) -> DataFrame | None:
        paths = [f"{self.path}/{p}" for b, p in manifest["files"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if none is named."""
        manifest = self._manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        return self._files(manifest)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys; buckets without one are not read."""
        manifest = self._manifest()
        wanted = keys.select(self.key).distinct()
        touched = {r[0] for r in wanted.select(self._bucket()).distinct().collect()}  # one a bucket at most
        return self._files(manifest, touched).join(wanted, self.key, "left_semi")

    def merge(self, rows: DataFrame, drop: DataFrame | None = None) -> int:
        """Rows take the place of all rows of their keys; the keys of ``drop`` go. Returns the new version.

        Without any key nothing is written, but for the first version of a table.
        """
        version = self.version()
        manifest = self._manifest(version) or {"buckets": self.buckets, "schema": rows.schema.jsonValue(), "files": {}}
        schema = StructType.fromJson(manifest["schema"])
        rows = rows.select(*schema.fieldNames())
        keys = rows.select(self.key)
        if drop is not None:
            keys = keys.unionByName(drop.select(self.key))
        touched = sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # one a bucket at most
        if not touched and version:
            return version
        old = self._files(manifest, set(touched)).join(keys.distinct(), self.key, "left_anti")
        folder = f"data/{uuid.uuid4().hex}"
        placed = old.unionByName(rows).withColumn("_bucket", self._bucket())
        if touched:
            placed.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        files = {b: p for b, p in manifest["files"].items() if int(b) not in touched}
        there = {s.getPath().getName() for s in self._fs.listStatus(self._at(folder))} if touched else set()
        files |= {str(b): f"{folder}/_bucket={b}" for b in touched if f"_bucket={b}" in there}
        self._fs.mkdirs(self._at("manifest"))
        self._commit(version + 1, manifest | {"files": files})
        return version + 1

    def resume(self, todo: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """Does those of ``todo`` whose keys the table has not yet and merges them; returns how many keys that were."""
        if self.version():
            todo = todo.join(self.read().select(self.key).distinct(), self.key, "left_anti")
        n = todo.select(self.key).distinct().count()
        if n:
            self.merge(work(todo))
        return n

    def vacuum(self) -> int:
        """Removes files that the last version doesn't name, and older manifests; returns how many folders went."""
        manifest, version = self._manifest(), self.version()
        if manifest is None:
            return 0
        live = {p.split("/")[1] for p in manifest["files"].values()}
        gone = 0
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in live:
                gone += self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._at("manifest")):
            if s.getPath().getName() != f"{version:012d}.json":
                self._fs.delete(s.getPath(), False)
        return gone
