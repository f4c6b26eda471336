"""A repository of files that is read incrementally, in batches or as a stream.

``spark.read.format("repository")`` lists the files below ``path``, outside skipped folders
and under a size bound, and reads them in partitions of about ``PARTITION_BYTES``.
``spark.readStream.format("repository")`` emits what changed: a position of the stream is
the name of a manifest, the hashes of all files at a time, kept below the option ``state``.
Two manifests tell which files are new, changed or deleted, so a batch is the same however
often it is tried and a restart goes on where the last one ended. Only files whose size or
time differ from the manifest before are hashed again, and those that were written within
``SETTLED`` before it.

A manifest is a folder of ``BUCKETS`` files by path and a head with their digests. ``changes``
makes it in tasks: folders are listed level by level, a bucket's files hashed by one task.
The stream is planned from two heads; its tasks compare the buckets whose digests differ.
A stream that nobody gives a manifest (option ``manifest``) makes its own where it is planned,
so that is for sources of up to some million files.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import posixpath
import time
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .parsers import decode
from .tables import width_for

#: Folders that hold no sources.
SKIPPED = (".git", "__pycache__", "node_modules", "build", "install", "log", ".venv")
PARTITION_BYTES = 8 << 20
#: Files of a manifest, and the nanoseconds after which a file's time tells it from later contents.
BUCKETS, SETTLED = 256, 2_000_000_000
SCHEMA = "path string, state string, hash string, text string"


def store(path: str):
    """(file system, path in it) of a path or URI, on any node."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_hash(content: bytes) -> str:
    """The first 16 hexadecimal digits of the content's SHA-256."""
    return hashlib.sha256(content).hexdigest()[:16]


def listed(root: str, max_bytes: int) -> dict[str, tuple[int, int]]:
    """Relative path -> (size, time) of the files below a root."""
    from pyarrow import fs

    system, at = store(root)
    found = {}
    for info in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and info.size <= max_bytes:
            name = posixpath.relpath(info.path, at)
            if not set(name.split("/")) & set(SKIPPED):
                found[name] = info.size, info.mtime_ns
    return found


def content_of(root: str, name: str) -> bytes | None:
    """The bytes of a file, nothing if it is gone."""
    system, at = store(root)
    try:
        with system.open_input_stream(posixpath.join(at, name)) as f:
            return f.read()
    except FileNotFoundError:
        return None


class Files(InputPartition):
    """Files to read, with their states, and ones that are gone."""

    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


def dealt(names: list[tuple[str, str]], sizes: dict[str, int]) -> list[Files]:
    """Partitions of (path, state) of about ``PARTITION_BYTES`` each."""
    out, room = [], 0
    for name, state in sorted(names):
        size = 4096 + sizes.get(name, 0)
        if not out or room < size:
            out.append(Files([]))
            room = PARTITION_BYTES
        out[-1].names.append((name, state))
        room -= size
    return out


def rows_of(root: str, part: Files) -> Iterator[tuple]:
    for name, state in part.names:
        content = None if state == "deleted" else content_of(root, name)
        if state == "deleted":
            yield name, state, None, None
        elif content is not None:  # a file that went meanwhile is told by the next batch
            yield name, state, file_hash(content), decode(content)


class Whole(DataSourceReader):
    def __init__(self, root: str, max_bytes: int):
        self.root, self.max_bytes = root, max_bytes

    def partitions(self):
        found = listed(self.root, self.max_bytes)
        return dealt([(name, "new") for name in found], {n: s for n, (s, _) in found.items()})

    def read(self, partition):
        return rows_of(self.root, partition) if partition is not None else iter(())


class Buckets(InputPartition):
    """Buckets in which two manifests differ."""

    def __init__(self, before: str, after: str, numbers: list[int]):
        self.before, self.after, self.numbers = before, after, numbers


class Manifests:
    """The manifests below a folder. Their names begin with a number; the empty name is that of no files."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, name: str, part: str = ""):
        system, at = store(self.folder)
        return system, posixpath.join(at, name, part)

    def _read(self, name: str, part: str):
        system, at = self._path(name, part)
        with system.open_input_stream(at, compression=None) as f:
            return json.loads(gzip.decompress(f.read()))

    def _write(self, name: str, part: str, content) -> None:
        system, at = self._path(name, part)
        system.create_dir(posixpath.dirname(at), recursive=True)
        aside = f"{at}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside, compression=None) as f:
            f.write(gzip.compress(json.dumps(content).encode(), 1))
        system.move(aside, at)

    def _names(self) -> list[str]:
        from pyarrow import fs

        system, at = self._path("")
        found = [posixpath.basename(i.path.rstrip("/")) for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True))]
        return sorted((n for n in found if n.isdigit()), key=int)

    def newest(self) -> str:
        from pyarrow import fs

        for name in reversed(self._names()):
            system, at = self._path(name, "head")
            if system.get_file_info(at).type == fs.FileType.File:
                return name
        return ""

    def next(self) -> str:
        names = self._names()
        return f"{int(names[-1]) + 1 if names else 1:012d}"

    def head(self, name: str) -> dict[int, list]:
        """Bucket -> [digest of its paths and hashes, files, bytes]."""
        return {int(k): v for k, v in self._read(name, "head").items()} if name else {}

    def bucket(self, name: str, number: int, head: dict[int, list] | None = None) -> dict[str, list]:
        """Path -> [size, time, hash] of the files of a bucket."""
        if not name or number not in (self.head(name) if head is None else head):
            return {}
        return self._read(name, str(number))

    def add(self, name: str, number: int, files: dict[str, list]) -> list:
        """Writes a bucket; returns its entry of the head."""
        self._write(name, str(number), files)
        digest = hashlib.sha256(json.dumps([(p, f[2]) for p, f in sorted(files.items())]).encode()).hexdigest()
        return [digest, len(files), sum(f[0] for f in files.values())]

    def end(self, name: str, old: str, head: dict[int, list]) -> str:
        """Writes the head. Where nothing changed since the manifest ``old``, that one gets the files' new times and stays."""
        if not head:
            return ""
        if old and head == self.head(old):
            for number in head:
                system, at = self._path(name, str(number))
                system.move(at, self._path(old, str(number))[1])
            system.delete_dir(self._path(name)[1])
            return old
        self._write(name, "head", head)
        return name

    def drop_before(self, name: str) -> None:
        for other in self._names():
            if int(other) < int(name):
                system, at = self._path(other)
                system.delete_dir(at)


def hashed(root: str, files: dict[str, tuple[int, int]], old: dict[str, list], began: int, each: Callable = map) -> dict[str, list]:
    """Path -> [size, time, hash] of files; those that ``old`` has with their size and time are not read.

    A time within ``SETTLED`` before the listing ``began`` is kept as -1, as the file may change again at that time.
    """
    known = {n: old[n] for n, stat in files.items() if n in old and tuple(old[n][:2]) == stat}
    other = [n for n in files if n not in known]
    for n, content in zip(other, each(lambda n: content_of(root, n), other)):
        if content is not None:
            size, at = files[n]
            known[n] = [size, at if at < began - SETTLED else -1, file_hash(content)]
    return known


class Changes(DataSourceStreamReader):
    def __init__(self, root: str, max_bytes: int, state: str, made: str | None = None):
        self.root, self.max_bytes, self.manifests, self.made = root, max_bytes, Manifests(state), made

    def initialOffset(self):
        return {"manifest": ""}

    def latestOffset(self):
        if self.made is not None:
            return {"manifest": self.made}
        m, began = self.manifests, time.time_ns()
        old, name, split = m.newest(), m.next(), defaultdict(dict)
        for n, stat in listed(self.root, self.max_bytes).items():
            split[zlib.crc32(n.encode()) % BUCKETS][n] = stat
        before, head = m.head(old), {}
        with ThreadPoolExecutor(16) as pool:
            for number, files in split.items():
                if known := hashed(self.root, files, m.bucket(old, number, before), began, pool.map):
                    head[number] = m.add(name, number, known)
        return {"manifest": m.end(name, old, head)}

    def partitions(self, start, end):
        before, after = self.manifests.head(start["manifest"]), self.manifests.head(end["manifest"])
        out, room = [], 0
        for number in sorted(before | after):
            old, new = before.get(number, ["", 0, 0]), after.get(number, ["", 0, 0])
            if old[0] == new[0]:
                continue
            size = 4096 * max(old[1], new[1]) + new[2]
            if not out or room < size:
                out.append(Buckets(start["manifest"], end["manifest"], []))
                room = PARTITION_BYTES
            out[-1].numbers.append(number)
            room -= size
        return out or [Buckets("", "", [])]

    def read(self, partition):
        for number in partition.numbers:
            before, after = self.manifests.bucket(partition.before, number), self.manifests.bucket(partition.after, number)
            changed = [(n, "changed" if n in before else "new") for n, f in after.items() if n not in before or before[n][2] != f[2]]
            yield from rows_of(self.root, Files(changed + [(n, "deleted") for n in before if n not in after]))

    def commit(self, end):
        """Manifests older than the committed one are no longer needed."""
        if end["manifest"]:
            self.manifests.drop_before(end["manifest"])


class RepositorySource(DataSource):
    """Options: path, maxBytes (200,000 if not given) and, for streams, state and the manifest to end at, where it was made before."""

    @classmethod
    def name(cls):
        return "repository"

    def schema(self):
        return SCHEMA

    def _limit(self) -> int:
        return int(self.options.get("maxBytes", 200_000))

    def reader(self, schema):
        return Whole(self.options["path"], self._limit())

    def streamReader(self, schema):
        return Changes(self.options["path"], self._limit(), self.options["state"], self.options.get("manifest"))


def files_of(spark: SparkSession, root: str, max_bytes: int = 200_000) -> DataFrame:
    """(path, state, hash, text): all files below a root."""
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").options(path=root, maxBytes=max_bytes).load()


def _numbers(folder: str) -> int:
    """The number after the last entry of a log."""
    from pyarrow import fs

    system, at = store(folder)
    names = [posixpath.basename(i.path) for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True))]
    return max((int(n) + 1 for n in names if n.isdigit()), default=0)


def listing(spark: SparkSession, root: str, max_bytes: int, scratch: str) -> DataFrame:
    """(path, size, time): the files that ``listed`` finds. Folders are listed in tasks, level by level, into tables below ``scratch``."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        system, at = store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for info in system.get_file_info(fs.FileSelector(posixpath.join(at, folder) if folder else at, allow_not_found=True)):
                    if info.base_name in SKIPPED:
                        continue
                    name = posixpath.join(folder, info.base_name)
                    if info.type == fs.FileType.Directory:
                        rows.append((name, None, None))
                    elif info.type == fs.FileType.File and info.size <= max_bytes:
                        rows.append((name, info.size, info.mtime_ns))
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000])
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "time"])

    schema, wide = "path string, size long, time long", spark.sparkContext.defaultParallelism
    folders, n, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while n:
        levels.append(f"{scratch}/{len(levels)}")
        folders.repartition(width_for(n, 100, min(n, wide))).mapInArrow(run, schema).write.parquet(levels[-1])
        folders = spark.read.schema(schema).parquet(levels[-1]).where("size is null").select("path")
        n = folders.count()
    return spark.read.schema(schema).parquet(*levels).where("size is not null")


def manifest(spark: SparkSession, root: str, state: str, max_bytes: int = 200_000) -> str:
    """The name of the manifest of all files as they are now, made in tasks below the folder ``state``."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    m, began, scratch = Manifests(state), time.time_ns(), f"{state}/listing-{uuid.uuid4().hex}"
    old, name = m.newest(), m.next()
    before = m.head(old)

    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("bucket")[0].as_py()
        now = dict(zip(rows.column("path").to_pylist(), zip(rows.column("size").to_pylist(), rows.column("time").to_pylist())))
        known = hashed(root, now, m.bucket(old, number, before), began)
        found = [[number, *m.add(name, number, known)]] if known else []
        return pa.table([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["bucket", "digest", "files", "bytes"])

    try:
        files = listing(spark, root, max_bytes, scratch)
        rows = files.withColumn("bucket", (F.crc32(F.encode("path", "UTF-8")) % BUCKETS).cast("int"))
        width = min(BUCKETS, width_for(files.count(), 500))
        done = rows.repartition(width, "bucket").groupBy("bucket").applyInArrow(run, "bucket int, digest string, files long, bytes long").collect()
    finally:
        system, at = store(scratch)
        system.create_dir(at, recursive=True)
        system.delete_dir(at)
    return m.end(name, old, {r["bucket"]: [r["digest"], r["files"], r["bytes"]] for r in done})


def changes(spark: SparkSession, root: str, state: str, max_bytes: int = 200_000) -> DataFrame:
    """(path, state, hash, text): files that are new, changed or deleted since the last call with this ``state`` folder.

    What a call returns is kept below the folder; the next one begins after it. A call that
    finds a batch planned but not done does that one first.
    """
    spark.dataSource.register(RepositorySource)
    written = []
    passes = 2 if _numbers(f"{state}/checkpoint/offsets") > _numbers(f"{state}/checkpoint/commits") else 1

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/out/{number}")
        written.append(f"{state}/out/{number}")

    for _ in range(passes):
        made = manifest(spark, root, f"{state}/manifests", max_bytes)
        rows = spark.readStream.format("repository").options(path=root, maxBytes=max_bytes, state=f"{state}/manifests", manifest=made).load()
        q = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(*written) if written else spark.createDataFrame([], SCHEMA)


def write_files(rows: DataFrame, root: str) -> int:
    """Writes rows (path, text) as files below a root, a null text removes its file; returns how many there were."""
    import pyarrow as pa

    def run(batches):
        system, at = store(root)
        made = set()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = posixpath.join(at, name)
                if text is None:
                    system.delete_file(path)
                    continue
                if (folder := posixpath.dirname(path)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(path, compression=None) as f:
                    f.write(text.encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    from pyspark.sql import functions as F

    return rows.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
