"""WARC records in ZIP-packaged archives, written and read by range.

Writing: pages with equal payloads (by SHA-1) of at least ``min_bytes`` bytes are one
response record, that of the smallest page_id, and revisit records. Each Spark partition
becomes one archive: stored (uncompressed) ZIP members ``archive/NNNNNN.warc.gz``, in which
every record is a gzip member of its own, an index member ``indexes/index.cdx`` with a line
per record, and the central directory (ZIP64 where sizes ask for it). Spark's own file
writer stores the bytes, so any shared file system will do and lost tasks are redone; it
ends each row with a line feed, which falls between members and, at the end, is the
archive's one-byte comment.

Reading: a first pass opens each archive's end, parses the end records (ZIP64 too), the
central directory and the index member, and lists record ranges; a second pass reads just
those ranges, in groups of adjacent records spread over the executors. Nothing is
extracted. Archives that only Spark's reader can open are read as whole files instead.

Defined cases: null html is the empty payload; of repeated rows that share the smallest
page_id each is a response; a null page_id refers to the smallest known one and is a
response where the group has none; a null url becomes ``urn:page:ID``; other columns are
ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch

MEMBER_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
#: Up to so many repeated payloads (some 60 bytes each) are broadcast.
BROADCAST_SHARED = 1_000_000
_B32_FROM, _B32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(text):
    """Bare upper-case base32 of the SHA-1 of a string column, built by columns alone."""
    h = F.sha1(F.encode(text, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), _B32_FROM, _B32_TO)


# -- records ---------------------------------------------------------------------------


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str = "1970-01-01T00:00:00Z", revisit: bool = False) -> bytes:
    """One WARC record, uncompressed."""
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url is not None else f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one uncompressed record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")

    def fields(block):
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode().split("\r\n")[1:])}

    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


# -- archives --------------------------------------------------------------------------


def _extra64(values) -> bytes:
    big = [v for v in values if v >= _MAX32]
    return struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""


def local_header(name: str, data: bytes) -> bytes:
    n = name.encode()
    extra = _extra64([len(data), len(data)])
    size = min(len(data), _MAX32)
    return _LOCAL + struct.pack("<5H3I2H", 45 if extra else 20, 0x800, 0, 0, 0x21, zlib.crc32(data), size, size, len(n), len(extra)) + n + extra


def directory(members: list[tuple[str, int, int, int]], at: int, comment: bytes, zip64: bool = False) -> bytes:
    """The central directory and end records of members (name, crc, size, offset)."""
    out = b""
    for name, crc, size, offset in members:
        n = name.encode()
        extra = _extra64([size, size, offset]) if size >= _MAX32 or offset >= _MAX32 else b""
        s = min(size, _MAX32)
        out += _CENTRAL + struct.pack("<6H3I5H2I", 45, 45 if extra else 20, 0x800, 0, 0, 0x21, crc, s, s, len(n), len(extra), 0, 0, 0, 0, min(offset, _MAX32)) + n + extra
    count, length = len(members), len(out)
    if zip64 or count >= _MAX16 or length >= _MAX32 or at >= _MAX32:
        end64 = at + length
        out += _END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, count, count, length, at) + _LOCATOR64 + struct.pack("<IQI", 0, end64, 1)
        count, length, at = _MAX16, _MAX32, _MAX32
    return out + _END + struct.pack("<4H2IH", 0, 0, count, count, length, at, len(comment)) + comment


class Archive:
    """A ZIP archive read by ranges: ``members`` maps names to (offset of the data, size)."""

    def __init__(self, source, size: int):
        self.source = source
        tail_at = max(0, size - 65557 - 76)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(_END)
        if end < 0:
            raise ValueError("not a ZIP archive: no end record")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if _MAX16 == count or _MAX32 in (length, at):
            if tail[end - 20 : end - 16] == _LOCATOR64:
                (where,) = struct.unpack_from("<Q", tail, end - 12)
                end64 = self.range(where, 56)
                if end64[:4] != _END64:
                    raise ValueError("broken ZIP64 end record")
                count, length, at = struct.unpack_from("<3Q", end64, 32)
        self.members: dict[str, tuple[int, int]] = {}
        names = self.range(at, length)
        p = 0
        while p + 46 <= len(names) and names[p : p + 4] == _CENTRAL:
            method, size_, whole, n, x, c, offset = (*struct.unpack_from("<H", names, p + 10), *struct.unpack_from("<IIHHH", names, p + 20), *struct.unpack_from("<I", names, p + 42))
            name = names[p + 46 : p + 46 + n].decode()
            q, stop = p + 46 + n, p + 46 + n + x
            while q + 4 <= stop:
                tag, width = struct.unpack_from("<HH", names, q)
                if tag == 1:
                    values = iter(struct.unpack_from(f"<{width // 8}Q", names, q + 4))
                    whole = next(values) if whole == _MAX32 else whole
                    size_ = next(values) if size_ == _MAX32 else size_
                    offset = next(values) if offset == _MAX32 else offset
                q += 4 + width
            if method:
                raise ValueError(f"{name} is compressed; only stored members can be read by range")
            head = self.range(offset, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"{name} has no local header at {offset}")
            n2, x2 = struct.unpack_from("<HH", head, 26)
            self.members[name] = (offset + 30 + n2 + x2, size_)
            p += 46 + n + x + c
        if len(self.members) != count:
            raise ValueError("broken central directory")

    def range(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def records(self) -> list[tuple[int, int]]:
        """(offset in the archive, length) of every record, from the index members."""
        out = []
        for name, (at, size) in self.members.items():
            if name.startswith("indexes/"):
                for line in self.range(at, size).decode().splitlines():
                    member, offset, length = line.split(" ")
                    out.append((self.members[member][0] + int(offset), int(length)))
        return sorted(out)


def open_source(path: str):
    """A seekable file for a path or URI, from any executor that reaches its store."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


# -- Spark -----------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url"), html.alias("html"))
    full = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.col("html")))
    shared = (
        full.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    # Only payloads that occur more than once, with their count; pages meet them where they are if a
    # count allows it. Else those with more than a thousandth of the pages are broadcast, a thousand
    # at most, so that no task gets the pages of a frequent payload, and the others are shuffled.
    shared = scratch.save(shared, "shared")
    if shared.count() <= BROADCAST_SHARED:
        joined = full.join(F.broadcast(shared), "payload_digest", "left")
    else:
        bound = pages.count() / 1000
        hot, cold = F.broadcast(shared.where(F.col("n") > bound)), shared.where(F.col("n") <= bound)
        rest = full.join(hot.select("payload_digest"), "payload_digest", "left_anti")
        joined = full.join(hot, "payload_digest").unionByName(rest.join(cold, "payload_digest", "left"))
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        F.when(revisit, "").otherwise(F.col("html")).alias("html"),
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, member_bytes: int = MEMBER_BYTES) -> None:
    """One archive per non-empty partition of ``with_revisits`` rows, below ``folder``."""

    def run(batches):
        members, index = [], []
        at = 0
        block, entries = bytearray(), []

        def emit(name, data):
            nonlocal at
            head = local_header(name, data)
            members.append((name, zlib.crc32(data), len(data), at))
            row = head + data
            at += len(row) + 1  # the writer's line feed
            return pa.record_batch([pa.array([row], pa.binary())], names=["data"])

        def flush():
            name = f"archive/{len(members):06d}.warc.gz"
            index.extend(f"{name} {o} {n}" for o, n in entries)
            out = emit(name, bytes(block))
            block.clear()
            entries.clear()
            return out

        for b in batches:
            for part in range(0, b.num_rows, 64):
                for r in b.slice(part, 64).to_pylist():
                    raw = record(r["page_id"], r["url"], r["html"].encode(), r["payload_bytes"], r["payload_digest"], r["refers_to"], revisit=r["record_type"] == "revisit")
                    packed = gzip.compress(raw, 5, mtime=0)
                    entries.append((len(block), len(packed)))
                    block += packed
                    if len(block) >= member_bytes:
                        yield flush()
        if entries:
            yield flush()
        if members:
            yield emit("indexes/index.cdx", "\n".join(index).encode())
            yield pa.record_batch([pa.array([directory(members, at, b"\n")[:-1]], pa.binary())], names=["data"])

    records.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.mode("overwrite").text(folder)


_OUT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(raw: bytes):
    warc, http, payload = parse(raw)
    stated = warc["warc-payload-digest"].removeprefix("sha1:")
    kind = warc["warc-type"]
    if kind == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != stated:
            raise ValueError(f"payload of {warc['warc-record-id']} doesn't match its digest")
    page, refers = warc.get("x-page-id", ""), warc.get("x-refers-to-page")
    return int(page) if page else None, warc["warc-target-uri"], int(http["content-length"]), stated, kind, int(refers) if refers else None, payload


def read_archives(spark, folder: str, payloads: bool = True, ranged: bool | None = None) -> DataFrame:
    """Every record of the archives in ``folder``; ``payloads`` False leaves the bytes out."""
    files = spark.read.format("binaryFile").load(folder)
    if ranged is None:
        some = files.select("path").limit(1).collect()
        ranged = not some or some[0][0].startswith("file:") or _reachable(some[0][0])
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _OUT.split(", ")]

    def batch(rows):
        rows = [r if payloads else (*r[:6], None) for r in rows]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    if not ranged:

        def whole(batches):
            import io

            for b in batches:
                for content in b.column(0):
                    raw = content.as_buffer()
                    archive = Archive(io.BytesIO(raw), raw.size)
                    for k in range(0, len(found := archive.records()), 256):
                        yield batch([_rows(gzip.decompress(archive.range(o, n))) for o, n in found[k : k + 256]])

        return files.select("content").mapInArrow(whole, _OUT)

    def locate(batches):
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_source(path) as source:
                    found = Archive(source, size).records() if size else []
                group: list[int] = []
                begin = 0
                for o, n in found:
                    if group and o + n - begin > RANGE_BYTES:
                        yield pa.record_batch([pa.array([path]), pa.array([begin], pa.int64()), pa.array([group], pa.list_(pa.int64()))], names=["path", "at", "parts"])
                        group = []
                    if not group:
                        begin = o
                    group += [o - begin, n]
                if group:
                    yield pa.record_batch([pa.array([path]), pa.array([begin], pa.int64()), pa.array([group], pa.list_(pa.int64()))], names=["path", "at", "parts"])

    def fetch(batches):
        for b in batches:
            for path, at, parts in zip(*(c.to_pylist() for c in b.columns)):
                with open_source(path) as source:
                    source.seek(at)
                    block = source.read(parts[-2] + parts[-1])
                spans = list(zip(parts[::2], parts[1::2]))
                for k in range(0, len(spans), 256):
                    yield batch([_rows(gzip.decompress(block[o : o + n])) for o, n in spans[k : k + 256]])

    width = max(1, spark.sparkContext.defaultParallelism)
    ranges = files.select("path", "length").mapInArrow(locate, "path string, at long, parts array<long>")
    return ranges.repartition(max(width, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(fetch, _OUT)


def _reachable(path: str) -> bool:
    try:
        with open_source(path) as source:
            source.read(1)
        return True
    except (OSError, ValueError, ImportError, NotImplementedError) as e:  # no such store here: Spark's reader is the way
        logging.getLogger(__name__).warning("archives are read whole, as %s can't be opened here: %s", path, e)
        return False


def op7_warc(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(with_revisits(pages, 0, scratch), scratch.path("archives"))
    return read_archives(spark, scratch.path("archives"), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP7_SQL = r"""
WITH h AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, t, octet_length(encode(t)) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (((('0x' || substr(hex || '0000', 1 + ((i * 5) // 4), 3))::BIGINT) >> (7 - (i * 5) % 4)) & 31) AS BIGINT), 1)),
      'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first
  FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""
