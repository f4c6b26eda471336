"""Fingerprints of documents by their Lempel-Ziv phrases.

A text is parsed once into dictionary phrases: each is the shortest run of code points from
where the last one ended that no phrase was before (LZ78). The set of phrases is hashed, and
the ``SIZE`` least hashes are the fingerprint, a MinHash signature of fixed length. Texts that
would compress well together share phrases, so the likeness of two fingerprints, the share of
the least hashes of both sets that both hold, estimates the Jaccard similarity of the phrase
sets. Of phrases of which only some are kept, a smaller set is kept whole and compared exactly.

The dictionary starts anew every ``STRETCH`` code points, which bounds its memory and the
length of phrases. The parse reads from left to right, so an edit of a text's end starts from
the phrases before it: the phrases of its old end are taken back and those of its new end added.

``with_edits`` compares each document with an edited form of itself and with the next
document, in descending order of ids. Ids are dealt out by ranges of ids alone (ranges are
measured on the ids; one id per range reaches the driver), each range is sorted, and a task
reads it row by row with one row to look ahead; the first document of a range goes to the
range before it as well, and the first of all to the last. Texts are shuffled once.

Defined cases: a null text is the empty text; a text without phrases has the empty
fingerprint, which is like itself (1) and nothing else (0); rows that share an id go by a
hash of their texts; rows without an id come after all others; a single row follows itself;
further columns are ignored, whatever their names; an empty input gives an empty output.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Hashes of a fingerprint.
SIZE = 128
#: Code points after which the dictionary is emptied.
STRETCH = 1 << 20
#: Rows of a range of ids, about; there are at most ``RANGES`` ranges.
RANGE_ROWS = 2_000
RANGES = 65_536

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parse(text: str, seen: dict, begun: str = "") -> str:
    """Adds the phrases of a text to ``seen``; ``begun`` is a phrase left open before it, the result one after it."""
    for c in text:
        begun += c
        if begun not in seen:
            seen[begun] = None
            begun = ""
    return begun


_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        width = max(n, min(2 * len(_POWERS[0]), STRETCH))
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _POWERS = tuple(np.cumprod(np.where(np.arange(width) == 0, np.uint64(1), x)) for x in (_ODD, inverse))
    return _POWERS


def phrase_hashes(text: str, phrases) -> np.ndarray:
    """32-bit hashes of phrases that make up the beginning of a text, in their order.

    A phrase is hashed by a polynomial over its code points, from running sums over the text.
    """
    lengths = np.fromiter(map(len, phrases), np.int64)
    if not len(lengths):
        return np.empty(0, np.uint32)
    ends = np.cumsum(lengths)
    points = np.frombuffer(text[: int(ends[-1])].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _powers(len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed((points + np.uint64(1)) * _ODD) * up[: len(points)])])
    starts = ends - lengths
    whole = (sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64)
    return (_mixed(whole) >> np.uint64(32)).astype(np.uint32)


def _least(hashes: np.ndarray) -> np.ndarray:
    """The ``SIZE`` least different hashes, in order."""
    hashes = np.unique(hashes)
    return hashes[:SIZE]


def _text_of(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype(">u4").tobytes()).decode()


def fingerprint(text: str) -> str:
    """The fingerprint of a text, as a Base64 string of its sorted 32-bit hashes."""
    found = np.empty(0, np.uint32)
    for start in range(0, len(text), STRETCH):
        piece, seen = text[start : start + STRETCH], {}
        parse(piece, seen)
        found = _least(np.concatenate([found, phrase_hashes(piece, seen)]))
    return _text_of(found)


def hashes_of(mark: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(mark), ">u4")


def likeness_of(a: str, b: str) -> float:
    """The share of the least hashes of two fingerprints that both have, from 0 to 1."""
    if a == b:
        return 1.0
    x, y = hashes_of(a), hashes_of(b)
    least = np.union1d(x, y)[:SIZE]
    both = np.intersect1d(x, y, assume_unique=True)
    return float(np.isin(both, least, assume_unique=True).sum() / len(least))


class Parsed:
    """A text, its fingerprint, and what is needed for that of its edited form."""

    def __init__(self, text: str):
        self.text = text
        self.kept = len(text) - len(text) // 3
        self.seen: dict = {}
        if len(text) > STRETCH:
            self.mark = fingerprint(text)
            return
        self.begun = parse(text[: self.kept], self.seen)
        self.before = len(self.seen)
        parse(text[self.kept :], self.seen, self.begun)
        self.mark = _text_of(_least(phrase_hashes(text, self.seen)))

    def edited(self, following: str) -> tuple[str, str]:
        """The text whose last third is the beginning of the following one, and its fingerprint."""
        end = following[: len(self.text) // 3]
        text = self.text[: self.kept] + end
        if len(self.text) > STRETCH:
            return text, fingerprint(text)
        while len(self.seen) > self.before:
            self.seen.popitem()
        parse(end, self.seen, self.begun)
        return text, _text_of(_least(phrase_hashes(text, self.seen)))


@F.pandas_udf(StringType())
def fingerprints(text: pd.Series) -> pd.Series:
    """The fingerprints of a column of texts."""
    return text.fillna("").map(fingerprint)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness of two columns of fingerprints."""
    return pd.Series([likeness_of(x, y) for x, y in zip(a, b)], dtype=float)


def _ranges(ids: DataFrame) -> list[tuple[int, int]]:
    """(least, largest) of ranges of ids that hold about as many rows each, in order."""
    wanted = min(RANGES, max(16, ids.count() // RANGE_ROWS))
    parts = ids.where("id is not null").repartitionByRange(wanted, "id").groupBy(F.spark_partition_id().alias("p"))
    return sorted((r["a"], r["b"]) for r in parts.agg(F.min("id").alias("a"), F.max("id").alias("b")).collect())


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, own, id, text): documents in partitions of whole ranges, each range in descending order.

    After the documents of a range comes, with ``own`` false, the one that follows its last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    found = _ranges(docs.select(F.col(id_col).cast("long").alias("id")))
    lost = rows.where("id is null").agg(F.max("tie")).first()[0]
    least, head = (np.array([r[k] for r in found], np.int64) for k in (0, 1))
    order = [*range(len(found) - 1, -1, -1), *([-1] if lost is not None else [])]  # ranges by descending ids, the last without
    before = dict(zip(order, [order[-1], *order[:-1]])) if order else {}

    def places(ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
        known = ids.notna().to_numpy()
        value = ids.fillna(0).to_numpy(np.int64)
        at = np.where(known, np.searchsorted(least, value, "right") - 1, -1)
        first = np.where(known, head[at] == value, ties.to_numpy(np.int64) == (lost or 0)) if len(head) else np.full(len(ids), True)
        to = pd.array([before[r] if f else None for r, f in zip(at.tolist(), first.tolist())], "Int32")
        return pd.DataFrame({"range": at.astype(np.int32), "to": to})

    placed = rows.withColumn("p", F.pandas_udf(places, "range int, to int")("id", "tie"))
    copies = F.filter(
        F.array(F.struct(F.col("p.range").alias("range"), F.lit(True).alias("own")), F.struct(F.col("p.to").alias("range"), F.lit(False).alias("own"))), lambda c: c["range"].isNotNull()
    )
    spread = placed.select("id", "text", "tie", F.explode(copies).alias("c")).select("c.range", "c.own", "id", "text", "tie")
    tasks = max(16, len(order) // 4)
    return spread.repartition(tasks, "range").sortWithinPartitions("range", F.desc("own"), F.desc_nulls_last("id"), F.desc("tie")).drop("tie")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The edited text has the first ``floor(n_chars / 3)`` code points of the next document, in
    descending order of ids, in place of its own last ones.
    """
    names = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.large_string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None  # range, own, id and parsed text of the row before
        for batch in batches:
            out = []
            for place, own, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                now = Parsed(text) if own or (last and last[1] and last[0] == place) else None
                if last and last[1] and last[0] == place:
                    was = last[3]
                    edited, mark = was.edited(text)
                    out.append((last[2], len(was.text), edited, was.mark, mark, likeness_of(was.mark, mark), likeness_of(was.mark, now.mark)))
                last = (place, own, key, now)
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", *names])

    found = dealt(docs, id_col, text_col).mapInArrow(run, "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *names)


def op12_phrase_fingerprint(spark, sf_dir):
    found = with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
