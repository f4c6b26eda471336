"""Best-fit packing of tokenized documents into sequences.

Documents are tokenized once into pieces of at most ``capacity`` tokens (only longer
documents are cut) and the pieces, without their ids, are written to a narrow table. The
plan is made from the histogram of piece lengths alone: best-fit decreasing over counts,
where all bins with the same content are one group, so its cost and size depend on the
number of distinct lengths (at most ``capacity``) and not on the number of documents. The
plan is a list of slot runs ``(length, first rank, count, first sequence, slots per
sequence, offset)``. Pieces are ranked within their length (in hashed sub-buckets, as many
as its count asks for, whose counts give the offsets) and take the slot of their rank.

Defined cases: a null or empty text is the one separator token; every row of the input
is packed, repeated ones too; an empty input gives an empty output; a piece of full length
has a sequence of its own; ids are null where the id is null; the text of a token that the
vocabulary file adds (such as ``<|endoftext|>``) is that token, as the tokenizer has it.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scratch

CAPACITY = 4096
SEPARATOR = 1
#: Pieces of a length that one ranking task orders, about.
RANK_ROWS = 500
CACHE_ENTRIES = 400_000

# In texts of these characters alone, normalisation is lower-casing and pre-tokens are
# found by the expression below; other texts go through the tokenizer whole.
_OTHER = re.compile("[^\x00-\u017f\u2010-\u2027\u2030-\u205e]")
_LETTER, _NUMBER, _SPACE = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PRE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class WordBPE:
    """Ids of texts by a tokenizer file; ids of frequent pre-tokens are remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold one of these go through the tokenizer whole: each is one id of its own.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = bytearray(max(vocabulary.values(), default=0) + 3)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that hold no white space, by one call of the tokenizer."""
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        found, at, ends = [], 0, self.ends
        for k, i in enumerate(ids):
            if ends[i]:
                found.append(ids[at : k + 1])
                at = k + 1
        if len(found) != len(words) or at != len(ids):  # a word that the tokenizer cuts again
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return {w: struct.pack(f"<{len(x)}I", *x) for w, x in zip(words, found)}

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _OTHER.search(text) or any(t in text for t in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = self.words
        tokens = _PRE.findall(text.lower())
        new = {t for t in tokens if t not in words}
        if not new:
            return b"".join(map(words.__getitem__, tokens))
        if len(words) > CACHE_ENTRIES:
            words.clear()
            new = set(tokens)
        learned = self._learn(list(new))
        words.update(learned)
        out = b"".join(map(words.__getitem__, tokens))
        for t in learned:
            if len(t) >= 64:
                del words[t]
        return out


@lru_cache(2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length and the CRC-32 of its ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches):
        t = tokenizer(path)
        end = struct.pack("<I", SEPARATOR)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                x = b.slice(part, 256)
                rows = []
                for doc, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                    ids = t.encode(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.record_batch([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slot runs (length, first rank, count, first sequence, slots per sequence, offset).

    Best-fit decreasing: an item goes to the open sequence with the least sufficient
    space. While a sequence is the best fit it stays so until it can't take another item
    of that length, so sequences of one group are filled alike and only the last one of a
    length can differ from its group.
    """
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, how many)
    spaces: list[int] = []
    runs = []
    fresh = 0

    def put(space, first, n):
        if n and space:
            if space not in open_:
                open_[space] = []
                insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop(at)
            else:
                space = capacity
                n = -(-left // (capacity // length))
                first = fresh
                fresh += n
            each = space // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - space))
                rank += full * each
                left -= full * each
                put(space - each * length, first, full)
            if n > full and left:  # fewer than one sequence takes
                runs.append((length, rank, left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                full += 1
                left = 0
            put(space, first + full, n - full)
    return runs


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.save(pieces(docs, path, capacity, id_col, text_col), "pieces")
    # At most ``capacity`` rows: one for each length.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Sub-buckets of a length in proportion to its own count, so that no length is one large task.
    parts = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in histogram.items()], "length long, parts long")
    cut = cut.join(F.broadcast(parts), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")))
    counts = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    runs = plan(histogram, capacity)
    columns = ["length", "first_rank", "run", "first_sequence", "each", "at"]
    slots = spark.createDataFrame(
        pa.table([pa.array(c, pa.int64()) for c in zip(*runs)] if runs else [pa.array([], pa.int64())] * 6, names=columns)
    )
    counts = scratch.save(counts, "counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("place", F.row_number().over(within) - 1)
        .join(before.select("length", "bucket", "before"), ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place"))
    )
    # The plan's size depends on the number of distinct lengths only: broadcast.
    s = F.broadcast(slots).alias("s")
    r = ranked.alias("r")
    inside = F.col("r.rank") - F.col("s.first_rank")
    return r.join(s, (F.col("r.length") == F.col("s.length")) & (inside >= 0) & (inside < F.col("s.run"))).select(
        F.col("r.doc_id").alias(id_col),
        "r.piece",
        "r.start",
        "r.length",
        "r.ids_crc32",
        (F.col("s.first_sequence") + F.floor(inside / F.col("s.each"))).alias("sequence_id"),
        (F.col("s.at") + F.pmod(inside, F.col("s.each")) * F.col("r.length")).alias("offset"),
    )


def op9_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
