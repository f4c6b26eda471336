"""Byte-level BPE encoding and decoding.

Text is split by the tokenizer's pattern; each match (pre-token) is merged on its own.
Merging keeps the symbols of a pre-token in a doubly linked list and the candidate
merges in a rank queue: a bucket per merge rank holds the list positions whose pair has
that rank, and a hierarchy of 256-bit words marks the non-empty buckets, so find-first-set
from the top word yields the lowest rank in a constant number of steps. A position taken
from a bucket whose pair has changed meanwhile is stale and skipped. Work grows linearly
with the length of a pre-token, which is what very long ones need. The new pre-tokens of
many texts go through one queue: their lists end before each other, so no pair is of two.

Pre-tokens recur, so each worker keeps a bounded map from chunks (a run of white space
and the run of other characters after it) to their ids, in two generations: a full one
replaces the older, whose entries move back when they are used again.

Defined cases: a null text is the empty text and has no ids; texts are encoded whole;
the text of a special token is ordinary text; decoding gives the bytes back exactly. Which
characters are letters, numbers and white space is read off the tokenizer library itself,
since Unicode tables differ by version; texts with a character that this expression engine
would class otherwise are split by explicit character classes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Entries of a generation of a worker's map of chunks, and of that of pre-tokens.
CACHE_ENTRIES = 300_000
#: Code points of texts that are encoded together, bytes of pre-tokens that are merged together; longer ones are alone.
TEXT_ROOM, MERGE_ROOM = 1 << 20, 1 << 18
_BIT = [1 << k for k in range(256)]


def _ranges(codes: set[int]) -> str:
    """Code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


@lru_cache(1)
def classes() -> dict[str, str]:
    """Letters, numbers and white space as the tokenizer library has them, and ``odd``: the
    characters that ``regex`` classes otherwise, and white space beyond ASCII.

    The library drops what its pattern does not match, so a byte vocabulary under the
    pattern of one class gives that class back.
    """
    import tiktoken

    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)))
    own = {k: set(map(ord, regex.findall(k, every))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    ranks = {bytes([b]): b for b in range(256)}
    found = {}
    for k in own:
        library = tiktoken.Encoding("class", pat_str=k, mergeable_ranks=ranks, special_tokens={})
        found[k] = set(map(ord, library.decode_bytes(library.encode_ordinary(every)).decode()))
    odd = {c for k in own for c in own[k] ^ found[k]} | {c for c in found[r"\s"] if c > 127}
    return {k: _ranges(v) for k, v in found.items()} | {"odd": _ranges(odd)}


def explicit(pattern: str, own: dict[str, str]) -> str:
    """A pattern with its classes spelled out, inside other classes and alone."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda k: own[k[0]], m[0]), pattern)
    return re.sub(r"\\p\{[LN]\}|\\s|\\S", lambda k: f"[^{own[chr(92) + 's']}]" if k[0] == r"\S" else f"[{own[k[0]]}]", inside)


def _filled(items: list, room: int) -> Iterator[list]:
    """Runs of items of at most ``room`` in length together; a longer item is alone."""
    out, left = [], room
    for x in items:
        size = len(x or "")
        if out and left < size:
            yield out
            out, left = [], room
        out.append(x)
        left -= size
    if out:
        yield out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, own: dict[str, str] | None = None):
        own = own or classes()
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        # Without odd characters both patterns match alike, and the first one is faster.
        self.pattern = regex.compile(pattern)
        self.exact = re.compile(explicit(pattern, own))
        self.odd = re.compile(f"[{own['odd']}]")
        # The rank queue: positions per rank, and two levels of 256-bit words of non-empty ranks.
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (self.size // 256 + 1)
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_tokens: dict[str, bytes] = {}
        self.table = [b""] * self.size
        # Ranks of single bytes and of pairs of bytes; a byte without one has -2, for it may yet be merged.
        self.single, self.double = np.full(256, -2), np.full(1 << 16, -1)
        for token, rank in ranks.items():
            self.table[rank] = token
            if len(token) == 1:
                self.single[token[0]] = rank
            elif len(token) == 2:
                self.double[token[0] << 8 | token[1]] = rank

    @classmethod
    def from_file(cls, path: str, pattern: str, own: dict[str, str] | None = None) -> ByteBPE:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            return cls({base64.b64decode(p[0]): int(p[1]) for p in pairs if p}, pattern, own)

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(token)
        return np.frombuffer(self.merge_all([token])[0], "<u4").tolist() if whole is None else [whole]

    def merge_all(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that have no rank as a whole, each as little-endian unsigned 32-bit integers."""
        get, buckets, low, bit = self.ranks.get, self.buckets, self.low, _BIT
        high = 0  # top word of the bitmap; wider than 256 bits for larger vocabularies
        text = b"\0".join(tokens) + b"\0"
        n = len(text)
        ends = np.cumsum(np.fromiter(map(len, tokens), "i8", len(tokens)) + 1) - 1
        # Where the symbol that begins at a position ends, and where the one before it begins. A
        # pre-token's end has no symbol: a slice that ends at 0 is empty, and has no rank.
        places = np.arange(1, n + 1)
        places[ends] = 0
        after = places.tolist()
        places = np.arange(-1, n - 1)
        places[0] = places[ends[:-1] + 1] = -1
        before = places.tolist()
        codes = np.frombuffer(text, "u1").astype("i8")
        first = self.single[codes]
        first[ends] = -1
        ids = first.tolist()  # of the symbol that begins at a position, -1 where none does
        first = np.append(self.double[codes[:-1] << 8 | codes[1:]], -1)
        first[ends] = first[ends - (ends > 0)] = -1
        pair = first.tolist()  # the rank that the pair at a position has now

        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        ranks, starts = np.unique(first[at], return_index=True)
        at, starts = at.tolist(), [*starts.tolist(), len(at)]
        for k, r in enumerate(ranks.tolist()):
            buckets[r] = at[starts[k] : starts[k + 1]]
            low[r >> 8] |= bit[r & 255]
            high |= 1 << (r >> 8)
        while high:
            w = (high & -high).bit_length() - 1
            word = low[w]
            rank = w << 8 | (word & -word).bit_length() - 1
            low[w] = word = word & (word - 1)
            if not word:
                high &= high - 1
            found = buckets.pop(rank)
            if len(found) > 1:
                found.sort()
            found = iter(found)
            for i in found:
                if pair[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                after[i] = k
                before[k] = i
                pair[j] = ids[j] = -1
                ids[i] = lowest = rank
                pair[i] = r = get(text[i : after[k]], -1)
                if r >= 0:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        buckets[r] = [i]
                        low[r >> 8] |= bit[r & 255]
                        high |= 1 << (r >> 8)
                    if r < lowest:
                        lowest = r
                h = before[i]
                if h >= 0:
                    pair[h] = r = get(text[h:k], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            low[r >> 8] |= bit[r & 255]
                            high |= 1 << (r >> 8)
                        if r < lowest:
                            lowest = r
                if lowest < rank:  # a pair of lower rank, which goes first
                    rest = list(found)
                    if rest:
                        buckets[rank] = rest + buckets.get(rank, [])
                        low[rank >> 8] |= bit[rank & 255]
                        high |= 1 << (rank >> 8)
                    break
        ids = np.array(ids)
        if (ids < -1).any():
            raise KeyError("a byte without a rank")
        counts = [0, *(np.cumsum(ids >= 0)[ends] * 4).tolist()]
        out = ids[ids >= 0].astype("<u4").tobytes()
        return [out[counts[k] : counts[k + 1]] for k in range(len(tokens))]

    def _learn(self, parts: dict[str, list[str]]) -> None:
        """Enters pre-tokens that are not in the map yet."""
        tokens, new = self.tokens, []
        for t in {t for p in parts.values() for t in p}.difference(tokens):
            ids = self.old_tokens.get(t)
            if ids is None:
                e = t.encode()
                whole = self.ranks.get(e)
                if whole is None:
                    new.append((t, e))
                    continue
                ids = struct.pack("<I", whole)
            tokens[t] = ids
        names = iter(new)
        for group in _filled([e for _, e in new], MERGE_ROOM):
            for ids in self.merge_all(group):
                tokens[next(names)[0]] = ids

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        if len(self.tokens) > CACHE_ENTRIES:
            self.old_tokens, self.tokens = self.tokens, {}
        if len(self.words) > CACHE_ENTRIES:
            self.old_words, self.words = self.words, {}
        words, parts, chunks = self.words, {}, []
        for t in texts:
            if t and not t.isascii() and self.odd.search("".join(set(t))):  # chunks would cut runs of white space
                parts[t] = self.exact.findall(t)
                chunks.append([t])
            else:
                chunks.append(_CHUNK.findall(t or ""))
        new = set().union(*chunks).difference(words)
        for c in new:
            if c not in parts:
                ids = self.old_words.get(c)
                if ids is None:
                    parts[c] = self.pattern.findall(c)
                else:
                    words[c] = ids
        self._learn(parts)
        for c, p in parts.items():
            words[c] = b"".join(map(self.tokens.__getitem__, p))
        out = [b"".join(map(words.__getitem__, c)) for c in chunks]
        for c, p in parts.items():  # long ones hardly recur
            if len(c) >= 64:
                del words[c]
                for t in p:
                    if len(t) >= 64:
                        self.tokens.pop(t, None)
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for group in _filled(texts, TEXT_ROOM) for ids in self._encoded(group)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str, own: dict[str, str] | None = None) -> ByteBPE:
    """One codec per worker process; ``own`` holds the classes that the driver found."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = ByteBPE.from_file(path, pattern, own)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, the token ids as an array."""
    own = classes()

    def run(batches):
        bpe = codec(path, pattern, own)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                x = b.slice(part, 256)
                ids = [np.frombuffer(i, "<u4").astype("i4") for i in bpe.encode_all(x.column(1).to_pylist())]
                yield pa.record_batch([x.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, and digests of the ids and of the decoded bytes."""
    own = classes()

    def run(batches):
        bpe = codec(path, pattern, own)
        for b in batches:
            for part in range(0, b.num_rows, 256):
                x = b.slice(part, 256)
                n, of_ids, of_bytes = [], [], []
                for ids in bpe.encode_all(x.column(1).to_pylist()):
                    n.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.record_batch([x.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
