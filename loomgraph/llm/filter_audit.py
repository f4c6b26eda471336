"""Audit of how document filters interact: what each removes, alone and in every order.

Duplicates are found by refining a partition of the documents. They are split by their
length in code points, then by the hash of their first block, their second and so on;
blocks grow sixteenfold, so a text of any length has a handful. After every split the
documents that are alone in their class drop out, and only narrow rows (id, class, hashes)
move. The texts of what is left are compared in full with that of their class's least id;
those that differ (two texts with equal hashes) form classes of their own and go round
again. A document is a duplicate when an equal text has a smaller id.

The audit then needs no document any more: a document is a mask of the filters it fails,
masks are counted per part, and every order of the filters is a sum over 32 masks.

Classes with more than ``HOT`` of the rows (at most 1 / HOT of them) are broadcast, so no
task gets a class of many copies whole; texts are compared in groups of ``GROUP`` members,
each with a copy of the least text. The ids of what is left are broadcast if a count allows
it, so that other texts stay where they are; else the texts go through one shuffle.

Defined cases: a null text is the empty text; a null part is the empty string; rows without
an id are no duplicates, have none and no labels; rows that share id and text mark each other not;
labels given twice count if one of them does; words and distinct words of long texts are
taken block by block; further columns are ignored, whatever their names; an empty input
gives an empty output.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch

FILTERS = "ABCDE"
#: Share of the rows above which a class is broadcast.
HOT = 0.001
#: Members of a class that are compared in one group.
GROUP = 64
#: Code points of the first block; every later block ends sixteen times further.
BLOCK = 256
#: Up to so many ids (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

_UPPER = bytes(range(65, 91))
_SPACE = b" \t\n\x0b\x0c\r"
_MARKS = (b"#", b"$", b"%", b"&", b"*", b"|")


def words_of(data: bytes) -> tuple[int, int]:
    """Words and distinct words: maximal runs of other bytes than ``[\\x20\\x09-\\x0D]``, as ``split`` cuts."""
    if len(data) <= PIECE:
        words = data.split()
        return len(words), len(set(words))
    count, seen, start = 0, set(), 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        words = data[start:end].split()
        count, start = count + len(words), end
        seen.update(words)
    return count, len(seen)


def failures(text: str, data: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = words_of(data)
    upper = len(data) - len(data.translate(None, _UPPER))
    tests = (words < 100, 100 * distinct < 80 * words, 100 * upper > 10 * len(text), any(m in data for m in _MARKS))
    return sum(t << k for k, t in enumerate(tests))


def block_hashes(text: str) -> list[int]:
    """Signed 64-bit hashes of the blocks of a text, the first of ``BLOCK`` code points."""
    out, start, end = [], 0, BLOCK
    while start < len(text):
        out.append(xxhash.xxh64_intdigest(text[start:end].encode()) - (1 << 63))
        start, end = end, end * 16
    return out


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", with_text: bool = False, hashes=block_hashes) -> DataFrame:
    """(id, part, mask, n, blocks[, text]): per row the filters A to D it fails, its length and block hashes."""
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = dict(chosen.dtypes)["id"]

    def run(batches):
        for batch in batches:
            masks, lengths, blocks = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                masks.append(failures(text, text.encode()))
                lengths.append(len(text))
                blocks.append(hashes(text))
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(lengths, pa.int64()), pa.array(blocks, pa.list_(pa.int64()))]
            names = ["id", "part", "mask", "n", "blocks"]
            if with_text:
                columns, names = [*columns, batch.column(2)], [*names, "text"]
            yield pa.record_batch(columns, names=names)

    return chosen.mapInArrow(run, f"id {kind}, part string, mask int, n long, blocks array<long>" + (", text string" if with_text else ""))


def _shared(rows: DataFrame, keys: list[str], scratch: Scratch, name: str, total: int) -> DataFrame:
    """The rows whose keys another row has too."""
    counts = scratch.save(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), f"{name}-counts")
    hot = F.broadcast(counts.where(F.col("_n") > HOT * total).drop("_n"))  # at most 1 / HOT rows
    rest = rows.join(hot, keys, "left_anti").join(counts.where(F.col("_n") <= HOT * total), keys, "left_semi")
    return scratch.save(rows.join(hot, keys, "left_semi").unionByName(rest), name)


def candidates(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, class): rows (id, n, blocks) that no split by length or by a block's hash tells from all others."""
    total = rows.count()
    now = _shared(rows.where("id is not null").select("id", "n", "blocks", F.col("n").alias("class")), ["class"], scratch, "round-0", total)
    for k in range(1, 64):
        deepest = now.agg(F.max(F.size("blocks"))).first()[0] or 0
        if k > deepest:
            break
        split = now.withColumn("class", F.when(F.size("blocks") >= k, F.xxhash64("class", F.get("blocks", F.lit(k - 1)))).otherwise(F.col("class")))
        now = _shared(split, ["class"], scratch, f"round-{k}", total)
    return now.select("id", "class")


def _class_of(n, blocks):
    """The class that all splits together give a row."""
    return F.aggregate(blocks, n, lambda c, b: F.xxhash64(c, b))


def duplicates(docs: DataFrame, rows: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", hashes=block_hashes) -> DataFrame:
    """(id, part, mask, first): documents whose text the smaller id ``first`` has too; rows are ``profile(docs)``."""
    left = candidates(rows, scratch)
    ids = left.select(F.col("id").alias("_left")).distinct()
    few = ids.count() <= BROADCAST_IDS
    own = docs.select(id_col, text_col, part_col).join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("_left"), "left_semi")
    texts = profile(own, id_col, text_col, part_col, with_text=True, hashes=hashes).withColumn("class", _class_of(F.col("n"), F.col("blocks"))).drop("n", "blocks")
    total = left.count()
    sizes = scratch.save(left.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")), "classes")
    if few:  # classes are fewer than ids
        marked = texts.join(F.broadcast(sizes), "class")
    else:
        hot, cold = F.broadcast(sizes.where(F.col("size") > HOT * total)), sizes.where(F.col("size") <= HOT * total)
        marked = texts.join(hot, "class").unionByName(texts.join(hot.select("class"), "class", "left_anti").join(cold, "class"))
    found = []
    for k in range(64):
        marked = scratch.save(marked, f"texts-{k}")
        least = marked.where("id = first").groupBy("class", "size").agg(F.min("text").alias("least"))
        groups = F.ceil(F.col("size") / GROUP)
        spread = least.select("class", "least", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"))
        met = marked.withColumn("group", F.pmod(F.xxhash64("id"), groups)).join(spread, ["class", "group"]).withColumn("same", F.col("text") == F.col("least"))
        compared = scratch.save(met.select("id", "part", "mask", "class", "first", "same", F.when(~F.col("same"), F.col("text")).alias("text")), f"compared-{k}")
        found.append(compared.where("same and id > first").select("id", "part", "mask", "first"))
        other = compared.where("not same")
        if other.isEmpty():
            break
        again = other.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
        marked = other.drop("same", "first").join(again, "class")
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the set of filters they fail.

    Bit k of a mask is the k-th of ``FILTERS``. A duplicate moves from its mask to that with E.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.save(profile(docs, id_col, text_col, part_col), "profile")
    again = duplicates(docs, rows, scratch, id_col, text_col, part_col)
    moves = F.explode(F.array(F.struct(F.col("mask"), F.lit(-1).alias("weight")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("weight"))))
    moved = again.select("id", "part", moves.alias("m")).select("id", "part", "m.mask", "m.weight")
    every = rows.select("id", "part", "mask", F.lit(1).alias("weight")).unionByName(moved)
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = every.where("id is not null").join(marks, "id", "left")  # rows without an id would all meet in one task
    lost = every.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    weight = F.col("weight")
    counts = known.unionByName(lost).groupBy("part", "mask").agg(
        F.sum(weight).alias("docs"), F.sum(F.when(F.col("good"), weight).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), weight).otherwise(0)).alias("toxic")
    )
    counts = scratch.save(counts, "counts", 1)
    scratch.drop_but("counts")
    return counts


def orders(counts: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic) -> per part, order of the filters and step what that step does.

    The at most 32 masks of a part are one row; kept, removed, redundant, unique_fails,
    good_lost, toxic_lost count its documents, shapley sums removals of the filter over all orders.
    """
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches):
        steps = [(order, k) for order in map("".join, itertools.permutations(FILTERS)) for k in range(len(FILTERS))]
        bits = {f: 1 << k for k, f in enumerate(FILTERS)}
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = [(m["mask"], m["docs"], m["good"], m["toxic"]) for m in masks]

                def total(column, condition):
                    return sum(row[column] for row in table if condition(row[0]))  # noqa: B023

                # A mask of n filters is removed by each of them in 1 / n of the 120 orders.
                shapley = {f: sum(n * 120 // m.bit_count() for m, n, _, _ in table if m & b) for f, b in bits.items()}
                out = []
                for order, k in steps:
                    own, before = bits[order[k]], sum(bits[f] for f in order[:k])

                    def removed(m):
                        return m & own and not m & before  # noqa: B023

                    counted = (
                        total(1, lambda m: not m & (own | before)), total(1, removed), total(1, lambda m: m & own and m & before), total(1, lambda m: m == own),
                        total(2, removed), total(3, removed), shapley[order[k]],
                    )
                    out.append((part, order, k + 1, *counted))
                columns = list(zip(*out))
                kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "filter_order", "step", *names])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in names))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Every order of the five filters over the documents of each part; labels (id, quality, toxic)."""
    return orders(mask_counts(docs, labels, id_col, text_col, part_col))


def op11_filter_audit(spark, sf_dir):
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
  least AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
  l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
      + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, FALSE)::INT AS mask,
      coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN least USING (text) LEFT JOIN l ON l.doc_id = w.doc_id),
  m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
  b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a, b, b c, b d, b e
        WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
  s AS (SELECT filter_order, k::INTEGER AS step, bits[k] AS own, list_sum(bits[1:k-1])::INT AS before FROM o, range(1, 6) r(k)),
  r AS (SELECT part, filter_order, step, own,
      sum(CASE WHEN mask & (own | coalesce(before, 0)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
      sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
      sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
      sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
      sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM m, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""
