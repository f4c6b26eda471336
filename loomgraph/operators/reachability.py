"""Reachability without tables of all pairs: node sets, packed labels, strong components, an index.

Everything runs in rounds over frames ``(src, dst)``; a round takes ``HOPS`` hops from what
the last one found, so there are fewer tables in the shared folder than hops, and no node or
group meets in one task unless it is one strong component that has to be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scratch, running_total, small

MAX_ROUNDS = 10_000
#: Hops between two tables of a round.
HOPS = 2
#: Bits of a packed word.
WORD = 64
#: Words side by side in a row where many labels go down layer by layer, and the labels from which they do.
WIDE = 8
MANY = WIDE * WORD
#: Layers that one table of a peeling takes off.
PEELED = 4
#: Layers that read what lies above them at once.
BAND = 6
#: Rows of edges into a layer, or of numbered labels, that are broadcast at most.
INTO = 1_000_000
#: Labels in buckets that are broadcast at most.
NAMED = 2_000_000


def _steps(edges: DataFrame, scratch: Scratch, back: bool = False) -> DataFrame:
    """Distinct edges as (at, to), reversed if asked for."""
    a, b = ("dst", "src") if back else ("src", "dst")
    return scratch.save(edges.select(F.col(a).alias("at"), F.col(b).alias("to")).dropna().distinct(), "steps")


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id): the starts (id) and every node that they reach."""
    spark = edges.sparkSession
    scratch = Scratch(spark, "reachable")
    step = _steps(edges, scratch)
    new = scratch.save(starts.select("id").dropna().distinct(), "n0")
    paths = [scratch.path("n0")]
    for k in range(1, max_rounds + 1):
        if new.isEmpty():
            break
        known = spark.read.schema(new.schema).parquet(*paths)
        found, now = [], new
        for _ in range(HOPS):
            now = now.join(step, F.col("id") == F.col("at")).select(F.col("to").alias("id")).distinct()
            found.append(now)
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        new = scratch.save(every.distinct().join(known, "id", "left_anti"), f"n{k}")
        paths.append(scratch.path(f"n{k}"))
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    return spark.read.schema(new.schema).parquet(*paths)


def numbered(keys: DataFrame, column: str) -> DataFrame:
    """(column, bucket, bit): the different keys numbered in order, 64 to a bucket."""
    one = Scratch(keys.sparkSession, "numbered").save(keys.select(column).dropna().distinct(), "keys").withColumn("_one", F.lit(1))
    number = F.col("_number") - 1
    return running_total(one, column, "_one", "_number").select(column, F.floor(number / WORD).alias("bucket"), F.pmod(number, F.lit(WORD)).cast("int").alias("bit"))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, bucket, bit) -> (keys, bucket, word): the bits of a bucket as one 64-bit word."""
    return rows.groupBy(*keys, "bucket").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))


def unpacked(words: DataFrame) -> DataFrame:
    """The rows of packed ones: ``bit`` in place of ``word``."""
    held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("word", b) == 1)
    return words.withColumn("bit", F.explode(held)).drop("word")


def spread(steps: DataFrame, seeds: DataFrame, scratch: Scratch, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """seeds (id, bucket, word) taken along steps (at, to) -> (id, bucket, word), the seeds included.

    A round sends only bits that are new at a node; a word moves 64 labels at once.
    """
    spark = steps.sparkSession
    new = scratch.save(seeds.groupBy("id", "bucket").agg(F.bit_or("word").alias("word")), "w0")
    paths = [scratch.path("w0")]
    for k in range(1, max_rounds + 1):
        if new.isEmpty():
            break
        found, now = [], new
        for _ in range(HOPS):
            now = now.join(steps, F.col("id") == F.col("at")).groupBy(F.col("to").alias("id"), "bucket").agg(F.bit_or("word").alias("word"))
            found.append(now)
        every = found[0]
        for f in found[1:]:
            every = every.unionByName(f)
        known = spark.read.schema(new.schema).parquet(*paths).select("id", "bucket", F.col("word").alias("old"))
        met = every.groupBy("id", "bucket").agg(F.bit_or("word").alias("word")).join(known, ["id", "bucket"], "left")
        fresh = met.groupBy("id", "bucket", "word").agg(F.bit_or("old").alias("old")).withColumn("word", F.expr("word & ~coalesce(old, 0L)"))
        new = scratch.save(fresh.where("word <> 0").select("id", "bucket", "word"), f"w{k}")
        paths.append(scratch.path(f"w{k}"))
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    return spark.read.schema(new.schema).parquet(*paths).groupBy("id", "bucket").agg(F.bit_or("word").alias("word"))


def extreme(steps: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, largest: bool = True, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """seeds (id, value), a row for each node -> the same with the largest (else least) value that reaches the node along steps (at, to), its own among them.

    Null values are none. A round sends only values that have become better.
    """
    best, better = (F.max, F.greatest) if largest else (F.min, F.least)
    now = scratch.save(seeds.select("id", "value", F.col("value").isNotNull().alias("moved")), f"{name}0")
    for k in range(1, max_rounds + 1):
        for _ in range(HOPS):
            sent = now.where("moved").join(steps, F.col("id") == F.col("at")).groupBy("to").agg(best("value").alias("sent"))
            met = now.join(sent, F.col("id") == F.col("to"), "left").withColumn("after", better("value", "sent"))
            # A value that moved in this table's first hop has gone on in its second one.
            now = met.select("id", F.col("after").alias("value"), (~F.col("after").eqNullSafe(F.col("value"))).alias("moved"))
        now = scratch.save(now, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        if now.where("moved").isEmpty():
            return now.select("id", "value")
    raise RuntimeError(f"no end within {max_rounds} rounds")


def layers(steps: DataFrame, scratch: Scratch, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, dict[int, int]] | None:
    """steps (at, to) -> (steps with ``layer``, how many steps lead to each layer), or nothing if they hold a cycle.

    The layer of a step is that of its end: the number of steps on the longest path to it.
    Nodes without steps to them are peeled, ``PEELED`` layers to a table.
    """
    spark = steps.sparkSession
    left, gone, n = steps, [], None
    for k in range(max_rounds):
        now = left.withColumn("off", F.lit(None).cast("int"))
        for layer in range(1, PEELED + 1):
            inner = now.where("off is null").select(F.col("to").alias("at")).distinct().withColumn("inner", F.lit(True))
            free = F.col("off").isNull() & F.col("inner").isNull()
            now = now.join(inner, "at", "left").select("at", "to", F.when(free, k * PEELED + layer).otherwise(F.col("off")).alias("off"))
        now = scratch.save(now, f"peel{k}")
        gone.append(scratch.path(f"peel{k}"))
        left = now.where("off is null").select("at", "to")
        m = left.count()
        if m in (0, n):
            break
        n = m
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    if m:
        return None
    off = spark.read.schema(now.schema).parquet(*gone).where("off is not null")
    # A node lies one below the last of the steps to it to go, which are all gone by then.
    own = off.groupBy("to").agg(F.max("off").alias("layer"))
    out = scratch.save(off.select("at", "to").join(own, "to"), "layered")
    return out, {r["layer"]: r["n"] for r in out.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}


def wide(words: DataFrame) -> DataFrame:
    """(id, bucket, word) -> (id, block, w0, ...): ``WIDE`` buckets side by side."""
    each = [F.bit_or(F.when(F.pmod("bucket", F.lit(WIDE)) == k, F.col("word")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WIDE)]
    return words.groupBy("id", F.floor(F.col("bucket") / WIDE).alias("block")).agg(*each)


def narrow(rows: DataFrame) -> DataFrame:
    """The words of wide rows that hold a bit: (id, bucket, word)."""
    words = rows.select("id", "block", F.posexplode(F.array(*(f"w{k}" for k in range(WIDE)))).alias("k", "word")).where("word <> 0")
    return words.select("id", (F.col("block") * WIDE + F.col("k")).alias("bucket"), "word")


def descend(layered: DataFrame, sizes: dict[int, int], seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """``spread`` over steps without cycles (at, to, layer): a node's words are made once, when all above it are there.

    ``BAND`` layers at a time read the layers above them, then each reads only those of its band
    above it and shuffles only what its own nodes get, so every word goes along every step once,
    whatever the lengths of the paths.
    """
    spark = layered.sparkSession
    each = [f"w{k}" for k in range(WIDE)]
    place = layered.select(F.col("to").alias("id"), "layer").distinct().hint("merge")
    first = wide(seeds).join(place, "id", "left").withColumn("layer", F.coalesce("layer", F.lit(0)))
    first = scratch.save(first.repartition("layer", "block"), "first")
    kind = first.select("id", "block", *each)

    def into(low: int, high: int) -> DataFrame:
        steps = layered.where(F.col("layer").between(low, high)).select("at", "to", "layer")
        return F.broadcast(steps) if sum(sizes.get(k, 0) for k in range(low, high + 1)) <= INTO else steps.hint("merge")

    def got(tables: list[str], low: int, high: int) -> DataFrame:
        return spark.read.schema(kind.schema).parquet(*tables).join(into(low, high), F.col("id") == F.col("at")).select(F.col("to").alias("id"), "layer", "block", *each)

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.bit_or(c).alias(c) for c in each))

    paths: list[str] = []
    last = max(sizes, default=0)
    for low in range(0, last + 1, BAND):
        high = min(low + BAND - 1, last)
        own = first.where(F.col("layer").between(low, high)).select("id", "layer", "block", *each)
        if paths:
            own = scratch.save(merged(own.unionByName(got(paths, low, high)), "id", "layer", "block"), f"band{low}")
        band: list[str] = []
        for k in range(low, high + 1):
            here = own.where(F.col("layer") == k).select(*kind.columns)
            if band:
                here = merged(here.unionByName(got(band, k, k).select(*kind.columns)), "id", "block")
            scratch.save(here, f"layer{k}")
            band.append(scratch.path(f"layer{k}"))
        scratch.drop(f"band{low}")
        paths += band
    return narrow(spark.read.schema(kind.schema).parquet(*paths))


def reaching(edges: DataFrame, seeds: DataFrame, label: str, back: bool = False, own: bool = True) -> tuple[DataFrame, DataFrame]:
    """Which labels reach which nodes, packed.

    seeds (id, label) -> (words, numbers): (id, bucket, word) for the nodes that a label's seeds
    reach along the edges (against them if ``back``), and (label, bucket, bit). Seeds have their
    own label if ``own``, else only where a path of one edge or more leads to them. More than
    ``MANY`` labels go layer by layer where no cycle is in the way, fewer in rounds.
    """
    scratch = Scratch(edges.sparkSession, "reaching")
    steps = _steps(edges, scratch, back)
    numbers = scratch.save(numbered(seeds, label), "numbers")
    first = seeds.select("id", label).dropna().join(small(numbers, INTO), label)
    if own:  # both ways make one row of a node's bits
        first = first.select("id", "bucket", F.expr("shiftleft(1L, bit)").alias("word"))
    else:
        first = packed(first, ["id"]).join(steps, F.col("id") == F.col("at")).select(F.col("to").alias("id"), "bucket", "word")
    found = layers(steps, scratch) if numbers.limit(MANY + 1).count() > MANY else None
    return spread(steps, first, scratch) if found is None else descend(*found, first, scratch), numbers


def labelled(words: DataFrame, numbers: DataFrame, label: str) -> DataFrame:
    """(id, label): the packed rows that ``reaching`` gives, unpacked, and further columns that they have; a bucket's 64 labels meet its words."""
    own = [c for c in words.columns if c not in ("bucket", "word")]
    named = F.map_from_entries(F.collect_list(F.struct("bit", label)))
    buckets = numbers.groupBy("bucket").agg(named.alias("_held")).select("bucket", F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.try_element_at("_held", b)).alias("_held"))
    # Every bit is made a row and the empty ones dropped in the same compiled loop; functions on arrays would be interpreted.
    bits = words.join(small(buckets, NAMED // WORD), "bucket").select(*own, "word", "_held", F.explode(F.array(*map(F.lit, range(WORD)))).alias("bit"))
    return bits.where(F.getbit("word", "bit") == 1).select(*own, F.get("_held", "bit").alias(label))


def pairs(edges: DataFrame, roots: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(src, dst): every dst that a path of one edge or more joins to a src, each once; ``roots`` (id) restricts the sources, ``ends`` (id, ...) the dsts.

    Other columns of ``ends`` go with the pairs: they meet the packed words, not each pair.
    Sources go down the edges packed, 64 to a word: neighbours in order share most of what
    they reach, so the words are far fewer than the pairs, which are made at the end.
    """
    words, numbers = reaching(edges, _sources(edges, roots), "src", own=False)
    if ends is not None:
        words = words.join(small(ends.distinct(), INTO // 2), "id")
    return labelled(words, numbers, "src").withColumnRenamed("id", "dst").select("src", "dst", *([] if ends is None else [c for c in ends.columns if c != "id"]))


def _sources(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    own = edges.select(F.col("src").alias("id")).dropna().distinct()
    if roots is not None:
        # Both may hold every node, and a column of ids in small files would be broadcast.
        own = own.join(roots.select("id").distinct().hint("merge"), "id", "left_semi")
    return own.select("id", F.col("id").alias("src"))


def counts_below(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(id, n): how many nodes each node with an edge reaches by a path of one edge or more.

    Bits are counted by bucket, so nothing but the sums of 64 nodes leaves a task.
    """
    words, numbers = reaching(edges, _sources(edges, roots), "src", own=False)
    sums = words.groupBy("bucket").agg(F.array(*(F.sum(F.getbit("word", F.lit(k)).cast("long")) for k in range(WORD))).alias("_n"))
    return numbers.hint("merge").join(sums, "bucket").select(F.col("src").alias("id"), F.get("_n", F.col("bit")).alias("n"))


def counts_above(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, n): how many of the ``roots`` (id) reach each node, where any does."""
    words, _ = reaching(edges, _sources(edges, roots), "src", own=False)
    return words.groupBy("id").agg(F.sum(F.bit_count("word")).alias("n"))


def trimmed(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int]:
    """The edges left, and how many, when nodes without edges in or out are peeled away again and again."""
    now = scratch.save(edges, f"{name}-0")
    n = now.count()
    for k in range(1, max_rounds):
        if n == 0:
            break
        left = now
        for _ in range(HOPS):
            into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = left.join(into, "src", "left_semi").join(out, "dst", "left_semi")
        now = scratch.save(left.select(*edges.columns), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        m = now.count()
        if m == n:
            break
        n = m
    return now, n


def strong_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, component): nodes that lie on a cycle, by the least id of their strong component.

    Forward-backward colouring: what no cycle holds is trimmed; every node takes the largest
    id that reaches it as its colour; going back from the node whose id is the colour, within
    the colour, finds that node's whole component. All colours are worked on at once, then
    what is left is trimmed and coloured again. Null ends are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "strong")
    kind = dict(edges.dtypes)["src"]
    left, n = trimmed(edges.select("src", "dst").dropna().distinct(), scratch, "t0")
    found = []
    for r in range(1, max_rounds):
        if n == 0:
            break
        colour = scratch.save(left.groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("m")).select("id", F.greatest("id", "m").alias("colour")), f"c{r}-0")
        for k in range(1, max_rounds):
            now = colour
            for _ in range(HOPS):
                sent = left.join(now, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("colour").alias("m"))
                now = now.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.greatest("colour", F.coalesce("m", "colour")).alias("colour"))
            after = now.join(colour.toDF("id", "was"), "id").select("id", "colour", (F.col("colour") != F.col("was")).alias("moved"))
            after = scratch.save(after, f"c{r}-{k}")
            done = after.where("moved").isEmpty()
            scratch.drop(f"c{r}-{k - 1}")
            colour = after.select("id", "colour")
            if done:
                break
        # Edges within a colour, against their direction, from the node that gave the colour.
        inside = left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select(F.col("dst").alias("at"), F.col("src").alias("to"))
        inside = scratch.save(inside, f"i{r}")
        members = scratch.save(colour.where("id = colour").select("id", "colour"), f"m{r}-0")
        paths, new = [scratch.path(f"m{r}-0")], members
        for k in range(1, max_rounds):
            known = spark.read.schema(members.schema).parquet(*paths)
            steps, now = [], new
            for _ in range(HOPS):
                now = now.join(inside, F.col("id") == F.col("at")).select(F.col("to").alias("id"), "colour").distinct()
                steps.append(now)
            every = steps[0]
            for s in steps[1:]:
                every = every.unionByName(s)
            new = scratch.save(every.distinct().join(known.select("id"), "id", "left_anti"), f"m{r}-{k}")
            paths.append(scratch.path(f"m{r}-{k}"))
            if new.isEmpty():
                break
        done_now = spark.read.schema(members.schema).parquet(*paths)
        found.append(done_now.withColumn("round", F.lit(r)))
        gone = done_now.select("id")
        rest = left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")
        left, n = trimmed(rest, scratch, f"t{r}")
    if not found:
        return spark.createDataFrame([], f"id {kind}, component {kind}")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    named = every.groupBy("round", "colour").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n"))
    # A node that is its colour alone lies on a cycle only if it has an edge to itself.
    loops = edges.where("src = dst").select(F.col("src").alias("colour")).distinct().withColumn("loop", F.lit(True))
    real = named.join(loops, "colour", "left").where("n > 1 or loop").select("round", "colour", "component")
    return scratch.save(every.join(real, ["round", "colour"]).select("id", "component"), "out")


#: 64-bit words of each of an index's two sets of bits, and its random orders.
INDEX_WORDS, INDEX_ORDERS = 4, 2
_DOWN = [f"down{k}" for k in range(INDEX_WORDS)]
_UP = [f"up{k}" for k in range(INDEX_WORDS)]
_LOW, _HIGH = [f"low{k}" for k in range(INDEX_ORDERS)], [f"high{k}" for k in range(INDEX_ORDERS)]
LABELS = [*_DOWN, *_UP, *_LOW, *_HIGH]


def index(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, labels): what a node that reaches another must have, a fixed number of longs per node.

    ``down`` holds a bit of every node below (itself included), ``up`` of every node above;
    ``low`` and ``high`` are the interval of the nodes below in random orders. If a reaches b,
    the bits below b are among those below a, the bits above a among those above b, and b's
    intervals lie within a's. Cycles share their labels.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "index")
    step = _steps(edges, scratch)
    place = F.pmod(F.xxhash64("id"), F.lit(WORD * INDEX_WORDS))
    bits = [F.when(F.floor(place / WORD) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(WORD)).cast("int"))).otherwise(F.lit(0).cast("long")) for k in range(INDEX_WORDS)]
    orders = [F.xxhash64("id", F.lit(k)) for k in range(INDEX_ORDERS)]
    ends = step.select(F.col("at").alias("id")).unionByName(step.select(F.col("to").alias("id"))).distinct()
    now = ends.select("id", *(b.alias(c) for b, c in zip(bits + bits, _DOWN + _UP)), *(o.alias(c) for o, c in zip(orders + orders, _LOW + _HIGH)), F.lit(True).alias("moved"))
    now = scratch.save(now, "x0")
    for k in range(1, max_rounds):
        here = now
        for _ in range(HOPS):
            sent = here.where("moved")
            below = step.join(sent, F.col("to") == F.col("id")).groupBy("at").agg(*(F.bit_or(c).alias(f"n_{c}") for c in _DOWN), *(F.min(c).alias(f"n_{c}") for c in _LOW), *(F.max(c).alias(f"n_{c}") for c in _HIGH))
            above = step.join(sent, F.col("at") == F.col("id")).groupBy("to").agg(*(F.bit_or(c).alias(f"n_{c}") for c in _UP))
            met = here.join(below, F.col("id") == F.col("at"), "left").join(above, F.col("id") == F.col("to"), "left")
            after = {c: F.col(c).bitwiseOR(F.coalesce(f"n_{c}", F.lit(0))) for c in _DOWN + _UP} | {c: F.least(c, f"n_{c}") for c in _LOW} | {c: F.greatest(c, f"n_{c}") for c in _HIGH}
            changed = F.lit(False)
            for c in LABELS:
                changed = changed | (after[c] != F.col(c))
            here = met.select("id", *(after[c].alias(c) for c in LABELS), changed.alias("moved"))
        now = scratch.save(here, f"x{k}")
        scratch.drop(f"x{k - 1}")
        if now.where("moved").isEmpty():
            return now.drop("moved")
    raise RuntimeError(f"no end within {max_rounds} rounds")


def _may(a: str, b: str):
    """Whether labels (prefix a) may reach labels (prefix b)."""
    ok = F.lit(True)
    for c in _DOWN:
        ok = ok & (F.col(f"{b}{c}").bitwiseAND(F.bitwise_not(F.col(f"{a}{c}"))) == 0)
    for c in _UP:
        ok = ok & (F.col(f"{a}{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}{c}"))) == 0)
    for c in _LOW:
        ok = ok & (F.col(f"{a}{c}") <= F.col(f"{b}{c}"))
    for c in _HIGH:
        ok = ok & (F.col(f"{a}{c}") >= F.col(f"{b}{c}"))
    return ok


def holding(pairs: DataFrame, edges: DataFrame, labels: DataFrame | None = None, least: int = 1, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The pairs (src, dst) that a path of ``least`` edges (one or two) or more joins, each once.

    The index (made here if not given) refuses most pairs; for the others a search goes down
    from src, for all pairs at once, only through nodes that may reach dst.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "holding")
    step = _steps(edges, scratch)
    labels = index(edges) if labels is None else labels

    def marked(prefix):
        return labels.select(F.col("id").alias(f"{prefix}id"), *(F.col(c).alias(f"{prefix}{c}") for c in LABELS))

    def hopeful(rows, at):
        met = rows.join(marked("a_"), F.col(at) == F.col("a_id")).join(marked("b_"), F.col("dst") == F.col("b_id"))
        return met.where(_may("a_", "b_")).select(*rows.columns)

    front = scratch.save(hopeful(pairs.select("src", "dst").dropna().distinct(), "src").withColumn("at", F.col("src")), "f0")
    paths, held = [scratch.path("f0")] if least == 1 else [], []  # a longer path may pass src once more
    for k in range(1, max_rounds):
        if front.isEmpty():
            break
        nearer = front.join(step, "at").select("src", "dst", F.col("to").alias("at")).distinct()
        arrived = F.lit(k >= least) & (F.col("at") == F.col("dst"))
        done = scratch.save(nearer.where(arrived).select("src", "dst"), f"h{k}")
        held.append(scratch.path(f"h{k}"))
        onward = nearer.where(~arrived).join(small(done), ["src", "dst"], "left_anti")
        if paths:
            onward = onward.join(spark.read.schema(front.schema).parquet(*paths), ["src", "dst", "at"], "left_anti")
        front = scratch.save(hopeful(onward, "at"), f"f{k}")
        paths.append(scratch.path(f"f{k}"))
    else:
        raise RuntimeError(f"no end within {max_rounds} rounds")
    if not held:
        return front.select("src", "dst")
    return spark.read.schema(front.select("src", "dst").schema).parquet(*held).distinct()
