"""Exact and near deduplication against brute force, and their defined edge cases."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from loomgraph.llm import embedding_dedup, exact_dedup, minhash
from loomgraph.sources import tables
from loomgraph.operators import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], DOCS)


def labels_of(ids, pairs):
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def noisy_family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_exact_groups_match_brute_force(spark):
    rng = random.Random(1)
    pool = ["a b", "a  b", "a\tb", "a b", "", None, "A b", "x" * 5000, " a b"]
    texts = [(i, rng.choice(pool)) for i in range(300)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(frame(spark, texts), support=0.05).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), i == min(same))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_edges(spark):
    empty = exact_dedup.exact_groups(frame(spark, []))
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0
    twice = exact_dedup.exact_groups(frame(spark, [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r["doc_id"] or 0, r["kept"], r["group_size"]) for r in twice) == [(0, False, 4), (0, True, 1), (1, True, 4), (1, True, 4), (2, False, 4)]
    extra = frame(spark, [(1, "a"), (2, "a")]).selectExpr("*", "'x' as digest", "1 as hot", "2 as keep_id", "3 as id", "4 as own", "5 as lost", "6 as gone", "7 as _own")
    kept = exact_dedup.deduplicate(extra)
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == extra.columns


@pytest.mark.parametrize("bound", [0, 10**6])
def test_exact_deduplication_keeps_the_first_of_each_text(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup, "BROADCAST_LOST", bound)
    rng = random.Random(12)
    texts = [(i, "hot" if i % 3 == 0 else rng.choice([f"t{rng.randrange(150)}", "hot  text", None, "", "\t"])) for i in range(600)]
    texts += [(7, "another text under an id"), (7, "hot"), (None, "hot"), (None, "t1"), (3, "hot")]
    rng.shuffle(texts)
    kept = exact_dedup.deduplicate(frame(spark, texts), support=0.05).collect()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts]
    least = {}
    for i, t in norm:
        least[t] = min(least.get(t, 10**9), 10**9 if i is None else i)
    want = sorted((-1 if i is None else i, t) for i, t in norm if i is None or least[t] == i)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in kept) == want


def test_frequent_digests_are_candidates(spark):
    rows = [("a",)] * 300 + [("b",)] * 120 + [(f"c{k}",) for k in range(3000)]
    random.Random(13).shuffle(rows)
    digests = spark.createDataFrame(rows, "t string").selectExpr("unhex(sha2(t, 256)) as digest").repartition(7)
    found = exact_dedup.frequent_hashes(digests, 0.02).collect()
    want = {r[0] for r in spark.sql("select xxhash64(unhex(sha2(t, 256))) from values ('a'), ('b') as v(t)").collect()}
    assert want <= {r["h"] for r in found} and len(found) <= 50


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    ids = list(range(400))
    rng.shuffle(ids)
    pairs = list(zip(ids[:250], ids[1:250])) + [(ids[300], i) for i in ids[301:]]
    got = dict(components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect())
    want = labels_of(ids, pairs)
    assert got == {i: want[i] for i in {v for p in pairs for v in p}}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent,small", [(80, False), (85, True)])
def test_near_duplicates_match_brute_force(spark, percent, small, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", 7)  # several blocks for each family
    if small:  # several blocks of signatures, dense families, joins of keys in blocks, broadcast sets
        monkeypatch.setattr(minhash, "SIGNATURE_NODES", 5)
        monkeypatch.setattr(minhash, "DENSE", -10)
        monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
        monkeypatch.setattr(tables, "HOT_ROWS", 4)  # hot keys, hubs and labels
    rng = random.Random(percent)
    texts = []
    for k in range(6):
        texts += noisy_family(rng, 12, 250, 5)
    texts += noisy_family(rng, 6, 9, 2) + ["one two", "ONE\ttwo", "one two three", "", None, "   ", "long " * 3000]
    shared = " ".join(f"p{k}" for k in range(60))
    texts += [shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows), percent).collect()}

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = labels_of(sets, pairs)
    assert len(pairs) > 50
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    a, b = "a b c d e f g", "h i j k l m n"
    rows = minhash.near_duplicates(frame(spark, [(5, a), (5, b), (7, b), (2, a), (None, a), (9, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (7, 2, False), (9, 9, True)]
    kept = minhash.deduplicate(frame(spark, [(5, a), (2, a), (9, None)]).selectExpr("*", "1 as family", "2 as id", "3 as component"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9] and "family" in kept.columns


@pytest.mark.parametrize("percent", [80, 85])
def test_signature_bound_holds_pairs_at_the_threshold(percent):
    rng = np.random.default_rng(3)
    chunks = minhash.chunks_for(percent)
    lost = 0
    for _ in range(2000):
        base = rng.integers(0, 2**64, 400, np.uint64)
        both = 4 * percent  # of 400
        half = (400 - both) // 2
        a, b = np.unique(base[: both + half]), np.unique(np.concatenate([base[:both], base[both + half :]]))
        (sa, ba), (sb, bb) = minhash.signature(a, chunks), minhash.signature(b, chunks)
        lost += int(np.bitwise_count(ba.view(np.uint64) ^ bb.view(np.uint64)).sum()) > minhash.bit_bound(percent)
        differ = sa.view(np.uint16) != sb.view(np.uint16)
        lost += differ.sum() >= 2 * chunks
        if differ.sum() < 2 * chunks:  # pigeonhole: some chunk has one error at most
            assert (differ.reshape(chunks, 4).sum(axis=1) <= 1).any()
    assert lost == 0


def test_blocks_list_near_pairs_once():
    """Near pairs of a family by blocks against all pairs in plain Python."""
    import pandas as pd

    rng = random.Random(5)
    texts = noisy_family(rng, 40, 120, 6) + noisy_family(rng, 3, 120, 2)
    sets = [minhash.shingles(t) for t in texts]
    sigs = [minhash.signature(s, 8) for s in sets]
    rows = []
    for k, (s, (c, b)) in enumerate(zip(sets, sigs)):
        for other in range(3):
            rows.append((1, min(k % 3, other), max(k % 3, other), k, len(s), k // 2, k % 3, *c, *b))
    frame_ = pd.DataFrame(rows, columns=["family", "i", "j", "id", "n", "label", "block", *minhash._columns(8)])
    got = sorted((min(a, b), max(a, b)) for _, a, b in minhash.near_in_blocks(frame_, 80, 8))
    want = []
    for a, b in combinations(range(len(sets)), 2):
        symbols = (sigs[a][0].view(np.uint16) != sigs[b][0].view(np.uint16)).sum()
        bits = np.bitwise_count(sigs[a][1].view(np.uint64) ^ sigs[b][1].view(np.uint64)).sum()
        n, m = sorted((len(sets[a]), len(sets[b])))
        if a // 2 != b // 2 and symbols < 16 and bits <= minhash.bit_bound(80) and 100 * n >= 80 * m:
            want.append((a, b))
    assert len(want) > 20 and got == want


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("cell", [4096, 40])
def test_embedding_links_match_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", min(cell, 64))
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 17 else None))
    rows += [(400 + k, rows[5][1], rows[5][2]) for k in range(5)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0, None], 1), (503, [float("nan")] * 16, 1), (504, [], 1), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [3.0e38] * 16, 2), (508, [1e-38] * 16, 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(np.float32(v), float)
            x /= np.abs(x).max()
            good[i] = (label, x / np.linalg.norm(x))
    pairs = [(a, b) for a, b in combinations(good, 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93]
    want = labels_of([r[0] for r in rows], pairs)
    links = {r[0]: 0 for r in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    assert len(pairs) > 100
    assert got == {i: (links[i], want[i], want[i] == i) for i in links}


def test_embedding_edges(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    rows = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 2)], VECTORS).selectExpr("*", "1 as node", "2 as cell")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
