"""op11's operator against plain Python."""

import itertools
import random

import pytest

from loomgraph.llm import filter_audit as a
from loomgraph.sources.tables import Scratch

DOCS = "doc_id long, text string, lang string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, masks = {}, {}
    for i, text, lang, *_ in docs:
        text = text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in docs),
        }
        masks.setdefault(lang or "", []).append((frozenset(f for f in fails if fails[f]), i in good, i in toxic))
    for part, rows in masks.items():
        removals = dict.fromkeys("ABCDE", 0)
        mine = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                before = set(order[:k])
                out_now = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                removals[f] += len(out_now)
                mine[order, k + 1] = (len(left), len(out_now), sum(f in r[0] and bool(r[0] & before) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in out_now), sum(r[2] for r in out_now))
        for (order, step), row in mine.items():
            out[part, order, step] = (*row, removals[order[step - 1]])
    return out


def some_documents():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(140)] + ["Big", "LOUD", "a#b"]

    def text(n):
        return rng.choice([" ", "\n", "\x0b "]).join(rng.choice(words) for _ in range(n))

    base = [text(n) for n in (0, 1, 5, 90, 100, 110, 130, 250, 260, 900) for _ in range(3)]
    base += [base[20] + "x", base[20][:-1], "é" * 300, "e" * 300, ("é" * 256) + "tail", ("é" * 256) + "tale", " " * 400, "x" * 70_000 + "a", "x" * 70_000 + "b"]
    docs = [(k, rng.choice(base), rng.choice(["en", "de", None, ""]), "own", 1) for k in range(260)]
    docs += [(7, None, "en", "own", 1), (7, "twice", "en", "own", 1), (7, "twice", "en", "own", 1), (900, "twice", "en", "own", 1), (None, base[5], "en", "own", 1), (None, base[5], None, "own", 1)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 270, 2)] + [(4, 1, 1), (None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("hot", [a.HOT, 0.9])
def test_audit(spark, monkeypatch, hot):
    monkeypatch.setattr(a, "HOT", hot)
    docs, labels = some_documents()
    got = a.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    rows = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got.collect()}
    assert rows == brute(docs, labels)
    assert got.count() == len({d[2] or "" for d in docs}) * 600


@pytest.mark.parametrize("few", [a.BROADCAST_IDS, 0])
def test_equal_hashes_are_no_equal_texts(spark, monkeypatch, few):
    """With one hash for all blocks, texts of a length share a class and only their texts tell them apart."""
    monkeypatch.setattr(a, "BROADCAST_IDS", few)
    monkeypatch.setattr(a, "GROUP", 3)
    docs = spark.createDataFrame([(k, "abcd"[k % 4] * (2 + k % 3) + "z", "en") for k in range(60)], "doc_id long, text string, lang string")
    same = lambda text: [1]
    rows = a.profile(docs, hashes=same)
    found = a.duplicates(docs, rows, Scratch(spark, "test"), hashes=same)
    assert sorted((r["id"], r["first"]) for r in found.collect()) == [(k, k % 12) for k in range(12, 60)]


def test_words_of_long_texts(monkeypatch):
    text = "one two  three\n" * 50 + "x" * 40 + " end"
    whole = a.words_of(text.encode())
    monkeypatch.setattr(a, "PIECE", 7)
    assert a.words_of(text.encode()) == whole == (152, 5)


def test_empty_tables(spark):
    none = a.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert none.count() == 0 and none.columns[:3] == ["part", "filter_order", "step"]
    alone = a.audit(spark.createDataFrame([(1, None, None, "x", 1)], DOCS), spark.createDataFrame([], LABELS))
    assert {(r["part"], r["removed"]) for r in alone.where("step = 1 and filter_order like 'A%'").collect()} == {("", 1)} and alone.count() == 600
