"""op12 and its operator against a plain parse of each text."""

import hashlib
import random

import numpy as np
import pytest

from loomgraph.llm import phrase_fingerprint as p
from loomgraph.llm import queries

SF = "/root/testdata/sf0.001"


def phrases(text, stretch=p.STRETCH):
    out = set()
    for at in range(0, len(text), stretch):
        piece, own, start = text[at : at + stretch], set(), 0
        for end in range(1, len(piece) + 1):
            if piece[start:end] not in own:
                own.add(piece[start:end])
                start = end
        out |= own
    return out


def brute(text):
    """The least hashes, each phrase hashed on its own."""
    marks = {int(p.phrase_hashes(w, [w])[0]) for w in phrases(text)}
    return sorted(marks)[: p.SIZE]


def edited(text, following):
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)


def check(got, rows):
    assert len(got) == len(rows)
    for k, (key, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        r = got[key]
        changed = edited(text, following)
        assert (r["n_chars"], r["edited"]) == (len(text), changed)
        assert list(p.hashes_of(r["fingerprint"])) == brute(text) and list(p.hashes_of(r["edited_fingerprint"])) == brute(changed)
        for other, near in ((changed, r["near_edited"]), (following, r["near_next"])):
            a, b = brute(text), brute(other)
            least = sorted({*a, *b})[: p.SIZE]
            assert near == (1.0 if a == b else len({*a} & {*b} & {*least}) / len(least))


def some_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "éclair", "日本", "\U0001f600", "of", "the"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 30, 300])))) for k in rng.sample(range(10_000), 90)]
    return [*rows, (10_001, None), (10_002, ""), (10_003, "a"), (10_004, "a" * 5000), (10_005, "ab"), (-3, "below zero")]


@pytest.mark.parametrize("each", [4, 2000])
def test_edits(spark, monkeypatch, each):
    monkeypatch.setattr(p, "RANGE_ROWS", each)
    rows = some_rows() + [(None, "no id at all")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, range string, own int").repartition(3)
    check({r["doc_id"]: r for r in p.with_edits(frame).collect()}, in_order(rows))


def test_few_rows(spark):
    schema = "doc_id int, text string"
    assert p.with_edits(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "alone in the world")], [(None, "nameless")], [(2, "two"), (1, None)]):
        frame = p.with_edits(spark.createDataFrame(rows, schema))
        check({r["doc_id"]: r for r in frame.collect()}, rows)
        assert dict(frame.dtypes)["doc_id"] == "int"
    twice = p.with_edits(spark.createDataFrame([(3, "same"), (3, "same"), (3, "other"), (1, "first")], schema)).collect()
    assert sorted((r["doc_id"], r["n_chars"]) for r in twice) == [(1, 5), (3, 4), (3, 4), (3, 5)]


def test_very_long_texts(monkeypatch):
    monkeypatch.setattr(p, "STRETCH", 100)
    text = "".join(random.Random(1).choice("abc") for _ in range(1234))
    want = sorted({int(p.phrase_hashes(w, [w])[0]) for w in phrases(text, 100)})[: p.SIZE]
    assert list(p.hashes_of(p.fingerprint(text))) == want
    assert p.Parsed(text).edited("x" * 1000)[1] == p.fingerprint(text[: 1234 - 411] + "x" * 411)


def test_a_run_of_one_letter_takes_no_long():
    import time

    began = time.time()
    p.fingerprint("a" * 3_000_000)
    assert time.time() - began < 30


def test_columns(spark):
    frame = spark.createDataFrame([("one text", "one text"), (None, ""), ("one text", "quite another")], "a string, b string")
    near = [r[0] for r in frame.select(p.likeness(p.fingerprints("a"), p.fingerprints("b"))).collect()]
    assert near[:2] == [1.0, 1.0] and near[2] < 0.5


def test_the_estimate_is_close():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(3000))
    other = edited(text, text[::-1])
    a, b = phrases(text), phrases(other)
    assert abs(len(a & b) / len(a | b) - p.likeness_of(p.fingerprint(text), p.fingerprint(other))) < 0.13


def test_query(spark):
    rows = in_order([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_phrase_fingerprint"](spark, SF).collect()}
    assert len(got) == len(rows)
    for k, (key, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        r = got[key]
        changed = edited(text or "", following)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (p.fingerprint(text or ""), p.fingerprint(changed))
        assert r["near_next"] == p.likeness_of(r["fingerprint"], got[rows[(k + 1) % len(rows)][0]]["fingerprint"])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.97
