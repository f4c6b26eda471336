"""op13 and its operator against every edit that is possible."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomgraph.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
GAPS = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        words = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def brute(rows):
    """The least (cost, audit, turns) of all edits, with up to two inserts at a place."""
    marks = faults(rows)
    best = None
    for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
        for edits in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, turns = 0, "", []
            for k in range(len(rows) + 1):
                for g in gaps[k]:
                    cost, audit = cost + 5, audit + "I"
                    turns.append((NAMES[g], ""))
                if k == len(rows):
                    break
                (role, text), edit = rows[k], edits[k]
                if edit == "D":
                    cost, audit = cost + 2, audit + "D"
                    continue
                if marks[k] in ("blank", "duplicate"):
                    break
                cost += (5 if marks[k] == "truncated" else 0) + (edit != "K")
                audit += "K" if edit == "K" else "R"
                turns.append((role if edit == "K" else NAMES[edit], text))
            else:
                raise AssertionError
            if k < len(rows) or not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "_" for r, _ in turns)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, turns)
    return best


def test_repair_is_the_cheapest(spark):
    rng = random.Random(7)
    talks = {k: [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", " "]), rng.choice(["One.", "Two!", "cut", "cut", " ", "Why?\n", "end. \t"])) for _ in range(rng.randrange(1, 4))] for k in range(120)}
    rows = [(k, n, role, text) for k, talk in talks.items() for n, (role, text) in enumerate(talk)]
    got = {r["conv_id"]: r for r in c.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, talk in talks.items():
        cost, audit, turns = brute(talk)
        r = got[k]
        assert (r["cost"], r["audit"], [tuple(t) for t in r["repaired"]]) == (cost, audit, turns), talk
        marks = faults(talk)
        assert [r["blank"], r["duplicate"], r["truncated"]] == [marks.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))


def test_damage(spark):
    text = "One. Two! Three?"
    rows = [(k, n, "assistant", text) for k in range(40) for n in range(5)]
    got = c.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for k, n, role, _ in rows:
        kind = zlib.crc32(f"{k}:{n}".encode()) % 20
        row = (k, n, "user" if kind == 4 else role, {1: "", 2: "One Two Three"}.get(kind, text))
        want += [(*row, copy, kind != 0) for copy in ([1, 2] if kind == 3 else [1])]
    assert sorted(map(tuple, got)) == sorted(want) and {r["here"] for r in got} == {True, False}


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "First."), (1, None, "user", "First."), (1, 9, "assistant", "Nine."), (1, 4, None, None),
        (None, 1, "user", "Hm."), (None, 2, "assistant", "Yes."),
        (2, None, "user", "x"), (3, 5, "user", "Long. " * 200_000), (3, 8, "assistant", "So."),
    ]
    frame = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", fault string")
    got = {r["conv_id"]: r for r in c.repair(frame).collect()}
    assert set(got) == {1, 2, 3, None}
    first = got[1]
    assert (first["gaps"], first["blank"], first["duplicate"], first["illegal"]) == (4, 1, 1, 3) and first["audit"] == "KDDK" and first["cost"] == 4
    assert got[None]["audit"] == "KK" and got[None]["cost"] == 0
    assert (got[2]["audit"], got[2]["cost"], got[2]["gaps"], got[2]["repaired"]) == ("D", 2, 0, [])
    assert (got[3]["audit"], got[3]["gaps"]) == ("KK", 2) and len(got[3]["repaired"][0]["text"]) == 1_200_000
    assert c.repair(frame.limit(0)).count() == 0


def test_a_conversation_without_rows_left(spark, tmp_path):
    pair = next((k, n) for k in range(1000) for n in range(3) if zlib.crc32(f"{k}:{n}".encode()) % 20 == 0)
    spark.createDataFrame([(*pair, "user", "Gone.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = c.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert row.asDict() == {"conv_id": pair[0], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


@pytest.mark.parametrize("turns", [2000])
def test_a_long_conversation(spark, turns):
    rows = [(1, n, "user" if n % 2 else "assistant", f"Turn {n}.") for n in range(turns)]
    (row,) = c.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert row["audit"] == "D" + "K" * (turns - 2) + "D" and row["cost"] == 4 and len(row["repaired"]) == turns - 2
