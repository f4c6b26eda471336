"""The queries on the smallest tables, against SQL or brute force."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest

from loomgraph.llm import quality, queries
from tools import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert compare.rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == compare.rows_of(columns, cursor.fetchall())


def test_op1(spark, docs):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: grams(t) for i, t in docs.items()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows(spark, "op1_minhash_near_dedup")}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_op4(spark, docs):
    """Every score again from the trained rules by plain Python over the collected statistics."""
    import math

    from pyspark.sql import functions as F

    frame, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    labels = {r["doc_id"]: r["quality"] for r in marks.collect()}
    model = quality.train(frame, marks)
    stats = quality.statistics(F.col("text"))
    table = {r["doc_id"]: r for r in frame.select("doc_id", *(stats[k].alias(k) for k in quality.STATISTICS)).collect()}
    got = {r["doc_id"]: r for r in rows(spark, "op4_quality_classifier")}
    assert set(got) == set(docs)
    for i, r in got.items():
        total = model.intercept
        for rule, weight in zip(model.rules, model.weights):
            if all((table[i][quality.STATISTICS[f]] > c) == greater for f, greater, c in rule):
                total += weight
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3)
    held = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.9 * len(held)


def test_op5(spark, docs):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(spark, "op5_byte_bpe")}
    for i, t in docs.items():
        ids = enc.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op8(spark, docs):
    """Against a plain search for the notices that the tables hold, line by line."""
    notices = {"cc-by-nc": "licensed under cc by-nc 4.0.", "gpl": "licensed under the gnu general public license, version 3.", "apache": "licensed under the apache license, version 2.0.", "mit": "released under the mit license.", "proprietary": "all rights reserved."}
    got = rows(spark, "op8_license_scan")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    seen = Counter()
    for r in got:
        text, at, want = docs[r["doc_id"]], 0, []
        for line in text.split("\n"):
            want += [(at, f, at + len(line)) for f, phrase in notices.items() if phrase in line.lower()]
            at += len(line) + 1
        merged = []
        for start, family, end in sorted(want):
            before = next((m for m in merged if m[1] == family and start <= m[2]), None)
            if before:
                before[2] = max(before[2], end)
            else:
                merged.append([start, family, end])
        assert r["spans"] == ",".join(f"{f}:{a}:{b}" for a, f, b in merged), (r["doc_id"], merged)
        assert r["n_paragraphs"] == len(merged) and r["families"] == ",".join(sorted({m[1] for m in merged}))
        seen.update(m[1] for m in merged)
    assert len(seen) >= 4


def test_op9(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, lengths = Counter(), []
    for i, t in docs.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            lengths.append(len(part))
            want[(i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got = rows(spark, "op9_best_fit_packing")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        place = 0
        for at, n in sorted(parts):
            assert at == place
            place += n
        assert place <= 4096
    assert len(fill) <= -(-sum(lengths) // 4096) + 2


def test_op10(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in rows(spark, "op10_secret_scan"):
        t = docs[r["doc_id"]]
        a = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 8]
        b = [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        h = [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = sorted(a + b + h, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        text = ",".join(f"{k}:{x}:{y}" for k, x, y in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (len(a), len(b), len(h), hashlib.sha256(text.encode()).hexdigest())
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_queries_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "embeddings", "pages", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, f"file://{tmp_path}").count() == 0, name
