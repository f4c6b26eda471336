"""The pipeline's stages, each against a brute-force version on its own input."""

import struct
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from loomgraph.llm import exact_dedup, minhash, quality, queries, secret_scan

SF = "/root/testdata/sf0.001"


def test_the_registered_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "secret scans", "best-fit packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{k}")
        docs = spark.read.parquet(f"file://{folder}/{k}")
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_columns_stay(stages):
    for _, _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_what_scores_well(spark, stages):
    _, before, after, _ = stages[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if scores[r["doc_id"]] >= 0.3)


def test_exact_stage(stages):
    import re

    _, before, after, _ = stages[1]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())


def test_minhash_stage(stages):
    _, before, after, _ = stages[2]
    sets = {r["doc_id"]: set(minhash.shingles(r["text"]).tolist()) for r in before}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert sorted(r["doc_id"] for r in after) == [i for i in ids if root[i] == i]


def test_secret_stage(stages):
    _, before, after, _ = stages[3]
    got = {r["doc_id"]: r["text"] for r in after}
    assert got == {r["doc_id"]: secret_scan.redact(r["text"]) for r in before}
    assert not any(secret_scan.scan(t) for t in got.values())


def test_packing_stage(stages):
    _, before, after, _ = stages[4]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], k // 4096, k, len(part := ids[k : k + 4096]), zlib.crc32(struct.pack(f"<{len(part)}I", *part))) for k in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == sorted(want)
    fill = {}
    for r in after:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        place = 0
        for at, n in sorted(parts):
            assert at == place
            place += n
        assert place <= 4096
    assert len(fill) <= -(-sum(r["length"] for r in after) // 4096) + 2


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_exact_query_agrees_with_the_stage(spark, stages):
    docs = spark.createDataFrame(stages[1][1])
    kept = exact_dedup.exact_groups(docs).where("kept").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in stages[1][2])
