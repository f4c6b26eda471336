"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``; the last returns the pieces of the packed documents.
"""

from __future__ import annotations

import public_tokenizers

from loomgraph.llm import exact_dedup, minhash, packing, quality, secret_scan
from loomgraph.sources.tables import Scratch

#: A rule ensemble, MinHash and two tokenizers are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labelled ones, rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark, docs, sf_dir):
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def minhash_stage(spark, docs, sf_dir):
    """Of each group of near-duplicates (five words, 0.8 or more) one document stays."""
    return minhash.deduplicate(docs, percent=80)


def secret_stage(spark, docs, sf_dir):
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact_documents(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents with their sequences and offsets."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", minhash_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
