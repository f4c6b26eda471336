"""Stages around a text generator: prompts, replies and candidate vocabularies.

The generator itself is a callable ``complete(prompt) -> str`` given by the caller; this
module calls no service.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.tables import Scratch
from . import reachability


class Dropped(RuntimeError):
    """Every provider has run out."""


class QuotaExhausted(RuntimeError):
    """One provider has run out."""


def complete_all(rows: DataFrame, complete: Callable[[str], str], prompt: str = "prompt", reply: str = "reply") -> DataFrame:
    """Adds the generator's reply to every prompt, in batches on the executors."""
    out = StructType([*rows.schema.fields, StructField(reply, StringType())])

    def run(parts):
        for pdf in parts:
            pdf[reply] = [None if p is None else complete(p) for p in pdf[prompt]]
            yield pdf

    return rows.mapInPandas(run, out)


def rotating(providers: list[Callable[[str], str]], tries: int = 3, pause: float = 1.0, sleeper: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """One generator of several: a provider that has run out is not asked again.

    A failure of the connection is tried again after growing pauses, then the next provider is asked.
    """
    spent: set[int] = set()

    def complete(prompt: str) -> str:
        for k, p in enumerate(providers):
            for again in range(tries):
                if k in spent:
                    break
                try:
                    return p(prompt)
                except QuotaExhausted:
                    spent.add(k)
                except OSError:
                    if again < tries - 1:
                        sleeper(pause * 2**again)
        raise Dropped("no provider is left")

    return complete


def json_of(reply: str) -> dict:
    """The JSON object of a reply: all of it, else from its first brace to its last; raises ValueError if there is none."""
    try:
        whole = json.loads(re.sub(r"(?m)^\s*```\w*\s*$", "", reply))
        if isinstance(whole, dict):
            return whole
    except json.JSONDecodeError:
        pass
    m = re.search(r"\{.*\}", reply, re.DOTALL)
    if not m:
        raise ValueError("no JSON object")
    return json.loads(m[0])


def candidate_vocabulary(edges: DataFrame, nodes: DataFrame, targets: DataFrame, trivial: tuple[str, ...] = (), few: int = 8, limit: int = 60) -> DataFrame:
    """(target, place, id): what a record may invoke, alphabetical.

    The closure of the target without trivial nodes; where that holds fewer than ``few``
    nodes, all concepts and techniques.
    """
    reach = reachability.pairs(edges, targets).select(F.col("src").alias("target"), F.col("dst").alias("id")).where(~F.col("id").cast("string").isin(*trivial) if trivial else F.lit(True))
    place = F.row_number().over(Window.partitionBy("target").orderBy("id"))
    # No more than these of a target are needed, be it for the list or to see that they are few.
    own = Scratch(edges.sparkSession, "vocabulary").save(reach.withColumn("place", place).where(F.col("place") <= max(few, limit)), "own")
    size = targets.select(F.col("id").alias("target")).distinct().join(own.groupBy("target").agg(F.count(F.lit(1)).alias("n")), "target", "left").na.fill(0, ["n"])
    wide = nodes.where("type in ('concept', 'technique')").select("id")
    small = size.where(F.col("n") < few).select("target")
    # Each small target takes the same list, whose first ``limit`` names are all that count.
    head = wide.orderBy("id").limit(limit + 1)
    widened = small.crossJoin(F.broadcast(head)).where("target <> id").withColumn("place", place)
    every = own.join(size.where(F.col("n") >= few).select("target"), "target", "left_semi").unionByName(widened)
    return every.where(F.col("place") <= limit).select("target", "place", "id")


def prompts(nodes: DataFrame, vocabulary: DataFrame, passages: DataFrame, budget: int = 24_000) -> DataFrame:
    """(id, prompt): a node's name, its vocabulary and its passages (id, place, text) within the budget."""
    v = vocabulary.groupBy(F.col("target").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("id").cast("string").alias("w")))), lambda x: x["w"]), ", ").alias("words"))
    w = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fit = passages.withColumn("spent", F.sum(F.length("text")).over(w)).where(F.col("spent") <= budget)
    t = fit.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("source"))
    j = nodes.join(v, "id", "left").join(t, "id", "left")
    return j.select("id", F.format_string("Subject: %s\nMay invoke: %s\nSource:\n%s", F.col("name"), F.coalesce("words", F.lit("-")), F.coalesce("source", F.lit("-"))).alias("prompt"))


def replies_to_rows(replies: DataFrame, schema: str) -> DataFrame:
    """(id, reply) -> (id, record, status): replies parsed by ``schema``; malformed ones are kept with their status."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    record = F.from_json(body, schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    r = replies.select("id", record.alias("record"), body.alias("body"))
    status = F.when(F.col("body") == "", "no object").when(F.col("record._corrupt_record").isNotNull(), "malformed").otherwise("ok")
    return r.select("id", "record", status.alias("status"))


def stub(answers: dict[str, str], default: str = "{}") -> Callable[[str], str]:
    """A deterministic generator for tests: the answer whose key the prompt holds."""

    def complete(prompt: str) -> str:
        return next((v for k, v in answers.items() if k in prompt), default)

    return complete


def describe(rows: pd.DataFrame) -> str:
    """Components as lines of a prompt: parameters that tell something first, matrices before them."""
    lines = []
    for name, own in rows.groupby("component", sort=True):
        telling = own.sort_values(by=["is_matrix", "name"], ascending=[False, True])
        lines.append(f"{name}: " + ", ".join(f"{n}={v}" for n, v in zip(telling["name"], telling["value"])))
    return "\n".join(lines)
