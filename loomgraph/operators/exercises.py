"""Masked exercises from records with steps and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as w


def step_exercises(steps: DataFrame, leaks: DataFrame, masks: DataFrame) -> DataFrame:
    """steps (doc, n, text), leaks (doc, n, leak), masks (doc, item, place) -> one exercise per masked step.

    (doc, place, n, question, answer, hidden): the hidden step and the later steps that name
    it are shown as ``[n] ???``.
    """
    also = leaks.groupBy("doc", "n").agg(F.collect_set("leak").alias("also"))
    own = masks.select("doc", F.col("item").alias("n"), "place").join(also, ["doc", "n"], "left")
    own = own.select("doc", F.col("n").alias("asked"), "place", F.concat(F.array("n"), F.coalesce("also", F.array().cast("array<int>"))).alias("hidden"))
    shown = own.join(steps, "doc").withColumn("line", F.when(F.array_contains("hidden", F.col("n")), F.concat(F.lit("["), F.col("n"), F.lit("] ???"))).otherwise(F.concat(F.lit("["), F.col("n"), F.lit("] "), F.col("text"))))
    g = shown.groupBy("doc", "place", "asked", "hidden").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"), F.max(F.when(F.col("n") == F.col("asked"), F.col("text"))).alias("answer"))
    question = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return g.select("doc", "place", F.col("asked").alias("n"), question.alias("question"), "answer", F.array_join(F.transform(F.array_sort("hidden"), lambda x: x.cast("string")), ",").alias("hidden"))


def symbol_exercises(symbols: DataFrame, statements: DataFrame, unique: DataFrame) -> DataFrame:
    """symbols (doc, item, symbol, meaning) -> exercises, symbols named in the statement first."""
    s = symbols.join(unique.select("doc", "item", F.col("n").alias("unique")), ["doc", "item"]).join(statements, "doc", "left").where("unique >= 2")
    named = F.coalesce(F.col("statement").contains(F.trim(F.substring_index("symbol", ",", 1))), F.lit(False))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(named), F.desc("unique"), F.desc("item")))
    return s.select("doc", place.alias("place"), "item", F.concat(F.lit("What does "), "symbol", F.lit(" stand for?")).alias("question"), F.col("meaning").alias("answer"))


def exercises_for(by_steps: DataFrame, by_symbols: DataFrame, limit: int = 3) -> DataFrame:
    """(doc, place, kind, question, answer): step exercises first, symbols fill up."""
    both = by_steps.select("doc", F.lit(0).alias("rank"), F.lit("step").alias("kind"), F.col("place").alias("p"), "question", "answer").unionByName(
        by_symbols.select("doc", F.lit(1).alias("rank"), F.lit("symbol").alias("kind"), F.col("place").alias("p"), "question", "answer")
    )
    place = F.row_number().over(Window.partitionBy("doc").orderBy("rank", "p"))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("doc", "place", "kind", "question", "answer")


def available(steps: DataFrame, minimum: int = 2) -> DataFrame:
    """(doc, n): maskable items of each record."""
    return w.unique_tokens(steps).where(F.col("n") >= minimum).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def worksheet(exercises: DataFrame) -> DataFrame:
    """(worksheet): one markdown text, questions numbered throughout, answers last."""
    # One learner's sheet: a few exercises, so a single ordering task is right.
    e = exercises.withColumn("no", F.row_number().over(Window.orderBy("doc", "place")))
    g = e.agg(F.array_sort(F.collect_list(F.struct("no", "question", "answer"))).alias("rows"))
    def listed(field):
        return F.array_join(F.transform("rows", lambda r: F.concat(r["no"].cast("string"), F.lit(". "), F.coalesce(r[field], F.lit("")))), "\n")
    return g.select(F.concat(F.lit("# Questions\n"), listed("question"), F.lit("\n# Answers\n"), listed("answer")).alias("worksheet"))
