"""Which of many terms a text holds, by one automaton over all of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The automaton that this worker used last, by the name of its terms.
_LAST: dict = {}


def _automaton(name: str, terms: tuple[str, ...]):
    """The Aho-Corasick automaton of the terms; a worker makes it once for all its tasks."""
    if name not in _LAST:
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in terms:
            found.add_word(term, term)
        found.make_automaton()
        _LAST.clear()
        _LAST[name] = found
    return _LAST[name]


def terms_in(spark: SparkSession, text: str, terms: list[str]) -> Column:
    """The different terms (not empty) that a text column holds as substrings, in order; each text is read once."""
    if not terms:
        return F.array().cast("array<string>")
    sent, name = spark.sparkContext.broadcast(tuple(terms)), uuid.uuid4().hex

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(name, sent.value)
        for part in texts:
            yield pd.Series([sorted({term for _, term in automaton.iter(x)}) if x else [] for x in part], dtype=object)

    return found(F.col(text))
