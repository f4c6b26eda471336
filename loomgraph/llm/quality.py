"""Quality classifier: a sparse ensemble of tree rules, compiled into column expressions.

Statistics of the whole text (see ``STATISTICS``) are Spark columns. Shallow trees are
grown on bootstraps of a bounded sample of labelled rows; every path from a root to a
node is a conjunctive rule over statistics. A lasso logistic regression over all rules
keeps few of them, and the kept rules with their weights become one column expression, so
scoring is part of the scan and no worker runs Python.

The sample: at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of the
doc_id, of the rows outside the held-out fold (crc32 of the doc_id as text, modulo 5, is
0). Labels, language, source and doc_id are no inputs of a score.

Defined cases: null and empty texts have zero statistics and get a score as any other; no
usable label, or labels of one class, give the smoothed base rate as the score of every
row; a document labelled twice counts twice; repeated rows are scored alike; null doc_ids
are scored and not held out; ``score`` replaces a column of the name given for the score
and touches no other, whatever it is called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import unused

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS = 30, 3, 24
MAX_RULES = 60
CUT = 0.3

STATISTICS = (
    "words", "mean_word", "distinct_words", "repeated_next", "distinct_lines", "words_per_line",
    "upper", "digits", "symbols", "pipes", "exclamations", "stops",
)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; ratios are of characters, words or lines, 0 for empty texts."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n_words = F.size(words)
    some_words = F.greatest(n_words, F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))

    def count(pattern):
        return F.regexp_count(t, F.lit(pattern))

    def of(c):
        return F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))

    return {
        "words": n_words.cast("double"),
        "mean_word": F.length(t) / some_words,
        "distinct_words": F.size(F.array_distinct(words)) / some_words,
        "repeated_next": count(r"(?<![^\x20\x0A])([^\x20\x0A]++)[\x20\x0A](?=\1(?![^\x20\x0A]))") / some_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "words_per_line": n_words / n_lines,
        "upper": count(r"\p{Lu}") / chars,
        "digits": count(r"[0-9]") / chars,
        "symbols": count(r"[^\p{L}\p{N}\s.,]") / chars,
        "pipes": of("|") / some_words,
        "exclamations": of("!") / some_words,
        "stops": of(".") / some_words,
    }


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


# -- fitting, on the bounded sample -----------------------------------------------------


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater?, bound) each


def _grow(x, y, rows, cuts, rng, depth, path, out):
    """Grows one tree on ``rows``; adds the rule of every node below the root to ``out``."""
    if depth == 0 or len(rows) < 20 or y[rows].min() == y[rows].max():
        return
    best = (1e-9, None, None)
    p = y[rows].mean()
    base = p * (1 - p)
    for f in rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]:
        for c in cuts[f]:
            right = x[rows, f] > c
            k = int(right.sum())
            if min(k, len(rows) - k) < 5:
                continue
            a, b = y[rows[right]].mean(), y[rows[~right]].mean()
            gain = base - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
            if gain > best[0]:
                best = (gain, int(f), float(c))
    if best[1] is None:
        return
    _, f, c = best
    for greater in (False, True):
        rule = (*path, (f, greater, c))
        out.append(rule)
        own = rows[(x[rows, f] > c) == greater]
        _grow(x, y, own, cuts, rng, depth - 1, rule, out)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, c in rule:
        out &= (x[:, f] > c) == greater
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (np.linalg.norm(z.T @ z, 2) / n + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        nw = v - step * (z.T @ (p - y) / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * float((p - y).mean())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            s += weight * holds(rule, x)
        return 1 / (1 + np.exp(-s))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 17) -> RuleEnsemble:
    """A rule ensemble for rows of STATISTICS and labels 0 or 1."""
    n = len(y)
    if not n or y.min() == y.max():
        p = (y.sum() + 1) / (n + 2)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, BINS))) for f in range(x.shape[1])]
    classes = [np.flatnonzero(y == k) for k in (0, 1)]
    found: list[Rule] = []
    for _ in range(TREES):
        each = min(2000, max(len(c) for c in classes))
        rows = np.concatenate([rng.choice(c, min(each, 4 * len(c))) for c in classes])  # both classes count alike
        _grow(x, y, rows, cuts, rng, DEPTH, (), found)
    z, kept, seen = [], [], set()
    for rule in sorted(set(found), key=lambda r: (len(r), r)):
        h = holds(rule, x)
        key = h.tobytes()
        if 0.002 <= h.mean() <= 0.998 and key not in seen:
            seen.add(key)
            kept.append(rule)
            z.append(h)
    if not kept:
        p = (y.sum() + 1) / (n + 2)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    z = np.array(z, np.float64).T
    mean, sd = z.mean(axis=0), z.std(axis=0)
    for penalty in (0.002, 0.004, 0.008, 0.016, 0.032, 0.064):
        w, b = lasso((z - mean) / sd, y, penalty)
        if (np.abs(w) > 1e-6).sum() <= MAX_RULES:
            break
    top = [k for k in np.argsort(-np.abs(w))[:MAX_RULES] if abs(w[k]) > 1e-6]
    raw = w / sd
    return RuleEnsemble([kept[k] for k in top], [float(raw[k]) for k in top], float(b - sum(raw[k] * mean[k] for k in top)))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the bounded sample, on the driver."""
    order = F.xxhash64("doc_id")
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("_label"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("doc_id")))
    # A hash bound that about twice the wanted rows pass leaves tasks little to order and send.
    own = own.where(F.pmod(order, F.lit(max(1, own.count()))) < 2 * rows).orderBy(order, "_label").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    joined = texts.join(F.broadcast(own), "doc_id")  # at most ``rows`` rows of two numbers
    s = statistics(F.col("_text"))
    table = joined.select(order.alias("_order"), "doc_id", "_label", *(s[k].alias(k) for k in STATISTICS)).orderBy("_order", *STATISTICS, "_label").limit(rows).toPandas()
    return table[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), table["_label"].to_numpy(float)


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score added under ``name``."""
    s = statistics(F.col(text_col))
    own = unused(docs, "statistics")[0]
    nested = docs.withColumn(own, F.struct(*(s[k].alias(k) for k in STATISTICS)))
    names = {k: F.col(f"{own}.{k}") for k in STATISTICS}
    return nested.withColumn(name, compiled(model, names)).drop(own)


def compiled(model: RuleEnsemble, names: dict[str, Column]) -> Column:
    """The score as one expression over columns of the statistics."""
    total = F.lit(float(model.intercept))
    for rule, weight in zip(model.rules, model.weights):
        holds_ = F.lit(True)
        for f, greater, c in rule:
            own = names[STATISTICS[f]]
            holds_ = holds_ & ((own > c) if greater else (own <= c))
        total = total + F.when(holds_, F.lit(float(weight))).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    return fit(*sample(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    own = unused(docs, "score")[0]
    return score(docs, train(docs, labels), name=own).where(F.col(own) >= cut).drop(own)


def op4_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
