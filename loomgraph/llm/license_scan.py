"""Licence scan: a trained paragraph classifier confirmed by template comparison.

A logistic regression over sparse word n-grams (words and word pairs), one against the rest
for each family, is trained here, on the driver, from notices and sentences of licence
bodies (``TEMPLATES``) in noisy variants, from pairs of notices of different families, and
from paragraphs that are none: invented prose, sentences that use the same words otherwise,
and a bounded sample of corpus paragraphs without licence words. Since every family has a
score of its own, a window may hold several (dual licences). Scores are calibrated by a
temperature fitted across folds of the templates: a fold's variants are scored by a model
that has seen neither them nor their templates. A window in which no family reaches
``MIN_PROBABILITY`` is of the unknown class, whose probability is that of none of them. A
prediction counts only if the window also contains most of the word pairs of one of the
family's templates, no negation stands right before them and nothing is "reserved for". Only
n-grams with a word of the vocabulary are features, so a text without any such word is
unknown throughout and is skipped after one look at its words.

Identifiers of licence expressions (``SPDX-License-Identifier: (MIT OR Apache-2.0) AND
BSD-3-Clause``, ``License: MPL-2.0``) are parsed in front; each adds two words of its own to
its line, which are features and a template like others.

A paragraph is a run of lines that are not blank; marks of comments at the line's start
count as blanks, so a wrapped notice in a source file is one paragraph. It is classified in
windows of ``WINDOW`` words, each ``STRIDE`` after the last, so that every run of
``WINDOW - STRIDE`` words lies in one of them and long paragraphs are read whole. A span
reaches from the first to the last line that the confirmed words touch; overlapping spans
of one family are one. Spans are code points, end exclusive.

Defined cases: null and empty texts have no licence; texts are scanned whole, paragraphs
and lines of any length; repeated rows are scanned each; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by which licences are commonly stated, by family.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license", "spdx license identifier mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "dual licensed under the mit license", "or the mit license", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "distributed under the terms of the mit license", "code is mit licensed", "mit licensed", "or the mit license license mit or http opensource.org licenses mit at your option"],
    "apache": ["licensed under the apache license version 2.0", "apache license version 2.0", "you may not use this file except in compliance with the license", "spdx license identifier apache 2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "and the apache license version 2.0", "released under the apache license", "licensed under apache 2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "gnu general public license", "under the terms of the gnu general public license as published by the free software foundation", "gpl version 2", "licensed under the gpl v3", "spdx license identifier gpl 3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "released under gpl v3", "released under the gpl", "gnu gpl v2 or later", "gnu gpl version 3", "distributed under the gpl", "licensed under gpl v2", "available under the gpl v3"],
    "lgpl": ["gnu lesser general public license", "licensed under the lgpl", "under the terms of the gnu lesser general public license", "spdx license identifier lgpl 2.1", "released under lgpl v3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lgpl v2.1 or later", "gnu library general public license", "available under the lgpl v3"],
    "agpl": ["gnu affero general public license", "licensed under the agpl", "under the terms of the gnu affero general public license", "released under agpl v3", "gnu agpl v3 or later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "bsd 3 clause license", "bsd 2 clause license", "licensed under the bsd license", "use of this source code is governed by a bsd style license", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "released under the bsd license", "new bsd license", "distributed under the bsd license", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"],
    "mpl": ["mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license", "licensed under the mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0", "subject to the terms of the mozilla public license v 2.0", "released under the mozilla public license"],
    "cc-by": ["licensed under cc by 4.0", "creative commons attribution 4.0 international license", "licensed under a creative commons attribution license", "released under cc by 4.0", "creative commons attribution 3.0 unported license"],
    "cc-by-sa": ["licensed under cc by sa 4.0", "creative commons attribution sharealike license", "available under the creative commons attribution share alike license", "creative commons attribution sharealike 4.0 international license", "creative commons attribution share alike 3.0 license", "released under cc by sa 3.0"],
    "cc-by-nc": ["licensed under cc by nc 4.0", "creative commons attribution noncommercial license", "creative commons attribution non commercial 4.0 international", "released under cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"],
    "cc-by-nd": ["licensed under cc by nd 4.0", "creative commons attribution noderivatives license", "creative commons attribution no derivatives 4.0 license", "creative commons attribution noderivatives 4.0 international"],
    "cc0": ["cc0 1.0 universal", "dedicated to the public domain under cc0", "to the extent possible under law the author has waived all copyright and related rights", "released under cc0", "creative commons zero", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license", "released under the isc license", "the software is provided as is and the author disclaims all warranties with regard to this software"],
    "epl": ["eclipse public license version 2.0", "eclipse public license", "made available under the terms of the eclipse public license", "spdx license identifier epl 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "licensed under the epl 2.0"],
    "eupl": ["european union public licence version 1.2", "european union public licence", "licensed under the eupl", "licensed under the european union public licence"],
    "zlib": ["zlib license", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "licensed under the zlib license", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "boost": ["boost software license version 1.0", "distributed under the boost software license", "boost software license", "see accompanying file license 1 0.txt or copy at http www.boost.org license 1 0.txt"],
    "artistic": ["artistic license 2.0", "under the terms of the artistic license", "same terms as perl the artistic license", "licensed under the artistic license"],
    "cddl": ["common development and distribution license", "subject to the terms of the common development and distribution license", "licensed under the cddl"],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission"],
}
#: How identifiers of licence expressions begin, by family; the longest beginning counts.
IDENTIFIERS = {
    "mit": ("mit", "x11"), "apache": ("apache-",), "gpl": ("gpl-", "gplv"), "lgpl": ("lgpl-", "lgplv"), "agpl": ("agpl-", "agplv"), "bsd": ("bsd-", "0bsd"), "mpl": ("mpl-",),
    "cc-by": ("cc-by-",), "cc-by-sa": ("cc-by-sa-",), "cc-by-nc": ("cc-by-nc-",), "cc-by-nd": ("cc-by-nd-",), "cc0": ("cc0-",), "unlicense": ("unlicense",), "isc": ("isc",),
    "epl": ("epl-",), "eupl": ("eupl-",), "zlib": ("zlib",), "boost": ("bsl-",), "artistic": ("artistic-",), "cddl": ("cddl-",),
}
#: Families that share most of their words; pairs of them are no training examples.
KIN = ({"gpl", "lgpl", "agpl"}, {"cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc0"})
#: Sentences that use the same words and state no licence.
NEGATIVES = [
    "the driver had no license with her", "a licensed nurse was released from work", "general elections are public", "the apache tribe lived here", "he studied at mit in cambridge",
    "under the terms of the treaty", "free of charge for any person", "the software was published in version 2.0", "version 3 of the draft was released", "the commons voted on creative uses",
    "copies of this source are rare", "public attribution of the work", "please reserve all rights to speak", "license plates are issued by the state", "the gnu grazed by the river",
    "mozilla and other animals", "by nature and by night", "a general public library", "this work is under way", "the permission was granted without fee", "all rights reserved for the mayor", "all rights were reserved for members of the club", "all rights reserved for use by the tenants",
    "the eclipse was visible to the public", "the european union has a public office", "an artistic distribution of common goods", "boost the development of software",
]
STOP = frozenset("a an the of to in is are and or by for this that with without any as may you not be from under on at it".split())
UNKNOWN = "unknown"
MIN_PROBABILITY = 0.6
MIN_CONTAINED = 0.6
#: Words of a window and between the beginnings of windows.
WINDOW, STRIDE = 48, 16
NEGATIONS = frozenset("not never nor isn wasn cannot no longer".split())
#: Corpus paragraphs in the training set, and characters of each, at most; longer ones are no examples.
SAMPLE_PARAGRAPHS = 1000
SAMPLE_CHARACTERS = 2000
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: A licence's short name and version in one word.
_VERSIONED = re.compile(r"([al]?gpl|mpl|epl|cddl|apache)(v?)([0-9][0-9.]*)")
_EXPRESSION = re.compile(r"""(?:spdx-license-identifier|\blicen[sc]e(?:-expression)?["']?)[ \t]*[:=][ \t]*["']?([a-z0-9.+() \t-]+)""")
_TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*")
#: The word before an identifier's own word.
TAG = "licenceid"


def identified(term: str) -> str | None:
    """The family of an identifier in lower case; it is a whole name or goes on with a version or variant."""
    found = [(len(b), f) for f, begins in IDENTIFIERS.items() for b in begins if term == b or term.startswith(b) and (b[-1] in "-v" or term[len(b)] in "-+")]
    return max(found)[1] if found else None


def tokens(low: str, begin: int, end: int):
    """(word, its span) of a line in lower case; versioned names are two words, identifiers add two after the line's."""
    for m in _WORD.finditer(low, begin, end):
        split = _VERSIONED.fullmatch(m[0])
        if split:
            yield split[1], m.span()
            yield (split[2] or "") + split[3], m.span()
        else:
            yield m[0], m.span()
    expression = _EXPRESSION.search(low, begin, end) if low.find("licen", begin, end) >= 0 else None
    if not expression:
        return
    skip = False  # the exception after WITH
    for m in _TERM.finditer(low, *expression.span(1)):
        family = identified(m[0])
        if m[0] == "with" or skip:
            skip = m[0] == "with"
        elif family:
            yield TAG, m.span()
            yield own_word(family), m.span()


def own_word(family: str) -> str:
    return "id" + family.replace("-", "")


def words_of(text: str) -> list[str]:
    low = text.lower()
    return [w for w, _ in tokens(low, 0, len(low))]


for _family in IDENTIFIERS:
    TEMPLATES[_family].append(f"{TAG} {own_word(_family)}")
ANCHORS = frozenset(w for ts in TEMPLATES.values() for t in ts for w in words_of(t)) - STOP
#: A text with none of these is of the unknown class: every template holds one.
MARKS = frozenset(
    "license licensed licence licenced mit apache gpl lgpl agpl gnu bsd mpl mozilla cc cc0 commons unlicense isc copyright rights permission permitted redistribution redistributions spdx unencumbered domain compliance waived eupl epl eclipse zlib cddl altered warranty warranties licenceid".split()
)
_MARK = re.compile(r"\b(?:" + "|".join(sorted(MARKS)) + r")(?:v?[0-9][0-9.]*)?\b", re.ASCII)
#: Marks of comments at the beginning of a line, and what makes a line blank.
_COMMENT = re.compile(r"[ \t\r\f\v]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+|>+|\"{3}|'{3}|(?:rem|dnl)\b)[ \t\r\f\v]*)*", re.IGNORECASE)


def grams(words: list[str]) -> set[str]:
    """Words and word pairs that hold an anchor."""
    out = {w for w in words if w in ANCHORS}
    out.update(f"{a} {b}" for a, b in zip(words, words[1:]) if a in ANCHORS or b in ANCHORS)
    return out


class LicenceModel:
    def __init__(self, vocabulary: dict[str, int], families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.vocabulary, self.families, self.weights, self.bias, self.temperature = vocabulary, families, weights, bias, temperature
        self.pairs = {f: [set(zip(w, w[1:])) for t in TEMPLATES[f] if len(w := words_of(t)) > 1] for f in families}

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of each family, whatever the others."""
        at = [k for g in grams(words) if (k := self.vocabulary.get(g)) is not None]
        return 1 / (1 + np.exp(-(self.bias + self.weights[at].sum(axis=0)) / self.temperature))

    def classify(self, text: str) -> tuple[str, float]:
        """(likeliest confirmed family or unknown, probability) of a short paragraph."""
        words = words_of(text)
        found = self.judge(words)
        if found:
            family, p, _ = max(found, key=lambda f: f[1])
            return family, p
        return UNKNOWN, 1.0 if MARKS.isdisjoint(words) else float(np.prod(1 - self.probabilities(words)))

    def judge(self, words: list[str]) -> list[tuple[str, float, tuple[int, int]]]:
        """(family, probability, first and last word of the template) of all confirmed families of a window."""
        if MARKS.isdisjoint(words):
            return []
        p = self.probabilities(words)
        likely = np.flatnonzero(p >= MIN_PROBABILITY)
        if not len(likely):
            return []
        own = list(zip(words, words[1:]))
        have = set(own)
        out = []
        for k in likely:
            best = max(self.pairs[self.families[k]], key=lambda t: (len(have & t) / len(t), len(t)))
            if len(have & best) < MIN_CONTAINED * len(best):
                continue
            at = [i for i, x in enumerate(own) if x in best]
            reserved_for = words[at[-1] + 1 : at[-1] + 3] == ["reserved", "for"]  # kept for somebody, no notice
            if not reserved_for and NEGATIONS.isdisjoint(words[max(0, at[0] - 2) : at[0]]):
                out.append((self.families[k], float(p[k]), (at[0], at[-1] + 1)))
        return out

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(family, start, end, probability) of every licence notice, by start, then family."""
        if not text or not _MARK.search(text.lower()):
            return []
        out = []
        for words, places in paragraphs(text):
            last: dict[str, list] = {}
            for at in range(0, max(1, len(words) - STRIDE), STRIDE):
                for family, p, (a, z) in self.judge(words[at : at + WINDOW]):
                    start = text.rfind("\n", 0, places[at + a][0]) + 1
                    end = text.find("\n", places[at + z][1])
                    end = len(text) if end < 0 else end
                    before = last.get(family)
                    if before and start <= before[2]:
                        before[1:] = min(before[1], start), max(before[2], end), max(before[3], p)
                    else:
                        last[family] = [family, start, end, p]
                        out.append(last[family])
        return sorted((tuple(f) for f in out), key=lambda f: (f[1], f[0]))


def paragraphs(text: str):
    """(words, their spans) of every run of lines that are not blank and hold a word of MARKS."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow in lower case; only ASCII counts here
        low = "".join(c.lower() if c.isascii() else c for c in text)
    words: list[str] = []
    places: list[tuple[int, int]] = []
    at, end = 0, len(text)
    while at <= end:
        stop = text.find("\n", at)
        stop = end if stop < 0 else stop
        begin = _COMMENT.match(low, at, stop).end()
        if begin >= stop or not low[begin:stop].strip():
            if words and not MARKS.isdisjoint(words):
                yield words, places
            words, places = [], []
        else:
            for word, place in tokens(low, begin, stop):
                words.append(word)
                places.append(place)
        at = stop + 1
    if words and not MARKS.isdisjoint(words):
        yield words, places


def _variants(rng, sentence: str, filler: list[str], n: int) -> list[list[str]]:
    words = words_of(sentence)
    out = [words]
    for _ in range(n - 1):
        own = [w for w in words if rng.random() > 0.06] if len(words) > 4 else list(words)
        pre = list(rng.choice(filler, rng.integers(0, 12)))
        post = list(rng.choice(filler, rng.integers(0, 12)))
        out.append([*pre, *own, *post])
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a regression for each column of y by accelerated gradient steps; a family's examples weigh as much as a fifth of the rest."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    share = y.mean(axis=0)
    weight = np.where(y > 0, 0.2 * (1 - share) / np.maximum(share, 1e-9), 1).astype(np.float32)
    v, vb = w.copy(), b.copy()
    for r in range(rounds):
        g = (1 / (1 + np.exp(-(x @ v + vb))) - y) * weight / len(y)
        nw, nb = v - STEP * (x.T @ g + ridge * v), vb - STEP * g.sum(axis=0)
        m = r / (r + 3)
        v, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


#: Length of a gradient step; a row has some tens of n-grams.
STEP = 0.5


def train(paragraphs: list[str] = (), seed: int = 5, rounds: int = 400, ridge: float = 2e-5, folds: int = 3) -> LicenceModel:
    """The classifier; ``paragraphs`` are further examples of no family."""
    rng = np.random.default_rng(seed)
    parts = ["an", "the", "er", "ti", "on", "of", "re", "sh", "lo", "ma", "de", "qu", "is", "and", "ing"]
    filler = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(400)] + sorted(STOP)
    families = list(TEMPLATES)
    examples: list[tuple[list[str], tuple[str, ...], int]] = []  # words, families, fold of the template

    def add(texts, own, n, before=()):
        for fold, t in enumerate(texts):
            examples.extend(([*before, *w], own, fold % folds) for w in _variants(rng, t, filler, n))

    for f in families:
        add(TEMPLATES[f], (f,), 14)
        add([t for t in TEMPLATES[f] if t.startswith(("licensed", "released", "under", "available", "distributed"))], (), 3, ("not",))
    add(NEGATIVES, (), 24)
    add(sorted(ANCHORS - {TAG} - {own_word(f) for f in IDENTIFIERS}), (), 2)  # a single word is no notice
    for _ in range(3000):
        f, g = rng.choice(families, 2, replace=False)
        if not any({f, g} <= kin for kin in KIN):
            i, j = (int(rng.integers(len(TEMPLATES[k]))) for k in (f, g))
            if i % folds == j % folds:
                one, two = (_variants(rng, TEMPLATES[k][n], filler, 2)[1] for k, n in ((f, i), (g, j)))
                examples.append(([*one, *two], (f, g), i % folds))
    examples += [(list(rng.choice(filler, rng.integers(3, 30))), (), i % folds) for i in range(300)]
    examples += [(words_of(p), (), i % folds) for i, p in enumerate(paragraphs) if MARKS.isdisjoint(words_of(p))]
    vocabulary: dict[str, int] = {}
    sparse = [[vocabulary.setdefault(g, len(vocabulary)) for g in grams(w)] for w, _, _ in examples]
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for i, at in enumerate(sparse):
        x[i, at] = 1
    y = np.zeros((len(examples), len(families)), np.float32)
    for i, (_, own, _) in enumerate(examples):
        y[i, [families.index(f) for f in own]] = 1
    fold = np.array([f for _, _, f in examples])
    keep = x.sum(axis=0) >= 3
    place = np.cumsum(keep) - 1
    vocabulary = {g: int(place[k]) for g, k in vocabulary.items() if keep[k]}
    x = x[:, keep]
    scores, truth = [], []
    for f in range(folds):
        w, b = _fit(x[fold != f], y[fold != f], rounds // 3, ridge)
        scores.append(x[fold == f] @ w + b)
        truth.append(y[fold == f])
    z, own = np.concatenate(scores), np.concatenate(truth)
    best = (np.inf, 1.0)
    for t in np.linspace(0.3, 3, 28):
        q = z / t
        loss = (np.logaddexp(0, q) - own * q).mean()
        best = min(best, (float(loss), float(t)))
    w, b = _fit(x, y, rounds, ridge)
    return LicenceModel(vocabulary, families, w, b, best[1])


def sample_paragraphs(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """A bounded sample of distinct corpus lines from anywhere in the texts, those of the smallest hash.

    A hash bound that about twice the wanted rows pass comes first, by an estimate of the
    number of distinct lines, so that tasks have little to order and send; if too few pass,
    all of them are ordered.
    """
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line"))
    lines = lines.where((F.trim("line") != "") & (F.length("line") <= SAMPLE_CHARACTERS)).withColumn("h", F.xxhash64("line"))
    n = lines.agg(F.approx_count_distinct("h")).first()[0]
    few = lines.where(F.pmod("h", F.lit(max(n, 1))) < 2 * rows).select("line", "h").distinct()
    found = few.orderBy("h", "line").limit(rows).collect()
    if len(found) < min(rows, n // 2):
        found = lines.select("line", "h").distinct().orderBy("h", "line").limit(rows).collect()
    return [r["line"] for r in found]


@lru_cache(1)
def _base_model() -> LicenceModel:
    return train()


def scan_documents(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``licences``, an array of (family, start, stop, probability)."""
    model = model or _base_model()
    spans = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred n-grams and their weights

    def run(batches):
        m = shared.value
        for b in batches:
            for part in range(0, b.num_rows, 512):
                x = b.slice(part, 512)
                found = [[dict(zip(("family", "start", "stop", "probability"), s)) for s in m.scan(t)] for t in x.column(1).to_pylist()]
                yield pa.record_batch([x.column(0).cast(pa.int64()), pa.array(found, spans)], names=["id", "licences"])

    out = "id long, licences array<struct<family:string,start:long,stop:long,probability:double>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out).withColumnRenamed("id", id_col)


def op8_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_documents(docs, train(sample_paragraphs(docs)))
    best = F.array_max(F.transform("licences", lambda s: F.struct(s.probability, s.family)))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda s: s.family))), ",").alias("families"),
        F.round(best.probability, 6).alias("best_probability"),
        F.array_join(F.transform("licences", lambda s: F.concat_ws(":", s.family, s.start.cast("string"), s.stop.cast("string"))), ",").alias("spans"),
    )
