"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates.

A text is cut into paragraphs at blank lines; the lines of a paragraph are joined, without indentation and
comment marks, so that wrapping does not matter. A paragraph is scanned by its sentences, and a sentence
over WINDOW words by overlapping windows of so many. Features are the words and word pairs of the templates
that a window holds (once or more alike); a softmax regression, trained in numpy on altered template
sentences within ordinary words and on ordinary sentences, gives each window a probability for each licence
family and for "unknown". The probabilities are calibrated by one temperature on held-out altered sentences.
A paragraph names a family when one of its windows has a probability of at least `least` for it and holds at
least `share` of the word pairs of one of the family's sentences, in their order.

The model is fitted on the driver from the sentences below, a fixed few hundred features, and broadcast.
Every window of every text is classified, whole.

Defined results: a null or empty text has no licence (families is an empty array, license null). Ties
between families go to the first by name. Repeated rows give equal rows. Columns of other names pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table, text_of

EDGE = ".,;:!?|()[]{}<>\"'`*#$%&_"
UNKNOWN = "unknown"
#: Words in a window of a long sentence; windows start at every half of it.
WINDOW = 64
#: Marks that begin a line of a comment or a quotation.
PREFIX = r"(\A|\n)[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|--+|%+|>+|<!--+)[ \t]*)*"

# Licence families and sentences by which their notices are known.
GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "released under the agpl 3.0", "under the terms of the gnu affero general public license as published by the free software foundation", GNU.format("affero general public license", "3"), "spdx-license-identifier agpl-3.0-only"],
    "apache-2.0": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", "apache license version 2.0 january 2004", "released under the apache 2.0 license", "spdx-license-identifier apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd 3-clause license", "licensed under the bsd license", "distributed under the 2-clause bsd license", "spdx-license-identifier bsd-3-clause", "spdx-license-identifier bsd-2-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "released under the creative commons attribution license", "spdx-license-identifier cc-by-4.0"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "licensed under cc by-nc-sa 4.0", "spdx-license-identifier cc-by-nc-4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "text is available under the creative commons attribution-sharealike license", "spdx-license-identifier cc-by-sa-4.0"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related rights to this work", "released under cc0 1.0 universal public domain dedication", "dedicated to the public domain under cc0", "spdx-license-identifier cc0-1.0"],
    "gpl-2.0": ["this program is licensed under the gnu general public license version 2", "licensed under the gnu gpl version 2 only", "released under gpl 2.0", GNU.format("general public license", "2"), "spdx-license-identifier gpl-2.0-only"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl version 3 or later", GNU.format("general public license", "3"), "released under gpl 3.0", "spdx-license-identifier gpl-3.0-or-later"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "released under the isc license", "spdx-license-identifier isc"],
    "lgpl": ["licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license", "released under the lgpl 2.1", GNU.format("lesser general public license", "2.1"), "spdx-license-identifier lgpl-2.1-only"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "spdx-license-identifier mit"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "released under the mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "spdx-license-identifier mpl-2.0"],
}

# Sentences that hold the same words and are no licences.
ORDINARY = """
the driver lost his license after the accident|a license plate was found under the bridge|the film was released under another title
version 2.0 of the report was published in january|the work is subject to change without notice|all of the above forms are met with a smile
you may not use this file as evidence|the general public was invited to the opening|the foundation gave its permission to use the hall
he is a person of some charge and purpose|the public domain is a large place|copies of the letter were included in the file
the source of the river is in the mountains|software is sold with or without a box|a fee is charged for any copy of this map
apache helicopters flew over the town|students of mit won the prize|the gnu is a large animal of the plains
creative people need common sense|attribution of the painting is not certain|mozilla made a browser for the public
the terms of the treaty were published|rights of the author and of the reader|the following conditions are common in winter
it was as hot in may as in july|and so it is with the version of the story that we have|the commons was full and the lords were empty
""".replace("\n", "|")


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Sentences of all paragraphs, laid end to end; the paragraphs' offsets in them; and the texts' offsets in the paragraphs."""
    cut = pc.replace_substring(pc.replace_substring(texts.fill_null(""), "\r\n", "\n"), "\r", "\n")
    cut = pc.replace_substring(pc.replace_substring_regex(cut, PREFIX, "\\1"), "/", " ")
    paragraphs = pc.split_pattern(cut, "\n\n")
    joined = pc.replace_substring(paragraphs.flatten(), "\n", " ")
    for mark in (". ", "! ", "? "):
        joined = pc.replace_substring(joined, mark, mark[0] + "\n")
    sentences = pc.split_pattern(joined, "\n")
    of, at = (np.asarray(x.offsets, dtype=np.int64) for x in (sentences, paragraphs))
    return sentences.flatten(), of - of[0], at - at[0]


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of all windows, laid end to end, the windows' offsets in them and the sentence of each."""
    sizes = np.diff(offsets)
    half = WINDOW // 2
    n = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW) // half) + 1)
    sentence = np.repeat(np.arange(len(sizes)), n)
    shift = (np.arange(len(sentence)) - np.repeat(np.cumsum(n) - n, n)) * half
    begin = offsets[:-1][sentence] + shift
    length = np.minimum(begin + WINDOW, offsets[1:][sentence]) - begin
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - length), length), np.concatenate([[0], ends]), sentence


def clean(text: str) -> list[str]:
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


@dataclass
class Classifier:
    families: list[str]  # the last is unknown
    vocabulary: dict[str, int]
    pairs: np.ndarray  # sorted codes of known pairs
    word_weights: np.ndarray
    pair_weights: np.ndarray
    bias: np.ndarray
    temperature: float
    sentences: list[tuple[int, np.ndarray]]  # family and the pair codes of each template sentence

    def features(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its pair with the next known word of the piece, as a place in pairs (-1: none), and its code."""
        n = len(self.vocabulary)
        following = np.append(ids[1:], -1)
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        following[ends] = -1
        code = np.where((ids >= 0) & (following >= 0), ids * n + following, -1)
        at = np.searchsorted(self.pairs, code)
        at = np.where((at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == code), at, -1)
        return at, code

    def logits(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        pair, _ = self.features(ids, offsets)
        out = np.tile(self.bias, (len(offsets) - 1, 1))
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for places, weights in ((ids, self.word_weights), (pair, self.pair_weights)):
            hit = np.flatnonzero(places >= 0)
            if len(hit):  # a feature counts once in a window, as in training
                once = np.unique(owner[hit] * len(weights) + places[hit])
                rows = once // len(weights)
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                out[rows[starts]] += np.add.reduceat(weights[once % len(weights)], starts, axis=0)
        return out

    def probabilities(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(ids, offsets) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def confirmed(self, family: int, codes: np.ndarray, share: float) -> bool:
        """Whether enough of one sentence's pairs stand in the window, in order: their longest common subsequence, bit by bit."""
        for of, wanted in self.sentences:
            if of != family:
                continue
            where: dict[int, int] = {}
            for i, c in enumerate(wanted.tolist()):
                where[c] = where.get(c, 0) | 1 << i
            full = free = (1 << len(wanted)) - 1
            for c in codes.tolist():
                if m := where.get(c):
                    u = free & m
                    free = ((free + u) | (free - u)) & full
            if len(wanted) - free.bit_count() >= share * len(wanted):
                return True
        return False


@cache
def trained(copies: int = 30, rounds: int = 300, seed: int = 0) -> Classifier:
    """Fit on altered template sentences and ordinary ones; a quarter of the alterations is kept for the temperature."""
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ss in TEMPLATES.values() for s in ss for w in clean(s)}))}
    n = len(vocabulary)
    known = sorted(vocabulary)
    ordinary = [clean(s) for s in ORDINARY.split("|") if s.strip()]

    def around() -> list[str]:
        words = ordinary[int(rng.integers(len(ordinary)))] + ["x"] * 10
        return [str(w) for w in rng.choice(words, int(rng.integers(0, 16)))] if rng.random() < 0.6 else []

    held = [{w for t in TEMPLATES[f] for w in clean(t)} for f in families[:-1]]
    telling = {w for w in vocabulary if sum(w in h for h in held) == 1}  # without these an altered sentence may be another family's
    rows: list[tuple[list[str], int]] = []
    for k, family in enumerate(families[:-1]):
        for sentence in TEMPLATES[family]:
            words = clean(sentence)
            rows.append((words, k))
            for _ in range(copies):
                some = [w for w in words if w in telling or w.isdigit() or rng.random() > 0.08]
                front, back = (around() for _ in range(2))
                rows.append((front + some + back, k))
    for words in ordinary:
        rows += [([w for w in words if rng.random() > 0.1], len(families) - 1) for _ in range(copies // 2)]
    for _ in range(copies * 25):
        rows.append(([str(w) for w in rng.choice(known, int(rng.integers(1, 9)))], len(families) - 1))
        rows.append((["x", str(rng.choice(["the", "of", "in", "and", "a", "is"])), "x"], len(families) - 1))
    ids = [np.array([vocabulary.get(w, -1) for w in words], dtype=np.int64) for words, _ in rows]
    codes = {int(a * n + b) for k, family in enumerate(families[:-1]) for s in TEMPLATES[family] for a, b in zip(*(lambda x: (x[:-1], x[1:]))([vocabulary[w] for w in clean(s)]), strict=True)}
    pairs = np.array(sorted(codes), dtype=np.int64)
    model = Classifier(families, vocabulary, pairs, np.zeros((n, len(families))), np.zeros((len(pairs), len(families))), np.zeros(len(families)), 1.0, [])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    flat = np.concatenate(ids)
    pair, _ = model.features(flat, offsets)
    x = np.zeros((len(rows), n + len(pairs)), dtype=np.float32)
    owner = np.repeat(np.arange(len(rows)), np.diff(offsets))
    x[owner[flat >= 0], flat[flat >= 0]] = 1
    x[owner[pair >= 0], n + pair[pair >= 0]] = 1
    y = np.array([k for _, k in rows])
    held = rng.random(len(rows)) < 0.25
    goal = np.eye(len(families), dtype=np.float32)[y]
    w, bias = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    xt, gt = x[~held], goal[~held]
    for _ in range(rounds):
        z = xt @ w + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = (z / z.sum(axis=1, keepdims=True) - gt) / len(gt)
        w -= 8.0 * (xt.T @ error + 1e-5 * w)
        bias -= 2.0 * error.sum(axis=0)
    z = x[held] @ w + bias
    tries = np.geomspace(0.25, 4, 33)
    loss = [-(z / t - np.log(np.exp(z / t - (z / t).max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - (z / t).max(axis=1, keepdims=True))[np.arange(held.sum()), y[held]].mean() for t in tries]
    model.word_weights, model.pair_weights, model.bias, model.temperature = w[:n], w[n:], bias.astype(np.float64), float(tries[int(np.argmin(loss))])
    for k, family in enumerate(families[:-1]):
        for s in TEMPLATES[family]:
            v = np.array([vocabulary[x] for x in clean(s)])
            model.sentences.append((k, v[:-1] * n + v[1:]))
    return model


def scan_batch(model: Classifier, texts: pa.Array, least: float, share: float) -> pa.Array:
    sentences, of, at = pieces_of(texts)
    words = pc.ascii_split_whitespace(pc.utf8_lower(sentences))
    known = pa.array(list(model.vocabulary), pa.string())
    ids = np.asarray(pc.index_in(pc.utf8_trim(words.flatten(), characters=EDGE), value_set=known).fill_null(-1), dtype=np.int64)
    offsets = np.asarray(words.offsets, dtype=np.int64)
    places, offsets, sentence = windows_of(offsets - offsets[0])
    flat = ids[places]
    chance = model.probabilities(flat, offsets)
    best = chance[:, :-1].argmax(axis=1)
    sure = np.flatnonzero(chance[np.arange(len(best)), best] >= least)
    found: dict[int, dict] = {}
    _, codes = model.features(flat, offsets)
    for i in sure.tolist():
        own = codes[offsets[i] : offsets[i + 1]]
        if model.confirmed(int(best[i]), own, share):
            paragraph = int(np.searchsorted(of, sentence[i], side="right")) - 1
            doc = int(np.searchsorted(at, paragraph, side="right")) - 1
            key = (paragraph - int(at[doc]), model.families[best[i]])
            mine = found.setdefault(doc, {})
            mine[key] = max(mine.get(key, 0.0), float(chance[i, best[i]]))
    out = [[{"family": f, "probability": p, "piece": k} for (k, f), p in sorted(found.get(d, {}).items())] for d in range(len(texts))]
    return pa.array(out, pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("piece", pa.int32())])))


def scan(df: DataFrame, text: str = "text", out: str = "notices", least: float = 0.5, share: float = 0.7) -> DataFrame:
    """df with an array of (family, probability, piece: the paragraph): the confirmed notices of the whole text, in order."""
    shared = df.sparkSession.sparkContext.broadcast(trained())

    @arrow_udf("array<struct<family:string,probability:double,piece:int>>")
    def notices(texts: pa.Array) -> pa.Array:
        parts = [scan_batch(shared.value, texts.slice(at, 2048), least, share) for at in range(0, len(texts), 2048)]
        return pa.concat_arrays(parts) if parts else scan_batch(shared.value, texts, least, share)

    return df.withColumn(out, notices(text_of(text)))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences: doc_id, license (the most probable), families, n_notices, probability."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    top = F.expr("array_max(transform(notices, x -> struct(x.probability as p, -x.piece as at, x.family as family)))")
    return found.select(
        "doc_id", top["family"].alias("license"), F.array_sort(F.array_distinct("notices.family")).alias("families"),
        F.size("notices").cast("long").alias("n_notices"), F.round(top["p"], 6).alias("probability"),
    )
