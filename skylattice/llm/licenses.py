"""Licence scan: a paragraph classifier of sparse word n-grams, confirmed by templates.

A multinomial logistic regression over hashed words and pairs of words is trained on the driver from template notices
and varied copies of them, beside copies whose own words are made-up ones (unknown licences) and paragraphs that are no licence. Its weights enter the query as literal arrays, so a
scan is one projection of DataFrame functions without a shuffle. A paragraph is no licence where
that is likelier than one half, or than every other class; else of a known family if the best family's calibrated
probability reaches a threshold, and an unknown licence otherwise. The temperature and the threshold come from phrases
that training hasn't seen, and from whole families that models trained for this have not. Templates confirm a prediction: the share of the shorter one's words that both have.

A paragraph is a line, and also a block: several lines without a blank one or a sentence's end between them, as in wrapped
notices. A confirmed block takes the place of its lines, unless one of the same family is their only licence, or one is
confirmed for a family whose name is no part of the block's (as gpl is of agpl). A block that is not confirmed counts only
where none of its lines is a licence. Its place is that of its first line.

Texts without any word of the model's own vocabulary can't score as a licence: features without such a word have no
weight. They are passed over by one set comparison, which drops nothing.

Defined cases: null and empty texts have no paragraphs and no licence. Null and repeated doc_ids are judged row by
row. Texts of any length are judged whole, paragraph by paragraph. Ties go to the family that comes first by name. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features, varied copies of each template, and steps of training.
FEATURES, COPIES, STEPS = 4096, 24, 120
#: Share of known families' varied copies that the unknown class may cost, and the overlap that confirms.
UNKNOWN_COST, CONFIRM = 0.02, 0.6
PARAGRAPHS = r"\n+"
#: What ends a block of lines: a sentence that ends with its line, or lines without a letter or digit. And a mark between blocks.
BREAK, MARK = r"(?:(?<=[.!?])[^\p{L}\p{N}\n]*\n|\n(?=[^\p{L}\p{N}\n]*\n))(?:[^\p{L}\p{N}\n]*\n)*", "\u0001"

#: Template notices by family.
TEMPLATES = {
    "agpl": ("This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "isc": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright of the company. All rights reserved. This software is proprietary and confidential."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
}
#: Names of families' licences, and phrases that licences are named in; the last phrases are for calibration alone.
NAMES = {
    "agpl": ("GNU Affero General Public License", "AGPL v3", "AGPL-3.0"),
    "apache": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0"),
    "bsd": ("BSD 3-Clause License", "BSD License", "BSD-2-Clause"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "gpl": ("GNU General Public License, version 3", "GPL v2", "GPL-3.0"),
    "isc": ("ISC License", "ISC licence"),
    "lgpl": ("GNU Lesser General Public License, version 2.1", "LGPL v3", "LGPL-2.1"),
    "mit": ("MIT License", "MIT licence", "MIT-style license"),
    "mpl": ("Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "public-domain": ("CC0 1.0 Universal", "CC0", "Unlicense"),
}
PHRASES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "SPDX-License-Identifier: {}", "Distributed under the terms of the {}, see LICENSE.", "license = {}")
HELD_PHRASES = ("You may use this software under the {}.", "Code in this folder is available under {}.", "This file is covered by the {}; see COPYING for the terms.")
#: Licences of no family here, for the unknown class, and paragraphs that are no licence.
OTHER = ("Licensed under the Foobar Community License, version 7.", "This work is licensed under the Artistic Terms of Example Corp.", "Released under the Zephyr Shared Source License.", "Use of this software is governed by the Business Source License 1.1", "Licensed under the European Space Data License.", "Distributed under the Quill Font License.")
NONE = ("She renewed the driving license at the office of the town on Monday.", "The version of the story that the author told was free of errors.", "The general public liked the work, and it was released in spring.", "Copies of the source were distributed at the meeting.", "The apache helicopter landed near the river and the crew left.", "They study at MIT and met the software foundation of the city.", "The terms of the agreement were discussed and permission was asked.", "The common people created a domain of their own under the hill.", "Any person may use the library without charge on sunday.", "It is a license to dream, the poet said in public.", "The product is sold as is with the name of the shop.", "He wrote software and documentation for the department.")
#: Words too common in prose to be the model's own vocabulary.
COMMON = frozenset("a all an and any are as at author be basis by can charge city common copies copy copying created deal discussed do dream errors except fee files following for form forms free general he hill holder in is it law may met name names near neither no nor not of office on or own people person poet product products program promote provided purpose required river said she shop sold source spring story sunday terms that the their these they this to town under unless use used version was were with without work writing you".split())


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams(text: str) -> list[str]:
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


class Model:
    """families: sorted; the classes after them are unknown licences and no licence. weights[class][feature], bias[class], temperature and threshold; recalls of unseen notices of known families, and of unseen families as unknown."""

    def __init__(self, families, vocabulary, weights, bias, temperature, threshold, recalls=None):
        self.families, self.vocabulary, self.weights, self.bias = families, vocabulary, weights, bias
        self.temperature, self.threshold, self.recalls = temperature, threshold, recalls or {}


def features(texts: list[str], vocabulary: frozenset[str]) -> np.ndarray:
    """Hashed words and pairs, those with a word of the vocabulary alone."""
    x = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        for g in set(grams(t)):
            if any(w in vocabulary for w in g.split(" ")):
                x[i, zlib.crc32(g.encode()) % FEATURES] = 1
    return x


def softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def train(seed: int = 6) -> Model:
    """From templates, others and prose, each in varied copies: words dropped, doubled, or put between other words."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    vocabulary = frozenset(w for t in (*TEMPLATES.values(), *NAMES.values(), OTHER) for x in t for w in words(x) if w not in COMMON and len(w) > 1 and not w.isdigit())
    filler = [w for t in NONE for w in words(t)]

    def vary(text: str) -> str:
        w = [x for x in words(text) if rng.random() > 0.08]
        around = lambda: [filler[int(rng.integers(len(filler)))] for _ in range(int(rng.integers(0, 6)))]
        return " ".join(around() + w + around())

    generic = {w for w in vocabulary if sum(any(w in words(t) for t in ts) for ts in TEMPLATES.values()) >= 3} | {"license", "licensed", "licence"}
    letters = [*"abcdefghijklmnopqrstuvwxyz"]

    made_up = lambda: "".join(letters[int(i)] for i in rng.integers(0, 26, int(rng.integers(3, 10))))

    def renamed(text: str) -> str:
        """The notice of a licence that nobody knows: words of its own give way to made-up ones, numbers to others."""
        return " ".join(made_up() if w in vocabulary and w not in generic else str(rng.integers(0, 20)) if w.isdigit() else w for w in words(text))

    def sample(copies: int, notices: dict[str, list[str]], known: list[str]):
        """Varied copies of families' notices, of unknown licences and of prose, with their classes; families that aren't known are unknown licences."""
        texts, y = [], []
        for f, own in sorted(notices.items()):
            for t in own:
                texts += [t, *(vary(t) for _ in range(copies))]
                y += [known.index(f) if f in known else len(known)] * (copies + 1)
                texts += [vary(renamed(t)) for _ in range(copies // 3)]
                y += [len(known)] * (copies // 3)
        for t in OTHER:
            texts += [vary(t) for _ in range(copies)]
            y += [len(known)] * copies
        for t in NONE:
            texts += [t, *(vary(t) for _ in range(5 * copies))]
            y += [len(known) + 1] * (5 * copies + 1)
        for w in sorted(vocabulary):  # such a word in prose of any language, once or often, is no licence
            texts += [*(vary(w) for _ in range(4)), *(" ".join([w, *(w if rng.random() < 0.1 else made_up() for _ in range(n))][::-1]) for n in (3, 6, 8, 12, 20, 40, 40, 60, 80))]
            y += [len(known) + 1] * 13
        return texts, np.array(y)

    def fitted(texts: list[str], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        x = features(texts, vocabulary)
        target = np.eye(n, dtype=np.float32)[y]
        w, b = np.zeros((FEATURES, n), np.float32), np.zeros(n, np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, STEPS + 1):
            error = (softmax(x @ w + b) - target) / len(y)
            g = x.T @ error + np.float32(1e-4) * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= np.float32(0.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + np.float32(1e-7))
            b -= np.float32(2.0) * error.sum(0)
        return w, b

    named = lambda f, phrases: [p.format(n) for p in phrases for n in NAMES.get(f, ())]
    whole = {f: [*TEMPLATES[f], *named(f, PHRASES)] for f in families}
    w, b = fitted(*sample(COPIES // 3, whole, families), len(families) + 2)
    # Calibration: notices in phrases that training has never seen; and models without a third of the families judge those
    seen = [(k, v) for k, f in enumerate(families) for t in named(f, HELD_PHRASES) for v in (t, *(vary(t) for _ in range(3)))]
    z, truth, strange = features([v for _, v in seen], vocabulary) @ w + b, np.array([k for k, _ in seen]), []
    for part in range(3):
        hidden = families[part::3]
        known = [f for f in families if f not in hidden]
        cw, cb = fitted(*sample(COPIES // 3, {f: whole[f] for f in known}, known), len(known) + 2)
        strange.append(features([v for f in hidden for t in (*TEMPLATES[f], *named(f, HELD_PHRASES)) for v in (t, *(vary(t) for _ in range(3)))], vocabulary) @ cw + cb)
    heats = np.array([0.5, 0.7, 1, 1.5, 2, 3, 4, 6])
    loss = [-np.log(softmax(z / h)[np.arange(len(truth)), truth] + 1e-9).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(z / heat)[np.arange(len(truth)), truth]
    q = np.concatenate([softmax(x / heat)[:, :-2].max(1) for x in strange])
    # as high as licences of unseen families need, unless that costs unseen notices of known ones more than allowed; one half at least
    threshold = float(max(0.5, min(np.quantile(q, 0.95), np.quantile(p, UNKNOWN_COST))))
    return Model(families, vocabulary, w.T, b, heat, threshold, {"known": float((p >= threshold).mean()), "unknown": float((q < threshold).mean())})


def scan(docs: DataFrame, model: Model | None = None, paragraphs: str = PARAGRAPHS) -> DataFrame:
    """(doc_id, paragraphs: those that are licences, with place, family, probability, overlap, confirmed), in order."""
    model = model or train()
    array = lambda xs: F.from_json(F.lit(json.dumps(xs)), "array<double>")  # noqa: E731  a literal after constant folding
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    own = F.array(*(F.lit(w) for w in sorted(model.vocabulary)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("seen", F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), own))
    parts = F.transform(F.split("text", paragraphs), lambda p, i: F.struct(i.alias("place"), F.lit(False).alias("block"), tokens(p).alias("w")))
    rows = rows.withColumn("b", F.when(F.col("seen"), F.split(F.regexp_replace(F.translate("text", MARK, " "), BREAK, f"$0{MARK}"), MARK)).otherwise(F.array().cast("array<string>")))
    wrapped = lambda b: F.size(F.filter(F.split(b, paragraphs), lambda x: x.rlike(r"[\p{L}\p{N}]"))) > 1
    blocks = F.transform("b", lambda b, i: F.struct(i.alias("place"), F.lit(True).alias("block"), F.when(wrapped(b), tokens(b)).otherwise(F.array().cast("array<string>")).alias("w")))
    # lines of each block; every block but the last ends in a line end, so its pieces are one more
    n = F.transform("b", lambda b, i: F.size(F.split(b, paragraphs)) - F.when(i < F.size("b") - 1, 1).otherwise(0))
    none = F.array().cast("array<struct<place:int,block:boolean,w:array<string>>>")
    rows = rows.select("doc_id", n.alias("n"), F.when(F.col("seen"), F.filter(F.concat(parts, blocks), lambda p: F.arrays_overlap(p["w"], own))).otherwise(none).alias("p"))

    def index(p):
        pairs = F.when(F.size(p["w"]) > 1, F.zip_with(F.slice(p["w"], F.lit(1), F.size(p["w"]) - 1), F.slice(p["w"], F.lit(2), F.size(p["w"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        known = F.filter(F.array_distinct(F.concat(p["w"], pairs)), lambda g: F.arrays_overlap(F.split(g, " "), own))
        places = F.array_distinct(F.transform(known, lambda g: F.pmod(F.crc32(g), F.lit(FEATURES)).cast("int") + 1))
        return F.struct(p["place"].alias("place"), p["block"].alias("block"), F.array_distinct(p["w"]).alias("w"), places.alias("f"))

    rows = rows.select("doc_id", "n", F.transform("p", index).alias("p"))

    def logits(p):
        each = []
        for weights, b in zip(model.weights, model.bias, strict=True):
            table = array([round(float(x), 5) for x in weights])
            each.append((F.lit(float(b)) + F.aggregate(p["f"], F.lit(0.0), _adder(table))) / F.lit(model.temperature))
        return F.struct(p["place"].alias("place"), p["block"].alias("block"), p["w"].alias("w"), F.array(*each).alias("z"))

    rows = rows.select("doc_id", "n", F.transform("p", logits).alias("p"))

    def probabilities(p):
        top = F.array_max(p["z"])
        e = F.transform(p["z"], lambda z: F.exp(z - top))
        return F.struct(p["place"].alias("place"), p["block"].alias("block"), p["w"].alias("w"), e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("total"))

    rows = rows.select("doc_id", "n", F.transform("p", probabilities).alias("p"))
    k = len(model.families)
    names = F.array(*(F.lit(f) for f in (*model.families, "unknown")))

    def judge(p):
        best = F.array_max(F.slice(p["e"], 1, k + 1))
        family = F.element_at(names, F.array_position(p["e"], best).cast("int"))
        none = F.element_at(p["e"], k + 2) / p["total"]
        return F.struct(p["place"].alias("place"), p["block"].alias("block"), p["w"].alias("w"), family.alias("family"), (best / p["total"]).alias("probability"), none.alias("none"))

    rows = rows.select("doc_id", "n", F.filter(F.transform("p", judge), lambda p: (p["none"] < 0.5) & (p["probability"] > p["none"])).alias("p"))
    shared = lambda w, t: F.size(F.array_intersect(w, F.array(*(F.lit(x) for x in sorted(set(words(t))))))) / F.least(F.size(w), F.lit(len(set(words(t)))))

    def confirm(p):
        overlap = F.lit(0.0)
        for f in model.families:
            overlap = F.when(p["family"] == f, F.greatest(*(shared(p["w"], t) for t in TEMPLATES[f]))).otherwise(overlap)
        known = (p["probability"] >= model.threshold) & (p["family"] != "unknown")
        return F.struct(p["place"].alias("place"), p["block"].alias("block"), F.when(known, p["family"]).otherwise("unknown").alias("family"), p["probability"].alias("probability"), overlap.alias("overlap"), (known & (overlap >= CONFIRM)).alias("confirmed"))

    rows = rows.select("doc_id", "n", F.transform("p", confirm).alias("p"))
    upto = lambda k: F.aggregate(F.slice(F.col("n"), F.lit(1), k), F.lit(0), lambda a, x: a + x)
    fields = ("place", "family", "probability", "overlap", "confirmed")
    placed = lambda b: F.struct(upto(b["place"]).alias("place"), *(b[f].alias(f) for f in fields[1:]), upto(b["place"] + 1).alias("stop"))
    rows = rows.select("doc_id", F.transform(F.filter("p", lambda p: ~p["block"]), lambda p: F.struct(*(p[f].alias(f) for f in fields))).alias("p"), F.transform(F.filter("p", lambda p: p["block"]), placed).alias("b"))
    inside = lambda p, b: (p["place"] >= b["place"]) & (p["place"] < b["stop"])

    def counts(b):
        own = F.filter("p", lambda p: inside(p, b))
        alone = (F.size(own) == 1) & F.exists(own, lambda p: p["confirmed"] & (p["family"] == b["family"]))
        other = F.exists(own, lambda p: p["confirmed"] & ~F.contains(b["family"], p["family"]))
        return (b["confirmed"] & ~alone & ~other) | (F.size(own) == 0)

    rows = rows.select("doc_id", "p", F.filter("b", counts).alias("b"))
    lines = F.filter("p", lambda p: ~F.exists("b", lambda b: inside(p, b)))
    whole = F.transform("b", lambda b: F.struct(*(b[f].alias(f) for f in fields)))
    return rows.select("doc_id", F.array_sort(F.concat(lines, whole)).alias("paragraphs"))


def _adder(table):
    return lambda a, i: a + F.element_at(table, i)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sure = F.filter("paragraphs", lambda p: p["confirmed"])
    names = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["family"]))), ",")
    return found.select("doc_id", F.size("paragraphs").alias("n_license_paragraphs"), F.size(sure).alias("n_confirmed"), names(F.col("paragraphs")).alias("families"), names(sure).alias("confirmed_families"), F.transform("paragraphs", lambda p: p["place"]).alias("places"))
