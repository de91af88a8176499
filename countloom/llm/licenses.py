"""License scans (native: DataFrame functions only).

A paragraph is a line or several consecutive lines with words, joined: from every line on, as many as it takes to have the words
of the longest notice, so a notice may be wrapped anywhere.  It is classified by a sparse word n-gram logistic regression over licence
families and ``none``.  The model is trained on the driver from short notices of each family and background sentences; its features are
the word uni- and bigrams of the notices in paragraphs with a word of licensing (``ANCHORS``; every notice has one).  A paragraph without
such a word has no features, in training as in scoring, and is ``none``, so it need not be scored.  Scoring looks the weights up in constant
arrays.  A family is reported where its probability is at least ``sure`` and the comparison with the family's notices (share of
a notice's bigrams found in the paragraph) reaches ``CONFIRM``; otherwise a paragraph that is not ``none`` is ``unknown``.
Of paragraphs that overlap the best counts (families before ``unknown``, then the score, then the shorter one), lines that are
notices by themselves join no others, and paragraphs of one family without a line between them count as one.  Both thresholds are
calibrated in ``train`` on notices of families that the model has not seen: at ``sure`` none of them is named, and a paragraph is not ``none``
where the families together have a probability between that of the background and the next one of theirs.

Defined results: a copyright line alone is no licence; null and empty texts have no licence (``none``, score 0, no paragraphs); very long texts are scanned whole;
repeated rows get equal results; a paragraph is numbered by its first line; among equal scores the first paragraph counts; an empty table gives an empty result; extra
columns pass through ``scan`` unless they bear the name of a result, which then replaces them.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Notices by family.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This file is released under the Apache License 2.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",  # noqa: E501
        "either version 3 of the License, or (at your option) any later version. See the GNU General Public License for more details.",
        "Released under the GPL-3.0 license.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",  # noqa: E501
        "Released under the GPL-2.0 license.",
        "Licensed under the GPL v2.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "Released under the LGPL-2.1 license.",
        "Licensed under the LGPL v3.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL-3.0 license.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
        "Released under the ISC license.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this unencumbered software",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Boost Software License 1.0.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
}
#: Identifiers by family, for lines that declare a licence.
IDENTIFIERS = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "ISC": ["ISC"], "Unlicense": ["Unlicense"], "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "EPL-2.0": ["EPL-2.0"], "BSL-1.0": ["BSL-1.0"],
    "MPL-2.0": ["MPL-2.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC0-1.0": ["CC0-1.0"],
}
#: Beginnings of words, and whole words, of licensing: only a paragraph with one of them has features.
ANCHORS = (
    ["licen", "unlicen", "sublicen", "copyright", "permission", "permitted", "redistribut", "unencumber", "warrant", "spdx", "gpl", "lgpl", "agpl", "cc0", "bsd", "mozilla", "apache"],
    ["mit", "isc", "cc", "public", "gnu", "commons", "domain", "granted", "eclipse", "boost", "rights", "reserved", "version"],
)
TELLING = f"(?<![a-z0-9])(?:{'|'.join(ANCHORS[0])}|(?:{'|'.join(ANCHORS[1])})(?![a-z0-9]))"
for _family, _names in IDENTIFIERS.items():
    NOTICES[_family] += [f"{sign}: {name}" for name in _names for sign in ("SPDX-License-Identifier", "License")]
#: Sentences of no licence that share words with the notices.
BACKGROUND = [
    "The driver lost his license last year and may not use the car.",
    "The project was released in spring and the work is going well.",
    "General conditions are met with or without the public.",
    "Students at MIT work on software in the lab.",
    "The foundation is free for any person to visit at no charge.",
    "You can modify the file or use the copy in the folder.",
    "The Apache helicopter is subject to international terms.",
    "Version 2.0 of the program is slower than version 3.",
    "Attribution of the work to the author is not certain.",
    "The terms of the sale were published by the general office.",
    "A copy of this source was found under the table.",
    "To the extent possible we follow the law and related rights.",
    "This is the work of many, with the code of the public.",
    "She applied for a fishing license yesterday.",
    "A license costs ten coins.",
    "No license was needed.",
    "License plates are yellow here.",
    "Licensed doctors met in town.",
    "Wir fahren mit dem Zug in die Stadt.",
    "Mit ihm kam der Regen.",
    "Er wohnt mit uns.",
    "MIT is a university.",
    "The public was granted entry to the domain of the lord.",
    "All rights of the tenants are reserved in the contract of the house.",
    "House of Commons members met in public.",
    "Es ist mit der Zeit mit allen so.",
    "Copyright 2019 Example Corporation. All rights reserved.",
    "They were permitted to use the hall with or without the boost of the law.",
    "He gave permission to use the car, and no warranty came with it.",
]
#: Notices of families that the model does not know, for the calibration of the unknown class.
STRANGE = [
    "Licensed under the Example Community License, version 7.",
    "Released under the Acme Research License.",
    "This work is licensed under the Ministry of Maps data terms.",
    "Use of this dataset is subject to the Northwind license agreement.",
    "SPDX-License-Identifier: EUPL-1.2",
    "License: EUPL",
    "Licensed under the Orbital Software Agreement, version 4.",
]
FAMILIES = [*NOTICES, "none"]
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*:?"
CONFIRM = 0.6


def tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


#: Words of the longest notice; so many lines at most are joined, as each has a word.
LONGEST = max(len(tokens_of(n)) for ns in NOTICES.values() for n in ns)


def grams_of(text: str) -> list[str]:
    t = tokens_of(text)
    return sorted({*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))})


@lru_cache(maxsize=1)
def train() -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Features, weights (features x families), biases, and the thresholds of a family and of any licence at all; a few dozen rows of training data."""
    rng = np.random.default_rng(7)
    rows = [(n, k) for k, family in enumerate(NOTICES) for n in NOTICES[family]]
    features = sorted({g for n, _ in rows for g in grams_of(n)})
    place = {g: i for i, g in enumerate(features)}
    none = len(NOTICES)
    data = [*rows, *((b, none) for b in BACKGROUND)]
    words = sorted({w for n, _ in rows for w in tokens_of(n)})
    for _ in range(60):  # loose words of the notices make none
        data.append((" ".join(rng.choice(words, rng.integers(1, 7))), none))
    x = np.zeros((len(data), len(features)))
    for r, (text, _) in enumerate(data):
        for g in grams_of(text) if re.search(TELLING, text.lower()) else []:
            if g in place:
                x[r, place[g]] = 1
    y = np.eye(none + 1)[[k for _, k in data]]
    w, b = np.zeros((len(features), none + 1)), np.zeros(none + 1)
    for _ in range(1500):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (y - p) / len(data)
        w, b = w + 2.0 * (g - 2e-4 * w), b + 2.0 * (y - p).mean(0)
        w = np.sign(w) * np.maximum(0, np.abs(w) - 4e-4)  # sparse

    def probabilities(text: str) -> np.ndarray:
        own = set(grams_of(text)) if re.search(TELLING, text.lower()) else set()
        z = np.array([float(f in own) for f in features]) @ w + b
        p = np.exp(z - z.max())
        return p / p.sum()

    strange, plain = [probabilities(t) for t in STRANGE], [probabilities(t) for t in BACKGROUND]
    sure = min(0.9, max(0.5, max(p[:none].max() for p in strange) + 0.01))
    floor = max(1 - p[none] for p in plain)  # no background sentence is a licence
    least = (min(1 - p[none] for p in strange if 1 - p[none] > floor) + floor) / 2
    return features, np.round(w, 4), np.round(b, 4), sure, least


def _numbers(values: np.ndarray, kind: str) -> Column:
    """A constant array, folded once."""
    return F.split(F.lit(",".join(map(str, values.reshape(-1).tolist()))), ",").cast(f"array<{kind}>")


def _probabilities(line: Column) -> Column:
    """(best family's index, its probability) of a paragraph; ``none`` where no feature occurs."""
    features, weights, bias, *_ = train()
    n = len(FAMILIES)
    grams = let(
        F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})")),
        lambda t: F.array_distinct(
            F.concat(t, F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda b, i: F.concat(t[i], F.lit(" "), b)))
        ),
    )
    known = F.filter(grams, lambda g: g.isin(features))
    rows = F.transform(known, lambda g: F.array_position(F.array(*map(F.lit, features)), g) - 1)
    zeros = F.array(*[F.lit(float(x)) for x in bias])
    flat = _numbers(weights, "double")

    def softmax(z: Column) -> Column:
        total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(z)))
        any_family = 1 - F.exp(F.get(z, F.lit(n - 1)) - F.array_max(z)) / total
        return F.struct((F.array_position(z, F.array_max(z)) - 1).cast("int").alias("family"), (1 / total).alias("p"), any_family.alias("any"))

    add = lambda acc, r: F.transform(acc, lambda v, k: v + F.get(flat, (r * n + k).cast("int")))
    scored = let(F.aggregate(rows, zeros, add), softmax)
    return F.when(F.size(known) == 0, F.struct(F.lit(n - 1).alias("family"), F.lit(1.0).alias("p"), F.lit(0.0).alias("any"))).otherwise(scored)


def _likeness(line: Column) -> Column:
    """By family: the greatest share of a notice's bigrams that the paragraph has."""
    bigrams = lambda text: [g for g in grams_of(text) if " " in g]
    own = let(F.regexp_extract_all(F.lower(line), F.lit(f"({TOKEN})")), lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda b, i: F.concat(t[i], F.lit(" "), b)))
    share = lambda x, notice: F.size(F.array_intersect(x, F.array(*map(F.lit, bigrams(notice))))) / F.lit(len(bigrams(notice)))
    return let(own, lambda x: F.array(*[F.greatest(*[share(x, n) for n in notices], F.lit(0.0)) for notices in NOTICES.values()], F.lit(0.0)))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with licence (family, ``unknown`` or ``none``), licence_score, licence_paragraph (from 0; null if none) and n_licence_paragraphs."""
    *_, sure, least = train()
    names = F.array(*map(F.lit, FAMILIES))
    none = len(FAMILIES) - 1
    tells = lambda x: F.lower(x).rlike(TELLING)  # noqa: E731  (without such a word there are no features)
    n_words = lambda x: F.size(F.regexp_extract_all(F.lower(x), F.lit(f"({TOKEN})")))
    numbered = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i"), i.alias("last")))
    lines = F.when(tells(F.col(text)), numbered).otherwise(F.slice(numbered, 1, 0))

    def judged(x: Column) -> Column:
        def of(y: Column) -> Column:
            like = F.get(y["like"], y["best"]["family"])
            named = (y["best"]["family"] != none) & (y["best"]["p"] >= sure) & (like >= CONFIRM)
            name = F.when(named, F.get(names, y["best"]["family"])).when(y["best"]["any"] >= least, F.lit("unknown")).otherwise("none")
            return F.struct(named.alias("named"), y["best"]["p"].alias("score"), (-x["i"]).alias("at"), (-x["last"]).alias("until"), name.alias("name"))

        return let(F.struct(_probabilities(x["line"]).alias("best"), _likeness(x["line"]).alias("like")), of)

    def all_judged(x: Column) -> Column:
        return F.filter(F.transform(F.filter(x, lambda y: tells(y["line"])), judged), lambda y: y["name"] != "none")

    def joined(rows: Column) -> Column:
        """The paragraphs of two lines or more that begin with the first of ``rows``."""
        first = rows[0]
        out = F.slice(F.array(F.struct(first["line"].alias("line"), first["i"].alias("i"), first["last"].alias("last"))), 1, 0)
        start = F.struct(first["line"].alias("line"), first["words"].alias("n"), ((first["words"] > 0) & (first["words"] < LONGEST)).alias("open"), out.alias("out"))

        def add(acc: Column, x: Column) -> Column:
            more = F.concat(acc["line"], F.lit(" "), x["line"])
            n = acc["n"] + x["words"]
            grown = F.struct(more.alias("line"), n.alias("n"), (n < LONGEST).alias("open"), F.concat(acc["out"], F.array(F.struct(more.alias("line"), first["i"].alias("i"), x["i"].alias("last")))).alias("out"))
            closed = F.struct(acc["line"].alias("line"), acc["n"].alias("n"), F.lit(False).alias("open"), acc["out"].alias("out"))
            return F.when(acc["open"] & (x["words"] > 0), grown).otherwise(closed)

        return F.aggregate(F.slice(rows, 2, LONGEST), start, add, lambda acc: acc["out"])

    def over_lines(single: Column, all_lines: Column) -> Column:
        """The paragraphs of two lines or more that are a notice."""
        taken = F.transform(F.filter(single, lambda y: y["named"]), lambda y: -y["at"])

        def of(x: Column) -> Column:
            near = lambda i: F.slice(x, i + 1, LONGEST)
            begin = F.filter(x, lambda y: (y["words"] > 0) & F.exists(near(y["i"]), lambda z: z["told"]))
            return F.flatten(F.transform(begin, lambda y: let(near(y["i"]), lambda rows: all_judged(joined(rows)))))

        counted = F.transform(
            all_lines,
            lambda y: F.struct(y["line"], y["i"], y["last"], F.when(F.array_contains(taken, y["i"]), 0).otherwise(n_words(y["line"])).alias("words"), tells(y["line"]).alias("told")),
        )
        return let(counted, of)

    def apart(found: Column) -> Column:
        """The best ones of those that overlap, touching ones of one family as one; ``found`` is in the order of lines."""

        def add(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            but_last = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            shorter = x["at"] - x["until"] < last["at"] - last["until"]
            equal = F.when(x["named"], (x["score"] > last["score"]) | ((x["score"] == last["score"]) & shorter)).otherwise(shorter)
            better = (x["named"] & ~last["named"]) | ((x["named"] == last["named"]) & equal)
            whole = F.struct(last["at"].alias("at"), x["until"].alias("until"), x["named"].alias("named"), F.greatest(last["score"], x["score"]).alias("score"), x["name"].alias("name"))
            return (
                F.when((F.size(acc) > 0) & (last["until"] - 1 == x["at"]) & (last["name"] == x["name"]) & x["named"], F.concat(but_last, F.array(whole)))
                .when((F.size(acc) == 0) | (last["until"] > x["at"]), F.concat(acc, F.array(x)))
                .when(better, F.concat(but_last, F.array(x)))
                .otherwise(acc)
            )

        return F.aggregate(found, F.slice(found, 1, 0), add)

    def in_order(found: Column) -> Column:
        return F.reverse(F.array_sort(F.transform(found, lambda y: F.struct(y["at"], y["until"], y["named"], y["score"], y["name"]))))

    results = ("licence", "licence_score", "licence_paragraph", "n_licence_paragraphs")
    every = let(lines, lambda x: let(all_judged(x), lambda single: in_order(F.concat(single, over_lines(single, x)))))
    found = let(every, apart)

    def summed(x: Column) -> Column:
        x = F.transform(x, lambda y: F.struct(y["score"], y["at"], y["name"]))
        best = F.array_max(F.filter(x, lambda y: y["name"] != "unknown"))
        top = F.coalesce(best, F.array_max(x))
        return F.struct(
            F.coalesce(top["name"], F.lit("none")).alias("licence"), F.coalesce(F.round(top["score"], 6), F.lit(0.0)).alias("licence_score"),
            (-top["at"]).cast("int").alias("licence_paragraph"), F.size(x).alias("n_licence_paragraphs"),
        )

    return docs.drop(*results).select("*", F.inline(F.transform(F.array(found), summed)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
