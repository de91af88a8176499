import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import same_as_sql
from countloom.llm import language, licenses, mixing, ngram_join, packing, quality, rules, tokencount, urls, winnow
from countloom.llm.registry import ORACLES, QUERIES

#: Null, empty and wordless texts, short and very long ones, repeated rows, and columns that clash with results.
AWKWARD = [
    (1, None, None, "en"), (2, "", "a", "en"), (3, " \n\t ", "a", None), (4, "one", "b", "fr"), (5, "one two three", None, "fr"),
    (6, "The rain in Spain stays mainly in the plain, and it is not so in Britain or the north of France at all, one hears.", "b", "en"),
    (6, "The rain in Spain stays mainly in the plain, and it is not so in Britain or the north of France at all, one hears.", "b", "en"),
    (7, "le ciel est bleu et la mer est calme " * 4000, "a", "fr"), (8, "\u00e9t\u00e9 \U0001f600 \u4e2d\u6587 \u0130", "a", None), (None, "a text without an id", "c", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string, score double, n_words long, size long, bucket long, key string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3, "k") for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(name, sf=SMALL):
    return pq.read_table(f"{sf}/{name}.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same_as_sql(QUERIES[name](spark, SMALL), ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


# 1 token counts


def brute_tokens(word, scores):
    w, best = tokencount.MARK + word, [(0.0, 0)]
    for e in range(1, len(w) + 1):
        ways = [(best[b][0] + scores[w[b:e]], best[b][1] - 1) for b in range(e) if w[b:e] in scores]
        ways.append((best[e - 1][0] + tokencount.UNKNOWN, best[e - 1][1] - len(w[e - 1].encode())))
        best.append(max(ways))
    return -best[-1][1]


SCORES = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.0, "▁a": -2.5, "▁ab": -4.0, "ba": -4.0, "aba": -5.0, "bb": -4.5}


@given(st.lists(st.text("abé中", min_size=1, max_size=12), max_size=20))
@settings(max_examples=80, deadline=None)
def test_trie_counts_equal_a_plain_program(words):
    trie = tokencount.Trie(SCORES)
    assert trie.totals([" ".join(words).encode()])[1] == [sum(brute_tokens(w, SCORES) for w in words)]


def test_token_counts(spark, awkward, nothing, monkeypatch):
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokencount.token_counts(awkward).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4][0] == 1 and got[7][0] == 4000 * 9
    assert tokencount.token_counts(nothing).count() == 0
    trie = tokencount.Trie(SCORES)
    monkeypatch.setattr(tokencount, "NODES", 3)  # a new trie for every call
    texts = [b"ab abba", b"bb ab", b"abab"]
    assert [trie.totals([t])[1][0] for t in texts] == [sum(brute_tokens(w, SCORES) for w in t.decode().split()) for t in texts]


def test_token_counts_of_whole_texts(spark):
    """The query against a plain program, word by word over all texts."""
    scores = tokencount.scores_of(tokencount.default_vocabulary())
    docs, known = table("documents"), {}
    got = {r["doc_id"]: r for r in QUERIES["op1_token_counts"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs["doc_id"], docs["text"]):
        words = (text or "").encode().split()
        for w in words:
            if w not in known:
                known[w] = brute_tokens(w.decode(), scores)
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(known[w] for w in words))


# 2 quality


def test_quality_on_held_out_labels(spark):
    got = QUERIES["op2_quality_classifier"](spark, MIDDLE).toPandas()
    docs = table("documents", MIDDLE)
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = got.merge(table("labels", MIDDLE), on="doc_id")
    both = both[both["held_out"]]
    assert (both["predicted"] == both["quality"]).mean() > 0.93


def test_scores_equal_a_plain_compression(spark):
    """Every score from the model's two dictionaries with the command of the library, and in the order of the size differences."""
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    made = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    zero, slope = model.weights
    assert slope > 0
    plain = {}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        good, bad = (len(c.compress(raw)) for c in made)
        plain[r["doc_id"]] = (bad - good) / max(1, len(raw)) ** 0.5
    assert all(abs(got[i] - 1 / (1 + math.exp(-zero - slope * d))) < 1e-9 for i, d in plain.items())
    ordered = sorted(plain, key=plain.get)
    assert all(got[a] <= got[b] for a, b in zip(ordered, ordered[1:]))


def test_long_labelled_texts_are_learned_from(spark):
    good, bad = "plain words of a plain text " * 2000, "%%% &&& ### %%% $$$ " * 2000
    docs = spark.createDataFrame([(k, good if k % 2 else bad) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    of = quality.fit(docs, labels).scorer()
    assert of(good.encode()) > 0.5 > of(bad.encode())


def test_quality_edges(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(awkward, none)
    assert {r["score"] for r in quality.score(awkward, model).collect()} == {0.5}
    rows = [(b"plain words of a plain text " * 3, 1), (b"%%% &&& ### %%% $$$ " * 5, 0)] * 6
    model = quality.train(rows)
    scores = [r["score"] for r in quality.score(awkward, model).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores) and scores[5] == scores[6]
    assert quality.score(nothing, model).count() == 0
    of = model.scorer()
    assert of(b"some plain words of text " * 4) > 0.5 > of(b"&&& %%% ### $$$ " * 8)
    assert quality.keep(awkward, model).columns == awkward.columns


# 3 rules


def brute_rules(text):
    words = WORD.findall(text or "")
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_rules_edges(spark, awkward, nothing):
    texts = [None, "", "a b c d e f g h " * 2, "a b c d e f g h\n" * 3, "x " * 30, "# * | <b>\n\n \n# * | <b>", " ".join(map(str, range(40))) + " 1 2 3 4 5 6 7 8"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in rules.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t), t
    assert got[0]["ledger"] & 1 and got[4]["ledger"] & 2
    book = rules.ledger(awkward)
    assert book.count() == 10 and book.columns.count("n_words") == 1 and rules.ledger(nothing).count() == 0


@pytest.mark.parametrize("own", [None, {"short": "n_words < 60", "long": "n_words > 30", "lines": "n_dup_lines > 0"}])
def test_ablation_counts_what_each_rule_removes(spark, own):
    book = rules.ledger(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text"), rules=own)
    names = list(own or rules.RULES)
    masks = [r["ledger"] for r in book.select("ledger").collect()]
    got = {r["rule"]: r for r in rules.ablation(book, "web-1", own).collect()}
    assert list(got) == names
    for i, name in enumerate(names):
        r, bit = got[name], 1 << i
        assert r["failed"] == sum(bool(m & bit) for m in masks) and r["failed_alone"] == sum(m == bit for m in masks)
        assert r["kept_without"] == sum(not m & ~bit for m in masks)
    assert book.where(rules.passes("web-1", own)).count() == masks.count(0)
    some = rules.ablation(book, 3, own).collect()
    assert [r["rule"] for r in some] == names[:2] and some[0]["kept_without"] == sum(not m & 2 for m in masks)


# 4 licences


def test_licences(spark, awkward, nothing):
    notices = [(f, n) for f, ns in licenses.NOTICES.items() for n in ns]
    df = spark.createDataFrame([(i, f"Some words.\n{n}\nMore words.") for i, (_, n) in enumerate(notices)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert all(got[i]["licence"] == f and got[i]["licence_paragraph"] == 1 for i, (f, _) in enumerate(notices))
    other = spark.createDataFrame(list(enumerate(licenses.STRANGE + licenses.BACKGROUND)), "doc_id int, text string")
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(other).collect()}
    assert set(got.values()) <= {"unknown", "none"} and [got[i] for i in range(2)] == ["unknown"] * 2
    assert all(got[i] == "none" for i in range(len(licenses.STRANGE), len(got)))
    assert {r["licence"] for r in licenses.scan(awkward).collect()} == {"none"} and licenses.scan(nothing).count() == 0


def test_wrapped_and_declared_licences(spark):
    cases = []
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            words = notice.split()
            for width in (1, 2, 3, 5, 8, 11):
                lines = [" ".join(words[k : k + width]) for k in range(0, len(words), width)]
                cases += [(family, 2, "\n".join(["Some words.", "", *lines, "", "More words."]))]
            cases.append((family, 2, "\n".join([" *", " * ", *(f" * {w}" for w in lines), " */"])))
    cases += [("BSD", 1, "\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:")]
    cases += [("MIT", 0, "SPDX-License-Identifier: MIT"), ("unknown", 0, "License: EUPL"), ("unknown", 1, "text\nSPDX-License-Identifier: EUPL-1.2")]
    cases += [("none", None, "Er geht mit der Zeit."), ("none", None, "He has a fishing license.\nShe has none."), ("none", None, "Redistribution is a word\n\nof the general\npublic")]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], "doc_id int, text string")
    got = {r["doc_id"]: (r["licence"], r["licence_paragraph"], r["n_licence_paragraphs"]) for r in licenses.scan(df).collect()}
    wrong = [(got[i], c) for i, c in enumerate(cases) if got[i][0] != c[0] or got[i][2] not in ((0,) if c[0] == "none" else (1, 2))]
    assert not wrong, [(g, c[0], c[2][:60]) for g, c in wrong[:12]]
    # a long notice may be clearest without its first lines
    wrong = [(got[i], c) for i, c in enumerate(cases) if c[0] != "none" and not c[1] <= got[i][1] <= c[1] + 8]
    assert not wrong, [(g, c[0], c[2][:60]) for g, c in wrong[:12]]


def brute_scan(text):
    """The scan with plain loops: every paragraph, its scores, and the best ones of those that overlap."""
    features, weights, bias, sure, least = licenses.train()
    place, none = {g: i for i, g in enumerate(features)}, len(licenses.FAMILIES) - 1
    tells = lambda x: re.search(licenses.TELLING, x.lower()) is not None

    def judged(line):
        t = licenses.tokens_of(line)
        grams = list(dict.fromkeys([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]))
        z = [float(b) + sum(float(weights[place[g]][k]) for g in grams if g in place) for k, b in enumerate(bias)]
        total = sum(math.exp(v - max(z)) for v in z)
        best = z.index(max(z))
        have = {g for g in grams if " " in g}
        like = 0.0 if best == none else max(len(have & {g for g in licenses.grams_of(n) if " " in g}) / len({g for g in licenses.grams_of(n) if " " in g}) for n in licenses.NOTICES[licenses.FAMILIES[best]])
        named = best != none and 1 / total >= sure and like >= licenses.CONFIRM
        some = any(g in place for g in grams) and 1 - math.exp(z[none] - max(z)) / total >= least
        return named, 1 / total, licenses.FAMILIES[best] if named else "unknown" if some else "none"

    lines = (text or "").split("\n")
    found = []
    for i, line in enumerate(lines):
        if tells(line) and (j := judged(line))[2] != "none":
            found.append((-i, -i, *j))
    taken = {-x[0] for x in found if x[2]}
    words = [0 if i in taken else len(licenses.tokens_of(x)) for i, x in enumerate(lines)]
    for i in range(len(lines)):
        if words[i] and any(map(tells, lines[i : i + licenses.LONGEST])):
            joined, n = lines[i], words[i]
            for k in range(i + 1, min(len(lines), i + licenses.LONGEST)):
                if n >= licenses.LONGEST or not words[k]:
                    break
                joined, n = joined + " " + lines[k], n + words[k]
                if tells(joined) and (j := judged(joined))[2] != "none":
                    found.append((-i, -k, *j))
    kept = []
    for x in sorted(found, reverse=True):
        last = kept[-1] if kept else None
        if last and last[1] - 1 == x[0] and last[4] == x[4] and x[2]:
            kept[-1] = (last[0], x[1], x[2], max(last[3], x[3]), x[4])
        elif not last or last[1] > x[0]:
            kept.append(x)
        else:
            shorter = x[0] - x[1] < last[0] - last[1]
            better = x[2] > last[2] or x[2] == last[2] and ((x[3] > last[3] or x[3] == last[3] and shorter) if x[2] else shorter)
            kept[-1] = x if better else last
    top = max([(y[3], y[0], y[4]) for y in kept if y[4] != "unknown"] or [(y[3], y[0], y[4]) for y in kept] or [(0.0, None, "none")])
    return top[2], round(top[0], 6), None if top[1] is None else -top[1], len(kept)


def test_scan_equals_plain_loops(spark):
    docs = table("documents")
    rng = np.random.default_rng(3)
    made = []
    for k in range(60):
        notices = [n for ns in licenses.NOTICES.values() for n in ns] + licenses.STRANGE + licenses.BACKGROUND
        words = " ".join(notices[i] for i in rng.integers(0, len(notices), 2)).split()
        made.append("\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6)) if k % 2 else "\n".join(notices[i] for i in rng.integers(0, len(notices), 4)))
    texts = [*docs["text"], *made, None, ""]
    got = {r["i"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)).collect()}
    wrong = []
    for i, t in enumerate(texts):
        r, want = got[i], brute_scan(t)
        same = (r["licence"], r["licence_paragraph"], r["n_licence_paragraphs"]) == (want[0], want[2], want[3]) and abs(r["licence_score"] - want[1]) < 2e-6
        wrong += [] if same else [(t, r, want)]
    assert not wrong, wrong[:3]


def test_every_notice_has_a_word_of_licensing():
    assert all(re.search(licenses.TELLING, n.lower()) for ns in licenses.NOTICES.values() for n in ns)
    assert licenses.LONGEST <= 40


#: Wordings that are not in the training notices, some wrapped over lines.
HELD_OUT = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"),
    ("MIT", "This library is distributed under the MIT license, see below."),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("Apache-2.0", " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "You can redistribute it and/or modify it under the terms of the GNU General Public\nLicense as published by the Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "It is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software\nreleased into the public domain. Anyone may use it."),
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("BSD", "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file"),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "The text is licensed under a Creative Commons Attribution 4.0 International License, see there."),
    ("CC-BY-SA-4.0", "Photos licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "The data are released into the public domain under CC0 1.0."),
    ("unknown", "Licensed under the Harbour Data License, version 3."),
    ("unknown", "SPDX-License-Identifier: CDDL-1.1"),
    ("none", "Copyright (c) 2021 Some Company. All rights reserved."),
    ("none", "Er wohnt mit seiner Mutter in der Stadt und arbeitet mit uns."),
    ("none", "She lost her license at the public pool and asked for permission to leave."),
    ("none", "The apache people lived there long before the public road was built."),
    ("none", "Nothing of the kind was ever said, and nobody minds it."),
]


def test_licences_in_other_words(spark):
    df = spark.createDataFrame([(i, f"Some words before.\n\n{t}\n\nAnd after.") for i, (_, t) in enumerate(HELD_OUT)], "i int, text string")
    got = {r["i"]: (r["licence"], r["licence_score"]) for r in licenses.scan(df).collect()}
    wrong = [(got[i], want, t[:70]) for i, (want, t) in enumerate(HELD_OUT) if got[i][0] != want]
    assert len(wrong) <= 2, wrong
    assert not [w for w in wrong if w[0][0] not in ("none", "unknown")], wrong  # a wrong family is worse than none


# 5 fingerprints


def brute_winnow(text, gram=winnow.GRAM, window=winnow.WINDOW):
    h = winnow._hashes(winnow.codes_of(text), gram).tolist()
    if not h:
        return []
    w, out = min(window, len(h)), []
    for i in range(len(h) - w + 1):
        at = max(j for j in range(i, i + w) if h[j] == min(h[i : i + w]))
        if not out or out[-1] != (h[at], at):
            out.append((h[at], at))
    return out


@given(st.text("ab c", max_size=80))
@settings(max_examples=150, deadline=None)
def test_winnowing_is_the_rightmost_least(text):
    h, p = winnow.winnow(winnow.codes_of(text))
    assert list(zip(h.tolist(), p.tolist())) == brute_winnow(text)


def test_equal_grams_have_equal_hashes():
    a, b = (winnow._hashes(winnow.codes_of(t), 5).tolist() for t in ("xxabcdeyy", "abcde"))
    assert a[2] == b[0] and len(set(a)) == 5


@given(st.text("abcdef", min_size=19, max_size=40), st.text("uvw", max_size=30), st.text("xyz", max_size=30))
@settings(max_examples=60, deadline=None)
def test_shared_passages_are_found(passage, before, after):
    a, b = (set(winnow.winnow(winnow.codes_of(t))[0].tolist()) for t in (before + passage, passage + after))
    assert a & b


def test_edits_follow_the_next_document(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(winnow, "RANGE_ROWS", 30)
    got = {r["doc_id"]: r for r in winnow.op5(spark, SMALL).collect()}
    docs = table("documents").sort_values("doc_id", ascending=False)
    texts = docs["text"].tolist()
    assert len(got) == len(texts)
    for i, t, n in zip(docs["doc_id"], texts, texts[1:] + texts[:1]):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        own, new, following = (brute_winnow(x) for x in (t, e, n))
        for name, chosen in (("fingerprint", own), ("edited_fingerprint", new)):
            h, p = winnow.read_digest(r[name])
            assert list(zip(h.tolist(), p.tolist())) == chosen
        for name, other in (("near_edited", new), ("near_next", following)):
            a, b = {h for h, _ in own}, {h for h, _ in other}
            assert abs(r[name] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    rows = winnow.compare_edits(awkward).collect()
    assert len(rows) == 10 and len({r["fingerprint"] for r in rows if r["doc_id"] == 6}) == 1
    assert winnow.compare_edits(nothing).count() == 0
    assert winnow.compare_edits(awkward.where("doc_id = 4")).first()["near_next"] == 1.0
    assert winnow.fingerprints(awkward).count() == 10


def test_order_of_null_and_repeated_ids(spark, monkeypatch):
    """An id, and rows without one, that fill several ranges."""
    monkeypatch.setattr(winnow, "RANGE_ROWS", 7)
    rows = [(5, f"five {k}") for k in range(40)] + [(None, f"none {k}") for k in range(30)] + [(k, f"own {k} of the text") for k in range(-20, 20)] + [(8, "same")] * 9
    out = winnow.in_order(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["place"] for r in out}) > 12
    places = {}
    for r in sorted((r for r in out if not r["last"]), key=lambda r: r["place"]):
        places.setdefault(r["place"], []).append((r["doc_id"], r["text"]))
    got = [x for part in places.values() for x in part]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    ids = [max((-99 if i is None else i) for i, _ in part) for part in places.values()]
    assert ids == sorted(ids, reverse=True) and max(len(p) for p in places.values()) < 25
    assert sorted(r["place"] for r in out if r["last"]) == sorted(places)
    assert winnow.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


# 6 language


def test_language_on_held_out_rows(spark, awkward, nothing):
    got = QUERIES["op6_language_id"](spark, MIDDLE).toPandas()
    docs = table("documents", MIDDLE)
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    both = got.merge(docs, on="doc_id")
    both = both[both["held_out"]]
    assert (both["lang_pred"] == both["lang"]).mean() > 0.98
    model = language.fit(awkward)
    rows = language.predict(awkward, model).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows) and rows[5] == rows[6]
    assert language.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(awkward, language.fit(nothing)).collect()} == {"und"}


def test_masks_hold_every_language_of_a_gram():
    model = language.train([("abc abd", "x"), ("abc xyz", "y")])
    h, _ = language._grams(language._codes(["abc"])[0], 3)
    assert all(m == 3 for m in model.masks(h).tolist())
    assert model.predict(["abd", "xyz", "123", "qqqq"])[0] == ["x", "y", "und", "x"]


def brute_language(model, text):
    """Counts of known n-grams by language, corrected for the share of false positives, one n-gram and language at a time."""
    padded = [chr(c) for c in language._codes([text])[0]]
    known, total = [0] * len(model.languages), 0
    for n in language.SIZES:
        for at in range(len(padded) - n + 1):
            gram = padded[at : at + n]
            if " " in gram[1:-1] or gram[0] == gram[-1] == " " or (n == 2 and gram == [" ", " "]):
                continue
            hashes, _ = language._grams(np.array([ord(c) for c in gram], np.uint32), n)
            if not len(hashes):
                continue
            total += 1
            cells = [int(p[0]) for p in language._positions(hashes)]
            for k in range(len(known)):
                known[k] += all(int(model.cells[k // 64][c]) >> (k % 64) & 1 for c in cells)
    real = [max(0.0, (c - total * f) / (1 - f)) for c, f in zip(known, model.false_rate)]
    if not any(ch.isalpha() for ch in text):
        return "und", 0.0
    if max(real) <= 0:
        return model.languages[model.fallback], 0.0
    return model.languages[real.index(max(real))], max(real) / sum(real)


def test_predictions_equal_single_counts(spark):
    docs = table("documents")
    model = language.train([(t, lang) for t, lang in zip(docs["text"][:80], docs["lang"][:80]) if t and lang])
    texts = [t[:400] for t in docs["text"][80:130] if t] + ["", "1 2 3", "a", "zzz qqq xxx"]
    for text, name, score in zip(texts, *model.predict(texts)):
        want = brute_language(model, text)
        assert name == want[0] and abs(score - want[1]) < 1e-9


def test_more_languages_than_bits_of_a_word(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:03d}" for k in range(150)]  # the words of a language are over three letters of its own
    word = lambda k, i: "".join((letters[k % 26], letters[k // 26 + 7 * (i % 3)], letters[(k * 5 + i) % 26]))
    texts = [" ".join(word(k, i) for i in range(6)) for k in range(150)]
    docs = spark.createDataFrame([(10 * k + j, texts[k], names[k]) for k in range(150) for j in range(10)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert list(model.languages) == names and len(model.cells) == 3
    got = language.predict(docs, model).toPandas().merge(docs.toPandas(), on="doc_id")
    assert len(got) == 1500 and (got["lang_pred"] == got["lang"]).all()
    few = language.train([(t, n) for t, n in zip(texts, names)][:64])
    assert few.cells.shape == (1, language.CELLS)


# 7 mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    open_ = set(order)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 0, "c": 100, "d": 3, None: 7}, {"z": 1, "y": 1000, "x": 2, "w": 5}])
def test_targets_are_reshared(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_mix(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows = mixing.op7(spark, SMALL).toPandas()
    same_as_sql(mixing.op7(spark, SMALL), mixing.ORACLE)
    assert (rows["taken"] <= 3 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(lower=1) == 0).all()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == int((rows["taken"] / rows["size"].clip(lower=1)).sum())
    plan = mixing.plan(awkward).collect()
    assert len(plan) == 10 and all(r["taken"] == 0 for r in plan if r["size"] == 0)
    assert mixing.mix(awkward).columns == awkward.columns and mixing.mix(awkward).where("text is null").count() == 0
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


# 8 URLs


def brute_verdict(url, rule_list=urls.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        authority = re.match("[^/?#]*", rest)[0]
        host = authority.translate(str.maketrans(urls.UPPER, urls.LOWER))
        path = re.match("[^?#]*", rest[len(authority) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rule_list if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_urls(spark, awkward):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y", "http://net/", "http://xnet/", "https://a.org/fr/", "ftp://example.com/de/#f", "http://example.com?x://y.net/", "http://a://b.net/", "http://" + "a." * 500 + "net/" + "p" * 3000, "http://ünï.org/fr/é"]  # noqa: E501
    odd += odd[4:6]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(odd)], "page_id int, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(odd)}
    more = [("example.com", "/d", "allow"), ("com", "/de/5", "block"), ("a.example.com", "/de/", "allow")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, more).collect()}
    assert got == {i: brute_verdict(u, more) for i, u in enumerate(odd)}
    assert urls.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict <> 'allow'").count() == 0
    assert urls.judge(df.limit(0)).count() == 0


# 9 packing


def test_packing_round_trip(spark, awkward, nothing):
    from tokenizers import Tokenizer

    got = packing.op9(spark, SMALL).toPandas()
    docs = table("documents")
    reference = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, e in zip(docs["doc_id"], reference.encode_batch(docs["text"].tolist(), add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        want |= {(i, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    check_slots(got)
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 2048) + 1
    rows = packing.pack_documents(awkward).toPandas()
    check_slots(rows)
    assert len(rows) > 10 and (rows[rows["doc_id"].isin([1, 2, 3])]["length"] == 1).all()
    assert packing.pack_documents(nothing).count() == 0


def check_slots(rows, capacity=2048):
    rows = rows.sort_values(["sequence_id", "offset"])
    for _, g in rows.groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= capacity


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=8))
@settings(max_examples=150, deadline=None)
def test_plans_place_every_rank_once(counts):
    spans, ranks = {}, {}
    for length, first, n, each, seq, at in packing.plan(counts, 20):
        for k in range(n):
            spans.setdefault(seq + k // each, []).append((at + k % each * length, length))
            ranks.setdefault(length, []).append(first + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for items in spans.values():
        items.sort()
        ends = [a + b for a, b in items]
        assert [a for a, _ in items] == [0, *ends[:-1]] and ends[-1] <= 20


@given(st.text("abZé'İΣßÑ.,!?*<|> \t中1", max_size=60))
@settings(max_examples=150, deadline=None)
def test_words_make_the_ids_of_the_text(text):
    encoder = packing.Encoder.of(packing.default_tokenizer())
    for t in (text, text + "<|endoftext|>x"):
        assert encoder.encode([t.encode()])[0] == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


# 10 Jaccard join


def brute_join(rows):
    """Every row is a document of its own; a component has the least id of its rows."""
    lower = str.maketrans(urls.UPPER, urls.LOWER)
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, len(x), least.get(top(i))) for i, ((doc_id, _), x) in enumerate(zip(rows, sets))]


def family(n, seed, size=60, edits=3):
    """Texts that each differ from one original in a few words, so that some are linked through others only."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, size, rng.integers(0, edits + 1)):
            t[at] = f"n{rng.integers(0, 10**6)}"
        out.append(" ".join(t[: size - rng.integers(0, 6)]))
    return out


def joined(df):
    return sorted(map(tuple, ngram_join.join(df).collect()))


def test_join_equals_all_pairs(spark, nothing, monkeypatch):
    texts = family(60, 1) + family(30, 2, 40, 4) + family(10, 3, 12, 1) + [None, "", "  ", "one", "ONE", "a b c", "a b c d e", "A b C d e", "a b c d e"]
    rows = [(i * 7 % 1000 + 1000 * (i % 2), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(3)
    want = sorted(brute_join(rows))
    assert joined(df) == want
    # few pivots in a turn, small trees, and pairs go through the shuffle
    monkeypatch.setattr(ngram_join, "TURN", 1)
    monkeypatch.setattr(ngram_join, "MORE", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    assert joined(df) == want
    assert ngram_join.join(nothing).count() == 0


def test_join_of_awkward_rows(spark, awkward):
    got = ngram_join.join(awkward).collect()
    assert len(got) == 10
    assert {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0} and {r["component_id"] for r in got if r["doc_id"] == 6} == {6}


@given(st.lists(st.text("ab A\n", max_size=40), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_shingles(texts):
    lower = str.maketrans(urls.UPPER, urls.LOWER)
    for t, got in zip(texts, ngram_join.shingles([t.encode() for t in texts])):
        w = WORD.findall(t.translate(lower))
        n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(1, len(w))
        assert len(got) == n and (np.diff(got.astype(object)) > 0).all()


def test_join_of_null_and_repeated_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (5, text("a") + " end"), (5, text("b") + " end"), (1, text("a")), (2, text("b")),  # an id with two texts, each linked elsewhere
        (9, text("c")), (None, text("c") + " x"), (8, text("c") + " x y"), (None, text("d")), (None, text("d") + " x"),  # linked through a row without id; no id at all
        (3, text("e")), (3, text("e")), (3, text("f")), (4, None), (4, None), (None, ""),
    ]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=key) == sorted(brute_join(rows), key=key)


def test_hashes_of_one_document_in_a_bucket():
    for own in (np.array([3] * 70_000), np.array([0, 0, 2, 5]), np.arange(300) % 7):
        own = np.sort(own)
        assert (ngram_join._owned(ngram_join._owners(own, 9)) == own).all()
    ranks = ngram_join.rank(np.array([1, 2, 63, 64, 80, 1000, 10**9, 10**18]))
    assert ranks[:4].tolist() == [1, 2, 63, 64] and (np.diff(ranks.astype(int)) >= 0).all() and ranks[-1] == 255


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=2, max_size=12), st.lists(st.integers(0, 3), min_size=12, max_size=12))
@settings(max_examples=200, deadline=None)
def test_tree_finds_every_link(sets, alone):
    """Sets with some n-grams that no other set has, which are counted in their size alone."""
    keys, sizes = [np.array(sorted(s), "<u8") for s in sets], [len(s) + more for s, more in zip(sets, alone)]
    tree = ngram_join.PrefixTree(sizes, keys)
    assert sorted(tree.order) == list(range(len(sets)))
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 75 * (sizes[i] + sizes[j] - len(sets[i] & sets[j]))
    for i in range(len(sets)):
        none = np.zeros(len(sets), bool)
        assert sorted(tree.order[at] for at in tree.join(keys[i], sizes[i], none)) == [j for j in range(len(sets)) if link(i, j)]
    parent = list(range(len(sets)))
    for i, j in ngram_join.tree_links(sizes, keys, list(range(len(sets))), list(range(len(sets)))):
        assert link(i, j)
        parent = [parent[i] if x == parent[j] else x for x in parent]
    assert all(parent[i] == parent[j] for i in range(len(sets)) for j in range(i) if link(i, j))


def test_components(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(40)], "id long, component long")
    chain = [(i, i + 1) for i in range(0, 19)] + [(30, 35), (35, 31)]
    got = dict(map(tuple, ngram_join.components(nodes, spark.createDataFrame(chain, "x long, y long").repartition(12)).collect()))
    assert all(got[i] == 0 for i in range(20)) and got[35] == got[31] == 30 and got[25] == 25
