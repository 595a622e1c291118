"""Quality rules, language ID, toxicity and licence scan."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.llm import lang_crf, license_rules, toxicity_knn
from churnlake.llm.common import _importable
from churnlake.llm.lang_crf import identify_languages, posterior_sums
from churnlake.llm.license_rules import scan_licenses
from churnlake.llm.quality_rules import CORE, CUTOFF, GRAIN, mcd, quality_verdicts, text_statistics
from churnlake.llm.toxicity_knn import BlockMaxIndex, isotonic, score_toxicity, weighted
from helpers import DOC_SCHEMA, awkward, docs_frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(t):
    t = t or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(words) - 2):
        count.setdefault(tuple(words[i: i + 3]), []).append(i)
    covered = {i + k for at in count.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_statistics_match_brute_force(spark):
    r = random.Random(2)
    texts = awkward() + ["a\x0bb  c\r\nd\n\n \nd\nd", "a a a a", "a b a b a b", "### $$ <tag>|&"]
    texts += [" ".join(r.choice("abcdefgh") + r.choice("\n  ") for _ in range(r.randrange(200))) for _ in range(60)]
    texts += ["\n".join(r.choice(["one two three", "four five", ""]) for _ in range(30)) for _ in range(10)]
    got = {x.doc_id: x for x in text_statistics(docs_frame(spark, texts)).collect()}
    for i, t in enumerate(texts, 1):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == statistics(t), repr(t)[:80]


def clean_text(r, n):
    return " ".join("".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randrange(2, 5)))
                    for _ in range(n))


def test_junk_is_rejected_and_clean_kept(spark):
    r = random.Random(8)
    clean = [clean_text(r, int(min(4000, 50 + r.lognormvariate(5, 0.8)))) for _ in range(300)]
    junk = [" ".join(w + "###" for w in clean_text(r, 120).split()) for _ in range(40)]
    short = ["too short"] * 5 + ["x y z " * 60] + [None, ""]
    df = docs_frame(spark, clean + junk + short)
    got = {x.doc_id: x for x in quality_verdicts(spark, df).collect()}
    assert len(got) == len(clean + junk + short)
    assert all(got[i].kept for i in range(1, 301))
    assert not any(got[i].kept for i in range(301, 301 + 40 + len(short)))
    assert all(got[i].base_failed for i in range(341, 341 + len(short)))


def test_small_groups_and_nulls(spark):
    r = random.Random(8)
    df = docs_frame(spark, [clean_text(r, 80) for _ in range(5)])
    extra = df.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))
    got = quality_verdicts(spark, df.unionByName(extra)).collect()
    assert len(got) == 10 and all(x.kept and x.distance2 is None for x in got)
    assert quality_verdicts(spark, df.limit(0)).count() == 0


def test_mcd_matches_numpy(spark):
    """The C-steps reach a determinant no larger than numpy's from the true centre, and ignore the outliers."""
    g = np.random.default_rng(5)
    x = g.normal(size=(400, 5)) * [1, .5, .3, .6, .4] + [5, 1, 0, 0, 0]
    x[:70] += [0, 0, 6, 4, 5]
    _importable(spark)
    rows = spark.createDataFrame([("g", i, *map(float, v)) for i, v in enumerate(x)],
                                 "grp string, id long, x0 double, x1 double, x2 double, x3 double, x4 double")
    fit = mcd(spark, rows).collect()[0]
    centre, cov = x[70:].mean(axis=0), np.cov(x[70:].T, bias=True)
    for _ in range(30):
        v = cov + np.diag(np.square(GRAIN))
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(v), x - centre)
        core = x[d <= np.quantile(d, CORE)]
        centre, cov = core.mean(axis=0), np.cov(core.T, bias=True)
    w = np.array([[fit[f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    m = np.array([fit[f"m{i}"] for i in range(5)])
    assert np.abs(m - x[70:].mean(axis=0)).max() < 0.15
    d = (((x - m) @ w.T) ** 2).sum(axis=1)
    assert d[:70].min() > CUTOFF > np.sort(d[70:])[-3]
    assert fit.logdet <= np.linalg.slogdet(np.cov(x[70:].T, bias=True) + np.diag(np.square(GRAIN)))[1] + 0.5


def chain_posteriors(emit, trans, first):
    """Brute force over all labellings."""
    from itertools import product
    t, k = emit.shape
    total, out = 0.0, np.zeros(k)
    for y in product(range(k), repeat=t):
        s = first[y[0]] + sum(emit[i, c] for i, c in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        total += math.exp(s)
        for c in y:
            out[c] += math.exp(s)
    return out / total


def test_forward_backward_matches_brute_force():
    g = np.random.default_rng(1)
    table = g.normal(size=(12, 3)).astype(np.float32)
    trans, first = g.normal(size=(3, 3)), g.normal(size=3)
    chains = [g.integers(0, 12, n) for n in (1, 5, 0, 6, 3, 6, 2)]
    got = posterior_sums(chains, table, trans, first)
    for c, row in zip(chains, got):
        want = chain_posteriors(table[c].astype(float), trans, first) if len(c) else np.zeros(3)
        assert np.allclose(row, want, atol=1e-4)


def test_languages_held_out(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    _importable(spark)
    settings = lang_crf.Settings(docs_per_label=60, words_per_doc=120)
    got = {x.doc_id: x for x in identify_languages(spark, docs, settings=settings).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(right) >= 0.97 * len(right)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_code_switched_words_and_edges(spark):
    r = random.Random(6)
    make = {"en": "the and with of that over under house water".split(),
            "de": "der und mit von dass über unter haus wasser".split()}
    texts, langs = [], []
    for _ in range(80):
        for lang, ws in make.items():
            texts.append(" ".join(r.choice(ws) for _ in range(30)))
            langs.append(lang)
    texts += [None, "", "123 !!! ###", "the house", "haus", "the water of der", "x " * 30_000]
    langs += [None] * 7
    rows = identify_languages(spark, docs_frame(spark, texts, langs)).collect()
    got = {x.doc_id: x for x in rows}
    assert [got[i].lang_pred for i in (161, 162, 163)] == ["und"] * 3 and got[161].score == 0.0
    assert [got[i].lang_pred for i in (164, 165, 166)] == ["en", "de", "en"]
    assert got[167].n_words == 30_000 and 0 <= got[167].score <= 1
    none = identify_languages(spark, docs_frame(spark, ["some text"], [None])).collect()
    assert [(x.lang_pred, x.score) for x in none] == [("und", 0.0)]
    assert identify_languages(spark, docs_frame(spark, ["a"]).limit(0)).count() == 0


def test_every_language_is_learned(spark):
    r = random.Random(7)
    langs = [f"l{i:02d}" for i in range(70)]
    own = {x: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for x in langs}
    rows = [(x, " ".join(r.choice(own[x]) for _ in range(20))) for x in langs for _ in range(8)]
    settings = lang_crf.Settings(buckets=1 << 12, iterations=20)
    got = identify_languages(spark, docs_frame(spark, [t for _, t in rows], [x for x, _ in rows]), settings=settings).collect()
    assert {x.doc_id: x.lang_pred for x in got} == {i: x for i, (x, _) in enumerate(rows, 1)}


def test_word_cache_limit_does_not_change_scores(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(20)) for _ in range(40)]
    df = docs_frame(spark, texts, ["en", "de"] * 20)
    a, b = ({x.doc_id: (x.lang_pred, round(x.score, 5)) for x in identify_languages(
        spark, df, settings=lang_crf.Settings(cached_words=n, words_at_once=w)).collect()}
        for n, w in ((3, 10), (1000, 10_000)))
    assert a == b


def test_block_max_neighbours_match_brute_force():
    g = np.random.default_rng(4)
    n_terms, n = 60, 700
    vectors = []
    for _ in range(n):
        t = np.unique(g.integers(0, n_terms, g.integers(1, 12)))
        vectors.append((t, weighted(g.integers(1, 5, len(t)).astype(float), np.ones(n_terms)[t])))
    index = BlockMaxIndex(vectors, n_terms)
    dense = np.zeros((n, n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(150):
        t = np.unique(g.integers(0, n_terms, g.integers(1, 6)))
        w = weighted(g.integers(1, 5, len(t)).astype(float), np.ones(len(t)))
        want = dense[:, t] @ w
        k = int(g.integers(1, 80))
        near, cosine = index.nearest(t, w, k)
        assert np.allclose(cosine, np.sort(want[want > 0])[::-1][:k]) and np.allclose(want[near], cosine)


def test_isotonic_is_monotone():
    g = np.random.default_rng(2)
    x, y = g.random(300), (g.random(300) < 0.4).astype(float)
    lows, values = isotonic(x, y, np.ones(300))
    assert (np.diff(lows) > 0).all() and (np.diff(values) >= 0).all() and 0 <= values[0] and values[-1] <= 1


def test_toxicity(spark):
    r = random.Random(3)
    mild = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(1, 401):
        bad = i % 4 == 0
        ws = [r.choice(mild) for _ in range(40)]
        if bad:
            for _ in range(4):
                ws[r.randrange(40)] = r.choice(["idiot", "moron", "scum"])
        texts.append(" ".join(ws))
        labels.append((i, int(bad)))
    texts += [None, "", "scum idiot moron", "word1 word2", "idiot " * 20_000]
    df = docs_frame(spark, texts)
    lab = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (3, 1, None)],
                                "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in score_toxicity(spark, df, lab).collect()}
    assert len(got) == len(texts)
    held = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(x.held_out for x, _ in held) and all(x.predicted == y for x, y in held)
    assert [got[i].predicted for i in (401, 402, 403, 404, 405)] == [0, 0, 1, 0, 1]
    known = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert got[403].neighbours and set(got[403].neighbours) <= known and got[403].cosines[0] <= 1 + 1e-9
    none = score_toxicity(spark, df, lab.limit(0)).collect()
    assert {x.score for x in none} == {0.0} and len(none) == len(texts)
    assert score_toxicity(spark, df.limit(0), lab).count() == 0
    assert toxicity_knn.word_terms("Worthless!!") == ["=worthless", "wort", "worth", "worthl", "worthle", "worthles"]


def test_toxicity_cosines_are_over_all_words(spark):
    """Words of one example alone, and of both labels alike, count as well; brute force."""
    r = random.Random(9)
    texts = [" ".join([f"w{chr(97 + r.randrange(25))}" for _ in range(6)] + [f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"])
             for i in range(60)] + ["onlyaa", None]
    labels = [(i, 1, i % 2) for i in range(1, 61)]
    got = {x.doc_id: x for x in score_toxicity(
        spark, docs_frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    known = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    bags = [Counter(x for t in (t or "").split() for x in toxicity_knn.word_terms(t)) for t in texts]
    df = Counter(x for b in bags for x in b)
    vocabulary = {x for i in known for x in bags[i - 1]}

    def vector(i):
        v = {x: (1 + math.log(n)) * math.log((1 + len(texts)) / (1 + df[x])) for x, n in bags[i - 1].items() if x in vocabulary}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()} if norm else v

    vectors = {i: vector(i) for i in range(1, len(texts) + 1)}
    for i, v in vectors.items():
        want = sorted((sum(w * vectors[e].get(x, 0) for x, w in v.items()) for e in known), reverse=True)
        want = [c for c in want if c > 0][:toxicity_knn.Settings().neighbours]
        assert np.allclose(got[i].cosines, want), i


def test_model_keeps_its_key():
    """The worker cache goes by it; the last example has no term."""
    model = toxicity_knn.build_model("fresh", {"a": 0}, np.ones(1), [(1, 1, [0], [2]), (2, 0, [], [])], {0: 1, 1: 1},
                                     toxicity_knn.Settings())
    assert model.key == "fresh"


def licenses(texts, spark):
    return [(x.n_sentences, x.licenses, x.rules)
            for x in scan_licenses(docs_frame(spark, texts)).orderBy("doc_id").collect()]


def test_license_rules(spark):
    s = license_rules.SENTENCES
    apache = f"{s[11].capitalize()};\n {s[12]}. {s[13]}.\n{s[14]}."
    wrapped = "Permission is hereby granted" + s[3].removeprefix("permission is hereby granted").replace(" of ", "\nof ")
    got = licenses([None, "", "no notice here", "Words before\nReleased under the MIT License.\nmore words",
                    "First. Licensed under CC BY-NC 4.0! Next.", apache, f"{s[12]}. {s[11]}.",
                    f"{wrapped}.\n\n{s[4]}.", "released under the mit licence", "RELEASED UNDER THE MIT LICENSE",
                    "This work is licensed under the GNU General Public License, version 3.\n" * 2], spark)
    assert got == [(0, "", ""), (0, "", ""), (0, "", ""), (1, "MIT", "mit-release"), (1, "CC-BY-NC-4.0", "cc-by-nc"),
                   (4, "Apache-2.0", "apache-header,apache-short-header"), (2, "", ""), (1, "MIT", "mit-grant"),
                   (0, "", ""), (1, "MIT", "mit-release"), (2, "GPL-3.0", "gpl3-notice")]
    assert licenses(awkward(), spark) == [(0, "", "")] * len(awkward())
    assert scan_licenses(docs_frame(spark, ["a"]).limit(0)).count() == 0


def test_license_headers_as_they_are_written(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
           "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n"
           "   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above "
           "copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other "
           "materials provided with the distribution.\n\n")
    third = ("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote "
             "products derived from\n   this software without specific prior written permission.\n")
    header = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {}General "
              "Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n"
              "# (at your option) any later version.\n")
    old = ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General "
           "Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) "
           "any later version.\n")
    got = [x for _, x, _ in licenses([
        "Notes.\nThis project is licensed under the MIT License.\n", "// SPDX-License-Identifier: BSD-3-Clause\nint x;",
        "/* SPDX-License-Identifier: GPL-2.0-only */\n", "mit\nSPDX-License-Identifier: unknown\n", bsd, bsd + third,
        bsd + "\n\n" + bsd + third, header.format(""), header.format("Lesser "), header.format("Affero "), old,
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL"], spark)]
    assert got == ["MIT", "BSD-3-Clause", "GPL-2.0-only", "", "BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause,BSD-3-Clause",
                   "GPL-3.0-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "MPL-2.0"]


def test_license_rules_are_parameters(spark):
    book = license_rules.Rulebook((("house license", 1), ("house program", 2)),
                                  (("one", "House", (1,)), ("both", "House-2", (1, 2))))
    got = [(x.licenses, x.rules) for x in scan_licenses(docs_frame(spark, [
        "House License.", "House license. House program.", "House license. House program. House license.",
        "Released under the MIT license."]), book=book).orderBy("doc_id").collect()]
    assert got == [("House", "one"), ("House-2", "both"), ("House,House-2", "one,both"), ("", "")]


@pytest.mark.parametrize("sentence", sorted(x for x, _ in license_rules.default_rulebook().sentences))
def test_known_sentences_have_a_cue(sentence):
    assert re.search(license_rules.CUE, sentence) and not re.search(r"[^a-z0-9.+ -]", sentence)


def test_repeated_rows_score_alike(spark):
    df = docs_frame(spark, ["released under the mit license."])
    null = spark.createDataFrame([(None, "x", None, None, None, None, None, None)], DOC_SCHEMA)
    rows = scan_licenses(df.unionByName(df).unionByName(null)).collect()
    assert sorted(x.licenses for x in rows) == ["", "MIT", "MIT"]
