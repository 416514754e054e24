import math
import random
import textwrap

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from litsieve.llm import hash_forest, language_id, license_scan

from .data import frame

VOCABULARY = public.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.01"


def test_forward_sums_all_segmentations():
    vocabulary = language_id.Vocabulary(VOCABULARY)
    rnd = np.random.default_rng(2)
    probability = rnd.random((len(vocabulary.pieces), 3)) / 32000
    number = {p: k for k, p in enumerate(vocabulary.pieces) if p}

    def brute(word):
        alpha = [np.ones(3)]
        for j in range(1, len(word) + 1):
            alpha.append(alpha[j - 1] * language_id.BYTE_PROBABILITY + sum(alpha[i] * probability[number[word[i:j]]] for i in range(max(0, j - vocabulary.longest), j) if word[i:j] in number))
        return np.log(alpha[-1])

    for word in (b" the", b" therefore", " très".encode(), b" qqqqzx", b" a"):
        assert np.allclose(vocabulary.forward(np.frombuffer(word, np.uint8)[None], probability)[0], brute(word))
    long = np.frombuffer(b" " + b"the" * 200, np.uint8)[None]
    assert np.isfinite(vocabulary.forward(long, probability)).all() and (vocabulary.forward(long, probability) < -1000).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(docs, VOCABULARY).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.95


def test_language_cases(spark):
    english, german = "the and of that with this then", "der die und das nicht mit ein für"
    rows = [(k, english if k % 2 else german) for k in range(40)] + [(100, None), (101, ""), (102, "12 34 !"), (103, "日本語"), (None, english), (104, "x" * 20000), (1, english)]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("text") == english, "en").when(F.col("text") == german, "de"))
    got = language_id.identify(docs, VOCABULARY).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == "en" and by[2] == "de" and by[None] == "en"
    assert by[100] == by[101] == by[102] == "und" and by[103] != "und" and by[104] != "und"
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), VOCABULARY).collect()} == {"und"}
    assert language_id.identify(frame(spark, []), VOCABULARY).collect() == []


def brute(vectors, k, every):
    out = []
    good = [(i, v) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, v in good:
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_nearest_cases(spark):
    rnd = random.Random(3)
    f32 = lambda: float(np.float32(rnd.gauss(0, 1)))
    vectors = [(k, [f32() for _ in range(8)]) for k in range(60)]
    vectors += [(100 + k, vectors[7][1]) for k in range(40)]  # ties
    vectors += [(200, None), (201, [0.0] * 8), (202, [math.nan] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, [math.inf] * 8), (205, []), (206, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, dim int, shard int")
    got = hash_forest.nearest(table, k=5, every=5, share=1000.0, shard_rows=30).collect()
    want = brute(vectors, 5, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted((q, r, i, round(s, 9)) for q, r, i, s in want)
    assert hash_forest.nearest(table.limit(0)).collect() == []


def test_recall_against_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    x = np.array(rows.embedding.tolist(), np.float64)
    rng = np.random.default_rng(5)
    more = rng.standard_normal((6000, x.shape[1]))
    x = np.concatenate([x, more / np.linalg.norm(more, axis=1)[:, None]])
    queries = np.arange(0, len(x), 60)
    forest = hash_forest.Forest(x)
    got = [set(v.tolist()) for v, _ in hash_forest.best(forest, np.arange(len(x)), x[queries], queries, 20, hash_forest.SHARE)]
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -9
    want = np.argsort(-score, 1)[:, :20]
    assert np.mean([len(g & set(w.tolist())) / 20 for g, w in zip(got, want, strict=True)]) > 0.94
    chosen = [len(c) for c in forest.candidates(x[queries], int(hash_forest.SHARE * len(x)))]
    assert np.mean(chosen) < 0.7 * len(x)
    few = rows.vec_id.to_numpy()[::20]
    everything = hash_forest.nearest(table).toPandas().groupby("query_id").vec_id.apply(set)
    x = x[: len(rows)]
    want = {q: set(rows.vec_id.to_numpy()[np.argsort(-np.where(rows.vec_id == q, -9, x @ x[rows.index[rows.vec_id == q][0]]))[:20]].tolist()) for q in few if q % 20 == 0}
    assert np.mean([len(everything[q] & w) / 20 for q, w in want.items()]) > 0.94


@pytest.mark.parametrize(("line", "expected"), [
    ("Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("She lost her licence in a game of cards.", None),
])
def test_license_lines(line, expected):
    found = license_scan.classify(line)
    assert (found[0] if found else None) == expected


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[2][2]
    rows = [(1, "word " * 30 + "\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "prose of no kind"), (5, "a. b. " * 9000 + "Licensed under CC BY-NC 4.0. " + "c d. " * 9000), (6, mit.replace("free of charge", "without charge") + "\n" + "x\n" * 50 + "Licensed under the Apache License, Version 2.0."), (1, "prose"), (None, "Released under the MIT License.")]
    got = sorted(license_scan.scan(frame(spark, rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.licenses))
    assert [(r.doc_id, r.licenses) for r in got] == [(1, ""), (1, "MIT"), (2, ""), (3, ""), (4, ""), (5, "CC-BY-NC-4.0"), (6, "Apache-2.0,MIT"), (None, "MIT")]
    changed = next(m for m in got[6].matches if m.license == "MIT")
    assert "-free" in changed.differences and changed.gain > 0.5
    assert license_scan.scan(frame(spark, [])).collect() == []


@pytest.mark.parametrize(("text", "expected"), [
    ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("Licensed under the MIT License or the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("This work is licensed under the GNU General Public License, version 2, or the MIT license.", "GPL-2.0,MIT"),
    ("Released under the MIT License. See the MIT license file.", "MIT"),
])
def test_license_scan_finds_every_notice_of_a_block(spark, text, expected):
    (got,) = license_scan.scan(frame(spark, [(1, text)])).collect()
    assert got.licenses == expected and got.n_licenses == expected.count(",") + 1
    assert len(got.matches) == got.n_licenses


def test_all_templates_in_one_block():
    found = license_scan.notices("\n".join(t for _, _, t in license_scan.TEMPLATES))
    assert [f[2] for f in sorted(found)] == [n for n, _, _ in license_scan.TEMPLATES]


@pytest.mark.parametrize("name", sorted({n for n, _, _ in license_scan.TEMPLATES}))
def test_wrapped_notices(name):
    prose = "The rain went on for days and nobody in the town knew when it would end. " * 40
    for template in (t for n, _, t in license_scan.TEMPLATES if n == name):
        for width in (20, 40, 80, 10_000):
            for mark in ("", "# ", " * "):
                lines = textwrap.wrap(template, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False)
                text = "\n".join([prose, *lines, prose])
                found = [f for a, b in license_scan.blocks(text) for f in license_scan.notices(text[a:b])]
                assert [(f[2], f[4]) for f in found] == [(name, 1.0)], (template, width, mark)


def test_standard_notices():
    """As they are published, with blank lines within."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
    zlib = """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
    for text, name in ((bsd, "BSD"), (zlib, "Zlib"), (isc, "ISC")):
        assert [f[2] for a, b in license_scan.blocks(text) for f in license_scan.notices(text[a:b])] == [name]


@pytest.mark.parametrize(("text", "expected"), [
    ("// SPDX-License-Identifier: MIT\nint main() {}", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-only\nimport os", "GPL-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0-or-later"),
    ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0"),
    ("SPDX-License-Identifier: LicenseRef-Own", ""),
])
def test_tags_and_headings(text, expected):
    found = {f[2] for a, b in license_scan.blocks(text) for f in license_scan.notices(text[a:b])}
    assert ",".join(sorted(found)) == expected
