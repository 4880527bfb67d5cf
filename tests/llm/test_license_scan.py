import random
import re
import time

import pytest

from weftline.llm import license_scan as lic


@pytest.mark.parametrize(("text", "labels", "permissive"), [
    ("MIT", {"mit"}, True),
    ("(MIT OR GPL-2.0-only) AND Apache-2.0 */", {"mit", "gpl", "apache"}, True),
    ("MIT or GPL-2.0-only and AGPL-3.0", {"mit", "gpl"}, True),
    ("(MIT OR GPL-2.0) AND GPL-3.0-or-later WITH Classpath-exception-2.0", {"mit", "gpl"}, False),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR ISC trailing words", {"gpl", "isc"}, True),
    ("((Zlib))", {"zlib"}, False),
])
def test_expressions(text, labels, permissive):
    got = lic.evaluate(text)
    assert (set(got.labels), got.permissive) == (labels, permissive)


@pytest.mark.parametrize("text", ["", "AND", "(MIT", "MIT OR", "MIT AND ) x", "()"])
def test_broken_expressions(text):
    assert lic.evaluate(text) is None


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, p) for p in lic.BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({lic.BASE_PHRASES[p] for _, p in places}))


def test_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "-", "Ünï", "é", "\n", "GENERAL-PUBLIC\tLICENSE", "mit", "x1"]
    texts = [None, "", "mit license", "MIT LICENSE mit license", "mitlicense mit licenses", "y" * 100_000 + " the MIT License"]
    texts += ["".join(rng.choice(parts) + rng.choice([" ", "", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (0, None), (None, "MIT license")], "doc_id long, text string").selectExpr("*", "'l' AS labels", "1 AS score")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lic.notices(docs).collect())
    key = lambda x: tuple((v is not None, v) for v in x)
    want = [*((True, i, *brute(t)) for i, t in enumerate(texts)), (True, 0, *brute(None)), (False, 0, *brute("MIT license"))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_tags(spark):
    rows = [(1, "/* SPDX-License-Identifier: MIT OR Apache-2.0 */"), (2, "SPDX-License-Identifier: (MIT\nAll rights reserved."), (3, "nothing")]
    got = {r.doc_id: r for r in lic.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].permissive, round(got[1].score, 3), got[1].n_base) == ("apache,mit", True, 0.95, 0)
    assert (got[2].labels, got[2].permissive, got[2].expressions) == ("proprietary", None, ["(MIT"])
    assert (got[3].labels, got[3].score) == ("", 0.0)
    assert lic.notices(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tags_by_their_words(spark):
    """Whatever stands between a tag's words, its expression is what is left of the line."""
    texts = [
        "SPDX License  Identifier: MIT", "spdx-license-identifier:\nGPL-2.0", "SPDX-License-Identifier\tISC # x", "é SPDX_LICENSE_IDENTIFIER :BSD-3-Clause\r\nMIT license",
        "SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0", "spdx-license-identifier",
    ]
    got = {r.doc_id: r for r in lic.notices(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "", "isc", "bsd,mit", "gpl,mit", ""]
    assert [got[i].expressions for i in range(4)] == [["MIT"], [""], ["ISC # x"], ["BSD-3-Clause"]]
    assert got[4].expressions == ["MIT SPDX-License-Identifier: GPL-2.0", "GPL-2.0"] and got[4].permissive is False
    assert [round(got[i].score, 4) for i in (0, 1, 3, 5)] == [0.95, 0.5, 0.99, 0.5]


def test_labels_against_brute_force(spark):
    """Labels, score and expressions by plain searches over the words."""
    rng = random.Random(8)
    every = {**lic.BASE_PHRASES, **lic.MORE_PHRASES}
    parts = [*every, "SPDX-License-Identifier: MIT OR Zlib\n", "SPDX-License-Identifier: (GPL-2.0\n", "spdx license", "identifier", "words,", "all rights", "reserved"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(150)]

    def want(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        inside = {p for p in [*every, lic.TAG] if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        labels, doubt, said = {every[p] for p in inside if p in every}, 0.2 ** len(inside - {lic.TAG}), []
        for m in re.finditer(r"spdx\W+license\W+identifier\b", text, re.I):
            said.append(text[m.end() :].split("\n")[0].lstrip(" \t").removeprefix(":").strip())
            value = lic.evaluate(said[-1])
            doubt *= 0.05 if value else 0.5
            labels |= value.labels if value else set()
        return ",".join(sorted(labels)), round(1 - doubt, 9), said

    got = {r.doc_id: (r.labels, round(r.score, 9), r.expressions) for r in lic.notices(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_time_is_linear(spark):
    """A megabyte of phrases, and of tags, takes seconds."""
    texts = ["mit license apache license " * 40_000, "SPDX-License-Identifier: MIT\n" * 35_000, "general public license\n" * 45_000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in lic.notices(docs).collect()}
    assert time.time() - began < 40
    assert [got[0].n_base, got[0].first_word, got[0].last_word, got[2].n_base] == [80_000, 0, 159_998, 45_000] and len(got[1].expressions) == 35_000
