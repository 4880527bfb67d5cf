import functools
import math
import random
import re
import zlib

import numpy as np

from weftline.llm import tokens
from weftline.llm import toxicity as tox
from weftline.llm.common import splitmix

BAD = ["grumbleä", "grumbleö", "grumbler", "snarkly", "blargh"]


def docs(n=900, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéfghij", k=rng.randint(2, 7)))
    rows = []
    for i in range(n):
        sentences = [[word() for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(2, 25))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                rng.choice(sentences).insert(1, rng.choice(BAD))
        rows.append((i, ". ".join(" ".join(s).capitalize() for s in sentences) + ".", int(toxic)))
    return rows


def test_held_out_documents_and_their_sentences(spark):
    rows = docs()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1), (4, None), (10**9, 1)], "doc_id long, toxic int")
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "'a' AS toxic", "1 AS score")
    got = {r.doc_id: r for r in tox.toxicity(frame, labels).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in rows if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    for i, text, t in rows:
        for s in got[i].offending:
            assert any(b in text[s.start : s.end].lower() for b in BAD)
            assert "." not in text[s.start : s.end]
        assert bool(got[i].offending) == bool(t) or got[i].held_out


def test_held_out_labels_are_not_learned(spark):
    rows = docs(300)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in rows]
    a, b = (tox.toxicity(frame, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score").collect() for x in ([(i, t) for i, _, t in rows], flipped))
    assert sorted(a) == sorted(b)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, None), (1, None), (2, ""), (None, "a. b! c"), (3, "w. " * 100_000), (4, "...")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = tox.toxicity(frame, none).collect()
    assert len(got) == 6 and {r.predicted for r in got} <= {0, 1} and {r.score for r in got if r.doc_id in (1, 2, 4)} == {0.0}
    assert tox.toxicity(frame.where("false"), none).count() == 0


def test_scores_against_brute_force(spark):
    """Sentences, features and noisy-or of every text, in plain Python, with the learned weights."""
    rows = docs(400)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "A!b?\nGrumbler... é; snarkly x\n\n!"), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = tox.learned(tox._sample(frame, labels, tox.remainder(3) != 1))
    weights = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    assert weights

    @functools.cache
    def word_features(word):
        data = np.frombuffer(word, np.uint8)
        name = lambda n: tokens.span_hashes(data[:n], np.array([0]), np.array([n]))
        return {int(name(len(word))[0])} | {int(splitmix(name(n) + np.uint64(n))[0]) for n in tox.HEADS if len(word) > n}

    def score(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            words = re.findall(rb"[a-z0-9\x80-\xff]+", sentence.encode().lower())
            inside = set().union(*map(word_features, words))
            clean *= 1 if not words else 1 - 1 / (1 + math.exp(-(model.bias + sum(weights.get(f, 0.0) for f in inside))))
        return 1 - clean

    texts = {r.doc_id: r.text for r in frame.collect()}
    got = tox.toxicity(frame, labels).collect()
    wrong = {r.doc_id: (r.score, score(texts[r.doc_id])) for r in got if abs(r.score - score(texts[r.doc_id])) >= 1e-6}
    assert not wrong


def test_cross_validation_never_reads_the_held_fold(spark):
    rows = docs(200)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, _, t in rows]
    tried = [tox.SETTINGS, tox.SETTINGS._replace(ridge=3.0)]
    a, b = (tox.cross_validated(frame, spark.createDataFrame(x, "doc_id long, toxic int"), tox.remainder(3) != 1, tried, 2) for x in ([(i, t) for i, _, t in rows], flipped))
    assert a == b and len(a) == 2 and a[0][0] <= a[1][0]


def test_long_texts_are_learned_from(spark):
    """A labelled text of any length takes part in training."""
    rng = random.Random(2)
    filler = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(12_000))
    rows = [(i, f"{filler}. such blargh there." if i % 3 == 0 else f"fine text {i}. so be it.", int(i % 3 == 0)) for i in range(90)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = tox.toxicity(frame, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.predicted for r in got} == {i: t for i, _, t in rows}
