import math
import random
import re
import string
import zlib

import numpy as np

from weftline.llm import quality_score as quality


def docs(n=600, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.8
        if not good:
            words = [[w + rng.choice(["$$$", "%%%"]) for w in words], [w.upper() + "!!" for w in words], words[:1] * 80][i % 3]
        rows.append((i, " ".join(words) + ".", int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = docs()
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 10] + [(None, 1), (3, None)], "doc_id long, quality int")
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "'a' AS x", "1 AS score")
    got = {r.doc_id: r for r in quality.quality_scores(frame, labels).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned(spark):
    rows = docs(200)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    a, b = (quality.quality_scores(frame, spark.createDataFrame(x, "doc_id long, quality int")).collect() for x in ([(i, q) for i, _, q in rows], flipped))
    assert sorted(a) == sorted(b)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None), (1, None), (2, ""), (None, "a b c"), (3, "w " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.quality_scores(frame, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.3}
    assert quality.quality_scores(frame.where("false"), none).count() == 0


def plain_features(text):
    """The features of one text, in plain Python."""
    text = text or ""
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))))
    raw = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    size, some = max(len(text), 1), max(len(words), 1)
    of = lambda chars: sum(data.count(c.encode()) for c in chars) / size
    symbols = "#*$%&<>@^~=+_{}[]\\/"
    ends = lambda chars: sum(w[-1:].decode("latin-1") in chars for w in raw) / some
    return {
        "log_words": math.log1p(len(words)), "word_length": size / some, "upper": of(string.ascii_uppercase), "digits": of(string.digits), "symbols": of(symbols),
        "exclamations": of("!"), "pipes": of("|"), "stops": of(".?"), "commas": of(",;:"), "end_symbols": ends(symbols), "end_exclamations": ends("!"),
        "next_repeats": sum(a == b for a, b in zip(words, words[1:])) / some, "distinct": len(set(words)) / some,  # noqa: B905
        "line_words": math.log1p(len(words) / max(len(lines), 1)), "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "beyond_ascii": sum(b >= 0xC0 for b in data) / size,
    }


def test_scores_against_brute_force(spark):
    """Features by plain Python, the fit by plain loops of a few steps, and the scores of every text."""
    rows = docs(300)
    texts = [t for _, t, _ in rows] + ["", None, "é Ü|x\nx\nx\n\ny!! #1 a a, b.", " \n\t", "w " * 30_000]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(frame, labels).collect()}
    x = np.array([[plain_features(t)[f] for f in quality.FEATURES] for t in texts])
    learn = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5]
    model = quality.fit(x[learn], np.array([rows[i][2] == 1 for i in learn]))
    bad = sum(rows[i][2] == 0 for i in learn)
    raw = np.array([sum(min(max((v - m) / d, -quality.CLIP), quality.CLIP) * w for v, m, d, w in zip(row, model.mean, model.deviation, model.weights, strict=True)) for row in x])
    scores = 1 / (1 + np.exp(-(model.slope * (raw - model.threshold) + math.log(0.3 / 0.7))))
    assert (raw[learn] < model.threshold).sum() == bad  # the quantile at the share of bad documents
    assert all(abs(got[i].score - s) < 1e-6 for i, s in enumerate(scores))


def test_weights_maximise_the_pairs_likelihood():
    """No small step away from the fitted weights makes the preferences likelier."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    good = x[:, 0] - 0.5 * x[:, 3] + rng.normal(scale=0.8, size=400) > -0.8
    model = quality.fit(x, good)
    z = np.clip((x - model.mean) / model.deviation, -quality.CLIP, quality.CLIP)

    def loss(w):
        apart = (z[good] @ w)[:, None] - (z[~good] @ w)[None, :]
        return np.log1p(np.exp(-apart)).mean() + quality.RIDGE / 2 * (w**2).sum()

    best = loss(model.weights)
    for i in range(x.shape[1]):
        for step in (-0.15, 0.15):
            moved = model.weights.copy()
            moved[i] += step
            assert loss(moved) > best - 2e-4


def test_every_pair_counts():
    """The fit has no gradient left over all pairs, not over a part of them."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    good = x[:, 0] - 0.5 * x[:, 3] + rng.normal(scale=0.5, size=500) > -0.8
    model = quality.fit(x, good)
    z = np.clip((x - model.mean) / model.deviation, -quality.CLIP, quality.CLIP)
    loses = 1 / (1 + np.exp((z[good] @ model.weights)[:, None] - (z[~good] @ model.weights)[None, :]))
    gradient = (loses.sum(axis=1) @ z[good] - loses.sum(axis=0) @ z[~good]) / loses.size - quality.RIDGE * model.weights
    assert np.abs(gradient).max() < 1e-7


def test_every_label_counts(spark):
    """Of 26,000 labelled documents, the threshold leaves as many below it as are labelled bad."""
    rng = random.Random(8)
    bad = [rng.random() < 0.3 for _ in range(26_000)]
    rows = [(i, " ".join("".join(rng.choices("abcdefABC123.,;#|é", k=rng.randint(2, 9))) for _ in range(rng.randint(9, 40))) + "!%" * (rng.randint(0, 3) + b), int(not b)) for i, b in enumerate(bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.quality_scores(frame.drop("quality"), frame.drop("text")).where("not held_out").select("doc_id", "predicted").toPandas()
    assert len(got) > 20_500
    assert abs((got["predicted"] == 0).sum() - sum(bad[i] for i in got["doc_id"])) <= 1


def test_values_at_ranks(spark):
    """Against sorting, with repeated, tiny, huge and equal values."""
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [1e300, -1e300, 5e-324, 0.0, 1.0, 1.0 + 2**-52] * 3, [2.5] * 7):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        for rank in (0, len(values) // 3, len(values) - 1):
            assert quality.at_rank(rows, "v", rank) == sorted(values)[rank]
