import random
import re
from collections import defaultdict

import numpy as np

from weftline.llm import mixing


def test_targets_by_hand():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, 100.0 * 250 / 300, 100.0 * 500 / 300]
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2) == [20.0, 1495.0]
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 0], [3, 1], 1.5, 2) == [0.0, 0.0]


def test_permutations():
    for n in (1, 2, 3, 64, 1000):
        for key in (1, 77):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))


def test_draws():
    """Shards' counts add up to shards and totals, vary as multinomial draws do, and don't depend on who draws."""
    totals = np.array([500_000, 300_000, 0, 200_000, 1])
    every = list(mixing.draws(totals, 0, 10**9))
    counts = np.array([c for _, c, _ in every])
    assert (counts.sum(axis=0) == totals).all() and (counts[:-1].sum(axis=1) == mixing.SHARD).all()
    assert (np.array([b for _, _, b in every]) == np.cumsum(counts, axis=0) - counts).all()
    some = list(mixing.draws(totals, 17, 23))
    assert [s for s, _, _ in some] == list(range(17, 23)) and all((c == counts[s]).all() for s, c, _ in some)
    p = totals[:2] / totals.sum()
    spread = counts[:-1, :2].var(axis=0) / (mixing.SHARD * p * (1 - p))
    assert ((0.7 < spread) & (spread < 1.3)).all()


def test_draws_of_any_size():
    """Beyond what numpy draws exactly, halves still add up and vary as they should."""
    counts = np.array([6 * 10**10, 3 * 10**10, 10**10])
    found = np.array([mixing.halved(counts, 0, 2 + i, 5 * 10**10) for i in range(300)])
    assert (found.sum(axis=1) == 5 * 10**10).all() and (found <= counts).all() and (found >= 0).all()
    sigma = np.sqrt(5e10 * 0.6 * 0.4 * 0.5)
    assert abs(found[:, 0].mean() - 3e10) < sigma / 4 and 0.8 < found[:, 0].std() / sigma < 1.2


def docs(n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "é y", "a\x0bb", "w"]) + " w" * rng.randint(0, 300), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "ü", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "only empty"), (n + 2, " \n", None), (None, "one two", "b"), (0, "same id", "hot"), (0, "same id", "hot"), (n + 3, "w " * 20_000, "b")] + [(None, None, None)] * 50


def test_mix(spark):
    rows = docs()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS start")
    got = mixing.mixing(frame).collect()
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(int)
    for _, t, s in rows:
        by_source[s] += size_of(t)
    order = sorted(by_source, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, mixing.targets([by_source[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r["size"], r.source_size, r.target) for r in got), key=key) == sorted(((i, size_of(t), by_source[s], goal[s]) for i, t, s in rows), key=key)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    for s in order:
        assert abs(taken[by_source[s]] - goal[s]) <= mixing.BLOCK
    again = mixing.mixing(frame.repartition(7)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


def test_blocks_cover_streams_once(spark):
    placed, slots = mixing.mix(spark.createDataFrame(docs(500, 2), "doc_id long, text string, source string"))
    words = defaultdict(int)
    for r in mixing.document_blocks(placed).collect():
        words[r.source_no, r.block] += r.words
    for s in {k[0] for k in words}:
        own = [words[s, b] for b in range(1 + max(b for t, b in words if t == s))]
        assert all(w == mixing.BLOCK for w in own[:-1]) and 0 < own[-1] <= mixing.BLOCK
    used = [(r.source_no, r.block) for r in slots.collect()]
    assert set(used) <= set(words) and max(used.count(u) for u in set(used)) <= 2


def test_nothing_to_mix(spark):
    assert mixing.mixing(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert mixing.mixing(spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")).collect() == [(1, 0, 0, 0.0, 0)]
