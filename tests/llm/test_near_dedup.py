import random
import re

from weftline.llm import near_dedup as near


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """component by row, for rows with distinct ids"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(6, 300))]
        texts.append(base)
        for _ in range(rng.randint(0, 8)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, max(1, len(copy) // 35))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    # a chain in which neighbours are alike and the ends aren't
    stream = [word() for _ in range(700)]
    texts += [stream[i * 10 : i * 10 + 200] for i in range(45)]
    shared = [word() for _ in range(60)]
    texts += [[word() for _ in range(30)] + shared + [word() for _ in range(30)] for _ in range(30)]
    texts += [["one", "two"], ["One", "TWO"], ["one two three"], ["x"], ["é", "É"]]
    rng.shuffle(texts)
    rows = [(3 * i + 1, (" \n" if i % 7 == 0 else " ").join(t)) for i, t in enumerate(texts)]
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "same " * 400), (5004, "same " * 90)] + [(6000 + i, "exactly the same text again and again in many rows") for i in range(50)]


def test_against_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'a' AS rep", "2 AS component")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(frame).collect()}
    assert got == brute(rows)
    kept = near.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(i for i, x in brute(rows).items() if x[2])


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.near_duplicates(empty).count() == 0 and near.one_of_each(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (None, "a b c d e f"), (2, "u v w x y z")]
    got = sorted(map(tuple, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 2, None, True)], key=repr)


def test_odd_sketch_estimates(spark):
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(400)]
    for changed, low, high in ((0, 0.99, 1.01), (8, 0.7, 0.95)):
        other = list(base)
        for i in rng.sample(range(400), changed):
            other[i] = "z" + str(i)
        frame = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
        a, b = (near.signatures(frame).where(f"doc_id = {i}").selectExpr(f"sketch AS s{i}") for i in (1, 2))
        value = a.join(b).select(near.estimate(a.s1, b.s2).alias("e")).first().e
        assert low <= value <= high
