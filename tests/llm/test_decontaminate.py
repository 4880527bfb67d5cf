import random
import re

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import decontaminate as dec


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def brute(item, doc):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, v in enumerate(doc):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (w != v)))
        row = new
    return min(row)


def case(seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 5)))
    items = [(i, [word() for _ in range(rng.choice([5, 6, 8, 11, 12, 20, 40, 70]))]) for i in range(30)]
    docs = []
    for d in range(150):
        text = [word() for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            leaked = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(leaked) // 5)):
                p, kind = rng.randrange(len(leaked)), rng.randrange(3)
                leaked[p : p + 1] = [[word()], [], [leaked[p], word()]][kind]
            at = rng.randint(0, len(text))
            text[at:at] = leaked
        docs.append((d, " ".join(w.upper() if d % 2 else w for w in text)))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_recall_and_exactness(spark):
    docs, items = case()
    got = {(r.doc_id, r.item_id): r.edits for r in dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            w = words(item)
            edits = brute(w, words(text))
            if edits <= len(w) // dec.ALLOWED:
                want[d, i] = edits
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and len(want) >= 40
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five"), (3, "One Two x four five"), (None, "one two three four five"), (4, "w " * 50_000)], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS words")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, "too short"), (4, None), (5, "")], "item_id long, text string")
    got = sorted((repr(r.doc_id), r.item_id, r.edits) for r in dec.leaks(docs, items).collect())
    assert got == [("3", 1, 0), ("3", 2, 0), ("None", 1, 0), ("None", 2, 0)]
    kept = dec.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs, items.where("item_id = 3"))):
        assert dec.leaks(d, i).count() == 0 and dec.without_leaks(d, i).count() == d.count()


def replaced(spark, cases, each):
    """The share found, by case, of items (length, places) leaked with new words at these places (None: random ones, n // 4)."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10))
    docs, items, of = [], [], {}
    for case, (n, places) in enumerate(cases):
        for _ in range(each):
            item = [word() for _ in range(n)]
            put = places if places is not None else rng.sample(range(n), n // dec.ALLOWED)
            leaked = [word() if i in put else w for i, w in enumerate(item)]
            of[len(items)] = case
            docs.append((len(items), " ".join([*(word() for _ in range(30)), *leaked, *(word() for _ in range(30))])))
            items.append((len(items), " ".join(item)))
    got = dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id == r.item_id for r in got)
    return [sum(of[r.item_id] == c for r in got) / each for c in range(len(cases))]


def test_edits_in_the_middle(spark):
    """Edits that stand in every window of an item at once."""
    found = replaced(spark, [(16, {5, 7, 9, 11}), (20, {1, 8, 9, 10, 11}), (8, {3, 4}), (32, {8, 9, 10, 11, 20, 21, 22, 23})], 40)
    assert all(found)


def test_allowed_edits_leave_a_run():
    for n in range(min(dec.SIZES), 2000):
        size = max(s for s in dec.SIZES if s <= n)
        edits = n // dec.ALLOWED
        assert -((edits - n) // (edits + 1)) >= dec.KEPT_RUN[size]


def test_recall_at_the_most_edits(spark):
    """The stated recall, by length, with all the edits that are allowed."""
    lengths = [5, 6, 8, 11, 12, 15, 16, 20, 23, 24, 32]
    found = replaced(spark, [(n, None) for n in lengths], 100)
    assert all(share >= dec.TARGET for share in found), dict(zip(lengths, found, strict=True))


def test_plain_items(spark):
    """Items of one or two words over and over, their copies and copies with edits."""
    texts = ["na " * 5, "ho " * 12, "la " * 30, "ding dong " * 6, "tick tick tock " * 5]
    filler = " ".join(f"x{i}" for i in range(40))
    docs = [(i, f"{filler} {t} {filler}") for i, t in enumerate(texts)] + [(10, f"{filler} ho ho ho y ho ho ho z ho ho ho ho {filler}")]
    got = dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in got} == {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (4, 4): 0, (10, 1): 2}


def test_words_in_another_order_are_another_region(spark):
    """Two rows of one id whose texts differ in the order of words only, and items without an id."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    mixed = "eta alpha theta gamma beta zeta epsilon delta"
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {mixed} y"), (None, f"x {mixed} y"), (None, f"x {item} y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (None, item), (2, mixed)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dec.leaks(docs, items).collect()}
    assert got == {(d, i): 0 for d in (1, None) for i in (1, 2, None)}


def test_bitmaps_grow(spark):
    assert [dec.bits_for(n) for n in (0, 10**6, 4 * 10**6, 10**12)] == [24, 24, 26, 28]
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    flags = dec.bitmap(keys, 16)
    own = np.array([r.k for r in keys.collect()]).view(np.uint64)
    other = np.array([r.k for r in spark.range(1000, 3000).select(F.xxhash64("id").alias("k")).collect()]).view(np.uint64)
    assert dec._in(flags, own).all() and dec._in(flags, other).mean() < 0.05


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "doc_id long, text string").selectExpr("*", "1 AS _hit", "2 AS wanted", "3 AS item_id", "4 AS `a.b`")
    items = spark.createDataFrame([(1, "A b c d e f")], "item_id long, text string")
    out = dec.without_leaks(docs, items)
    assert out.columns == docs.columns and out.collect() == docs.where("doc_id = 2").collect()
