"""Benchmark passages in documents, by CGK embedding, bit sampling and exact edit distance.

A benchmark item leaks into a document if some stretch of the document's words is
within an edit distance (words inserted, deleted or replaced) of a quarter of the
item's length, rounded down. Words are compared after lower-casing A-Z.

* The random walk of Chakraborty, Goldenberg and Koucky copies the word at a pointer
  to its output and moves the pointer on by a random bit of step and word. Windows at
  a small edit distance get outputs at a small Hamming distance.
* Windows have the size of the largest class (12, 5) that fits into the item; items of
  fewer than 5 words are no passages, as shingles of fewer words aren't elsewhere. Every
  window of every item and every window of every document is embedded, by eight walks.
* Each of 8 tables a walk samples 4 (size 5: 3) output positions; one equal sample
  makes a candidate. As every offset within an item is tried, an item is missed only if all
  its windows disagree in all tables. Walks, tables and positions are chosen for a recall
  of TARGET or more at the most allowed edits, at every length of item (random places).
  Items of 12 words have a single window and are the hardest. Windows of an item's own
  length would be harder still: a quarter of their words may differ, and the walks of
  longer windows rarely meet again after so many edits, while of several short windows
  one has few of them.
* Neighbouring candidate windows make one region; its exact semi-global edit distance
  to the item decides. A region that lacks more of the item's words than edits are
  allowed has a greater distance and isn't measured.

Items of equal words are searched as one. Document windows go through bitmaps of the
items' samples, which grow with the benchmark up to MOST_BITS; beyond that, more windows
pass, and only the join that follows has more work. Only windows that pass are joined to
the items; a sample that many documents and items share is a key whose rows Spark splits
over tasks, and pairs are made distinct within each task first. Before the walks, windows
are left out that have no run of 3 (size 5: 2) consecutive words of some item nearby. This
loses no leak: at most n // 4 edits leave n - n // 4 of an item's n words in at most
n // 4 + 1 runs, so that one has 3 words or more if n is 12 or more, and 2 if n is 5 or
more. All windows within two sizes of the run are walked.

Defined results: null or empty texts and items match nothing; a null doc_id or item_id is
reported as null; rows of one doc_id report their smallest distance; repeated items
each report; texts and items of any length are read whole, the longest in a batch of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import by_size, odd_constants, of_ids, signed, splitmix, text_bytes, written

SIZES = (12, 5)
TARGET = 0.9  # recall at n // ALLOWED edits, for every length n
WALKS, TABLES = 8, 8
SAMPLED = {12: 4, 5: 3}  # outputs by size
LEAST_BITS, MOST_BITS = 24, 28  # logarithms of the bitmaps' sizes
BITS_A_KEY = 16
ALLOWED = 4  # one edit for so many words
LEAST_CHANGES = {12: 2, 5: 1}
NO_KEY = np.uint64(0)
#: Consecutive words that the allowed edits leave together somewhere in every item of a size class.
KEPT_RUN = {12: 3, 5: 2}

_WALK = odd_constants(WALKS, 21)


def _plan(size: int) -> list[list[np.ndarray]]:
    """The output positions that each table of each walk samples."""
    rng = np.random.default_rng(size)
    return [[np.sort(rng.choice(3 * size // 2, SAMPLED[size], replace=False)) for _ in range(TABLES)] for _ in range(WALKS)]


def _different(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """How many different words the windows have."""
    n = np.ones(len(at), np.int64)
    for j in range(1, size):
        word = hashes[at + j]
        fresh = np.ones(len(at), bool)
        for i in range(j):
            fresh &= hashes[at + i] != word
        n += fresh
    return n


def samples(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The sampled outputs, hashed, of the windows of ``size`` words that begin at ``at``: a column a table.

    A walk may stay on a frequent word; a sample in which the word changes too seldom
    tells nothing and is NO_KEY, for items and documents alike. Windows in which at most
    half of the words are different have no better samples and keep all.
    """
    keys = np.empty((len(at), WALKS * TABLES), np.uint64)
    plain = _different(hashes, at, size) <= size // 2
    step_type = np.uint64
    for walk, tables in enumerate(_plan(size)):
        coins = splitmix(hashes ^ _WALK[walk])
        pointer = at.copy()
        mult = odd_constants(TABLES * SAMPLED[size], 100 * size + walk)
        sums = np.zeros((TABLES, len(at)), np.uint64)
        latest = np.zeros((TABLES, len(at)), np.uint64)
        changes = np.full((TABLES, len(at)), -1, np.int8)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for t, steps in enumerate(tables):
            for k, j in enumerate(steps):
                wanted.setdefault(int(j), []).append((t, k))
        for j in range(max(wanted) + 1):
            inside = np.minimum(pointer, at + (size - 1)) if j >= size else pointer
            if j in wanted:
                word = hashes[inside]
                if j >= size:
                    word = np.where(pointer - at < size, word, step_type(0))
                for t, k in wanted[j]:
                    sums[t] += word * mult[t * SAMPLED[size] + k]
                    changes[t] += word != latest[t]
                    latest[t] = word
            pointer = pointer + ((coins[inside] >> step_type(j)) & step_type(1)).astype(np.int64)
        for t in range(TABLES):
            key = splitmix(sums[t] + mult[t * SAMPLED[size]] + step_type(size))
            keys[:, walk * TABLES + t] = np.where(plain | (changes[t] >= LEAST_CHANGES[size]), key, NO_KEY)
    return keys


def _windows(w: tokens.Words, size: int) -> np.ndarray:
    """Where a window of ``size`` words fits into its text."""
    if len(w.hashes) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.text[: len(w.text) - size + 1] == w.text[size - 1 :])


def _class_of(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n), np.int64)
    for size in sorted(SIZES):
        out[n >= size] = size
    return out


def _runs(w: tokens.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that stand for a size class, and where they begin."""
    h, at = tokens.runs_of(w, KEPT_RUN[size])
    return splitmix(h + np.uint64(size)), at


def _near(w: tokens.Words, size: int, at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The windows within two sizes of which a run of some item of the size class begins."""
    h, begins = _runs(w, size)
    found = np.zeros(len(w.hashes), np.int64)
    found[begins[_in(flags, h)]] = 1
    before = np.concatenate([[0], np.cumsum(found)])
    low = np.maximum(at - 2 * size, w.first[w.text[at]])
    high = np.minimum(at + 3 * size, w.first[w.text[at] + 1])
    return at[before[high] > before[low]]


def item_keys(items: DataFrame) -> DataFrame:
    """Rows (item_id, size, words, runs, keys) for the items that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            w = tokens.words(data, offsets)
            sizes = _class_of(np.diff(w.first))
            rows = {"item_id": [], "size": [], "words": [], "runs": [], "keys": []}
            for size in SIZES:
                at = _windows(w, size)
                at = at[sizes[w.text[at]] == size]
                keys = samples(w.hashes, at, size)
                runs, begins = _runs(w, size)
                for d in np.unique(w.text[at]):
                    rows["item_id"].append(batch.column("item_id")[int(d)].as_py())
                    rows["size"].append(size)
                    rows["words"].append(signed(w.hashes[w.first[d] : w.first[d + 1]]).tolist())
                    rows["runs"].append(signed(np.unique(runs[w.text[begins] == d])).tolist())
                    rows["keys"].append(signed(np.setdiff1d(keys[w.text[at] == d], NO_KEY)).tolist())
            yield pa.RecordBatch.from_pydict(rows, schema=types)

    longs = pa.list_(pa.int64())
    types = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("words", longs), ("runs", longs), ("keys", longs)])
    shape = "item_id bigint, size int, words array<bigint>, runs array<bigint>, keys array<bigint>"
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(run, shape)


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(64 - bits)).astype(np.int64), ((keys << np.uint64(bits)) >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(keys: int) -> int:
    """The logarithm of a bitmap's size for so many keys."""
    return min(max(LEAST_BITS, math.ceil(math.log2(max(1, keys * BITS_A_KEY)))), MOST_BITS)


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of two probes over the longs of a one-column table, packed in segments on Spark.

    Its 2^bits bits, as bytes, are all that comes to the driver, however many values there are.
    """
    name = values.columns[0]
    low = F.shiftrightunsigned(name, 64 - bits)
    second = F.shiftrightunsigned(F.shiftleft(name, bits), 64 - bits)
    slots = values.select(F.explode(F.array(low, second)).alias("slot")).distinct().select(F.floor(F.col("slot") / 65536).cast("long").alias("segment"), (F.col("slot") % 65536).alias("bit"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(65536, bool)
        flags[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "bytes": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in slots.groupBy("segment").applyInPandas(pack, "segment bigint, bytes binary").toLocalIterator():
        out[row["segment"] * 8192 : (row["segment"] + 1) * 8192] = np.frombuffer(row["bytes"], np.uint8)
    return out


def _set(flags: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (flags[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _in(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of a bitmap."""
    a, b = _slots(keys, int(len(flags)).bit_length() + 2)
    hit = _set(flags, a)
    hit[hit] = _set(flags, b[hit])
    return hit


def regions(docs: DataFrame, sizes: list[int], longest: int, keys_at: Broadcast) -> DataFrame:
    """Rows (doc_id, region, words, keys): stretches around windows that share a sample with some item.

    ``keys_at`` has the bitmaps of the items' samples and of their runs.
    """
    reach = longest + longest // ALLOWED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_flags, run_flags = keys_at.value
        schema = pa.schema([("doc_id", pa.int64()), ("region", pa.int64()), ("words", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
        for batch in batches:
            for part in by_size(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                w = tokens.words(data, offsets)
                found_at, found_key = [], []
                for size in sizes:
                    at = _near(w, size, _windows(w, size), run_flags)
                    for low in range(0, len(at), 1 << 15):
                        some = at[low : low + (1 << 15)]
                        keys = samples(w.hashes, some, size)
                        row, table = np.nonzero((keys != NO_KEY) & _in(key_flags, keys.ravel()).reshape(keys.shape))
                        found_at.append(some[row])
                        found_key.append(keys[row, table])
                if not found_at or not sum(map(len, found_at)):
                    continue
                at, key = np.concatenate(found_at), np.concatenate(found_key)
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                fresh = np.concatenate([[True], (np.diff(at) > longest) | (np.diff(w.text[at]) > 0)])
                begins = np.flatnonzero(fresh)
                ends = np.append(begins[1:], len(at))
                rows = {"doc_id": [], "region": [], "words": [], "keys": []}
                ids = part.column("doc_id")
                for b, e in zip(begins, ends, strict=True):
                    d = int(w.text[at[b]])
                    low, high = max(int(w.first[d]), int(at[b]) - reach), min(int(w.first[d + 1]), int(at[e - 1]) + reach)
                    stretch = w.hashes[low:high]
                    rows["doc_id"].append(ids[d].as_py())
                    # a hash of the words in their order, and of their place
                    placed = splitmix(stretch ^ splitmix(np.arange(low, high, dtype=np.uint64))).sum(dtype=np.uint64)
                    rows["region"].append(int(signed(splitmix(np.array([placed])))[0]))
                    rows["words"].append(signed(stretch).tolist())
                    rows["keys"].append(signed(np.unique(key[b:e])).tolist())
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, region bigint, words array<bigint>, keys array<bigint>")


def least_distance(item: np.ndarray, stretch: np.ndarray) -> int:
    """The smallest edit distance between the item and any stretch of consecutive words."""
    steps = np.arange(len(stretch) + 1)
    row = np.zeros(len(stretch) + 1, np.int64)
    for i, word in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (stretch != word))
        new[0] = i + 1
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, item_words, edits) for every leak found."""
    spark = docs.sparkSession
    every = written(item_keys(items), "leak-items")
    # items of equal words are one, under a number that is fixed by writing it
    alike = every.groupBy("words").agg(*(F.first(c).alias(c) for c in ("size", "runs", "keys")))
    known = written(alike.withColumn("item", F.monotonically_increasing_id()), "leak-known")
    sums = F.max(F.size("words")).alias("longest"), F.collect_set("size").alias("sizes"), F.sum(F.size("keys")).alias("keys"), F.sum(F.size("runs")).alias("runs")
    shape = known.agg(*sums).first()
    if shape["longest"] is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, item_words int, edits int")
    by_key = known.select(F.explode("keys").alias("key"), "item").distinct()
    maps = spark.sparkContext.broadcast((bitmap(by_key.select("key"), bits_for(shape["keys"])), bitmap(known.select(F.explode("runs").alias("key")), bits_for(shape["runs"]))))
    found = written(regions(docs, sorted(shape["sizes"]), shape["longest"], maps), "leak-regions")
    maps.destroy()
    pairs = found.select("doc_id", "region", F.explode("keys").alias("key")).join(by_key, "key").select("doc_id", "region", "item").distinct()
    stretches = found.select(F.col("doc_id").alias("d"), F.col("region").alias("r"), F.col("words").alias("stretch")).dropDuplicates(["d", "r"])
    both = pairs.join(known.select("item", "words"), "item").join(stretches, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("region") == F.col("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, n = [], []
            for item, stretch in zip(batch.column("words"), batch.column("stretch"), strict=True):
                a, b = item.values.to_numpy(), stretch.values.to_numpy()
                n.append(len(a))
                lacking = int(np.isin(a, b, invert=True).sum())
                edits.append(lacking if lacking > len(a) // ALLOWED else least_distance(a, b))
            columns = [batch.column("doc_id"), batch.column("item"), pa.array(n, pa.int32()), pa.array(edits, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item", "item_words", "edits"])

    measured = both.select("doc_id", "item", "words", "stretch").mapInArrow(run, "doc_id bigint, item bigint, item_words int, edits int")
    best = measured.where(F.col("edits") <= F.floor(F.col("item_words") / ALLOWED)).groupBy("doc_id", "item").agg(F.max("item_words").alias("item_words"), F.min("edits").alias("edits"))
    names = every.select("item_id", "words").join(known.select("words", "item"), "words").select("item_id", "item")
    return best.join(names, "item").select("doc_id", "item_id", "item_words", "edits")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents into which no item has leaked; rows without doc_id can't be named and stay."""
    return of_ids(docs, leaks(docs, items).where("doc_id IS NOT NULL").select("doc_id"), "left_anti")
