"""Mixing sources to target weights by blocks of words.

* Each source's documents, in the order of a hash, make one stream of words, packed
  into blocks of ``BLOCK`` words; the last block may be shorter. Positions come from
  prefix sums in three levels (within hash ranges, over the ranges of a group, over the
  groups), so that no task holds a whole source.
* Targets share ``share`` times all words by weight; none exceeds ``limit`` times its
  source's words, and what is over goes to the others by weight.
* The output is shards of ``SHARD`` slots, one block each. How many of a shard's slots
  each source has is a multinomial draw, given that over all shards each source gets
  its target's number of slots. So shards differ as in free draws, while the sums keep to
  the targets at any size. The draw is made by halves: the slots of a range of shards are
  dealt to its two halves by a multivariate hypergeometric draw, seeded by the range; so
  each task draws its own shards, and knows how many slots of a source come before them.
* A source's slots over all shards are numbered. Slot j takes the block at place
  j mod n of the source's pseudorandom permutation (a Feistel network with cycle
  walking) of its n blocks, a different permutation for each pass over the source.
  Slots and blocks are joined by source and index.

Draws and permutations depend on the seed, the sources' sizes and the ranges of shards
only, the streams on hashes of rows; so a rerun, or a task's second attempt, gives the
same mix. A source is a label: what the driver holds of each is its name, size and
number of rows, and each task its number of slots.

Defined results: a null text has no words, its row takes 0; a null source is a source
of its own, the last; rows that repeat are documents of their own; a source without
words has the target 0; a text of any length is one document of as many blocks as it
fills; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from weftline.llm.common import cores, splitmix, written

BLOCK = 64
SHARD = 4096
SEED = 20
ROUNDS = 4
#: Up to so many sources their table is broadcast; beyond, it is joined as any other.
MAX_BROADCAST_SOURCES = 100_000
RANGE_ROWS = 1024
GROUP_RANGES = 4096
TASK_SLOTS = 1 << 18
#: Up to so many slots numpy draws exactly; beyond, the normal law stands in, as close as counts so large can tell.
MOST_EXACT = 10**9


def sized(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, h): words of each text, and the place in its source's order."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, limit: float) -> list[float]:
    """The words to take from each source."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if rate * weights[i] > limit * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rate * weights[i]
            break
        for i in full:
            out[i] = float(limit * sizes[i])
            open_.remove(i)
        left = share * sum(sizes) - sum(out)
    return out


def _marked(rng: np.random.Generator, marked: int, others: int, drawn: int) -> int:
    """How many of ``drawn`` slots out of marked and other ones are marked."""
    total = marked + others
    if total < MOST_EXACT:
        return int(rng.hypergeometric(marked, others, drawn))
    mean = drawn * marked / total
    deviation = math.sqrt(max(0.0, mean * (others / total) * (total - drawn) / (total - 1)))
    return min(max(round(rng.normal(mean, deviation)), drawn - others, 0), marked, drawn)


def halved(counts: np.ndarray, low: int, high: int, slots: int) -> np.ndarray:
    """How many of each source's slots in the shards of a range fall into its first ``slots`` slots."""
    rng = np.random.default_rng([SEED, low, high])
    out, left, drawn = np.zeros_like(counts), int(counts.sum()), slots
    for i in np.flatnonzero(counts):
        if not drawn:
            break
        left -= int(counts[i])
        out[i] = _marked(rng, int(counts[i]), left, drawn)
        drawn -= int(out[i])
    return out


def draws(totals: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the shards of a range: the shard, each source's slots in it, and each one's in all shards before."""
    def part(counts: np.ndarray, before: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if low >= end or high <= begin:
            return
        if high - low == 1:
            yield low, counts, before
            return
        middle = (low + high) // 2
        first = halved(counts, low, high, (middle - low) * SHARD)
        yield from part(first, before, low, middle)
        yield from part(counts - first, before + first, middle, high)

    yield from part(totals, np.zeros_like(totals), 0, math.ceil(int(totals.sum()) / SHARD))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each index's place in the pseudorandom permutation of range(n) that its key names."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(ROUNDS):
            left, right = right, left ^ (splitmix(right + splitmix(k * np.uint64(ROUNDS) + np.uint64(r + 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _before(*by: str) -> WindowSpec:
    """The rows before one, of those equal in all but the last of ``by``, in the order of the last."""
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the words of their source that come before them."""
    place = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("ranges")).cast("bigint")
    rows = rows.withColumn("range", place).drop("ranges")
    ranges = rows.groupBy("source_no", "range").agg(F.sum("size").alias("words")).withColumn("group", F.expr(f"range DIV {GROUP_RANGES}"))
    groups = ranges.groupBy("source_no", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("source_no", "group", F.coalesce(F.sum("words").over(_before("source_no", "group")), F.lit(0)).alias("base"))
    earlier = F.coalesce(F.sum("words").over(_before("source_no", "group", "range")), F.lit(0)).alias("earlier")
    ranges = ranges.select("source_no", "group", "range", earlier).join(groups, ["source_no", "group"])
    within = Window.partitionBy("source_no", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges.select("source_no", "range", (F.col("base") + F.col("earlier")).alias("base")), ["source_no", "range"])
    return rows.withColumn("start", F.col("base") + F.col("inner")).drop("range", "inner", "base")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents as placed in their sources' streams, and the mix.

    Documents: (doc_id, source, source_no, size, source_size, target, start); start is
    null for documents without words. The mix: (shard, slot, source_no, block), of which
    block b of a source has its stream's words from b * BLOCK. Weights repeat over the
    sources by code point, null last.
    """
    spark = docs.sparkSession
    rows = written(sized(docs), "mix-sizes")
    known = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n")).collect()
    known = sorted(known, key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes = [r.words for r in known]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, limit)
    named = [(r.source, i, r.words, g, max(1, math.ceil(r.n / RANGE_ROWS))) for i, (r, g) in enumerate(zip(known, goal, strict=True))]
    table = spark.createDataFrame(named, "_source string, source_no int, source_size bigint, target double, ranges bigint")
    table = F.broadcast(table) if len(named) <= MAX_BROADCAST_SOURCES else table
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # rows without words need no place; many of them may be equal
    none = rows.where("size = 0").drop("h", "ranges").withColumn("start", F.lit(None).cast("bigint"))
    placed = written(_placed(rows.where("size > 0")).drop("h").unionByName(none), "mix-placed")

    blocks = np.array([math.ceil(s / BLOCK) for s in sizes], np.int64)
    totals = np.array([round(g / s * b) if s else 0 for g, s, b in zip(goal, sizes, blocks, strict=True)], np.int64)
    slots = int(totals.sum())
    shape = "shard bigint, slot bigint, source_no int, block bigint"
    if not slots:
        return placed, spark.createDataFrame([], shape)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            for shard, counts, before in draws(totals, int(f["id"].min()), int(f["id"].max()) + 1):
                source = np.repeat(np.arange(len(counts)), counts)
                slot = np.arange(len(source))
                j = before[source] + slot - (np.cumsum(counts) - counts)[source]
                of = blocks[source]
                key = (source + 1).astype(np.uint64) * np.uint64(1 << 20) + (j // of).astype(np.uint64)
                yield pd.DataFrame({"shard": shard, "slot": slot, "source_no": source.astype(np.int32), "block": permuted(j % of, of, key)})

    shards = math.ceil(slots / SHARD)
    tasks = min(shards, max(cores(spark), math.ceil(slots / TASK_SLOTS)))
    return placed, spark.range(0, shards, 1, tasks).mapInPandas(place, shape)


def document_blocks(placed: DataFrame) -> DataFrame:
    """Rows (source_no, start, block, words): which words of which block each document has."""
    spans = placed.where("size > 0").select("doc_id", "source_no", "start", "size", F.expr(f"explode(sequence(start DIV {BLOCK}, (start + size - 1) DIV {BLOCK}))").alias("block"))
    low, high = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return spans.select("source_no", "start", "block", (high - low).alias("words"))


def mixing(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row for each document: (doc_id, size, source_size, target, taken)."""
    placed, slots = mix(docs, weights, share, limit)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # Spark can't know how many slots a shard's row becomes, so it mustn't take them for small
    taken = document_blocks(placed).hint("merge").join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # a start is that of one document with words
    out = placed.join(taken, ["source_no", "start"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
