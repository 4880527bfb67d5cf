"""Near-duplicate groups by banded MinHash with odd sketches.

A document's set is its distinct runs of five words (fewer words: the whole
sequence as one). Two documents are linked if 100 * |intersection| is at least
75 * |union|. Steps:

1. one pass over the texts gives each row its set size, a 128-bit fingerprint of
   the set, band keys of 7 of 448 MinHash values each, and two odd sketches: bitmaps
   in which each MinHash value, or each element of the set, flips one bit;
2. rows of equal fingerprint are one class, with its smallest doc_id as
   representative; only representatives go on, one row of each class;
3. a bucket is the representatives that share a band key. Each is paired with the
   smallest of its bucket; sizes and odd sketches (the population count of the XOR
   estimates the similarity) drop pairs that can't be links; the others are
   confirmed on the full sets; components of the links follow;
4. pairs of one bucket that are still in different components are confirmed in the
   same way; from the first components and these links follow the last ones. Pairs
   inside a component need no test, as they can't change it. So a group of n near
   copies costs n pairs, and no pair that could join two components is left out.

A pair of similarity 0.75 shares no band with probability 1e-4, of 0.78 with 4e-6, of
0.8 with 3e-7; seven values a band keep documents that only share a passage apart. The
sketch bound (an estimate under 0.62) lies five deviations below 0.75.

Defined results: null or wordless texts have an empty set and no links; a null
doc_id has no links and a null component, and is kept; rows of equal doc_id are one
node, whatever their texts; texts of any length are read whole, the longest in a batch
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import tokens
from weftline.llm.common import by_size, free_name, observed, odd_constants, of_ids, signed, splitmix, text_bytes, written
from weftline.llm.components import components

RUN = 5
PERCENT = 75
BANDS, ROWS = 64, 7
SKETCH_WORDS, PARITY_WORDS = 16, 32  # of 64 bits
LEAST_ESTIMATE = 0.62

_MULTIPLIERS = odd_constants(BANDS * ROWS, 1)
_BAND = odd_constants(BANDS, 2)
_IN_BAND = odd_constants(ROWS, 3)


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of each text, and where each text's begin."""
    data, offsets = text_bytes(col)
    n = len(offsets) - 1
    w = tokens.words(data, offsets)
    h, at = tokens.runs_of(w, RUN)
    text = w.text[at]
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < RUN))
    if len(short):
        whole = np.array([_sequence(w.hashes[w.first[d] : w.first[d + 1]]) for d in short], np.uint64)
        h, text = np.concatenate([h, whole]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    fresh = tokens.first_of_each(splitmix(h + splitmix(text.astype(np.uint64) + np.uint64(1))))
    h, text = h[fresh], text[fresh]
    return h, np.searchsorted(text, np.arange(n + 1), side="left")


def _sequence(hashes: np.ndarray) -> np.uint64:
    mult = odd_constants(RUN, 12)
    with np.errstate(over="ignore"):
        return splitmix(np.array([(hashes * mult[: len(hashes)]).sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0]


def _signatures(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fingerprints, band keys and odd sketches (of the MinHash values, of the set itself) of the non-empty sets."""
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return full, *(np.zeros((0, width), np.uint64) for width in (2, BANDS, SKETCH_WORDS, PARITY_WORDS))
    at = begin[full]
    prints = np.stack([np.add.reduceat(splitmix(h ^ np.uint64(s)), at) for s in (5, 6)], axis=1)
    least = np.empty((len(full), BANDS * ROWS), np.uint64)
    scaled = np.empty_like(h)
    for i, m in enumerate(_MULTIPLIERS):
        np.multiply(h, m, out=scaled)
        least[:, i] = np.minimum.reduceat(scaled, at)
    rows = splitmix(least.reshape(len(full), BANDS, ROWS)) * _IN_BAND
    keys = splitmix(rows.sum(axis=2, dtype=np.uint64) + _BAND)
    bits = splitmix(least + _MULTIPLIERS) % np.uint64(64 * SKETCH_WORDS)
    sketch = np.zeros((len(full), 64 * SKETCH_WORDS), np.uint8)
    np.add.at(sketch, (np.arange(len(full))[:, None], bits.astype(np.int64)), 1)
    packed = np.packbits(sketch & 1, axis=1, bitorder="little").view(np.uint64)
    parity = np.zeros((len(full), PARITY_WORDS), np.uint64)
    place = splitmix(h ^ np.uint64(9)) % np.uint64(64 * PARITY_WORDS)
    row = np.repeat(np.arange(len(full)), np.diff(begin)[full])
    np.bitwise_xor.at(parity, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return full, prints, keys, packed, parity


def _lists(rows: int, full: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column: the rows of ``values`` at ``full``, empty lists elsewhere."""
    size = np.zeros(rows + 1, np.int64)
    size[full + 1] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.array(signed(np.ascontiguousarray(values)).ravel()))


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, f1, f2, bands, sketch, parity) of a table (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text", 1 << 20):
                h, begin = _sets(part.column("text"))
                full, prints, keys, sketch, parity = _signatures(h, begin)
                f = np.zeros((part.num_rows, 2), np.uint64)
                f[full] = prints
                lists = [_lists(part.num_rows, full, x) for x in (keys, sketch, parity)]
                columns = [part.column("doc_id"), pa.array(np.diff(begin)), *(pa.array(signed(f[:, i].copy())) for i in (0, 1)), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "bands", "sketch", "parity"])

    schema = "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch array<bigint>, parity array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def sets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, runs): the whole set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text", 1 << 20):
                h, begin = _sets(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "runs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, runs array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity by two odd sketches: 1 + (m / 4k) ln(1 - 2z / m) for m bits, k samples and z differing bits."""
    m, k = 64 * SKETCH_WORDS, BANDS * ROWS
    z = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    return F.when(2 * z >= m, F.lit(-1.0)).otherwise(1 + F.lit(m / 4 / k) * F.log(1 - 2 * z / F.lit(float(m))))


def _most_differing() -> int:
    """The bits that may differ where the estimate still reaches the bound."""
    m, k = 64 * SKETCH_WORDS, BANDS * ROWS
    return math.floor(m / 2 * (1 - math.exp(4 * k / m * (LEAST_ESTIMATE - 1))))


def _likely() -> Column:
    """Whether sizes and sketches leave it open that u and v are linked.

    The estimate from the MinHash values' odd sketch must reach the bound. The odd sketch
    of the sets themselves decides without error: no more of its bits differ than the
    sets have elements apart, which for a link is at most a share of both sizes.
    """
    def differing(name: str, words: int) -> Column:
        return sum((F.bit_count(F.col(f"{name}_u")[i].bitwiseXOR(F.col(f"{name}_v")[i])) for i in range(words)), F.lit(0))

    sizes = 100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v")
    apart = (100 + PERCENT) * differing("p", PARITY_WORDS) <= (100 - PERCENT) * (F.col("n_u") + F.col("n_v"))
    return sizes & (differing("s", SKETCH_WORDS) <= _most_differing()) & apart


def _side(rows: DataFrame, name: str, *more: Column) -> DataFrame:
    """The columns that ``_likely`` reads, as those of one side of a pair."""
    return rows.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"), F.col("parity").alias(f"p_{name}"), *more)


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among pairs (u, v) of representatives, on full sets; pairs are read from files."""
    wanted = pairs.select("u").union(pairs.select("v"))
    full = written(sets(of_ids(docs, wanted, "left_semi")), "near-sets")
    both = pairs.join(full.select(F.col("doc_id").alias("u"), F.col("runs").alias("r_u")), "u")
    both = both.join(full.select(F.col("doc_id").alias("v"), F.col("runs").alias("r_v")), "v")
    common = F.size(F.array_intersect("r_u", "r_v"))
    return both.where(100 * common >= PERCENT * (F.size("r_u") + F.size("r_v") - common)).select("u", "v")


def _bridges(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (u, v) that make the classes of one doc_id one node."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("f1", "f2") for f in (F.min, F.max)]
    several = known.groupBy("doc_id").agg(*ends).where("f1_min <> f1_max OR f2_min <> f2_max").select("doc_id")
    of_class = known.select("doc_id", "f1", "f2", "n").join(several, "doc_id", "left_semi")
    return of_class.join(reps.select("f1", "f2", "n", F.col("doc_id").alias("rep")), ["f1", "f2", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def _across(buckets: DataFrame, reps: DataFrame, placed_in: DataFrame) -> DataFrame:
    """Likely pairs (u, v) of one bucket in different components; those with a bucket's smallest have been tried."""
    placed = buckets.join(placed_in, F.col("doc_id") == F.col("node"), "left").select("key", "hub", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    rest = placed.where("doc_id <> hub").join(mixed, "key").join(reps.select("doc_id", "n", "sketch", "parity"), "doc_id")
    rest = written(rest, "near-rest")
    left = _side(rest, "u", F.col("key"), F.col("c").alias("c_u"))
    right = _side(rest, "v", F.col("key").alias("k"), F.col("c").alias("c_v"))
    return left.join(right, (F.col("key") == F.col("k")) & (F.col("c_u") > F.col("c_v")) & _likely()).select("u", "v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = written(signatures(docs), "near-signatures")
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "bands", "sketch", "parity")).alias("r")
    reps = written(known.groupBy("f1", "f2", "n").agg(first).select("f1", "f2", "n", "r.*"), "near-representatives")

    entries = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
    buckets = written(entries.join(shared, "key"), "near-buckets")
    star = buckets.where("doc_id > hub").select(F.col("doc_id").alias("u"), F.col("hub").alias("v")).distinct()
    star = written(star.join(_side(reps, "u"), "u").join(_side(reps, "v"), "v").where(_likely()).select("u", "v"), "near-star")
    placed_in = components(_confirmed(star, docs).union(_bridges(known, reps)))

    across, seen, _ = observed(_across(buckets, reps, placed_in), "near-across", pairs=F.count(F.lit(1)))
    if seen["pairs"]:
        more = _confirmed(across, docs)
        placed_in = components(placed_in.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    final = reps.select("f1", "f2", "n", F.col("doc_id").alias("rep")).join(placed_in, F.col("rep") == F.col("node"), "left")
    out = rows.select("doc_id", "n", "f1", "f2").join(final.select("f1", "f2", "n", F.coalesce("component", "rep").alias("c")), ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id names their group; rows without doc_id stay.

    Of several rows of one doc_id that with the smallest text stays, null before others.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id")
    place = free_name("place", docs)
    sorts = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*sorts))
    named = of_ids(docs.where("doc_id IS NOT NULL"), kept, "left_semi")
    named = named.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return named.unionByName(docs.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) END AS g FROM t),
n AS (SELECT r, doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT r, unnest(g) AS g FROM s),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x.doc_id AS u, y.doc_id AS v FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM n UNION SELECT reach.a, ways.v FROM reach JOIN ways ON reach.b = ways.u),
first AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM n LEFT JOIN first ON a = doc_id"""
