"""Document scores learned from preferences: Bradley-Terry on feature differences.

One pass over the texts gives each document a few features, all read from the text
itself. Every labelled good document is preferred to every labelled bad one; the
Bradley-Terry model says that a document with score s wins over one with score t with
probability 1 / (1 + exp(t - s)). Scores are linear in the features, so this is
logistic loss on the differences of two feature vectors, and it is minimised over all
pairs of all labelled documents by Newton's steps.

A pair's loss is a smooth function of two scores. So a pass need not look at pairs:
each document is dealt over the ``NODES`` nearest points of a grid of scores by
Lagrange's weights, tasks sum the documents' moments point by point, and pairs of
points stand for pairs of documents, to about 1e-9 of the loss. The threshold is the
exact quantile of all labelled documents' scores at their share of bad ones; scores are
then mapped to 0 to 1 so that it falls on ``CUT``.

Defined results: a null or empty text has zero features and is scored like any other;
texts of any length are read whole; each row is scored by itself; labels that are null
or belong to no document are left out, several labels of one document are merged to
the smallest; without labels of both kinds every score is ``CUT``; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import by_size, text_bytes, written

CUT = 0.3
RIDGE = 1e-3
CLIP = 3.0
#: Passes of the fit, at most, and the step that ends it.
PASSES = 60
SMALL_STEP = 1e-7
#: The grid of scores: its spacing, and the points that a score is dealt over.
GRID = 0.125
NODES = np.arange(-3, 5)
#: Ranges that a pass of the search for a quantile tells apart.
BINS = 1024

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "pipes", "stops", "commas",
    "end_symbols", "end_exclamations", "next_repeats", "distinct", "line_words", "dup_lines", "beyond_ascii",
)


def _flag(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_CLASSES = {
    "upper": _flag("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _flag("0123456789"), "symbols": _flag("#*$%&<>@^~=+_{}[]\\/"),
    "exclamations": _flag("!"), "pipes": _flag("|"), "stops": _flag(".?"), "commas": _flag(",;:"), "beyond_ascii": (np.arange(256) >= 0xC0).astype(np.int64),
}


def features(col: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    data, offsets = text_bytes(col)
    n = len(offsets) - 1
    w = tokens.words(data, offsets)
    count = np.diff(w.first)
    some, size = np.maximum(count, 1), np.maximum(tokens.lengths_in_characters(data, offsets), 1)

    def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[at[1:]] - sums[at[:-1]]

    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    same = np.zeros(len(w.hashes), np.int64)
    if len(same):
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    fresh = tokens.first_of_each(tokens.splitmix(w.hashes + tokens.splitmix(w.text.astype(np.uint64))))
    starts, ends = tokens.spans(data != 0x0A, offsets)
    line_text = np.searchsorted(offsets, starts, side="right") - 1
    lines = np.bincount(line_text, minlength=n)
    line_keys = tokens.splitmix(tokens.span_hashes(data, starts, ends) + tokens.splitmix(line_text.astype(np.uint64)))
    again = np.bincount(line_text[~tokens.first_of_each(line_keys)], minlength=n)
    out = {name: per_text(flag[data], offsets) / size for name, flag in _CLASSES.items()}
    out |= {
        "log_words": np.log1p(count), "word_length": size / some,
        "end_symbols": per_text(_CLASSES["symbols"][last], w.first) / some, "end_exclamations": per_text(_CLASSES["exclamations"][last], w.first) / some,
        "next_repeats": per_text(same, w.first) / some, "distinct": per_text(fresh.astype(np.int64), w.first) / some,
        "line_words": np.log1p(count / np.maximum(lines, 1)), "dup_lines": again / np.maximum(lines, 1),
    }
    return np.stack([out[name] for name in FEATURES], axis=1).astype(np.float64)


def with_features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x), x a text's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text"):
                x = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, x array<double>")


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (w . z - threshold) + logit(CUT)))), z the standardised features."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -CLIP, CLIP)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Summed row by row, so that equal texts have equal scores in every batch."""
        return (self.standard(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), CUT)
        z = self.slope * (self.raw(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _settled(x: np.ndarray | float) -> np.ndarray:
    """Ten digits, so that the order in which tasks end leaves no trace."""
    return np.array([float(f"{v:.10g}") for v in np.ravel(x)])


def _start(mean: np.ndarray, deviation: np.ndarray) -> Model:
    return Model(_settled(mean), np.maximum(_settled(deviation), 1e-6), np.zeros(len(mean)), 0.0, 1.0)


def _flat(width: int) -> Model:
    return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.0)


def grid_sums(model: Model, batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of 1, z and z z' over documents by grid point and label: keys (2 * point + good), and a row for each."""
    width = len(model.weights)
    i, j = np.triu_indices(width)
    found: dict[int, np.ndarray] = {}
    for x, good in batches:
        z = model.standard(x)
        place = model.raw(x) / GRID
        low = np.floor(place).astype(np.int64)
        t = (place - low)[:, None]
        dealt = np.stack([np.prod((t - NODES[NODES != k]) / (k - NODES[NODES != k]), axis=1) for k in NODES], axis=1)
        moments = np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], axis=1)
        key = 2 * low + good
        order = np.argsort(key, kind="stable")
        firsts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
        for rows in np.split(order, firsts[1:]) if len(order) else []:
            k = int(key[rows[0]])
            found[k] = found.get(k, 0) + dealt[rows].T @ moments[rows]
    keys = np.array([k + 2 * n for k in found for n in NODES], np.int64)
    return _merged(keys, np.concatenate([*found.values(), np.zeros((0, 1 + width + len(i)))]))


def _merged(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each key."""
    unique, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(unique), sums.shape[1]))
    np.add.at(out, at, sums)
    return unique, out


def pair_loss(keys: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs of a good and a bad document with its ridge, the gradient and the Hessian."""
    width = len(weights)
    good = keys % 2 == 1
    points, bad_points = (keys[good] // 2) * GRID, (keys[~good] // 2) * GRID
    (n, v, square), (bad_n, bad_v, bad_square) = (np.split(sums[side], [1, 1 + width], axis=1) for side in (good, ~good))
    loss, gradient, cross, upper = 0.0, np.zeros(width), np.zeros((width, width)), np.zeros(square.shape[1])
    for a in range(0, len(points), 256):
        here = slice(a, a + 256)
        apart = points[here, None] - bad_points
        loses = np.exp(-np.logaddexp(0, apart))
        slope = loses * (1 - loses)
        loss += (n[here].T @ np.logaddexp(0, -apart) @ bad_n).item()
        gradient -= (loses @ bad_n).T[0] @ v[here] - (loses.T @ n[here]).T[0] @ bad_v
        upper += (slope @ bad_n).T[0] @ square[here] + (slope.T @ n[here]).T[0] @ bad_square
        cross += v[here].T @ slope @ bad_v
    hessian = np.zeros((width, width))
    hessian[np.triu_indices(width)] = upper
    hessian += np.triu(hessian, 1).T - cross - cross.T
    pairs = n.sum() * bad_n.sum()
    return loss / pairs + RIDGE / 2 * weights @ weights, gradient / pairs + RIDGE * weights, hessian / pairs + RIDGE * np.eye(width)


def _fitted(model: Model, sums: Callable[[Model], tuple[np.ndarray, np.ndarray]]) -> Model:
    """Newton's steps, halved while they make the loss larger; ``sums`` is one pass over all labelled documents."""
    best, least, step = model.weights, np.inf, np.zeros(len(model.weights))
    for _ in range(PASSES):
        weights = best + step
        loss, gradient, hessian = pair_loss(*sums(replace(model, weights=weights)), weights)
        if loss <= least + 1e-9:
            best, least, step = weights, loss, -np.linalg.solve(hessian, gradient)
        else:
            step = step / 2
        if np.abs(step).max() < SMALL_STEP:
            break
    return replace(model, weights=np.round(best + step, 8))


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """Bradley-Terry over all pairs of one good and one bad document; what ``fit_table`` does, on arrays."""
    if not good.any() or good.all():
        return _flat(x.shape[1] if x.ndim == 2 else len(FEATURES))
    model = _fitted(_start(x.mean(axis=0), x.std(axis=0)), lambda m: grid_sums(m, [(x, good)]))
    scores = np.sort(model.raw(x))
    k = int((~good).sum())
    model.threshold = float((scores[k - 1] + scores[k]) / 2)
    model.slope = float(_settled(4 / max(scores.std(), 1e-9))[0])
    return model


def at_rank(rows: DataFrame, name: str, rank: int) -> float:
    """The value that ``rank`` rows stand before in the order of a column: exact, by counts in ever narrower ranges."""
    value = F.col(name)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    before = 0
    while low < high:
        place = F.least(F.floor((value - low) / (high - low) * BINS), F.lit(BINS - 1))
        found = rows.where(value.between(low, high)).groupBy(place.alias("place")).agg(F.count(F.lit(1)), F.min(value), F.max(value)).collect()
        for _, count, low, high in sorted(found):  # noqa: B007
            if before + count > rank:
                break
            before += count
    return low


def fit_table(labelled: DataFrame) -> Model:
    """``fit`` over all rows (x, good), good 1 or 0: each pass is a job, and only sums come to the driver."""
    width = len(FEATURES)
    at = [F.get("x", F.lit(k)) for k in range(width)]
    n, winners, *rest = labelled.agg(F.count(F.lit(1)), F.sum("good"), *map(F.avg, at), *map(F.stddev_pop, at)).first()
    if not n or winners in (0, n):
        return _flat(width)

    def arrays(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy().reshape(-1, width)

    def sums(model: Model) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, found = grid_sums(model, ((arrays(b), b.column("good").to_numpy()) for b in batches))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["key", "sums"])

        got = labelled.mapInArrow(run, "key bigint, sums array<double>").toArrow().combine_chunks()
        keys = got.column("key").to_numpy()
        return _merged(keys, got.column("sums").combine_chunks().flatten().to_numpy().reshape(len(keys), -1))

    model = _fitted(_start(np.array(rest[:width]), np.array(rest[width:])), sums)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(arrays(batch)))], names=["raw"])

    raw = written(labelled.select("x").mapInArrow(scored, "raw double"), "quality-raw")
    k = n - winners
    below = at_rank(raw, "raw", k - 1)
    until, above, deviation = raw.agg(F.count_if(F.col("raw") <= below), F.min(F.when(F.col("raw") > below, F.col("raw"))), F.stddev_pop("raw")).first()
    model.threshold = (below + (below if until > k else above)) / 2
    model.slope = float(_settled(4 / max(deviation, 1e-9))[0])
    return model


def labelled_rows(rows: DataFrame, labels: DataFrame, label: str, learns: Column) -> DataFrame:
    """Rows (x, good) of all labelled documents of ``rows`` that may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learns).groupBy("doc_id").agg(F.min(label).alias("_label"))
    return rows.join(known, "doc_id").select("x", (F.col("_label") == 1).cast("int").alias("good"))


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for all documents; rows of the held fold are never learned from.

    A null doc_id belongs to no fold.
    """
    rows = written(with_features(docs), "quality-features")
    held = F.coalesce(remainder(folds) == held_fold, F.lit(False))
    model = fit_table(written(labelled_rows(rows, labels, "quality", ~held), "quality-labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
