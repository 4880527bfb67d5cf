"""Toxic documents and the sentences that make them so: multiple-instance learning with noisy-or.

A document is a bag of sentences (split at ``.``, ``!``, ``?`` and line ends). A
sentence's features are its words and the first bytes of its longer words, which stand
for stems; it is toxic with probability p = 1 / (1 + exp(-(BIAS + the weights of its
distinct features))), a document with 1 - (1 - p1) (1 - p2) ...; so one sentence is enough. Only
documents have labels: the weights follow from the likelihood of these, which a toxic
document's gradient passes on to its suspicious sentences. A leak (a share of toxic
labels that no sentence explains) is part of the likelihood in training and left out
of scores; it keeps mislabelled documents from making common words toxic.

Training takes a bounded sample of labelled documents, at most ``MAX_SAMPLE``, with
their whole texts; only features of ``LEAST_DOCS`` and ``LEAST_SHARE`` of them that go with
toxic documents get weights, none below 0. Every text, of any length, is then scored
whole, on Spark. ``SETTINGS`` were chosen by ``cross_validated`` on the documents that may
be learned from; labels of the held fold had no part in it.

Defined results: a null or empty text has no sentences and the score 0; every row is
scored by itself; labels that are null or belong to no document are left out, several
labels of one document are merged to the largest; without toxic labels every score is
near 0; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.llm.common import bounded_sample, by_size, cut, signed, splitmix, text_bytes, written
from weftline.llm.quality_score import remainder

#: Labelled documents that the model is fitted on, at most.
MAX_SAMPLE = 12_000
LEAST_DOCS, LEAST_SHARE = 4, 0.0015
HEADS = (4, 5, 6)


class Settings(NamedTuple):
    """What the fit depends on: a sentence's score without suspects, the pull of the prior, the least share of toxic documents of a suspect, the least weight kept."""

    bias: float
    ridge: float
    least_rate: float
    keep_weight: float


#: Chosen by ``cross_validated``.
SETTINGS = Settings(bias=-12.0, ridge=0.03, least_rate=0.6, keep_weight=0.25)
STEPS = 200
CUT = 0.7
OFFENDING = 0.5

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_NOT_WORD = np.zeros(256, bool)
_NOT_WORD[:0x80] = True
_NOT_WORD[0x30:0x3A] = False
_NOT_WORD[0x61:0x7B] = False


@dataclass
class Bags:
    """Features of several texts with the sentence of each; sentences are numbered over all texts.

    start and end of a sentence are bytes in the batch.
    """

    features: np.ndarray
    sentence: np.ndarray
    text_of: np.ndarray
    start_of: np.ndarray
    end_of: np.ndarray


def bags(col: pa.Array) -> Bags:
    """The features of every sentence that has a word: its words and the heads of its longer words."""
    data, offsets = text_bytes(col)
    w = tokens.words(data, offsets, _NOT_WORD, heads=HEADS)
    if not len(w.starts):
        none = np.zeros(0, np.int64)
        return Bags(none.astype(np.uint64), none, none, none, none)
    part = np.cumsum(_ENDS[data])[w.starts]
    fresh = np.ones(len(part), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (w.text[1:] != w.text[:-1])
    sentence = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(part)) - 1
    longer = [np.flatnonzero(w.ends - w.starts > size) for size in HEADS]
    features = np.concatenate([w.hashes, *(splitmix(h[at] + np.uint64(size)) for h, at, size in zip(w.heads, longer, HEADS, strict=True))])
    sentences = np.concatenate([sentence, *(sentence[at] for at in longer)])
    return Bags(features, sentences, w.text[first], w.starts[first], w.ends[last])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(feature: np.ndarray, sentence: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray, prior: np.ndarray, settings: Settings = SETTINGS) -> np.ndarray:
    """The features' weights, from pairs of a feature's number and a sentence, and each sentence's document."""
    weights, speed, square = prior.copy(), np.zeros(len(prior)), np.zeros(len(prior))
    leak = 0.5 * toxic.mean() if len(toxic) else 0.0
    for step in range(1, STEPS + 1):
        p = _sigmoid(settings.bias + np.bincount(sentence, weights[feature], len(doc_of)))
        clean = (1 - leak) * np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(toxic)))
        # d log-likelihood / d z of each sentence
        pull = np.where(toxic[doc_of], p * (clean / np.maximum(1 - clean, 1e-12))[doc_of], -p)
        gradient = np.bincount(feature, pull[sentence], len(weights)) - settings.ridge * (weights - prior)
        speed = 0.9 * speed + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights += 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights = np.maximum(weights, 0.0)
        # the leak's share of the toxic labels, by expectation
        leak = np.clip((leak / np.maximum(1 - clean, 1e-12))[toxic].sum() / len(toxic), 1e-4, 0.5)
    return weights


def _sample(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """Rows (doc_id, toxic, text) of a bounded sample of labelled documents, kept in the shared folder."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = bounded_sample(known.where(learns), MAX_SAMPLE).withColumnRenamed("doc_id", "_id")
    texts = docs.join(F.broadcast(cut(known)), F.col("doc_id") == F.col("_id"))
    return written(texts.select("doc_id", "toxic", "text"), "toxicity-sample")


@dataclass
class Model:
    """Features, in order, their weights, and the score of a sentence without any of them."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """The probability of each sentence."""
        feature, sentence = hits(b, self.vocabulary)
        return _sigmoid(self.bias + np.bincount(sentence, self.weights[feature], len(b.text_of)))

    def documents(self, b: Bags, n: int) -> np.ndarray:
        """The noisy-or of each text's sentences."""
        return np.clip(-np.expm1(np.bincount(b.text_of, np.log1p(-np.minimum(self.sentences(b), 1 - 1e-15)), n)), 0, 1)


def learned(sample: DataFrame, settings: Settings = SETTINGS) -> Model:
    """A model of a sample's (toxic, text).

    Counts by feature are made on Spark; only suspects, features that go with toxic
    documents, and their places in the sample come to the driver.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text"):
                b = bags(part.column("text"))
                text = b.text_of[b.sentence]
                once = tokens.first_of_each(splitmix(b.features + splitmix(text.astype(np.uint64))))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)[text[once]] > 0
                yield pa.RecordBatch.from_arrays([pa.array(signed(b.features[once])), pa.array(toxic.astype(np.int64))], names=["feature", "toxic"])

    sample = sample.select("toxic", "text")
    n, bad = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), settings.bias)
    if not bad:
        return nothing
    base = bad / n
    sums = sample.mapInArrow(counted, "feature bigint, toxic bigint").groupBy("feature").agg(F.count("*").alias("docs"), F.sum("toxic").alias("bad"))
    rate = F.col("bad") / (F.col("docs") + 2)
    chance = base + 3 * F.sqrt(base * (1 - base) / F.col("docs"))
    found = sums.where((F.col("docs") >= max(LEAST_DOCS, LEAST_SHARE * n)) & (rate > settings.least_rate) & (rate > chance)).select("feature", rate.alias("rate")).toPandas()
    if not len(found):
        return nothing
    vocabulary = found["feature"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, rate = vocabulary[order], found["rate"].to_numpy()[order]
    # a suspect alone makes a document as likely toxic as it has been so far
    prior = -settings.bias + np.log(rate / (1 - rate))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("toxic", pa.int32()), ("n", pa.int32()), ("feature", pa.list_(pa.int32())), ("sentence", pa.list_(pa.int32()))])
        for batch in batches:
            for part in by_size(batch, "text"):
                b = bags(part.column("text"))
                feature, sentence = hits(b, vocabulary)
                first = np.searchsorted(b.text_of, np.arange(part.num_rows + 1))
                begin = pa.array(np.searchsorted(sentence, first).astype(np.int32))
                inner = (sentence - first[b.text_of[sentence]]).astype(np.int32) if len(sentence) else sentence.astype(np.int32)
                lists = [pa.ListArray.from_arrays(begin, pa.array(x)) for x in (feature.astype(np.int32), inner)]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(np.diff(first).astype(np.int32)), *lists], schema=types)

    rows = sample.mapInArrow(placed, "toxic int, n int, feature array<int>, sentence array<int>").toPandas()
    sentences = rows["n"].to_numpy().astype(np.int64)
    before = np.cumsum(sentences) - sentences
    feature = np.concatenate([np.zeros(0, np.int64), *rows["feature"]]).astype(np.int64)
    sentence = np.concatenate([np.zeros(0, np.int64), *(np.asarray(s, np.int64) + a for s, a in zip(rows["sentence"], before, strict=True))]).astype(np.int64)
    weights = fit(feature, sentence, np.repeat(np.arange(len(rows)), sentences), rows["toxic"].to_numpy() > 0, prior, settings)
    keep = weights >= settings.keep_weight
    return Model(vocabulary[keep], weights[keep], settings.bias)


def cross_validated(docs: DataFrame, labels: DataFrame, learns: Column, tried: Sequence[Settings], folds: int = 3) -> list[tuple[float, int, Settings]]:
    """Log loss and errors of settings, best first, by folds among the documents that may be learned from."""
    sample = _sample(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels, learns)
    fold = F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(folds))
    out = []
    for settings in tried:
        loss, errors, n = 0.0, 0, 0
        for k in range(folds):
            model = learned(sample.where(fold != k), settings)
            got = _scored(sample.where(fold == k).select("doc_id", "text", "toxic"), model, "toxic").select("score", "toxic").toPandas()
            p, toxic = np.clip(got["score"].to_numpy(), 1e-3, 1 - 1e-3), got["toxic"].to_numpy() > 0
            loss -= float(np.where(toxic, np.log(p), np.log(1 - p)).sum())
            errors += int(((p >= CUT) != toxic).sum())
            n += len(got)
        out.append((loss / max(n, 1), errors, settings))
    return sorted(out)


def hits(b: Bags, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a vocabulary number and a sentence, by sentence."""
    if not len(vocabulary) or not len(b.features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(maybe[(b.features & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(vocabulary, b.features[at]), len(vocabulary) - 1)
    hit = vocabulary[place] == b.features[at]
    sentence, feature = np.divmod(np.unique(b.sentence[at[hit]] * len(vocabulary) + place[hit]), len(vocabulary))
    return feature, sentence


def _scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """Rows (doc_id, score, predicted, offending) and the int columns ``more``."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    types = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(span)), *((c, pa.int32()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, "text"):
                b = bags(part.column("text"))
                p, score = model.sentences(b), model.documents(b, part.num_rows)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                at = np.flatnonzero(p >= OFFENDING)
                if len(at):
                    data, offsets = text_bytes(part.column("text"))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for i in at:
                        base = chars[offsets[b.text_of[i]]]
                        found[b.text_of[i]].append({"start": int(chars[b.start_of[i]] - base), "end": int(chars[b.end_of[i]] - base), "p": float(p[i])})
                columns = [part.column("doc_id"), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array(found, types.field("offending").type)]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in more)], schema=types)

    shape = "doc_id bigint, score double, predicted int, offending array<struct<start:bigint,end:bigint,p:double>>"
    return docs.mapInArrow(run, ", ".join([shape, *(f"{c} int" for c in more)]))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, offending) for all documents.

    offending lists the sentences of at least OFFENDING, with their bounds in code
    points and their probability. Labels of the held fold are never learned from; a
    null doc_id belongs to no fold.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = learned(_sample(docs, labels, remainder(folds) != held_fold))
    held = F.coalesce(remainder(folds) == held_fold, F.lit(False))
    return _scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "offending")
