"""Quality rules whose cutoffs come with a risk guarantee.

Every text is measured once (words, symbols, repeated lines and repeated word
runs). A stratum (a language, say) gets a ladder of settings, each a cutoff for every
rule or none: on rung q, a rule has the strictest cutoff of its grid that rejects at most
a share of q of the stratum's unlabelled documents and at least one labelled bad one. So a
document that a rung rejects is rejected by all stricter ones. Labelled good documents
are the holdout. From the mildest rung on, the exact binomial upper bound of the share of
good documents that the rung's rules reject together has to stay within ``risk``; the last
rung before the first that fails is used. Rungs are made without the labelled good
documents and tested in a fixed order, so they need no correction; the confidence is split
over the strata (Bonferroni). With a probability of 1 - ``error``, no stratum loses more
than a share of ``risk`` of its good documents to all cutoffs together.

Defined results: a null text counts as empty (it fails the base rule, having no
words); texts of any length are measured whole, the longest in a batch of their own; a
null stratum is a stratum of its own; rows that share a doc_id are measured each by
itself; labels of one doc_id are merged to the smallest; in a stratum with too few labels,
and with no labels, only the base rule rejects; an empty table gives an empty result;
other columns, of any name, are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weftline.llm import tokens
from weftline.llm.common import by_size, free_name, observed, splitmix, text_bytes, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: A rule rejects documents whose measure, a whole number, exceeds a cutoff of its grid.
RULES = {
    "symbols": ("CASE WHEN word_chars > 0 THEN n_symbols * 1000 DIV word_chars ELSE 0 END", (0, 5, 10, 20, 50, 100, 200, 400)),
    "dup_lines": ("n_dup_lines", (0, 1, 2, 4, 8, 16, 32, 64)),
    "repeats": ("CASE WHEN n_words > 0 THEN n_repeat_words * 1000 DIV n_words ELSE 0 END", (25, 50, 100, 150, 200, 250, 300, 400)),
    "word_length": ("CASE WHEN n_words > 0 THEN word_chars * 100 DIV n_words ELSE 0 END", (700, 800, 900, 1000, 1200, 1500, 2000, 4000)),
}
RISK = 0.01
ERROR = 0.05
#: Rungs of the ladder: the thousandths of unlabelled documents that one rule may reject.
RUNGS = (1, 3, 10, 30, 100, 200, 300, 500)
MAX_BROADCAST_STRATA = 10_000

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    data, offsets = text_bytes(col)
    n = len(offsets) - 1
    w = tokens.words(data, offsets, fold=tokens.IDENTITY)
    inside = ~tokens.SPACES[data]

    def per_text(of_bytes: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_bytes)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def in_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        return splitmix(keys + splitmix(text.astype(np.uint64) + np.uint64(1)))

    threes, at = tokens.runs_of(w, 3)
    keys = in_text(threes, w.text[at])
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.zeros(len(w.hashes) + 3, np.int64)
    hit = at[times[which] > 1] if len(at) else at
    for i in range(3):
        again[hit + i] = 1
    repeated = np.concatenate([[0], np.cumsum(again[: len(w.hashes)])])

    starts, ends = tokens.spans(data != 0x0A, offsets)
    filled = np.concatenate([[0], np.cumsum(inside)])
    has_word = filled[ends] > filled[starts]
    starts, ends = starts[has_word], ends[has_word]
    line_text = np.searchsorted(offsets, starts, side="right") - 1
    fresh = tokens.first_of_each(in_text(tokens.span_hashes(data, starts, ends), line_text))
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(_LEAD[data] * inside),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_text[~fresh], minlength=n),
        "n_repeat_words": repeated[w.first[1:]] - repeated[w.first[:-1]],
    }


def with_counts(docs: DataFrame, keep_text: bool = True, prefix: str = "") -> DataFrame:
    """The rows of ``docs`` with the counts of their text as further columns."""
    fields = docs.schema.fields
    kept = [i for i, f in enumerate(fields) if keep_text or f.name != "text"]
    text = docs.columns.index("text")
    schema = StructType([*(fields[i] for i in kept), *(StructField(prefix + c, LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, f"c{text}"):
                counts = measure(part.column(text))
                columns = [part.column(i) for i in kept] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    # columns go by their places, as their names may be of any kind
    return docs.toDF(*(f"c{i}" for i in range(len(fields)))).mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exact up to rounding; 1 where k is not below n * p."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        if term < 1e-18 * total:
            break
    return math.exp(log) * total


def _small(table: DataFrame) -> DataFrame:
    """A table of strata, written, to be broadcast if its size is within the bound."""
    out, seen, _ = observed(table, "quality-strata", n=F.count(F.lit(1)))
    return F.broadcast(out) if (seen["n"] or 0) <= MAX_BROADCAST_STRATA else out


def _ladder(measures: DataFrame, held: DataFrame) -> DataFrame:
    """Rows (stratum, rungs): an array of settings, mildest first, each a struct of the rules' cutoffs."""
    tried = [(rule, c) for rule, (_, grid) in RULES.items() for c in grid]

    def counted(rows: DataFrame, names: dict[str, Column]) -> DataFrame:
        sums = [F.count_if(of & (F.col(rule) > c)).alias(f"{name}_{rule}_{c}") for name, of in names.items() for rule, c in tried]
        return rows.groupBy("stratum").agg(F.count("*").alias(f"n_{min(names)}"), *sums)

    both = counted(measures, {"all": F.lit(True)}).join(
        counted(held, {"known": F.lit(True), "bad": F.col("quality") != 1}).withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s"))
    ).withColumnRenamed("n_bad", "n_known")

    def cutoff(rule: str, q: int) -> Column:
        """The strictest cutoff that a rung allows a rule."""
        out = F.lit(None).cast("int")
        for c in sorted(RULES[rule][1], reverse=True):
            apart = F.col(f"all_{rule}_{c}") - F.col(f"known_{rule}_{c}") + 1
            fits = (1000 * apart <= q * (F.col("n_all") - F.col("n_known") + 2)) & (F.col(f"bad_{rule}_{c}") > 0)
            out = F.when(fits, c).otherwise(out)
        return out.alias(rule)

    return both.select("stratum", F.array(*(F.struct(*(cutoff(rule, q) for rule in RULES)) for q in RUNGS)).alias("rungs"))


def _rejected(setting: Column, value: Callable[[str], Column]) -> Column:
    """Whether any rule's value exceeds its cutoff in a setting."""
    out = F.lit(False)
    for rule in RULES:
        out = out | F.coalesce(value(rule) > setting[rule], F.lit(False))
    return out


def cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Rows (stratum, one column a rule with its cutoff or null) for the strata that have labels.

    A rung passes if P(X <= rejected good) <= error / strata at the given risk: then
    the upper Clopper-Pearson bound of the false rejections is at most ``risk``.
    """
    quality = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    measures = counts.select("doc_id", F.col(stratum).alias("stratum"), *(F.expr(sql).alias(rule) for rule, (sql, _) in RULES.items()))
    held = written(measures.join(quality, "doc_id").drop("doc_id"), "quality-held")
    ladder = _small(_ladder(measures.drop("doc_id"), held))
    tested = held.where("quality = 1").join(ladder.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")))
    fails = [F.count_if(_rejected(F.col("rungs")[i], F.col)).alias(f"k{i}") for i in range(len(RUNGS))]
    tested = _small(tested.groupBy("stratum").agg(F.count("*").alias("n"), F.first("rungs").alias("rungs"), *fails))
    level = error / max(1, tested.count())

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            last = []
            for row in f.itertuples():
                passed = [binomial_tail(int(getattr(row, f"k{i}")), int(row.n), risk) <= level for i in range(len(RUNGS))]
                last.append(passed.index(False) - 1 if False in passed else len(RUNGS) - 1)
            yield pd.DataFrame({"stratum": f["stratum"], "last": pd.array(last, "int32")})

    kind = measures.schema["stratum"].dataType.simpleString()
    last = tested.select("stratum", "n", *(f"k{i}" for i in range(len(RUNGS)))).mapInPandas(chosen, f"stratum {kind}, last int")
    final = last.where("last >= 0").join(ladder.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")))
    return final.select("stratum", F.get("rungs", F.col("last")).alias("setting")).select("stratum", "setting.*")


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"`{prefix}n_words` < 50 OR 100 * `{prefix}n_repeat_words` > 50 * `{prefix}n_words`")


def judged(measured: DataFrame, chosen: DataFrame, stratum: str = "lang", prefix: str = "") -> DataFrame:
    """``measured`` with two more columns: base_failed, and kept by base rule and cutoffs."""
    name, setting = free_name("stratum", measured), free_name("setting", measured)
    chosen = _small(chosen.select(F.col("stratum").alias(name), F.struct(*RULES).alias(setting)))

    def value(rule: str) -> Column:
        sql = RULES[rule][0]
        for c in COUNTS:
            sql = re.sub(rf"\b{c}\b", f"`{prefix}{c}`", sql)
        return F.expr(sql)

    out = measured.join(chosen, F.col(f"`{stratum}`").eqNullSafe(F.col(name)), "left")
    failed = base_failed(prefix)
    return out.withColumns({f"{prefix}base_failed": failed, f"{prefix}kept": ~failed & ~_rejected(F.col(setting), value)}).drop(name, setting)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    counts = written(with_counts(docs.select("doc_id", stratum, "text"), keep_text=False), "quality-counts")
    out = judged(counts, cutoffs(counts, labels, stratum, risk, error), stratum)
    return out.select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The texts are measured twice, once for the cutoffs and once while they pass
    through the filter; so no text is shuffled.
    """
    counts = written(with_counts(docs.select("doc_id", stratum, "text"), keep_text=False), "quality-counts")
    chosen = cutoffs(counts, labels, stratum, risk, error)
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return judged(with_counts(docs, prefix=prefix), chosen, stratum, prefix).where(f"`{prefix}kept`").select(*(F.col(f"`{c}`") for c in docs.columns))


def _sql() -> str:
    measures = ", ".join(f"{sql.replace(' DIV ', ' // ')} AS {rule}" for rule, (sql, _) in RULES.items())
    tried = [(rule, c) for rule, (_, grid) in RULES.items() for c in grid]
    shares = " UNION ALL ".join(
        f"SELECT lang, '{rule}' AS rule, {c} AS cutoff, count(*) FILTER (quality IS NULL) AS n, count(*) FILTER (quality IS NULL AND {rule} > {c}) AS k, "
        f"count(*) FILTER (quality <> 1 AND {rule} > {c}) AS bad, count(quality) AS known FROM marked GROUP BY lang" for rule, c in tried
    )
    rungs = ", ".join(f"({q})" for q in RUNGS)
    tail = (
        f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN n > i THEN lgamma(n - i + 1) ELSE 0 END "
        f"+ i * ln({RISK}) + (n - i) * ln(1 - {RISK}))))"
    )
    over = " OR ".join(f"coalesce(m.{rule} > s.{rule}, false)" for rule in RULES)
    columns = ", ".join(f"min(cutoff) FILTER (rule = '{rule}' AND bad > 0 AND 1000 * (k + 1) <= q * (n + 2)) AS {rule}" for rule in RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce("text", '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^ 	-
]+') AS ws, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM t),
g AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs FROM w),
h AS (SELECT *, map_from_entries(list_transform(map_entries(list_histogram(gs)), lambda e: {{'k': e.key, 'v': e.value}})) AS h FROM g),
c AS (SELECT r, doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  len(list_filter(range(1, len(ws) + 1), lambda i: (i <= len(gs) AND h[gs[i]] > 1) OR (i > 1 AND i - 1 <= len(gs) AND h[gs[i - 1]] > 1) OR (i > 2 AND i - 2 <= len(gs) AND h[gs[i - 2]] > 1)))::BIGINT AS n_repeat_words FROM h),
m AS MATERIALIZED (SELECT *, {measures} FROM c),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
marked AS MATERIALIZED (SELECT m.*, quality FROM m LEFT JOIN q USING (doc_id)),
shares AS ({shares}),
ladder AS MATERIALIZED (SELECT lang, q, {columns} FROM shares, (VALUES {rungs}) AS v(q) WHERE known > 0 GROUP BY lang, q),
tested AS (SELECT s.lang, s.q, count(*) AS n, count(*) FILTER ({over}) AS k FROM ladder s JOIN marked m ON m.lang IS NOT DISTINCT FROM s.lang AND m.quality = 1 GROUP BY s.lang, s.q),
passed AS (SELECT *, k < n * {RISK} AND {tail} <= {ERROR} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM tested)) AS ok FROM tested),
chosen AS (SELECT lang, max(q) AS q FROM passed p WHERE NOT EXISTS (SELECT 1 FROM passed f WHERE f.lang IS NOT DISTINCT FROM p.lang AND f.q <= p.q AND NOT f.ok) GROUP BY lang),
setting AS (SELECT ladder.* FROM ladder JOIN chosen c ON ladder.lang IS NOT DISTINCT FROM c.lang AND ladder.q = c.q)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({over}) AS kept FROM m LEFT JOIN setting s ON m.lang IS NOT DISTINCT FROM s.lang"""


SQL = _sql()
