"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.stored import removed, scratch, shared_dir, temporary

__all__ = ["removed", "scratch", "shared_dir", "temporary"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back as Parquet.

    Unlike a checkpoint, later steps then read only the columns they need.
    """
    return observed(df, name)[0]


def observed(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict, str]:
    """``written``, sums over the rows that are taken on the way, and the path."""
    spark, path, seen = df.sparkSession, scratch(df.sparkSession, name), {}
    if sums:
        watch = Observation()
        df.observe(watch, *(c.alias(k) for k, c in sums.items())).write.parquet(path)
        seen = watch.get
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), {k: seen.get(k) for k in sums}, path


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def free_name(stem: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    return next(name for name in (stem + "_" * n for n in range(len(taken) + 1)) if name.lower() not in taken)


def of_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is (left_semi) or isn't (left_anti) in the one column of ``ids``."""
    name = free_name("wanted", docs)
    return docs.join(ids.toDF(name), F.col("doc_id") == F.col(name), how)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd multipliers, the same on every machine."""
    start = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return splitmix(start) | np.uint64(1)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each row starts; null counts as empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[first:last], offsets - first


def by_size(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text, so that memory stays bounded.

    A longer text is a run of its own.
    """
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit words as Spark's longs."""
    return x.view(np.int64)


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of doc_id that is the same in every run.

    The share to keep follows from a count, so that hardly more than ``most`` rows are
    ever sorted, however many partitions there are.
    """
    share = min(1.0, most / max(1, rows.count()))
    place = F.xxhash64(F.lit(7), "doc_id")
    return rows.where(place.cast("double") / 2.0**64 + 0.5 <= share).orderBy(place, "doc_id").limit(most)


def cores(spark: SparkSession) -> int:
    """How many partitions a shuffle has by default here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)))
