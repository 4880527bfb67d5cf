"""Documents to a training mix, in five stages; each is written as Parquet and reread by the next.

Every stage takes the whole table that its predecessor kept, with columns of any name
beside doc_id, text, lang and source, and all but the last return its columns. Common to
all stages: an empty table gives an empty one; texts of any length are read whole; a row
without doc_id can't be named by a decision about ids and stays, unless its own text
fails a rule; rows that repeat are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, mixing, near_dedup, quality_rules, secret_scan
from weftline.llm.common import removed, scratch, table, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a cutoff of their language rejects.

    Null and empty texts go, as they have no words; repeated rows stay as often as they
    came; without enough labels in a language only the base rule rejects there.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id.

    Texts without words are in no group. Of rows that share a doc_id one stays, that of the
    smallest text; rows without doc_id all stay.
    """
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item has leaked.

    Of rows that share a doc_id all go if a leak is in one; rows without doc_id stay, as do
    null and empty texts. An empty benchmark keeps all.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by a mark, and n_chars to match.

    Null texts stay null; texts without secrets stay as they are.
    """
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target and taken.

    Texts without words have size and taken 0; documents without source are a source of
    their own.
    """
    return mixing.mixing(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written is deleted once the next one has been."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with temporary(spark, name):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs


#: Edit distances over candidates of a random walk, and a pseudorandom mix, aren't SQL.
ORACLE_SQL = None
