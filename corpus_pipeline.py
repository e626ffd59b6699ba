"""Corpus pipeline: quality, language, near duplicates, mixture, packing.

Each stage works on all that the one before kept; its result is written as Parquet in
the shared folder and read again.  All stages but the last return the columns of
``documents``, so their decisions take effect by which rows remain (the mixture repeats rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import langid, mixing, neardup, quality
from tessella.llm.common import cut, documents, fresh, hashable, scratch
from tessella.llm.queries import pack_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rates one half or more; null and empty texts are rated like any other, no rows give none, rows that repeat are rated alike."""
    return quality.accepted(docs, quality.fit(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus' own labels teach; null texts and texts without a letter go.  Without any labelled document no language is known and all go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more; texts without words are no copies and stay.

    Rows that repeat an id are one document, of which one row stays (the smallest by its text and a hash of its
    columns).  A row without an id cannot name a group: of rows without id and with equal texts one stays.
    """
    found = neardup.near_duplicates(docs, percent=80)
    name, n = fresh(docs, "_kept_id", "_n")
    kept = found.where("kept").select(F.col("doc_id").alias(name)).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[name]), "left_semi")
    # ids that several rows carry are few, so only their rows move
    several = docs.groupBy(F.col("doc_id").alias(name)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    same = docs["doc_id"].eqNullSafe(several[name])
    first = W.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).orderBy("text", F.xxhash64(*hashable(docs)))
    one = rows.join(several, same, "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n)
    return rows.join(several, same, "left_anti").unionAll(one)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target rate, in a global shuffle.  A null source is a source; a null id draws as the text ``null``."""
    rate, copies, copy = names = tuple(fresh(docs, "rate", "n_copies", "copy"))
    return mixing.replicate(docs, mixing.rates(docs), names=names).drop(rate, copies, copy)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 ids; a null text is empty, and rows that repeat are packed as often as they occur."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: The stages train models and search candidates, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before wrote; once it has written its own, its intermediate tables go."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark, lambda: docs):
            docs = cut(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
