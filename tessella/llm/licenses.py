"""License scan by diagonal voting, in DataFrame operations only.

Every document's rolling word 2-gram hashes are joined to the positions of the same hashes in the
templates.  A hit votes for the diagonal (document position - template position) on
which both texts would lie side by side.  Votes are counted by diagonal; a diagonal with
every vote of the template is the template word for word.  For long
templates, each diagonal is merged with its neighbours (a word more or less here and there): the
merged span is verified by the share of distinct template positions it hits.  It cannot be longer than the
template and the neighbourhood, so hits that lie further off neither help nor harm it.

Texts are cut into words once.  Hashes that no template has are dropped inside a row's array, before
anything is exploded; only hits are shuffled, and the templates, a fixed table, are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: Exact templates count places where all words stand consecutively; others match in part.
    exact: bool = False


#: Base phrases, then notices of licences in their public wording.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)


#: What separates words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case.

    ``lower`` also changes other letters, which no template has; the two whose lower case holds an ASCII letter are
    replaced first by others that do not.
    """
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.array_remove(F.split(F.lower(safe), _SEPARATORS), "")


def templates_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """``template, label, exact, n (2-grams), at, h``: a row for each 2-gram of each template."""
    rows = [(i, t.label, t.exact, len(w) - 1, k, w[k], w[k + 1]) for i, t in enumerate(templates) for w in [t.words.split()] for k in range(len(w) - 1)]
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, n int, at int, a string, b string")
    return df.select("template", "label", "exact", "n", "at", F.xxhash64("a", "b").alias("h"))


def grams(docs: DataFrame, templates: tuple[Template, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_words, grams``: a row for each document, with the places and hashes of those of its 2-grams that a template has."""
    spark = docs.sparkSession
    known = [r.h for r in templates_table(spark, templates).select("h").distinct().orderBy("h").collect()]  # fixed: as many as the templates' words
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("w"))

    def hit(x: Column, i: Column) -> Column:
        h = F.xxhash64(x, F.get("w", i + 1))
        return F.when(h.isin(known) & (i + 1 < F.size("w")), F.struct(i.alias("pos"), h.alias("h")))

    found = F.filter(F.transform("w", hit), lambda x: x.isNotNull())
    return words.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), found.alias("grams"))


def hits(found: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """``doc_id, text_hash, template, label, exact, n, pos, at``: every template position that a document's 2-gram equals."""
    rows = found.select("doc_id", "text_hash", F.explode("grams").alias("g")).select("doc_id", "text_hash", "g.pos", "g.h")
    return rows.join(F.broadcast(templates_table(found.sparkSession, templates)), "h").drop("h")


def spans(found: DataFrame, drift: int = 3, least: float = 0.6) -> DataFrame:
    """Verified places: ``doc_id, text_hash, template, label, exact, start, end, share``; end is the last word's position.

    Exact templates need all their 2-grams on one diagonal.  Others need the share ``least`` of their distinct
    positions on diagonals at most ``drift`` from one of them, which gives the best place among its neighbours.
    Repeated rows vote once.
    """
    from pyspark.sql import Window as W

    key = ["doc_id", "text_hash", "template", "label", "exact", "n"]
    votes = found.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*key, "diagonal").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    # one document's diagonals of one template; a frame holds 2 * drift + 1 of them at most
    near = W.partitionBy(*key).orderBy("diagonal").rangeBetween(-drift, drift)
    merged = votes.select(
        *key,
        "diagonal",
        F.when(F.col("exact"), F.size("ats")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(near))))).alias("hit"),
        F.min(F.col("diagonal") + F.array_min("ats")).over(near).alias("first"),
        F.max(F.col("diagonal") + F.array_max("ats")).over(near).alias("last"),
    )
    best = F.max(F.struct("hit", (-F.col("diagonal")).alias("d"))).over(near)
    chosen = merged.withColumn("best", best).where(F.when(F.col("exact"), F.col("hit") == F.col("n")).otherwise((F.col("hit") >= least * F.col("n")) & (F.col("best.d") == -F.col("diagonal"))))
    return chosen.select(
        *key,
        F.when(F.col("exact"), F.col("diagonal")).otherwise(F.col("first")).alias("start"),
        F.when(F.col("exact"), F.col("diagonal") + F.col("n")).otherwise(F.col("last") + 1).alias("end"),
        (F.col("hit") / F.col("n")).alias("share"),
    )


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    n_base counts all places of base phrases, first_word and last_word are their smallest and largest
    start (null without any), labels are distinct, sorted and joined by commas (empty without any), score
    is the best share of a template found, and 0 without any.  Null texts are empty; rows
    that repeat get equal rows; a null id is an id like any other.  Other columns are not read.
    """
    rows = cut(grams(docs, base + notices, id_col, text_col), "license_grams")
    places = spans(hits(rows, base + notices))
    by_doc = places.groupBy("doc_id", "text_hash").agg(
        F.count(F.when(F.col("exact"), 1)).alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash"))
    out = rows.select("doc_id", "text_hash", "n_words").alias("d").join(by_doc.alias("p"), same, "left")
    return out.select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def schema() -> T.StructType:
    return T.StructType.fromDDL("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
