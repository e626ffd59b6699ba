"""One whole-table query for each training-data operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embdup, htmltext, langid, licenses, media, mixing, neardup, packing, quality, tokenids
from .common import cut, documents
from .tokens import tokenizer_path

SEQUENCE = 2048


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenids.write_shards(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokenids.read_digests(path, spark)


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenize_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=SEQUENCE, with_ids=False)
    return packing.pack(pieces, SEQUENCE)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), percent=85)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs)
    got = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = quality.score(docs.select("doc_id", "text"), quality.fit(docs), keep=["doc_id"])
    return got.select("doc_id", "weak_label", "quality", (F.col("quality") >= 0.5).alias("kept"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.replicate(docs, mixing.rates(docs)).select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("n_copies").cast("long").alias("n_copies"), F.col("copy").cast("long").alias("copy"))


OP7_SQL = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n::DOUBLE, 0.5) * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT sum(pow(n::DOUBLE, 0.5)) FROM n) * n) AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + sqrt(rate) * 10 + 20)::BIGINT + 1)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT doc_id, source, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
d AS (SELECT u.doc_id, u.source, any_value(c.rate) AS rate, count(*) FILTER (WHERE c.cdf <= u.u) AS n_copies
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source, u.u)
SELECT doc_id, source, round(rate, 9) AS rate, n_copies, unnest(range(0, n_copies)) AS copy FROM d WHERE n_copies > 0
"""


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    got = htmltext.extract(pages, keep=["page_id", "url"])
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    stored = cut(media.read_media(spark, media.store_media(docs)), "media_features")
    sequences = media.parse_interleaved(media.as_page(docs), keep=["doc_id", "n_bytes"])
    got = media.resolve(sequences, stored)
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_token_shards, op2_best_fit_packing, op3_near_duplicates, op4_language, op5_embedding_duplicates, op6_quality, op7_source_mixture, op8_main_text, op9_license_scan, op10_media_columns, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixture": OP7_SQL}
