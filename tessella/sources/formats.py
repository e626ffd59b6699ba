"""Readers and writers: segmentation bundles, rank tables, gene lists, binned counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INDEX_SCHEMA = "scale_id string, mode string, resolution double, compactness double, seconds double, path string"


def write_bundle(segments: DataFrame, index: DataFrame, folder: str) -> None:
    """``segments`` (scale_id, obs_id, segment) partitioned by scale, and the index as CSV."""
    segments.repartition("scale_id").write.mode("overwrite").partitionBy("scale_id").parquet(f"{folder}/segments")
    index.write.mode("overwrite").option("header", True).csv(f"{folder}/segments_index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows; ``scale_id`` and ``path`` are required and rows without them raise."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(INDEX_SCHEMA).csv(f"{folder}/segments_index")
    bad = F.col("scale_id").isNull() | F.col("path").isNull()
    return df.withColumn("scale_id", F.when(bad, F.raise_error(F.lit("index row without scale_id or path"))).otherwise(F.col("scale_id")))


def read_scale(spark: SparkSession, folder: str, scale_id: str) -> DataFrame:
    """Segments of one scale: only its folder is listed.  Unassigned (-1) becomes null."""
    df = spark.read.schema("obs_id long, segment long, scale_id string").parquet(f"{folder}/segments").where(F.col("scale_id") == scale_id)
    return df.withColumn("segment", F.when(F.col("segment") >= 0, F.col("segment")))


def scale_row(index: DataFrame, scale_id: str) -> dict:
    rows = index.where(F.col("scale_id") == scale_id).limit(2).collect()
    if len(rows) != 1:
        raise KeyError(f"{len(rows)} index rows for scale {scale_id!r}")
    return rows[0].asDict()


#: How an index names the native scale.
NATIVE_IDS, NATIVE_MODE, NATIVE_PATH = ("native", "native_identity", "__native_identity__"), "native_identity", "__native_identity__"


def with_native(index: DataFrame) -> DataFrame:
    """Adds ``native``: by id, mode or path; only where no row has such a hint, by the column ``native_identity``, unless that is true for all of several rows."""
    from tessella.functions.scalars import is_true

    def text(c: str):
        return F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")) if c in index.columns else F.lit("")

    hint = text("scale_id").isin(*NATIVE_IDS) | F.contains(text("scale_id"), F.lit(NATIVE_MODE)) | (text("mode") == NATIVE_MODE)
    if "path" in index.columns:
        hint = hint | F.coalesce(F.col("path") == NATIVE_PATH, F.lit(False))
    flag = is_true("native_identity") if "native_identity" in index.columns else F.lit(False)
    x = index.withColumn("_hint", hint).withColumn("_flag", flag)
    all_ = x.agg(F.bool_or("_hint").alias("_any"), F.bool_and("_flag").alias("_all"), F.count(F.lit(1)).alias("_n"))
    weak = F.col("_flag") & ~(F.col("_all") & (F.col("_n") > 1))
    return x.crossJoin(F.broadcast(all_)).withColumn("native", F.when(F.col("_any"), F.col("_hint")).otherwise(weak)).drop("_hint", "_flag", "_any", "_all", "_n")


#: Modes in order of preference.
MODES = ("auto_reference", "native", "manual")


def match_scales(index: DataFrame, focus: float, reference: float, tol: float) -> DataFrame:
    """For each resolution the focus and the reference scale, compactness within ``tol``; ties by mode, seconds, compactness, id."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode")).cast("int"), F.lit(0))
    x = index.withColumn("_o", F.when(order == 0, len(MODES) + 1).otherwise(order))

    def pick(c: float, name: str) -> DataFrame:
        w = W.partitionBy("resolution").orderBy("_o", "seconds", "compactness", "scale_id")
        y = x.where(F.abs(F.col("compactness") - c) <= tol).withColumn("_r", F.row_number().over(w)).where("_r = 1")
        return y.select("resolution", F.col("scale_id").alias(name))

    return pick(focus, "focus_id").join(pick(reference, "reference_id"), "resolution")


def write_ranks(ranks: DataFrame, scales: list[str], path: str) -> None:
    """Wide CSV: gene, rank_<scale>."""
    wide = ranks.groupBy("gene").pivot("scale_id", scales).agg(F.first("rank"))
    wide.toDF("gene", *[f"rank_{s}" for s in scales]).write.mode("overwrite").option("header", True).csv(path)


def read_ranks(spark: SparkSession, path: str, scales: list[str]) -> DataFrame:
    """Long form of a wide rank table; missing ranks go."""
    schema = "gene string, " + ", ".join(f"`rank_{s}` long" for s in scales)
    df = spark.read.option("header", True).schema(schema).csv(path)
    long = df.unpivot("gene", [f"rank_{s}" for s in scales], "scale_id", "rank")
    return long.where("rank is not null").withColumn("scale_id", F.regexp_replace("scale_id", "^rank_", ""))


def gene_sets(ranks: DataFrame, top: int, max_rank: int | None = None) -> DataFrame:
    """The best ``top`` genes of each scale (up to ``max_rank``) as one sorted list."""
    w = W.partitionBy("scale_id").orderBy("rank", "gene")
    x = ranks.where(F.col("rank") <= max_rank) if max_rank else ranks
    x = x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return x.groupBy("scale_id").agg(F.array_join(F.array_sort(F.collect_list("gene")), ";").alias("genes"), F.count(F.lit(1)).alias("n"))


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One gene a line; trimmed, upper case, empty lines and repeats left out."""
    from tessella.functions.scalars import clean_symbol

    return spark.read.text(path).select(clean_symbol("value").alias("gene")).where("gene is not null").distinct()


def bin_counts(rows: DataFrame, size: int) -> DataFrame:
    """Counts of points of a long (x, y, gene, count) table summed over square bins."""
    return rows.groupBy(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"), "gene").agg(F.sum("count").alias("count"))


def read_gem(spark: SparkSession, path: str, size: int = 3) -> DataFrame:
    """Tab-separated geneID, x, y, MIDCount table (``#`` starts a comment), binned."""
    df = spark.read.option("header", True).option("sep", "\t").option("comment", "#").schema("geneID string, x long, y long, MIDCount long").csv(path)
    return bin_counts(df.select(F.col("geneID").alias("gene"), "x", "y", F.col("MIDCount").alias("count")), size)


def key_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of each candidate key column, most distinct first."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return long.groupBy("column").agg(F.count_distinct("value").alias("n_distinct")).orderBy(F.desc("n_distinct"), "column")
