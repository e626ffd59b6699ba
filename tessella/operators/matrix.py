"""Sparse measurements ``(entity, gene, value)``: an absent row is zero and counts in every denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import with_quantiles
from tessella.sources.storage import many


def pseudo_bulk(expr: DataFrame, members: DataFrame, keys: list[str], mean: bool = False) -> DataFrame:
    """Sum (or mean over all members) of every gene in every segment; ``members``: obs_id and ``keys``."""
    x = many(expr).join(many(members), "obs_id").groupBy(*keys, "gene").agg(F.sum("value").alias("value"))
    if not mean:
        return x
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return x.join(size, keys).withColumn("value", F.col("value") / F.col("_n")).drop("_n")


def normalize_total(x: DataFrame, keys: list[str], total: float = 1e4) -> DataFrame:
    """Scale each row of the matrix to ``total``; rows that sum to 0 stay."""
    s = F.sum("value").over(W.partitionBy(*keys))
    return x.withColumn("value", F.when(s == 0, F.col("value")).otherwise(F.col("value") * total / s))


def log1p(x: DataFrame) -> DataFrame:
    return x.withColumn("value", F.log1p("value"))


def gene_filter(x: DataFrame, keys: list[str], least: int, by: list[str] = ()) -> DataFrame:
    """Genes present in ``least`` or more rows of the matrix (within each group ``by``)."""
    ok = x.where("value <> 0").groupBy(*by, "gene").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return x.join(ok.drop("_n"), [*by, "gene"], "left_semi")


def tf_idf(x: DataFrame, n_rows: Column | int, key: str = "obs_id") -> DataFrame:
    """value / row sum * ln(1 + N / (1 + df))."""
    df = x.where("value <> 0").groupBy("gene").agg(F.count(F.lit(1)).alias("_df"))
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    s = F.sum("value").over(W.partitionBy(key))
    return x.withColumn("_tf", F.try_divide("value", s)).join(df, "gene").withColumn("value", F.col("_tf") * F.log(1 + n / (1 + F.col("_df")))).drop("_tf", "_df")


def gene_moments(x: DataFrame, n_rows: int) -> DataFrame:
    """Mean, population variance, detection rate of every gene over ``n_rows`` entities, zeros included."""
    return x.groupBy("gene").agg(
        (F.sum("value") / n_rows).alias("mean"),
        (F.sum(F.col("value") * F.col("value")) / n_rows - F.pow(F.sum("value") / n_rows, 2.0)).alias("variance"),
        (F.count(F.when(F.col("value") > 0, 1)) / n_rows).alias("detection"),
    )


def variable_features(x: DataFrame, n_rows: int, q: float) -> DataFrame:
    """Genes whose variance is at or above its ``q`` quantile."""
    m = with_quantiles(gene_moments(x, n_rows), "variance", {"_cut": q})
    return m.where(F.col("variance") >= F.col("_cut")).drop("_cut")


def highly_variable(x: DataFrame, n_rows: int, n_top: int, bins: int = 5) -> DataFrame:
    """Top genes by dispersion (variance / mean) normalised within equal-count bins of the mean; ties by name."""
    m = gene_moments(x, n_rows).withColumn("dispersion", F.try_divide("variance", "mean"))
    total = m.agg(F.count(F.lit(1)).alias("_g"))
    m = m.crossJoin(F.broadcast(total))
    place = F.row_number().over(W.orderBy("mean", "gene")) - 1  # genes, not observations: a small dimension
    m = m.withColumn("bin", F.floor(place * bins / F.col("_g")).cast("int"))
    w = W.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(w)
    m = m.withColumn("score", F.coalesce(F.try_divide(F.col("dispersion") - F.avg("dispersion").over(w), sd), F.lit(0.0)))
    r = F.row_number().over(W.orderBy(F.desc("score"), "gene"))
    return m.withColumn("place", r).where(F.col("place") <= n_top).drop("_g")


def gene_score(x: DataFrame, genes: list[str], entities: DataFrame, key: str = "obs_id") -> DataFrame:
    """Mean of the listed genes of every entity, absent ones as 0."""
    s = x.where(F.col("gene").isin(genes)).groupBy(key).agg((F.sum("value") / len(genes)).alias("score"))
    return entities.select(key).join(s, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def expression_embedding(x: DataFrame, genes: list[str], members: DataFrame, how: str = "mean") -> DataFrame:
    """Log of the genes' share of each entity's total, averaged (or summed) over its segment and given back to its members."""
    picked = F.sum(F.when(F.col("gene").isin(genes), F.col("value")).otherwise(0.0))
    s = x.groupBy("obs_id").agg(picked.alias("picked"), F.sum("value").alias("total"))
    per = members.join(s, "obs_id", "left").withColumn("share", F.coalesce(F.try_divide("picked", "total"), F.lit(0.0)))
    w = W.partitionBy("seg")
    v = F.avg("share").over(w) if how == "mean" else F.sum("share").over(w)
    return per.select("obs_id", "seg", F.log1p(v).alias("value"))


def background_genes(all_genes: DataFrame, selected: DataFrame) -> DataFrame:
    return all_genes.select("gene").distinct().join(selected.select("gene"), "gene", "left_anti")


def loading_embedding(x: DataFrame, loadings: DataFrame, key: str = "obs_id") -> DataFrame:
    """Sum of absolute loadings over the genes that an entity expresses."""
    return x.where("value > 0").join(loadings, "gene").groupBy(key, "pc").agg(F.sum(F.abs("loading")).alias("value"))
