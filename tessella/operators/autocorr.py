"""Moran's I and Geary's C of all genes at all scales, in closed form.

With S0 the sum of weights, r and c its row and column sums and m the mean over all n segments:
numerator = sum w x_i x_j - m (sum x r + sum x c) + m^2 S0, denominator = sum x^2 - n m^2.
Genes absent from a segment are 0 there; only stored values travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import min_rank
from tessella.sources.storage import many

from .graph import collapse, transform_weights
from .matrix import gene_filter, log1p, normalize_total, pseudo_bulk


#: Names of the covariates on which sizes are regressed out.
COVARIATES = {"log_n_spots": ("log_n_spots", "n_spots", "segment_size", "log_segment_size"), "log_total_counts": ("log_total_counts", "total_counts", "library_size", "log_library_size")}
NO_COVARIATE = ("", "none", "false", "off", "no")


def metric_of(mode: str | None) -> tuple[str, bool]:
    """Score column of a mode, and whether smaller is better."""
    return ("geary", True) if str(mode).lower() == "geary" else ("moran", False)


def covariate_of(name: str | None) -> str | None:
    """The covariate that a name stands for; None for names of none, an error for others."""
    key = "" if name is None else name.strip().lower()
    if key in NO_COVARIATE:
        return None
    for known, names in COVARIATES.items():
        if key in names:
            return known
    raise ValueError(f"unknown covariate {name!r}; one of {sorted(COVARIATES)} or None")


def moran(x: DataFrame, w: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    """``by, gene, moran, geary``.  ``x``: by, seg, gene, value; ``w``: by, i, j, weight; ``n``: by, n (all segments).

    Null where the gene does not vary or the graph has no weight.
    """
    rows = w.groupBy(*by, F.col("i").alias("seg")).agg(F.sum("weight").alias("r"))
    cols = w.groupBy(*by, F.col("j").alias("seg")).agg(F.sum("weight").alias("c"))
    s0 = w.groupBy(*by).agg(F.sum("weight").alias("s0"))
    zero = F.lit(0.0)
    sums = many(x).join(many(rows), [*by, "seg"], "left").join(many(cols), [*by, "seg"], "left")
    sums = sums.withColumn("r", F.coalesce("r", zero)).withColumn("c", F.coalesce("c", zero))
    v = F.col("value")
    m = sums.groupBy(*by, "gene").agg(F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"), F.sum(v * F.col("r")).alias("sxr"), F.sum(v * F.col("c")).alias("sxc"), F.sum(v * v * (F.col("r") + F.col("c"))).alias("sxxrc"))
    a = x.select(*by, F.col("seg").alias("i"), "gene", F.col("value").alias("xi"))
    b = x.select(*by, F.col("seg").alias("j"), "gene", F.col("value").alias("xj"))
    cross = many(w).join(many(a), [*by, "i"]).join(many(b), [*by, "j", "gene"]).groupBy(*by, "gene").agg(F.sum(F.col("weight") * F.col("xi") * F.col("xj")).alias("s1"))
    t = m.join(cross, [*by, "gene"], "left").join(F.broadcast(n), by).join(F.broadcast(s0), by, "left")
    s1, s0_ = F.coalesce("s1", zero), F.coalesce("s0", zero)
    mean = F.col("sx") / F.col("n")
    den = F.col("sxx") - mean * F.col("sx")
    ok = (den > 1e-9 * F.col("sxx")) & (s0_ > 0)
    i = F.col("n") / s0_ * (s1 - mean * (F.col("sxr") + F.col("sxc")) + mean * mean * s0_) / den
    c = (F.col("n") - 1) / (2 * s0_) * (F.col("sxxrc") - 2 * s1) / den
    return t.select(*by, "gene", F.when(ok, i).alias("moran"), F.when(ok, c).alias("geary"))


def residualise(x: DataFrame, covariate: DataFrame, n: DataFrame, by: list[str]) -> DataFrame:
    """Values minus their regression on one covariate ``z`` (by, seg, z), over all segments; unchanged where the normal equations are singular.

    The result is dense: every gene has a row for every segment.
    """
    genes = x.select(*by, "gene").distinct()
    dense = many(covariate.join(F.broadcast(genes), by)).join(many(x), [*by, "seg", "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    z, v = F.col("z"), F.col("value")
    s = dense.groupBy(*by, "gene").agg(F.count(F.lit(1)).alias("n_"), F.sum(z).alias("z_"), F.sum(z * z).alias("zz"), F.sum(v).alias("v_"), F.sum(z * v).alias("zv"))
    det = F.col("n_") * F.col("zz") - F.col("z_") * F.col("z_")
    slope = F.when(F.abs(det) > 1e-12, (F.col("n_") * F.col("zv") - F.col("z_") * F.col("v_")) / F.when(F.abs(det) > 1e-12, det).otherwise(1.0))
    s = s.withColumn("slope", slope).withColumn("icept", (F.col("v_") - F.col("slope") * F.col("z_")) / F.col("n_"))
    out = dense.join(F.broadcast(s.select(*by, "gene", "slope", "icept")), [*by, "gene"])
    return out.select(*by, "seg", "gene", F.when(F.col("slope").isNull(), v).otherwise(v - F.col("icept") - F.col("slope") * z).alias("value"))


def ranks(scores: DataFrame, by: list[str], metric: str = "moran", threshold: float | None = 0.0) -> DataFrame:
    """Competition ranks of the genes that pass: Moran above the threshold, descending; Geary up to it, ascending (0 or None: no limit)."""
    s = scores.where(F.col(metric).isNotNull())
    if metric == "moran":
        s = s.where(F.col(metric) > threshold) if threshold is not None else s
        return s.withColumn("rank", min_rank(F.desc(metric), by))
    s = s.where(F.col(metric) <= threshold) if threshold else s
    return s.withColumn("rank", min_rank(F.asc(metric), by))


def bulk_at_scales(expr: DataFrame, segments: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Normalised, logged pseudo-bulk of every scale; the gene filter comes before the row sums."""
    x = gene_filter(pseudo_bulk(expr, segments, [*by, "seg"]), [*by, "seg"], least, by)
    return log1p(normalize_total(x, [*by, "seg"]))


def pseudo_bulk_analysis(expr: DataFrame, obs: DataFrame, segments: DataFrame, edges: DataFrame, by: list[str], numeric: list[str] = (), categorical: list[str] = (), batch: str | None = None, least: int = 1, mode: str = "moran", residual: str | None = None, n_top: int | None = None) -> dict[str, DataFrame]:
    """All of a pseudo-bulk analysis, every scale in one plan.

    ``obs``: by segment the size, mean coordinates and numbers, most frequent categories, first batch, and the number of
    genes and the total of the filtered, normalised, logged matrix; ``matrix``; ``weights``; ``scores`` with ranks; with
    ``n_top``, ``variable``: the genes of largest variance over a scale's segments.
    """
    from pyspark.sql import Window as W

    from tessella.sources.storage import cut

    from .segment import aggregate_members

    x = cut(bulk_at_scales(expr, segments, by, least), "bulk")
    w = cut(transform_weights(collapse(edges, segments, by).select(*by, "i", "j", "weight"), "R", by), "weights")
    members = segments.join(obs, "obs_id")
    table = aggregate_members(members, [*by, "seg"], ["x", "y", *numeric], list(categorical), batch)
    per = x.groupBy(*by, "seg").agg(F.count(F.when(F.col("value") != 0, 1)).alias("genes"), F.sum("value").alias("total"))
    degree = w.groupBy(*by, F.col("i").alias("seg")).agg(F.count(F.lit(1)).alias("neighbours"))
    table = table.join(per, [*by, "seg"], "left").join(degree, [*by, "seg"], "left").na.fill(0, ["genes", "neighbours"]).na.fill(0.0, ["total"])
    n = segments.groupBy(*by).agg(F.count_distinct("seg").alias("n"))
    y, z = x, covariate_of(residual)
    if z is not None:
        size = segments.groupBy(*by, "seg").agg(F.log(1 + F.count(F.lit(1))).alias("z")) if z == "log_n_spots" else pseudo_bulk(expr, segments, [*by, "seg"]).groupBy(*by, "seg").agg(F.log1p(F.sum("value")).alias("z"))
        y = cut(residualise(x, size, n, by), "residuals")
    out = {"obs": table, "matrix": x, "weights": w, "scores": ranks(moran(y, w, n, by), by, metric_of(mode)[0])}
    if n_top is not None:
        v = x.groupBy(*by, "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(n), by)
        v = v.withColumn("variance", F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2.0))
        out["variable"] = v.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("variance"), "gene"))).where(F.col("_r") <= n_top).select(*by, "gene", "variance")
    return out


def multiscale(expr: DataFrame, segments: DataFrame, edges: DataFrame, by: list[str], least: int = 1, threshold: float | None = 0.0, metric: str = "moran") -> DataFrame:
    """All scales in one job: the scale is a key of every step."""
    from tessella.sources.storage import cut

    x = cut(bulk_at_scales(expr, segments, by, least), "bulk")
    w = cut(transform_weights(collapse(edges, segments, by).select(*by, "i", "j", "weight"), "R", by), "weights")
    n = segments.groupBy(*by).agg(F.count_distinct("seg").alias("n"))
    return ranks(moran(x, w, n, by), by, metric, threshold)
