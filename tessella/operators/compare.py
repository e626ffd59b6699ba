"""Comparing segmentations: per-gene segment metrics, gains, purity, concentration, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import average_rank, correlation, quantile, weighted_average
from tessella.sources.storage import cut, many

#: Metrics of a segmentation, and whether more is better.
METRICS = {"within_var": -1, "between_var": 1, "snr": 1, "r2": 1, "detection": 1, "dynamic_range": 1, "top10_mass": 1, "neighbor_contrast": 1, "segment_moran": 1, "sizeaware_moran": 1}


def segment_metrics(expr: DataFrame, segments: DataFrame, boundaries: DataFrame, by: list[str]) -> DataFrame:
    """Ten metrics per ``by, gene``; ``boundaries``: by, i < j, weight.

    Segments without the gene have mean 0 there, so the dense grid is segments x genes, not entities x genes.
    The sums and the grid are stored: what follows reads them several times.
    """
    sizes = segments.groupBy(*by, "seg").agg(F.count(F.lit(1)).alias("n"))
    sums = many(expr).join(many(segments), "obs_id").groupBy(*by, "seg", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    sums = cut(sums, "sums")
    genes = sums.select(*by, "gene").distinct()
    zero = F.lit(0.0)
    x = sizes.join(F.broadcast(genes), by).join(many(sums), [*by, "seg", "gene"], "left").withColumn("s", F.coalesce("s", zero)).withColumn("q", F.coalesce("q", zero))
    x = x.withColumn("mu", F.col("s") / F.col("n"))
    tot = x.groupBy(*by, "gene").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.avg("mu").alias("flat"), F.count(F.lit(1)).alias("k"))
    x = x.join(F.broadcast(tot), [*by, "gene"]).withColumn("grand", F.col("s_all") / F.col("n_all"))
    order = W.partitionBy(*by, "gene").orderBy(F.desc("s"), "seg")
    x = cut(x.withColumn("place", F.row_number().over(order)), "grid")
    n, mu, grand = F.col("n"), F.col("mu"), F.col("grand")
    within = F.sum(F.col("q") - 2 * mu * F.col("s") + n * mu * mu) / F.max("n_all")
    between = F.sum(n * F.pow(mu - grand, 2.0)) / F.max("n_all")
    top = F.greatest(F.lit(1), F.ceil(F.col("k") * 0.1))
    m = x.groupBy(*by, "gene").agg(
        within.alias("within_var"),
        between.alias("between_var"),
        F.avg((mu > 0).cast("double")).alias("detection"),
        (quantile("mu", 0.9) - quantile("mu", 0.1)).alias("dynamic_range"),
        F.try_divide(F.sum(F.when(F.col("place") <= top, F.col("s"))), F.max("s_all")).alias("top10_mass"),
        F.sum(F.pow(mu - F.col("flat"), 2.0)).alias("zz"),
        F.sum(n * F.pow(mu - grand, 2.0)).alias("nzz"),
        F.max("k").alias("k"),
        F.max("n_all").alias("n_all"),
    )
    a = x.select(*by, "gene", F.col("seg").alias("i"), F.col("mu").alias("ma"), F.col("n").alias("na"), "flat", "grand")
    b = x.select(*by, "gene", F.col("seg").alias("j"), F.col("mu").alias("mb"), F.col("n").alias("nb"))
    e = many(boundaries).join(many(a), [*by, "i"]).join(many(b), [*by, "j", "gene"])
    w, wn = F.col("weight"), F.col("weight") * F.sqrt(F.col("na") * F.col("nb"))
    edge = e.groupBy(*by, "gene").agg(
        F.try_divide(F.sum(w * F.abs(F.col("ma") - F.col("mb"))), F.sum(w)).alias("neighbor_contrast"),
        F.sum(w).alias("w"),
        F.sum(w * (F.col("ma") - F.col("flat")) * (F.col("mb") - F.col("flat"))).alias("wzz"),
        F.sum(wn).alias("wn"),
        F.sum(wn * (F.col("ma") - F.col("grand")) * (F.col("mb") - F.col("grand"))).alias("wnzz"),
    )
    out = m.join(edge, [*by, "gene"], "left")
    return out.select(
        *by,
        "gene",
        "within_var",
        "between_var",
        (F.col("between_var") / (F.col("within_var") + 1e-12)).alias("snr"),
        (F.col("between_var") / F.greatest(F.col("within_var") + F.col("between_var"), F.lit(1e-12))).alias("r2"),
        "detection",
        "dynamic_range",
        "top10_mass",
        "neighbor_contrast",
        F.try_divide(F.try_divide(F.col("k"), 2 * F.col("w")) * 2 * F.col("wzz"), F.col("zz")).alias("segment_moran"),
        F.try_divide(F.try_divide(F.col("n_all"), 2 * F.col("wn")) * 2 * F.col("wnzz"), F.col("nzz")).alias("sizeaware_moran"),
    )


def gains(focus: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Focus minus reference, turned so that more is better."""
    r = reference.select(*by, "gene", *[F.col(m).alias(f"_{m}") for m in METRICS])
    j = focus.join(r, [*by, "gene"])
    return j.select(*by, "gene", *[(F.lit(s) * (F.col(m) - F.col(f"_{m}"))).alias(f"gain_{m}") for m, s in METRICS.items()])


def contrast(df: DataFrame, focus: str, reference: str, score: str, eps: float = 1e-6) -> DataFrame:
    """Adds how far the focus' mean lies below the reference's (lower is better): ``contrast, contrast_abs, contrast_ratio``, and the average-rank percentile of ``score``."""
    f, r = F.col(focus).cast("double"), F.col(reference).cast("double")
    scored = df.withColumn("_one", F.lit(1))  # a row for each gene
    out = scored.withColumn("contrast", r - f).withColumn("contrast_abs", F.abs(r - f)).withColumn("contrast_ratio", (r - f) / (r + f + eps))
    pct = average_rank(score, ["_one"]) / F.count(score).over(W.partitionBy("_one"))
    return out.withColumn("percentile", F.when(F.col(score).isNotNull(), pct)).drop("_one")


def resolve_markers(panels: DataFrame, genes: DataFrame) -> DataFrame:
    """``panel, gene`` of the panels' genes that exist; a panel without any is an error."""
    known = panels.distinct().join(genes.select("gene").distinct().withColumn("_k", F.lit(1)), "gene", "left")
    n = F.count("_k").over(W.partitionBy("panel"))
    checked = known.withColumn("_n", n).where(F.when(F.col("_n") == 0, F.raise_error(F.concat(F.lit("no gene of the panel exists: "), F.col("panel"))).cast("boolean")).otherwise(F.lit(True)))
    return checked.where("_k is not null").select("panel", "gene")


def purity_contrast(focus: DataFrame, reference: DataFrame, n_classes: int, by: list[str]) -> DataFrame:
    """Weighted purity of two segmentations (``by, seg, class, v``) side by side, and the focus' gain in each figure (less ambiguity is better)."""
    signs = {"top": 1, "ambiguity": -1, "margin": 1, "purity": 1}
    f = purity_summary(purity(focus, n_classes, by), "mass", by)
    r = purity_summary(purity(reference, n_classes, by), "mass", by).select(*by, *[F.col(c).alias(f"ref_{c}") for c in signs])
    return f.join(r, by).select(*by, *signs, *[f"ref_{c}" for c in signs], *[(s * (F.col(c) - F.col(f"ref_{c}"))).alias(f"gain_{c}") for c, s in signs.items()])


def rank_concordance(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """Two rankings per ``scale``: common genes, Spearman, overlap and Jaccard of the genes ranked ``top`` or better."""
    j = a.select("scale", "gene", F.col("rank").alias("ra")).join(b.select("scale", "gene", F.col("rank").alias("rb")), ["scale", "gene"])
    j = j.withColumn("_pa", average_rank("ra", ["scale"])).withColumn("_pb", average_rank("rb", ["scale"]))
    ina, inb = F.col("ra") <= top, F.col("rb") <= top
    both, either = F.count(F.when(ina & inb, 1)), F.count(F.when(ina | inb, 1))
    return j.groupBy("scale").agg(F.count(F.lit(1)).alias("n"), correlation("_pa", "_pb").alias("spearman"), both.alias("top_overlap"), F.try_divide(both, either).alias("top_jaccard"))


def example_genes(scores: DataFrame, order: list, n: int, wanted: list[str] = ()) -> DataFrame:
    """The ``n`` genes to show: those asked for that exist, in that order, then the best by ``order``: ``place, gene`` (the limit is the feature)."""
    asked = F.array_position(F.array(*[F.lit(g) for g in wanted]), F.col("gene")) if wanted else F.lit(0)
    x = scores.select("gene", F.when(asked > 0, asked).otherwise(1 << 30).alias("_a"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    top = x.orderBy("_a", *[f"_o{i}" for i in range(len(order))], "gene").limit(n)
    w = W.orderBy("_a", *[f"_o{i}" for i in range(len(order))], "gene")
    return top.select(F.row_number().over(w).cast("long").alias("place"), "gene")


def tidy_summary(df: DataFrame, by: list[str], values: list[str], qs: tuple[float, ...] = (0.25, 0.75)) -> DataFrame:
    """Long summary: ``by, metric, n, mean, median, std (sample), positive, nonzero, q25 ...``."""
    long = df.unpivot(by, values, "metric", "value").where("value is not null")
    v = F.col("value")
    aggs = [quantile(v, q).alias(f"q{round(q * 100):02d}") for q in qs]
    return long.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), quantile(v, 0.5).alias("median"), F.stddev_samp(v).alias("std"), F.avg((v > 0).cast("double")).alias("positive"), F.avg((v != 0).cast("double")).alias("nonzero"), *aggs)


def both_summaries(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Means by ``a`` and by ``b`` from one pass over the rows (grouping sets)."""
    return df.groupingSets([[a], [b]], a, b).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def purity(class_sums: DataFrame, n_classes: int, by: list[str]) -> DataFrame:
    """Per segment from ``by, seg, class, v``: top share, its class, ambiguity, margin to the second, 1 - entropy / ln max(2, K), mass."""
    w = W.partitionBy(*by, "seg")
    x = class_sums.where("v > 0").withColumn("p", F.col("v") / F.sum("v").over(w))
    x = x.withColumn("_r", F.row_number().over(w.orderBy(F.desc("p"), "class")))
    k = max(2, n_classes)
    top = F.max(F.when(F.col("_r") == 1, F.col("p")))
    second = F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("p"))), F.lit(0.0))
    ent = 1 + F.sum(F.col("p") * F.log("p")) / F.log(F.lit(float(k)))
    return x.groupBy(*by, "seg").agg(top.alias("top"), F.max(F.when(F.col("_r") == 1, F.col("class"))).alias("class"), (1 - top).alias("ambiguity"), (top - second).alias("margin"), ent.alias("purity"), F.sum("v").alias("mass"))


def purity_summary(per_segment: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """Weighted means over segments."""
    w = F.col(weight)
    cols = [weighted_average(F.col(c), w).alias(c) for c in ("top", "ambiguity", "margin", "purity")]
    return per_segment.groupBy(*by).agg(*cols, F.count(F.lit(1)).alias("segments")) if by else per_segment.agg(*cols, F.count(F.lit(1)).alias("segments"))


def neighbour_purity(per_segment: DataFrame, boundaries: DataFrame, by: list[str]) -> DataFrame:
    """Share of boundary weight between segments of one dominant class."""
    a = per_segment.select(*by, F.col("seg").alias("i"), F.col("class").alias("ca"))
    b = per_segment.select(*by, F.col("seg").alias("j"), F.col("class").alias("cb"))
    j = boundaries.join(a, [*by, "i"]).join(b, [*by, "j"])
    v = F.try_divide(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)), F.sum("weight")).alias("neighbour_purity")
    return j.groupBy(*by).agg(v) if by else j.agg(v)


def gain_drivers(g: DataFrame, metrics: list[str], eps: float = 1e-12) -> DataFrame:
    """Positive gains over their 90 % quantile (of positive ones); the largest drives, ``mixed`` under 1.25 times the second, ``weak`` if none is positive."""
    scale = g.agg(*[quantile(F.when(F.col(m) > 0, F.col(m)), 0.9).alias(f"_{m}") for m in metrics])
    x = g.crossJoin(F.broadcast(scale))
    share = {m: F.when(F.col(m) > 0, F.coalesce(F.try_divide(F.col(m), F.col(f"_{m}")), F.lit(0.0))).otherwise(0.0) for m in metrics}
    entries = F.sort_array(F.array(*[F.struct(share[m].alias("v"), F.lit(m).alias("m")) for m in metrics]), asc=False)
    x = x.withColumn("_e", entries)
    best, second = F.col("_e")[0], F.col("_e")[1]
    driver = F.when(best["v"] <= eps, "weak").when(second["v"] * 1.25 > best["v"], "mixed").otherwise(best["m"])
    return x.withColumn("driver", driver).withColumn("strength", best["v"]).drop("_e", *[f"_{m}" for m in metrics])


def concentration(totals: DataFrame, by: list[str], top: float = 0.25) -> DataFrame:
    """Per gene from segment totals (``by, gene, seg, v``): mass of the top share (ceil), area between the capture curve and the diagonal, share of segments for half the mass, effective segments."""
    w = W.partitionBy(*by, "gene").orderBy(F.desc("v"), "seg")
    whole = W.partitionBy(*by, "gene")
    x = totals.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("total", F.sum("v").over(whole)).where("total > 0")
    x = x.withColumn("cum", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.col("total"))
    prev = F.coalesce(F.lag("cum").over(w), F.lit(0.0))
    step = (F.col("cum") + prev) / 2 / F.col("n") - (2 * F.col("k") - 1) / (2 * F.col("n") * F.col("n"))
    x = x.withColumn("step", step).withColumn("p", F.col("v") / F.col("total"))
    return x.groupBy(*by, "gene").agg(
        F.max(F.when(F.col("k") <= F.ceil(F.col("n") * F.lit(top)), F.col("cum"))).alias("top_mass"),
        F.sum("step").alias("area"),
        (F.min(F.when(F.col("cum") >= 0.5 - 1e-12, F.col("k"))) / F.max("n")).alias("half_share"),
        (1 / F.sum(F.col("p") * F.col("p"))).alias("effective"),
    )


def agreement(df: DataFrame, a: str, b: str, by: list[str], top: int) -> DataFrame:
    """Spearman, Pearson, share of equal signs, overlap and Jaccard of the top values of two scores."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = x.withColumn("_ra", average_rank(a, by)).withColumn("_rb", average_rank(b, by))
    w = W.partitionBy(*by)
    x = x.withColumn("_ta", F.row_number().over(w.orderBy(F.desc(a), "gene")) <= top).withColumn("_tb", F.row_number().over(w.orderBy(F.desc(b), "gene")) <= top)
    both, either = F.count(F.when(F.col("_ta") & F.col("_tb"), 1)), F.count(F.when(F.col("_ta") | F.col("_tb"), 1))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_ra", "_rb").alias("spearman"), correlation(a, b).alias("pearson"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign"), both.alias("top_overlap"), F.try_divide(both, either).alias("top_jaccard"))


def relationship(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """Genes of either ranking: in both tops, in one only, or in neither."""
    j = a.select("gene", F.col("rank").alias("ra")).join(b.select("gene", F.col("rank").alias("rb")), "gene", "full_outer")
    ina, inb = F.coalesce(F.col("ra") <= top, F.lit(False)), F.coalesce(F.col("rb") <= top, F.lit(False))
    return j.withColumn("relation", F.when(ina & inb, "both").when(ina, "first_only").when(inb, "second_only").otherwise("neither"))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of ``b``'s values for each ``a``, zero filled in a fixed order, with the row's share of each."""
    t = df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0, values)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    return t.select(a, *[F.col(f"`{v}`").alias(v) for v in values], *[F.try_divide(F.col(f"`{v}`"), total).alias(f"{v}_share") for v in values])


def stability(focus: DataFrame, reference: DataFrame, t: float) -> DataFrame:
    """Per gene over compactness values of the focus against the mean of the reference: centre, spread, share at ``t`` or more, spike (max - median), verdict."""
    v = F.col("value")
    f = focus.groupBy("gene").agg(F.avg(v).alias("mean"), quantile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), (quantile(v, 0.75) - quantile(v, 0.25)).alias("iqr"), F.avg((v >= t).cast("double")).alias("share"))
    r = reference.groupBy("gene").agg(F.avg(v).alias("ref"))
    return f.join(r, "gene", "left").withColumn("delta", F.col("mean") - F.col("ref")).withColumn("spike", F.col("max") - F.col("median")).withColumn("stable", (F.col("share") >= 0.75) & (F.col("std") <= F.abs(F.col("mean")) * 0.5))


def association(df: DataFrame, metrics: list[str], target: str, q: float) -> DataFrame:
    """Each metric against a target: Pearson, Spearman, and median targets in its low, middle and high group."""
    long = df.unpivot(["gene", target], metrics, "metric", "value").where(F.col("value").isNotNull() & F.col(target).isNotNull())
    cut = long.groupBy("metric").agg(quantile("value", q).alias("_lo"), quantile("value", 1 - q).alias("_hi"))
    x = long.join(F.broadcast(cut), "metric").withColumn("_a", average_rank("value", ["metric"])).withColumn("_b", average_rank(target, ["metric"]))
    g = F.when(F.col("value") <= F.col("_lo"), "low").when(F.col("value") >= F.col("_hi"), "high").otherwise("mid")
    x = x.withColumn("_g", g)

    def med(name: str) -> Column:
        return quantile(F.when(F.col("_g") == name, F.col(target)), 0.5).alias(f"{name}_median")

    return x.groupBy("metric").agg(correlation("value", target).alias("pearson"), correlation("_a", "_b").alias("spearman"), med("low"), med("mid"), med("high"))
