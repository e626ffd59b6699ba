"""Ranks and scores across scales: trajectories, filling, classification by scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import average_rank, clip, correlation, hashed, quantile


def _grid(long: DataFrame, gene: str = "gene", scale: str = "scale") -> DataFrame:
    """Every gene at every scale; scales are few and broadcast."""
    return long.select(gene).distinct().crossJoin(F.broadcast(long.select(scale).distinct()))


def fill_worst(long: DataFrame) -> DataFrame:
    """Missing ranks become the largest rank anywhere, plus one."""
    worst = long.agg((F.max("rank") + 1).alias("_w"))
    return _grid(long).join(long.select("gene", "scale", "rank"), ["gene", "scale"], "left").crossJoin(F.broadcast(worst)).select("gene", "scale", F.coalesce("rank", "_w").alias("rank"), F.col("rank").isNull().alias("filled"))


def fill_for_plot(long: DataFrame, mode: str | float | None = "worst") -> DataFrame:
    """Missing ranks for drawing: ``worst`` of their scale plus one, ``global_worst``, a number, or as they are (``keep``).  A scale without any rank stays empty."""
    if mode is None or (isinstance(mode, str) and mode.strip().lower() in ("", "none", "nan", "keep", "raw")):
        return long.select("gene", "scale", "rank")
    full = _grid(long).join(long.select("gene", "scale", "rank"), ["gene", "scale"], "left")
    if isinstance(mode, str) and mode.strip().lower() in ("global_worst", "table_worst"):
        return fill_worst(long).select("gene", "scale", "rank")
    if isinstance(mode, str) and mode.strip().lower() in ("worst", "scale_worst", "per_scale_worst", "column_worst"):
        fill = F.max("rank").over(W.partitionBy("scale")) + 1
    else:
        fill = F.lit(float(mode))
    return full.select("gene", "scale", F.coalesce("rank", fill).alias("rank"))


def find_column(columns: list[str], scale: str, prefixes: tuple[str, ...] = ("rank_",)) -> str | None:
    """The column of a wide table that belongs to a scale: its id as it is, with a prefix, or with ``r`` or ``res_`` added or taken away."""
    bare = scale.removeprefix("res_").removeprefix("r") if scale.startswith("res_") else scale.removeprefix("r")
    forms = [scale, bare, f"r{bare}", f"res_{bare}"]
    for name in [scale, *[p + scale for p in prefixes], *forms[1:], *[p + f for p in prefixes for f in forms[1:]]]:
        if name in columns:
            return name
    return None


def wide_to_long(wide: DataFrame, scales: list[str], prefixes: tuple[str, ...] = ("rank_",), key: str = "gene", value: str = "rank") -> DataFrame:
    """Long rows ``gene, scale, rank`` of those scales whose column the table has; nulls go."""
    found = {s: c for s in scales if (c := find_column(wide.columns, s, prefixes))}
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.col(f"`{c}`").alias(value)) for s, c in found.items()])).alias("_r")
    return wide.select(key, rows).select(key, "_r.scale", f"_r.{value}").where(F.col(value).isNotNull())


def call_scale_specific(long: DataFrame, top: int, groups: int = 3, overrides: dict[float, str] | None = None, good: float = 0.3, min_groups: int = 2, gap: float = 0.1) -> DataFrame:
    """From ranks with gaps (``gene, scale, rank, score``) to calls: missing ranks imputed, scales grouped by the overlap of
    their top genes, single scales moved to other groups where ``overrides`` says so, and every gene called for its best group.

    Scales are few: their overlaps are all that reaches the driver.
    """
    from tessella.sources.storage import cut

    x = cut(impute(long), "imputed")
    d = jaccard(cut(top_sets(x, top), "tops")).collect()
    named = {float(s): g for s, g in cluster_scales([(r.a, r.b, 1 - r.jaccard) for r in d], groups).items()} | {float(s): g for s, g in (overrides or {}).items()}
    order = list(dict.fromkeys(named[s] for s in sorted(named)))
    grp = F.create_map(*[F.lit(v) for s, g in named.items() for v in (s, g)])[F.col("scale").cast("double")]
    n = x.agg(F.count_distinct("gene").alias("n"))
    y = x.crossJoin(F.broadcast(n)).withColumn("grp", grp).withColumn("sample", F.lit("all"))
    return svg_calls(y, good, min_groups, gap, order).drop("sample")


def impute(long: DataFrame) -> DataFrame:
    """Missing ranks become the number of genes; missing scores their scale's minimum (0 if there is none)."""
    n = long.agg(F.count_distinct("gene").alias("_n"))
    low = F.min("score").over(W.partitionBy("scale"))
    g = _grid(long).join(long.select("gene", "scale", "rank", "score"), ["gene", "scale"], "left").crossJoin(F.broadcast(n))
    return g.select("gene", "scale", F.coalesce("rank", "_n").cast("long").alias("rank"), F.coalesce("score", low, F.lit(0.0)).alias("score"), F.col("rank").isNull().alias("filled"))


def trajectory(long: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of a gene's values at equal resolution (or compactness)."""
    return long.groupBy("gene", by).agg(F.avg(value).alias(value))


def rank_shift(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """Per scale: common genes, Spearman, mean, median and largest shift, overlap of the top genes."""
    x = a.select("scale", "gene", F.col("rank").alias("ra"))
    y = b.select("scale", "gene", F.col("rank").alias("rb"))
    j = x.join(y, ["scale", "gene"])
    j = j.withColumn("pa", average_rank("ra", ["scale"])).withColumn("pb", average_rank("rb", ["scale"]))
    d = F.abs(F.col("ra") - F.col("rb"))
    return j.groupBy("scale").agg(
        F.count(F.lit(1)).alias("n"),
        correlation("pa", "pb").alias("spearman"),
        quantile(d, 0.5).alias("median_shift"),
        F.avg(d).alias("mean_shift"),
        F.max(d).cast("long").alias("max_shift"),
        F.count(F.when((F.col("ra") <= top) & (F.col("rb") <= top), 1)).alias("top_overlap"),
    )


def region_profile(long: DataFrame, value: str, region: Column, lower_better: bool, normalise: bool = True) -> DataFrame:
    """Per gene: best and second region by mean of the (column-normalised) value, gaps, spread and specificity, and the resolution that stands out."""
    w = W.partitionBy("scale")
    v = F.col(value) / F.max(value).over(w) if normalise else F.col(value)
    x = long.withColumn("_v", v).withColumn("region", region).where("region is not null")
    r = x.groupBy("gene", "region").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    sign = 1 if lower_better else -1
    order = W.partitionBy("gene").orderBy(F.col("mean") * sign, "region")
    r = r.withColumn("_p", F.row_number().over(order))
    out = r.groupBy("gene").agg(
        F.max(F.when(F.col("_p") == 1, F.col("region"))).alias("best_region"),
        F.max(F.when(F.col("_p") == 1, F.col("mean"))).alias("best"),
        F.max(F.when(F.col("_p") == 1, F.col("std"))).alias("std"),
        F.max(F.when(F.col("_p") == 2, F.col("mean"))).alias("second"),
    )
    gap = (F.col("second") - F.col("best")) * sign
    out = out.withColumn("gap_abs", gap)
    out = out.withColumn("gap_rel", gap / ((F.col("second") if lower_better else F.abs(F.col("best"))) + 1e-8))
    out = out.withColumn("specificity", gap / (F.col("std") + 1e-3))
    g = W.partitionBy("gene")
    others = F.try_divide(F.sum("_v").over(g) - F.col("_v"), F.count("_v").over(g) - 1)
    best_res = x.select("gene", "scale", ((others - F.col("_v")) * sign).alias("_d")).groupBy("gene").agg(F.min_by("scale", F.struct(-F.col("_d"), F.col("scale"))).alias("best_scale"))
    return out.join(best_res, "gene")


def classify_by_quantiles(profile: DataFrame, q_best: float, q_gap: float, q_rel: float, q_spec: float, q_std: float, lower_better: bool) -> DataFrame:
    """The best region where all five figures pass their quantile over the genes, else ``mixed``."""
    cut = profile.agg(quantile("best", q_best).alias("c1"), quantile("gap_abs", q_gap).alias("c2"), quantile("gap_rel", q_rel).alias("c3"), quantile("specificity", q_spec).alias("c4"), quantile("std", q_std).alias("c5"))
    good = F.col("best") <= F.col("c1") if lower_better else F.col("best") >= F.col("c1")
    ok = good & (F.col("gap_abs") >= F.col("c2")) & (F.col("gap_rel") >= F.col("c3")) & (F.col("specificity") >= F.col("c4")) & (F.col("std") <= F.col("c5"))
    return profile.crossJoin(F.broadcast(cut)).withColumn("category", F.when(ok, F.col("best_region")).otherwise("mixed")).drop("c1", "c2", "c3", "c4", "c5")


def score_selector(profile: DataFrame, least: float, gap: float) -> DataFrame:
    """Absolute limits on the best mean and its gap; composite mean + 0.5 gap - 0.25 std."""
    composite = F.col("best") + 0.5 * F.col("gap_abs") - 0.25 * F.col("std")
    ok = (F.col("best") >= least) & (F.col("gap_abs") >= gap)
    return profile.withColumn("composite", composite).withColumn("category", F.when(ok, F.col("best_region")).otherwise("mixed"))


def preference(rank: Column, by: list[str]) -> Column:
    """1 for the first rank down to 0 for the last."""
    top = F.max(rank).over(W.partitionBy(*by))
    return F.when(top > 1, clip(1 - (rank - 1) / (top - 1), 0.0, 1.0)).otherwise(1.0)


def hybrid_selector(long: DataFrame, region: Column, weight: float) -> DataFrame:
    """(1 - weight) rank preference + weight score percentile, by region, plus a quarter of its lead over the next."""
    x = long.withColumn("pref", preference(F.col("rank"), ["scale"])).withColumn("pct", average_rank("score", ["scale"]) / F.count("score").over(W.partitionBy("scale"))).withColumn("region", region)
    r = x.groupBy("gene", "region").agg(F.avg("pref").alias("pref"), F.avg("pct").alias("pct"))
    r = r.withColumn("base", (1 - weight) * F.col("pref") + weight * F.col("pct"))
    order = W.partitionBy("gene").orderBy(F.desc("base"), "region")
    lead = F.col("base") - F.lead("base").over(order)
    r = r.withColumn("lead", lead).withColumn("_p", F.row_number().over(order)).where("_p = 1")
    return r.select("gene", "region", (F.col("base") + 0.25 * F.coalesce("lead", F.lit(0.0))).alias("score"), "lead")


def group_of_scale(scale: Column, spec: dict) -> Column:
    """Named group of a scale: ``(lo, hi)`` inclusive, a list (tolerance 1e-4), or one number; later names win."""
    out = F.lit(None).cast("string")
    for name, s in spec.items():
        if isinstance(s, tuple):
            hit = scale.between(*s)
        else:
            hit = F.lit(False)
            for v in s if isinstance(s, (list, set)) else [s]:
                hit = hit | (F.abs(scale - float(v)) <= 1e-4)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def svg_calls(long: DataFrame, good: float, min_groups: int, gap: float, order: list[str]) -> DataFrame:
    """Scale-preferential calls from ``sample, gene, grp, rank, n``.

    By group: median and smallest rank percentile, share of good scales, number.  A gene with enough groups
    is called for its best group if that group's median is good, leads the second by ``gap`` and most of its scales are good.
    """
    pct = F.col("rank") / F.col("n")
    g = long.withColumn("_p", pct).groupBy("sample", "gene", "grp").agg(quantile("_p", 0.5).alias("median"), F.min("_p").alias("best"), F.avg((F.col("_p") <= good).cast("double")).alias("good"), F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("grp"))
    w = W.partitionBy("sample", "gene").orderBy("median", place)
    g = g.withColumn("_r", F.row_number().over(w))

    def at(k: int, c: str) -> Column:
        return F.max(F.when(F.col("_r") == k, F.col(c))).alias(f"{c}{k}")

    out = g.groupBy("sample", "gene").agg(F.count(F.lit(1)).alias("groups"), at(1, "grp"), at(1, "median"), at(1, "best"), at(1, "good"), at(2, "median")).where(F.col("groups") >= min_groups)
    lead = F.col("median2") - F.col("median1")
    called = (F.col("median1") <= good) & (lead >= gap) & (F.col("good1") >= 0.5)
    return out.select("sample", "gene", "groups", F.col("grp1").alias("grp"), F.col("median1").alias("median"), F.col("best1").alias("best"), F.col("good1").alias("good"), lead.alias("lead"), called.alias("called"))


def continuous_specificity(long: DataFrame, n_perm: int = 99, seed: int = 0) -> DataFrame:
    """Preference-weighted mean and spread of log2 resolution, prominence / (breadth + 1e-6), and an empirical p from permuting preferences within the gene.

    Permutations come from hashes of (seed, permutation, gene, scale): the same for every partitioning.
    """
    x = long.withColumn("p", preference(F.col("rank"), ["scale"])).withColumn("l", F.log2(F.col("scale").cast("double")))

    def stats(df: DataFrame, keys: list[str], p: str) -> DataFrame:
        # a gene's scales in order: sums are the same in every run
        one = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("l", F.col(p).alias("p")))).alias("_a"))

        def total(of) -> Column:
            return F.aggregate("_a", F.lit(0.0), lambda acc, e: acc + of(e))

        one = one.withColumn("_w", total(lambda e: e["p"])).withColumn("centre", F.try_divide(total(lambda e: e["p"] * e["l"]), F.col("_w")))
        var = F.try_divide(total(lambda e: e["p"] * (e["l"] - F.col("centre")) * (e["l"] - F.col("centre"))), F.col("_w"))
        ps = F.transform("_a", lambda e: e["p"])
        one = one.withColumn("breadth", F.sqrt(F.greatest(var, F.lit(0.0)))).withColumn("prominence", F.array_max(ps) - F.col("_w") / F.size("_a"))
        return one.withColumn("specificity", F.col("prominence") / (F.col("breadth") + 1e-6)).drop("_a", "_w")

    own = stats(x, ["gene"], "p")
    perms = x.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    key = W.partitionBy("gene", "perm")
    a = perms.withColumn("_a", F.row_number().over(key.orderBy("scale")))
    b = perms.withColumn("_a", F.row_number().over(key.orderBy(hashed(seed, "perm", "gene", "scale")))).select("gene", "perm", "_a", F.col("p").alias("q"))
    null = stats(a.join(b, ["gene", "perm", "_a"]), ["gene", "perm"], "q").select("gene", F.col("specificity").alias("null"))
    p = null.join(own.select("gene", "specificity"), "gene").groupBy("gene").agg(((F.count(F.when(F.col("null") >= F.col("specificity") * (1 - 1e-6), 1)) + 1) / (n_perm + 1)).alias("pvalue"))
    return own.join(p, "gene")


def robustness(long: DataFrame, top: int) -> DataFrame:
    """Per gene over scales: mean, median, extremes, population spread, quartile range, share of scales in the top."""
    r = F.col("rank")
    return long.groupBy("gene").agg(
        F.avg(r).alias("mean"),
        quantile(r, 0.5).alias("median"),
        F.min(r).cast("long").alias("best"),
        F.max(r).cast("long").alias("worst"),
        F.stddev_pop(r).alias("std"),
        (quantile(r, 0.75) - quantile(r, 0.25)).alias("iqr"),
        F.avg((r <= top).cast("double")).alias("top_share"),
        F.count(F.lit(1)).alias("n"),
    )


def top_sets(long: DataFrame, top: int) -> DataFrame:
    """The best ``top`` genes of each scale; ties by name."""
    w = W.partitionBy("scale").orderBy("rank", "gene")
    return long.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("scale", "gene", "place")


def jaccard(sets: DataFrame) -> DataFrame:
    """Overlap of the gene sets of every two scales (self-join on the gene, never all pairs of genes)."""
    a = sets.select(F.col("scale").alias("a"), "gene")
    b = sets.select(F.col("scale").alias("b"), "gene")
    common = a.join(b, "gene").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    size = sets.groupBy("scale").agg(F.count(F.lit(1)).alias("n"))
    scales = F.broadcast(size.select(F.col("scale").alias("a"), F.col("n").alias("na"))).crossJoin(F.broadcast(size.select(F.col("scale").alias("b"), F.col("n").alias("nb"))))
    out = scales.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def cluster_scales(distances: list[tuple[float, float, float]], groups: int, names: tuple[str, ...] = ("fine", "mid", "coarse")) -> dict[float, str]:
    """Average-linkage clusters of the scales (a few tens, on the driver), named by ascending median scale.

    ``distances``: rows (a, b, distance).  With other than three groups the names are ``g1``, ``g2`` ...
    """
    d = {(a, b): x for a, b, x in distances}
    clusters = [[s] for s in sorted({a for a, _, _ in distances})]
    while len(clusters) > groups:
        def gap(i: int, j: int) -> float:
            return sum(d[p, q] for p in clusters[i] for q in clusters[j]) / (len(clusters[i]) * len(clusters[j]))

        _, i, j = min((gap(i, j), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        clusters[i] += clusters.pop(j)
    import statistics

    clusters.sort(key=statistics.median)
    if len(clusters) != len(names):
        names = tuple(f"g{i + 1}" for i in range(len(clusters)))
    return {s: n for c, n in zip(clusters, names, strict=True) for s in c}
