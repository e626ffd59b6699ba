"""Group enrichment: effect sizes, rank tests, permutations, gene sets, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import benjamini_hochberg, chi2_sf_even, hashed, hashed_int, normal_sf, zscore
from tessella.sources.storage import cut, many


def group_sizes(obs: DataFrame, least: int | str = "auto") -> DataFrame:
    """``celltype, n_in, n_out`` of groups with enough members inside and outside (``auto``: max(15, ceil(0.001 n)))."""
    total = obs.agg(F.count(F.lit(1)).alias("n"))
    g = obs.where("celltype is not null").groupBy("celltype").agg(F.count(F.lit(1)).alias("n_in")).crossJoin(F.broadcast(total))
    m = F.greatest(F.lit(15), F.ceil(F.col("n") * 0.001)) if least == "auto" else F.lit(least)
    return g.withColumn("n_out", F.col("n") - F.col("n_in")).where((F.col("n_in") >= m) & (F.col("n_out") >= m)).select("celltype", "n_in", "n_out")


def effects(expr: DataFrame, obs: DataFrame, least: int | str = "auto") -> DataFrame:
    """Gene x group: means and shares inside and outside (absent values are 0), their differences, log2 fold change."""
    sizes = group_sizes(obs, least)
    per = many(expr).join(many(obs).select("obs_id", "celltype"), "obs_id").groupBy("gene", "celltype").agg(F.sum("value").alias("s"), F.count(F.when(F.col("value") > 0, 1)).alias("c"))
    per = cut(per, "sums")  # genes x groups, read twice
    total = per.groupBy("gene").agg(F.sum("s").alias("s_all"), F.sum("c").alias("c_all"))
    g = total.crossJoin(F.broadcast(sizes)).join(per, ["gene", "celltype"], "left")  # genes x a few groups
    s, c = F.coalesce("s", F.lit(0.0)), F.coalesce("c", F.lit(0))
    mi, mo = s / F.col("n_in"), (F.col("s_all") - s) / F.col("n_out")
    pi, po = c / F.col("n_in"), (F.col("c_all") - c) / F.col("n_out")
    return g.select("gene", "celltype", "n_in", "n_out", mi.alias("mean_in"), mo.alias("mean_out"), (mi - mo).alias("mean_diff"), pi.alias("pct_in"), po.alias("pct_out"), (pi - po).alias("pct_diff"), F.log2((mi + 1e-9) / (mo + 1e-9)).alias("log2_fc"))


def mann_whitney(expr: DataFrame, obs: DataFrame, least: int | str = "auto") -> DataFrame:
    """One-sided (greater) U test of every group against the rest, for every gene, with tie and continuity correction.

    Only stored values are ranked: zeros (stored or not) are one tied block below them, in closed form.  Values
    are summed up by (gene, value) first, so equal values are one row however many entities hold them.
    """
    sizes = group_sizes(obs, least)
    n = obs.where("celltype is not null").agg(F.count(F.lit(1)).alias("n"))
    x = expr.where("value > 0").join(obs.where("celltype is not null").select("obs_id", "celltype"), "obs_id")
    by_value = x.groupBy("gene", "value", "celltype").agg(F.count(F.lit(1)).alias("k"))
    ties = by_value.groupBy("gene", "value").agg(F.sum("k").alias("t"))
    nnz = ties.groupBy("gene").agg(F.sum("t").alias("nnz"))
    below = F.coalesce(F.sum("t").over(W.partitionBy("gene").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("_b", below).join(nnz, "gene").crossJoin(F.broadcast(n)).withColumn("rank", F.col("n") - F.col("nnz") + F.col("_b") + (F.col("t") + 1) / 2.0)
    t, z = F.col("t").cast("double"), (F.col("n") - F.col("nnz")).cast("double")
    tie = ranked.groupBy("gene").agg((F.sum(t * t * t - t) + F.max(z * z * z - z)).alias("tie"), F.max("nnz").alias("nnz"), F.max("n").alias("n"))
    sums = by_value.join(ranked.select("gene", "value", "rank"), ["gene", "value"]).groupBy("gene", "celltype").agg(F.sum(F.col("k") * F.col("rank")).alias("r"), F.sum("k").alias("k"))
    g = tie.crossJoin(F.broadcast(sizes)).join(sums, ["gene", "celltype"], "left")
    k, r = F.coalesce("k", F.lit(0)), F.coalesce("r", F.lit(0.0))
    zero_rank = (F.col("n") - F.col("nnz") + 1) / 2.0
    n1, n2, nn = F.col("n_in").cast("double"), F.col("n_out").cast("double"), F.col("n").cast("double")
    u = r + (n1 - k) * zero_rank - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (nn + 1 - F.col("tie") / (nn * (nn - 1))))
    zz = F.try_divide(u - n1 * n2 / 2 - 0.5, sd)
    return g.select("gene", "celltype", u.alias("u"), "tie", zz.alias("z")).withColumn("pvalue", normal_sf("z"))


def classify(effect: DataFrame, tests: DataFrame, q: float = 0.05, diff: float = 0.0) -> DataFrame:
    """Effects with p, q (within the gene, over groups), whether enriched, and the gene's class: none, single, multi or pan."""
    j = benjamini_hochberg(effect.join(tests.select("gene", "celltype", "pvalue"), ["gene", "celltype"]), "pvalue", "qvalue", ["gene"], ["celltype"])
    j = j.withColumn("enriched", (F.col("qvalue") <= q) & (F.col("mean_diff") > diff))
    w = W.partitionBy("gene")
    k, n = F.sum(F.col("enriched").cast("int")).over(w), F.count(F.lit(1)).over(w)
    return j.withColumn("class", F.when(k == 0, "none").when(k == 1, "single").when(k == n, "pan").otherwise("multi"))


def specificity(effect: DataFrame) -> DataFrame:
    """0.2, 0.3, 0.5 mixture of the gene's z-scores of mean difference, share difference and fold change; best group, margin to the next, strong if it leads by 1."""
    z = effect
    for c in ("mean_diff", "pct_diff", "log2_fc"):
        z = z.withColumn(f"_{c}", zscore(c, ["gene"]))
    z = z.withColumn("score", 0.2 * F.col("_mean_diff") + 0.3 * F.col("_pct_diff") + 0.5 * F.col("_log2_fc"))
    order = W.partitionBy("gene").orderBy(F.desc("score"), "celltype")
    z = z.withColumn("margin", F.col("score") - F.lead("score").over(order)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return z.select("gene", "celltype", "score", "margin", (F.col("margin") >= 1).alias("strong"))


def permutation(expr: DataFrame, obs: DataFrame, group: str, n_perm: int, seed: int = 0) -> DataFrame:
    """Empirical p = (greater or equal + 1) / (n + 1) and z of the mean inside a group under random groups of its size.

    A permutation orders entities by a hash of (seed, permutation, id); the first ``n_in`` are in.  The cut is found
    from counts of hash ranges, so no task sorts a permutation of all entities.
    """
    n_in = obs.where(F.col("celltype") == group).count()
    perms = obs.select("obs_id", F.explode(F.sequence(F.lit(0), F.lit(n_perm))).alias("perm"))
    h = F.when((F.col("perm") == 0), F.lit(None)).otherwise(hashed_int(15, seed, "perm", "obs_id"))
    drawn = perms.where("perm > 0").withColumn("h", h).withColumn("bucket", F.shiftright("h", 50))
    counts = drawn.groupBy("perm", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("perm").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where(F.col("before") < n_in)
    place = F.row_number().over(W.partitionBy("perm", "bucket").orderBy("h", "obs_id")) + F.col("before")
    chosen = drawn.join(F.broadcast(counts), ["perm", "bucket"]).withColumn("place", place).where(F.col("place") <= n_in).select("perm", "obs_id")
    own = obs.where(F.col("celltype") == group).select(F.lit(0).alias("perm"), "obs_id")
    sums = chosen.unionByName(own).join(expr, "obs_id").groupBy("gene", "perm").agg((F.sum("value") / n_in).alias("m"))
    genes = expr.select("gene").distinct()
    grid = genes.crossJoin(F.broadcast(expr.sparkSession.range(n_perm + 1).select(F.col("id").cast("int").alias("perm"))))
    full = grid.join(sums, ["gene", "perm"], "left").withColumn("m", F.coalesce("m", F.lit(0.0)))
    seen = full.where("perm = 0").select("gene", F.col("m").alias("observed"))
    null = full.where("perm > 0").join(seen, "gene")
    # n_perm means of a gene, folded in ascending order: sums in order of arrival would differ in their last bits
    means = null.groupBy("gene", "observed").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, m: s + m)

    found = F.size(F.filter("ms", lambda m: m >= F.col("observed") - 1e-12))
    means = means.withColumn("mean", total(F.col("ms")) / n_perm)
    std = F.sqrt(total(F.transform("ms", lambda m: (m - F.col("mean")) * (m - F.col("mean")))) / n_perm)
    return means.select("gene", "observed", ((found + 1) / (n_perm + 1)).alias("pvalue"), F.try_divide(F.col("observed") - F.col("mean"), std).alias("z"))


def block_permutation(values: DataFrame, n_perm: int, seed: int = 0, statistic=None) -> DataFrame:
    """Two-sided p of the mean difference of labels (1 against 0), shuffled within blocks; the share of permutations at least as extreme, without + 1.

    ``statistic``: an aggregate column of ``value`` and ``label`` (default: difference of means).
    """
    stat = statistic if statistic is not None else F.avg(F.when(F.col("label") == 1, F.col("value"))) - F.avg(F.when(F.col("label") == 0, F.col("value")))
    observed = values.agg(stat.alias("observed"))
    # a value's place in its block is the same in every permutation; only labels are shuffled
    a = values.withColumn("_k", F.row_number().over(W.partitionBy("block").orderBy("obs_id"))).select("block", "_k", "value")
    p = values.select("block", "obs_id", "label", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"))
    order = W.partitionBy("perm", "block").orderBy(hashed(seed, "perm", "obs_id"), "obs_id")
    b = p.withColumn("_k", F.row_number().over(order)).select("perm", "block", "_k", "label")
    null = many(b).join(many(a), ["block", "_k"]).groupBy("perm").agg(stat.alias("null"))
    x = null.crossJoin(F.broadcast(observed))
    return x.agg(F.first("observed").alias("observed"), F.avg((F.abs("null") >= F.abs("observed") - 1e-12).cast("double")).alias("pvalue"), F.try_divide(F.first("observed") - F.avg("null"), F.stddev_pop("null")).alias("z"))


def fisher_combine(p: DataFrame, by: list[str]) -> DataFrame:
    """Fisher's combined p-value of each group: chi-squared with twice as many degrees of freedom as there are p-values, which has a closed form."""
    s = p.where("pvalue is not null").groupBy(*by).agg((-2 * F.sum(F.log(F.greatest("pvalue", F.lit(1e-300))))).alias("chi2"), F.count(F.lit(1)).alias("k"))
    return s.withColumn("pvalue", chi2_sf_even("chi2", "k"))


def over_representation(sets: DataFrame, terms: DataFrame, universe: int) -> DataFrame:
    """Overlap of every gene set with every term, expected overlap, fold, and the hypergeometric upper tail.

    ``sets``: grp, gene; ``terms``: database, term, gene.  The tail sums log-gamma terms inside one expression.
    """
    n_set = sets.groupBy("grp").agg(F.count_distinct("gene").alias("n_set"))
    n_term = terms.groupBy("database", "term").agg(F.count_distinct("gene").alias("n_term"))
    common = sets.join(terms, "gene").groupBy("grp", "database", "term").agg(F.count_distinct("gene").alias("overlap"), F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("genes"))
    x = common.join(F.broadcast(n_set), "grp").join(F.broadcast(n_term), ["database", "term"])
    x = x.withColumn("expected", F.col("n_set") * F.col("n_term") / F.lit(float(universe)))
    # P(X = k) by the ratio of neighbouring terms from the log of the first
    top = F.least("n_set", "n_term")
    logf = lambda m: F.aggregate(F.sequence(F.lit(0), F.greatest(m.cast("int"), F.lit(0))), F.lit(0.0), lambda a, i: a + F.when(i > 1, F.log(i.cast("double"))).otherwise(0.0))
    u, a, b = F.lit(universe), F.col("n_set"), F.col("n_term")

    def log_choose(n, k):
        return logf(n) - logf(k) - logf(n - k)

    def term(k):
        return F.exp(log_choose(b, k) + log_choose(u - b, a - k) - log_choose(u, a))

    tail = F.aggregate(F.sequence(F.col("overlap"), top), F.lit(0.0), lambda acc, k: acc + F.when(a - k <= u - b, term(k)).otherwise(0.0))
    return x.withColumn("fold", F.col("overlap") / F.col("expected")).withColumn("pvalue", F.least(tail, F.lit(1.0)))


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Paired signed-rank test by ``a - b``: positive rank sum, normal approximation with tie correction, two-sided p; zero differences go."""
    d = pairs.withColumn("d", F.col("a") - F.col("b")).where("d <> 0").withColumn("m", F.abs("d"))
    w = W.partitionBy(*by)
    r = F.rank().over(w.orderBy("m")) + (F.count(F.lit(1)).over(W.partitionBy(*by, "m")) - 1) / 2.0
    t = F.count(F.lit(1)).over(W.partitionBy(*by, "m")).cast("double")
    x = d.withColumn("r", r).withColumn("t", t)
    s = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum((F.col("t") * F.col("t") - 1)).alias("tie"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    return s.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, sd)).withColumn("pvalue", F.least(2 * normal_sf(F.abs("z")), F.lit(1.0)))


def by_scale_group(sets: DataFrame, effect: DataFrame) -> DataFrame:
    """Effects of each scale group's genes (``grp, gene``) against all other genes, for every entity group: number of genes, mean log2 fold change in and out of the set, their difference, and the share with a positive one."""
    n = F.count(F.lit(1))
    all_ = effect.groupBy("celltype").agg(F.sum("log2_fc").alias("_s"), n.alias("_n"))
    own = sets.select("grp", "gene").distinct().join(effect.select("gene", "celltype", "log2_fc"), "gene").groupBy("grp", "celltype").agg(n.alias("n"), F.sum("log2_fc").alias("s"), F.avg((F.col("log2_fc") > 0).cast("double")).alias("positive"))
    j = own.join(all_, "celltype")
    inside, outside = F.col("s") / F.col("n"), F.try_divide(F.col("_s") - F.col("s"), F.col("_n") - F.col("n"))
    return j.select("grp", "celltype", "n", inside.alias("mean_in"), outside.alias("mean_out"), (inside - outside).alias("difference"), "positive")


def sets_by_scale_group(sets: DataFrame, effect: DataFrame, moments: DataFrame, n_sets: int, bins: int, seed: int = 0) -> DataFrame:
    """Each scale group's gene set against expression-matched random sets, for every entity group: observed mean, empirical p, z.

    ``moments``: gene and mean.  Scale groups are few, so there is one plan for each.
    """
    out = None
    for (g,) in sets.select("grp").distinct().orderBy("grp").collect():
        own = sets.where(F.col("grp") == g).select("gene").distinct()
        seen = effect.join(own, "gene", "left_semi").groupBy("celltype").agg(F.avg("log2_fc").alias("observed"))
        null = matched_controls(moments, own, n_sets, bins, seed).join(effect.select("gene", "celltype", "log2_fc"), "gene").groupBy("control", "celltype").agg(F.avg("log2_fc").alias("v"))
        at_least = F.count(F.when(F.col("v") >= F.col("observed"), 1))
        one = null.join(seen, "celltype").groupBy("celltype").agg(F.first("observed").alias("observed"), ((at_least + 1) / (F.count(F.lit(1)) + 1)).alias("pvalue"), F.try_divide(F.first("observed") - F.avg("v"), F.stddev_pop("v")).alias("z"))
        one = one.select(F.lit(g).alias("grp"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def bootstrap(gene_scores: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """Mean of ``score`` by ``panel`` with 2.5 % and 97.5 % quantiles over resamples of its genes.

    A resample draws, for every slot of the panel, the gene at a hashed place: with replacement, the same for every partitioning.
    """
    w = W.partitionBy("panel")
    g = gene_scores.withColumn("k", F.row_number().over(w.orderBy("gene")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    slots = g.select("panel", F.col("k").alias("slot"), "n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot"))
    draws = slots.select("panel", "boot", F.pmod(hashed_int(12, seed, "panel", "boot", "slot"), F.col("n")).alias("k"))
    means = draws.join(g.select("panel", "k", "score"), ["panel", "k"]).groupBy("panel", "boot").agg(F.avg("score").alias("m"))
    ci = means.groupBy("panel").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return gene_scores.groupBy("panel").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")).join(ci, "panel")


def matched_controls(genes: DataFrame, panel: DataFrame, n_sets: int, bins: int, seed: int = 0) -> DataFrame:
    """Random sets of as many genes from the same expression bins as the panel: ``control, gene``.

    Bins are equal parts of the average-rank percentile of the mean; within a bin genes come in hashed order, those of the panel excluded.
    """
    from tessella.functions.stats import average_rank

    total = genes.agg(F.count(F.lit(1)).alias("_n"))
    ranked = genes.withColumn("_one", F.lit(1)).withColumn("_p", average_rank("mean", ["_one"])).crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("_p") / F.col("_n") * bins), F.lit(bins - 1)).cast("int"))
    need = ranked.join(panel.select("gene"), "gene", "left_semi").groupBy("bin").agg(F.count(F.lit(1)).alias("need"))
    pool = ranked.join(panel.select("gene"), "gene", "left_anti").select("gene", "bin", F.explode(F.sequence(F.lit(1), F.lit(n_sets))).alias("control"))
    w = W.partitionBy("control", "bin").orderBy(hashed(seed, "control", "gene"), "gene")
    return pool.withColumn("_r", F.row_number().over(w)).join(F.broadcast(need), "bin").where(F.col("_r") <= F.col("need")).select("control", "bin", "gene")
