"""Queries of composed operators: embeddings, evidence tables, sweeps, tiers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import stats as ST
from tessella.operators import compare, embed, enrich, equalize, graph, matrix, scale, segment, spatial
from tessella.sources.storage import cut

from . import views as V
from .core import _DIRECTED, _IMP, MORAN, _directed, _values, imputed, multiscale_moran_ranks
from .registry import query
from .summaries import _EFF, _GAIN, _VAL, EDGE_COLUMNS, _val, all_gains, block_sql, boot_sql, control_sql, edge_sql, rounded


@query("SELECT obs_id, x::DOUBLE AS x, y::DOUBLE AS y FROM obs WHERE obs_id % 10 <> 0")
def b1_b2_resolve_coordinates(spark, sf):
    o = V.obs(spark, sf)
    bad = o.select("obs_id", F.col("x").alias("array_col"), F.when(F.col("obs_id") % 10 == 0, "NaN").otherwise(F.col("y").cast("string")).alias("array_row"))
    return spatial.resolve_coordinates(bad).select("obs_id", "x", "y")


@query("SELECT obs_id, [0.2, 1.0, 10.0]::DOUBLE[]::VARCHAR AS c, CASE WHEN n <= 1 THEN 1.0 WHEN n <= 2 THEN 2.0 WHEN n <= 2.5 THEN 2.5 WHEN n <= 5 THEN 5.0 ELSE 10.0 END::DOUBLE AS nice FROM (SELECT obs_id, 1 + obs_id % 9 AS n FROM obs)")
def b14_b15_candidates(spark, sf):
    o = V.obs(spark, sf)
    c = S.clean_candidates(F.array(F.lit(1.0), F.lit(0.01), F.lit(1.0), F.lit(55.0)), 0.2, 10.0)
    text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: v.cast("string")), ", "), F.lit("]"))
    return o.select("obs_id", text.alias("c"), S.nice_at_least((1 + F.col("obs_id") % 9).cast("double")).alias("nice"))


@query("SELECT user_id, event_type AS \"Term\", value AS p_value, round(-log10(greatest(value / 1e4, 1e-300)), 6) AS score FROM events WHERE value > 0 ", base=False)
def b36_standard_frame(spark, sf):
    e = V.table(spark, sf, "events").where("value > 0")
    return e.select("user_id", F.col("event_type").alias("Term"), F.col("value").cast("string").try_cast("double").alias("p_value"), F.round(-F.log10(F.greatest(F.col("value") / 1e4, F.lit(1e-300))), 6).alias("score"))


@query(_IMP + ", lm AS (SELECT * FROM (VALUES (2, 'tiny'), (4, 'small'), (8, 'mid')) t(scale, label)) SELECT gene, coalesce(label, 'other') AS label, SUM(rank)::BIGINT AS rank FROM long LEFT JOIN lm USING (scale) WHERE scale <> 20 GROUP BY 1, 2")
def b37_d17_label_mapping(spark, sf):
    m = spark.createDataFrame([(2, "tiny"), (4, "small"), (8, "mid")], "scale long, label string")
    x = imputed(spark, sf).where("scale <> 20").join(F.broadcast(m), "scale", "left")
    return x.groupBy("gene", F.coalesce("label", F.lit("other")).alias("label")).agg(F.sum("rank").alias("rank"))


@query(", t AS (SELECT obs_id % 700 AS barcode, x, y, CASE WHEN obs_id % 13 <> 0 THEN bal END AS v FROM obs), e AS (SELECT obs_id AS barcode, batch AS d FROM obs) SELECT barcode, x, y, v, d FROM t RIGHT JOIN e USING (barcode) WHERE x IS NOT NULL AND v IS NOT NULL")
def d1_tiles_embedding(spark, sf):
    """Right outer join, then only complete rows."""
    o = V.obs(spark, sf)
    t = o.select((F.col("obs_id") % 700).alias("barcode"), "x", "y", F.when(F.col("obs_id") % 13 != 0, F.col("bal")).alias("v"))
    e = o.select(F.col("obs_id").alias("barcode"), F.col("batch").alias("d"))
    return t.join(e, "barcode", "right").dropna()


@query(MORAN + "SELECT gene, max(rank) FILTER (WHERE side = 2)::BIGINT AS r2, max(rank) FILTER (WHERE side = 5)::BIGINT AS r5, max(rank) FILTER (WHERE side = 20)::BIGINT AS r20 FROM ranked WHERE side IN (2, 5, 20) GROUP BY 1")
def d4_rank_outer_join(spark, sf):
    r = cut(multiscale_moran_ranks(spark, sf), "ranks")
    out = None
    for s in (2, 5, 20):
        one = r.where(F.col("side") == s).select("gene", F.col("rank").alias(f"r{s}"))
        out = one if out is None else out.join(one, "gene", "full_outer")
    return out


@query("SELECT batch AS seg, bal % 3 >= 1 AS b, round(AVG(x), 7) AS x, round(AVG(y), 7) AS y, COUNT(*) AS n FROM obs GROUP BY 1, 2")
def e7_mean_rows(spark, sf):
    o = V.obs(spark, sf)
    return o.groupBy(F.col("batch").alias("seg"), (F.col("bal") % 3 >= 1).alias("b")).agg(F.round(F.avg("x"), 7).alias("x"), F.round(F.avg("y"), 7).alias("y"), F.count(F.lit(1)).alias("n"))


_LONG3 = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM gains" for m in ("gain_r2", "gain_snr"))


@query(_GAIN + f", l AS ({_LONG3}) SELECT metric, COUNT(v) AS n, round(AVG(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(AVG((v > 0)::INT), 6) AS positive, round(AVG((v <> 0)::INT), 6) AS nonzero, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM l WHERE v IS NOT NULL GROUP BY 1")
def e15_comparison_table(spark, sf):
    return rounded(compare.tidy_summary(all_gains(spark, sf).select("gain_r2", "gain_snr"), [], ["gain_r2", "gain_snr"]))


@query(
    _GAIN
    + """, d AS (SELECT gene, CASE WHEN gain_r2 > 0 AND gain_snr > 0 THEN 'both' WHEN gain_r2 > 0 THEN 'r2' ELSE 'none' END AS driver, gain_r2 FROM gains)
SELECT driver, COUNT(*) AS n, round(COUNT(*) / (SELECT COUNT(*) FROM d), 6) AS share, round(median(gain_r2), 6) AS median, arg_max(gene, (gain_r2, gene)) AS example FROM d GROUP BY 1"""
)
def e22_e24_category_summary(spark, sf):
    g = all_gains(spark, sf)
    d = g.select("gene", F.when((F.col("gain_r2") > 0) & (F.col("gain_snr") > 0), "both").when(F.col("gain_r2") > 0, "r2").otherwise("none").alias("driver"), "gain_r2")
    total = d.agg(F.count(F.lit(1)).alias("t"))
    s = d.groupBy("driver").agg(F.count(F.lit(1)).alias("n"), ST.quantile("gain_r2", 0.5).alias("median"), F.max_by("gene", F.struct("gain_r2", "gene")).alias("example"))
    return rounded(s.crossJoin(F.broadcast(total)).select("driver", "n", (F.col("n") / F.col("t")).alias("share"), "median", "example"))


@query(_GAIN + ", l AS (SELECT 'r2' AS metric, gain_r2 AS v FROM gains UNION ALL SELECT 'detection', gain_detection FROM gains) SELECT metric, round(median(v), 6) AS median, round(AVG(v), 6) AS mean, round(AVG((v > 0)::INT), 6) AS positive FROM l GROUP BY 1")
def e23_reason_summary(spark, sf):
    long = all_gains(spark, sf).select(F.col("gain_r2").alias("r2"), F.col("gain_detection").alias("detection")).unpivot([], ["r2", "detection"], "metric", "v")
    return rounded(long.groupBy("metric").agg(ST.quantile("v", 0.5).alias("median"), F.avg("v").alias("mean"), F.avg((F.col("v") > 0).cast("double")).alias("positive")))


@query(_IMP + ", t AS (SELECT gene, scale, score, CASE WHEN scale IN (2, 20) OR scale BETWEEN 4 AND 5 THEN 'fine' ELSE 'coarse' END AS grp FROM long) SELECT gene, grp, round(AVG(score), 6) AS score, COUNT(*) AS n FROM t GROUP BY 1, 2")
def f6_f14_tier_override(spark, sf):
    """Groups by range, then native and selected scales moved to the fine tier."""
    x = imputed(spark, sf)
    base = scale.group_of_scale(F.col("scale"), {"fine": (0, 5), "coarse": (5.5, 100)})
    chosen = F.exists(F.array(F.lit(2.0), F.lit(20.0)), lambda v: ST.is_close(F.col("scale").cast("double"), v, 1e-4))
    return rounded(x.withColumn("grp", F.when(chosen, "fine").otherwise(base)).groupBy("gene", "grp").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")))


@query(MORAN + "SELECT gene, side AS scale, rank::BIGINT AS rank, CASE WHEN side <= 5 THEN 'fine' ELSE 'coarse' END AS grp FROM ranked WHERE side IN (2, 10)")
def f15_wide_to_long(spark, sf):
    r = cut(multiscale_moran_ranks(spark, sf), "ranks")
    wide = r.groupBy("gene").pivot("side", [2, 10]).agg(F.first("rank"))
    long = wide.unpivot("gene", ["2", "10"], "scale", "rank").where("rank is not null").withColumn("scale", F.col("scale").cast("long"))
    g = scale.group_of_scale(F.col("scale"), {"fine": (0, 5), "coarse": (6, 100)})
    return long.select("gene", "scale", "rank", F.when(g.isNull(), F.raise_error(F.lit("scale without group"))).otherwise(g).alias("grp"))


@query(_IMP + """, a AS (SELECT gene, scale, rank AS ra, rank() OVER (PARTITION BY scale ORDER BY score, gene) AS rb FROM long)
SELECT gene, scale, ra, rb, abs(ra - rb) AS gap FROM a WHERE scale = 5 ORDER BY abs(ra - rb) DESC, ra, gene LIMIT 6""")
def g2_top_discordant(spark, sf):
    x = imputed(spark, sf).where("scale = 5")
    x = x.withColumn("rb", F.rank().over(W.partitionBy("scale").orderBy("score", "gene")).cast("long"))
    return x.select("gene", "scale", F.col("rank").alias("ra"), "rb", F.abs(F.col("rank") - F.col("rb")).alias("gap")).orderBy(F.desc("gap"), "ra", "gene").limit(6)


@query(None)
def j8_principal_components(spark, sf):
    x = cut(matrix.log1p(matrix.normalize_total(V.expr(spark, sf), ["obs_id"])), "norm")
    scores, _ = embed.components(x, V.obs(spark, sf).count(), 3)
    return rounded(scores)


@query(None)
def j11_latent_semantic(spark, sf):
    return rounded(embed.latent_semantic(cut(V.expr(spark, sf), "expr"), V.obs(spark, sf).count(), 3))


@query(None)
def j9_non_negative_factors(spark, sf):
    return embed.non_negative(V.expr(spark, sf), 3)


_UNIT = ", one AS (SELECT obs_id, round(bal / 7, 0) AS value FROM obs), u0 AS (SELECT obs_id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM one)"
_CAND = ", u1 AS (SELECT obs_id, (bal - min(bal) OVER ()) / (max(bal) OVER () - min(bal) OVER ()) AS value FROM obs), dir AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"


def _smoothed(name: str, sigma: float) -> str:
    w = f"exp(-1 / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE))"
    return f", {name} AS (SELECT obs_id, SUM(value * w) / SUM(w) AS value FROM (SELECT obs_id, value, 1.0::DOUBLE AS w FROM u1 UNION ALL SELECT src, value, {w} FROM dir JOIN u1 ON obs_id = dst) GROUP BY 1)"


_SWEEP = _CAND + "".join(_smoothed(f"g{i}", s) + edge_sql("u1", f"g{i}", f"e{i}") for i, s in enumerate((0.5, 1.0, 2.0)))


@query(_SWEEP + ", sw AS (" + " UNION ALL ".join(f"SELECT *, {s}::DOUBLE AS sigma FROM e{i}" for i, s in enumerate((0.5, 1.0, 2.0))) + ") SELECT " + EDGE_COLUMNS + ", sigma, row_number() OVER (ORDER BY structure DESC, sigma) = 1 AS selected FROM sw")
def j26_g6_smoothing_sweep(spark, sf):
    """Candidates of the Gaussian smoother with their edge scores; the best one flagged."""
    v, e = cut(_values(spark, sf).withColumn("value", ST.minmax("value", ["dim"])), "values"), cut(_directed(spark, sf), "edges")
    out = None
    for sigma in (0.5, 1.0, 2.0):
        one = equalize.edge_scores(v, graph.smooth(v, e, sigma), V.edges(spark, sf)).withColumn("sigma", F.lit(sigma))
        out = one if out is None else out.unionByName(one)
    best = F.row_number().over(W.orderBy(F.desc("structure"), "sigma")) == 1  # a row for each candidate
    return rounded(out.withColumn("selected", best))


_SCALED = "(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())"
_KINDS = {
    "balance": f"SELECT obs_id, {_SCALED} AS value FROM (SELECT obs_id, least(greatest(value, lo), hi) AS v FROM one CROSS JOIN (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM one))",
    "ecdf": "SELECT obs_id, cume_dist() OVER (ORDER BY value) AS value FROM one",
    "histogram": "SELECT obs_id, cume_dist() OVER (ORDER BY b) AS value FROM (SELECT obs_id, least(floor((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 256), 255) AS b FROM one)",
    "perceptual": f"SELECT obs_id, {_SCALED} AS value FROM (SELECT obs_id, z / (1 + 0.5 * abs(z)) AS v FROM (SELECT obs_id, (value - AVG(value) OVER ()) / stddev_pop(value) OVER () AS z FROM one))",
}


@query(_UNIT + "".join(f", {k} AS ({s})" + edge_sql("u0", k, f"e_{k}") for k, s in _KINDS.items()) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT {EDGE_COLUMNS}, '{k}' AS method FROM e_{k}" for k in _KINDS) + ")")
def j27_equalisation_sweep(spark, sf):
    v = cut(_val(spark, sf).withColumn("dim", F.lit(0)), "values")
    before = v.withColumn("value", ST.minmax("value", ["dim"]))
    kinds = {"balance": equalize.balance(v, 0.02, 0.02), "ecdf": equalize.ecdf(v), "histogram": equalize.histogram(v), "perceptual": equalize.perceptual(v, 0.5)}
    out = None
    for name, after in kinds.items():
        one = equalize.edge_scores(before, after, V.edges(spark, sf)).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(_DIRECTED + ", c AS (SELECT obs_id, x // 3 AS i, y // 3 AS j FROM obs), b AS (SELECT i, j, AVG(value) AS v FROM c JOIN val USING (obs_id) GROUP BY 1, 2), s AS (SELECT a.i, a.j, AVG(b.v) AS v FROM b a JOIN b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2) SELECT obs_id, round(v, 6) AS value FROM c JOIN s USING (i, j)")
def j25_coarse_smooth(spark, sf):
    """Approximate smoothing: means of coarse bins, smoothed over their neighbours, joined back."""
    o = V.obs(spark, sf).select("obs_id", F.floor(F.col("x") / 3).alias("i"), F.floor(F.col("y") / 3).alias("j"), "bal")
    bins = cut(o.groupBy("i", "j").agg(F.avg("bal").alias("v")), "bins")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = bins.withColumn("_s", step).select((F.col("i") + F.col("_s.a")).alias("i"), (F.col("j") + F.col("_s.b")).alias("j"), "v")
    smooth = near.groupBy("i", "j").agg(F.avg("v").alias("v"))
    return o.join(smooth, ["i", "j"]).select("obs_id", F.round("v", 6).alias("value"))


@query(
    _EFF
    + control_sql("Brand#2%", 200, 3, "AVG")
    + """, fc AS (SELECT gene, log2((mean_in + 1e-9) / (mean_out + 1e-9)) AS fc FROM eff WHERE celltype = 'BUILDING'), ob AS (SELECT AVG(fc) AS observed FROM fc WHERE gene LIKE 'Brand#2%'), nu AS (SELECT control, AVG(fc) AS v FROM controls JOIN fc USING (gene) GROUP BY 1)
SELECT round(any_value(observed), 6) AS observed, round((COUNT(*) FILTER (WHERE v >= observed) + 1) / (COUNT(*) + 1), 6) AS p_right, round((COUNT(*) FILTER (WHERE v <= observed) + 1) / (COUNT(*) + 1), 6) AS p_left, round((any_value(observed) - AVG(v)) / stddev_pop(v), 5) AS z FROM nu CROSS JOIN ob"""
)
def k5_k9_gene_set_test(spark, sf):
    """A gene set's mean group effect against expression-matched random sets: empirical p and z."""
    x, o = cut(V.expr(spark, sf), "expr"), V.obs(spark, sf)
    m = matrix.gene_moments(x, o.count())
    eff = cut(enrich.effects(x, o).where("celltype = 'BUILDING'").select("gene", "log2_fc"), "effects")
    panel = m.where("gene like 'Brand#2%'").select("gene")
    seen = eff.join(panel, "gene", "left_semi").agg(F.avg("log2_fc").alias("observed"))
    null = enrich.matched_controls(m, panel, 200, 3).join(eff, "gene").groupBy("control").agg(F.avg("log2_fc").alias("v")).crossJoin(F.broadcast(seen))
    out = null.agg(F.first("observed").alias("observed"), ((F.count_if(F.col("v") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_right"), ((F.count_if(F.col("v") <= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_left"), F.round(F.try_divide(F.first("observed") - F.avg("v"), F.stddev_pop("v")), 5).alias("z"))
    return rounded(out)


@query(
    boot_sql("COUNT(*) FILTER (WHERE value > 0)", 100)
    + control_sql("Brand#1%", 50, 2, "COUNT")
    + """, cv AS (SELECT control, AVG(g.score) AS v FROM controls JOIN g USING (gene) GROUP BY 1), cs AS (SELECT AVG(v) AS control, stddev_pop(v) AS control_sd FROM cv)
SELECT panel, round(mean, 6) AS mean, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(control, 6) AS control, round(control_sd, 6) AS control_sd, (mean > control)::INT + (lo > control)::INT + (mean > control + control_sd)::INT AS evidence FROM booted CROSS JOIN cs"""
)
def k10_d19_evidence(spark, sf):
    """Observed panel means joined with their bootstrap and matched controls, and how many of three checks hold."""
    o = V.obs(spark, sf)
    m = cut(matrix.gene_moments(V.expr(spark, sf), o.count()), "moments")
    scores = m.select(F.substring("gene", 1, 7).alias("panel"), "gene", F.col("detection").alias("score"))
    boot = enrich.bootstrap(scores, 100)
    c = enrich.matched_controls(m, m.where("gene like 'Brand#1%'").select("gene"), 50, 2).join(m.select("gene", "detection"), "gene").groupBy("control").agg(F.avg("detection").alias("v"))
    control = c.agg(F.avg("v").alias("control"), F.stddev_pop("v").alias("control_sd"))
    x = boot.crossJoin(F.broadcast(control))
    flags = (F.col("mean") > F.col("control")).cast("int") + (F.col("lo") > F.col("control")).cast("int") + (F.col("mean") > F.col("control") + F.col("control_sd")).cast("int")
    return rounded(x.withColumn("evidence", flags))


@query(", k AS (SELECT batch % 3 AS lib, obs_id, (x // 8) AS seg FROM obs) SELECT lib || '_' || seg AS label, COUNT(*) AS n FROM k GROUP BY 1")
def j19_library_labels(spark, sf):
    o = V.obs(spark, sf).select((F.col("batch") % 3).alias("lib"), F.floor(F.col("x") / 8).alias("seg"))
    return o.groupBy(segment.concat_labels(o, "lib", "seg").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(", d AS (SELECT obs_id, list_sort([x % 7, y % 5, obs_id % 11]) AS v FROM obs) SELECT obs_id, v[3] AS top, v[2] AS second FROM d")
def i_array_functions(spark, sf):
    o = V.obs(spark, sf)
    v = F.sort_array(F.array(F.col("x") % 7, F.col("y") % 5, F.col("obs_id") % 11), asc=False)
    return o.select("obs_id", v[0].alias("top"), v[1].alias("second"))


@query(_VAL + ", r AS (SELECT obs_id, value / (SELECT max(abs(value)) FROM val) AS v FROM val) SELECT obs_id, round(power(abs(v), 0.8), 9) AS g, sign(v)::DOUBLE AS s FROM r")
def b10_gamma(spark, sf):
    v = _val(spark, sf)
    m = v.agg(F.max(F.abs("value")).alias("m"))
    return v.crossJoin(F.broadcast(m)).select("obs_id", F.round(S.gamma(F.abs(F.col("value") / F.col("m")), 0.8), 9).alias("g"), F.round(F.signum(F.col("value") / F.col("m")), 1).alias("s"))


@query(block_sql(50, "median(value) FILTER (WHERE label = 1) - median(value) FILTER (WHERE label = 0)"))
def k11_m1_custom_statistic(spark, sf):
    """A statistic of the caller's: the difference of medians."""
    v = V.obs(spark, sf).select("obs_id", F.col("bal").alias("value"), (F.col("celltype") == "BUILDING").cast("int").alias("label"), F.col("batch").alias("block"))
    stat = F.median(F.when(F.col("label") == 1, F.col("value"))) - F.median(F.when(F.col("label") == 0, F.col("value")))
    return rounded(enrich.block_permutation(v, 50, statistic=stat), 5)
