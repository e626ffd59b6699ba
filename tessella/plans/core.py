"""Queries of the Moran family and the matrix operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import autocorr, graph, matrix, scale, spatial
from tessella.sources.storage import cut

from . import views as V
from .registry import query

#: Bulk at all sides, weights and Moran sums, as SQL that continues the views.
MORAN = """, raw AS (SELECT s.side, s.seg, e.gene, SUM(e.value) AS v FROM expr e JOIN segments s USING (obs_id) GROUP BY 1, 2, 3),
bulk AS (SELECT side, seg, gene, ln(1 + v * 1e4 / SUM(v) OVER (PARTITION BY side, seg)) AS x FROM raw),
half AS (SELECT a.side, least(a.seg, b.seg) AS p, greatest(a.seg, b.seg) AS q, SUM(weight) AS w FROM edges e
  JOIN segments a ON a.obs_id = e.src JOIN segments b ON b.obs_id = e.dst AND b.side = a.side WHERE a.seg <> b.seg GROUP BY 1, 2, 3),
sym AS (SELECT side, p AS i, q AS j, w FROM half UNION ALL SELECT side, q, p, w FROM half),
wt AS (SELECT side, i, j, w / SUM(w) OVER (PARTITION BY side, i) AS w FROM sym),
nseg AS (SELECT side, COUNT(DISTINCT seg)::DOUBLE AS n FROM segments GROUP BY 1),
rr AS (SELECT side, i AS seg, SUM(w) AS r FROM wt GROUP BY 1, 2), cc AS (SELECT side, j AS seg, SUM(w) AS c FROM wt GROUP BY 1, 2),
s0 AS (SELECT side, SUM(w) AS s0 FROM wt GROUP BY 1),
m AS (SELECT b.side, b.gene, SUM(x) AS sx, SUM(x * x) AS sxx, SUM(x * coalesce(r, 0)) AS sxr, SUM(x * coalesce(c, 0)) AS sxc,
        SUM(x * x * (coalesce(r, 0) + coalesce(c, 0))) AS sxxrc
      FROM bulk b LEFT JOIN rr ON rr.side = b.side AND rr.seg = b.seg LEFT JOIN cc ON cc.side = b.side AND cc.seg = b.seg GROUP BY 1, 2),
xx AS (SELECT a.side, a.gene, SUM(w.w * a.x * b.x) AS s1 FROM bulk a JOIN wt w ON w.side = a.side AND w.i = a.seg
       JOIN bulk b ON b.side = w.side AND b.seg = w.j AND b.gene = a.gene GROUP BY 1, 2),
sc AS (SELECT m.side, m.gene,
   CASE WHEN sxx - sx * sx / n > 1e-9 * sxx THEN n / s0 * (coalesce(s1, 0) - sx / n * (sxr + sxc) + sx / n * sx / n * s0) / (sxx - sx * sx / n) END AS moran,
   CASE WHEN sxx - sx * sx / n > 1e-9 * sxx THEN (n - 1) / (2 * s0) * (sxxrc - 2 * coalesce(s1, 0)) / (sxx - sx * sx / n) END AS geary
  FROM m LEFT JOIN xx USING (side, gene) JOIN nseg USING (side) JOIN s0 USING (side)),
ranked AS (SELECT side, gene, moran, rank() OVER (PARTITION BY side ORDER BY moran DESC) AS rank FROM sc WHERE moran > 0)
"""


def scored(spark, sf):
    x = cut(autocorr.bulk_at_scales(V.expr(spark, sf), V.segments(spark, sf), ["side"]), "bulk")
    seg = V.segments(spark, sf)
    w = cut(graph.transform_weights(graph.collapse(V.edges(spark, sf), seg, ["side"]).select("side", "i", "j", "weight"), "R", ["side"]), "weights")
    return autocorr.moran(x, w, seg.groupBy("side").agg(F.count_distinct("seg").alias("n")), ["side"])


@query(MORAN + "SELECT side, gene, round(moran, 6) AS moran, rank::BIGINT AS rank FROM ranked")
def multiscale_moran_ranks(spark, sf):
    """Flagship: J3, J4 (B16, E1, C4, B4, B5, J7, E3, J5, J1, C5, F1) at six scales in one job."""
    r = autocorr.multiscale(V.expr(spark, sf), V.segments(spark, sf), V.edges(spark, sf), ["side"])
    return r.select("side", "gene", F.round("moran", 6).alias("moran"), F.col("rank").cast("long").alias("rank"))


@query(MORAN + "SELECT side, gene, round(geary, 6) AS geary, rank() OVER (PARTITION BY side ORDER BY geary)::BIGINT AS rank FROM sc WHERE geary IS NOT NULL")
def j2_geary_ranks(spark, sf):
    r = autocorr.ranks(scored(spark, sf), ["side"], "geary", None)
    return r.select("side", "gene", F.round("geary", 6).alias("geary"), F.col("rank").cast("long").alias("rank"))


@query(
    MORAN.replace("bulk AS (SELECT", "bulk0 AS (SELECT")
    + """, z AS (SELECT side, seg, ln(1 + COUNT(*)) AS z FROM segments GROUP BY 1, 2),
dense AS (SELECT z.side, z.seg, g.gene, z.z, coalesce(b.x, 0) AS x FROM z JOIN (SELECT DISTINCT side, gene FROM bulk0) g USING (side) LEFT JOIN bulk0 b ON b.side = z.side AND b.seg = z.seg AND b.gene = g.gene),
co AS (SELECT side, gene, COUNT(*) AS n, SUM(z) AS z1, SUM(z * z) AS z2, SUM(x) AS x1, SUM(z * x) AS zx FROM dense GROUP BY 1, 2),
be AS (SELECT *, CASE WHEN abs(n * z2 - z1 * z1) > 1e-12 THEN (n * zx - z1 * x1) / (n * z2 - z1 * z1) END AS b FROM co)
SELECT d.side, d.gene, round(SUM(abs(CASE WHEN b IS NULL THEN d.x ELSE d.x - (x1 - b * z1) / n - b * d.z END)), 4) AS total FROM dense d JOIN be USING (side, gene) GROUP BY 1, 2""".replace("bulk ", "bulk0 ")
)
def j1_residual_bulk(spark, sf):
    """Residuals of every gene on the log segment size."""
    seg = V.segments(spark, sf)
    x = cut(autocorr.bulk_at_scales(V.expr(spark, sf), seg, ["side"]), "bulk")
    z = seg.groupBy("side", "seg").agg(F.log(1 + F.count(F.lit(1))).alias("z"))
    r = autocorr.residualise(x, z, None, ["side"])
    return r.groupBy("side", "gene").agg(F.round(F.sum(F.abs("value")), 4).alias("total"))


@query(", s AS (SELECT seg, obs_id FROM segments WHERE side = 5) SELECT seg, gene, round(SUM(value), 6) AS total FROM expr JOIN s USING (obs_id) GROUP BY 1, 2")
def e1_pseudo_bulk_sum(spark, sf):
    x = matrix.pseudo_bulk(V.expr(spark, sf), V.segments(spark, sf, (5,)), ["seg"])
    return x.select("seg", "gene", F.round("value", 6).alias("total"))


@query(", s AS (SELECT seg, obs_id FROM segments WHERE side = 5), n AS (SELECT seg, COUNT(*) AS n FROM s GROUP BY 1) SELECT seg, gene, round(SUM(value) / any_value(n), 6) AS mean FROM expr JOIN s USING (obs_id) JOIN n USING (seg) GROUP BY 1, 2")
def e1_pseudo_bulk_mean(spark, sf):
    x = matrix.pseudo_bulk(V.expr(spark, sf), V.segments(spark, sf, (5,)), ["seg"], mean=True)
    return x.select("seg", "gene", F.round("value", 6).alias("mean"))


@query("SELECT obs_id, gene, round(ln(1 + value * 1e4 / SUM(value) OVER (PARTITION BY obs_id)), 6) AS value FROM expr")
def b4_b5_log_normalize(spark, sf):
    return matrix.log1p(matrix.normalize_total(V.expr(spark, sf), ["obs_id"])).select("obs_id", "gene", F.round("value", 6).alias("value"))


@query(""", d AS (SELECT gene, COUNT(*) AS df FROM expr WHERE value <> 0 GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM obs)
SELECT obs_id, gene, round(value / SUM(value) OVER (PARTITION BY obs_id) * ln(1 + n / (1 + df)), 6) AS value FROM expr JOIN d USING (gene) CROSS JOIN n""")
def b6_tf_idf(spark, sf):
    return matrix.tf_idf(V.expr(spark, sf), V.obs(spark, sf).count()).select("obs_id", "gene", F.round("value", 6).alias("value"))


@query(""", n AS (SELECT COUNT(*)::DOUBLE AS n FROM obs), m AS (SELECT gene, SUM(value * value) / any_value(n) - (SUM(value) / any_value(n)) ** 2 AS v FROM expr CROSS JOIN n GROUP BY 1)
SELECT gene, round(v, 5) AS variance FROM m WHERE v >= (SELECT quantile_cont(v, 0.6) FROM m)""")
def b7_variable_features(spark, sf):
    return matrix.variable_features(V.expr(spark, sf), V.obs(spark, sf).count(), 0.6).select("gene", F.round("variance", 5).alias("variance"))


@query(""", n AS (SELECT COUNT(*)::DOUBLE AS n FROM obs) SELECT gene, round(SUM(value) / any_value(n), 6) AS mean, round(COUNT(*) FILTER (WHERE value > 0) / any_value(n), 6) AS detection FROM expr CROSS JOIN n GROUP BY 1""")
def e20_gene_stats(spark, sf):
    m = matrix.gene_moments(V.expr(spark, sf), V.obs(spark, sf).count())
    return m.select("gene", F.round("mean", 6).alias("mean"), F.round("detection", 6).alias("detection"))


@query(""", n AS (SELECT COUNT(*)::DOUBLE AS n FROM obs) SELECT gene FROM expr CROSS JOIN n GROUP BY 1 HAVING COUNT(*) FILTER (WHERE value > 0) / any_value(n) >= 0.3""")
def c14_min_detection(spark, sf):
    m = matrix.gene_moments(V.expr(spark, sf), V.obs(spark, sf).count())
    return m.where("detection >= 0.3").select("gene")


@query(""", s AS (SELECT seg, obs_id FROM segments WHERE side = 4), b AS (SELECT seg, gene, SUM(value) AS v FROM expr JOIN s USING (obs_id) GROUP BY 1, 2)
SELECT gene, COUNT(*) AS n FROM b WHERE v <> 0 GROUP BY 1 HAVING COUNT(*) >= 60""")
def c4_gene_filter(spark, sf):
    x = matrix.gene_filter(matrix.pseudo_bulk(V.expr(spark, sf), V.segments(spark, sf, (4,)), ["seg"]), ["seg"], 60)
    return x.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query(""", n AS (SELECT COUNT(*)::DOUBLE AS n FROM obs), m AS (SELECT gene, SUM(value) / any_value(n) AS mean, SUM(value * value) / any_value(n) - (SUM(value) / any_value(n)) ** 2 AS v FROM expr CROSS JOIN n GROUP BY 1),
b AS (SELECT *, v / mean AS d, floor((row_number() OVER (ORDER BY mean, gene) - 1) * 5.0 / COUNT(*) OVER ())::INT AS bin FROM m),
s AS (SELECT *, coalesce((d - AVG(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0), 0) AS score FROM b)
SELECT gene, bin, round(score, 5) AS score FROM s QUALIFY row_number() OVER (ORDER BY score DESC, gene) <= 10""")
def g8_highly_variable(spark, sf):
    h = matrix.highly_variable(V.expr(spark, sf), V.obs(spark, sf).count(), 10)
    return h.select("gene", "bin", F.round("score", 5).alias("score"))


@query("""SELECT o.obs_id, round(coalesce(SUM(value) FILTER (WHERE gene IN ('Brand#11', 'Brand#22', 'Brand#33')), 0) / 3, 6) AS score FROM obs o LEFT JOIN expr USING (obs_id) GROUP BY 1""")
def b38_gene_score(spark, sf):
    s = matrix.gene_score(V.expr(spark, sf), ["Brand#11", "Brand#22", "Brand#33"], V.obs(spark, sf))
    return s.select("obs_id", F.round("score", 6).alias("score"))


@query(""", t AS (SELECT obs_id, SUM(value) FILTER (WHERE gene IN ('Brand#11', 'Brand#22')) AS p, SUM(value) AS t FROM expr GROUP BY 1)
SELECT s.obs_id, s.seg, round(ln(1 + AVG(coalesce(p / t, 0)) OVER (PARTITION BY s.seg)), 6) AS value FROM segments s LEFT JOIN t USING (obs_id) WHERE side = 8""")
def b39_expression_embedding(spark, sf):
    e = matrix.expression_embedding(V.expr(spark, sf), ["Brand#11", "Brand#22"], V.segments(spark, sf, (8,)).select("obs_id", "seg"))
    return e.select("obs_id", "seg", F.round("value", 6).alias("value"))


@query(""", g AS (SELECT DISTINCT gene FROM expr) SELECT gene FROM g WHERE gene NOT IN ('Brand#11', 'Brand#22', 'Brand#33')""")
def a17_background_genes(spark, sf):
    chosen = spark.createDataFrame([("Brand#11",), ("Brand#22",), ("Brand#33",)], "gene string")
    return matrix.background_genes(V.expr(spark, sf), chosen)


@query("SELECT obs_id, value FROM expr WHERE gene = 'Brand#23'")
def a16_gene_vector(spark, sf):
    return V.expr(spark, sf).where("gene = 'Brand#23'").select("obs_id", "value")


@query(""", l AS (SELECT DISTINCT gene, ('0x' || substr(md5(gene), 1, 4))::INT % 7 - 3 AS loading FROM expr) SELECT obs_id, 'PC1' AS pc, SUM(abs(loading))::DOUBLE AS value FROM expr JOIN l USING (gene) WHERE value > 0 GROUP BY 1""")
def j12_loading_embedding(spark, sf):
    x = V.expr(spark, sf)
    load = x.select("gene").distinct().select("gene", F.lit("PC1").alias("pc"), (F.conv(F.substring(F.md5(F.col("gene").cast("binary")), 1, 4), 16, 10).cast("int") % 7 - 3).alias("loading"))
    return matrix.loading_embedding(x, load).select("obs_id", "pc", F.col("value").cast("double").alias("value"))


# graphs


@query("SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight FROM edges")
def j7_lattice_edges(spark, sf):
    return V.edges(spark, sf).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")


@query(MORAN + "SELECT side, i, j, w AS weight, w AS n FROM sym")
def e3_collapsed_graph(spark, sf):
    g = graph.collapse(V.edges(spark, sf), V.segments(spark, sf), ["side"])
    return g.select("side", "i", "j", "weight", F.col("n").cast("double").alias("n"))


@query(""", e AS (SELECT src, dst, (src % 7 + 1)::DOUBLE AS d FROM edges), s AS (SELECT obs_id, seg FROM segments WHERE side = 5)
SELECT least(a.seg, b.seg) AS i, greatest(a.seg, b.seg) AS j, round(AVG(d), 6) AS mean FROM e JOIN s a ON a.obs_id = src JOIN s b ON b.obs_id = dst WHERE a.seg <> b.seg GROUP BY 1, 2""")
def e4_mean_distance(spark, sf):
    e = V.edges(spark, sf).select("src", "dst", (F.col("src") % 7 + 1).cast("double").alias("weight"))
    g = graph.collapse(e, V.segments(spark, sf, (5,)).select("obs_id", "seg")).where("i < j")
    return g.select("i", "j", F.round("mean", 6).alias("mean"))


@query(""", d AS (SELECT src AS i, dst AS j, ((src * 31 + dst * 17) % 11 + 1)::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, ((src * 31 + dst * 17) % 11 + 1)::DOUBLE FROM edges)
SELECT i, j, w AS weight FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY w DESC, j) <= 2""")
def g3_top_neighbours(spark, sf):
    e = V.edges(spark, sf).withColumn("weight", ((F.col("src") * 31 + F.col("dst") * 17) % 11 + 1).cast("double"))
    u = graph.undirected(e).select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight")
    return graph.top_neighbours(u, 2)


@query(""", e AS (SELECT src, dst, ((src + dst) % 5)::DOUBLE AS w FROM edges UNION ALL SELECT dst, src, ((src * dst) % 5)::DOUBLE FROM edges)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS weight FROM e GROUP BY 1, 2""")
def d7_symmetrise_max(spark, sf):
    e = V.edges(spark, sf)
    a = e.withColumn("weight", ((F.col("src") + F.col("dst")) % 5).cast("double"))
    b = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), ((F.col("src") * F.col("dst")) % 5).cast("double").alias("weight"))
    return graph.symmetrise_max(a.unionByName(b))


@query(MORAN + "SELECT 'R' AS how, side, round(SUM(w * w), 6) AS s FROM wt GROUP BY 2 UNION ALL SELECT 'B', side, COUNT(*)::DOUBLE FROM sym GROUP BY 2 UNION ALL SELECT 'D', side, round(SUM((w / t) ** 2), 6) FROM (SELECT side, w, SUM(w) OVER (PARTITION BY side) AS t FROM sym) GROUP BY 2")
def j5_weight_transforms(spark, sf):
    w = cut(graph.collapse(V.edges(spark, sf), V.segments(spark, sf), ["side"]).select("side", "i", "j", "weight"), "w")
    out = None
    for how in ("R", "B", "D"):
        one = graph.transform_weights(w, how, ["side"]).groupBy("side").agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("s")).select(F.lit(how).alias("how"), "side", "s")
        out = one if out is None else out.unionByName(one)
    return out


_DIRECTED = ", dir AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), val AS (SELECT obs_id, 0 AS dim, bal AS value FROM obs)"


def _values(spark, sf):
    return V.obs(spark, sf).select("obs_id", F.lit(0).alias("dim"), F.col("bal").alias("value"))


def _directed(spark, sf):
    return graph.undirected(V.edges(spark, sf)).select("src", "dst", F.lit(1.0).alias("dist"))


@query(_DIRECTED + ", u AS (SELECT obs_id, value, 1.0::DOUBLE AS w FROM val UNION ALL SELECT src, v.value, exp(-1 / (2 * 0.64::DOUBLE)) FROM dir JOIN val v ON v.obs_id = dst) SELECT obs_id, round(SUM(value * w) / SUM(w), 5) AS value FROM u GROUP BY 1")
def j20_gaussian_smooth(spark, sf):
    return graph.smooth(_values(spark, sf), _directed(spark, sf), 0.8).select("obs_id", F.round("value", 5).alias("value"))


@query(_DIRECTED + ", u AS (SELECT obs_id, value FROM val UNION ALL SELECT src, v.value FROM dir JOIN val v ON v.obs_id = dst) SELECT obs_id, round(AVG(value), 5) AS value FROM u GROUP BY 1")
def j20_uniform_smooth(spark, sf):
    return graph.smooth(_values(spark, sf), _directed(spark, sf)).select("obs_id", F.round("value", 5).alias("value"))


@query(
    _DIRECTED
    + """, w0 AS (SELECT src, dst, exp(-0.5::DOUBLE) AS w FROM dir UNION ALL SELECT DISTINCT src, src, 1.0::DOUBLE FROM dir),
p0 AS (SELECT src, dst, SUM(w) AS w FROM (SELECT src, dst, w / 2 AS w FROM w0 UNION ALL SELECT dst, src, w / 2 FROM w0) GROUP BY 1, 2),
p AS (SELECT src, dst, w / SUM(w) OVER (PARTITION BY src) AS p FROM p0),
x1 AS (SELECT src AS obs_id, SUM(p * value) AS v FROM p JOIN val ON obs_id = dst GROUP BY 1), x2 AS (SELECT src AS obs_id, SUM(p * v) AS v FROM p JOIN x1 ON obs_id = dst GROUP BY 1),
x3 AS (SELECT src AS obs_id, SUM(p * v) AS v FROM p JOIN x2 ON obs_id = dst GROUP BY 1)
SELECT val.obs_id, round(coalesce(v, value), 5) AS value FROM val LEFT JOIN x3 USING (obs_id)"""
)
def j21_graph_diffusion(spark, sf):
    w = graph.adaptive_gaussian(_directed(spark, sf))
    return graph.diffuse(_values(spark, sf), w, 3, 2).select("obs_id", F.round("value", 5).alias("value"))


@query(_DIRECTED + """, t AS (SELECT src, SUM(k * u.value) AS a, SUM(k) AS b FROM (SELECT d.src, d.dst, exp(-0.5::DOUBLE) * exp(-((u.value - v.value) ** 2) / (2 * 3000.0::DOUBLE ** 2)) AS k FROM dir d JOIN val u ON u.obs_id = d.dst JOIN val v ON v.obs_id = d.src) q JOIN val u ON u.obs_id = q.dst GROUP BY 1)
SELECT obs_id, round((value + coalesce(a, 0)) / (1 + coalesce(b, 0)), 5) AS value FROM val LEFT JOIN t ON t.src = obs_id""")
def j22_bilateral(spark, sf):
    return graph.bilateral(_values(spark, sf), _directed(spark, sf), 1.0, 3000.0).select("obs_id", F.round("value", 5).alias("value"))


@query(_DIRECTED + """, n AS (SELECT obs_id AS src, obs_id AS dst FROM val UNION ALL SELECT src, dst FROM dir),
m AS (SELECT src AS obs_id, AVG(value) AS m, AVG(value * value) AS q FROM n JOIN val ON obs_id = dst GROUP BY 1),
ab AS (SELECT obs_id, greatest(q - m * m, 0) / (greatest(q - m * m, 0) + 1e6) AS a, (1 - greatest(q - m * m, 0) / (greatest(q - m * m, 0) + 1e6)) * m AS b FROM m),
g AS (SELECT src AS obs_id, AVG(a) AS a, AVG(b) AS b FROM n JOIN ab ON obs_id = dst GROUP BY 1)
SELECT obs_id, round(a * value + b, 4) AS value FROM val JOIN g USING (obs_id)""")
def j23_guided(spark, sf):
    return graph.guided(_values(spark, sf), _directed(spark, sf), 1e6).select("obs_id", F.round("value", 4).alias("value"))


def _heat_sql(t: float, tail: float) -> str:
    """The same terms, each as a table."""
    import math

    k, term, left = 0, math.exp(-t), 1 - math.exp(-t)
    out, total = _DIRECTED + ", p AS (SELECT src, dst, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY src) AS p FROM dir), h0 AS (SELECT obs_id, value AS v FROM val)", f"SELECT obs_id, v * {term!r}::DOUBLE AS v FROM h0"
    while left > tail or k < t:
        k += 1
        term *= t / k
        left -= term
        out += f", h{k} AS (SELECT src AS obs_id, SUM(p * v) AS v FROM p JOIN h{k - 1} ON obs_id = dst GROUP BY 1)"
        total += f" UNION ALL SELECT obs_id, v * {term!r}::DOUBLE FROM h{k}"
    return out + f" SELECT obs_id, round(SUM(v), 5) AS value FROM ({total}) GROUP BY 1"


@query(_heat_sql(0.5, 1e-6))
def j24_heat_kernel(spark, sf):
    return graph.heat(_values(spark, sf), _directed(spark, sf).withColumn("weight", F.lit(1.0)), 0.5, 1e-6).select("obs_id", F.round("value", 5).alias("value"))


# scales


@query(MORAN + ", g AS (SELECT * FROM (SELECT DISTINCT gene FROM ranked) CROSS JOIN (SELECT DISTINCT side FROM ranked)) SELECT g.gene, g.side AS scale, coalesce(rank, (SELECT max(rank) + 1 FROM ranked))::BIGINT AS rank, rank IS NULL AS filled FROM g LEFT JOIN ranked USING (gene, side)")
def f2_fill_worst(spark, sf):
    r = cut(multiscale_moran_ranks(spark, sf), "ranks").select("gene", F.col("side").alias("scale"), "rank")
    return scale.fill_worst(r)


_IMP = MORAN + """, g AS (SELECT * FROM (SELECT DISTINCT gene FROM ranked) CROSS JOIN (SELECT DISTINCT side FROM ranked)), ng AS (SELECT COUNT(DISTINCT gene) AS ng FROM ranked),
long AS (SELECT g.gene, g.side AS scale, coalesce(rank, ng)::BIGINT AS rank, coalesce(moran, min(moran) OVER (PARTITION BY g.side), 0) AS score, rank IS NULL AS filled FROM g LEFT JOIN ranked USING (gene, side) CROSS JOIN ng)"""


def imputed(spark, sf):
    r = cut(autocorr.multiscale(V.expr(spark, sf), V.segments(spark, sf), V.edges(spark, sf), ["side"]), "ranks")
    return cut(scale.impute(r.select("gene", F.col("side").alias("scale"), "rank", F.col("moran").alias("score"))), "imputed")


@query(_IMP + "SELECT gene, scale, rank, round(score, 6) AS score, filled FROM long")
def f3_impute(spark, sf):
    return imputed(spark, sf).select("gene", "scale", "rank", F.round("score", 6).alias("score"), "filled")


@query(_IMP + "SELECT gene, CASE WHEN scale <= 5 THEN 'fine' ELSE 'coarse' END AS grp, round(AVG(rank), 6) AS rank FROM long GROUP BY 1, 2")
def f5_trajectory(spark, sf):
    x = imputed(spark, sf).withColumn("grp", scale.group_of_scale(F.col("scale"), {"fine": (0, 5), "coarse": [8, 10, 20]}))
    return scale.trajectory(x, "grp", "rank").select("gene", "grp", F.round("rank", 6).alias("rank"))


@query(_IMP + """, p AS (SELECT gene, CASE WHEN scale <= 4 THEN 'fine' WHEN scale <= 8 THEN 'mid' ELSE 'coarse' END AS grp, rank::DOUBLE / (SELECT ng FROM ng) AS p FROM long),
gg AS (SELECT gene, grp, median(p) AS med, min(p) AS best, AVG((p <= 0.3)::INT) AS good FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY med, CASE grp WHEN 'fine' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END) AS k FROM gg)
SELECT gene, max(grp) FILTER (WHERE k = 1) AS grp, round(max(med) FILTER (WHERE k = 1), 6) AS median, round(max(best) FILTER (WHERE k = 1), 6) AS best, round(max(good) FILTER (WHERE k = 1), 6) AS good,
 round(max(med) FILTER (WHERE k = 2) - max(med) FILTER (WHERE k = 1), 6) AS lead,
 max(med) FILTER (WHERE k = 1) <= 0.3 AND max(med) FILTER (WHERE k = 2) - max(med) FILTER (WHERE k = 1) >= 0.1 AND max(good) FILTER (WHERE k = 1) >= 0.5 AS called FROM r GROUP BY 1 HAVING COUNT(*) >= 2""")
def f12_svg_calls(spark, sf):
    x = imputed(spark, sf)
    n = x.agg(F.count_distinct("gene").alias("n"))
    g = scale.group_of_scale(F.col("scale"), {"fine": (0, 4), "mid": (5, 8), "coarse": [10, 20]})
    x = x.crossJoin(F.broadcast(n)).withColumn("grp", g).withColumn("sample", F.lit("s"))
    c = scale.svg_calls(x, 0.3, 2, 0.1, ["fine", "mid", "coarse"])
    return c.select("gene", "grp", *[F.round(k, 6).alias(k) for k in ("median", "best", "good", "lead")], "called")


_REG = "CASE WHEN scale <= 4 THEN 'fine' WHEN scale <= 8 THEN 'mid' ELSE 'coarse' END"


def _region():
    return F.when(F.col("scale") <= 4, "fine").when(F.col("scale") <= 8, "mid").otherwise("coarse")


def _profile(value: str, lower: bool) -> str:
    order = "mean" if lower else "-mean"
    gap = "s.mean - b.mean" if lower else "b.mean - s.mean"
    rel = "s.mean + 1e-8" if lower else "abs(b.mean) + 1e-8"
    return _IMP + f""", v AS (SELECT gene, scale, {value}::DOUBLE / max({value}) OVER (PARTITION BY scale) AS v, {_REG} AS region FROM long),
r AS (SELECT gene, region, AVG(v) AS mean, stddev_pop(v) AS std FROM v GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY {order}, region) AS k FROM r),
prof AS (SELECT b.gene, b.region AS best_region, b.mean AS best, b.std, s.mean AS second, {gap} AS gap_abs, ({gap}) / ({rel}) AS gap_rel, ({gap}) / (b.std + 1e-3) AS specificity FROM k b JOIN k s ON s.gene = b.gene AND b.k = 1 AND s.k = 2)"""


_Q5 = """, c AS (SELECT quantile_cont(best, {b}) AS c1, quantile_cont(gap_abs, 0.3) AS c2, quantile_cont(gap_rel, 0.3) AS c3, quantile_cont(specificity, 0.3) AS c4, quantile_cont(std, 0.8) AS c5 FROM prof)
SELECT gene, best_region, round(best, 6) AS best, round(specificity, 4) AS specificity, CASE WHEN best {op} c1 AND gap_abs >= c2 AND gap_rel >= c3 AND specificity >= c4 AND std <= c5 THEN best_region ELSE 'mixed' END AS category FROM prof CROSS JOIN c"""


@query(_profile("rank", True) + _Q5.format(b=0.7, op="<="))
def f8_rank_classifier(spark, sf):
    p = scale.region_profile(imputed(spark, sf), "rank", _region(), True)
    c = scale.classify_by_quantiles(cut(p, "profile"), 0.7, 0.3, 0.3, 0.3, 0.8, True)
    return c.select("gene", "best_region", F.round("best", 6).alias("best"), F.round("specificity", 4).alias("specificity"), "category")


@query(_profile("score", False) + _Q5.format(b=0.3, op=">="))
def f9_score_classifier(spark, sf):
    p = scale.region_profile(imputed(spark, sf), "score", _region(), False)
    c = scale.classify_by_quantiles(cut(p, "profile"), 0.3, 0.3, 0.3, 0.3, 0.8, False)
    return c.select("gene", "best_region", F.round("best", 6).alias("best"), F.round("specificity", 4).alias("specificity"), "category")


@query(_profile("score", False) + "SELECT gene, round(best + 0.5 * gap_abs - 0.25 * std, 6) AS composite, CASE WHEN best >= 0.4 AND gap_abs >= 0.05 THEN best_region ELSE 'mixed' END AS category FROM prof")
def f10_score_selector(spark, sf):
    p = scale.region_profile(imputed(spark, sf), "score", _region(), False)
    return scale.score_selector(p, 0.4, 0.05).select("gene", F.round("composite", 6).alias("composite"), "category")


@query(
    _IMP
    + f""", q AS (SELECT gene, {_REG} AS region, CASE WHEN max(rank) OVER w > 1 THEN 1 - (rank - 1)::DOUBLE / (max(rank) OVER w - 1) ELSE 1 END AS pref,
  (rank() OVER (PARTITION BY scale ORDER BY score) + (COUNT(*) OVER (PARTITION BY scale, score) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY scale) AS pct FROM long WINDOW w AS (PARTITION BY scale)),
r AS (SELECT gene, region, 0.6 * AVG(pref) + 0.4 * AVG(pct) AS base FROM q GROUP BY 1, 2),
o AS (SELECT *, base - lead(base) OVER (PARTITION BY gene ORDER BY base DESC, region) AS ld, row_number() OVER (PARTITION BY gene ORDER BY base DESC, region) AS k FROM r)
SELECT gene, region, round(base + 0.25 * coalesce(ld, 0), 6) AS score FROM o WHERE k = 1"""
)
def f11_hybrid_selector(spark, sf):
    return scale.hybrid_selector(imputed(spark, sf), _region(), 0.4).select("gene", "region", F.round("score", 6).alias("score"))


@query(_IMP + """, q AS (SELECT gene, scale, log2(scale::DOUBLE) AS l, CASE WHEN max(rank) OVER w > 1 THEN 1 - (rank - 1)::DOUBLE / (max(rank) OVER w - 1) ELSE 1 END AS p FROM long WINDOW w AS (PARTITION BY scale)),
ce AS (SELECT gene, SUM(p * l) / nullif(SUM(p), 0) AS c FROM q GROUP BY 1),
own AS (SELECT gene, any_value(c) AS centre, sqrt(greatest(SUM(p * (l - c) * (l - c)) / nullif(SUM(p), 0), 0)) AS breadth, max(p) - AVG(p) AS prominence FROM q JOIN ce USING (gene) GROUP BY 1),
pa AS (SELECT q.*, perm, row_number() OVER (PARTITION BY gene, perm ORDER BY scale) AS a, row_number() OVER (PARTITION BY gene, perm ORDER BY md5('0|' || perm || '|' || gene || '|' || scale)) AS b FROM q CROSS JOIN (SELECT unnest(range(1, 100)) AS perm)),
sh AS (SELECT x.gene, x.perm, x.l, y.p FROM pa x JOIN pa y ON y.gene = x.gene AND y.perm = x.perm AND y.b = x.a),
sc2 AS (SELECT gene, perm, SUM(p * l) / nullif(SUM(p), 0) AS c FROM sh GROUP BY 1, 2),
nu AS (SELECT gene, perm, (max(p) - AVG(p)) / (sqrt(greatest(SUM(p * (l - c) * (l - c)) / nullif(SUM(p), 0), 0)) + 1e-6) AS s FROM sh JOIN sc2 USING (gene, perm) GROUP BY 1, 2),
pv AS (SELECT gene, any_value(centre) AS centre, any_value(breadth) AS breadth, any_value(prominence) AS prominence, any_value(prominence / (breadth + 1e-6)) AS specificity, (COUNT(*) FILTER (WHERE s >= prominence / (breadth + 1e-6) * (1 - 1e-6)) + 1) / 100.0::DOUBLE AS pvalue FROM own JOIN nu USING (gene) GROUP BY 1),
bh AS (SELECT *, pvalue * COUNT(*) OVER () / row_number() OVER (ORDER BY pvalue, gene) AS raw FROM pv)
SELECT gene, round(centre, 6) AS centre, round(breadth, 6) AS breadth, round(prominence, 6) AS prominence, CASE WHEN specificity < 1000 THEN round(specificity, 4) ELSE round(specificity, 0) END AS specificity, round(pvalue, 6) AS pvalue, round(least(min(raw) OVER (ORDER BY pvalue, gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS qvalue FROM bh""")
def f16_continuous_specificity(spark, sf):
    from tessella.functions.stats import benjamini_hochberg

    c = benjamini_hochberg(scale.continuous_specificity(imputed(spark, sf), 99), "pvalue", "qvalue", [], ["gene"])
    sharp = F.when(F.col("specificity") < 1000, F.round("specificity", 4)).otherwise(F.round("specificity", 0))  # a breadth of 0 or nearly so
    return c.select("gene", sharp.alias("specificity"), *[F.round(k, 6).alias(k) for k in ("centre", "breadth", "prominence", "pvalue", "qvalue")])


@query(_IMP + """SELECT gene, round(AVG(rank), 6) AS mean, median(rank)::DOUBLE AS median, min(rank) AS best, max(rank) AS worst, round(stddev_pop(rank), 6) AS std,
 round(quantile_cont(rank::DOUBLE, 0.75) - quantile_cont(rank::DOUBLE, 0.25), 6) AS iqr, round(AVG((rank <= 10)::INT), 6) AS top_share, COUNT(*) AS n FROM long GROUP BY 1""")
def f24_robustness(spark, sf):
    r = scale.robustness(imputed(spark, sf), 10)
    return r.select("gene", F.round("mean", 6).alias("mean"), "median", "best", "worst", *[F.round(c, 6).alias(c) for c in ("std", "iqr", "top_share")], "n")


@query(_IMP + ", t AS (SELECT scale, gene FROM long QUALIFY row_number() OVER (PARTITION BY scale ORDER BY rank, gene) <= 8), n AS (SELECT a.scale AS a, b.scale AS b, COUNT(*) FILTER (WHERE a.gene = b.gene) AS common FROM t a CROSS JOIN t b GROUP BY 1, 2) SELECT a, b, common, round(common / (16.0 - common), 6) AS jaccard FROM n")
def d15_top_set_jaccard(spark, sf):
    j = scale.jaccard(cut(scale.top_sets(imputed(spark, sf), 8), "tops"))
    return j.select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"))


@query(None)
def j18_scale_groups(spark, sf):
    """Average-linkage groups of the scales by Jaccard distance: six numbers reach the driver for each scale."""
    j = scale.jaccard(cut(scale.top_sets(imputed(spark, sf), 8), "tops"))
    got = scale.cluster_scales([(r.a, r.b, 1 - r.jaccard) for r in j.collect()], 3)
    return spark.createDataFrame(sorted(got.items()), "scale long, grp string")


@query(_IMP + """, a AS (SELECT scale, gene, rank AS ra FROM long), b AS (SELECT scale, gene, rank() OVER (PARTITION BY scale ORDER BY score DESC, gene) AS rb FROM long),
j AS (SELECT *, rank() OVER (PARTITION BY scale ORDER BY ra) + (COUNT(*) OVER (PARTITION BY scale, ra) - 1) / 2.0 AS pa, rank() OVER (PARTITION BY scale ORDER BY rb) + (COUNT(*) OVER (PARTITION BY scale, rb) - 1) / 2.0 AS pb FROM a JOIN b USING (scale, gene))
SELECT scale, COUNT(*) AS n, round(corr(pa, pb), 6) AS spearman, median(abs(ra - rb))::DOUBLE AS median_shift, round(AVG(abs(ra - rb)), 6) AS mean_shift, max(abs(ra - rb)) AS max_shift, COUNT(*) FILTER (WHERE ra <= 10 AND rb <= 10) AS top_overlap FROM j GROUP BY 1""")
def f7_rank_shift(spark, sf):
    from pyspark.sql import Window as W

    x = imputed(spark, sf)
    b = x.withColumn("rank", F.rank().over(W.partitionBy("scale").orderBy(F.desc("score"), "gene")))
    r = scale.rank_shift(x, b, 10)
    return r.select("scale", "n", F.round("spearman", 6).alias("spearman"), "median_shift", F.round("mean_shift", 6).alias("mean_shift"), "max_shift", "top_overlap")


# coordinates


@query("SELECT obs_id, x, y, (x // 5)::VARCHAR || '_' || (y // 5)::VARCHAR AS label FROM obs")
def b16_fixed_grid(spark, sf):
    from tessella.functions.scalars import grid_label

    return V.obs(spark, sf).select("obs_id", "x", "y", grid_label("x", "y", 5).alias("label"))


@query("SELECT CAST(round_even(x * 0.3, 0) AS BIGINT) + 1 AS px, CAST(round_even(y * 0.3, 0) AS BIGINT) + 1 AS py, min(obs_id) AS obs_id, COUNT(*) AS n FROM obs GROUP BY 1, 2")
def b3_reduce_resolution(spark, sf):
    return spatial.reduce_resolution(V.obs(spark, sf), 0.3)


_PTS = ", pt AS (SELECT obs_id, (x * x % 97)::DOUBLE AS x, (y * 3 + y % 4)::DOUBLE AS y FROM obs)"


def _points(spark, sf):
    return V.obs(spark, sf).select("obs_id", (F.col("x") * F.col("x") % 97).cast("double").alias("x"), (F.col("y") * 3 + F.col("y") % 4).cast("double").alias("y"))


@query(_PTS + "SELECT obs_id, (dense_rank() OVER (ORDER BY x) - 1) * 2.0::DOUBLE AS x_new, (dense_rank() OVER (ORDER BY y) - 1) * 2.0::DOUBLE AS y_new FROM pt")
def b20_compact_tight(spark, sf):
    return spatial.compact_tight(_points(spark, sf), 2.0).select("obs_id", "x_new", "y_new")


def _capped(c: str) -> str:
    return f""", d{c} AS (SELECT {c}, {c} - lag({c}) OVER (ORDER BY {c}) AS gap FROM (SELECT DISTINCT {c} FROM pt)), m{c} AS (SELECT median(gap) * 1.5 AS cap FROM d{c}),
r{c} AS (SELECT {c}, SUM(coalesce(least(gap, cap), 0)) OVER (ORDER BY {c}) AS n{c} FROM d{c} CROSS JOIN m{c})"""


@query(_PTS + _capped("x") + _capped("y") + "SELECT obs_id, round(nx, 6) AS x_new, round(ny, 6) AS y_new FROM pt JOIN rx USING (x) JOIN ry USING (y)")
def b21_compact_capped(spark, sf):
    return spatial.compact_capped(_points(spark, sf), 1.5).select("obs_id", F.round("x_new", 6).alias("x_new"), F.round("y_new", 6).alias("y_new"))


@query(_PTS + "SELECT obs_id, round_even((x - 0.5) / 3, 0)::BIGINT AS x_i, round_even((y - 0.25) / 3, 0)::BIGINT AS y_i, row_number() OVER (PARTITION BY round_even((x - 0.5) / 3, 0), round_even((y - 0.25) / 3, 0) ORDER BY obs_id) = 1 AS first FROM pt")
def b22_snap(spark, sf):
    return spatial.snap(_points(spark, sf), 3.0, 0.5, 0.25).select("obs_id", "x_i", "y_i", "first")


@query(_PTS + ", k AS (SELECT *, round_even(x * 0.2, 0)::BIGINT::VARCHAR || '_' || round_even(y * 0.2, 0)::BIGINT::VARCHAR AS cell FROM pt), n AS (SELECT cell, COUNT(*) AS n FROM k GROUP BY 1) SELECT obs_id, cell, n FROM k JOIN n USING (cell) WHERE n > (SELECT quantile_cont(n::DOUBLE, 0.01) FROM n)")
def c1_grid_outliers(spark, sf):
    return spatial.grid_outliers(_points(spark, sf), 0.2).select("obs_id", "cell", "n")


_KNN = _PTS + ", kn AS (SELECT a.obs_id AS id, b.obs_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pt a JOIN pt b ON a.obs_id <> b.obs_id), nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM kn)"


@query(_KNN + "SELECT id, other, round(d, 6) AS dist, k AS place FROM nn WHERE k <= 3")
def d8_nearest_neighbours(spark, sf):
    p = cut(_points(spark, sf), "points")
    return spatial.nearest(p, p, 3, 3.0, keep_self=False).select("id", "other", F.round("dist", 6).alias("dist"), F.col("place").cast("long").alias("place"))


@query(_PTS + ", q AS (SELECT obs_id, x + 0.3 AS x, y + 0.4 AS y FROM pt), n AS (SELECT q.obs_id AS id, p.obs_id AS other, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS d FROM q CROSS JOIN pt p) SELECT id, other, round(d, 6) AS dist FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) = 1")
def d9_nearest_barcode(spark, sf):
    p = cut(_points(spark, sf), "points")
    q = p.withColumn("x", F.col("x") + 0.3).withColumn("y", F.col("y") + 0.4)
    return spatial.nearest(q, p, 1, 3.0).select("id", "other", F.round("dist", 6).alias("dist"))


@query(_KNN + ", m AS (SELECT id, AVG(d) AS m FROM nn WHERE k <= 3 GROUP BY 1) SELECT id AS obs_id, round(m, 6) AS mean_dist FROM m WHERE m <= (SELECT quantile_cont(m, 0.95) FROM m)")
def c2_isolated_points(spark, sf):
    p = cut(_points(spark, sf), "points")
    return spatial.isolated(p, 3, 3.0, 0.95).select("obs_id", F.round("mean_dist", 6).alias("mean_dist"))


@query(_KNN + ", f AS (SELECT * FROM nn WHERE k = 1), b AS (SELECT COUNT(*) AS b FROM (SELECT DISTINCT floor(x / 2), floor(y / 2) FROM pt)) SELECT round(median(d), 6) AS median, round(AVG(d), 6) AS mean, round(stddev_pop(d) / AVG(d), 6) AS cv, round(sqrt(any_value(b) * 4.0 / COUNT(*)), 6) AS effective FROM f CROSS JOIN b")
def e33_pitch(spark, sf):
    p = cut(_points(spark, sf), "points")
    return spatial.pitch(p, 3.0).select(*[F.round(c, 6).alias(c) for c in ("median", "mean", "cv", "effective")])


@query(_KNN + ", f AS (SELECT * FROM nn WHERE k = 1) SELECT round(median(d), 6) AS pitch FROM f WHERE d <= (SELECT quantile_cont(d, 0.2) FROM f)")
def e35_lattice_pitch(spark, sf):
    return spatial.lattice_pitch(cut(_points(spark, sf), "points"), 3.0).select(F.round("pitch", 6).alias("pitch"))


@query(_PTS + ", s AS (SELECT x, y, COUNT(*) AS n FROM pt GROUP BY 1, 2) SELECT COUNT(*) AS positions, max(n) AS largest, round(coalesce(SUM(n) FILTER (WHERE n > 1), 0) / SUM(n), 6) AS stacked FROM s")
def e29_collisions(spark, sf):
    return spatial.collisions(_points(spark, sf)).select("positions", "largest", F.round("stacked", 6).alias("stacked"))


@query(_PTS + ", d AS (SELECT x, x - lag(x) OVER (ORDER BY x) - 1 AS e FROM (SELECT DISTINCT x FROM pt)), s AS (SELECT x, SUM(CASE WHEN e BETWEEN 1 AND 2 THEN e ELSE 0 END) OVER (ORDER BY x) AS s FROM d) SELECT obs_id, x, x - s AS x_new FROM pt JOIN s USING (x)")
def f29_remove_gaps(spark, sf):
    return spatial.remove_gaps(_points(spark, sf), "x", 2).select("obs_id", "x", "x_new")


@query(_PTS + "SELECT round((var_pop(x) + var_pop(y)) / 2 + sqrt(((var_pop(x) - var_pop(y)) / 2) ** 2 + covar_pop(x, y) ** 2), 4) AS major, false AS collinear FROM pt")
def c13_collinear(spark, sf):
    return spatial.collinear(_points(spark, sf)).select(F.round("major", 4).alias("major"), "collinear")


@query("SELECT obs_id, x, y FROM obs WHERE x BETWEEN 5 AND 20 AND y BETWEEN 3 AND 15")
def c15_axis_crop(spark, sf):
    return V.obs(spark, sf).where(F.col("x").between(5, 20) & F.col("y").between(3, 15)).select("obs_id", "x", "y")


@query("SELECT obs_id FROM obs WHERE x > 1.5 AND y > 0.25 AND x + y < 21.75")
def c12_point_in_polygon(spark, sf):
    from tessella.functions.scalars import in_polygon

    inside = in_polygon(F.col("x").cast("double"), F.col("y").cast("double"), [1.5, 21.5, 1.5], [0.25, 0.25, 20.25])
    return V.obs(spark, sf).where(inside).select("obs_id")
