"""Queries of whole analyses: contrasts, tables across scales, compactness search, tiles, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import settings
from tessella.operators import autocorr, cluster, compare, embed, enrich, equalize, matrix, parallel, raster, scale, search, segment, tiles
from tessella.sources import formats
from tessella.sources.storage import cut

from . import views as V
from .core import _IMP, _KNN, _PTS, MORAN, _points, imputed, multiscale_moran_ranks, scored
from .registry import query
from .summaries import _EFF, _GAIN, _LAB, _VAL, _diagonal, _lab, _val, all_gains, choice_sql, rounded

# contrasts of segmentations and of rankings

_CONTRAST = ", mn AS (SELECT gene, AVG(rank::DOUBLE / ng) FILTER (WHERE scale <= 5) AS mean_fine, AVG(rank::DOUBLE / ng) FILTER (WHERE scale > 5) AS mean_coarse, stddev_pop(rank::DOUBLE / ng) AS spread FROM long CROSS JOIN ng GROUP BY 1)"


@query(_IMP + _CONTRAST + """ SELECT gene, round(mean_coarse - mean_fine, 6) AS contrast, round(abs(mean_coarse - mean_fine), 6) AS contrast_abs, round((mean_coarse - mean_fine) / (mean_coarse + mean_fine + 1e-6), 6) AS contrast_ratio,
 round((rank() OVER (ORDER BY spread) + (COUNT(*) OVER (PARTITION BY spread) - 1) / 2.0) / COUNT(*) OVER (), 6) AS percentile FROM (SELECT gene, mean_fine, mean_coarse, round(spread, 9) AS spread FROM mn)""")
def b33_contrast(spark, sf):
    x = imputed(spark, sf)
    n = x.agg(F.count_distinct("gene").alias("ng"))
    v = F.col("rank") / F.col("ng")
    m = x.crossJoin(F.broadcast(n)).groupBy("gene").agg(F.avg(F.when(F.col("scale") <= 5, v)).alias("mean_fine"), F.avg(F.when(F.col("scale") > 5, v)).alias("mean_coarse"), F.round(F.stddev_pop(v), 9).alias("spread"))
    return rounded(compare.contrast(m, "mean_fine", "mean_coarse", "spread").select("gene", "contrast", "contrast_abs", "contrast_ratio", "percentile"))


def _purity_sql(seg: str, o: str) -> str:
    return f""", cs{o} AS (SELECT side, seg, celltype AS class, COUNT(*)::DOUBLE AS v FROM {seg} JOIN obs USING (obs_id) GROUP BY 1, 2, 3), p{o} AS (SELECT *, v / SUM(v) OVER (PARTITION BY side, seg) AS p FROM cs{o}), r{o} AS (SELECT *, row_number() OVER (PARTITION BY side, seg ORDER BY p DESC, class) AS k FROM p{o}),
u{o} AS (SELECT side, seg, max(p) FILTER (WHERE k = 1) AS top, 1 - max(p) FILTER (WHERE k = 1) AS ambiguity, max(p) FILTER (WHERE k = 1) - coalesce(max(p) FILTER (WHERE k = 2), 0) AS margin, 1 + SUM(p * ln(p)) / ln(5) AS purity, SUM(v) AS mass FROM r{o} GROUP BY 1, 2),
w{o} AS (SELECT side, SUM(top * mass) / SUM(mass) AS top, SUM(ambiguity * mass) / SUM(mass) AS ambiguity, SUM(margin * mass) / SUM(mass) AS margin, SUM(purity * mass) / SUM(mass) AS purity FROM u{o} GROUP BY 1)"""


_FIGURES = {"top": 1, "ambiguity": -1, "margin": 1, "purity": 1}


@query(
    ", sg AS (SELECT * FROM segments WHERE side IN (5, 10)), sd AS (SELECT q.side, obs_id, ((x + y) // q.side) * 1000 + (x - y + 4000) // q.side AS seg FROM obs CROSS JOIN (SELECT unnest([5, 10])::BIGINT AS side) q)"
    + _purity_sql("sd", "1")
    + _purity_sql("sg", "2")
    + " SELECT side, "
    + ", ".join(f"round(w1.{c}, 6) AS {c}, round(w2.{c}, 6) AS ref_{c}, round({s} * (w1.{c} - w2.{c}), 6) AS gain_{c}" for c, s in _FIGURES.items())
    + " FROM w1 JOIN w2 USING (side)"
)
def e18_label_comparison(spark, sf):
    """Label purity of diagonal against square segments, by size."""
    def sums(seg):
        return seg.join(V.obs(spark, sf).select("obs_id", "celltype"), "obs_id").groupBy("side", "seg", F.col("celltype").alias("class")).agg(F.count(F.lit(1)).cast("double").alias("v"))

    return rounded(compare.purity_contrast(sums(_diagonal(spark, sf)), sums(V.segments(spark, sf, (5, 10))), 5, ["side"]))


_PANELS = [("a", "Brand#11"), ("a", "Brand#12"), ("a", "Brand#99"), ("b", "Brand#21"), ("b", "Brand#11")]


@query(", p AS (SELECT * FROM (VALUES " + ", ".join(str(p) for p in _PANELS) + ") t(panel, gene)) SELECT DISTINCT panel, gene FROM p JOIN expr USING (gene)")
def e19_marker_panels(spark, sf):
    return compare.resolve_markers(spark.createDataFrame(_PANELS, "panel string, gene string"), V.expr(spark, sf))


@query(""", raw AS (SELECT side, seg, gene, SUM(value) AS v FROM expr JOIN segments USING (obs_id) WHERE side IN (5, 8) GROUP BY 1, 2, 3), ok AS (SELECT side, gene FROM raw WHERE v <> 0 GROUP BY 1, 2 HAVING COUNT(*) >= 4),
mx AS (SELECT side, seg, gene, ln(1 + v * 1e4 / SUM(v) OVER (PARTITION BY side, seg)) AS v FROM raw JOIN ok USING (side, gene)), per AS (SELECT side, seg, COUNT(*) AS genes, SUM(v) AS total FROM mx GROUP BY 1, 2),
gr AS (SELECT DISTINCT a.side, least(a.seg, b.seg) AS i, greatest(a.seg, b.seg) AS j FROM edges e JOIN segments a ON a.obs_id = e.src JOIN segments b ON b.obs_id = e.dst AND b.side = a.side WHERE a.seg <> b.seg), dg AS (SELECT side, seg, COUNT(*) AS neighbours FROM (SELECT side, i AS seg FROM gr UNION ALL SELECT side, j FROM gr) GROUP BY 1, 2),
m AS (SELECT side, seg, o.* FROM segments JOIN obs o USING (obs_id) WHERE side IN (5, 8)), ct AS (SELECT side, seg, celltype FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY side, seg ORDER BY COUNT(*) DESC, celltype) = 1)
SELECT side, seg, COUNT(*) AS n, round(AVG(x), 6) AS x, round(AVG(y), 6) AS y, round(AVG(bal), 9) AS bal, arg_min(batch, obs_id) AS batch, any_value(ct.celltype) AS celltype, coalesce(any_value(genes), 0) AS genes, round(coalesce(any_value(total), 0), 5) AS total, coalesce(any_value(neighbours), 0) AS neighbours
FROM m JOIN ct USING (side, seg) LEFT JOIN per USING (side, seg) LEFT JOIN dg USING (side, seg) GROUP BY 1, 2""")
def e2_pseudo_bulk_analysis(spark, sf):
    a = autocorr.pseudo_bulk_analysis(V.expr(spark, sf), V.obs(spark, sf), V.segments(spark, sf, (5, 8)), V.edges(spark, sf), ["side"], ["bal"], ["celltype"], "batch", least=4)
    return a["obs"].select("side", "seg", "n", *[F.round(c, d).alias(c) for c, d in (("x", 6), ("y", 6), ("bal", 9))], "batch", "celltype", "genes", F.round("total", 5).alias("total"), "neighbours")


@query(None)
def f13_scale_specific_calls(spark, sf):
    """From ranks with gaps to calls, the scales grouped by clustering; tests compare with lists."""
    r = autocorr.multiscale(V.expr(spark, sf), V.segments(spark, sf), V.edges(spark, sf), ["side"])
    return rounded(scale.call_scale_specific(r.select("gene", F.col("side").alias("scale"), "rank", F.col("moran").alias("score")), 8))


_BOTH = MORAN + ", gr AS (SELECT side, gene, rank() OVER (PARTITION BY side ORDER BY geary) AS rank FROM sc WHERE geary IS NOT NULL), j AS (SELECT side, gene, a.rank AS ra, b.rank AS rb FROM ranked a JOIN gr b USING (side, gene))"


@query(_BOTH + """, p AS (SELECT *, rank() OVER (PARTITION BY side ORDER BY ra) + (COUNT(*) OVER (PARTITION BY side, ra) - 1) / 2.0 AS pa, rank() OVER (PARTITION BY side ORDER BY rb) + (COUNT(*) OVER (PARTITION BY side, rb) - 1) / 2.0 AS pb FROM j)
SELECT side AS scale, COUNT(*) AS n, round(corr(pa, pb), 6) AS spearman, COUNT(*) FILTER (WHERE ra <= 8 AND rb <= 8) AS top_overlap, round(COUNT(*) FILTER (WHERE ra <= 8 AND rb <= 8) / COUNT(*) FILTER (WHERE ra <= 8 OR rb <= 8), 6) AS top_jaccard FROM p GROUP BY 1""")
def f20_moran_geary_concordance(spark, sf):
    s = cut(scored(spark, sf), "scores")
    a, b = (autocorr.ranks(s, ["side"], m, t).select(F.col("side").alias("scale"), "gene", "rank") for m, t in (("moran", 0.0), ("geary", None)))
    return rounded(compare.rank_concordance(a, b, 8))


@query(_BOTH + """, t AS (SELECT gene, AVG(ra) AS moran_rank, AVG(rb) AS geary_rank, arg_min(side, (ra, side)) AS moran_scale, arg_min(side, (rb, side)) AS geary_scale, COUNT(*) AS n FROM j GROUP BY 1)
SELECT gene, round(moran_rank, 6) AS moran_rank, round(geary_rank, 6) AS geary_rank, moran_scale, geary_scale, n, round(abs(moran_rank - geary_rank), 6) AS gap, CASE WHEN moran_rank <= 10 AND geary_rank <= 10 THEN 'both' WHEN moran_rank <= 10 THEN 'first_only' WHEN geary_rank <= 10 THEN 'second_only' ELSE 'neither' END AS relation FROM t""")
def k13_moran_geary_tables(spark, sf):
    """Per gene over scales: mean rank by either statistic, the scale where each is best, and which tops it is in."""
    s = cut(scored(spark, sf), "scores")
    a, b = (autocorr.ranks(s, ["side"], m, t).select("side", "gene", F.col("rank").alias(c)) for m, t, c in (("moran", 0.0, "ra"), ("geary", None, "rb")))
    t = cut(a.join(b, ["side", "gene"]).groupBy("gene").agg(F.avg("ra").alias("moran_rank"), F.avg("rb").alias("geary_rank"), F.min_by("side", F.struct("ra", "side")).alias("moran_scale"), F.min_by("side", F.struct("rb", "side")).alias("geary_scale"), F.count(F.lit(1)).alias("n")), "tables")
    r = compare.relationship(t.select("gene", F.col("moran_rank").alias("rank")), t.select("gene", F.col("geary_rank").alias("rank")), 10).select("gene", "relation")
    return rounded(t.withColumn("gap", F.abs(F.col("moran_rank") - F.col("geary_rank"))).join(r, "gene"))


_REGION = "CASE WHEN scale <= 4 THEN 'fine' WHEN scale <= 8 THEN 'mid' ELSE 'coarse' END"
_SETS = f", rg AS (SELECT gene, {_REGION} AS grp, AVG(rank) AS r FROM long GROUP BY 1, 2), st AS (SELECT gene, grp FROM rg QUALIFY row_number() OVER (PARTITION BY gene ORDER BY r, grp) = 1)"


@query(_IMP + _SETS + _EFF + """, fc AS (SELECT gene, celltype, log2((mean_in + 1e-9) / (mean_out + 1e-9)) AS fc FROM eff), al AS (SELECT celltype, SUM(fc) AS s, COUNT(*) AS n FROM fc GROUP BY 1), ow AS (SELECT grp, celltype, COUNT(*) AS n, SUM(fc) AS s, AVG((fc > 0)::INT) AS positive FROM st JOIN fc USING (gene) GROUP BY 1, 2)
SELECT grp, celltype, ow.n AS n, round(ow.s / ow.n, 6) AS mean_in, round((al.s - ow.s) / nullif(al.n - ow.n, 0), 6) AS mean_out, round(ow.s / ow.n - (al.s - ow.s) / nullif(al.n - ow.n, 0), 6) AS difference, round(positive, 6) AS positive FROM ow JOIN al USING (celltype)""")
def k7_enrichment_by_scale_group(spark, sf):
    return rounded(enrich.by_scale_group(_scale_sets(spark, sf), enrich.effects(V.expr(spark, sf), V.obs(spark, sf))))


def _scale_sets(spark, sf):
    from pyspark.sql import Window as W

    grp = F.when(F.col("scale") <= 4, "fine").when(F.col("scale") <= 8, "mid").otherwise("coarse")
    r = imputed(spark, sf).groupBy("gene", grp.alias("grp")).agg(F.avg("rank").alias("r"))
    return r.withColumn("_p", F.row_number().over(W.partitionBy("gene").orderBy("r", "grp"))).where("_p = 1").select("gene", "grp")


@query(None)
def k7_gene_sets_by_scale_group(spark, sf):
    """Each scale group's set against matched random sets; its parts have SQL of their own (k5_k9, k9)."""
    x, o = cut(V.expr(spark, sf), "expr"), V.obs(spark, sf)
    m = cut(matrix.gene_moments(x, o.count()), "moments")
    return rounded(enrich.sets_by_scale_group(cut(_scale_sets(spark, sf), "sets"), cut(enrich.effects(x, o), "effects"), m, 50, 2))


@query(_LAB + """, v AS (SELECT obs_id, label, COUNT(*) AS n, SUM(origin) AS o FROM lab WHERE label >= 0 GROUP BY 1, 2), w AS (SELECT obs_id, label FROM v QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY n DESC, o DESC, label) = 1)
SELECT obs_id, coalesce(label, -1) AS label FROM obs LEFT JOIN w USING (obs_id)""")
def d20_tile_labels_to_obs(spark, sf):
    return segment.labels_to_obs(_lab(spark, sf), V.obs(spark, sf), "majority")


@query(_GAIN + _IMP + ", gs AS (SELECT gene, AVG(gain_r2) AS gain_r2 FROM gains GROUP BY 1), rs AS (SELECT gene, AVG(rank) AS mean_rank, min(rank) AS best_rank FROM long GROUP BY 1) SELECT gene, round(gain_r2, 6) AS gain_r2, round(mean_rank, 6) AS mean_rank, best_rank FROM gs LEFT JOIN rs USING (gene)")
def d21_evidence_join(spark, sf):
    """Gains with the ranks' summary joined in; genes without ranks stay."""
    g = all_gains(spark, sf).groupBy("gene").agg(F.avg("gain_r2").alias("gain_r2"))
    r = scale.robustness(imputed(spark, sf), 10).select("gene", F.col("mean").alias("mean_rank"), F.col("best").alias("best_rank"))
    return rounded(g.join(r, "gene", "left"))


_NATIVE = [("native", "x", "p1", "no"), ("r16", " Native_Identity ", "p2", None), ("r17", "x", "__native_identity__", None), ("a_native_identity_b", "x", "p3", None), ("r18", "x", "p4", "true"), ("r19", None, None, "1")]


@query("SELECT * FROM (VALUES ('r', 'a', false), ('native', 'a', true), ('r16', 'a', true), ('r17', 'a', true), ('a_native_identity_b', 'a', true), ('r18', 'a', false), ('r19', 'a', false), ('r18', 'b', true), ('r20', 'b', false), ('r18', 'c', false), ('r19', 'c', false)) t(scale_id, case_, native) WHERE scale_id <> 'r'", base=False)
def c11_native_scale(spark, sf):
    """Three small indexes: with strong hints, with one weak hint, with a weak hint on every row."""
    kind = "scale_id string, mode string, path string, native_identity string"
    cases = {"a": _NATIVE, "b": [_NATIVE[4], ("r20", "x", "p5", "off")], "c": [_NATIVE[4], _NATIVE[5]]}
    out = None
    for name, rows in cases.items():
        one = formats.with_native(spark.createDataFrame(rows, kind)).select("scale_id", F.lit(name).alias("case_"), "native")
        out = one if out is None else out.unionByName(one)
    return out


@query(MORAN + "SELECT gene, 'r' || side AS scale, rank::BIGINT AS rank FROM ranked WHERE side IN (2, 5, 8)")
def d18_scale_columns(spark, sf):
    """A wide table whose columns name scales in three ways, resolved and made long."""
    r = cut(multiscale_moran_ranks(spark, sf), "ranks")
    wide = r.groupBy("gene").pivot("side", [2, 5, 8]).agg(F.first("rank")).toDF("gene", "rank_r2", "res_5", "8")
    return scale.wide_to_long(wide, ["r2", "r5", "r8", "r99"])


@query("SELECT * FROM (VALUES ('n_spots', 'log_n_spots'), (' Segment_Size', 'log_n_spots'), ('library_size', 'log_total_counts'), ('OFF', NULL), ('', NULL)) t(alias, covariate)", base=False)
def b41_aliases(spark, sf):
    names = ["n_spots", " Segment_Size", "library_size", "OFF", ""]
    return spark.createDataFrame([(n, autocorr.covariate_of(n)) for n in names], "alias string, covariate string")


@query(MORAN + ", g AS (SELECT * FROM (SELECT DISTINCT gene FROM ranked) CROSS JOIN (SELECT DISTINCT side FROM ranked)) SELECT g.gene, g.side AS scale, coalesce(rank, max(rank) OVER (PARTITION BY g.side) + 1)::BIGINT AS rank FROM g LEFT JOIN ranked USING (gene, side)")
def f4_fill_for_plot(spark, sf):
    return scale.fill_for_plot(cut(multiscale_moran_ranks(spark, sf), "ranks").select("gene", F.col("side").alias("scale"), "rank"))


@query(_IMP + ", s AS (SELECT gene, AVG(rank) AS m, max(score) AS s FROM long GROUP BY 1), o AS (SELECT gene, row_number() OVER (ORDER BY CASE gene WHEN 'Brand#23' THEN 1 WHEN 'Brand#14' THEN 3 ELSE 9 END, round(m, 6), gene) AS place FROM s) SELECT place, gene FROM o WHERE place <= 7")
def g7_example_genes(spark, sf):
    """Two genes asked for (a third does not exist), then the best by mean rank; seven in all."""
    s = imputed(spark, sf).groupBy("gene").agg(F.avg("rank").alias("m"))
    return compare.example_genes(s, [F.round("m", 6)], 7, ["Brand#23", "Brand#00", "Brand#14"])


# callbacks, registries, settings


@query("SELECT obs_id, list_sum(list_transform(string_split(obs_id::VARCHAR, ''), lambda c: c::BIGINT))::BIGINT AS digits FROM obs")
def m4_map_items(spark, sf):
    """A caller's Python function of every row."""
    return parallel.map_items(V.obs(spark, sf).select("obs_id"), lambda r: {"obs_id": r["obs_id"], "digits": sum(map(int, str(r["obs_id"])))}, "obs_id long, digits long")


@query(_VAL + ", c AS (SELECT obs_id, dim, least(greatest(value, 0), 1000) AS v FROM val), u AS (SELECT obs_id, dim, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM c WINDOW w AS (PARTITION BY dim)) SELECT obs_id, dim, round(cume_dist() OVER (PARTITION BY dim ORDER BY v), 6) AS value FROM u")
def m5_method_chain(spark, sf):
    """Methods chosen by name, one after another."""
    return rounded(equalize.apply(_val(spark, sf), [("clip", 0.0, 1000.0), ("ecdf",)]))


# tiles


@query(_PTS + """, px AS (SELECT px, py FROM (SELECT unnest(range((SELECT floor(min(x))::BIGINT FROM pt), (SELECT floor(max(x))::BIGINT + 1 FROM pt))) AS px) CROSS JOIN (SELECT unnest(range((SELECT floor(min(y))::BIGINT FROM pt), (SELECT floor(max(y))::BIGINT + 1 FROM pt))) AS py))
SELECT px, py, arg_min(obs_id, ((px + 0.5 - x) ** 2 + (py + 0.5 - y) ** 2, obs_id)) AS obs_id FROM px CROSS JOIN pt GROUP BY 1, 2""")
def j29_voronoi_tiles(spark, sf):
    """Every pixel of the extent with its nearest point."""
    return tiles.tiles(cut(_points(spark, sf), "points"), "voronoi")


@query(_PTS + """, s AS (SELECT round_even(x / 3, 0)::BIGINT AS px, round_even(y / 3, 0)::BIGINT AS py, obs_id FROM pt), f AS (SELECT px, py, min(obs_id) AS obs_id FROM s GROUP BY 1, 2),
v AS (SELECT px + i AS px, py + j AS py, COUNT(*) AS n FROM f CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j) WHERE i <> 0 OR j <> 0 GROUP BY 1, 2), e AS (SELECT px, py FROM v ANTI JOIN f USING (px, py) WHERE n >= 5),
g AS (SELECT px, py, arg_min(obs_id, ((px * 3 - x) ** 2 + (py * 3 - y) ** 2, obs_id)) AS obs_id FROM e CROSS JOIN pt GROUP BY 1, 2) SELECT px, py, obs_id FROM f UNION ALL SELECT px, py, obs_id FROM g""")
def j29_boundary_tiles(spark, sf):
    """An inferred lattice, empty places with five occupied neighbours filled."""
    return tiles.tiles(cut(_points(spark, sf), "points"), "boundary", 3.0, 5)


_SIZES = """, f AS (SELECT d FROM nn WHERE k = 1 AND d > 0), ax AS (SELECT abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM nn JOIN pt a ON a.obs_id = id JOIN pt b ON b.obs_id = other WHERE k <= 6),
q AS (SELECT q, (SELECT quantile_cont(d, 0.5) FROM f) AS n5, (SELECT quantile_cont(d, 0.2) FROM f) AS n2, (SELECT least(quantile_cont(dx, 0.5) FILTER (WHERE dx > 0), quantile_cont(dy, 0.5) FILTER (WHERE dy > 0)) FROM ax) AS a5, (SELECT least(quantile_cont(dx, 0.2) FILTER (WHERE dx > 0), quantile_cont(dy, 0.2) FILTER (WHERE dy > 0)) FROM ax) AS a2 FROM (SELECT 1 AS q)),
z AS (SELECT 'nn' AS mode, n5 AS s FROM q UNION ALL SELECT 'axis', a5 FROM q UNION ALL SELECT 'auto', CASE WHEN a2 >= 0.7 * n2 THEN a2 ELSE n2 END FROM q),
ex AS (SELECT greatest(0.1, sqrt((max(x) - min(x)) * (max(y) - min(y)) / COUNT(*))) AS top FROM pt)"""


@query(_KNN + _SIZES + " SELECT mode, round(s, 6) AS size, round(least(s, top), 6) AS capped FROM z CROSS JOIN ex")
def e36_tile_size(spark, sf):
    p = cut(_points(spark, sf), "points")
    factor = settings.get(spark, "density_factor")
    out = None
    for mode in ("nn", "axis", "auto"):
        size = tiles.tile_size(p, mode, side=3.0)
        one = size.crossJoin(F.broadcast(tiles.cap_by_density(size, p, factor).withColumnRenamed("size", "capped"))).select(F.lit(mode).alias("mode"), "size", "capped")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(_KNN + ", f AS (SELECT stddev_pop(d) / AVG(d) AS cv FROM nn WHERE k = 1) SELECT 'columns' AS how, 'cell' AS kind UNION ALL SELECT 'marks', 'grid' UNION ALL SELECT 'distances', CASE WHEN cv <= 0.25 THEN 'grid' ELSE 'cell' END FROM f")
def e34_sampling_kind(spark, sf):
    p = cut(_points(spark, sf), "points")
    cases = {"columns": p.withColumnsRenamed({"x": "x_centroid", "y": "y_centroid"}), "marks": p.withColumn("in_tissue", F.lit(1)), "distances": p}
    return spark.createDataFrame([(k, tiles.sampling_kind(v, 3.0)) for k, v in cases.items()], "how string, kind string")


def _collisions_sql(radius: int) -> str:
    out = ", t AS (SELECT obs_id, x // 2 AS cx, y // 2 AS cy, row_number() OVER (PARTITION BY x // 2, y // 2 ORDER BY obs_id) = 1 AS first FROM obs), k0 AS (SELECT obs_id, cx, cy, false AS moved FROM t WHERE first), w0 AS (SELECT obs_id, cx, cy FROM t WHERE NOT first)"
    offsets = tiles.collision_offsets(radius)
    for n, (dx, dy) in enumerate(offsets):
        out += f", g{n} AS (SELECT min(obs_id) AS obs_id, cx + {dx} AS cx, cy + {dy} AS cy, true AS moved FROM w{n} WHERE cx + {dx} BETWEEN 0 AND 29 AND cy + {dy} BETWEEN 0 AND 999999 AND NOT EXISTS (SELECT 1 FROM k{n} k WHERE k.cx = w{n}.cx + {dx} AND k.cy = w{n}.cy + {dy}) GROUP BY cx, cy), k{n + 1} AS (SELECT * FROM k{n} UNION ALL SELECT * FROM g{n}), w{n + 1} AS (SELECT w.* FROM w{n} w ANTI JOIN g{n} USING (obs_id))"
    return out + f" SELECT obs_id, cx, cy, moved FROM k{len(offsets)} UNION ALL SELECT obs_id, cx, cy, false FROM w{len(offsets)}"


@query(_collisions_sql(2))
def f30_resolve_collisions(spark, sf):
    """Four tiles fall on a pixel of a canvas with room to one side only."""
    t = V.obs(spark, sf).select("obs_id", F.floor(F.col("x") / 2).alias("cx"), F.floor(F.col("y") / 2).alias("cy"))
    return tiles.resolve_collisions(t, 30, 1_000_000, 2)


@query(None)
def c3_voronoi_areas(spark, sf):
    """Points with a finite region that is not among the largest; tests compare with areas known in closed form."""
    return rounded(tiles.area_filter(cut(_points(spark, sf), "points"), 3.0, 0.9))


@query(None)
def c17_support_mask(spark, sf):
    """Holes filled, closed, small parts dropped; tests compare with a flood fill."""
    o = V.obs(spark, sf).where("celltype <> 'BUILDING'")
    return raster.regularise(o.select(F.col("x").alias("px"), F.col("y").alias("py")), 1, True, 20)


# compactness search

_FIGS = ("fidelity_cost", "regularity_cost", "score", "penalised")


def _segmenter(points, c):
    """Squares whose side grows with the compactness."""
    side = 2 + int(c * 40 + 0.37)
    return points.select("obs_id", (F.floor(F.col("x") / side) * 1000 + F.floor(F.col("y") / side)).alias("seg"))


def _evaluated(name: str, candidates: str) -> str:
    """Figures of the candidates (a table with the column c) under the same squares."""
    return f""", l_{name} AS (SELECT c AS compactness, obs_id, x, y, bal, (x // (2 + floor(c * 40 + 0.37)::BIGINT)) * 1000 + y // (2 + floor(c * 40 + 0.37)::BIGINT) AS seg FROM obs CROSS JOIN {candidates}),
s_{name} AS (SELECT compactness, seg, COUNT(*) AS n, var_pop(bal) AS v, CASE WHEN COUNT(*) > 2 THEN ln(sqrt(((var_samp(x) + var_samp(y)) / 2 + sqrt(((var_samp(x) - var_samp(y)) / 2) ** 2 + covar_samp(x, y) ** 2)) / greatest((var_samp(x) + var_samp(y)) / 2 - sqrt(((var_samp(x) - var_samp(y)) / 2) ** 2 + covar_samp(x, y) ** 2), 1e-9))) END AS a FROM l_{name} GROUP BY 1, 2),
n_{name} AS (SELECT a.compactness, AVG((a.seg <> b.seg)::INT) AS neighbor_disagreement FROM edges e JOIN l_{name} a ON a.obs_id = e.src JOIN l_{name} b ON b.obs_id = e.dst AND b.compactness = a.compactness GROUP BY 1),
{name} AS (SELECT compactness, SUM(v * n) / SUM(n) AS embedding_var, AVG(a) AS mean_log_aspect, stddev_pop(n) / AVG(n) AS size_cv, any_value(neighbor_disagreement) AS neighbor_disagreement FROM s_{name} JOIN n_{name} USING (compactness) GROUP BY 1)"""


def _search_points(spark, sf):
    return V.obs(spark, sf).select("obs_id", "x", "y", "bal")


_GIVEN = (0.01, 0.05, 0.12, 0.3)
_RANGE = "SELECT search_stage, round(compactness, 9) AS compactness, " + ", ".join(f"round({c}, 5) AS {c}" for c in _FIGS) + ", near, is_stage_selected, is_selected FROM "


def _shown(df):
    return df.select("search_stage", F.round("compactness", 9).alias("compactness"), *[F.round(c, 5).alias(c) for c in _FIGS], "near", "is_stage_selected", "is_selected")


@query(f", cand AS (SELECT unnest({list(_GIVEN)})::DOUBLE AS c)" + _evaluated("ev", "cand") + choice_sql("ev", 0.1) + _RANGE.join((" ", "(SELECT *, 'manual' AS search_stage, selected AS is_stage_selected, selected AS is_selected FROM ch)")))
def j28_manual_search(spark, sf):
    """Given candidates, a schedule, and a segmenter of the caller's."""
    _, rows = search.resolve(_search_points(spark, sf), V.edges(spark, sf), _segmenter, ["bal"], "manual", 0.1, _GIVEN)
    return _shown(rows)


@query(f", cand AS (SELECT 0.1 * unnest({list(search.MULTIPLIERS)})::DOUBLE AS c)" + _evaluated("ev", "cand") + choice_sql("ev", 0.1) + _RANGE.join((" ", "(SELECT *, 'adaptive' AS search_stage, selected AS is_stage_selected, selected AS is_selected FROM ch)")))
def j28_adaptive_search(spark, sf):
    _, rows = search.resolve(_search_points(spark, sf), V.edges(spark, sf), _segmenter, ["bal"], "adaptive", 0.1)
    return _shown(rows)


@query(None)
def j28_f28_auto_search(spark, sf):
    """Broad candidates, then seven around the best, as one table; tests compare with lists."""
    _, rows = search.resolve(_search_points(spark, sf), V.edges(spark, sf), _segmenter, ["bal"], "auto", lo=0.004)
    return _shown(rows)


@query(None)
def j28_multifidelity_search(spark, sf):
    """Rounds over a quarter, half and all of the points."""
    _, rows = search.resolve(_search_points(spark, sf), V.edges(spark, sf), _segmenter, ["bal"], "multifidelity")
    return _shown(rows)


@query(
    _KNN
    + """, v7 AS (SELECT * FROM nn WHERE k <= 7), sp AS (SELECT stddev_pop(d) / AVG(d) AS cv FROM v7), ne AS (SELECT id, var_pop(bal) AS v FROM v7 JOIN obs ON obs_id = other GROUP BY 1),
r AS (SELECT least(greatest((SELECT AVG(v) FROM ne) / (SELECT var_pop(bal) FROM obs), 0.25), 4) AS roughness, (SELECT cv FROM sp) AS spacing_cv, (SELECT COUNT(*) FROM obs) AS n),
c AS (SELECT *, 0.035 * least(greatest((greatest(sqrt(n / 128.0), 1) / 25) ** 0.6, 0.6), 4) / least(greatest(0.85 + 0.7 * roughness + 0.4 * spacing_cv, 0.8), 4) AS center FROM r)
SELECT round(center / 2.2, 9) AS lower, round(center, 9) AS center, round(center * 2.2, 9) AS upper, round(roughness, 6) AS roughness, round(spacing_cv, 6) AS spacing_cv, n FROM c"""
)
def j28_infer_range(spark, sf):
    p = cut(_points(spark, sf).join(V.obs(spark, sf).select("obs_id", "bal"), "obs_id"), "points")
    r = search.infer_range(p, ["bal"], 3.0)
    return r.select(*[F.round(c, 9).alias(c) for c in ("lower", "center", "upper")], *[F.round(c, 6).alias(c) for c in ("roughness", "spacing_cv")], "n")


_SEEDS = (0.01, 0.03, 0.1, 0.3)


@query(
    f", s AS (SELECT unnest({list(_SEEDS)})::DOUBLE AS c, generate_subscripts({list(_SEEDS)}, 1) AS i), e AS (SELECT a.c AS best, coalesce(b.c, a.c / 1.8) AS lo, coalesce(d.c, a.c * 1.8) AS hi FROM s a LEFT JOIN s b ON b.i = a.i - 1 LEFT JOIN s d ON d.i = a.i + 1), g AS (SELECT best, lo * (hi / lo) ** (k / 6.0::DOUBLE) AS c FROM e CROSS JOIN (SELECT unnest(range(0, 7)) AS k) UNION SELECT best, best FROM e) SELECT DISTINCT best, round(c, 9) AS candidate FROM g"
)
def f27_refined_candidates(spark, sf):
    return spark.createDataFrame([(b, round(c, 9)) for b in _SEEDS for c in sorted({round(x, 9) for x in search.refine(_SEEDS, b)})], "best double, candidate double")


# embedding


_SETS_ = {"a": ["Brand#11", "Brand#12"], "b": ["Brand#23"]}


@query(
    _PTS
    + f""", tl AS (SELECT round_even(x / 3, 0)::BIGINT AS px, round_even(y / 3, 0)::BIGINT AS py, min(obs_id) AS obs_id FROM pt GROUP BY 1, 2), nx AS (SELECT obs_id, gene, ln(1 + value * 1e4 / SUM(value) OVER (PARTITION BY obs_id)) AS v FROM expr),
ms AS (SELECT * FROM (VALUES {", ".join(f"('{g}', {i}, {1 / len(v)!r}::DOUBLE)" for i, v in enumerate(_SETS_.values()) for g in v)}) t(gene, pc, w)), sm AS (SELECT obs_id, pc, SUM(v * w) AS v FROM nx JOIN ms USING (gene) GROUP BY 1, 2),
fu AS (SELECT px, py, tl.obs_id, p.pc, coalesce(v, 0) AS v FROM tl CROSS JOIN (SELECT unnest([0, 1]) AS pc) p LEFT JOIN sm ON sm.obs_id = tl.obs_id AND sm.pc = p.pc)
SELECT px, py, obs_id, pc, round((v - min(v) OVER w) / CASE WHEN max(v) OVER w = min(v) OVER w THEN 1 ELSE max(v) OVER w - min(v) OVER w END, 6) AS value FROM fu WINDOW w AS (PARTITION BY pc)"""
)
def j10_embedded_tiles(spark, sf):
    """From points to tiles, counts to gene-set dimensions, and both to a picture."""
    t = cut(tiles.tiles(_points(spark, sf), "inferred", 3.0), "tiles")
    return rounded(embed.generate(V.expr(spark, sf), t, sets=_SETS_))


# clusters


@query(None)
def j16_communities(spark, sf):
    """Modularity clusters of the lattice weighted by closeness in value; tests compare with planted ones."""
    o = V.obs(spark, sf).select("obs_id", (F.col("bal") / 1000).alias("b"))
    w = cluster.feature_weights(o, V.edges(spark, sf), ["b"], 1.0)
    return cluster.communities(w, rounds=6, levels=2)


def _som_sql(side: int, steps: int, sigma: float) -> str:
    out = f", pt3 AS (SELECT obs_id, x::DOUBLE AS x, y::DOUBLE AS y, bal / 1000 AS b FROM obs), c0 AS (SELECT row_number() OVER (ORDER BY md5('0|' || obs_id), obs_id) - 1 AS node, x, y, b FROM pt3 QUALIFY node < {side * side})"
    for k in range(steps + 1):
        s = sigma * (1 - 0.5 * k / max(1, steps - 1))
        out += f""", a{k} AS (SELECT p.*, c.node FROM pt3 p CROSS JOIN c{k} c QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY (p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.b - c.b) ** 2, node) = 1),
s{k} AS (SELECT node, COUNT(*) AS n, SUM(x) AS x, SUM(y) AS y, SUM(b) AS b FROM a{k} GROUP BY 1),
h{k} AS (SELECT c.node AS t, s{k}.*, exp(-((c.node // {side} - s{k}.node // {side}) ** 2 + (c.node % {side} - s{k}.node % {side}) ** 2) / (2 * {s!r}::DOUBLE * {s!r}::DOUBLE)) AS h FROM c{k} c CROSS JOIN s{k}),
c{k + 1} AS (SELECT t AS node, SUM(h * x) / SUM(h * n) AS x, SUM(h * y) / SUM(h * n) AS y, SUM(h * b) / SUM(h * n) AS b FROM h{k} GROUP BY 1)"""
    return out + f" SELECT obs_id, node FROM a{steps}"


@query(_som_sql(3, 3, 1.0))
def j17_som(spark, sf):
    p = V.obs(spark, sf).select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("bal") / 1000).alias("b"))
    return cluster.som(p, ["x", "y", "b"], cluster.som_nodes(9.5), 3)
