"""Hand fixtures with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.functions import stats as ST
from tessella.operators import autocorr, compare, enrich, graph, raster, scale, segment, spatial
from tessella.sources import formats
from tessella.streaming import incremental


def lattice(spark, n=3):
    return spark.createDataFrame([(i, i % n, i // n) for i in range(n * n)], "obs_id long, x long, y long")


def moran_of(spark, values):
    p = lattice(spark)
    e = graph.undirected(spatial.lattice_edges(p)).select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight", F.lit(1).alias("s"))
    w = graph.transform_weights(e, "R", ["s"])
    x = spark.createDataFrame([(1, i, "g", float(v)) for i, v in enumerate(values) if v], "s int, seg long, gene string, value double")
    n = spark.createDataFrame([(1, 9)], "s int, n long")
    return autocorr.moran(x, w, n, ["s"]).first()


def test_moran_checkerboard_half_and_constant(spark):
    even = moran_of(spark, [1, 2, 1, 2, 1, 2, 1, 2, 1])
    # every neighbour is of the other colour
    m = 13 / 9
    z = [v - m for v in (1, 2, 1, 2, 1, 2, 1, 2, 1)]
    want = sum(a * (z[1] if a == z[0] else z[0]) for a in z) / sum(a * a for a in z)
    assert even.moran == pytest.approx(want)
    assert moran_of(spark, [1, 1, 1, 1, 1, 1, 5, 5, 5]).moran > 0
    assert moran_of(spark, [2] * 9).moran is None


def test_ranks_and_fdr(spark):
    r = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("a", 2, 5)], "gene string, scale int, rank long")
    got = {(x.gene, x.scale): (x["rank"], x.filled) for x in scale.fill_worst(r).collect()}
    assert got == {("a", 1): (1, False), ("b", 1): (2, False), ("a", 2): (5, False), ("b", 2): (6, True)}
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2), (5, None)], "k int, p double")
    q = {x.k: x.q for x in ST.benjamini_hochberg(p, "p", "q", [], ["k"]).collect()}
    assert [round(q[k], 4) for k in (1, 2, 3, 4)] == [0.04, 0.0533, 0.0533, 0.2]
    assert q[5] is None


def test_normal_and_chi_squared_tails(spark):
    zs = [-8.0, -2.0, 0.0, 0.5, 1.0, 2.9, 3.1, 6.0, 20.0, 35.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(ST.normal_sf("z").alias("p")).collect()
    for z, r in zip(zs, got, strict=True):
        assert r.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-10)
    got = spark.createDataFrame([(3.0, 1), (3.0, 2), (10.0, 5)], "x double, k int").select(ST.chi2_sf_even("x", "k").alias("p")).collect()
    for (x, k), r in zip([(3.0, 1), (3.0, 2), (10.0, 5)], got, strict=True):
        assert r.p == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k)))


def test_majority_ties(spark):
    rows = [(1, 7, 0), (1, 7, 0), (1, 3, 1), (1, 3, 0), (2, 5, 0), (2, 4, 0), (3, 9, 1)]
    df = spark.createDataFrame(rows, "obs_id int, label int, origin int")
    assert {r.obs_id: r.label for r in segment.majority(df).collect()} == {1: 3, 2: 4, 3: 9}


def test_segment_metrics_by_hand(spark):
    x = spark.createDataFrame([(0, "g", 1.0), (1, "g", 3.0), (2, "g", 5.0)], "obs_id long, gene string, value double")
    seg = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1)], "side int, obs_id long, seg long")
    b = spark.createDataFrame([(1, 0, 1, 2.0)], "side int, i long, j long, weight double")
    m = compare.segment_metrics(x, seg, b, ["side"]).first()
    # means 2 and 2.5, grand 2.25
    assert m.within_var == pytest.approx((1 + 1 + 6.25 + 6.25) / 4)
    assert m.between_var == pytest.approx(0.0625)
    assert m.r2 == pytest.approx(0.0625 / (3.625 + 0.0625))
    assert m.neighbor_contrast == pytest.approx(0.5)
    assert m.top10_mass == pytest.approx(5 / 9)
    assert m.segment_moran == pytest.approx(-1.0)


def test_mann_whitney_brute_force(spark):
    values = {0: 3.0, 1: 3.0, 2: 1.0, 5: 2.0, 6: 3.0, 8: 1.0}
    groups = ["a"] * 4 + ["b"] * 6
    x = spark.createDataFrame([(k, "g", v) for k, v in values.items()], "obs_id long, gene string, value double")
    obs = spark.createDataFrame(list(enumerate(groups)), "obs_id long, celltype string")
    got = {r.celltype: r for r in enrich.mann_whitney(x, obs, 2).collect()}
    full = [values.get(i, 0.0) for i in range(10)]
    u = sum((p > q) + 0.5 * (p == q) for p in full[:4] for q in full[4:])
    assert got["a"].u == pytest.approx(u)
    assert got["b"].u == pytest.approx(24 - u)


def test_concentration_curve(spark):
    t = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([4, 3, 2, 1])], "gene string, seg int, v double")
    r = compare.concentration(t, []).first()
    assert (r.top_mass, r.half_share, r.effective) == (pytest.approx(0.4), pytest.approx(0.5), pytest.approx(100 / 30))


def test_grid_outliers_drop_everything_when_counts_are_equal(spark):
    assert spatial.grid_outliers(lattice(spark), 1.0).count() == 0


def test_nearest_widens_its_search(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 101.0, 0.0)], "obs_id long, x double, y double")
    got = {r.id: (r.other, r.dist) for r in spatial.nearest(p, p, 1, 1.0, keep_self=False).collect()}
    assert got == {0: (1, 100.0), 1: (2, 1.0), 2: (1, 1.0)}


def test_nearest_serves_points_far_apart(spark):
    at = [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 2.0), (3, 5_000.0, 0.0), (4, 5_000.0, 7_000.0), (5, -3_000.0, 3_000.0)]
    p = spark.createDataFrame(at, "obs_id long, x double, y double")
    for k, keep in ((2, False), (3, True), (9, False)):
        want = {(i, o, n) for i, x, y in at for n, (_, o) in enumerate(sorted((math.dist((x, y), (u, v)), o) for o, u, v in at if keep or o != i)[:k], 1)}
        assert {(r.id, r.other, r.place) for r in spatial.nearest(p, p, k, 1.0, keep_self=keep).collect()} == want
    other = p.withColumn("obs_id", F.col("obs_id") + 10)
    assert spatial.nearest(other, p, 6, 1.0, keep_self=False).count() == 36
    nowhere = spark.createDataFrame([(7, None, 1.0), (8, float("nan"), 1.0)], p.schema)
    assert {r.id for r in spatial.nearest(p.unionByName(nowhere), p.unionByName(nowhere), 1, 1.0, keep_self=False).collect()} == {0, 1, 2, 3, 4, 5}


def test_components_and_morphology(spark):
    px = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (5, 6), (5, 7)], "px long, py long")
    ids = px.select((F.col("px") * F.lit(1 << 31) + F.col("py")).cast("long").alias("id"))
    sizes = sorted(r["count"] for r in graph.components(raster.pixel_edges(px), ids).groupBy("component").count().collect())
    assert sizes == [2, 3]
    assert raster.erode(raster.dilate(px)).join(px, ["px", "py"]).count() == 5


def test_scalars(spark):
    r = spark.range(1).select(
        S.nice_at_least(F.lit(13.0)).alias("nice"),
        S.resolution_of(F.lit("rank_r16_c0.5")).alias("res"),
        S.compactness_of(F.lit("rank_r16_c0.5")).alias("comp"),
        S.token(F.lit(" a b/c ")).alias("token"),
        S.token(F.lit("NaN")).alias("none"),
        S.clean_candidates(F.array(F.lit(3.0), F.lit(1.0), F.lit(3.0), F.lit(99.0)), 0.0, 10.0).alias("cand"),
        S.segment_count(F.lit(1000), 5.0, 1.0).alias("n"),
    ).first()
    assert (r.nice, r.res, r.comp, r.token, r.none, r.cand, r.n) == (20.0, 16.0, 0.5, "a_b_c", None, [1.0, 3.0, 10.0], 40)


def test_scale_clusters_are_named_by_size():
    scales = [1.0, 2.0, 8.0, 9.0, 40.0, 41.0]
    d = [(a, b, abs(math.log(a) - math.log(b))) for a in scales for b in scales]
    assert scale.cluster_scales(d, 3) == {1.0: "fine", 2.0: "fine", 8.0: "mid", 9.0: "mid", 40.0: "coarse", 41.0: "coarse"}


def test_permutations_do_not_depend_on_partitions(spark):
    x = spark.createDataFrame([(i, "g", float(i % 5)) for i in range(60)], "obs_id long, gene string, value double")
    o = spark.createDataFrame([(i, "a" if i % 5 == 4 else "b") for i in range(60)], "obs_id long, celltype string")
    a = enrich.permutation(x, o, "a", 30).first()
    b = enrich.permutation(x.repartition(7), o.repartition(3), "a", 30).first()
    assert a == b
    assert a.pvalue == pytest.approx(1 / 31)


def test_index_without_path_raises(spark, tmp_path):
    (tmp_path / "segments_index").mkdir()
    (tmp_path / "segments_index" / "a.csv").write_text("scale_id,mode,resolution,compactness,seconds,path\nr1,native,1,0.5,1,\n")
    with pytest.raises(Exception, match="without scale_id or path"):
        formats.read_index(spark, f"file://{tmp_path}").collect()


def test_streamed_sums_equal_batch_sums(spark, tmp_path):
    df = spark.createDataFrame([("s1", "g", 1.0), ("s1", "g", 2.0), ("s2", "g", 4.0)], "seg string, gene string, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = incremental.running_bulk(stream, ["seg", "gene"]).writeStream.format("memory").queryName("bulk").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("bulk").collect())) == [("s1", "g", 3.0, 2), ("s2", "g", 4.0, 1)]


def test_unknown_coordinates_raise(spark):
    with pytest.raises(KeyError):
        spatial.resolve_coordinates(spark.range(3))
    got = spatial.resolve_coordinates(spark.createDataFrame([("1.5", "2"), ("x", "1"), ("NaN", "1")], "array_col string, array_row string"))
    assert [(r.x, r.y) for r in got.collect()] == [(1.5, 2.0)]
