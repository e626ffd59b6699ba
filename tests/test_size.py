"""Joins and queries at sizes that the smallest tables do not show."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import autocorr, enrich, graph, matrix, segment, spatial
from tessella.plans import summaries
from tessella.plans import views as V
from tessella.plans.catalogue import ORACLES, QUERIES
from tessella.sources.storage import cut

from test_queries import TABLES, rows


def chosen(df) -> str:
    """The plan before any of it runs."""
    return df._jdf.queryExecution().sparkPlan().toString()


def grown(spark, sf):
    """Plans over tables that grow with the input, by the query that needs them."""
    o, x, seg, e = V.obs(spark, sf), V.expr(spark, sf), V.segments(spark, sf), V.edges(spark, sf)
    yield "f6_f14_tier_override", matrix.pseudo_bulk(x, seg, ["side", "seg"])
    yield "d15_top_set_jaccard", graph.collapse(e, seg, ["side"])
    v = o.select("obs_id", F.col("bal").alias("value"), (F.col("celltype") == "BUILDING").cast("int").alias("label"), F.col("batch").alias("block"))
    yield "k11_m1_custom_statistic", v.transform(_null, F.median("value"))
    yield "k11_block_permutation", v.transform(_null, None)


def _null(v, stat):
    return enrich.block_permutation(v, 3, statistic=stat)


GROWN = ["f6_f14_tier_override", "d15_top_set_jaccard", "k11_m1_custom_statistic", "k11_block_permutation"]


@pytest.mark.parametrize("name", GROWN)
def test_growing_rows_are_not_broadcast(spark, sf, name):
    assert "BroadcastHashJoin" not in chosen(dict(grown(spark, sf))[name])


def test_effects_do_not_broadcast_entities(spark, sf):
    """k7_enrichment_by_scale_group."""
    assert "BroadcastHashJoin [obs_id" not in chosen(enrich.effects(V.expr(spark, sf), V.obs(spark, sf)))


def test_effects_of_a_stored_table_do_not_broadcast_entities(spark, sf):
    """k7_gene_sets_by_scale_group."""
    assert "BroadcastHashJoin [obs_id" not in chosen(enrich.effects(cut(V.expr(spark, sf), "expr"), V.obs(spark, sf)))


def test_effects_read_entities_once(spark, sf):
    """k7_enrichment_by_scale_group, k7_gene_sets_by_scale_group: sums by gene and group are stored before they are read twice."""
    assert "l_quantity" not in chosen(enrich.effects(V.expr(spark, sf), V.obs(spark, sf)))


def test_moran_does_not_broadcast_segments(spark, sf):
    """d18_scale_columns."""
    seg = V.segments(spark, sf)
    x = autocorr.bulk_at_scales(V.expr(spark, sf), seg, ["side"])
    n = seg.groupBy("side").agg(F.count_distinct("seg").cast("double").alias("n"))
    plan = chosen(autocorr.moran(x, graph.collapse(V.edges(spark, sf), seg, ["side"]), n, ["side"]))
    assert not [r for r in plan.splitlines() if "BroadcastHashJoin" in r and ("seg" in r or "i#" in r or "j#" in r or "obs_id" in r)]


def test_bulk_for_residuals_does_not_broadcast_segments(spark, sf):
    """j1_residual_bulk."""
    assert "BroadcastHashJoin [obs_id" not in chosen(autocorr.bulk_at_scales(V.expr(spark, sf), V.segments(spark, sf), ["side"]))


def test_near_points_are_not_broadcast(spark, sf):
    """j29_voronoi_tiles."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))
    a, b = c.select("id", F.col("x").alias("xa"), F.col("x").alias("ya")), c.select(F.col("id").alias("other"), F.col("x").alias("xb"), F.col("x").alias("yb"))
    assert "BroadcastHashJoin" not in chosen(spatial._near(a, b, 1.0))


def test_disagreement_does_not_broadcast_members(spark, sf):
    """e30_compactness_metrics."""
    m = V.segments(spark, sf)
    assert "BroadcastHashJoin" not in chosen(segment.neighbour_disagreement(m, V.edges(spark, sf), ["side"]))


def test_candidates_do_not_broadcast_members(spark, sf):
    """f25_f26_compactness_choice."""
    assert "BroadcastHashJoin [obs_id" not in chosen(summaries._compact(spark, sf))


def test_lloyd_does_not_compare_every_point_with_every_centre(spark):
    """j13_j14_lloyd: by brute force, with ties, a missing feature and a missing centre."""
    rng = np.random.default_rng(5)
    p = rng.integers(0, 12, (600, 2)).astype(float)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(600, None, 1.0)], "obs_id long, x double, y double")
    centres = points.where("obs_id % 10 = 0").select(F.col("obs_id").alias("seg"), "x", "y")
    got = segment.lloyd(points, ["x", "y"], centres, 0)
    assert "NestedLoop" not in chosen(got)
    d = ((p[:, None, :] - p[None, ::10, :]) ** 2).sum(axis=2)
    want = dict(enumerate((d.argmin(axis=1) * 10).tolist())) | {600: 0}
    assert {r.obs_id: r.seg for r in got.collect()} == want


GAINS = ["b34_gain_percent", "e11_gains", "e12_gain_summary", "e14_tidy_summary"]


@pytest.mark.parametrize("name", GAINS)
def test_gains_compute_the_measurements_once(spark, sf, monkeypatch, name):
    calls, expr = [], V.expr
    monkeypatch.setattr(V, "expr", lambda *a: calls.append(a) or expr(*a))
    assert "l_quantity" not in chosen(QUERIES[name](spark, sf)) and len(calls) == 1


@pytest.mark.parametrize("name", GAINS)
def test_gains_on_a_tall_lattice_equal_sql(spark, sf, tmp_path, name):
    c = duckdb.connect()
    for t in TABLES:
        key = {"customer": "c_custkey", "orders": "o_custkey"}.get(t)
        moved = f" replace ({key} + 200000 AS {key})" if key else ""
        c.sql(f"copy (select *{moved} from '{sf}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(ORACLES[name]).df())
