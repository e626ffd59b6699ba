"""Operators without SQL against brute force, closed forms and planted structure."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import settings
from tessella.operators import cluster, compare, embed, enrich, graph, raster, scale, search, tiles
from tessella.sources import formats


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "obs_id long, x double, y double")


def test_communities_are_found(spark):
    edges, truth, at = [], {}, 0
    for c, n in enumerate((6, 5, 7)):
        ids = range(at, at + n)
        edges += [(a, b, 1.0) for a, b in itertools.combinations(ids, 2)]
        truth |= {i: at for i in ids}
        at += n
    edges += [(0, 6, 1.0), (7, 11, 1.0), (3, 3, 5.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r.id: r.cluster for r in cluster.communities(df, rounds=10, levels=3).collect()}
    assert got == truth
    assert cluster.communities(df.limit(0)).count() == 0


def test_modularity_of_two_pairs(spark):
    w = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "i long, j long, weight double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "id long, cluster long")
    assert cluster.modularity(w, labels) == pytest.approx(0.5)


def test_voronoi_areas_equal_cells_cut_by_all_others(spark):
    rng = np.random.default_rng(3)
    rows = rng.random((40, 2)) * 10
    got = {r.obs_id: r.area for r in tiles.voronoi_areas(points(spark, rows), 1.0, k=4).collect()}
    corners = {tuple(c) for c in tiles.hull(rows).tolist()}
    inside = [i for i in range(40) if tuple(rows[i].tolist()) not in corners]
    assert sorted(got) == inside
    for i in inside:
        others = np.delete(rows, i, axis=0)
        near = np.argsort(((others - rows[i]) ** 2).sum(axis=1))
        assert got[i] == pytest.approx(tiles._cell(*rows[i], others[near, 0], others[near, 1], 1e7)[0], rel=1e-9)


def test_voronoi_areas_of_a_lattice(spark):
    rows = [(i, j) for i in range(6) for j in range(5)]
    got = {r.obs_id: r.area for r in tiles.voronoi_areas(points(spark, rows), 1.0).collect()}
    assert sorted(got) == [k for k, (i, j) in enumerate(rows) if 0 < i < 5 and 0 < j < 4] and all(a == pytest.approx(1.0) for a in got.values())
    assert tiles.voronoi_areas(points(spark, [(0, 0), (1, 1), (2, 2)]), 1.0).count() == 0


def test_collisions_equal_offset_by_offset_search(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(6)) for _ in range(60)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "obs_id long, cx long, cy long")
    got = {r.obs_id: (r.cx, r.cy, r.moved) for r in tiles.resolve_collisions(df, 7, 6, 2).collect()}
    want, taken, left = {}, set(), []
    for i, p in enumerate(rows):
        if p in taken:
            left.append(i)
        else:
            taken.add(p)
            want[i] = (*p, False)
    for dx, dy in tiles.collision_offsets(2):
        asked = {}
        for i in left:
            q = (rows[i][0] + dx, rows[i][1] + dy)
            if 0 <= q[0] < 7 and 0 <= q[1] < 6 and q not in taken:
                asked.setdefault(q, i)
        for q, i in asked.items():
            taken.add(q)
            want[i] = (*q, True)
        left = [i for i in left if i not in want]
    want |= {i: (*rows[i], False) for i in left}
    assert got == want


def flood(mask):
    """Cells that no path of empty cells joins to the outside."""
    h, w = mask.shape
    big = np.pad(mask, 1)
    out, todo = np.zeros_like(big, bool), [(0, 0)]
    while todo:
        i, j = todo.pop()
        if 0 <= i < h + 2 and 0 <= j < w + 2 and not out[i, j] and not big[i, j]:
            out[i, j] = True
            todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return ~out[1:-1, 1:-1]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_holes_are_filled_as_by_flooding(spark, seed):
    mask = np.random.default_rng(seed).random((9, 11)) < 0.62
    df = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(mask), strict=True)], "px long, py long")
    got = sorted(map(tuple, raster.filled(df).collect()))
    assert got == sorted((int(i), int(j)) for i, j in zip(*np.nonzero(flood(mask)), strict=True))


def test_support_mask_drops_small_parts(spark):
    ring = [(i, j) for i in range(5) for j in range(5) if not (1 <= i <= 3 and 1 <= j <= 3)]
    df = spark.createDataFrame([*ring, (20, 20), (20, 21)], "px long, py long")
    got = sorted(map(tuple, raster.regularise(df, 1, True, 10).collect()))
    assert got == sorted((i, j) for i in range(5) for j in range(5))
    assert raster.regularise(df, 0, False, 17).count() == 0


@pytest.mark.parametrize("t", [0.5, 7.0, 100.0])
def test_heat_kernel_equals_matrix_exponential(spark, t):
    rng = np.random.default_rng(5)
    n = 7
    w = np.triu(rng.random((n, n)) < 0.6, 1) * rng.random((n, n))
    w[0, 1:] = 0.2
    w = w + w.T
    p = w / w.sum(axis=1, keepdims=True)
    x = rng.normal(size=n)
    values, vectors = np.linalg.eig(p - np.eye(n))
    want = (vectors @ np.diag(np.exp(t * values)) @ np.linalg.inv(vectors) @ x).real
    v = spark.createDataFrame([(i, 0, float(x[i])) for i in range(n)], "obs_id long, dim int, value double")
    e = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src long, dst long, weight double")
    got = {r.obs_id: r.value for r in graph.heat(v, e, t).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(want.tolist(), abs=1e-6)


@pytest.mark.parametrize("limit", [1024, 0])
def test_components_equal_a_decomposition(spark, limit):
    rng = np.random.default_rng(6)
    m = (rng.random((40, 9)) < 0.5) * rng.gamma(2.0, size=(40, 9)) * np.linspace(1, 4, 9)
    m[7] = 0  # an entity without any value
    x = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(40) for j in range(9) if m[i, j]], "obs_id long, gene string, value double")
    scores, loadings = embed.components(x, 40, 3, gram_genes=limit)
    _, _, vt = np.linalg.svd(m - m.mean(axis=0))
    for j in range(3):
        v = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        got = {r.gene: r.loading for r in loadings.where(F.col("pc") == j).collect()}
        assert [got[f"g{i}"] for i in range(9)] == pytest.approx(v.tolist(), abs=1e-4)
        at = {r.obs_id: r.value for r in scores.where(F.col("pc") == j).collect()}
        want = (m - m.mean(axis=0)) @ v
        assert [at[i] for i in sorted(at)] == pytest.approx([want[i] for i in sorted(at)], abs=1e-3)


def test_non_negative_factors_equal_the_updates_on_arrays(spark):
    rng = np.random.default_rng(7)
    m = (rng.random((30, 6)) < 0.8) * (rng.random((30, 2)) @ rng.random((2, 6)))
    m[:, 0] += 0.1
    x = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(30) for j in range(6) if m[i, j]], "obs_id long, gene string, value double")
    w = np.array([[0.5 + int(hashlib.md5(f"0|{i}|{j}".encode()).hexdigest()[:8], 16) / 16**8 for j in range(2)] for i in range(30)])
    h = np.random.default_rng(0).random((2, 6)) + 0.1
    first = np.abs(w @ h - m).sum()
    for _ in range(6):
        w *= (m @ h.T) / (w @ h @ h.T + 1e-12)
        last = h
        h = h * (w.T @ m) / (w.T @ w @ h + 1e-12)
    got = np.zeros((30, 2))
    for r in embed.non_negative(x, 2, steps=6).collect():
        got[r.obs_id, r.pc] = r.value
    assert got == pytest.approx(w, abs=1e-9) and (got >= 0).all() and np.abs(w @ last - m).sum() < first / 2


def test_embeddings_by_name(spark):
    rng = np.random.default_rng(12)
    m = (rng.random((20, 8)) < 0.7) * rng.integers(1, 9, (20, 8)).astype(float)
    x = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(20) for j in range(8) if m[i, j]], "obs_id long, gene string, value double")
    t = spark.createDataFrame([(i % 5, i // 5, i) for i in range(19)], "px long, py long, obs_id long")
    some = m[:19]
    logged = np.log1p(some * 1e4 / some.sum(axis=1, keepdims=True))
    c = logged - logged.mean(axis=0)
    v = np.linalg.svd(c)[2][0]
    s = c @ (v * np.sign(v[np.abs(v).argmax()]))
    got = {r.obs_id: r for r in embed.generate(x, t, dimensions=2).where("pc = 0").collect()}
    assert [got[i].value for i in range(19)] == pytest.approx(((s - s.min()) / (s.max() - s.min())).tolist(), abs=1e-6)
    assert all((r.px, r.py) == (i % 5, i // 5) for i, r in got.items())
    for method, norm in (("lsi", "tf_idf"), ("nmf", "none"), ("loadings", "log_norm"), ("pca_uncentred", "log_norm")):
        rows = embed.generate(x, t, method, norm, 2, n_top=6).collect()
        assert len(rows) == 38 and all(0 <= r.value <= 1 for r in rows), method
    with pytest.raises(ValueError):
        embed.generate(x, t, "umap")


def grid_rows(spark):
    rng = random.Random(8)
    p = spark.createDataFrame([(i * 12 + j, i, j, rng.random()) for i in range(12) for j in range(12)], "obs_id long, x long, y long, b double")
    e = [(i * 12 + j, i * 12 + j + 1, 1.0) for i in range(12) for j in range(11)] + [(i * 12 + j, i * 12 + 12 + j, 1.0) for i in range(11) for j in range(12)]
    return p, spark.createDataFrame(e, "src long, dst long, weight double")


def squares(points, c):
    side = 1 + round(c * 20)
    return points.select("obs_id", (F.floor(F.col("x") / side) * 100 + F.floor(F.col("y") / side)).alias("seg"))


def test_auto_search_goes_from_broad_to_fine(spark):
    p, e = grid_rows(spark)
    best, rows = search.resolve(p, e, squares, ["b"], "auto", candidates=[0.05, 0.1, 0.2])
    got = rows.collect()
    coarse = [r for r in got if r.search_stage == "coarse"]
    first = next(r.compactness for r in coarse if r.is_stage_selected)
    assert [r.compactness for r in sorted(coarse, key=lambda r: r.compactness)] == [0.05, 0.1, 0.2]
    fine = sorted(r.compactness for r in got if r.search_stage == "refine")
    want = sorted({round(c, 12): c for c in [0.05, 0.1, 0.2, *search.refine([0.05, 0.1, 0.2], first)]}.values())
    assert fine == pytest.approx(want) and sum(r.is_selected for r in got if r.search_stage == "refine") == 1
    # the choice is the best penalised score among those near the best score
    judged = [r for r in got if r.search_stage == "refine"]
    near = [r for r in judged if r.score <= min(x.score for x in judged) + max(0.01, 0.1 * (max(x.score for x in judged) - min(x.score for x in judged)))]
    assert best == min(near, key=lambda r: (r.penalised, r.compactness)).compactness


def test_multifidelity_ends_with_all_points(spark):
    p, e = grid_rows(spark)
    best, rows = search.resolve(p, e, squares, ["b"], "multifidelity", candidates=[0.05, 0.1, 0.2, 0.4], stages=(0.5, 1.0))
    got = rows.collect()
    assert {r.search_stage for r in got} == {"stage1", "stage2"}
    last = [r for r in got if r.search_stage == "stage2"]
    assert best in [r.compactness for r in last] and max(r.segments for r in last) <= 144


def test_candidate_lists():
    assert search.clean([0.3, float("nan"), -1, 0.3, 5], hi=1.0) == [0.3, 1]
    assert search.refine([0.1, 0.2, 0.4], 0.19) == pytest.approx([0.1 * 4 ** (i / 6) for i in range(7)])
    assert search.refine([0.1], 0.1)[0] == pytest.approx(0.1 / 1.8)
    stage = search.refine_stage([0.1, 0.2, 0.4, 0.8], {0.1: 3.0, 0.2: 1.0, 0.4: 2.0, 0.8: 4.0}, 0.2, 1)
    assert {0.1, 0.2, 0.4} <= set(stage) and min(stage) == pytest.approx(0.1 / 1.35) and max(stage) == pytest.approx(0.4 * 1.35)
    assert search.scheduled(0.5, "scaled", 200.0, 100.0, 1.0) == 1.0 and search.scheduled(None, "fixed", lo=2.0) == 2.0
    assert search.rescale(0.5, 100.0, 400.0, 0.5) == 1.0
    with pytest.raises(ValueError):
        search.scheduled(0.5, "scaled", 200.0, 0.0)


def test_search_modes_without_a_segmenter(spark):
    p, e = grid_rows(spark)
    assert search.resolve(p, e, None, ["b"], "fixed", 0.7) == (0.7, None)
    with pytest.raises(ValueError):
        search.resolve(p, e, None, ["b"], "auto")


def test_calls_group_the_scales(spark):
    fine, coarse = [f"f{i}" for i in range(6)], [f"c{i}" for i in range(6)]
    rows = []
    for s in (1.0, 2.0, 16.0, 32.0):
        order = fine + coarse if s < 10 else coarse + fine
        rows += [(g, s, k + 1, 1 - k / 12) for k, g in enumerate(order) if not (g == "c5" and s == 1.0)]
    long = spark.createDataFrame(rows, "gene string, scale double, rank int, score double")
    got = {r.gene: r for r in scale.call_scale_specific(long, 6, 2, good=0.5, gap=0.2).collect()}
    assert all(got[g].grp == "g1" and got[g].called for g in fine) and all(got[g].grp == "g2" and got[g].called for g in coarse)
    # c5 is imputed with the number of genes at the scale where it is missing
    assert got["c5"].median == pytest.approx(6 / 12) and got["c5"].lead == pytest.approx(12 / 12 - 6 / 12)
    moved = {r.gene: r.grp for r in scale.call_scale_specific(long, 6, 2, {16.0: "g1", 32.0: "g3"}, good=0.5, gap=0.2).collect()}
    assert moved["c0"] == "g3"


def test_panels_without_genes_raise(spark):
    genes = spark.createDataFrame([("a",), ("b",)], "gene string")
    ok = spark.createDataFrame([("p", "a"), ("p", "x"), ("q", "b")], "panel string, gene string")
    assert sorted(map(tuple, compare.resolve_markers(ok, genes).collect())) == [("p", "a"), ("q", "b")]
    with pytest.raises(Exception, match="no gene of the panel"):
        compare.resolve_markers(ok.union(spark.createDataFrame([("r", "y")], ok.schema)), genes).collect()


def test_missing_ranks_are_filled_in_four_ways(spark):
    long = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("a", 2, 5)], "gene string, scale int, rank int")

    def at(mode):
        return {(r.gene, r.scale): r["rank"] for r in scale.fill_for_plot(long, mode).collect()}.get(("b", 2))

    assert (at("worst"), at("global_worst"), at(9), at("keep"), at(None)) == (6, 6, 9.0, None, None)


def test_columns_of_scales_are_found():
    assert scale.find_column(["gene", "rank_r5"], "r5") == "rank_r5" and scale.find_column(["res_5"], "r5") == "res_5"
    assert scale.find_column(["r16"], "res_16") == "r16" and scale.find_column(["rank_16"], "16") == "rank_16" and scale.find_column(["x"], "r1") is None


def test_settings_come_from_the_session_first(spark, monkeypatch):
    assert settings.get(spark, "density_factor") == 1.0
    monkeypatch.setenv("TESSELLA_DENSITY_FACTOR", "0.5")
    assert settings.get(spark, "density_factor") == 0.5
    spark.conf.set("spark.tessella.density_factor", "2")
    assert settings.get(spark, "density_factor") == 2.0
    spark.conf.unset("spark.tessella.density_factor")
    with pytest.raises(KeyError):
        settings.get(spark, "nothing")


def test_pitch_is_for_cells(spark):
    p = points(spark, [(i, j) for i in range(5) for j in range(5)])
    with pytest.raises(ValueError):
        tiles.resolve_pitch(p)
    assert tiles.resolve_pitch(p, "xenium", cell=1.0) == pytest.approx(1.0)
    assert tiles.target_size(2.0, 9) == 6.0


def test_native_index_rows(spark):
    one = spark.createDataFrame([("r1", "true")], "scale_id string, native_identity string")
    assert formats.with_native(one).first().native


def test_map_of_the_self_organising_map_is_ordered(spark):
    rng = np.random.default_rng(9)
    rows = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    got = cluster.som(points(spark, rows), ["x", "y"], 2, 6, 0.5).collect()
    by = [{r.node for r in got if 20 * k <= r.obs_id < 20 * k + 20} for k in range(4)]
    assert all(len(b) == 1 for b in by)
    assert math.isclose(len(set().union(*by)), 4, abs_tol=1)


def test_latent_semantic_indexing_equals_a_decomposition(spark):
    rng = np.random.default_rng(10)
    m = (rng.random((30, 6)) < 0.6) * rng.integers(1, 9, (30, 6)).astype(float)
    m[:, 0] += 1
    x = spark.createDataFrame([(i, f"g{j}", float(m[i, j])) for i in range(30) for j in range(6) if m[i, j]], "obs_id long, gene string, value double")
    t = m / m.sum(axis=1, keepdims=True) * np.log(1 + 30 / (1 + (m > 0).sum(axis=0)))
    _, _, vt = np.linalg.svd(t, full_matrices=False)
    got = embed.latent_semantic(x, 30, 2).collect()
    for j in (1, 2):
        v = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        s = t @ v
        at = {r.obs_id: r.value for r in got if r.pc == j}
        assert [at[i] for i in range(30)] == pytest.approx(((s - s.min()) / (s.max() - s.min())).tolist(), abs=1e-6)


def test_gene_sets_of_scale_groups_against_lists(spark):
    rng = random.Random(11)
    genes = [f"g{i:02d}" for i in range(24)]
    mean = {g: 1.0 + i for i, g in enumerate(genes)}
    fc = {(g, c): rng.gauss(0, 1) for g in genes for c in ("a", "b")}
    m = spark.createDataFrame(list(mean.items()), "gene string, mean double")
    e = spark.createDataFrame([(g, c, v) for (g, c), v in fc.items()], "gene string, celltype string, log2_fc double")
    sets = spark.createDataFrame([("fine", g) for g in genes[:5]] + [("coarse", g) for g in genes[10:20]], "grp string, gene string")
    got = {(r.grp, r.celltype): r for r in enrich.sets_by_scale_group(sets, e, m, 30, 2).collect()}
    for grp, own in (("fine", genes[:5]), ("coarse", genes[10:20])):
        bins = {g: min(int((i + 1) / 24 * 2), 1) for i, g in enumerate(genes)}
        draws = []
        for k in range(1, 31):
            one = []
            for b in (0, 1):
                pool = sorted((g for g in genes if bins[g] == b and g not in own), key=lambda g: hashlib.md5(f"0|{k}|{g}".encode()).hexdigest())
                one += pool[: sum(bins[g] == b for g in own)]
            draws.append(one)
        for c in ("a", "b"):
            seen = sum(fc[g, c] for g in own) / len(own)
            null = [sum(fc[g, c] for g in d) / len(d) for d in draws]
            r = got[grp, c]
            assert r.observed == pytest.approx(seen) and r.pvalue == pytest.approx((sum(v >= seen for v in null) + 1) / 31)
            assert r.z == pytest.approx((seen - np.mean(null)) / np.std(null))
