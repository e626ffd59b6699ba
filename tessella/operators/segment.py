"""Segment labels: packing, majorities, integrity, compactness scores, k-means and SLIC-like clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.stats import quantile
from tessella.sources.storage import cut, many, ship


def pack_labels(df: DataFrame, label: str = "label", by: list[str] = ()) -> DataFrame:
    """Observed labels numbered 0 .. k-1 in ascending order; negative labels stay -1."""
    distinct = df.where(F.col(label) >= 0).select(*by, label).distinct()
    numbered = distinct.withColumn("packed", (F.row_number().over(W.partitionBy(*by).orderBy(label)) - 1).cast("long"))
    return df.join(numbered, [*by, label], "left").withColumn("packed", F.coalesce("packed", F.lit(-1).cast("long")))


def majority(rows: DataFrame, key: str = "obs_id", label: str = "label", origin: str = "origin") -> DataFrame:
    """Most frequent label of each key; ties by number of origin rows, then by the smallest label."""
    n = rows.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), F.sum(origin).alias("o"))
    w = W.partitionBy(key).orderBy(F.desc("n"), F.desc("o"), label)
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, label, "n", "o")


def aggregate_members(members: DataFrame, key: list[str], numeric: list[str], categorical: list[str], first: str | None = None, order: str = "obs_id") -> DataFrame:
    """Means of numbers, modes of categories (ties: smallest), the first member's value of ``first``."""
    aggs = [F.avg(c).alias(c) for c in numeric]
    if first:
        aggs.append(F.min_by(first, order).alias(first))
    out = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *aggs)
    for c in categorical:
        n = members.where(F.col(c).isNotNull()).groupBy(*key, c).agg(F.count(F.lit(1)).alias("_c"))
        top = n.groupBy(*key).agg(F.min_by(c, F.struct(-F.col("_c"), F.col(c))).alias(c))
        out = out.join(top, key, "left")
    return out


def segment_scores(members: DataFrame, key: str, value: str, how: str = "mean") -> DataFrame:
    """Mean (or sum) by segment, its size, and its z-score over segments; members without segment are left out."""
    agg = F.avg(value) if how == "mean" else F.sum(value)
    s = members.where(F.col(key).isNotNull()).groupBy(key).agg(agg.alias("score"), F.count(F.lit(1)).alias("n"))
    m = s.agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    return s.crossJoin(F.broadcast(m)).withColumn("z", F.try_divide(F.col("score") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def sizes(members: DataFrame, by: list[str], key: str = "seg") -> DataFrame:
    """Size distribution of each segmentation: number, mean, median, 5 % and 95 %, population CV."""
    s = members.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), F.avg("n").alias("mean"), quantile("n", 0.5).alias("median"), quantile("n", 0.05).alias("p05"), quantile("n", 0.95).alias("p95"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("cv"))


def compactness_metrics(members: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Size-weighted within-segment variance (mean over dimensions), mean log aspect and size CV of each candidate.  ``members``: by, seg, x, y, values."""
    vx, vy, c = F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")
    half, root = (vx + vy) / 2, F.sqrt(F.pow((vx - vy) / 2, 2.0) + c * c)
    aspect = F.log(F.sqrt((half + root) / F.greatest(half - root, F.lit(1e-9))))
    var = sum((F.var_pop(v) for v in values[1:]), F.var_pop(values[0])) / len(values)
    s = members.groupBy(*by, "seg").agg(F.count(F.lit(1)).alias("n"), var.alias("var"), F.when(F.count(F.lit(1)) > 2, aspect).alias("aspect"))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("segments"), (F.sum(F.col("var") * F.col("n")) / F.sum("n")).alias("embedding_var"), F.avg("aspect").alias("mean_log_aspect"), (F.stddev_pop("n") / F.avg("n")).alias("size_cv"))


def neighbour_disagreement(members: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Share of edges whose ends lie in different segments."""
    a = members.select(*by, F.col("obs_id").alias("src"), F.col("seg").alias("sa"))
    b = members.select(*by, F.col("obs_id").alias("dst"), F.col("seg").alias("sb"))
    return many(edges).select("src", "dst").join(many(a), "src").join(many(b), ["dst", *by]).groupBy(*by).agg(F.avg((F.col("sa") != F.col("sb")).cast("double")).alias("neighbor_disagreement"))


def compactness_scores(m: DataFrame) -> DataFrame:
    """Score of every candidate: fidelity against regularity by the harmonic mean of what each preserves.

    Costs are scaled over all candidates; regularity mixes aspect, size CV and disagreement 0.30 : 0.35 : 0.35 over those not null.
    """
    cols = ["embedding_var", "mean_log_aspect", "size_cv", "neighbor_disagreement"]
    ends = m.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    x = m.crossJoin(F.broadcast(ends))

    def unit(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return (F.col(c) - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)

    w = {"mean_log_aspect": 0.30, "size_cv": 0.35, "neighbor_disagreement": 0.35}
    total = sum((F.when(F.col(c).isNotNull(), v).otherwise(0.0) for c, v in w.items()), F.lit(0.0))
    cost = sum((F.coalesce(unit(c) * v, F.lit(0.0)) for c, v in w.items()), F.lit(0.0))
    x = x.withColumn("fidelity_cost", unit("embedding_var")).withColumn("regularity_cost", F.try_divide(cost, total))
    f, r = 1 - F.col("fidelity_cost"), 1 - F.col("regularity_cost")
    x = x.withColumn("tradeoff_gain", F.coalesce(F.try_divide(2 * f * r, f + r), F.lit(0.0))).withColumn("score", 1 - F.col("tradeoff_gain"))
    return x.drop(*[f"_{n}_{c}" for c in cols for n in ("lo", "hi")])


def select_compactness(scored: DataFrame, schedule: float | None, slack: float = 0.1, floor: float = 0.01) -> DataFrame:
    """Candidates near the best score (by ``slack`` of the range, at least ``floor``) with penalties 0.02 quadratic towards the ends and 0.03 |ln(c / schedule)|; the selected one is flagged, ties go to the one nearest the schedule.  Without a schedule there is no such penalty."""
    ends = scored.agg(F.min("score").alias("_b"), F.max("score").alias("_w"), F.min("compactness").alias("_lo"), F.max("compactness").alias("_hi"))
    x = scored.crossJoin(F.broadcast(ends))
    at = (F.col("compactness") - F.col("_lo")) / F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    away = F.lit(0.0) if schedule is None else F.abs(F.log(F.col("compactness") / schedule))
    x = x.withColumn("near", F.col("score") <= F.col("_b") + F.greatest(F.lit(floor), slack * (F.col("_w") - F.col("_b"))))
    x = x.withColumn("penalised", F.col("score") + 0.02 * F.pow(2 * at - 1, 2.0) + 0.03 * away).withColumn("away", away)
    best = x.where("near").agg(F.min_by("compactness", F.struct("penalised", "away", "compactness")).alias("_c"))
    return x.crossJoin(F.broadcast(best)).withColumn("selected", F.col("compactness") == F.col("_c")).drop("_b", "_w", "_lo", "_hi", "_c")


def lloyd(points: DataFrame, features: list[str], centres: DataFrame, steps: int, cut_every: int = 2) -> DataFrame:
    """k-means with given centres (``seg`` and the features): nearest centre (ties: smallest seg), means, ``steps`` times.

    The centres are a small table (their number is a parameter of the caller): each step sends them to all tasks; points are
    never shuffled, only partial sums by segment.  A point meets the centres that ``nearest_centres`` cannot exclude.
    """
    spark = points.sparkSession
    ship(spark)
    plain = points.drop("seg")
    kept = plain.columns
    ready = plain.select(*kept, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])

    def assign(c: DataFrame) -> DataFrame:
        rows = c.where(F.col("seg").isNotNull()).select("seg", *[F.col(f).cast("double").alias(f) for f in features]).orderBy("seg").toArrow()
        segs, at = rows.column("seg").combine_chunks(), _doubles(rows.columns[1:])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                best = pa.array(nearest_centres(_doubles(b.columns[len(kept) :]), at))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], segs.take(best)], names=[*kept, "seg"])

        if not len(rows):
            return plain.withColumn("seg", F.lit(None).cast(c.schema["seg"].dataType))
        return ready.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("seg", c.schema["seg"].dataType)]))

    c = centres
    for step in range(steps):
        c = assign(c).groupBy("seg").agg(*[F.avg(f).alias(f) for f in features])
        if (step + 1) % cut_every == 0:
            c = cut(c, "centres")
    return assign(c)


def _doubles(columns: list) -> np.ndarray:
    """Columns side by side, null as NaN."""
    return np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy(), float) for c in columns])


def nearest_centres(p: np.ndarray, c: np.ndarray, most: int = 128) -> np.ndarray:
    """The place of each point's nearest centre (rows of ``p`` and ``c``; ties: the first), exactly.

    Points are halved at medians into boxes of ``most`` points.  A centre that lies farther from a box than
    another centre from the box's far corner is nearest to none of its points; the rest are compared one by one.  Rows
    with a missing or infinite feature are at no distance: such a centre is taken only where there is no other.
    """
    out = np.zeros(len(p), np.int64)
    real = np.flatnonzero(np.isfinite(c).all(axis=1))
    todo = [(np.flatnonzero(np.isfinite(p).all(axis=1)), real)]
    while todo and len(real):
        at, near = todo.pop()
        if not len(at):
            continue
        lo, hi = p[at].min(axis=0), p[at].max(axis=0)
        m = c[near]
        least = (np.maximum(np.maximum(lo - m, m - hi), 0.0) ** 2).sum(axis=1)
        most_ = (np.maximum(np.abs(m - lo), np.abs(m - hi)) ** 2).sum(axis=1)
        near = near[least <= most_.min() * (1 + 1e-9)]
        if len(at) > most and (hi > lo).any():
            axis = int(np.argmax(hi - lo))
            order = at[np.argsort(p[at, axis], kind="stable")]
            todo += [(order[: len(at) // 2], near), (order[len(at) // 2 :], near)]
            continue
        for part in np.array_split(at, len(at) * len(near) // 4_000_000 + 1):
            d = np.zeros((len(part), len(near)))
            for f in range(p.shape[1]):
                gap = p[part, f, None] - c[None, near, f]
                d += gap * gap
            out[part] = near[d.argmin(axis=1)]
    return out


def slic(points: DataFrame, values: list[str], compactness: float, side: float, steps: int = 3) -> DataFrame:
    """SLIC-like superpixels: start from the squares of a grid of the given side; a point joins the nearest centre among the squares around its own, by value distance and position distance * compactness / side."""
    here = points.withColumn("gx", F.floor(F.col("x") / side)).withColumn("gy", F.floor(F.col("y") / side))
    # centres keep the square in which they started
    seg = F.concat_ws("_", F.col("gx").cast("string"), F.col("gy").cast("string"))
    labelled = here.withColumn("seg", seg).withColumn("cx", F.col("gx")).withColumn("cy", F.col("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(steps):
        centres = labelled.groupBy("seg", "cx", "cy").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), *[F.avg(v).alias(f"m_{v}") for v in values])
        wide = here.withColumn("_s", around).withColumn("cx", F.col("gx") + F.col("_s.i")).withColumn("cy", F.col("gy") + F.col("_s.j")).drop("_s")
        ratio = (compactness / side) ** 2
        d = sum((F.pow(F.col(v) - F.col(f"m_{v}"), 2.0) for v in values), F.lit(0.0)) + (F.pow(F.col("x") - F.col("mx"), 2.0) + F.pow(F.col("y") - F.col("my"), 2.0)) * ratio
        near = wide.join(centres, ["cx", "cy"]).withColumn("_d", d)
        best = near.groupBy("obs_id").agg(F.min_by(F.struct("seg", "cx", "cy"), F.struct("_d", "seg")).alias("b")).select("obs_id", "b.seg", "b.cx", "b.cy")
        labelled = cut(here.join(best, "obs_id"), "slic")
    return labelled.select("obs_id", "x", "y", *values, "seg")


def cluster_quality(members: DataFrame, values: list[str], key: str = "seg") -> DataFrame:
    """Calinski-Harabasz from per-cluster sums, and Davies-Bouldin from centroids (clusters are few and broadcast)."""
    sq = sum((F.col(v) * F.col(v) for v in values), F.lit(0.0))
    s = members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"), *[F.avg(v).alias(v) for v in values])
    norm = sum((F.col(v) * F.col(v) for v in values), F.lit(0.0))
    s = s.withColumn("sse", F.greatest(F.col("q") - F.col("n") * norm, F.lit(0.0)))
    g = s.agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"), F.sum("sse").alias("sse_all"), F.sum(F.col("n") * norm).alias("spread"), *[(F.sum(F.col("n") * F.col(v)) / F.sum("n")).alias(f"g_{v}") for v in values])
    gn = sum((F.col(f"g_{v}") * F.col(f"g_{v}") for v in values), F.lit(0.0))
    ch = g.select("k", F.try_divide((F.col("spread") - F.col("n_all") * gn) / (F.col("k") - 1), F.col("sse_all") / (F.col("n_all") - F.col("k"))).alias("calinski_harabasz"))
    rad = s.select(key, F.sqrt(F.col("sse") / F.col("n")).alias("r"), *values)
    a, b = rad.select(*[F.col(c).alias(f"a_{c}") for c in rad.columns]), rad.select(*[F.col(c).alias(f"b_{c}") for c in rad.columns])
    dist = F.sqrt(sum((F.pow(F.col(f"a_{v}") - F.col(f"b_{v}"), 2.0) for v in values), F.lit(0.0)))
    pairs = a.crossJoin(F.broadcast(b)).where(F.col(f"a_{key}") != F.col(f"b_{key}")).withColumn("t", F.try_divide(F.col("a_r") + F.col("b_r"), dist))
    db = pairs.groupBy(f"a_{key}").agg(F.max("t").alias("t")).agg(F.avg("t").alias("davies_bouldin"))
    return ch.crossJoin(F.broadcast(db))


def medoid(members: DataFrame, key: str = "seg") -> DataFrame:
    """The member nearest to each segment's centroid; ties by id."""
    w = W.partitionBy(key)
    d = F.pow(F.col("x") - F.avg("x").over(w), 2.0) + F.pow(F.col("y") - F.avg("y").over(w), 2.0)
    return members.withColumn("_d", d).groupBy(key).agg(F.min_by("obs_id", F.struct("_d", "obs_id")).alias("medoid"))


def labels_to_obs(tiles: DataFrame, obs: DataFrame, how: str, label: str = "label") -> DataFrame:
    """``obs_id, label`` for every observation, -1 without a tile.

    ``identity``: the tile's number is the observation's; ``index``: the tile names it in ``obs_id``; ``majority``: several tiles
    of an observation vote (ties: by origin tiles, then the smallest label; negative labels do not vote).
    """
    if how == "identity":
        got = tiles.select(F.col("tile").alias("obs_id"), label)
    elif how == "index":
        got = tiles.select("obs_id", label)
    elif how == "majority":
        got = majority(tiles.where(F.col(label) >= 0), "obs_id", label).select("obs_id", label)
    else:
        raise ValueError(f"unknown way {how!r}")
    return obs.select("obs_id").join(got, "obs_id", "left").select("obs_id", F.coalesce(label, F.lit(-1)).cast("long").alias(label))


def concat_labels(df: DataFrame, library: str, seg: str) -> Column:
    return F.concat_ws("_", F.col(library).cast("string"), F.col(seg).cast("string"))
