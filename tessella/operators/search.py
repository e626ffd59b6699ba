"""Choice of a superpixel compactness: candidate lists, their evaluation in one job, and searches over them.

A ``segmenter`` is any function ``(points, compactness) -> DataFrame(obs_id, seg)``.  All candidates of a round
are one job, with the compactness as a key; what reaches the driver is a row for each candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import clip

from .segment import compactness_metrics, compactness_scores, neighbour_disagreement, select_compactness
from .spatial import nearest

Segmenter = Callable[[DataFrame, float], DataFrame]

#: Candidates of the automatic search, and multipliers of the adaptive one.
AUTO_CANDIDATES = (0.003, 0.005, 0.008, 0.012, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2)
MULTIPLIERS = (0.4, 0.67, 1.0, 1.5, 2.25)


def clean(candidates: Sequence[float], lo: float | None = None, hi: float | None = None) -> list[float]:
    """Finite positive candidates within bounds, distinct to 12 decimals, ascending."""
    limited = (min(max(float(c), -math.inf if lo is None else lo), math.inf if hi is None else hi) for c in candidates)
    return sorted({round(c, 12): c for c in limited if math.isfinite(c) and c > 0}.values())


def geometric(lo: float, hi: float, n: int) -> list[float]:
    """``n`` numbers from ``lo`` to ``hi`` with one ratio."""
    return [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)]


def refine(seeds: Sequence[float], best: float, lo: float | None = None, hi: float | None = None) -> list[float]:
    """Seven candidates between the neighbours of the best seed (a factor of 1.8 beyond the ends), and the seed."""
    s = sorted(set(seeds))
    if not s:
        return [best]
    i = min(range(len(s)), key=lambda k: abs(s[k] - best))
    low = s[i - 1] if i else s[i] / 1.8
    high = s[i + 1] if i + 1 < len(s) else s[i] * 1.8
    return clean([*geometric(low, high, 7), s[i]], lo, hi)


def refine_stage(pool: Sequence[float], scores: dict[float, float], best: float, top: int, count: int | None = None, lo: float | None = None, hi: float | None = None) -> list[float]:
    """The ``top`` candidates by score with their neighbours in the pool, and a dense geometric grid a little beyond them."""
    pool = clean(pool)
    if len(pool) < 2:
        return pool
    known = {round(c, 12): s for c, s in scores.items()}
    winners = sorted(pool, key=lambda c: (known.get(round(c, 12), math.inf), abs(math.log(c / max(best, 1e-12)))))[: max(1, top)]
    at = {j for c in winners for k in [pool.index(c)] for j in (k - 1, k, k + 1) if 0 <= j < len(pool)}
    chosen = [pool[j] for j in sorted(at)]
    low, high = (chosen[0], chosen[-1]) if chosen[-1] > chosen[0] else (best / 1.5, best * 1.5)
    dense = geometric(low / 1.35, high * 1.35, max(5, max(2 * top, 7) if count is None else count))
    return clean([*chosen, *dense, best], lo, hi)


def scheduled(compactness: float | None, mode: str, target: float | None = None, base: float | None = None, power: float = 0.3, lo: float | None = None, hi: float | None = None) -> float:
    """The given compactness (1 without one), scaled by a power of target over base size where the mode scales."""
    value = 1.0 if compactness is None else float(compactness)
    if mode in ("scaled", "adaptive") and target is not None and base is not None:
        if base <= 0:
            raise ValueError("the base size must be positive")
        value *= (target / base) ** power
    return min(max(value, -math.inf if lo is None else lo), math.inf if hi is None else hi)


def infer_range(points: DataFrame, values: list[str], side: float, segment_side: float | None = None, resolution: float | None = None, k: int = 7) -> DataFrame:
    """One row ``lower, center, upper, roughness, spacing_cv, n``: where a search should begin.

    Roughness is the variance of values among a point's ``k`` nearest over that of all points (0.25 to 4),
    spacing_cv the variation of those distances.  ``segment_side``: wanted side in points; else from the number of segments ``resolution``
    (default: n / 128).
    """
    near = nearest(points.select("obs_id", "x", "y"), points.select("obs_id", "x", "y"), k, side, keep_self=False)
    spacing = near.agg(F.coalesce(F.try_divide(F.stddev_pop("dist"), F.avg("dist")), F.lit(0.0)).alias("spacing_cv"))
    around = near.join(points.select(F.col("obs_id").alias("other"), *values), "other").groupBy("id").agg(*[F.var_pop(v).alias(v) for v in values])
    mean = sum((F.avg(v) for v in values[1:]), F.avg(values[0])) / len(values)
    spread = sum((F.var_pop(v) for v in values[1:]), F.var_pop(values[0])) / len(values)
    x = points.agg(F.count(F.lit(1)).alias("n"), spread.alias("_all")).crossJoin(F.broadcast(spacing)).crossJoin(F.broadcast(around.agg(mean.alias("_near"))))
    rough = F.when(F.col("_all") > 1e-12, clip(F.col("_near") / F.col("_all"), 0.25, 4.0)).otherwise(1.0)
    own = F.lit(float(segment_side)) if segment_side is not None else F.sqrt(F.col("n") / resolution) if resolution else F.sqrt(F.col("n") / 128.0)
    size = clip(F.pow(F.greatest(own, F.lit(1.0)) / 25.0, 0.6), 0.6, 4.0)
    x = x.withColumn("roughness", F.coalesce(rough, F.lit(1.0)))
    centre = 0.035 * size / clip(0.85 + 0.70 * F.col("roughness") + 0.40 * F.col("spacing_cv"), 0.8, 4.0)
    return x.select((centre / 2.2).alias("lower"), centre.alias("center"), (centre * 2.2).alias("upper"), "roughness", "spacing_cv", "n")


def evaluate(points: DataFrame, edges: DataFrame, segmenter: Segmenter, candidates: Sequence[float], values: list[str]) -> DataFrame:
    """The four figures of every candidate: ``compactness, segments, embedding_var, mean_log_aspect, size_cv, neighbor_disagreement``."""
    labels = None
    for c in candidates:
        one = segmenter(points, c).select(F.lit(float(c)).alias("compactness"), "obs_id", "seg")
        labels = one if labels is None else labels.unionByName(one)
    members = labels.join(points.select("obs_id", "x", "y", *values), "obs_id")
    return compactness_metrics(members, values, ["compactness"]).join(neighbour_disagreement(labels, edges, ["compactness"]), "compactness")


def choose(rows: DataFrame, schedule: float | None) -> DataFrame:
    """Scores and penalties of evaluated candidates, the chosen one flagged ``selected``."""
    return select_compactness(compactness_scores(rows), schedule)


def _known(spark, rows: list, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def resolve(
    points: DataFrame,
    edges: DataFrame,
    segmenter: Segmenter | None,
    values: list[str],
    mode: str = "auto",
    compactness: float | None = None,
    candidates: Sequence[float] | None = None,
    lo: float | None = None,
    hi: float | None = None,
    stages: Sequence[float] = (0.25, 0.5, 1.0),
    top: int = 2,
    **schedule,
) -> tuple[float, DataFrame | None]:
    """The chosen compactness and, where a search was made, its rows (``frame``).

    ``fixed``, ``scaled``: the schedule itself.  ``manual``: the given candidates.  ``adaptive``: multiples of the schedule.
    ``auto``: broad candidates, then seven around the best, judged together.  ``multifidelity``: rounds over growing
    shares of the points (``stages``, by a hash of the id; the last is all of them), each refining the round before.
    """
    plan = None if mode in ("auto", "manual", "multifidelity") and compactness is None else scheduled(compactness, mode, lo=lo, hi=hi, **schedule)
    if mode in ("fixed", "scaled"):
        return plan, None
    if segmenter is None:
        raise ValueError(f"{mode} needs a segmenter")
    spark = points.sparkSession
    if mode == "manual":
        first = clean(candidates or (), lo, hi)
    elif mode == "adaptive":
        first = clean([plan * m for m in candidates or MULTIPLIERS], lo, hi) or [plan]
    else:
        first = clean([*(candidates or AUTO_CANDIDATES), *([] if plan is None else [plan])], lo, hi)
    if not first:
        raise ValueError("no candidate is left within the bounds")

    def run(some: Sequence[float], share: float = 1.0) -> tuple[list, DataFrame]:
        p, e = points, edges
        if share < 1:
            few = points.select("obs_id").where(F.pmod(F.xxhash64("obs_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
            p = points.join(few, "obs_id", "left_semi")
            e = edges.join(few.withColumnRenamed("obs_id", "src"), "src", "left_semi").join(few.withColumnRenamed("obs_id", "dst"), "dst", "left_semi")
        df = evaluate(p, e, segmenter, some, values)
        return df.collect(), df

    def best_of(df: DataFrame) -> tuple[float, DataFrame]:
        scored = choose(df, plan)
        rows = scored.collect()
        return next(r.compactness for r in rows if r.selected), _known(spark, rows, scored.schema)

    if mode in ("manual", "adaptive"):
        rows, df = run(first)
        best, scored = best_of(_known(spark, rows, df.schema))
        return best, frame([(mode, scored)], best)
    if mode == "auto":
        rows, df = run(first)
        best, coarse = best_of(_known(spark, rows, df.schema))
        fresh = [c for c in refine(first, best, lo, hi) if round(c, 12) not in {round(r.compactness, 12) for r in rows}]
        more, _ = run(fresh) if fresh else ([], None)
        best, both = best_of(_known(spark, rows + more, df.schema))
        return best, frame([("coarse", coarse), ("refine", both)], best)
    if mode != "multifidelity":
        raise ValueError(f"unknown mode {mode!r}")
    done, pool = [], first
    for i, share in enumerate(stages):
        rows, df = run(pool, share)
        best, scored = best_of(_known(spark, rows, df.schema))
        done.append((f"stage{i + 1}", scored))
        if i + 1 < len(stages):
            pool = refine_stage(pool, {r.compactness: r.score for r in scored.collect()}, best, top, lo=lo, hi=hi)
    return best, frame(done, best)


def rescale(best: float, reference: float, target: float, power: float, lo: float | None = None, hi: float | None = None) -> float:
    """A compactness found at a reference size, carried to another by the power law: the fast path, one search for many sizes."""
    return clean([best * (target / reference) ** power], lo, hi)[0]


def frame(stages: Sequence[tuple[str, DataFrame]], selected: float) -> DataFrame:
    """Rows of all stages: ``search_stage``, the candidate with its figures, and whether its stage, or the search, chose it."""
    out = None
    for name, df in stages:
        one = df.withColumnRenamed("selected", "is_stage_selected").withColumn("search_stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("is_selected", F.abs(F.col("compactness") - selected) <= 1e-8 + 1e-5 * abs(selected))


def best_row(rows: DataFrame) -> DataFrame:
    """The chosen candidate of each stage."""
    w = W.partitionBy("search_stage").orderBy("penalised", "away", "compactness")
    return rows.where("near").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
