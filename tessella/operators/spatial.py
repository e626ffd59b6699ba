"""Coordinates: lattices, neighbours, grids, spacing.

Neighbour searches bucket points into square cells and meet only adjacent cells by
equi-joins, so no operator compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import finite, half_even, quantile, with_quantiles
from tessella.sources.storage import cut, many

#: Coordinate columns, in the order in which they are tried.
COORDINATES = (("x", "y"), ("array_col", "array_row"), ("imagecol", "imagerow"), ("pxl_col_in_fullres", "pxl_row_in_fullres"), ("x_centroid", "y_centroid"))


def resolve_coordinates(df: DataFrame, pairs=COORDINATES) -> DataFrame:
    """``x`` and ``y`` from the first pair of columns that exists; rows without two finite numbers go."""
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            out = df.withColumn("x", finite(F.col(a))).withColumn("y", finite(F.col(b)))
            return out.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    raise KeyError(f"no coordinate columns among {df.columns}")


def lattice_edges(points: DataFrame, diagonal: bool = False) -> DataFrame:
    """Edges ``src, dst, weight`` to the right and down (and along both diagonals) of integer lattice points."""
    a = points.select(F.col("obs_id").alias("src"), "x", "y")
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if diagonal else [])
    step = F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in steps])).alias("s")
    want = a.select("src", "x", "y", step).select("src", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    return many(want).join(many(points).select(F.col("obs_id").alias("dst"), "x", "y"), ["x", "y"]).select("src", "dst", F.lit(1.0).alias("weight"))


def reduce_resolution(points: DataFrame, scale: float) -> DataFrame:
    """One row per coarser position ``rint(x * scale) + 1``, with its first id and the number of points."""
    px, py = (half_even(F.col(c) * scale).cast("long") + 1 for c in ("x", "y"))
    return points.groupBy(px.alias("px"), py.alias("py")).agg(F.min("obs_id").alias("obs_id"), F.count(F.lit(1)).alias("n"))


def _dense(df: DataFrame, c: str, name: str) -> DataFrame:
    """Distinct values of a coordinate with their place in ascending order.

    Spark deals the values out in ranges of equal size, however they are spread; they are ranked inside their range
    only, and a range's start is the number of values in the ranges before it - a table as small as the number of ranges.
    """
    values = df.select(c).where(F.col(c).isNotNull()).distinct()
    ranged = cut(values.repartitionByRange(c).select(c, F.spark_partition_id().alias("_r")), "ranges")
    sizes = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_r", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(W.partitionBy("_r").orderBy(c)) - 1
    return ranged.join(F.broadcast(before), "_r").select(c, (at + F.col("_before")).cast("long").alias(name), "_r")


def compact_tight(points: DataFrame, step: float = 1.0) -> DataFrame:
    """Coordinates moved together: place among distinct values, times ``step``."""
    out = points
    for c in ("x", "y"):
        out = out.join(_dense(points, c, f"_{c}").drop("_r"), c)
    return out.withColumn("x_new", F.col("_x") * F.lit(step)).withColumn("y_new", F.col("_y") * F.lit(step)).drop("_x", "_y")


def _gaps(points: DataFrame, c: str) -> DataFrame:
    """Each distinct value with its predecessor and place."""
    d = _dense(points, c, "place").drop("_r")
    before = d.select(F.col(c).alias("prev"), (F.col("place") + 1).alias("place"))
    return d.join(before, "place", "left").select(c, "place", (F.col(c) - F.col("prev")).alias("gap"))


def compact_capped(points: DataFrame, times: float) -> DataFrame:
    """Coordinates whose gaps are cut to ``times`` the median gap of their axis."""
    out = points
    for c in ("x", "y"):
        gaps = _gaps(points, c)
        capped = with_quantiles(gaps, "gap", {"_median": 0.5}).withColumn("_step", F.coalesce(F.least("gap", F.col("_median") * times), F.lit(0.0)))
        # running sums over distinct coordinates of one axis, in blocks
        block = F.floor(F.col("place") / 1024)
        w = W.partitionBy("_b").orderBy("place")
        inner = capped.withColumn("_b", block).withColumn("_run", F.sum("_step").over(w))
        sums = inner.groupBy("_b").agg(F.sum("_step").alias("_s"))
        base = sums.select("_b", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_base"))
        out = out.join(inner.join(F.broadcast(base), "_b").select(c, (F.col("_run") + F.col("_base")).alias(f"{c}_new")), c)
    return out


def axis_pitch(points: DataFrame) -> DataFrame:
    """Median gap between distinct coordinates of each axis: one row."""
    out = None
    for c in ("x", "y"):
        one = _gaps(points, c).agg(quantile("gap", 0.5).alias(f"pitch_{c}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def snap(points: DataFrame, pitch: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Lattice place, displacement from it, and whether the point is the first (smallest id) of its place."""
    out = points
    for c, o in (("x", x0), ("y", y0)):
        out = out.withColumn(f"{c}_i", half_even((F.col(c) - o) / pitch).cast("long"))
    moved = F.sqrt(F.pow(F.col("x") - (F.col("x_i") * pitch + x0), 2.0) + F.pow(F.col("y") - (F.col("y_i") * pitch + y0), 2.0))
    first = F.row_number().over(W.partitionBy("x_i", "y_i").orderBy("obs_id")) == 1
    return out.withColumn("moved", moved).withColumn("first", first)


def grid_outliers(points: DataFrame, factor: float, q: float = 0.01) -> DataFrame:
    """Points in cells ``rint(x f)_rint(y f)`` that hold more points than the ``q`` quantile of all cells.

    Where every cell holds equally many, none is above the quantile and all points go.
    """
    cell = F.concat_ws("_", half_even(F.col("x") * factor).cast("long").cast("string"), half_even(F.col("y") * factor).cast("long").cast("string"))
    keyed = points.withColumn("cell", cell)
    sizes = with_quantiles(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "n", {"_cut": q}).where(F.col("n") > F.col("_cut"))
    return keyed.join(sizes.select("cell", "n"), "cell")


def _near(a: DataFrame, b: DataFrame, side: Column | float) -> DataFrame:
    """Pairs of the rows of ``a`` (id_a, xa, ya) and ``b`` (id_b, xb, yb) in the same or adjacent cells of the given side."""
    side = side if isinstance(side, Column) else F.lit(float(side))
    left = a.withColumn("cx", F.floor(F.col("xa") / side)).withColumn("cy", F.floor(F.col("ya") / side))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = left.withColumn("_s", around).withColumn("cx", F.col("cx") + F.col("_s.i")).withColumn("cy", F.col("cy") + F.col("_s.j")).drop("_s")
    right = b.withColumn("cx", F.floor(F.col("xb") / side)).withColumn("cy", F.floor(F.col("yb") / side))
    return many(left).join(many(right), ["cx", "cy"]).drop("cx", "cy")


def nearest(a: DataFrame, b: DataFrame, k: int, side: float, keep_self: bool = True) -> DataFrame:
    """The ``k`` nearest rows of ``b`` (obs_id, x, y) to each of ``a``: ``id, other, dist, place``; ties by id.

    A cell's neighbourhood is certain up to the distance of its side; rows that have not found ``k``
    within it search again with cells twice as wide, until none is left or the cells are as wide as the extent of all points:
    then every row meets all of ``b`` and keeps what there is.
    """
    left = a.select(F.col("obs_id").alias("id"), F.col("x").cast("double").alias("xa"), F.col("y").cast("double").alias("ya"))
    right = b.select(F.col("obs_id").alias("other"), F.col("x").cast("double").alias("xb"), F.col("y").cast("double").alias("yb"))
    places = left.select("xa", "ya").unionByName(right.select(F.col("xb").alias("xa"), F.col("yb").alias("ya")))
    x, y = finite("xa"), finite("ya")
    span = places.agg(F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("s")).first().s or 0.0
    widest = span * 1.001
    # with so few rows, each of them is a neighbour
    r = max(side, widest) if right.limit(k + 1).count() <= k else side
    done, todo = None, left
    while True:
        pairs = _near(todo, right, r)
        if not keep_self:
            pairs = pairs.where("id <> other")
        d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2.0) + F.pow(F.col("ya") - F.col("yb"), 2.0))
        pairs = pairs.select("id", "other", d.alias("dist")).where(F.col("dist") <= r)
        w = W.partitionBy("id").orderBy("dist", "other")
        top = pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
        if r >= widest:
            return top if done is None else done.unionByName(top)
        full = top.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id")))
        found = cut(full.where(F.col("_n") >= k).drop("_n"), "nearest")
        done = found if done is None else done.unionByName(found)
        todo = cut(many(todo).join(many(found).select("id").distinct(), "id", "left_anti"), "searching")
        if todo.isEmpty():
            return done
        r *= 2


def neighbour_distance(points: DataFrame, side: float = 1.0) -> DataFrame:
    """``obs_id, dist`` to the nearest other point."""
    return nearest(points, points, 1, side, keep_self=False).select(F.col("id").alias("obs_id"), "dist")


def pitch(points: DataFrame, side: float = 1.0, cell: float = 2.0) -> DataFrame:
    """Spacing: median, mean and CV of nearest distances, the effective pitch sqrt(occupied area / n), and whether it looks like a grid (CV <= 0.25)."""
    d = neighbour_distance(points, side)
    stats = d.agg(quantile("dist", 0.5).alias("median"), F.avg("dist").alias("mean"), F.try_divide(F.stddev_pop("dist"), F.avg("dist")).alias("cv"), F.count(F.lit(1)).alias("n"))
    bins = points.select(F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).distinct().agg(F.count(F.lit(1)).alias("bins"))
    both = stats.crossJoin(F.broadcast(bins))
    return both.select("median", "mean", "cv", F.sqrt(F.col("bins") * cell * cell / F.col("n")).alias("effective"), (F.col("cv") <= 0.25).alias("grid"))


def lattice_pitch(points: DataFrame, side: float = 1.0, q: float = 0.2) -> DataFrame:
    """Median of the nearest distances up to their ``q`` quantile: one row."""
    d = with_quantiles(neighbour_distance(points, side), "dist", {"_q": q})
    return d.where(F.col("dist") <= F.col("_q")).agg(quantile("dist", 0.5).alias("pitch"))


def isolated(points: DataFrame, k: int, side: float, q: float) -> DataFrame:
    """Points whose mean distance to their ``k`` nearest is up to the ``q`` quantile; all points if none is."""
    mean = nearest(points, points, k, side, keep_self=False).groupBy(F.col("id").alias("obs_id")).agg(F.avg("dist").alias("mean_dist"))
    kept = with_quantiles(mean, "mean_dist", {"_cut": q}).where(F.col("mean_dist") <= F.col("_cut")).drop("_cut")
    return kept


def collinear(points: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Whether all points lie on one line: the smaller eigenvalue of their covariance is negligible."""
    vx, vy, cxy = F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    half, root = (vx + vy) / 2, F.sqrt(F.pow((vx - vy) / 2, 2.0) + cxy * cxy)
    return points.agg((half - root).alias("minor"), (half + root).alias("major")).withColumn("collinear", F.col("minor") <= eps * F.greatest(F.col("major"), F.lit(1.0)))


def collisions(points: DataFrame) -> DataFrame:
    """Stacks of points on one position: distinct positions, largest stack, share of points in stacks."""
    s = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("positions"), F.max("n").alias("largest"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("stacked"))


def remove_gaps(points: DataFrame, c: str, longest: int) -> DataFrame:
    """Integer coordinate without its empty runs of up to ``longest`` values; longer runs stay.  Adds ``<c>_new``."""
    g = _gaps(points, c)
    empty = F.coalesce(F.col("gap") - 1, F.lit(0)).cast("long")
    cut = F.when(empty.between(1, longest), empty).otherwise(0)
    w = W.partitionBy("_b").orderBy("place")
    inner = g.withColumn("_cut", cut).withColumn("_b", F.floor(F.col("place") / 1024)).withColumn("_run", F.sum("_cut").over(w))
    sums = inner.groupBy("_b").agg(F.sum("_cut").alias("_s"))
    base = sums.select("_b", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    shift = inner.join(F.broadcast(base), "_b").select(c, (F.col("_run") + F.col("_base")).alias("_shift"))
    return points.join(shift, c).withColumn(f"{c}_new", F.col(c) - F.col("_shift")).drop("_shift")
