"""Tiles: from points to lattice pixels, Voronoi areas, collisions, sampling kind and tile size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import quantile, with_quantiles
from tessella.sources.storage import cut, ship

from .spatial import nearest, pitch, snap

#: Columns that tell cells, and lattices.
CENTROIDS = (("Centroid_X", "Centroid_Y"), ("center_x", "center_y"), ("x_centroid", "y_centroid"))
LATTICE_MARKS = ("array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres", "in_tissue")


def _lattice(spark, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Every pixel of the extent, dealt out by Spark."""
    w, h = x1 - x0 + 1, y1 - y0 + 1
    return spark.range(w * h).select((F.col("id") % w + x0).alias("px"), (F.floor(F.col("id") / w) + y0).alias("py"))


def voronoi_raster(points: DataFrame, step: float = 1.0, farthest: float | None = None) -> DataFrame:
    """``px, py, obs_id``: every lattice pixel of the extent with its nearest point (ties: smallest id), none beyond ``farthest``."""
    e = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if e.x0 is None:
        return points.select(F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"), "obs_id").limit(0)
    grid = _lattice(points.sparkSession, math.floor(e.x0 / step), math.floor(e.x1 / step), math.floor(e.y0 / step), math.floor(e.y1 / step))
    at = grid.select(F.struct("px", "py").alias("obs_id"), ((F.col("px") + 0.5) * step).alias("x"), ((F.col("py") + 0.5) * step).alias("y"))
    near = nearest(at, points.select("obs_id", "x", "y"), 1, 2 * step)
    if farthest is not None:
        near = near.where(F.col("dist") <= farthest)
    return near.select("id.px", "id.py", F.col("other").alias("obs_id"))


def lattice_support(points: DataFrame, size: float, least: int, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``px, py, obs_id, filled``: occupied places of an inferred lattice with their first point, and empty places with
    ``least`` or more occupied ones among their eight neighbours, which take the nearest point."""
    at = snap(points, size, x0, y0).where("first").select(F.col("x_i").alias("px"), F.col("y_i").alias("py"), "obs_id")
    around = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])).alias("o")
    votes = at.select("px", "py", around).select((F.col("px") + F.col("o.i")).alias("px"), (F.col("py") + F.col("o.j")).alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    empty = votes.where(F.col("n") >= least).join(at, ["px", "py"], "left_anti")
    here = empty.select(F.struct("px", "py").alias("obs_id"), (F.col("px") * size + x0).alias("x"), (F.col("py") * size + y0).alias("y"))
    near = nearest(here, points.select("obs_id", "x", "y"), 1, 2 * size).select("id.px", "id.py", F.col("other").alias("obs_id"))
    return at.withColumn("filled", F.lit(False)).unionByName(near.withColumn("filled", F.lit(True)))


def tiles(points: DataFrame, mode: str = "coordinates", step: float = 1.0, least: int = 5, farthest: float | None = None) -> DataFrame:
    """Tiles ``px, py, obs_id`` in one of four modes.

    ``coordinates``: the points' own positions.  ``inferred``: the first point of each place of a lattice of pitch ``step``.
    ``boundary``: the same, with empty places that have ``least`` occupied neighbours filled.  ``voronoi``: every pixel of the extent.
    """
    if mode == "coordinates":
        return points.select(F.col("x").alias("px"), F.col("y").alias("py"), "obs_id")
    if mode == "inferred":
        return snap(points, step).where("first").select(F.col("x_i").alias("px"), F.col("y_i").alias("py"), "obs_id")
    if mode == "boundary":
        return lattice_support(points, step, least).select("px", "py", "obs_id")
    if mode == "voronoi":
        return voronoi_raster(points, step, farthest)
    raise ValueError(f"unknown mode {mode!r}")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of the rows, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def convex_hull(points: DataFrame) -> np.ndarray:
    """Corners of the hull of all points: each task's hull, then the hull of those (a few corners a task)."""

    ship(points.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2))
        for b in batches:
            held = hull(np.concatenate([held, np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])]))
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["x", "y"])

    some = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    corners = some.mapInArrow(run, "x double, y double").collect()
    return hull(np.array([tuple(r) for r in corners], float).reshape(-1, 2))


def _cell(px: float, py: float, xs: np.ndarray, ys: np.ndarray, far: float) -> tuple[float, float]:
    """Area of the Voronoi cell of a point among its neighbours (nearest first), and its largest distance from the point."""
    cell = [(-far, -far), (far, -far), (far, far), (-far, far)]
    for nx, ny in zip((xs - px).tolist(), (ys - py).tolist(), strict=True):
        half = (nx * nx + ny * ny) / 2
        if half == 0 or half > max(x * x + y * y for x, y in cell) * 2:
            continue
        out = []
        for (ax, ay), (bx, by) in zip(cell, cell[1:] + cell[:1], strict=True):
            da, db = nx * ax + ny * ay - half, nx * bx + ny * by - half
            if da <= 0:
                out.append((ax, ay))
            if (da < 0 < db) or (db < 0 < da):
                t = da / (da - db)
                out.append((ax + t * (bx - ax), ay + t * (by - ay)))
        cell = out
        if len(cell) < 3:
            return 0.0, 0.0
    radius = math.sqrt(max(x * x + y * y for x, y in cell))
    if 8 * radius < far:  # again from a box of the region's own size, so that rounding is of that size too
        return _cell(px, py, xs, ys, 2 * radius)
    area = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(cell, cell[1:] + cell[:1], strict=True)) / 2
    return abs(area), radius


def voronoi_areas(points: DataFrame, side: float, k: int = 16) -> DataFrame:
    """``obs_id, area`` of the finite Voronoi regions; points on the hull have none and are left out.

    A point's region is cut out by its ``k`` nearest: it is certain once no farther point can reach it, that is
    if twice its radius is within the k-th distance.  The others search again with twice as many.  Points on
    one position share their region (one of them has it: the smallest id).
    """
    p = cut(points.groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("obs_id").alias("obs_id")).where("x is not null and y is not null"), "places")
    corners = convex_hull(p)
    n = p.count()
    if len(corners) < 3:
        return p.select("obs_id", F.lit(0.0).alias("area")).limit(0)
    size = float(np.abs(corners - corners.mean(axis=0)).max())
    off = None
    for (ax, ay), (bx, by) in zip(corners.tolist(), np.roll(corners, -1, axis=0).tolist(), strict=True):
        # to the left of every side, by more than rounding
        d = ((F.col("y") - ay) * (bx - ax) - (F.col("x") - ax) * (by - ay)) / math.hypot(bx - ax, by - ay)
        off = (d > 1e-9 * size) if off is None else off & (d > 1e-9 * size)
    todo, done, far = p.where(off), None, 1e6 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, areas = [], []
            for i, x, y, near in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                xs, ys, last = np.array([e["x"] for e in near]), np.array([e["y"] for e in near]), near[-1]["dist"]
                area, radius = _cell(x, y, xs, ys, far)
                ids.append(i)
                areas.append(area if 2 * radius <= last or len(near) >= n - 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(areas, pa.float64())], names=["obs_id", "area"])

    while True:
        k = min(k, max(1, n - 1))
        found = nearest(todo, p, k, side, keep_self=False).join(p.select(F.col("obs_id").alias("other"), "x", "y"), "other")
        lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dist", "other", "x", "y"))).alias("near"))
        rows = todo.join(lists, todo["obs_id"] == lists["id"]).select(todo["obs_id"].cast("long").alias("obs_id"), "x", "y", "near")
        got = cut(rows.mapInArrow(run, "obs_id long, area double"), "areas")
        some = got.where("area is not null")
        done = some if done is None else done.unionByName(some)
        left = got.where("area is null").select("obs_id")
        if k >= n - 1 or left.isEmpty():
            return done
        todo, k = cut(todo.join(left, "obs_id", "left_semi"), "uncertain"), 2 * k


def area_filter(points: DataFrame, side: float, q: float = 0.995) -> DataFrame:
    """Points whose Voronoi region is finite and not larger than the ``q`` quantile of the areas: ``obs_id, area``."""
    return with_quantiles(cut(voronoi_areas(points, side), "areas"), "area", {"_cut": q}).where(F.col("area") <= F.col("_cut")).drop("_cut")


def collision_offsets(radius: int) -> list[tuple[int, int]]:
    """Pixels around a centre, nearest first; at one distance by |dy|, |dx|, dy, dx."""
    some = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i or j]
    return sorted(some, key=lambda o: (o[0] ** 2 + o[1] ** 2, abs(o[1]), abs(o[0]), o[1], o[0]))


def resolve_collisions(tiles: DataFrame, width: int, height: int, radius: int = 2, cut_every: int = 4) -> DataFrame:
    """``obs_id, cx, cy, moved``: the first tile (smallest id) of a pixel keeps it, the others take a free one nearby.

    Offset by offset, every tile still without a place asks for the pixel at that offset: if it is free and on the
    canvas, the smallest id gets it.  Tiles that find none stay where they were.
    """
    t = tiles.select("obs_id", F.least(F.greatest("cx", F.lit(0)), F.lit(width - 1)).cast("long").alias("cx"), F.least(F.greatest("cy", F.lit(0)), F.lit(height - 1)).cast("long").alias("cy"))
    first = F.row_number().over(W.partitionBy("cx", "cy").orderBy("obs_id")) == 1
    t = cut(t.withColumn("first", first), "tiles")
    taken = t.where("first").select("obs_id", "cx", "cy", F.lit(False).alias("moved"))
    pending = t.where("not first").select("obs_id", "cx", "cy")
    for n, (dx, dy) in enumerate(collision_offsets(radius)):
        asked = pending.select("obs_id", (F.col("cx") + dx).alias("px"), (F.col("cy") + dy).alias("py")).where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
        free = asked.join(taken.select(F.col("cx").alias("px"), F.col("cy").alias("py")), ["px", "py"], "left_anti")
        got = free.groupBy("px", "py").agg(F.min("obs_id").alias("obs_id")).select("obs_id", F.col("px").alias("cx"), F.col("py").alias("cy"), F.lit(True).alias("moved"))
        got = cut(got, "placed")
        taken = taken.unionByName(got)
        pending = pending.join(got.select("obs_id"), "obs_id", "left_anti")
        if (n + 1) % cut_every == 0:
            taken, pending = cut(taken, "taken"), cut(pending, "pending")
            if pending.isEmpty():
                break
    return taken.unionByName(pending.withColumn("moved", F.lit(False)))


def sampling_kind(points: DataFrame, side: float = 1.0) -> str:
    """``cell`` or ``grid``: by telling columns, else by how regular the nearest distances are (CV up to 0.25 is a grid)."""
    if any(a in points.columns and b in points.columns for a, b in CENTROIDS):
        return "cell"
    if any(c in points.columns for c in LATTICE_MARKS):
        return "grid"
    return "grid" if pitch(points, side).first().grid else "cell"


def resolve_pitch(points: DataFrame, platform: str = "auto", side: float = 1.0, cell: float = 2.0) -> float:
    """Effective pitch of cell-like points; lattices have a known pitch of their own, so asking for theirs is an error."""
    kind = sampling_kind(points, side) if platform == "auto" else "cell" if platform in ("merfish", "merscope", "xenium", "cosmx", "cell") else "grid"
    if kind != "cell":
        raise ValueError("lattices have a known pitch")
    return float(pitch(points, side, cell).first().effective)


def target_size(pitch_: float, cells: float) -> float:
    """Side length of a segment that is to hold so many cells."""
    if not cells > 0:
        raise ValueError("cells must be positive")
    return math.sqrt(cells) * pitch_


def tile_size(points: DataFrame, mode: str = "nn", q: float | None = None, scale: float = 1.0, shrink: float = 1.0, side: float = 1.0) -> DataFrame:
    """One row ``size``: by the nearest distances (``nn``), by coordinate differences to the six nearest (``axis``),
    or the latter unless it is under 0.7 times the former (``auto``)."""
    q = (0.2 if mode == "auto" else 0.5) if q is None else q
    p = points.select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = nearest(p, p, 1 if mode == "nn" else 6, side, keep_self=False)
    nn = near.where("place = 1 and dist > 0").agg(quantile("dist", q).alias("nn"))
    if mode == "nn":
        est = nn.select(F.coalesce("nn", F.lit(1.0)).alias("size"))
    else:
        a = p.select(F.col("obs_id").alias("id"), F.col("x").alias("xa"), F.col("y").alias("ya"))
        b = p.select(F.col("obs_id").alias("other"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        d = near.join(a, "id").join(b, "other").select(F.abs(F.col("xa") - F.col("xb")).alias("dx"), F.abs(F.col("ya") - F.col("yb")).alias("dy"))
        qx, qy = quantile(F.when(F.col("dx") > 0, F.col("dx")), q), quantile(F.when(F.col("dy") > 0, F.col("dy")), q)
        axis = d.agg(F.when(qx.isNotNull() & qy.isNotNull(), F.least(qx, qy)).alias("axis"))
        x = nn.crossJoin(F.broadcast(axis))
        pick = F.when((F.col("axis") >= 0.7 * F.col("nn")) | F.col("nn").isNull(), F.col("axis")).otherwise(F.col("nn")) if mode == "auto" else F.coalesce("axis", "nn")
        est = x.select(F.coalesce(pick, "nn", F.lit(1.0)).alias("size"))
    span = p.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0)).alias("_s"))
    return est.crossJoin(F.broadcast(span)).select(F.greatest(F.col("size") * scale * shrink, F.col("_s") * 1e-9).alias("size"))


def cap_by_density(size: DataFrame, points: DataFrame, factor: float = 1.0) -> DataFrame:
    """The size, at most ``factor`` (0.5 to 2) times the side of the area that each point has on average."""
    factor = min(max(factor, 0.5), 2.0)
    e = points.agg(F.count(F.lit(1)).alias("_n"), (F.max("x") - F.min("x")).alias("_w"), (F.max("y") - F.min("y")).alias("_h"))
    w, h = (F.when(F.col(c) > 0, F.col(c)).otherwise(1.0) for c in ("_w", "_h"))
    top = F.greatest(F.lit(0.1), F.sqrt(w * h / F.col("_n")) * factor)
    return size.crossJoin(F.broadcast(e)).select(F.when(F.col("_n") > 0, F.least("size", top)).otherwise(F.col("size")).alias("size"))
