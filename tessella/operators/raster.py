"""Pixels: stamping, splatting, morphology on ``px, py`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stamp(tiles: DataFrame, radius: int, shape: str = "square") -> DataFrame:
    """Pixels that each tile centre (cx, cy) covers, within a square or disc."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if shape == "square" or i * i + j * j <= radius * radius]
    o = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i, j in offsets])).alias("o")
    return tiles.select("*", o).withColumn("px", F.col("cx") + F.col("o.dx")).withColumn("py", F.col("cy") + F.col("o.dy")).drop("o")


def last_write(stamped: DataFrame, value: str, priority: list[Column]) -> DataFrame:
    """Value of the pixel's tile with the highest priority."""
    return stamped.groupBy("px", "py").agg(F.max_by(value, F.struct(*priority)).alias(value), F.count(F.lit(1)).alias("layers"))


def pool(pixels: DataFrame, factor: int, value: str) -> DataFrame:
    """Mean of each ``factor`` x ``factor`` block."""
    return pixels.groupBy(F.floor(F.col("px") / factor).alias("px"), F.floor(F.col("py") / factor).alias("py")).agg(F.avg(value).alias(value))


def splat(points: DataFrame) -> DataFrame:
    """The four pixels around each point with bilinear weights (only positive ones)."""
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corners = [(0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)]
    s = F.array(*[F.struct((F.floor("x") + i).alias("px"), (F.floor("y") + j).alias("py"), w.alias("w")) for i, j, w in corners])
    return points.withColumn("_s", F.explode(F.filter(s, lambda e: e["w"] > 0))).select("*", "_s.px", "_s.py", "_s.w").drop("_s")


def splat_mean(points: DataFrame, value: str) -> DataFrame:
    return splat(points).groupBy("px", "py").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def vote(points: DataFrame, label: str) -> DataFrame:
    """Label with the largest bilinear weight at every pixel; ties: smallest."""
    s = splat(points).groupBy("px", "py", label).agg(F.sum("w").alias("w"))
    w = W.partitionBy("px", "py").orderBy(F.desc(F.round("w", 9)), label)
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("px", "py", label, "w")


def _cross(pixels: DataFrame) -> DataFrame:
    o = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy")) for i, j in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])).alias("o")
    return pixels.select("px", "py", o).select((F.col("px") + F.col("o.dx")).alias("px"), (F.col("py") + F.col("o.dy")).alias("py"))


def dilate(pixels: DataFrame) -> DataFrame:
    return _cross(pixels).distinct()


def erode(pixels: DataFrame) -> DataFrame:
    """Pixels whose four neighbours are all set."""
    return _cross(pixels).groupBy("px", "py").agg(F.count(F.lit(1)).alias("_n")).where("_n = 5").drop("_n")


def close(pixels: DataFrame) -> DataFrame:
    return erode(dilate(pixels))


def support(pixels: DataFrame, least: int) -> DataFrame:
    """Pixels, set or not, with ``least`` or more of the five cross positions set."""
    return _cross(pixels).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def regularise(pixels: DataFrame, closing: int = 1, fill_holes: bool = True, min_size: int = 64) -> DataFrame:
    """Support mask ``px, py``: holes filled, closed by squares of the given radius, holes filled again, parts under ``min_size`` pixels dropped."""
    from tessella.sources.storage import cut

    from .graph import components

    def square(p: DataFrame) -> DataFrame:
        r = range(-closing, closing + 1)
        o = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in r for j in r])).alias("o")
        return p.select("px", "py", o).select((F.col("px") + F.col("o.i")).alias("px"), (F.col("py") + F.col("o.j")).alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))

    x = cut(pixels.select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).distinct(), "mask")
    if fill_holes:
        x = cut(filled(x), "mask")
    if closing > 0:
        x = cut(square(square(x).drop("n")).where(F.col("n") == (2 * closing + 1) ** 2).drop("n"), "mask")
        if fill_holes:
            x = cut(filled(x), "mask")
    if min_size > 0:
        pid = (F.col("px") * F.lit(1 << 31) + F.col("py")).cast("long")
        c = components(pixel_edges(x), x.select(pid.alias("id")))
        big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
        x = x.withColumn("id", pid).join(c.join(big, "component").select("id"), "id", "left_semi").select("px", "py")
    return x


def filled(pixels: DataFrame) -> DataFrame:
    """Pixels and the holes among them: unset pixels that no path of unset 4-neighbours joins to the outside.

    Unset pixels of a column are taken as runs, so what is joined and labelled is bounded by the outline, not by the area.
    """
    from tessella.sources.storage import cut

    from .graph import components

    w = W.partitionBy("px").orderBy("py")
    gaps = pixels.withColumn("_p", F.lag("py").over(w)).where(F.col("py") - F.col("_p") > 1).select("px", (F.col("_p") + 1).alias("a"), (F.col("py") - 1).alias("b"))
    ends = pixels.groupBy("px").agg(F.min("py").alias("lo"), F.max("py").alias("hi"))
    gaps = cut(gaps.withColumn("id", F.xxhash64("px", "a")), "gaps")
    nxt = gaps.select((F.col("px") - 1).alias("px"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("dst"))
    touch = gaps.join(nxt, "px").where("a <= b2 and a2 <= b").select(F.col("id").alias("src"), "dst")
    # a run is open if a column beside it is empty, or ends above or below within it
    open_ = None
    for d in (-1, 1):
        side = ends.select((F.col("px") - d).alias("px"), "lo", "hi")
        one = gaps.join(side, "px", "left").where("lo is null or a < lo or b > hi").select("id")
        open_ = one if open_ is None else open_.unionByName(one)
    c = cut(components(touch, gaps.select("id")), "holes")
    outside = c.join(open_.distinct(), "id", "left_semi").select("component").distinct()
    holes = gaps.join(c.join(outside, "component", "left_anti").select("id"), "id", "left_semi")
    return pixels.select("px", "py").unionByName(holes.select("px", F.explode(F.sequence("a", "b")).alias("py")))


def pixel_edges(pixels: DataFrame, by: list[str] = ()) -> DataFrame:
    """4-neighbour pairs of set pixels (of equal ``by``), as ids ``px * 2^31 + py``."""
    pid = (F.col("px") * F.lit(1 << 31) + F.col("py")).cast("long")
    a = pixels.select(*by, "px", "py", pid.alias("src"))
    right = pixels.select(*by, (F.col("px") - 1).alias("px"), "py", pid.alias("dst"))
    down = pixels.select(*by, "px", (F.col("py") - 1).alias("py"), pid.alias("dst"))
    return a.join(right.unionByName(down), [*by, "px", "py"]).select("src", "dst")


def canvas(tiles: DataFrame, width: int) -> DataFrame:
    """Extent, scale and height of a canvas of the given width: one row."""
    e = tiles.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scale = (width - 1) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-12))
    return e.withColumn("scale", scale).withColumn("height", (F.rint((F.col("y1") - F.col("y0")) * F.col("scale")) + 1).cast("long"))
