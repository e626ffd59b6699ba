"""Edge lists ``(src, dst, weight)``: symmetrising, collapsing to segments, weights, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.storage import cut, many


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; weights of repeated edges add up; loops go."""
    both = edges.where("src <> dst").select("src", "dst", "weight")
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return both.unionByName(back).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def symmetrise_max(edges: DataFrame) -> DataFrame:
    """Each unordered pair once (``src < dst``), with the larger weight of its two directions."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


def collapse(edges: DataFrame, segments: DataFrame, by: list[str] = ()) -> DataFrame:
    """Segment graph: ``by, i, j, weight, n, mean`` over edges between different segments, both directions.

    ``segments``: obs_id, seg and ``by`` (such as the scale).  Edges of obs without a segment go.
    """
    a = segments.select(*by, F.col("obs_id").alias("src"), F.col("seg").alias("i"))
    b = segments.select(*by, F.col("obs_id").alias("dst"), F.col("seg").alias("j"))
    cross = many(edges).join(many(a), "src").join(many(b), ["dst", *by]).where("i <> j and i is not null and j is not null")
    pairs = cross.groupBy(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    back = pairs.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "weight", "n")
    return pairs.unionByName(back).withColumn("mean", F.col("weight") / F.col("n"))


def top_neighbours(w: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """The ``k`` heaviest edges of each row; ties by the neighbour's id."""
    order = W.partitionBy(*by, "i").orderBy(F.desc("weight"), "j")
    return w.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def transform_weights(w: DataFrame, how: str, by: list[str] = ()) -> DataFrame:
    """``R`` rows sum to 1, ``B`` all 1, ``D`` all weights (of a group) sum to 1, ``none``."""
    if how == "R":
        return w.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy(*by, "i")))
    if how == "B":
        return w.withColumn("weight", F.lit(1.0))
    if how == "D":
        s = w.groupBy(*by).agg(F.sum("weight").alias("_s")) if by else w.agg(F.sum("weight").alias("_s"))
        joined = w.join(F.broadcast(s), list(by)) if by else w.crossJoin(F.broadcast(s))
        return joined.withColumn("weight", F.col("weight") / F.col("_s")).drop("_s")
    if how == "none":
        return w
    raise ValueError(f"unknown transformation {how!r}")


def smooth(values: DataFrame, edges: DataFrame, sigma: float | None = None) -> DataFrame:
    """Weighted mean of every entity and its neighbours: Gaussian in the edge's ``dist``, or uniform without ``sigma``.

    ``values``: obs_id, dim, value; ``edges``: directed src -> dst with dist.
    """
    w = F.lit(1.0) if sigma is None else F.exp(-F.col("dist") * F.col("dist") / (2 * sigma * sigma))
    own = values.select("obs_id", "dim", "value", F.lit(1.0).alias("w"))
    others = edges.select(F.col("src").alias("obs_id"), "dst", w.alias("w")).join(values.withColumnRenamed("obs_id", "dst"), "dst").select("obs_id", "dim", "value", "w")
    return own.unionByName(others).groupBy("obs_id", "dim").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))


def diffuse(values: DataFrame, weights: DataFrame, steps: int, cut_every: int = 5) -> DataFrame:
    """Repeated averaging y = 1/2 (W + W') x / degree with weights ``src, dst, weight`` (loops allowed); isolated entities stay.

    Lineage is cut every few steps by a table in the shared folder.
    """
    half = weights.select("src", "dst", (F.col("weight") / 2).alias("w")).unionByName(weights.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / 2).alias("w")))
    sym = half.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    deg = sym.groupBy("src").agg(F.sum("w").alias("deg"))
    p = cut(sym.join(deg, "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("p")), "transition")
    x = values
    for step in range(steps):
        moved = p.join(x.withColumnRenamed("obs_id", "dst"), "dst").groupBy(F.col("src").alias("obs_id"), "dim").agg(F.sum(F.col("p") * F.col("value")).alias("_v"))
        x = x.join(moved, ["obs_id", "dim"], "left").select("obs_id", "dim", F.coalesce("_v", "value").alias("value"))
        if (step + 1) % cut_every == 0 and step + 1 < steps:
            x = cut(x, "diffusion")
    return x


def adaptive_gaussian(edges: DataFrame) -> DataFrame:
    """Weights exp(-d^2 / 2 s^2) of directed edges, s the median distance of the source's edges; and a loop of weight 1 for each source."""
    s = edges.groupBy("src").agg(F.percentile("dist", F.lit(0.5)).alias("_s"))
    w = edges.join(s, "src").select("src", "dst", F.exp(-F.try_divide(F.col("dist") * F.col("dist"), 2 * F.col("_s") * F.col("_s"))).alias("weight"))
    return w.unionByName(s.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight")))


def bilateral(values: DataFrame, edges: DataFrame, sigma_d: float, sigma_v: float, steps: int = 1) -> DataFrame:
    """Mean of self and neighbours weighted by distance and by closeness in value, per dimension."""
    x = values
    for _ in range(steps):
        me = x.select(F.col("obs_id").alias("src"), "dim", F.col("value").alias("v"))
        it = x.select(F.col("obs_id").alias("dst"), "dim", F.col("value").alias("u"))
        w = F.exp(-F.col("dist") * F.col("dist") / (2 * sigma_d**2)) * F.exp(-F.pow(F.col("u") - F.col("v"), 2.0) / (2 * sigma_v**2))
        terms = edges.select("src", "dst", "dist").join(me, "src").join(it, ["dst", "dim"]).groupBy("src", "dim").agg(F.sum(w * F.col("u")).alias("_a"), F.sum(w).alias("_b"))
        x = me.join(terms, ["src", "dim"], "left").select(F.col("src").alias("obs_id"), "dim", ((F.col("v") + F.coalesce("_a", F.lit(0.0))) / (1 + F.coalesce("_b", F.lit(0.0)))).alias("value"))
    return x


def _neighbourhood_mean(x: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    own = x.select("obs_id", "dim", *columns)
    others = edges.select(F.col("src").alias("obs_id"), "dst").join(x.withColumnRenamed("obs_id", "dst"), "dst").select("obs_id", "dim", *columns)
    return own.unionByName(others).groupBy("obs_id", "dim").agg(*[F.avg(c).alias(c) for c in columns])


def guided(values: DataFrame, edges: DataFrame, eps: float) -> DataFrame:
    """Self-guided filter: a = var / (var + eps), b = mean - a mean, both averaged over neighbourhoods; a x + b."""
    sq = values.withColumn("sq", F.col("value") * F.col("value"))
    m = _neighbourhood_mean(sq, edges, ["value", "sq"])
    var = F.greatest(F.col("sq") - F.col("value") * F.col("value"), F.lit(0.0))
    ab = m.select("obs_id", "dim", (var / (var + eps)).alias("a"), ((1 - var / (var + eps)) * F.col("value")).alias("b"))
    mean = _neighbourhood_mean(ab, edges, ["a", "b"])
    return values.join(mean, ["obs_id", "dim"]).select("obs_id", "dim", (F.col("a") * F.col("value") + F.col("b")).alias("value"))


def heat(values: DataFrame, weights: DataFrame, t: float, tail: float = 1e-8, longest: float = 16.0, cut_every: int = 4) -> DataFrame:
    """exp(-t (I - P)) x as a Poisson mixture of powers of the row-normalised weights P.

    Times beyond ``longest`` are steps of equal length one after another; in each, terms are added until what is left of the
    mixture's mass is under ``tail`` of it, however many that takes.  Lineage is cut every few terms.
    """
    import math

    p = cut(transform_weights(weights.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight"), "R"), "transition")
    steps = max(1, math.ceil(t / longest))
    s, out = t / steps, values.select("obs_id", "dim", F.col("value").cast("double").alias("value"))
    for _ in range(steps):
        k, term, left = 0, math.exp(-s), 1 - math.exp(-s)
        x = out.select("obs_id", "dim", F.col("value").alias("x"), (F.col("value") * term).alias("sum"))
        while left > tail / steps or k < s:
            k += 1
            term *= s / k
            left -= term
            moved = p.join(x.select(F.col("obs_id").alias("j"), "dim", "x"), "j").groupBy(F.col("i").alias("obs_id"), "dim").agg(F.sum(F.col("weight") * F.col("x")).alias("_x"))
            new = F.coalesce("_x", F.lit(0.0))
            x = x.join(moved, ["obs_id", "dim"], "left").select("obs_id", "dim", new.alias("x"), (F.col("sum") + new * term).alias("sum"))
            if k % cut_every == 0:
                x = cut(x, "heat")
        out = cut(x.select("obs_id", "dim", F.col("sum").alias("value")), "heat")
    return out


def boundary_edges(pixels: DataFrame, by: list[str] = ()) -> DataFrame:
    """4-neighbour pixel pairs of different segments: ``by, i < j, weight`` (their number).  ``pixels``: px, py, seg."""
    right = pixels.select(*by, (F.col("px") + 1).alias("px"), "py", F.col("seg").alias("s"))
    down = pixels.select(*by, "px", (F.col("py") + 1).alias("py"), F.col("seg").alias("s"))
    pairs = pixels.join(right.unionByName(down), [*by, "px", "py"]).where("seg <> s")
    return pairs.groupBy(*by, F.least("seg", "s").alias("i"), F.greatest("seg", "s").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each node (``id``): labels spread along edges and jump to their own label's label."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct(), "links")
    x = cut(nodes.select("id", F.col("id").alias("component")), "labels")
    for _ in range(rounds):
        seen = both.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("_m"))
        new = x.join(seen, "id", "left").select("id", F.least("component", F.coalesce("_m", "component")).alias("new"), "component")
        jump = new.select(F.col("id").alias("new"), F.col("new").alias("_j"))
        y = cut(new.join(jump, "new", "left").select("id", F.least("new", F.coalesce("_j", "new")).alias("component"), "component", F.lit(0)).toDF("id", "component", "old", "_z").drop("_z"), "labels")
        if not y.where("component <> old").limit(1).count():
            return y.select("id", "component")
        x = y.select("id", "component")
    raise RuntimeError("labels still move")
