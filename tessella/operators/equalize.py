"""Value equalisation per dimension: ``obs_id, dim, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import clip, minmax, quantile, with_quantiles

_KEEP = ("obs_id", "dim", "value")


def balance(x: DataFrame, left: float, right: float) -> DataFrame:
    """Clip to the ``left`` and ``1 - right`` quantiles, then scale to [0, 1]."""
    q = with_quantiles(x, "value", {"_lo": left, "_hi": 1 - right}, ["dim"])
    return q.withColumn("value", F.least(F.greatest("value", "_lo"), F.col("_hi"))).withColumn("value", minmax("value", ["dim"])).select(*_KEEP)


def clipped(x: DataFrame, lo: float, hi: float) -> DataFrame:
    return x.withColumn("value", clip("value", lo, hi)).withColumn("value", minmax("value", ["dim"]))


def piecewise(x: DataFrame, bins: int) -> DataFrame:
    """Equal-width bins, each stretched to its own [0, 1]; a bin's largest value becomes 1."""
    w = W.partitionBy("dim")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    b = F.least(F.floor((F.col("value") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo) * bins), F.lit(bins - 1))
    return x.withColumn("_b", b).withColumn("value", minmax("value", ["dim", "_b"])).select(*_KEEP)


def perceptual(x: DataFrame, strength: float) -> DataFrame:
    """z / (1 + strength |z|), then [0, 1]."""
    w = W.partitionBy("dim")
    z = (F.col("value") - F.avg("value").over(w)) / F.greatest(F.stddev_pop("value").over(w), F.lit(1e-12))
    return x.withColumn("value", z / (1 + strength * F.abs(z))).withColumn("value", minmax("value", ["dim"]))


def ecdf(x: DataFrame) -> DataFrame:
    """Share of values up to and including each, from counts of distinct values."""
    n = x.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("_c"))
    run = F.sum("_c").over(W.partitionBy("dim").orderBy("value"))
    cdf = n.withColumn("_f", run / F.sum("_c").over(W.partitionBy("dim"))).select("dim", "value", "_f")
    return x.join(cdf, ["dim", "value"]).select("obs_id", "dim", F.col("_f").alias("value"))


def histogram(x: DataFrame, bins: int = 256) -> DataFrame:
    """Cumulative share of each value's bin among ``bins`` of equal width."""
    lo_hi = x.groupBy("dim").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    b = F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins), F.lit(bins - 1))
    y = x.join(F.broadcast(lo_hi), "dim").withColumn("_b", b)
    counts = y.groupBy("dim", "_b").agg(F.count(F.lit(1)).alias("_c"))
    cum = counts.withColumn("_f", F.sum("_c").over(W.partitionBy("dim").orderBy("_b")) / F.sum("_c").over(W.partitionBy("dim"))).select("dim", "_b", "_f")
    return y.join(F.broadcast(cum), ["dim", "_b"]).select("obs_id", "dim", F.col("_f").alias("value"))


def alpha(x: DataFrame, lo: float = 0.2, hi: float = 1.0, invert: bool = False) -> DataFrame:
    """Values clipped to their 1 % and 99 % quantiles and mapped to [lo, hi]."""
    q = with_quantiles(x, "value", {"_a": 0.01, "_b": 0.99})
    t = (F.least(F.greatest("value", "_a"), F.col("_b")) - F.col("_a")) / F.when(F.col("_b") == F.col("_a"), 1.0).otherwise(F.col("_b") - F.col("_a"))
    t = 1 - t if invert else t
    return q.withColumn("alpha", lo + t * (hi - lo)).drop("_a", "_b")


#: Methods by name.
METHODS = {"balance": balance, "clip": clipped, "piecewise": piecewise, "perceptual": perceptual, "ecdf": ecdf, "histogram": histogram}


def apply(x: DataFrame, chain: list[tuple]) -> DataFrame:
    """Methods one after another: ``(name, *arguments)`` each."""
    for name, *args in chain:
        if name not in METHODS:
            raise ValueError(f"unknown method {name!r}; one of {sorted(METHODS)}")
        x = METHODS[name](x, *args).select(*_KEEP)
    return x


def edge_scores(before: DataFrame, after: DataFrame, edges: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """How much differences across edges grew: on all edges, on the smallest and largest ones (by the values before), and the shares derived from them.

    contrast = max(0, high ratio - 1); structure = exp(-|ln ratio|); noise = max(0, low ratio - 1);
    saturation = share of values at the ends of [0, 1]; score = contrast * structure / (1 + noise + 2 saturation).
    """
    def diff(v: DataFrame, name: str) -> DataFrame:
        a = v.select(F.col("obs_id").alias("src"), "dim", F.col("value").alias("va"))
        b = v.select(F.col("obs_id").alias("dst"), "dim", F.col("value").alias("vb"))
        return edges.select("src", "dst").join(a, "src").join(b, ["dst", "dim"]).groupBy("src", "dst").agg(F.avg(F.abs(F.col("va") - F.col("vb"))).alias(name))

    d = with_quantiles(diff(before, "d0").join(diff(after, "d1"), ["src", "dst"]), "d0", {"_l": low, "_h": high})
    eps = F.lit(1e-9)

    def ratio(cond) -> F.Column:
        return F.avg(F.when(cond, F.col("d1"))) / F.greatest(F.avg(F.when(cond, F.col("d0"))), eps)

    r = d.agg(ratio(F.lit(True)).alias("all"), ratio(F.col("d0") <= F.col("_l")).alias("lo"), ratio(F.col("d0") >= F.col("_h")).alias("hi"))
    sat = after.agg(F.avg(((F.col("value") <= 0.01) | (F.col("value") >= 0.99)).cast("double")).alias("saturation"))
    x = r.crossJoin(F.broadcast(sat))
    contrast, noise = F.greatest(F.col("hi") - 1, F.lit(0.0)), F.greatest(F.col("lo") - 1, F.lit(0.0))
    structure = F.exp(-F.abs(F.log(F.greatest("all", eps))))
    return x.select(contrast.alias("contrast"), structure.alias("structure"), noise.alias("noise"), "saturation", (contrast * structure / (1 + noise + 2 * F.col("saturation"))).alias("score"))
