"""Statistics as column expressions and small DataFrame helpers.

Quantiles are exact and linear between neighbours, standard deviations of a whole
population unless named otherwise, and divisions by zero give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, lo, hi) -> Column:
    """``x`` limited to [lo, hi]; null stays null."""
    x = col(x)
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def half_even(x: Column | str) -> Column:
    return F.rint(col(x))


def is_close(a: Column, b: Column, atol: float, rtol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def finite(x: Column | str) -> Column:
    """``x`` as double, null where it is NaN or infinite."""
    x = col(x).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def min_rank(order: Column, by: list[str]) -> Column:
    """Competition rank: equal values share the smallest place."""
    return F.rank().over(W.partitionBy(*by).orderBy(order))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean place."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / F.lit(2.0)


def average_percentile(value: str, by: list[str]) -> Column:
    return average_rank(value, by) / F.count(value).over(W.partitionBy(*by))


def minmax(x: Column | str, by: list[str], mode: str = "unit") -> Column:
    """Scale to [0, 1] in a group.  ``mode``: what a zero range becomes - ``unit`` 1, ``eps`` range + 1e-10, ``floor`` at least 1e-12."""
    x, w = col(x), W.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    if mode == "unit":
        return (x - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)
    if mode == "eps":
        return (x - lo) / (hi - lo + 1e-10)
    return (x - lo) / F.greatest(hi - lo, F.lit(1e-12))


def zscore(x: Column | str, by: list[str], floor: float = 1e-8) -> Column:
    x, w = col(x), W.partitionBy(*by)
    return (x - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))


def quantile(x: Column | str, q: float) -> Column:
    return F.percentile(col(x).cast("double"), F.lit(q))


def with_quantiles(df: DataFrame, value: str, qs: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Join exact quantiles of ``value`` (of each group, or of all rows) as columns."""
    aggs = [quantile(value, q).alias(n) for n, q in qs.items()]
    if by:
        return df.join(df.groupBy(*by).agg(*aggs), list(by))
    return df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row


def benjamini_hochberg(df: DataFrame, p: str, name: str, by: list[str], tie: list[str]) -> DataFrame:
    """False discovery rates within each group; null p-values do not count and stay null."""
    ok = df.where(F.col(p).isNotNull())
    w = W.partitionBy(*by)
    n, r = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(p, *tie))
    raw = ok.withColumn("_raw", F.col(p) * n / r)
    back = W.partitionBy(*by).orderBy(p, *tie).rowsBetween(0, W.unboundedFollowing)
    out = raw.withColumn(name, F.least(F.min("_raw").over(back), F.lit(1.0))).drop("_raw")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def hashed(*parts: Column | str | int) -> Column:
    """MD5 of the parts, as hexadecimal text: a pseudo-random order that is the same for every partitioning and engine."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") if not isinstance(p, int) else F.lit(str(p)) for p in parts]).cast("binary"))


def hashed_int(digits: int, *parts: Column | str | int) -> Column:
    """The first ``digits`` (at most 15) hexadecimal digits of ``hashed`` as a number."""
    return F.conv(F.substring(hashed(*parts), 1, digits), 16, 10).cast("long")


def weighted_average(v: Column, w: Column) -> Column:
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation; null where one side does not vary."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def normal_sf(z: Column | str) -> Column:
    """Upper tail of the standard normal distribution.

    A continued fraction for large arguments and a series for small ones, both of fixed
    length, so it stays in generated code; relative error below 1e-12 up to z = 37.
    """
    z = col(z).cast("double")
    a = F.abs(z)
    # series: Phi(a) - 1/2 = phi(a) * sum a^(2k+1) / (1*3*5*...*(2k+1))
    phi = F.exp(-a * a / 2) * 0.3989422804014327
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("t"), a.alias("s")),
        lambda acc, k: F.struct((acc["t"] * a * a / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * a * a / (2 * k + 1)).alias("s")),
        lambda acc: acc["s"],
    )
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k.cast("double") / acc)
    upper = F.when(a < 3, F.lit(0.5) - phi * series).otherwise(phi / fraction)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi2_sf_even(x: Column | str, k: Column | str) -> Column:
    """Upper tail of chi-squared with ``2 k`` degrees of freedom: exp(-x/2) sum (x/2)^i / i!, i < k."""
    h, k = col(x).cast("double") / 2, col(k)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda acc, i: F.struct((acc["t"] * h / i).alias("t"), (acc["s"] + acc["t"] * h / i).alias("s")),
        lambda acc: acc["s"],
    )
    return F.exp(-h) * F.when(k <= 1, 1.0).otherwise(terms)
