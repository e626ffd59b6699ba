"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k drawn from a Poisson distribution
whose mean is the target repetition rate of its source, weight_s * total / n_s.
The draw inverts the distribution at a uniform number hashed from the seed and the
document's id, so it needs no state, survives task retries and is the same for
every partitioning.  Copies are then shuffled globally: dealt out by a hash of the
copy and sorted by another inside each partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hashable

#: The rates table is broadcast up to so many sources; beyond that it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Above this rate the cumulative probabilities begin near the mean: exp(-rate) underflows soon after.
LARGE_RATE = 700


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column, low: Column) -> Column:
    """Cumulative probabilities of low, low + 1 ... until the tail is beyond double precision.

    The first probability is taken from its logarithm (by Stirling's series) where exp(-rate) would underflow.
    """
    top = F.ceil(rate + F.sqrt(rate) * 10 + 20).cast("int")
    k0 = F.greatest(low, F.lit(1)).cast("double")
    log_p = k0 * F.log(rate / k0) + k0 - rate - F.log(k0 * (2 * math.pi)) / 2 - 1 / (k0 * 12) + 1 / (F.pow(k0, 3.0) * 360)
    first = F.when(low > 0, F.exp(log_p)).otherwise(F.exp(-rate))
    start = F.struct(F.array().cast("array<double>").alias("cdf"), first.alias("p"), F.lit(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        p = F.when(k == low, acc["p"]).otherwise(acc["p"] * rate / k)
        total = acc["sum"] + p
        return F.struct(F.concat(acc["cdf"], F.array(total)).alias("cdf"), p.alias("p"), total.alias("sum"))

    return F.aggregate(F.sequence(low, top), start, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, total: float | None = None, source_col: str = "source") -> DataFrame:
    """``source, n, rate, low, cdf``: the mean number of copies of each source's documents.

    ``targets``: weights by source (they need not add up to 1; sources without one get
    weight 0, and so disappear).  Without ``targets``, a source's weight is its share to the power
    ``temperature``.  ``total``: documents wanted (default: as many as there are).  A null source is a source of its own.
    ``cdf`` begins at ``low`` copies, below which a large rate's draws have a probability under 1e-20: less than
    the smallest step of the uniform numbers.
    """
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if targets is None:
        w = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, w double")
        w = n.join(F.broadcast(table), n["source"].eqNullSafe(table["source"]), "left").select(n["source"], "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = w.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n").cast("double") if total is None else F.lit(float(total))
    rate = F.coalesce(F.try_divide(F.col("w") * wanted, F.col("all_w") * F.col("n")), F.lit(0.0))
    out = w.join(F.broadcast(sums)).select("source", "n", rate.alias("rate"))
    low = F.when(F.col("rate") > LARGE_RATE, F.floor(F.col("rate") - F.sqrt("rate") * 10)).otherwise(0).cast("int")
    return out.withColumn("low", low).withColumn("cdf", poisson_cdf(F.col("rate"), F.col("low")))


def replicate(docs: DataFrame, rate_table: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", names: tuple[str, str, str] = ("rate", "n_copies", "copy"), keep: list[str] | None = None) -> DataFrame:
    """Each row as often as its draw says, in a global pseudo-random order; every row's columns, the rate, the number of copies and the copy's number (from 0).

    The draw depends on the seed and the id alone: rows that repeat an id are repeated
    alike.  A null id draws as the text ``null``.  Columns that already have one of the ``names`` are replaced.
    """
    spark = docs.sparkSession
    small = rate_table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    r_src, r_rate, r_low, r_cdf = fresh(docs, "_source", "_rate", "_low", "_cdf")
    table = rate_table.select(F.col("source").alias(r_src), F.col("rate").alias(r_rate), F.col("low").alias(r_low), F.col("cdf").alias(r_cdf))
    name = F.coalesce(docs[id_col].cast("string"), F.lit("null"))
    joined = docs.join(F.broadcast(table) if small else table, docs[source_col].eqNullSafe(table[r_src]))
    u = uniform(seed, name)
    n = F.col(r_low) + F.size(F.filter(F.col(r_cdf), lambda c: c <= u))
    rate, copies, copy = names
    rows = joined.select(*[docs[c] for c in keep], F.col(r_rate).alias(rate), n.alias(copies), name.alias(r_src)).where(F.col(copies) > 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy))
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the row's own columns spread rows that share an id, or have none
    own = [F.col(f"`{c}`") for c in hashable(rows) if c in keep]
    spot = F.xxhash64(r_src, copy, F.lit(seed), *own)
    return rows.repartition(n_parts, spot).sortWithinPartitions(F.xxhash64(spot, F.lit(1)), r_src, copy).drop(r_src)
