"""Spatial views over the driver tables, for Spark and, as SQL text, for the oracle.

Customers lie on a lattice of width 40 and are observations, part brands are
features, quantities are measurements, market segments are groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.storage import many

SIDES = (2, 4, 5, 8, 10, 20)
WIDTH = 40

SQL = """
WITH obs AS (
  SELECT c_custkey AS obs_id, CAST(c_custkey % 40 AS BIGINT) AS x, CAST(c_custkey // 40 AS BIGINT) AS y,
         c_mktsegment AS celltype, c_nationkey AS batch, c_acctbal AS bal FROM customer),
expr AS (
  SELECT o.o_custkey AS obs_id, p.p_brand AS gene, SUM(l.l_quantity) AS value
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  GROUP BY o.o_custkey, p.p_brand),
scales AS (SELECT unnest([2, 4, 5, 8, 10, 20]) AS side),
segments AS (
  SELECT CAST(s.side AS BIGINT) AS side, o.obs_id, (o.x // s.side) * 1000 + o.y // s.side AS seg FROM obs o CROSS JOIN scales s),
edges AS (
  SELECT a.obs_id AS src, b.obs_id AS dst, 1.0::DOUBLE AS weight FROM obs a JOIN obs b ON b.x = a.x + 1 AND b.y = a.y
  UNION ALL
  SELECT a.obs_id, b.obs_id, 1.0::DOUBLE FROM obs a JOIN obs b ON b.x = a.x AND b.y = a.y + 1)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return many(c).select(
        F.col("c_custkey").alias("obs_id"),
        (F.col("c_custkey") % WIDTH).cast("long").alias("x"),
        F.floor(F.col("c_custkey") / WIDTH).cast("long").alias("y"),
        F.col("c_mktsegment").alias("celltype"),
        F.col("c_nationkey").alias("batch"),
        F.col("c_acctbal").alias("bal"),
    )


def expr(spark: SparkSession, sf: str) -> DataFrame:
    o = many(table(spark, sf, "orders")).select("o_orderkey", "o_custkey")
    lines = many(table(spark, sf, "lineitem")).select("l_orderkey", "l_partkey", "l_quantity")
    p = many(table(spark, sf, "part")).select("p_partkey", "p_brand")
    rows = lines.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("obs_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def segments(spark: SparkSession, sf: str, sides: tuple[int, ...] = SIDES) -> DataFrame:
    side = F.explode(F.array(*[F.lit(s).cast("long") for s in sides])).alias("side")
    seg = F.floor(F.col("x") / F.col("side")) * 1000 + F.floor(F.col("y") / F.col("side"))
    return obs(spark, sf).select("obs_id", "x", "y", side).select("side", "obs_id", seg.cast("long").alias("seg"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    from tessella.operators.spatial import lattice_edges

    return lattice_edges(obs(spark, sf).select("obs_id", "x", "y"))
