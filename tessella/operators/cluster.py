"""Graph communities and self-organising maps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.stats import hashed
from tessella.sources.storage import cut


def modularity(w: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Newman's modularity of ``labels`` (id, cluster) on ``w`` (i, j, weight in both directions; a loop counts once)."""
    a = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci"))
    b = labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    e = w.join(a, "i").join(b, "j")
    by = e.groupBy(F.col("ci").alias("c")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("weight")).otherwise(0.0)).alias("inside"))
    r = by.agg(F.sum("k").alias("m"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return r.inside / r.m - resolution * r.kk / r.m**2 if r.m else 0.0


def _moves(w: DataFrame, degree: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """Labels after rounds of moves.

    In a round, half of the nodes (by a hash of node and round) may move to the neighbouring cluster with
    the largest gain; of two single nodes only the one with the larger label moves, so they do not swap.
    """
    labels = cut(degree.select("id", F.col("id").alias("cluster"), "k"), "clusters")
    best, best_q = labels, modularity(w, labels, resolution)
    stale = 0
    for r in range(rounds):
        sums = labels.groupBy("cluster").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
        to = labels.select(F.col("id").alias("j"), "cluster")
        links = w.where("i <> j").join(to, "j").groupBy(F.col("i").alias("id"), "cluster").agg(F.sum("weight").alias("to"))
        own = labels.select("id", "k", F.col("cluster").alias("own"))
        # a node's own cluster is a choice even where none of its neighbours is in it
        choice = links.unionByName(labels.select("id", "cluster", F.lit(0.0).alias("to"))).groupBy("id", "cluster").agg(F.sum("to").alias("to"))
        x = choice.join(own, "id").join(sums, "cluster")
        here = F.col("cluster") == F.col("own")
        gain = F.col("to") - resolution * F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / total
        x = x.withColumn("gain", gain).withColumn("stay", here).withColumn("alone", F.col("size") == 1)
        pick = x.groupBy("id").agg(
            F.max(F.when(F.col("stay"), F.col("gain"))).alias("now"),
            F.max(F.when(F.col("stay"), F.col("alone"))).alias("single"),
            F.max_by(F.struct("cluster", "gain", "alone"), F.struct("gain", -F.col("cluster"))).alias("b"),
        )
        swap = F.col("single") & F.col("b.alone") & (F.col("b.cluster") > F.col("own"))
        turn = F.substring(hashed(r, "id"), 1, 1) < "8"
        moved = own.join(pick, "id", "left").select("id", F.when(turn & (F.col("b.gain") > F.col("now") + 1e-12) & ~swap, F.col("b.cluster")).otherwise(F.col("own")).alias("cluster"), "k", "own")
        moved = cut(moved, "clusters")
        labels = moved.select("id", "cluster", "k")
        q = modularity(w, labels, resolution)
        if q > best_q + 1e-9:
            best, best_q, stale = labels, q, 0
        else:
            stale += 1
            if stale == 3:
                break
    return best


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 4) -> DataFrame:
    """Clusters of a weighted graph by modularity: ``id, cluster``, the cluster being its smallest id.

    Nodes move in rounds, clusters are contracted to nodes, and so on while modularity grows.  ``edges``: src, dst, weight, each
    pair once or in both directions; loops go.  The best labels seen are kept, so rounds never make it worse.
    """
    e = edges.where("src <> dst and weight > 0")
    w = cut(e.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight").unionByName(e.select(F.col("dst").alias("i"), F.col("src").alias("j"), "weight")).groupBy("i", "j").agg(F.sum(F.col("weight").cast("double")).alias("weight")), "graph")
    total = w.agg(F.sum("weight")).first()[0]
    labels = cut(w.select(F.col("i").alias("id")).distinct().withColumn("cluster", F.col("id")), "labels")
    for _ in range(levels if total else 0):
        degree = w.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("k"))
        found = _moves(w, degree, total, resolution, rounds).select(F.col("id").alias("cluster"), F.col("cluster").alias("to"))
        if not found.where("cluster <> to").limit(1).count():
            break
        labels = cut(labels.join(found, "cluster").select("id", F.col("to").alias("cluster")), "labels")
        a, b = found.select(F.col("cluster").alias("i"), F.col("to").alias("ci")), found.select(F.col("cluster").alias("j"), F.col("to").alias("cj"))
        w = cut(w.join(a, "i").join(b, "j").groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum("weight").alias("weight")), "graph")
    return labels.select("id", F.min("id").over(W.partitionBy("cluster")).alias("cluster"))


def feature_weights(points: DataFrame, edges: DataFrame, features: list[str], scale: float) -> DataFrame:
    """Edges weighted by the closeness of their ends' features: exp(-d^2 / 2 scale^2); coordinates may be among the features."""
    a = points.select(F.col("obs_id").alias("src"), *[F.col(f).alias(f"a_{f}") for f in features])
    b = points.select(F.col("obs_id").alias("dst"), *[F.col(f).alias(f"b_{f}") for f in features])
    d = sum((F.pow(F.col(f"a_{f}") - F.col(f"b_{f}"), 2.0) for f in features), F.lit(0.0))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", F.exp(-d / (2 * scale * scale)).alias("weight"))


def som(points: DataFrame, features: list[str], side: int, steps: int, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Self-organising map of side x side nodes, in batch: ``obs_id, node`` (row * side + column).

    Nodes start at the points first in hashed order.  In a step every point falls to its nearest node (ties: the smallest),
    and a node becomes the mean of all points weighted by exp(-d^2 / 2 s^2), d being the distance on the map from
    the point's node; s falls from ``sigma`` to half of it.  Only sums by node are shuffled; the map, side^2 rows, is broadcast.
    """
    first = points.select(*features, hashed(seed, "obs_id").alias("_h"), "obs_id").orderBy("_h", "obs_id").limit(side * side)
    nodes = cut(first.withColumn("node", (F.row_number().over(W.orderBy("_h", "obs_id")) - 1).cast("long")).select("node", *[F.col(f).cast("double").alias(f) for f in features]), "map")

    def assign(c: DataFrame) -> DataFrame:
        packed = c.agg(F.array_sort(F.collect_list(F.struct("node", *features))).alias("_c"))
        d = lambda m: sum(((F.col(f) - m[f]) * (F.col(f) - m[f]) for f in features), F.lit(0.0))
        best = F.array_min(F.transform("_c", lambda m: F.struct(d(m).alias("d"), m["node"].alias("node"))))
        return points.crossJoin(F.broadcast(packed)).withColumn("node", best["node"]).drop("_c")

    for step in range(steps):
        s = sigma * (1 - 0.5 * step / max(1, steps - 1))
        sums = assign(nodes).groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in features])
        to = nodes.select(F.col("node").alias("to"))
        dr, dc = F.floor(F.col("to") / side) - F.floor(F.col("node") / side), F.col("to") % side - F.col("node") % side
        h = F.exp(-(dr * dr + dc * dc) / (2 * s * s))
        pulled = to.crossJoin(F.broadcast(sums)).withColumn("h", h).groupBy("to")  # side^4 rows at most
        nodes = cut(pulled.agg(*[(F.sum(F.col("h") * F.col(f)) / F.sum(F.col("h") * F.col("n"))).alias(f) for f in features]).withColumnRenamed("to", "node"), "map")
    return assign(nodes).select("obs_id", "node")


def som_nodes(resolution: float) -> int:
    """Side of the map for a wanted number of nodes."""
    return int(math.sqrt(resolution))
