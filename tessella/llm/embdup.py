"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors x are stored as integers q with one scale s each: x = s q + e,
|e| <= r.  For two vectors  |x.y - s_x s_y q_x.q_y| <= |s_x q_x| r_y + |s_y q_y| r_x + r_x r_y,
with the norms and residuals computed per vector and rounded up.  A tile product
of integers (exact in float32 up to 2**24, beyond that in double precision) therefore proves most pairs to be
under the threshold; only pairs possibly above it are computed again in double
precision.

Which tiles meet is decided without looking at pairs: vectors belong to the
nearest of a bounded set of pivots, a cell knows its angular radius, and by the triangle
inequality cells further apart than the threshold's angle and both radii hold no link.
Equal vectors are one vector with a weight.  A tile pair returns, for each of its
vectors, the weight of its links, and a spanning forest: its output is linear in
its input however dense the links are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, map_rows, ship

#: Vectors of a tile, and at most so many pivots (they are all that reaches the driver).  There are
#: no more pivots than tiles, so cells hold whole tiles and a vector is sent once for each tile it meets.
TILE, PIVOTS = 4096, 256


def unit(values: list) -> np.ndarray | None:
    """The vector in double precision at length 1; None if it can link with nothing."""
    if values is None or not len(values) or (isinstance(values, list) and None in values):
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x /= top
    return x / np.linalg.norm(x)


def pack_vector(values: list) -> bytes:
    """The components as they were given: float32 where that loses nothing."""
    x = np.array(values, np.float64)
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return b"4" + short.tobytes() if (short == x).all() else b"8" + x.tobytes()


def unpack_unit(data: bytes) -> np.ndarray:
    return unit(np.frombuffer(data, np.float32 if data[:1] == b"4" else np.float64, offset=1))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows, scale, |s q| and an upper bound of the residual's length."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    r = np.linalg.norm(x - back, axis=1) * (1 + 1e-9) + 1e-12
    return q, s, np.linalg.norm(back, axis=1) * (1 + 1e-9), r


class _Tile:
    def __init__(self, ids: list[int], weights: list[int], data: list[bytes]):
        self.ids, self.w = np.array(ids, np.int64), np.array(weights, np.int64)
        self.x = np.stack([unpack_unit(d) for d in data])
        self.q, self.s, self.n, self.r = quantise(self.x)


def link_tiles(a: _Tile, b: _Tile | None, least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights of the links of a's and of b's vectors, and a spanning forest of the links."""
    same, b = b is None, a if b is None else b
    wa, wb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    label = np.arange(len(a.ids) + (0 if same else len(b.ids)))
    shift = 0 if same else len(a.ids)
    forest: list[tuple[int, int]] = []
    # integers stay exact: a partial sum is at most the product of the lengths
    length = [float(np.sqrt((t.q.astype(np.float64) ** 2).sum(axis=1).max())) for t in (a, b)]
    kind = np.float32 if length[0] * length[1] < 2**24 else np.float64
    bq = b.q.astype(kind).T
    bs, bn, br = (v.astype(np.float32) for v in (b.s, b.n, b.r))
    for i in range(0, len(a.ids), 256):
        part = slice(i, i + 256)
        product = (a.q[part].astype(kind) @ bq).astype(np.float32, copy=False)
        product *= bs
        bound = np.outer(a.n[part], br) + np.outer(a.r[part], bn + br)
        product *= a.s[part].astype(np.float32)[:, None]
        product += bound.astype(np.float32)
        rows, cols = np.nonzero(product >= np.float32(least - 1e-5))  # 1e-5 covers the roundings of float32
        if same:
            upper = cols > rows + i
            rows, cols = rows[upper], cols[upper]
        for j in range(0, len(rows), 1 << 16):
            r, c = rows[j : j + (1 << 16)] + i, cols[j : j + (1 << 16)]
            ok = np.einsum("ij,ij->i", a.x[r], b.x[c]) >= least
            r, c = r[ok], c[ok]
            np.add.at(wa, r, b.w[c])
            np.add.at(wb, c, a.w[r])
            while len(r):
                open_ = label[r] != label[c + shift]
                r, c = r[open_], c[open_]
                if not len(r):
                    break
                u, v = label[r[0]], label[c[0] + shift]
                star = r == r[0]  # all links of one vector at once
                olds = np.unique(label[c[star] + shift])
                firsts = {int(label[x + shift]): x for x in c[star][::-1].tolist()}
                for o in olds.tolist():
                    if o != u:
                        forest.append((int(a.ids[r[0]]), int(b.ids[firsts[o]])))
                label[np.isin(label, np.append(olds, u))] = min(int(olds.min()), int(u))
    if same:
        wa = wa + wb
        wb = np.zeros(0, np.int64)
    return wa, wb, forest


def _pivots(vectors: DataFrame, n: int, total: int) -> np.ndarray:
    """Up to ``n`` pivots: from a hash sample of at most 16 n vectors, each as far as possible from those before it."""
    u = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    got = vectors.where(u < 16 * n / max(1, total)).select("id", "x").orderBy("id").limit(32 * n).collect() or vectors.select("id", "x").limit(1).collect()
    if not got:
        return np.zeros((0, 1))
    got = [r for r in got if len(r.x) == len(got[0].x)]
    x = np.stack([unpack_unit(r.x) for r in got])
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        i = int(near.argmin())
        if near[i] > 0.9:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    return x[chosen]


def near_duplicates(rows: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Pairs link when their cosine, in double precision, is ``least`` or more.  Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of different lengths do not link.  A row
    with a null id links with nothing, has a null component and is kept; rows that repeat an id count as
    separate vectors and share its component.  Other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)

    def make():
        def f(v):
            units = [(y, unit(y)) for y in v.to_pylist()]
            raw = [None if x is None else pack_vector(y) for y, x in units]
            return [pa.array(raw, pa.binary()), pa.array([None if x is None else hashlib.sha256(x.tobytes()).digest() for _, x in units], pa.binary())]

        return f

    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    drawn = cut(map_rows(picked, ["v"], [("x", T.BinaryType()), ("fp", T.BinaryType())], make, keep=["vec_id"]), "vectors")
    named = drawn.where("fp is not null and vec_id is not null")
    # the digest names a direction; its rows are one vector with a weight
    distinct = cut(named.groupBy("fp").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"), F.min_by("x", "vec_id").alias("x")), "distinct")
    copies = named.select("vec_id", "fp").join(distinct.select("fp", "id", "w"), "fp")

    total = distinct.count()
    several = distinct.select(F.expr("substring(x, 1, 1) = binary('8')").alias("wide"), F.length("x").alias("n")).select(F.when(F.col("wide"), F.col("n") - 1).otherwise((F.col("n") - 1) * 2).alias("n")).distinct().limit(2).count() > 1
    # a tile holds vectors of one length; where lengths differ, cells are lengths instead
    centre = np.zeros((0, 1)) if several or not total else _pivots(distinct.select("id", "x"), min(pivots, -(-total // tile)), total)

    def assign():
        def f(x):
            vs = [unpack_unit(b) for b in x.cast(pa.binary()).to_pylist()]
            if not len(centre):
                return [pa.array([len(v) for v in vs], pa.int32()), pa.array([0.0] * len(vs), pa.float64())]
            c = np.stack(vs) @ centre.T
            best = c.argmax(axis=1)
            return [pa.array(best.astype(np.int32)), pa.array(np.arccos(np.clip(c[np.arange(len(vs)), best], -1, 1)))]

        return f

    cells = cut(map_rows(distinct.select("id", "w", "x"), ["x"], [("cell", T.IntegerType()), ("angle", T.DoubleType())], assign), "cells")
    about = {r.cell: (r.n, r.radius) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    angle = float(np.arccos(np.clip(least, -1, 1)))
    meets: list[tuple[int, int]] = []
    for p in sorted(about):
        for q in sorted(about):
            if p <= q and (p == q or (len(centre) and float(np.arccos(np.clip(centre[p] @ centre[q], -1, 1))) <= angle + about[p][1] + about[q][1] + 1e-9)):
                meets.append((p, q))
    tiles = {c: -(-n // tile) for c, (n, _) in about.items()}
    pairs = spark.createDataFrame(meets + [(q, p) for p, q in meets if p != q], "cell int, other int") if meets else spark.createDataFrame([], "cell int, other int")
    count = F.create_map(*[F.lit(v) for c, n in tiles.items() for v in (c, n)]) if tiles else F.create_map().cast("map<int,int>")
    placed = cells.withColumn("t", F.pmod(F.xxhash64("id"), count[F.col("cell")]).cast("int"))
    spread = placed.join(F.broadcast(pairs), "cell").withColumn("u", F.explode(F.sequence(F.lit(0), count[F.col("other")] - 1)))
    first = F.struct("cell", "t") <= F.struct(F.col("other").alias("cell"), F.col("u").alias("t"))
    me, it = F.struct("cell", "t"), F.struct(F.col("other").alias("cell"), F.col("u").alias("t"))
    work = spread.select(F.when(first, me).otherwise(it).alias("a"), F.when(first, it).otherwise(me).alias("b"), F.when(first, 0).otherwise(1).alias("side"), "id", "w", "x")
    work = work.select("a.cell", "a.t", F.col("b.cell").alias("cell2"), F.col("b.t").alias("t2"), "side", "id", "w", "x")
    work = work.withColumn("task", F.xxhash64("cell", "t", "cell2", "t2")).repartition("task").sortWithinPartitions("task", "cell", "t", "cell2", "t2", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, ([], [])

        def solve() -> pa.RecordBatch:
            a = _Tile(*zip(*held[0], strict=True)) if held[0] else None
            b = _Tile(*zip(*held[1], strict=True)) if held[1] else None
            ids, links, other = [], [], []
            if a is not None and (b is not None or task[:2] == task[2:]):
                wa, wb, forest = link_tiles(a, b, least)
                for t, w in ((a, wa), (b, wb)):
                    if t is not None:
                        some = w > 0
                        ids += t.ids[some].tolist()
                        links += w[some].tolist()
                other = [None] * len(ids) + [v for _, v in forest]
                ids += [u for u, _ in forest]
                links += [None] * len(forest)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], names=["u", "v", "links"])

        for b in batches:
            for *key, side, i, w, x in zip(*[b.column(c).to_pylist() for c in range(8)], strict=True):
                if task is None or tuple(key) != task:
                    if task is not None:
                        yield solve()
                    task, held = tuple(key), ([], [])
                held[side].append((i, w, x))
        if task is not None:
            yield solve()

    found = cut(work.drop("task").mapInArrow(run, "u long, v long, links long"), "tile_links")
    degree = found.where("links is not null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    same_id = copies.select(F.col("vec_id").alias("u"), F.col("id").alias("v")).where("u <> v")
    joined = components(found.where("v is not null").select("u", "v").unionAll(same_id)).select(F.col("id").alias("vec_id"), "component")
    per_row = copies.join(degree, "id", "left").select("vec_id", "fp", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).dropDuplicates(["vec_id", "fp"])
    out = drawn.select("vec_id", "fp").join(per_row, ["vec_id", "fp"], "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
