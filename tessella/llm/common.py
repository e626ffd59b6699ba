"""Helpers shared by the training-data operators.

* ``workspace`` / ``cut``: intermediate tables in the cluster's shared checkpoint
  folder, so that a lost executor never loses a cut lineage;
* ``components``: connected components by contraction, all in DataFrames;
* ``map_rows``: a typed ``mapInArrow`` that keeps the input columns;
* small vectorised hashing routines for numpy.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
_OWN_DIR: dict[str, str] = {}

MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


#: Bytes of an Arrow batch, where the session has set no limit of its own: texts can be long, and a
#: Python worker and its executor hold a few copies of a batch.  Rows of a batch stay as they are set.
BATCH_BYTES = 2 << 20
#: Bytes of a row group of intermediate tables: what a writing task holds in memory.
GROUP_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and bound Arrow batches by bytes."""
    sc = spark.sparkContext
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == _default(spark, limit):
        spark.conf.set(limit, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tessella-")
    target = os.path.join(folder, "tessella_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(Path(package.name) / p.relative_to(package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def _default(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(name)


def workspace(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where a session on a
    single machine names none.  On a cluster the executors would not share that, so there it is an error."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="tessella-work-")
        base = "file://" + _OWN_DIR[app]
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Paths of intermediate tables made within each open ``scratch``.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, keep: Callable[[], DataFrame | None]) -> Iterator[None]:
    """Removes the intermediate tables that were made inside, but for the files of ``keep()`` (asked at the end).

    For work whose result is written by then: nothing may read the other tables later.  An error leaves them.
    """
    _MADE.append([])
    try:
        yield
        result = keep()
        kept = set() if result is None else {f.rsplit("/", 1)[0] for f in result.inputFiles()}
        for path in _MADE[-1]:
            if not any(k.endswith(path.split(":", 1)[-1].lstrip("/")) for k in kept):
                drop_path(spark, path)
    finally:
        _MADE.pop()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _MADE:
        made.append(path)
    return path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark can hash (maps and variants it cannot)."""
    return [f.name for f in df.schema if not re.search(r"\b(map<|variant)", f.dataType.simpleString())]


def map_rows(
    df: DataFrame,
    columns: list[str],
    added: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed batch by batch in Python.

    ``make()`` runs once in each task and returns a function from the Arrow
    arrays of ``columns`` to one Arrow array for each added column.
    ``keep`` names the input columns to return (default: all).
    """
    ship(df.sparkSession)
    keep = df.columns if keep is None else keep
    need = list(dict.fromkeys([*keep, *columns]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                new = f(*[b.column(need.index(c)) for c in columns])
                yield pa.RecordBatch.from_arrays([b.column(need.index(c)) for c in keep] + list(new), names=[*keep, *[n for n, _ in added]])
        pa.default_memory_pool().release_unused()

    return df.select(*[F.col(f"`{c}`") for c in need]).mapInArrow(run, schema)


def text_scores(make: Callable[[], Callable[[pa.Array], pa.Array]], text: Column) -> Column:
    """A number for each text: only the texts travel to Python, and only numbers come back.

    ``make()`` runs once in each task and returns a function from texts (Arrow) to doubles.
    """

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for t in texts:
            yield f(t)
        pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, T.DoubleType())(text.cast("string"))


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def str_texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x < y:
            self.up[y] = x
        else:
            self.up[x] = y
        return True


def _thin(edges: DataFrame) -> DataFrame:
    """Within each partition, replace edges by a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            us, vs = [], []
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(u), find(v)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    us.append(max(u, v))
                    vs.append(min(u, v))
            if len(up) > 2_000_000:  # forgetting only keeps more edges
                up.clear()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges ``(u long, v long)``.

    Returns ``(id, component)`` for every id on an edge, component being the
    smallest id reachable.  Each round hooks every node to its smallest
    neighbour, shortens those trees, and contracts the edges onto their roots;
    the number of edges that remain at least halves in the usual case.  Edges
    are thinned to a forest in each partition first, so a hub costs each task
    at most one row for each of its own nodes.  Loops, repeated edges and nulls are ignored; an
    empty input gives an empty result.  Lineage is cut by tables in the shared folder.
    """
    spark = edges.sparkSession
    e = cut(_thin(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v").distinct()), "edges")
    label: DataFrame | None = None
    while e.limit(1).count():
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("p")), "hook")
        while True:  # to the roots, halving the depth each time
            up = hook.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            shorter = cut(hook.join(up, "p").select("x", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "hook")
            hook = shorter.select("x", "p")
            if not shorter.where("moved").limit(1).count():
                break
        if label is None:
            label = hook.select(F.col("x").alias("id"), F.col("p").alias("component"))
        else:
            to = hook.select(F.col("x").alias("component"), F.col("p").alias("q"))
            label = cut(label.join(to, "component", "left").select("id", F.coalesce("q", "component").alias("component")), "label")
        a = hook.select(F.col("x").alias("u"), F.col("p").alias("pu"))
        b = hook.select(F.col("x").alias("v"), F.col("p").alias("pv"))
        e = cut(_thin(e.join(a, "u").join(b, "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct()), "edges")
    return spark.createDataFrame([], "id long, component long") if label is None else label
