"""Near-duplicate documents with SetSketch registers.

A document's set is its distinct word shingles.  A SetSketch has ``m`` registers,
each ``floor(1 - log_b(h))`` of the smallest exponential hash ``h`` of the set's
elements under the register's own hash function.  Truncated minima are mergeable
(register-wise maximum) and two registers are equal with a probability close to
the Jaccard similarity, so:

1. Copies (equal sets) become one representative.
2. Registers are banded.  Buckets with one member fall away; members of the
   others are tied to the bucket's smallest one, a star whose size is linear in
   the bucket.  The components of the stars are *neighbourhoods*: every pair
   that shares a bucket lies in one.
3. In each neighbourhood, pairs are compared in blocks.  The similarity is estimated
   jointly from both sketches by likelihood (Ertl, "SetSketch", 2021); pairs whose
   estimate is far below the threshold fall away.  The others are verified on their full
   sets, most similar first, except where links already found connect them.
   A task returns a spanning forest of the links in its block pair.
4. Components of those links.

Blocks bound what one task holds; large neighbourhoods are spread over their
block pairs.  No pair of a neighbourhood is capped or sampled away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import Forest, byte_texts, components, cut, map_rows, mix64, odd_constants, ship

#: SetSketch parameters of the paper: base, rate, largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65534
ROWS, BANDS = 8, 40
WORDS = 5
#: Estimates lower than this much under the threshold (five standard errors) are not verified.
SLACK = 0.11
#: Most documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000

_MUL = odd_constants(ROWS * BANDS, 11).astype(np.uint32) | np.uint32(1)
_ADD = odd_constants(ROWS * BANDS, 12).astype(np.uint32)
_POS = odd_constants(64, 13)
_BAND = odd_constants(BANDS * 2, 14)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs without ASCII white space, A-Z in lower case.  With fewer
    words than ``words`` the whole sequence is the one shingle; no word, no shingle.
    """
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, n)
    k = min(n, words)
    s = h[: n - k + 1] * _POS[0]
    for i in range(1, k):
        s += h[i : n - k + 1 + i] * _POS[i]
    return np.unique(mix64(s + np.uint64(k)))


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set; all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(ROWS * BANDS, np.uint16)
    x = ((shingles >> np.uint64(32)) ^ (shingles & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _MUL + _ADD).min(axis=0), out=low)
    return registers(low)


def registers(low: np.ndarray) -> np.ndarray:
    """Truncate minima of uniform 32-bit hashes, taken as exponential variables."""
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(sketch).view(np.uint64).reshape(BANDS, 2)
    return mix64(mix64(parts[:, 0] ^ _BAND[:BANDS]) + parts[:, 1] * _BAND[BANDS:]).view(np.int64)


def slope(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: float) -> np.ndarray:
    """Derivative of the joint log likelihood at similarity ``j``.

    ``above`` and ``below`` count registers where the first sketch is larger or smaller.  The
    likelihood has one maximum, so it lies at ``j`` or higher where this is not negative.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    c, log_b = (BASE - 1) / BASE, np.log(BASE)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * c) / log_b

    xa, xb = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    pa_, pb_ = np.maximum(p(xa), 1e-12), np.maximum(p(xb), 1e-12)
    da, db = -v * c / ((1 - xa * c) * log_b), -u * c / ((1 - xb * c) * log_b)
    return above * da / pa_ + below * db / pb_ - equal * (da + db) / np.maximum(1 - pa_ - pb_, 1e-12)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """Similarity of two sketched sets of known sizes at the largest joint likelihood."""
    lo, hi = 0.0, min(n_a, n_b) / max(n_a, n_b)
    d = [np.array([float(x)]) for x in ((a == b).sum(), (a > b).sum(), (a < b).sum(), n_a, n_b)]
    for _ in range(30):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if slope(*d, mid)[0] >= 0 else (lo, mid)
    return (lo + hi) / 2


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, fp (16 bytes of the set's digest), keys (band keys)``."""

    def make():
        def f(_, text):
            sets = [shingle_set(t) for t in byte_texts(text)]
            memo: dict[bytes, np.ndarray] = {}
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            keys = []
            for s, fp in zip(sets, fps, strict=True):
                if len(s) and fp not in memo:
                    memo[fp] = band_keys(set_sketch(s))
                keys.append(memo[fp] if len(s) else None)
            return [pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]

        return f

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(d, ["doc_id", "text"], [("n_shingles", T.LongType()), ("fp", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))], make, keep=["doc_id"])


class _Block:
    """Sets and sketches of the documents of one task."""

    def __init__(self, ids: list[int], sets: list[bytes]):
        self.ids = np.array(ids, np.int64)
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.n = np.array([len(s) for s in self.sets], np.float64)
        self.sketch = np.stack([set_sketch(s) for s in self.sets])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets (sorted, distinct)."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def link_block(x: _Block, y: _Block | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``x``, or between ``x`` and ``y``."""
    same, y = y is None, x if y is None else y
    floor_j = max(0.01, percent / 100 - SLACK)
    found_i, found_j, found_e = [], [], []
    for i in range(len(x.ids)):
        start = i + 1 if same else 0
        n = y.n[start:]
        ok = np.flatnonzero(100 * np.minimum(n, x.n[i]) >= percent * np.maximum(n, x.n[i])) + start
        if not len(ok):
            continue
        other = y.sketch[ok]
        equal = (other == x.sketch[i]).sum(axis=1)
        near = equal >= (floor_j - 0.05) * other.shape[1]  # equal registers alone never estimate more than this below
        ok, other, equal = ok[near], other[near], equal[near]
        if not len(ok):
            continue
        above = (x.sketch[i] > other).sum(axis=1)
        keep = slope(equal, above, other.shape[1] - equal - above, np.full(len(ok), x.n[i]), y.n[ok], floor_j) >= 0
        found_i.append(np.full(keep.sum(), i, np.int32))
        found_j.append(ok[keep].astype(np.int32))
        found_e.append(equal[keep].astype(np.int16))
    if not found_i:
        return []
    fi, fj, fe = map(np.concatenate, (found_i, found_j, found_e))
    order = np.argsort(-fe, kind="stable")
    shift = 0 if same else len(x.ids)
    label = np.arange(len(x.ids) + (0 if same else len(y.ids)))
    out = []
    for k in range(0, len(order), 4096):
        part = order[k : k + 4096]
        part = part[label[fi[part]] != label[fj[part] + shift]]
        for i, j in zip(fi[part].tolist(), fj[part].tolist(), strict=True):
            a, b = label[i], label[j + shift]
            if a != b and linked(x.sets[i], y.sets[j], percent):
                label[label == max(a, b)] = min(a, b)
                out.append((int(x.ids[i]), int(y.ids[j])))
    return out


def _links(work: DataFrame, percent: int) -> DataFrame:
    """``work``: rows (task long, side int, id long, shingles binary), a task's rows together and sides in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, ([], [], [], [])

        def solve() -> pa.RecordBatch | None:
            out: list[tuple[int, int]] = []
            if held[0]:
                x = _Block(held[0], held[1])
                out = link_block(x, _Block(held[2], held[3]) if held[2] else None, percent) if task[1] else link_block(x, None, percent)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["u", "v"]) if out else None

        for b in batches:
            for k, bi, bj, side, i, s in zip(*[b.column(c).to_pylist() for c in range(6)], strict=True):
                if task is None or (k, bi, bj) != task[0]:
                    if task is not None and (r := solve()):
                        yield r
                    task, held = ((k, bi, bj), bi != bj), ([], [], [], [])
                held[2 * side].append(i)
                held[2 * side + 1].append(s)
        if task is not None and (r := solve()):
            yield r

    return work.select("hood", "bi", "bj", "side", "id", "shingles").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents whose shingle sets have 100 * |A & B| >= percent * |A | B| are linked; component_id is the smallest
    id reachable.  Empty or null texts have no shingles and link with nothing, not even each other.  Rows that repeat an
    id are one document of the graph, with the links of all its rows.  A row with a null id gets a null
    component and is kept.  Other columns are not read.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    drawn = cut(sketches(docs, id_col, text_col), "sketches")
    full = drawn.where("n_shingles > 0 and doc_id is not null")
    reps = cut(full.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "reps")
    copies = full.join(reps.where("copies > 1").select("fp", F.col("id").alias("v")), "fp").select(F.col("doc_id").alias("u"), "v").where("u <> v")
    # one row of each set carries its keys on
    owners = full.join(reps.select("fp", F.col("id").alias("doc_id")), ["fp", "doc_id"], "left_semi").dropDuplicates(["fp", "doc_id"])
    keys = cut(owners.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")), "keys")
    first = keys.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("w")).where("v <> w").select("key", "v")
    stars = keys.join(first, "key").select(F.col("id").alias("u"), "v").where("u <> v").distinct()
    hoods = cut(components(stars), "hoods")
    sizes = hoods.groupBy("component").count()
    named = hoods.join(sizes.where("count > 1"), "component").select(F.col("id").alias("doc_id"), F.col("component").alias("hood"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # whole texts of neighbourhood members only; their sets are made again rather than stored for all
    picked = texts.join(named, "doc_id")

    def make():
        def f(text):
            sets = [shingle_set(t) for t in byte_texts(text)]
            return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]

        return f

    sets = map_rows(picked, ["text"], [("shingles", T.BinaryType()), ("n", T.LongType())], make, keep=["doc_id", "hood"])
    sets = cut(sets.where("n > 0"), "sets")
    need = sets.groupBy("hood").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = sets.join(need, "hood").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    work = placed.select("hood", "block", "doc_id", "shingles", other).select(
        "hood",
        F.least("block", "other").alias("bi"),
        F.greatest("block", "other").alias("bj"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.col("doc_id").alias("id"),
        "shingles",
    )
    work = work.withColumn("task", F.xxhash64("hood", "bi", "bj")).repartition("task").sortWithinPartitions("task", "hood", "bi", "bj", "side", "id")
    links = cut(_links(work, percent).unionAll(copies), "links")
    found = components(links)
    out = drawn.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
