"""Best-fit packing of token pieces into fixed-length sequences, in a hierarchy.

1. Every partition packs its own pieces best-fit decreasing and emits bins that
   are (nearly) full.
2. Bins that are not become items themselves.  Groups of ``fan`` partitions merge
   theirs, best-fit again; the groups merge in turn, up to one group.

An any-fit packing leaves at most one bin that is half full or less, so each
partition brings at most one item that another bin could take, and a merge needs at
most as many hosts as it has such items.  Only these travel: a merge has at most
``fan * (fan + 2)`` rows, whatever the data and however many partitions there are.
The pieces themselves stay where they are until the moves of all rounds are known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, map_rows, str_texts
from .tokens import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BINS = f"{PIECE}, sequence_id long, offset long, part int, fill int, open boolean"


def best_fit(sizes: list[int], room: list[int], capacity: int) -> list[int]:
    """Bin of each item: the fullest that takes it, else a new one.

    ``room`` lists the free space of bins that exist; it is extended and updated.
    Free spaces with bins are bits of one integer, so each choice is a few
    machine-word operations however many bins are open.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, out = 0, []
    for b in range(len(room) - 1, -1, -1):
        by_room[room[b]].append(b)
        mask |= 1 << room[b]
    for s in sizes:
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(r)
        room[b] = r - s
        if r - s:
            by_room[r - s].append(b)
            mask |= 1 << (r - s)
        out.append(b)
    return out


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; if it is longer than ``capacity``,
    the first piece is the shorter one and all others are full."""
    if n <= capacity:
        return [(0, n)] if n else []
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenize_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32[, ids]``.

    Whole texts (null: empty), each followed by ``end_id``; ids as little-endian
    uint32.  Repeated rows are packed as often as they occur.
    """
    fields = PIECE + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), str_texts(b.column(1)), strict=True):
                x = enc.encode(t) + end
                for k, (s, n) in enumerate(cut_pieces(len(x) // 4, capacity)):
                    y = x[4 * s : 4 * (s + n)]
                    rows.append((d, k, s, n, zlib.crc32(y), y))
            cols = [[r[i] for r in rows] for i in range(6 if with_ids else 5)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=[f.split()[0] for f in fields.split(", ")])

    from .common import ship

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    names = [f.split()[0] for f in _BINS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _local(capacity: int, closed_room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), []
        for b in batches:
            rows += zip(*[b.column(i).to_pylist() for i in range(5)], strict=True)
        # an order of the rows' own, so that a task run again packs alike
        rows.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[4]))
        room: list[int] = []
        bins = best_fit([r[3] for r in rows], room, capacity)
        at, out = [0] * len(room), []
        for r, b in zip(rows, bins, strict=True):
            out.append((*r, part << 40 | b, at[b], part, capacity - room[b], room[b] > closed_room))
            at[b] += r[3]
        for i in range(0, len(out), 20_000):
            yield _arrow(out[i : i + 20_000])

    return run


def pack(pieces: DataFrame, capacity: int = 2048, closed_room: int = 0, fan: int = 16) -> DataFrame:
    """Place pieces (``doc_id, piece, start, length, ids_crc32``; 1 <= length <= capacity) into sequences.

    Returns the pieces with ``sequence_id`` (arbitrary) and ``offset`` (gapless
    from 0).  ``closed_room``: free space with which a bin counts as full.  Ties
    go by doc_id and piece; an empty input gives an empty result.
    """
    names = [f.split()[0] for f in PIECE.split(", ")]
    # written first: a lost executor does not tokenise again, and one Python worker serves a task
    level = cut(cut(pieces.select(*names), "pieces").mapInArrow(_local(capacity, closed_room), _BINS), "bins")
    out = [*names, "sequence_id", "offset"]
    n_parts = level.agg(F.max("part")).first()[0]
    if n_parts is None:
        return level.select(*out)

    def chosen(bins: DataFrame) -> DataFrame:
        """What a merge can use of open bins: the item, at most half full, and as many of the emptiest hosts as there can be items."""
        place = F.row_number().over(W.partitionBy("part").orderBy("fill", "sequence_id"))
        return cut(bins.withColumn("_n", place).where(F.col("_n") <= fan + 2).select("part", "sequence_id", "fill"), "open")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for g, s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                by_group.setdefault(g, []).append((f, s))
        rows = []
        for g, items in by_group.items():
            items.sort(key=lambda x: (-x[0], x[1]))
            room: list[int] = []
            placed = best_fit([f for f, _ in items], room, capacity)
            host: dict[int, int] = {}
            at: dict[int, int] = {}
            for (f, s), b in zip(items, placed, strict=True):
                rows.append((s, host.setdefault(b, s), at.get(b, 0), g, capacity - room[b], room[b] > closed_room))
                at[b] = at.get(b, 0) + f
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        fields = ("sequence_id", "host", "shift", "part", "fill", "open")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=fields)

    live = chosen(level.where("open").groupBy("part", "sequence_id").agg(F.max("fill").alias("fill")))
    moved, groups = None, n_parts + 1
    while groups > 1:
        grouped = live.select(F.floor(F.col("part") / fan).cast("int").alias("g"), "sequence_id", "fill").repartition("g")
        moves = cut(grouped.mapInArrow(merge, "sequence_id long, host long, shift long, part int, fill int, open boolean"), "moves")
        step = moves.where("host <> sequence_id").select("sequence_id", "host", "shift")
        if moved is None:
            moved = step
        else:  # what moved before goes along with its host
            again = step.select(F.col("sequence_id").alias("host"), F.col("host").alias("_host"), F.col("shift").alias("_shift"))
            carried = moved.join(again, "host", "left").select("sequence_id", F.coalesce("_host", "host").alias("host"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
            moved = cut(carried.unionByName(step), "moved")
        live = chosen(moves.where("open and host = sequence_id").select("part", "sequence_id", "fill"))
        groups = -(-groups // fan)
    if moved is None:
        return level.select(*out)
    return level.join(moved, "sequence_id", "left").select(*names, F.coalesce("host", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids``; one row is one sequence."""
    key = ["doc_id", "piece", "ids_crc32"]
    rows = placed.join(pieces_with_ids.select(*key, "ids").dropDuplicates(key), key)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
