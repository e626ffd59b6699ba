"""Token-id shards with Elias-Fano encoded document boundaries.

A shard holds the concatenated ids of consecutive documents (ascending
``doc_id``) in the narrowest of 1, 2 or 4 bytes, and the documents' end
positions as a monotone sequence in Elias-Fano form: the low ``l`` bits of every
value packed side by side, the high bits in unary, and a select directory with
the position of every 64th one bit.  ``Shard.select(i)`` finds a boundary from
one directory entry and at most a few words of the unary part, so no table of
64-bit offsets exists in the file or in memory.

Shards are rows of a Parquet table (any store Spark can write), each a single
self-describing byte string.

Layout of a shard, little-endian::

    8s  magic b"TSEF0001"      u8 bytes per id    u8 low bits l    6x
    u64 documents n            u64 ids u          u64 ids before it in its partition
    u64 bytes of: doc ids, null flags, low part, high part, directory
    doc ids (n x i64) | null flags (n bits) | low | high | directory (u32) | ids
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, new_path, ship, str_texts
from .tokens import encoder

MAGIC = b"TSEF0001"
_HEAD = struct.Struct("<8sBB6x8Q")
#: One directory entry for so many one bits.
SAMPLE = 64


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    v = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(v.astype(np.uint8).ravel(), bitorder="little").tobytes()


def elias_fano(values: np.ndarray, bound: int) -> tuple[int, bytes, bytes, bytes]:
    """Low bit count, low part, high part and select directory of ascending ``values`` <= bound."""
    n = len(values)
    low = max(0, int(bound // n).bit_length() - 1) if n else 0
    values = values.astype(np.uint64)
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n, dtype=np.int64)
    high = np.zeros((int(at[-1]) if n else 0) + 1, np.uint8)
    high[at] = 1
    return low, _pack_low(values & np.uint64((1 << low) - 1), low), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes()


def pack_shard(doc_ids: list, ids: list[bytes], start: int = 0) -> bytes:
    """A shard from documents' ids, each as little-endian uint32."""
    n = len(doc_ids)
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum(np.fromiter((len(x) // 4 for x in ids), np.int64, n)).astype(np.uint64)
    top = int(flat.max()) if len(flat) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    low, low_part, high_part, directory = elias_fano(ends, len(flat))
    docs = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    head = _HEAD.pack(MAGIC, width, low, n, len(flat), start, len(docs), len(nulls), len(low_part), len(high_part), len(directory))
    return b"".join([head, docs, nulls, low_part, high_part, directory, flat.astype(f"<u{width}").tobytes()])


class Shard:
    """Reader of one shard; everything is a view of its bytes."""

    def __init__(self, data: bytes):
        magic, width, self.low, self.n, self.n_ids, self.start, *sizes = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        view, at, parts = memoryview(data), _HEAD.size, []
        for s in sizes:
            parts.append(view[at : at + s])
            at += s
        self.docs = np.frombuffer(parts[0], "<i8")
        self.null = np.unpackbits(np.frombuffer(parts[1], np.uint8), bitorder="little", count=self.n).astype(bool)
        self.low_part, self.high_part = np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], np.uint8)
        self.directory = np.frombuffer(parts[4], "<u4")
        self.ids = np.frombuffer(view[at:], f"<u{width}", self.n_ids)

    def _low(self, i: int) -> int:
        first = i * self.low
        word = int.from_bytes(self.low_part[first >> 3 : (first + self.low + 7) >> 3].tobytes(), "little")
        return word >> (first & 7) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """End position (within the shard) of its document ``i``."""
        at, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high_part[byte : byte + 16], bitorder="little")[skip:])
            if left < len(bits):
                at = byte * 8 + skip + int(bits[left])
                return (at - i) << self.low | self._low(i)
            left, byte, skip = left - len(bits), byte + 16, 0

    def ends(self) -> np.ndarray:
        """All end positions, decoded at once; ``select`` gives each from the directory."""
        at = np.flatnonzero(np.unpackbits(self.high_part, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)).astype(np.int64) << self.low
        if self.low:
            bits = np.unpackbits(self.low_part, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.select(i - 1) if i else 0 : self.select(i)]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        begin = 0
        for i, end in enumerate(self.ends().tolist()):
            yield None if self.null[i] else int(self.docs[i]), begin, self.ids[begin:end]
            begin = end


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None = 2, shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode ``docs`` and write token shards; returns the table's path.

    Documents lie in ascending ``id_col`` order over all shards (null ids first,
    repeated ids by a hash of their texts), null texts as empty, whole texts always.  Other
    columns are not read.  A shard closes at ``shard_ids`` ids; a longer document has a
    shard of its own size.  Rows of the table: ``part, seq, n_docs, n_ids, shard``.
    Partitions are ranges of the id and that hash, so rows without an id, or of one id, are spread as well, and
    one shuffle of the texts is all that moves.
    """
    ship(docs.sparkSession)
    path = path or new_path(docs.sparkSession, "tokens")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list = []
        ids: list[bytes] = []
        size = before = 0

        def shard() -> pa.RecordBatch:
            n = sum(map(len, ids)) // 4
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([n], pa.int64()), pa.array([pack_shard(names, ids, before)], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "shard"],
            )

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), str_texts(b.column(1)), strict=True):
                x = enc.encode(t) + end
                names.append(d)
                ids.append(x)
                size += len(x) // 4
                if size >= shard_ids:
                    yield shard()
                    names, ids, size, before, seq = [], [], 0, before + size, seq + 1
        if names:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    # ids of frequent words compress well, and the shard's own parts stay addressable
    ordered.mapInArrow(run, "part int, seq long, n_docs long, n_ids long, shard binary").write.option("compression", "zstd").parquet(path)
    return path


def part_starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each partition that was written; one number for each task of the writer."""
    out, at = {}, 0
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids")).collect())):
        out[part] = at
        at += n
    return out


def read_documents(path: str, spark) -> DataFrame:
    """Documents of a table of shards: ``doc_id, start, n_tokens, ids`` (uint32, little-endian)."""
    return _read(path, spark, digest=False)


def read_digests(path: str, spark) -> DataFrame:
    """As ``read_documents``, with the ids' unsigned CRC-32 in place of the ids."""
    return _read(path, spark, digest=True)


def _read(path: str, spark, digest: bool) -> DataFrame:
    shards = spark.read.parquet(path)
    base = part_starts(shards)
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(data.as_py())
                ends = np.fromiter(map(s.select, range(s.n)), np.int64, s.n)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = memoryview(s.ids.astype("<u4").tobytes())
                each = [wide[4 * i : 4 * j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
                out = pa.array(map(zlib.crc32, each), pa.int64()) if digest else pa.array([bytes(x) for x in each], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.docs, mask=s.null), pa.array(begins + (base[part] + s.start)), pa.array(ends - begins), out],
                    names=["doc_id", "start", "n_tokens", last.split()[0]],
                )

    return shards.select("part", "shard").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def remove(path: str, spark) -> None:
    drop_path(spark, path)
