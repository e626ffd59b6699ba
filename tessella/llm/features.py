"""Hashed character n-gram vectors, vectorised over the code points of a text."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows

DIM_BITS = 12
DIM = 1 << DIM_BITS
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SPACE, _DIGIT, _UPPER, _LOWER = 32, 48, 65, 97
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For code points below 2**16: is it a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(cp: np.ndarray) -> np.ndarray:
    table = _letter_table()
    if len(cp) and int(cp.max()) >= 1 << 16:
        big = cp >= 1 << 16
        out = table[np.where(big, 0, cp)]
        out[big] = [chr(c).isalpha() for c in cp[big].tolist()]
        return out
    return table[cp]


def letter_stream(text: str) -> np.ndarray:
    """Code points of the letters in lower case, every run of others as one space; empty if it has no letter."""
    cp = code_points(text.lower())
    is_letter = letters(cp)
    if not is_letter.any():
        return np.empty(0, np.uint32)
    cp = np.where(is_letter, cp, np.uint32(_SPACE))
    space = cp == _SPACE
    return cp[~(space & np.concatenate([[False], space[:-1]]))]


def shape_stream(text: str) -> np.ndarray:
    """Code points with letters as ``A``/``a``, digits as ``0``; other characters as they are."""
    raw = code_points(text)
    out = raw.copy()
    is_letter = letters(raw)
    low = code_points(text.lower())
    upper = (raw != low) if len(low) == len(raw) else (raw < 128) & (raw >= 65) & (raw <= 90)
    out[is_letter] = np.where(upper[is_letter], np.uint32(_UPPER), np.uint32(_LOWER))
    out[(raw >= 48) & (raw <= 57)] = _DIGIT
    return out


def ngram_vector(cp: np.ndarray, orders: int = 3) -> np.ndarray:
    """Unit vector of square roots of hashed n-gram counts, n from 1 to ``orders``; zero if empty."""
    total = np.zeros(DIM, np.float32)
    for n in range(1, orders + 1):
        if len(cp) < n:
            break
        h = cp[: len(cp) - n + 1] * _MUL[0]
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * _MUL[1] + cp[i : len(cp) - n + 1 + i] * _MUL[2]
        h = (h ^ (h >> np.uint32(13))) * _MUL[(n - 1) % 3]
        total += np.bincount(h >> np.uint32(32 - DIM_BITS), minlength=DIM).astype(np.float32)
    total = np.sqrt(total)
    norm = float(np.linalg.norm(total))
    return total / norm if norm else total


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """The same rows in the same order with the vectors of a column compressed, for a driver that collects them."""

    def make():
        return lambda x: [pa.array([zlib.compress(v, 1) for v in x.to_pylist()], pa.binary())]

    keep = [c for c in df.columns if c != column]
    return map_rows(df, [column], [(f"{column}_z", T.BinaryType())], make, keep=keep).withColumnRenamed(f"{column}_z", column)


def vectors(rows: list[bytes]) -> np.ndarray:
    """What ``squeezed`` made, as rows of one matrix."""
    x = np.empty((len(rows), DIM), np.float32)
    for i, v in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(v), np.float32)
    return x
