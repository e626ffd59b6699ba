"""Scalar expressions over single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import clip, col, half_even

#: Strings that count as true, and as missing.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
NULL_WORDS = ("", "nan", "none", "null", "na", "n/a")


def brighten(c: Column | str, factor: float) -> Column:
    return clip(col(c) * factor, 0.0, 1.0)


def gamma(c: Column | str, g: float) -> Column:
    return F.pow(col(c), F.lit(g))


def segment_count(n: Column | str, target: float, pitch: float) -> Column:
    """Segments that cover ``n`` points of a lattice at a target side length, at least one."""
    return F.greatest(F.lit(1), half_even(col(n) / F.lit((target / pitch) ** 2)).cast("long"))


def scale_compactness(c: Column | str, frm: Column | float, to: Column | float, power: float, lo: float, hi: float) -> Column:
    """Power law between two target sizes, limited to [lo, hi]."""
    to, frm = (x if isinstance(x, Column) else F.lit(float(x)) for x in (to, frm))
    return clip(col(c) * F.pow(to / frm, F.lit(power)), lo, hi)


def clean_candidates(values: Column | str, lo: float, hi: float, digits: int = 6) -> Column:
    """Distinct candidates within bounds, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(col(values), lambda v: v.isNotNull()), lambda v: F.round(clip(v, lo, hi), digits))))


def nice_at_least(x: Column | str, digits: tuple[float, ...] = (1.0, 2.0, 2.5, 5.0, 10.0)) -> Column:
    """Smallest of ``digits`` times a power of ten that is not below ``x``."""
    x = col(x)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.array_min(F.filter(F.transform(F.array(*[F.lit(d) for d in digits]), lambda d: d * unit), lambda v: v >= x * (1 - 1e-12)))


def grid_label(x: Column | str, y: Column | str, side: float, x0: Column | float = 0.0, y0: Column | float = 0.0) -> Column:
    """``i_j`` of the square of a fixed grid that holds a point."""
    i = F.floor((col(x) - (x0 if isinstance(x0, Column) else F.lit(x0))) / F.lit(float(side)))
    j = F.floor((col(y) - (y0 if isinstance(y0, Column) else F.lit(y0))) / F.lit(float(side)))
    return F.concat_ws("_", i.cast("string"), j.cast("string"))


def to_canvas(x: Column | str, lo: Column, scale: Column | float, size: Column | int, mode: str = "round") -> Column:
    """Pixel of a coordinate, within the canvas; ``mode``: round half-even, or floor(x + 0.5)."""
    v = (col(x) - lo) * scale
    v = F.rint(v) if mode == "round" else F.floor(v + 0.5)
    return clip(v.cast("long"), 0, size - 1 if isinstance(size, int) else size - 1) if isinstance(size, int) else F.least(F.greatest(v.cast("long"), F.lit(0)), size - 1)


def is_true(v: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(v).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def token(v: Column | str) -> Column:
    """Letters, digits, ``.``, ``-`` and ``_``; runs of others as one ``_``; words for missing give null."""
    t = F.trim(col(v).cast("string"))
    return F.when(F.lower(t).isin(*NULL_WORDS), None).otherwise(F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""))


def resolution_of(label: Column | str) -> Column:
    """Number in ``res_16``, ``rank_r16_c0.5``, ``r16`` or ``16``."""
    got = F.regexp_extract(col(label), r"(?:^|_)(?:res_?|r)?(\d+(?:\.\d+)?)(?:_|$)", 1)
    return F.when(got == "", None).otherwise(got).try_cast("double")


def compactness_of(label: Column | str) -> Column:
    got = F.regexp_extract(col(label), r"_c(\d+(?:\.\d+)?)$", 1)
    return F.when(got == "", None).otherwise(got).try_cast("double")


def gain_percent(gain: Column | str, reference: Column | str, eps: float = 1e-12) -> Column:
    return col(gain) / F.greatest(F.abs(col(reference)), F.lit(eps)) * 100


def clean_symbol(s: Column | str) -> Column:
    t = F.upper(F.trim(col(s)))
    return F.when(t.isin("", "NAN", "NONE"), None).otherwise(t)


def in_polygon(x: Column, y: Column, xs: list[float], ys: list[float]) -> Column:
    """Even-odd rule by ray casting, edges unrolled into one expression."""
    inside = F.lit(False)
    for i in range(len(xs)):
        j = i - 1
        if ys[i] == ys[j]:
            continue
        crosses = ((F.lit(ys[i]) > y) != (F.lit(ys[j]) > y)) & (x < (xs[j] - xs[i]) * (y - ys[i]) / F.lit(ys[j] - ys[i]) + xs[i])
        inside = inside != crosses
    return inside
