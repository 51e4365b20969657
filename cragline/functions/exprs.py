"""Column expressions: clipping, half-even lookups, finite tests, rounding that two engines agree on."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """True for a number that is neither NaN nor infinite; false for null."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def floor_at(x: Column, digits: int = 3) -> Column:
    """Half-up rounding by floor, which agrees between engines where ``round`` does not."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def cell_index(v: Column, origin, cell, count, eps: float = 1e-9) -> Column:
    """Index of the grid cell of a coordinate, clipped to the grid."""
    raw = F.floor((v - origin) / cell + F.lit(eps))
    return F.greatest(F.lit(0), F.least(F.lit(count) - 1, raw)).cast("int")


def nearest_index(v: Column, origin, cell, count, shift: float = 0.5) -> Column:
    """Half-even nearest index: cell centres at shift 0.5, break-score cells at shift 1."""
    return clip(F.rint((v - origin) / cell - F.lit(shift)), 0.0, count - 1.0).cast("int")


def gaussian_kernel(sigma: float, reach: float = 4.0) -> list[float]:
    """Weights of taps -k..k, k = floor(reach * sigma + 0.5); their sum is 1."""
    k = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-k, k + 1)]
    return [x / sum(w) for x in w]
