"""Laws of index geometry: pure functions and their column forms."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = (256, 512, 1024, 2048, 4096, 6144, 8192, 12288, 16384)


def k_for(dim: int) -> int:
    return round(math.sqrt(dim))


def max_slots(k: int) -> int:
    return min(256, round(2 * math.sqrt(k)))


def salient_budget(k: int) -> int:
    return k // 2


def round_up(dim: float, grid: Iterable[int] = GRID) -> int:
    grid = sorted(grid)
    return next((d for d in grid if d >= dim), grid[-1])


def lsh_width(n: int) -> int:
    """Bits of a hash for about ten vectors a bucket, within 14 to 28; 16 for an unknown number."""
    return 16 if n <= 0 else max(14, min(28, math.ceil(math.log2(max(n / 10, 1)))))


def sample_size(n: int) -> int:
    return min(50_000, max(10_000, round(0.005 * n)))


def slots_column(k: Column) -> Column:
    return F.least(F.lit(256), F.bround(2 * F.sqrt(k), 0).cast("int"))


def zone_column(p99: Column) -> Column:
    """The zone of dimensions that the 99th percentile of atoms a record calls for."""
    return F.when(p99 <= 8, 1).when(p99 <= 24, 2).when(p99 <= 200, 3).otherwise(4)


def noise_column(p: Column, n: Column) -> Column:
    """Half-width of the 95 % interval of a share p of n trials, p held within [0.01, 0.99]; 0.5 without trials."""
    q = F.greatest(F.least(p, F.lit(0.99)), F.lit(0.01))
    return F.when(n <= 0, F.lit(0.5)).otherwise(1.96 * F.sqrt(q * (1 - q) / n))


def tier_weight(tier: Column, gated: Column) -> Column:
    base = F.when(tier == 1, 1.0).when(tier == 2, 0.7).otherwise(0.4)
    return F.least(F.lit(1.0), base + F.when((tier == 2) & gated, 0.2).otherwise(0.0))
