"""Numeric expressions with the missing-value rules the reports rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = float(1 << 52)


def if_else(condition: Column, yes, no) -> Column:
    """A missing condition gives a missing result."""
    return F.when(condition, yes).when(~condition, no)


def finite_or_null(c: Column) -> Column:
    """Spark orders NaN above infinity, so one comparison drops both."""
    return F.when(F.abs(c) < float("inf"), c)


def at_most_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(0.0), c))


def at_least_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def round_to_step(c: Column, per_unit: int = 20) -> Column:
    """Nearest multiple of 1/per_unit, ties to even."""
    return F.bround(c * per_unit) / per_unit


def floor_to_step(c: Column, per_unit: int = 10) -> Column:
    return F.floor(c * per_unit) / per_unit


def range_normalize(value: Column, low: Column, high: Column) -> Column:
    """0 at the lower and 1 at the upper limit; missing when the range has no width."""
    return F.try_divide(value - low, high - low)


def unit_hash(*parts: Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from row values. It does not depend on partitioning, so a
    recomputed task draws the same value."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / HASH_RANGE
