"""Long to wide and back. Pivot values are always given, so plans are static."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_attr(df: DataFrame, ids: Sequence[str], attr: str, value: str, names: Sequence[str]) -> DataFrame:
    return df.groupBy(*ids).pivot(attr, list(names)).agg(F.max(value))


def pivot_onehot(df: DataFrame, ids: Sequence[str], category: str, names: Sequence[str]) -> DataFrame:
    """One aggregate by ``ids``: a pivot would first group by ids and category, and its map holds a row for either."""
    return df.groupBy(*ids).agg(*[F.coalesce(F.max(F.when(F.col(category) == n, 1)), F.lit(0)).alias(n) for n in names])


def pivot_share(df: DataFrame, ids: Sequence[str], category: str, share: str,
                names: Sequence[str]) -> DataFrame:
    return df.groupBy(*ids).pivot(category, list(names)).agg(F.max(share)).na.fill(0.0, list(names))


def pivot_mean(df: DataFrame, ids: Sequence[str], key: str, value: str, names: Sequence[str],
               strict_missing: bool = False) -> DataFrame:
    """Mean of duplicates; ``strict_missing`` makes the mean missing when any value is."""
    mean = F.avg(value)
    if strict_missing:
        mean = F.when(F.count(value) == F.count(F.lit(1)), mean)
    return df.groupBy(*ids).pivot(key, list(names)).agg(mean)


def pivot_multi(df: DataFrame, ids: Sequence[str], key: str, measures: Sequence[str],
                names: Sequence[str]) -> DataFrame:
    """Several measures at once, named ``measure_key``; means of duplicates, absent = 0."""
    first, *_ = measures
    wide = df.groupBy(*ids).pivot(key, list(names)).agg(*[F.avg(m).alias(m) for m in measures])
    out = []
    for m in measures:
        for n in names:
            source = n if len(measures) == 1 else f"{n}_{m}"
            out.append(F.coalesce(F.col(f"`{source}`"), F.lit(0.0)).alias(f"{m}_{n}"))
    return wide.select(*ids, *out)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "key",
            value: str = "value", drop_blank: bool = False) -> DataFrame:
    long = df.unpivot(list(ids), list(columns), name, value)
    if not drop_blank:
        return long
    keep = F.col(value).isNotNull()
    if dict(long.dtypes)[value] == "string":
        keep = keep & (F.col(value) != "")
    return long.where(keep)


def unpivot_groups(df: DataFrame, ids: Sequence[str], groups: Sequence[str], slots: Sequence[int]) -> DataFrame:
    """Repeated column groups (X1.., Y1..) as one row per slot, from a single scan."""
    slot_rows = [F.struct(F.lit(i).alias("slot"), *[F.col(f"{g}{i}").alias(g) for g in groups]) for i in slots]
    return df.select(*ids, F.inline(F.array(*slot_rows)))


def eav_to_record(df: DataFrame, ids: Sequence[str], attr: str, value: str, names: dict[str, str]) -> DataFrame:
    """One row per record with the chosen attributes as columns."""
    return df.groupBy(*ids).agg(*[
        F.max(F.when(F.col(attr) == a, F.col(value))).alias(n) for a, n in names.items()])


def split_rows(df: DataFrame, column: str, separator: str = ":") -> DataFrame:
    return df.withColumn(column, F.explode(F.split(column, re.escape(separator))))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().subtract(b)


def reorder_levels(df: DataFrame, category: str, by: str, rank: str = "level") -> DataFrame:
    """Attach the order of the categories (ties by name). One row per category is ranked: a
    category is a label of a report axis, so the ranked table is a dictionary."""
    from kohorta.operators.ordered import number_rows
    levels = df.groupBy(category).agg(F.avg(by).alias("__by"))
    levels = number_rows(levels, [], ["__by", category], rank)
    return df.join(levels.drop("__by"), category)
