"""Joins by role. Plain ``DataFrame.join`` serves the equi joins; AQE splits their skewed partitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kohorta.functions.columns import shared_columns
from kohorta.functions.dates import add_months
from kohorta.operators.ordered import join_null_safe
from kohorta.session import checked_broadcast


def join_natural(a: DataFrame, b: DataFrame, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on every column name the two sides share."""
    on = shared_columns(a, b)
    return join_null_safe(a, b, on, how) if null_safe else a.join(b, on, how)


def join_lookup(fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = 100_000) -> DataFrame:
    """Join a dictionary; it is broadcast only after its size was counted."""
    return fact.join(checked_broadcast(lookup, max_rows), on=list(on), how=how)


def within_after(events: DataFrame, anchors: DataFrame, patient: str, date: str,
                 anchor_columns: Sequence[str], months: int, keys: Sequence[str]) -> DataFrame:
    """Distinct ``keys`` of events inside [anchor, anchor + months) of any anchor of the patient.

    The few anchors of a patient travel as one row, so the event side is joined once and never
    multiplied.
    """
    windows = F.filter(F.array(*[F.col(c) for c in anchor_columns]), lambda a: a.isNotNull())
    hit = F.exists("__anchors", lambda a: (F.col(date) >= a) & (F.col(date) < add_months(a, months)))
    dated = anchors.select(patient, windows.alias("__anchors")).where(F.size("__anchors") > 0)
    return events.join(dated, patient).where(hit).select(*keys).distinct()


def ordered_pairs(names: DataFrame, column: str, right_names: DataFrame | None = None, tile: int = 1000) -> DataFrame:
    """All pairs a < b of a dictionary of names, for instance feature names.

    The right names are dealt into tiles of about ``tile`` names and every left name visits each tile, so a pair is met
    by an equi join on the tile and no row or task holds the dictionary.
    """
    right = (right_names or names).select(F.col(column).alias("b")).where("b is not null").distinct()
    tiles = max(1, math.ceil(right.count() / tile))
    right = right.withColumn("tile", F.pmod(F.xxhash64("b"), F.lit(tiles)))
    left = names.select(F.col(column).alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("tile"))
    return left.join(right, "tile").where("a < b").select("a", "b")


def join_list_column(left: DataFrame, right: DataFrame, list_column: str, key: str) -> DataFrame:
    """Join on the elements of a list column."""
    return left.join(right.select(F.explode(list_column).alias(key), *[
        c for c in right.columns if c != list_column]), key)


def refuse_doubled_keys(part: DataFrame, on: Sequence[str]) -> DataFrame:
    """``part`` with a check inside its plan: the job fails when a key comes a second time.

    The running number needs the part dealt and sorted by its keys, which the sort-merge join after it needs as well, and
    holds no rows back. Rows with a missing key match nothing and are left out.
    """
    number = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
    text = F.concat(F.lit(f"feature table is not unique in {list(on)}: "), F.to_json(F.struct(*on)))
    once = F.when(F.col("__number") > 1, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))
    return part.dropna(subset=list(on)).withColumn("__number", number).where(once).drop("__number")


def join_star(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], verify: bool | str = True) -> DataFrame:
    """Left-join feature tables of different grain. Each must be unique in its keys, so the base
    never fans out; ``verify`` counts first and refuses a part that is not. With ``verify="plan"`` the parts are
    checked while they are joined, without a job of their own."""
    for part, on in parts:
        if verify == "plan":
            part = refuse_doubled_keys(part, on)
        elif verify and not part.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"feature table is not unique in {list(on)}")
        base = base.join(part, on=list(on), how="left")
    return base
