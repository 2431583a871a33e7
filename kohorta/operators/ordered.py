"""Ordered computations per key that stay distributed when one key is huge.

A window over ``partitionBy(key)`` sorts a whole key in one task. Each function here first
counts rows per key (a pre-aggregated pass that reads only the key columns). Keys that fit a task
keep the plain window. The rows of heavier keys, and every table that is ordered without a key, are cut
into ranges over all order columns, whatever their types; the window runs per (key, range), and one
summary row per (key, range) carries the state across range borders.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kohorta.session import materialize

ROWS_PER_TASK = 4_000_000
#: Rows of many keys that one task should sort. A task of the shuffle's own size (64 MB packed) held three times as many.
ROWS_PER_SORT = 500_000
RANGE, WHOLE = "__range", "__whole"


def heavy_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Keys with more rows than a task should sort, and how many."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return counts.where(F.col("__rows") > (rows_per_task or ROWS_PER_TASK))


def splits_for(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> int:
    """1 if every key fits a task, else more."""
    return 1 if keys and heavy_keys(df, keys, rows_per_task).isEmpty() else 2


def add_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], splits: int) -> DataFrame:
    """A range number that grows with the order of a key's rows. The ranges are of about equal size over all rows, so ties
    of the leading columns are cut by the following ones; written once, because the cut is drawn from a sample."""
    dealt = df.repartitionByRange(splits, *keys, *order)
    return materialize(dealt.withColumn(RANGE, F.spark_partition_id()))


def _dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Dealt by keys into as many tasks as the rows need, where that is more than there are cores; else the shuffle decides."""
    tasks = math.ceil(rows / ROWS_PER_SORT)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def _by_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], splits: int | None,
             plain: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """``plain`` for keys that fit a task, ``ranged`` for the others and for tables without key. A given ``splits`` decides
    for all rows: 1 is plain, more is ranged."""
    if splits == 1:
        return plain(df)
    if not keys:
        parts = splits or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # written with the ranges, so that the optimizer does not see one value and take one task
        return ranged(add_ranges(df.withColumn(WHOLE, F.lit(0)), [], order, parts), [WHOLE]).drop(WHOLE)
    if splits:
        return ranged(add_ranges(df, keys, order, splits), keys)
    every = Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).observe(every, F.sum("__rows").alias("rows"))
    heavy = materialize(counts.where(F.col("__rows") > ROWS_PER_TASK))
    rows = heavy.agg(F.sum("__rows")).first()[0]
    if rows is None:
        return plain(_dealt(df, keys, every.get["rows"] or 0))
    hot = add_ranges(join_null_safe(df, heavy, keys, "left_semi"), keys, order, math.ceil(2 * rows / ROWS_PER_TASK))
    return plain(join_null_safe(df, heavy, keys, "left_anti")).unionByName(ranged(hot, keys))


def _sort(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order]


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a missing key matches a missing key; key columns come from the left
    (from either side for right and full joins)."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = [left[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on]
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if how in ("right", "full") else F.col(c)
            for c in on}
    return joined.select(*[keys.get(c, F.col(c)) for c in left.columns],
                         *[c for c in right.columns if c not in on])


def _carry(df: DataFrame, keys, summary: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Attach, per (key, range), what the earlier ranges of the key hand over."""
    handed = summary.select(*keys, RANGE, *[c.alias(n) for n, c in carried.items()])
    return join_null_safe(df, handed, [*keys, RANGE], "left")


def _before(keys, descending) -> Window:
    """Earlier ranges of the same key: at most one row per range, so never a large sort."""
    rng = F.col(RANGE).desc() if descending else F.col(RANGE).asc()
    return Window.partitionBy(*keys).orderBy(rng)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                 descending: bool = False, splits: int | None = None) -> DataFrame:
    """Cumulative sums per key in a stated total order."""
    addends = {f"__add_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}

    def local(rows, parts):
        upto = Window.partitionBy(*parts).orderBy(*_sort(order, descending)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(f"__add_{n}").over(upto) for n in sums})

    def ranged(rows, keys):
        totals = rows.groupBy(*keys, RANGE).agg(*[F.sum(f"__add_{n}").alias(f"__tot_{n}") for n in sums])
        earlier = _before(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
        out = _carry(local(rows, [*keys, RANGE]), keys, totals,
                     {f"__pre_{n}": F.sum(f"__tot_{n}").over(earlier) for n in sums})
        out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__pre_{n}"), F.lit(0)) for n in sums})
        return out.drop(RANGE, *[f"__pre_{n}" for n in sums])

    return _by_size(df.withColumns(addends), keys, order, splits, lambda rows: local(rows, keys), ranged).drop(*addends)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no",
                descending: bool = False, splits: int | None = None) -> DataFrame:
    """1, 2, 3, ... per key in a stated total order."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("bigint")}, descending, splits)


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str],
                    splits: int | None = None) -> DataFrame:
    """The values of the preceding row of the same key; ``columns`` maps source to new name."""
    def local(rows, parts):
        window = Window.partitionBy(*parts).orderBy(*_sort(order, False))
        return rows.withColumns({new: F.lag(old).over(window) for old, new in columns.items()}), window

    def ranged(rows, keys):
        out, window = local(rows, [*keys, RANGE])
        out = out.withColumn("__first", F.row_number().over(window) == 1)
        tail = rows.groupBy(*keys, RANGE).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__tail"))
        out = _carry(out, keys, tail, {"__prev": F.lag("__tail").over(_before(keys, False))})
        out = out.withColumns({new: F.when(F.col("__first"), F.col(f"__prev.{old}")).otherwise(F.col(new))
                               for old, new in columns.items()})
        return out.drop(RANGE, "__first", "__prev")

    return _by_size(df, keys, order, splits, lambda rows: local(rows, keys)[0], ranged)


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                 descending: bool = False, splits: int | None = None) -> DataFrame:
    """Last non-missing value so far, per key in order (``descending`` fills backwards)."""
    def local(rows, parts):
        upto = Window.partitionBy(*parts).orderBy(*_sort(order, descending)).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})

    def ranged(rows, keys):
        pick = F.min_by if descending else F.max_by
        known = rows.groupBy(*keys, RANGE).agg(*[
            pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"__known_{c}") for c in columns])
        earlier = _before(keys, descending).rowsBetween(Window.unboundedPreceding, -1)
        out = _carry(local(rows, [*keys, RANGE]), keys, known, {
            f"__pre_{c}": F.last(f"__known_{c}", ignorenulls=True).over(earlier) for c in columns})
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__pre_{c}")) for c in columns})
        return out.drop(RANGE, *[f"__pre_{c}" for c in columns])

    return _by_size(df, keys, order, splits, lambda rows: local(rows, keys), ranged)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row per key in a stated order: an aggregate, so no key is ever sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int,
             rank: str | None = None) -> DataFrame:
    """The first ``count`` rows per key. Spark prunes each map task to ``count`` rows per key
    before the shuffle, so a hot key never arrives whole."""
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= count)
    return kept if rank else kept.drop(name)


def quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: dict[str, float],
              splits: int | None = None) -> DataFrame:
    """Interpolated quantiles (type 7) per key, exact at any group size.

    Small groups use the built-in exact aggregate, which holds a group's distinct values in
    memory. Beyond the row limit, and without a key, the values are counted, ranked by running counts
    and picked by rank.
    """
    df = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__v"))
    if (splits or splits_for(df.select(*keys) if keys else df, keys)) <= 1:
        return df.groupBy(*keys).agg(*[F.percentile("__v", p).alias(n) for n, p in probs.items()])
    counted = df.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = running_sums(counted, keys, ["__v"], {"__upto": F.col("__c")}, splits=splits)
    size = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    if keys:
        ranked = join_null_safe(ranked, size, keys)
    else:
        ranked = ranked.withColumn("__n", size.select("__n").scalar())
    picks = []
    for n, p in probs.items():
        place = (F.col("__n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            holds = (F.col("__upto") - F.col("__c") <= rank) & (rank < F.col("__upto"))
            picks.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{side}_{n}"))
    found = ranked.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)
    result = []
    for n, p in probs.items():
        place = (F.col("__n") - 1) * F.lit(float(p))
        weight = place - F.floor(place)
        result.append((F.col(f"__lo_{n}") + weight * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n))
    return found.select(*keys, *result)
