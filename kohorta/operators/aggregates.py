"""Counts, profiles, summaries and binning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.operators.ordered import join_null_safe, quantiles, splits_for
from kohorta.operators.reshape import unpivot


def count_by(df: DataFrame, keys: Sequence[str], out: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def distinct_with_missing(c: str) -> Column:
    """Number of distinct values, a missing value being one of them."""
    return F.countDistinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))


def ratio_to_total(df: DataFrame, count: str, by: Sequence[str] = (), share: str = "cnt_p",
                   total: str | None = None) -> DataFrame:
    """Share of a count within ``by`` (or overall) from pre-aggregated totals, without a window."""
    name = total or "__total"
    totals = df.groupBy(*by).agg(F.sum(count).alias(name))
    out = join_null_safe(df, totals, by) if by else df.withColumn(name, totals.scalar())
    out = out.withColumn(share, F.try_divide(F.col(count), F.col(name)))
    return out if total else out.drop(name)


def _unfilled(df: DataFrame, c: str, kind: str) -> Column:
    col = F.col(f"`{c}`")
    return col.isNull() | (col == "") if kind == "string" else col.isNull()


def fill_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Filled and unfilled cells per table and column, one scan per table."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("__n"), *[
            F.count_if(_unfilled(df, c, k)).alias(c) for c, k in df.dtypes])
        parts.append(unpivot(counted, ["__n"], df.columns, "column_name", "unfilled_values").select(
            F.lit(name).alias("table_name"), "column_name",
            (F.col("__n") - F.col("unfilled_values")).alias("filled_values"), "unfilled_values",
            F.bround(F.try_divide(F.col("__n") - F.col("unfilled_values"), F.col("__n")), 2)
            .alias("filled_percent")))
    return reduce(DataFrame.unionByName, parts)


def null_profile(df: DataFrame, exclude: Sequence[str] = (), below: int | None = None) -> DataFrame:
    """Missing cells per column in long form, optionally only the columns under a gate."""
    columns = [c for c in df.columns if c not in exclude]
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    long = counted.unpivot([], columns, "key", "value")
    return long if below is None else long.where(F.col("value") < below)


def row_null_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in columns])


STAT_NAMES = ("min", "max", "mean", "median", "lastKnown", "stdev")  # fixed values: column suffixes


def six_stat_summary(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str],
                     clip: bool | Sequence[str] = False, splits: int | None = None) -> DataFrame:
    """min, max, mean, median, last known value and sample deviation of every feature per key.

    ``clip`` (all columns, or the named ones) lets min and max include 0.

    One aggregate with map-side combining. Only the exact median keeps a key's values together;
    where one key is too large for a task the medians are taken in long form by rank.
    """
    if splits is None:
        splits = splits_for(df.select(*keys), keys)
    clipped = set(columns) if clip is True else set(clip or ())
    place = f"`{order[0]}`" if len(order) == 1 else f"struct({', '.join(f'`{o}`' for o in order)})"
    aggs = []
    for c in columns:
        x = f"cast(`{c}` as double)"
        low, high = f"min({x})", f"max({x})"
        stats = {
            "min": f"if({low} is null, null, least({low}, 0D))" if c in clipped else low,
            "max": f"if({high} is null, null, greatest({high}, 0D))" if c in clipped else high,
            "mean": f"avg({x})",
            "median": f"percentile({x}, 0.5)",
            "lastKnown": f"max_by({x}, if(`{c}` is null, null, {place}))",
            "stdev": f"stddev_samp({x})",
        }
        # NaN sorts above infinity, so one comparison makes both missing
        aggs += [F.expr(f"if(abs({e}) < double('Infinity'), {e}, null) as `{c}_{s}`")
                 for s, e in stats.items() if not (s == "median" and splits > 1)]
    out = df.groupBy(*keys).agg(*aggs)
    if splits > 1:
        long = unpivot(df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]),
                       keys, columns, "__key", "__value")
        middle = quantiles(long, [*keys, "__key"], "__value", {"m": 0.5}, splits)
        wide = middle.groupBy(*keys).pivot("__key", list(columns)).agg(F.max("m"))
        wide = wide.select(*keys, *[F.col(f"`{c}`").alias(f"{c}_median") for c in columns])
        out = join_null_safe(out, wide, keys, "left").select(
            *keys, *[F.col(f"`{c}_{s}`") for c in columns for s in STAT_NAMES])
    return out


def merge_summaries(clipped: DataFrame, plain: DataFrame, on: Sequence[str], label: str,
                    constants: Sequence[str] = ()) -> DataFrame:
    """Join the two summaries, keep one statistic of per-patient constants, drop unlabelled rows."""
    return keep_constants(clipped.join(plain, list(on)), constants).where(F.col(label).isNotNull())


def keep_constants(summary: DataFrame, constants: Sequence[str]) -> DataFrame:
    """One column instead of six for values that do not change within a patient."""
    kept = {f"{c}_min": c for c in constants}
    gone = {f"{c}_{s}" for c in constants for s in STAT_NAMES if s != "min"}
    return summary.selectExpr(*[f"`{c}` as `{kept.get(c, c)}`" for c in summary.columns if c not in gone])


def collapse_unique(df: DataFrame, keys: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values in first-seen order as one text. Duplicates go before anything is collected,
    so a key holds its vocabulary only."""
    seen = df.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col("__at"), F.col(value).alias("v"))))
    return seen.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), ", ").alias(out))


def mean_sd_by(df: DataFrame, keys: Sequence[str], value: str, names=("cnt", "avg_value", "sd_value")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(names[0]), F.avg(value).alias(names[1]),
                                 F.stddev_samp(value).alias(names[2]))


def count_conditional(df: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count_if(v >= threshold).alias("cnt_above_th"), F.count_if(v < threshold).alias("cnt_below_th"),
        F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("sd_value"))


def quantile_edges(df: DataFrame, column: str, n: int) -> list[float]:
    """Unique quantile edges; n + 1 numbers come to the driver."""
    probs = {f"q{i}": i / n for i in range(n + 1)}
    row = quantiles(df, [], column, probs).first()
    return sorted({row[q] for q in probs if row[q] is not None}) if row else []


def quantile_cut(df: DataFrame, column: str, n: int = 5, digits: int = 2, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins, the lowest value included: an index and a text label."""
    edges = quantile_edges(df, column, n)
    index, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    value = F.col(column)
    for i in reversed(range(1, len(edges))):
        text = f"{round(edges[i - 1], digits):.15g} - {round(edges[i], digits):.15g}"
        index = F.when(value <= edges[i], F.lit(i)).otherwise(index)
        label = F.when(value <= edges[i], F.lit(text)).otherwise(label)
    return df.withColumns({out: index, f"{out}_label": label})


def bin_rate(df: DataFrame, column: str, label: str, n: int = 4, low: Column | None = None,
             high: Column | None = None) -> DataFrame:
    """Event rate per quantile bin, and the share of its values inside the limits."""
    aggs = [F.count(F.lit(1)).alias("cnt"), F.avg(F.col(label).cast("double")).alias("event_rate")]
    if low is not None and high is not None:
        inside = (F.col(column) >= F.col("__low")) & (F.col(column) <= F.col("__high"))
        df = df.withColumns({"__low": low, "__high": high})
        aggs.append(F.avg(inside.cast("double")).alias("in_range_share"))
    return quantile_cut(df, column, n).groupBy("bin", "bin_label").agg(*aggs)


def histogram_counts(df: DataFrame, column: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins 1..bins between the smallest and the largest value."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    low, high = (0.0, 0.0) if low is None else (low, high)  # nothing to count gives an empty result
    width = ((high - low) / bins) or 1.0
    place = F.least(F.floor((F.col(column) - low) / width) + 1, F.lit(bins)).cast("int")
    return (df.where(F.col(column).isNotNull()).groupBy(*keys, place.alias("bin"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("bin_low", low + (F.col("bin") - 1) * width))


def timeline_band(df: DataFrame, patient: str, date: str, key: str, value: str) -> DataFrame:
    """Lowest and highest normalised value per patient, day and key."""
    return df.groupBy(patient, date, key).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def timeline_envelope(df: DataFrame, key: str, value: str) -> DataFrame:
    """Value span per key, stretched to include the normal range 0..1."""
    return df.groupBy(key).agg(F.least(F.min(value), F.lit(0.0)).alias("ymin"),
                               F.greatest(F.max(value), F.lit(1.0)).alias("ymax"))


def event_count(dates: Sequence[str]) -> Column:
    """Number of dated events 0..k from columns that are filled from the left."""
    count = F.lit(0)
    for i, d in enumerate(dates, 1):
        count = F.when(F.col(d).isNotNull(), F.lit(i)).otherwise(count)
    return count
