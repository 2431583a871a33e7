"""From attribute rows of lab records to a normalised measurement table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.dates import parse_dmy, quarter_text
from kohorta.functions.numeric import if_else, range_normalize
from kohorta.functions.text import blank_to_null, decimal_comma, normalize_key, ordinal_code, to_number
from kohorta.operators.reshape import eav_to_record
from kohorta.session import checked_broadcast

# Keys with limits of their own, and the key whose unit is a fraction in some records.
RANGE_OVERRIDES = {"Titin_Ak": {"low": 0.0, "high": 2.0}, "Procalcitonin": {"low": 0.005}}
FRACTION_KEY, FRACTION_UP_TO, FRACTION_FACTOR = "Haematokrit", 1.0, 100.0

# The attributes of a lab record that a measurement needs.
RECORD_ATTRIBUTES = {"Kat": "key", "Date": "date", "range_low": "low", "range_high": "high", "Value": "value"}


def nonneg_numeric(df: DataFrame, value: str, comma: bool = True) -> DataFrame:
    """Numeric values only, none below zero; a decimal comma is accepted unless told otherwise."""
    number = decimal_comma(F.col(value)) if comma else to_number(F.col(value))
    return df.withColumn(value, number).where(F.col(value) >= 0)


def default_ranges(df: DataFrame, limits: DataFrame, overrides=None) -> DataFrame:
    """Numeric limits: equal or blank text limits are missing, missing ones come from the lookup by
    sex (w, m, otherwise child), and some keys have fixed ones. ``limits`` has one row per key."""
    low, high = F.col("low"), F.col("high")
    usable = blank_to_null(if_else(low == high, F.lit(""), low))

    def by_sex(side: str):
        return (F.when(F.col("sex") == "w", F.col(f"women_{side}")).when(F.col("sex") == "m", F.col(f"men_{side}"))
                .otherwise(F.col(f"child_{side}")))
    joined = df.join(checked_broadcast(limits), "key").withColumns({
        "low": F.coalesce(decimal_comma(usable), by_sex("low")),
        "high": F.coalesce(decimal_comma(blank_to_null(high)), by_sex("high"))})
    for key, fixed in (RANGE_OVERRIDES if overrides is None else overrides).items():
        joined = joined.withColumns({side: F.when(F.col("key") == key, F.lit(v)).otherwise(F.col(side))
                                     for side, v in fixed.items()})
    return joined.drop(*[f"{who}_{side}" for who in ("women", "men", "child") for side in ("low", "high")])


def unit_rescale(df: DataFrame, key: str = FRACTION_KEY, up_to: float = FRACTION_UP_TO,
                 factor: float = FRACTION_FACTOR) -> DataFrame:
    """Bring one key's fractions to percent: value and both limits, judged by the old upper limit."""
    fraction = F.coalesce((F.col("key") == key) & (F.col("high") <= up_to), F.lit(False))
    return df.withColumns({c: F.when(fraction, F.col(c) * factor).otherwise(F.col(c)) for c in ("value", "low", "high")})


def measurement_table(eav: DataFrame, ids: Sequence[str], limits: DataFrame, overrides=None,
                      fraction=(FRACTION_KEY, FRACTION_UP_TO)) -> DataFrame:
    """One row per lab value: coded, numeric, with limits, normalised to 0..1, with day and quarter.

    ``ids`` identify a record and must include ``sex``.
    """
    records = eav_to_record(eav, ids, "attr", "value", RECORD_ATTRIBUTES)
    coded = records.withColumn("value", ordinal_code(F.col("key"), F.col("value")))
    numbers = nonneg_numeric(coded, "value").withColumn("key", normalize_key(F.col("key")))
    ranged = unit_rescale(default_ranges(numbers, limits, overrides), *fraction)
    day = parse_dmy(F.col("date"))
    return ranged.withColumns({
        "normalized": range_normalize(F.col("value"), F.col("low"), F.col("high")),
        "day": day, "quarter": quarter_text(day)}).drop("date")
