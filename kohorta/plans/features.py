"""Feature tables per encounter, per date and per patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.columns import sanitize_columns
from kohorta.functions.dates import before_event, parse_dmy
from kohorta.functions.text import concat_path
from kohorta.operators.aggregates import keep_constants, ratio_to_total, six_stat_summary
from kohorta.operators.joins import join_lookup, join_star, refuse_doubled_keys
from kohorta.operators.ordered import join_null_safe, running_sums
from kohorta.operators.reshape import pivot_attr, pivot_multi, pivot_onehot, pivot_share
from kohorta.operators.temporal import active_in_window, lag_trend, locf
from kohorta.session import drop_stages, stage


def treatment_flags(records: DataFrame, lookup: DataFrame, names: Sequence[str]) -> DataFrame:
    """0/1 per cleaned treatment name and encounter. ``records`` are attribute rows, ``lookup`` maps
    value to value_clean; descriptions without a clean name make no column."""
    described = records.where(F.col("attr") == "Descr").select("Encounter", "Patient_ID", "value")
    clean = join_lookup(described, lookup.select("value", "value_clean"), ["value"]).where("value_clean is not null")
    return pivot_onehot(clean, ["Encounter", "Patient_ID"], "value_clean", names)


def care_path_shares(attributes: DataFrame) -> DataFrame:
    """(Patient_ID, path, share): share of a patient's encounters that went from one unit to another."""
    wide = pivot_attr(attributes, ["Patient_ID", "Encounter"], "attr", "value", ["oe_admission", "oe_discharge"])
    wide = wide.where("oe_admission is not null or oe_discharge is not null")
    counted = wide.groupBy("Patient_ID", "oe_admission", "oe_discharge").agg(F.countDistinct("Encounter").alias("cnt"))
    shares = ratio_to_total(counted, "cnt", ["Patient_ID"], "share")
    return shares.select("Patient_ID", concat_path(F.col("oe_admission"), F.col("oe_discharge")).alias("path"), "share")


def care_paths(attributes: DataFrame, names: Sequence[str]) -> DataFrame:
    return pivot_share(care_path_shares(attributes), ["Patient_ID"], "path", "share", names)


def stay_counts(attributes: DataFrame, kinds: Sequence[str] = ("stat", "amb")) -> DataFrame:
    """Stays of each kind up to and including this one, per encounter."""
    wide = pivot_attr(attributes, ["Patient_ID", "Encounter"], "attr", "value", ["admission", "discharge", "encounter_type"])
    dated = wide.withColumns({c: parse_dmy(F.col(c)) for c in ("admission", "discharge")}).where(
        "admission is not null and discharge is not null")
    marks = {f"cnt_{k}": (F.col("encounter_type") == k).cast("bigint") for k in kinds}
    return running_sums(dated, ["Patient_ID"], ["admission", "Encounter"], marks).select("Patient_ID", "Encounter", *marks)


def value_trends(values: DataFrame, keys: Sequence[str], key: str, order: Sequence[str], date: str, value: str,
                 ids: Sequence[str], names: Sequence[str], splits: int | None = None) -> DataFrame:
    """Change and change per day of every key, one column per measure and key; absent = 0."""
    changed = lag_trend(values, [*keys, key], order, date, value, splits)
    return pivot_multi(changed, ids, key, ["trend_abs", "trend"], names)


def values_and_trends(values: DataFrame, keys: Sequence[str], key: str, order: Sequence[str], date: str, value: str,
                      ids: Sequence[str], names: Sequence[str], splits: int | None = None) -> DataFrame:
    """Mean value, change and change per day of every key from one pass over the measurements.

    The same columns as ``pivot_mean`` left-joined with ``value_trends``: trends of absent keys are 0,
    and all trends are missing where no row of the group has one.
    """
    changed = lag_trend(values, [*keys, key], order, date, value, splits, keep=True)
    cells = [F.expr(f"avg(if(`{key}` = '{n}', `{value}`, null)) as `{n}`") for n in names]
    for m in ("trend_abs", "trend"):
        cells += [F.expr(f"if(count(trend_abs) = 0, null, coalesce(avg(if(`{key}` = '{n}', {m}, null)), 0D)) as `{m}_{n}`")
                  for n in names]
    return changed.groupBy(*ids).agg(*cells)


def dated_features(matrix: DataFrame, patient: Sequence[str], order: Sequence[str], names: Sequence[str],
                   parts: Sequence[tuple[DataFrame, Sequence[str]]], splits: int | None = None, verify: bool | str = "plan") -> DataFrame:
    """Values per key carried forward, joined with feature tables of any grain, each checked for unique keys."""
    return join_star(locf(matrix, patient, order, names, splits), parts, verify)


def patient_features(dated: DataFrame, keys: Sequence[str], date: str, event: str, clipped: Sequence[str],
                     plain: Sequence[str], constants: Sequence[str] = (), splits: int | None = None) -> DataFrame:
    """One row per patient: six statistics of every feature over the time before the event.

    Both kinds of summary share one aggregate, so the dated table is shuffled once.
    """
    early = dated.where(before_event(F.col(date), F.col(event)))
    summed = six_stat_summary(early, keys, [*clipped, *plain, *constants], [date], clip=list(clipped), splits=splits)
    return sanitize_columns(keep_constants(summed, constants))


def encounter_features(values: DataFrame, members: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], key: str,
                       order: Sequence[str], date: str, value: str, names: Sequence[str], patient: str = "Patient_ID",
                       encounter: str = "Encounter", splits: int | None = None) -> DataFrame:
    """One row per patient, encounter and day of the cohort: mean values carried forward along the patient, trends,
    active days of the trailing months, and the columns of ``parts`` (feature tables by encounter, day or patient).

    ``values`` has one row per measurement and is read once; everything after it works on its days. ``members`` has one
    row per patient of the cohort; patients outside of it have no row in the result.
    """
    matrix = encounter_matrix(values, members, key, order, date, value, names, patient, encounter, splits)
    return encounter_days(matrix, members, parts, date, names, patient, encounter, splits)


def encounter_matrix(values: DataFrame, members: DataFrame, key: str, order: Sequence[str], date: str, value: str, names: Sequence[str],
                     patient: str = "Patient_ID", encounter: str = "Encounter", splits: int | None = None) -> DataFrame:
    """The measurements of the cohort by patient, encounter and day: mean values and trends, written once."""
    ids = [patient, encounter, date]
    known = values.join(members.select(patient).distinct(), patient, "left_semi")
    known = stage(known, "encounter-values")
    matrix = stage(values_and_trends(known, [patient], key, order, date, value, ids, names, splits), "encounter-matrix")
    drop_stages(known)
    return matrix


def encounter_days(matrix: DataFrame, members: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], date: str, names: Sequence[str],
                   patient: str = "Patient_ID", encounter: str = "Encounter", splits: int | None = None) -> DataFrame:
    """``encounter_features`` from its matrix. No join adds rows, so a patient has at most the rows of the matrix.

    Tables finer than a patient meet the keys of the matrix alone, so that its wide rows are not dealt out for each of them. They are
    put beside the matrix in a written step; the joins by patient find its rows where carrying forward needs them.
    """
    ids = [patient, encounter, date]
    active = active_in_window(matrix.select(patient, date), patient, date, "active")
    fine = [(active, [patient, date]), *[p for p in parts if list(p[1]) != [patient]]]
    sides = join_star(matrix.select(*ids), fine, "plan")
    wide = stage(join_null_safe(matrix, sides, ids), "encounter-days")
    dated = dated_features(wide, [patient], [date, encounter], names, [p for p in parts if list(p[1]) == [patient]], splits)
    return dated.join(refuse_doubled_keys(members, [patient]), patient)


def encounter_patient_features(dated: DataFrame, keys: Sequence[str], date: str, event: str, clipped: Sequence[str],
                               plain: Sequence[str], constants: Sequence[str], parts: Sequence[tuple[DataFrame, Sequence[str]]],
                               encounter: str = "Encounter", splits: int | None = None) -> DataFrame:
    """One row per patient: statistics of the dated columns before the event, and the patient's own columns.

    Tables at the grain of the patient (``parts``) meet the one row of the summary instead of every day, where each of
    their six statistics would be the same number. Of the days of one date the last encounter gives the last known value.
    Without ``splits`` the rows of a patient are counted, for which the tables joined to ``dated`` are made once more.
    """
    early = dated.where(before_event(F.col(date), F.col(event)))
    summed = six_stat_summary(early, keys, [*clipped, *plain, *constants], [date, encounter], clip=list(clipped), splits=splits)
    return sanitize_columns(join_star(keep_constants(summed, constants), parts, "plan"))
