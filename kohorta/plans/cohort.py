"""Cohort tables: who is in, from which decade, with which onset and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.functions.columns import shared_columns
from kohorta.functions.dates import (NO_EVENT_YEAR, age_in_centuries, date_parts_by_schema, decade_floor, decade_text,
                                     onset_age, parse_ymd)
from kohorta.functions.text import is_blank, regex_flag, repair_encoding, strip_title
from kohorta.operators.aggregates import count_by, ratio_to_total
from kohorta.operators.joins import within_after
from kohorta.operators.ordered import first_rows, join_null_safe, quantiles
from kohorta.operators.temporal import locf_marker

DEFAULT_GROUP = "pop"  # fixed value: group of patients outside the cohort


def cohort_members(cohort: DataFrame, patients: DataFrame) -> DataFrame:
    """Cohort rows (Vorname, Nachname, ...) with the patient record of the same name and its decade."""
    named = date_parts_by_schema(patients.withColumn("Name", strip_title(F.col("Name")))).withColumnRenamed("Name", "Nachname")
    joined = cohort.join(named, ["Vorname", "Nachname"], "left")
    return joined.withColumn("decade", decade_text(F.col("Geburtsdatum")))


def cohort_table(cohort: DataFrame, patients: DataFrame) -> DataFrame:
    counted = count_by(cohort_members(cohort, patients), ["decade", "Gender", "grp"])
    return ratio_to_total(counted, "cnt", ["decade"], "cnt_p", "s")


def encounter_cohort(lab: DataFrame, extracts: DataFrame, cohort: DataFrame, patients: DataFrame) -> DataFrame:
    """One row per encounter of the ward extracts, with lab patient, cohort group and patient record.

    The lab side may lack an encounter and the cohort may lack a patient: neither loses a row.
    """
    tested = lab.select("Patient_ID", "Encounter").distinct().withColumn("has_lab", F.lit(True))
    wards = extracts.withColumnsRenamed({"Patnr": "Patient_ID", "Fallnr": "Encounter"})
    all_ = tested.join(wards, ["Patient_ID", "Encounter"], "right")
    all_ = all_.join(cohort.select("Patient_ID", "mk", "grp"), "Patient_ID", "full").where(F.col("ICD").isNotNull())
    one = first_rows(all_, ["Encounter"], ["Patient_ID", "Nachname"])
    clean = one.withColumns({
        "Nachname": repair_encoding(F.col("Nachname")),
        "grp": F.when(is_blank(F.col("grp")), DEFAULT_GROUP).otherwise(F.col("grp"))})
    return clean.join(patients.withColumnRenamed("Name", "Nachname"), ["Vorname", "Nachname"], "left")


def onset_members(patients: DataFrame, diagnoses: DataFrame, cohort: DataFrame) -> DataFrame:
    """Patients with a diagnosis year, their age at onset and years until the first event."""
    known = patients.join(diagnoses, shared_columns(patients, diagnoses)).where(F.col("Diagnose_Jahr").isNotNull())
    year = F.col("Diagnose_Jahr").try_cast("double")
    aged = known.withColumn("onset_age", year - F.col("year").try_cast("double")).withColumnRenamed("Name", "Nachname")
    until = F.coalesce(F.substring(F.col("mk1_date"), 1, 4).try_cast("double"), F.lit(float(NO_EVENT_YEAR)))
    return aged.join(cohort, ["Vorname", "Nachname"]).withColumn("years_to_event", until - year)


def onset_table(members: DataFrame) -> DataFrame:
    """Median, least and greatest onset age and years to the event by group and sex."""
    keys = ["grp", "Gender"]
    out = members.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("onset_age", "years_to_event")
                                       for n, f in (("min", F.min), ("max", F.max))])
    for c in ("onset_age", "years_to_event"):
        out = join_null_safe(out, quantiles(members, keys, c, {f"median_{c}": 0.5}), keys, "left")
    return out


def onset_decades(members: DataFrame) -> DataFrame:
    decades = members.withColumn("onset_decade", decade_floor(F.col("onset_age")).cast("bigint"))
    return ratio_to_total(count_by(decades, ["onset_decade", "Gender", "grp"]), "cnt", ["onset_decade"])


def clinical_status(cohort: DataFrame, patients: DataFrame, history: DataFrame, status: Sequence[str]) -> DataFrame:
    """Counts by group and status columns, one row per person (the first by patient number)."""
    joined = cohort.select("Vorname", "Nachname", "grp").join(
        patients.select(F.col("Name").alias("Nachname"), "Vorname", "Pat_Nr"), ["Vorname", "Nachname"], "left").join(
        history.select("Pat_Nr", *status), "Pat_Nr", "left")
    return count_by(first_rows(joined, ["Vorname", "Nachname"], ["Pat_Nr"]), ["grp", *status])


def age_table(members: DataFrame, as_of, corrections: DataFrame | None = None) -> DataFrame:
    """Sex flag, age and age at onset (in centuries) per patient; a correction replaces the patient's row.

    ``members`` has Patient_ID, Geschlecht, Geburtsdatum, Diagnose_Jahr.
    """
    born = parse_ymd(F.col("Geburtsdatum"))
    out = members.select(
        "Patient_ID", regex_flag(F.col("Geschlecht"), "weibl").cast("double").alias("Geschlecht"),
        age_in_centuries(born, F.lit(as_of)).alias("Age"),
        (onset_age(F.col("Diagnose_Jahr"), born) / 100).alias("Age_of_onset"), F.lit(1).alias("source"))
    if corrections is not None:
        out = out.unionByName(corrections.select("Patient_ID", "Geschlecht", "Age", "Age_of_onset", F.lit(0).alias("source")))
    return first_rows(out, ["Patient_ID"], ["source"]).drop("source")


def pre_event_records(records: DataFrame, events: DataFrame, cohort: DataFrame, event_columns: Sequence[str],
                      marker: str = "LeistID", months: int = 6) -> DataFrame:
    """Attribute rows with their record id, without encounters that touch the months after an event.

    ``records`` has Patient_ID, Encounter, seq, attr, value; ``events`` has Patient_ID, Encounter, date.
    """
    after = within_after(events, cohort, "Patient_ID", "date", event_columns, months, ["Encounter"])
    # encounters go whole, so they go before their rows are sorted for the record ids
    kept = records.join(after, "Encounter", "left_anti")
    marked = locf_marker(kept, ["Patient_ID", "Encounter"], ["seq"], "attr", marker, "Encounter", "lab_ID")
    return marked.join(cohort.select("Patient_ID", "mk", "Gender"), "Patient_ID")


def cohort_summary(members: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of the patients that were scored in the end."""
    used = members.join(scored.select("Patient_ID").distinct(), "Patient_ID", "left_semi")
    return count_by(used.select("Patient_ID", *keys).distinct(), keys)
