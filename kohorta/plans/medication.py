"""Medication tables: repeated slots to rows, classes filled from known rows, classes before the event."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.functions.dates import before_event
from kohorta.functions.text import blank_to_null, is_blank, regex_flag
from kohorta.operators.aggregates import collapse_unique, ratio_to_total
from kohorta.operators.reshape import unpivot, unpivot_groups
from kohorta.session import materialize

# The classes that are recognised and flagged, in order of preference.
CLASSES = ("CE_Hemmer", "Corticoid", "Immunsupressivum")
SLOT_GROUPS = ("Drug", "Klasse", "Faktor", "Anweisung", "Tagesmenge")


def medication_distribution(wide: DataFrame, patient: str, class_columns: Sequence[str]) -> DataFrame:
    """Share of each class among the patient-class combinations."""
    long = unpivot(wide, [patient], class_columns, "slot", "Klasse", drop_blank=True)
    counted = long.groupBy("Klasse").agg(F.countDistinct(patient).alias("cnt_patients"))
    return ratio_to_total(counted, "cnt_patients")


GRAM = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def required_texts(pattern: Column) -> Column:
    """Texts that whatever the pattern matches must contain; empty where the pattern does not tell.

    Told are patterns of characters, dots and the signs * + ? after one character. Groups, choices, classes and escapes
    are left to the caller.
    """
    certain = F.regexp_replace(F.regexp_replace(pattern, r"(?s).[*?]+", "."), r"\+", ".")
    texts = F.filter(F.split(certain, r"\."), lambda x: x != "")
    return F.when(F.rlike(pattern, F.lit(r"[|\[\](){}\\^$]")), F.array().cast("array<string>")).otherwise(texts)


def _pieces(text: Column, size: int) -> Column:
    """All pieces of ``size`` characters."""
    return F.when(F.length(text) >= size, F.transform(
        F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def _grams(texts: Column) -> Column:
    """The pieces of three characters of every text, or the whole of a shorter one."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda x: F.when(F.length(x) <= GRAM, F.array(x)).otherwise(_pieces(x, GRAM)))))


def mentioned_ranks(names: DataFrame, known: DataFrame, drug: str = "Drug", literal: bool = False, tile: int = 1000) -> DataFrame:
    """(drug, rank): the least rank of the known names that occur in a name.

    ``names`` holds distinct texts in ``drug``, ``known`` has rank and known, repeated or not. A known name is a regular expression
    without regard to ASCII case (or a text without regard to any case if ``literal``). It is looked up by the rarest
    three characters that it must contain, an equi join that only meets names holding them, and then tested in full;
    a known name with such characters in no name is out at once. Expressions that require no text are dealt into tiles of
    ``tile``, and every name is tested against each tile, so no row or task holds all of them.
    """
    if literal:
        fold, required = F.lower, F.array(F.lower("known"))
    else:
        def fold(c):
            return F.translate(c, UPPER, LOWER)
        required = required_texts(fold(F.col("known")))

    def mentions(pattern):
        if literal:
            return F.lower(F.col(drug)).contains(F.lower(pattern))
        return F.rlike(F.col(drug), F.concat(F.lit("(?i)"), pattern))

    known = known.where("rank is not null and known <> ''").select("rank", "known").distinct().withColumn("__grams", _grams(required))
    folded = fold(F.col(drug))
    places = names.where(F.col(drug).isNotNull()).select(drug, F.explode(F.array_distinct(F.concat(
        *[_pieces(folded, size) for size in range(1, GRAM + 1)]))).alias("__gram"))
    often = places.groupBy("__gram").agg(F.count(F.lit(1)).alias("__often"))
    wanted = known.select("rank", "known", F.size("__grams").alias("__all"), F.explode("__grams").alias("__gram"))
    rarest = wanted.join(often, "__gram").groupBy("rank", "known", "__all").agg(
        F.min(F.struct("__often", "__gram")).alias("__best"), F.count(F.lit(1)).alias("__found"))
    keyed = rarest.where("__found = __all").select("rank", "known", F.col("__best.__gram").alias("__gram"))
    found = places.join(keyed, "__gram").where(mentions(F.col("known"))).groupBy(drug).agg(F.min("rank").alias("rank"))
    free = known.where(F.size("__grams") == 0).select("rank", "known")
    count = free.count()
    if count:
        tiles = math.ceil(count / tile)
        dealt = free.groupBy(F.pmod(F.xxhash64("known"), F.lit(tiles)).alias("__tile"), "rank").agg(
            F.collect_list("known").alias("__known"))
        visiting = names.where(F.col(drug).isNotNull()).select(drug, F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint"))).alias("__tile"))
        tested = visiting.join(dealt, "__tile").where(F.exists("__known", mentions))
        found = found.unionByName(tested.select(drug, "rank")).groupBy(drug).agg(F.min("rank").alias("rank"))
    return found


def fill_classes(rows: DataFrame, drug: str = "Drug", klass: str = "Klasse", classes: Sequence[str] = CLASSES,
                 literal: bool = False, dictionary_rows: int = 1000) -> DataFrame:
    """Give drugs without a class the first class that has a known drug whose name occurs in theirs.

    Names are matched once per distinct drug name against the dictionary of known names (``mentioned_ranks``), and the
    outcome is joined back. ``dictionary_rows`` bounds the expressions without a required text that travel in one row.
    """
    rank = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(classes))):
        rank = F.when(F.col(klass) == c, i).otherwise(rank)
    pairs = materialize(rows.select(drug, klass).distinct())  # names and classes only; the rows are read once for them
    known = pairs.select(rank.alias("rank"), F.col(drug).alias("known"))
    names = pairs.where(is_blank(F.col(klass)) & F.col(drug).isNotNull()).select(drug).distinct()  # blank and missing classes
    best = mentioned_ranks(names, known, drug, literal, dictionary_rows)
    guessed = best.select(drug, F.get(F.array(*[F.lit(c) for c in classes]), F.col("rank")).alias("__guess"))
    return rows.join(guessed, drug, "left").withColumn(
        klass, F.coalesce(blank_to_null(F.col(klass)), F.col("__guess"), F.lit(""))).drop("__guess")


def medication_rows(wide: DataFrame, ids: Sequence[str], slots: Sequence[int], groups: Sequence[str] = SLOT_GROUPS) -> DataFrame:
    return unpivot_groups(wide, ids, groups, slots)


def medication_classes(rows: DataFrame, events: DataFrame, patient: str, date: str, event: str, order: str,
                       classes: Sequence[str] = CLASSES) -> DataFrame:
    """Classes a patient took before the event, in first-seen order, with a flag per class.

    ``events`` has one row per patient of the cohort.
    """
    joined = fill_classes(rows, classes=classes).join(events.select(patient, event), patient)
    kept = joined.where(before_event(F.col(date), F.col(event)) & (F.col("Klasse") != ""))
    text = collapse_unique(kept, [patient], "Klasse", order, "Wirkstoffe")
    return text.withColumns({c: regex_flag(F.col("Wirkstoffe"), c) for c in classes})
