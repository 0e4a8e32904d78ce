"""All counts of the insight dataset from one pass over the trials.

A row is one group of one set: all trials, or the trials of a recruitment
status, study type, phase, risk band, sponsor or month of registration. The sets
are GROUPING SETS of one aggregate: each trial is read once, counted into its
group of every set on the map side, and only groups are shuffled. Sections are
then small queries on that table. The rules are those of ``insights``, whose
functions answer for one section at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates
from ..functions.text import is_blank, sponsor_name
from .insights import QUALITY_FIELDS, QUALITY_TEXT_FIELDS
from .rules import as_rows, is_public, percentage, total_of, with_outdated_flag

SETS = ("recruitment_status_id", "study_type_id", "phase_id", "risk_band", "sponsor", "month")
EVERYTHING = "all"
DATE_ISSUES = ("enrolment_before_registration", "future_registration_date", "future_enrolment_date")


def _risk_band(as_of: dt.date) -> Column:
    months = dates.months_since(F.col("date_enrolment"), as_of)
    return (
        F.when(months.between(12, 23), "12_23_months")
        .when(months.between(24, 35), "24_35_months")
        .when(months >= 36, "36_plus_months")
        .otherwise("other")
    )


def _marks(as_of: dt.date) -> dict[str, Column]:
    """What is counted, as a condition on a trial with ``possibly_outdated`` and ``kind``."""
    registered, enrolment, today = F.col("date_registration"), F.col("date_enrolment"), dates.day(as_of)
    missing = {f: is_blank(F.col(f)) if f in QUALITY_TEXT_FIELDS else F.col(f).isNull() for f in QUALITY_FIELDS}
    issues = (enrolment < registered, registered > today, enrolment > today)
    of_public = {
        "possibly_outdated_trials": F.col("possibly_outdated"),
        "last_12_months_trials": dates.within_last_year(registered, as_of),
        "interventional_trials": F.col("kind") == "intervention",
        "observational_trials": F.col("kind") == "observational",
        **{f"missing_{f}": condition for f, condition in missing.items()},
        **dict(zip(DATE_ISSUES, issues, strict=True)),
    }
    return {
        "public_trials": is_public(),
        "published_trials": F.col("status") == "published",
        "approved_trials": F.col("status") == "approved",
        "registered_this_year": dates.in_same_period(registered, as_of, "year"),
        "registered_this_month": dates.in_same_period(registered, as_of, "month"),
        **{name: is_public() & condition for name, condition in of_public.items()},
    }


def count_groups(trial: DataFrame, recruitment: DataFrame, study_type: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per set and group: ``set``, the key of that set, ``total_trials`` and every other count."""
    kinds = study_type.select(F.col("id").alias("study_type_id"), F.lower("xml_value").alias("kind"))
    marks = _marks(as_of)
    marked = with_outdated_flag(trial, recruitment, as_of).join(kinds, "study_type_id", "left").select(
        "recruitment_status_id", "study_type_id", "phase_id",
        _risk_band(as_of).alias("risk_band"),
        sponsor_name(F.col("primary_sponsor")).alias("sponsor"),
        F.trunc("date_registration", "month").alias("month"),
        *[condition.alias(name) for name, condition in marks.items()],
    )
    grouped = marked.groupingSets([[], *[[name] for name in SETS]], *SETS).agg(
        *[(F.grouping(name) == 0).alias(f"by_{name}") for name in SETS],
        F.count(F.lit(1)).alias("total_trials"),
        *[F.count_if(name).alias(name) for name in marks],
    )
    # A NULL key is a group of its own, so the set is told by grouping(), not by the keys.
    of_set = F.coalesce(*[F.when(F.col(f"by_{name}"), F.lit(name)) for name in SETS], F.lit(EVERYTHING))
    return grouped.select(of_set.alias("set"), *SETS, "total_trials", *marks)


def _set(counts: DataFrame, name: str, measure: str = "public_trials") -> DataFrame:
    """The groups of one set that ``measure`` counts at all."""
    return counts.filter((F.col("set") == name) & (F.col(measure) > 0))


def _overall(counts: DataFrame, *names: str) -> DataFrame:
    """One row of counts over all trials; zeros for an empty table, which has no group."""
    return counts.filter(F.col("set") == EVERYTHING).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def executive_dashboard(counts: DataFrame) -> DataFrame:
    return _overall(
        counts, "total_trials", "public_trials", "published_trials", "approved_trials",
        "registered_this_year", "registered_this_month",
    )


def outdated_total(counts: DataFrame) -> DataFrame:
    return _overall(counts, "possibly_outdated_trials").withColumnRenamed("possibly_outdated_trials", "possibly_outdated_total")


def recruitment_distribution(counts: DataFrame, recruitment: DataFrame) -> DataFrame:
    labels = recruitment.select(F.col("id").alias("recruitment_status_id"), "xml_value")
    return (
        _set(counts, "recruitment_status_id")
        .join(labels, "recruitment_status_id")
        .groupBy(F.col("xml_value").alias("recruitment_status_label"))
        .agg(F.sum("public_trials").alias("total"))
        .orderBy(F.desc("total"), "recruitment_status_label")
    )


def risk_bands(counts: DataFrame) -> DataFrame:
    bands = _set(counts, "risk_band", "possibly_outdated_trials")
    return bands.select("risk_band", F.col("possibly_outdated_trials").alias("total")).orderBy("risk_band")


def flagged_sponsors(counts: DataFrame, limit: int = C.TOP_FLAGGED_SPONSORS) -> DataFrame:
    flagged = _set(counts, "sponsor", "possibly_outdated_trials").select("sponsor", "possibly_outdated_trials")
    return flagged.orderBy(F.desc("possibly_outdated_trials"), "sponsor").limit(limit)


def top_sponsors(counts: DataFrame, limit: int = C.TOP_SPONSORS) -> DataFrame:
    sponsors = _set(counts, "sponsor")
    return sponsors.orderBy(F.desc("public_trials"), "sponsor").limit(limit).select(
        "sponsor", F.col("public_trials").alias("total_trials"),
        percentage(F.col("public_trials"), total_of(sponsors, "public_trials")).alias("percentage"),
        "possibly_outdated_trials", "last_12_months_trials", "interventional_trials", "observational_trials",
    )


def profile(counts: DataFrame, key: str, vocabulary: DataFrame, name: str) -> DataFrame:
    labels = vocabulary.select(F.col("id").alias(key), "xml_value")
    return (
        _set(counts, key)
        .join(labels, key, "left")
        .groupBy(F.coalesce("xml_value", F.lit("Unknown")).alias(name))
        .agg(F.sum("public_trials").alias("total_trials"))
        .orderBy(F.desc("total_trials"), name)
    )


def trials_by_year(counts: DataFrame) -> DataFrame:
    months = _set(counts, "month").filter(F.col("month").isNotNull())
    return months.groupBy(F.year("month").alias("year")).agg(F.sum("public_trials").alias("total_trials")).orderBy("year")


def trials_by_month(counts: DataFrame, as_of: dt.date, months: int = C.TREND_MONTHS) -> DataFrame:
    first = F.add_months(F.trunc(dates.day(as_of), "month"), -(months - 1))
    recent = _set(counts, "month").filter(F.col("month") >= first)
    return recent.select(
        F.date_format("month", "yyyy-MM").alias("month"), F.col("public_trials").alias("total_trials")
    ).orderBy("month")


def missing_fields(counts: DataFrame) -> DataFrame:
    one_row = _overall(counts, *[f"missing_{f}" for f in QUALITY_FIELDS])
    fields = as_rows(one_row, ["field_name", "missing_count"], [(f"missing_{f}", f) for f in QUALITY_FIELDS])
    return fields.orderBy(F.desc("missing_count"), "field_name")


def date_issues(counts: DataFrame) -> DataFrame:
    return _overall(counts, *DATE_ISSUES)
