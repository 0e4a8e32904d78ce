"""Row sets behind the insight dataset, except sponsor x condition.

Rankings that the registry orders by a count alone get the group key as last
sort key, so every result is deterministic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates
from ..functions.conditions import loose_terms
from ..functions.text import is_blank, sponsor_name, title_case
from .rules import (
    as_rows, is_public, outdated_only, percentage, public, total_of, with_outdated_flag,
)


def executive_dashboard(trial: DataFrame, as_of: dt.date) -> DataFrame:
    registered = F.col("date_registration")
    return trial.agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(is_public()).alias("public_trials"),
        F.count_if(F.col("status") == "published").alias("published_trials"),
        F.count_if(F.col("status") == "approved").alias("approved_trials"),
        F.count_if(dates.in_same_period(registered, as_of, "year")).alias("registered_this_year"),
        F.count_if(dates.in_same_period(registered, as_of, "month")).alias("registered_this_month"),
    )


# --- recruitment freshness ----------------------------------------------------


def outdated_total(trial: DataFrame, recruitment: DataFrame, as_of: dt.date) -> DataFrame:
    return outdated_only(trial, recruitment, as_of).agg(F.count(F.lit(1)).alias("possibly_outdated_total"))


def recruitment_distribution(trial: DataFrame, recruitment: DataFrame) -> DataFrame:
    counts = public(trial).groupBy("recruitment_status_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(recruitment.select(F.col("id").alias("recruitment_status_id"), "xml_value"), "recruitment_status_id")
        .groupBy(F.col("xml_value").alias("recruitment_status_label"))
        .agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "recruitment_status_label")
    )


def risk_bands(trial: DataFrame, recruitment: DataFrame, as_of: dt.date) -> DataFrame:
    months = dates.months_since(F.col("date_enrolment"), as_of)
    band = (
        F.when(months.between(12, 23), "12_23_months")
        .when(months.between(24, 35), "24_35_months")
        .when(months >= 36, "36_plus_months")
        .otherwise("other")
    )
    return (
        outdated_only(trial, recruitment, as_of)
        .groupBy(band.alias("risk_band"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy("risk_band")
    )


def flagged_sponsors(
    trial: DataFrame, recruitment: DataFrame, as_of: dt.date, limit: int = C.TOP_FLAGGED_SPONSORS
) -> DataFrame:
    return (
        outdated_only(trial, recruitment, as_of)
        .groupBy(sponsor_name(F.col("primary_sponsor")).alias("sponsor"))
        .agg(F.count(F.lit(1)).alias("possibly_outdated_trials"))
        .orderBy(F.desc("possibly_outdated_trials"), "sponsor")
        .limit(limit)
    )


def oldest_examples(
    trial: DataFrame, recruitment: DataFrame, as_of: dt.date, limit: int = C.OLDEST_EXAMPLES
) -> DataFrame:
    return (
        outdated_only(trial, recruitment, as_of)
        .select(
            "id", "trial_id",
            F.left(F.coalesce("public_title", F.lit("")), F.lit(C.EXAMPLE_TITLE_LENGTH)).alias("public_title"),
            F.coalesce("primary_sponsor", F.lit(C.DEFAULT_SPONSOR)).alias("primary_sponsor"),
            F.col("active_label").alias("recruitment_status_label"),
            "date_enrolment",
            dates.months_since(F.col("date_enrolment"), as_of).alias("months_since_enrolment"),
        )
        .orderBy(F.desc_nulls_last("months_since_enrolment"), "id")
        .limit(limit)
    )


# --- rankings -------------------------------------------------------------------


def top_sponsors(
    trial: DataFrame,
    recruitment: DataFrame,
    study_type: DataFrame,
    as_of: dt.date,
    limit: int | None = C.TOP_SPONSORS,
) -> DataFrame:
    """Largest sponsors of public trials."""
    kind = F.lower("study_type")
    study_kind = study_type.select(F.col("id").alias("study_type_id"), F.col("xml_value").alias("study_type"))
    grouped = (
        public(with_outdated_flag(trial, recruitment, as_of))
        .join(study_kind, "study_type_id", "left")
        .groupBy(sponsor_name(F.col("primary_sponsor")).alias("sponsor"))
        .agg(
            F.count(F.lit(1)).alias("total_trials"),
            F.count_if("possibly_outdated").alias("possibly_outdated_trials"),
            F.count_if(dates.within_last_year(F.col("date_registration"), as_of)).alias("last_12_months_trials"),
            F.count_if(kind == "intervention").alias("interventional_trials"),
            F.count_if(kind == "observational").alias("observational_trials"),
        )
    )
    ranked = grouped.orderBy(F.desc("total_trials"), "sponsor").limit(max(C.TOP_SPONSORS if limit is None else limit, 1))
    return ranked.select(
        "sponsor", "total_trials", percentage(F.col("total_trials"), total_of(grouped, "total_trials")).alias("percentage"),
        "possibly_outdated_trials", "last_12_months_trials", "interventional_trials", "observational_trials",
    )


def top_health_conditions(
    trial: DataFrame, recruitment: DataFrame, as_of: dt.date, limit: int | None = C.TOP_CONDITIONS
) -> DataFrame:
    """Most frequent free-text terms.

    Trials count once per term; outdated trials count once per mention, so a
    trial naming a term twice adds two. One shuffle, on partially counted terms.
    """
    terms = (
        public(trial)
        .filter(F.coalesce("hc_freetext", F.lit("")) != "")
        .transform(lambda df: with_outdated_flag(df, recruitment, as_of))
        .select("possibly_outdated", "date_registration", F.inline(loose_terms(F.col("hc_freetext"))))
    )
    recent = dates.within_last_year(F.col("date_registration"), as_of)
    return (
        terms.groupBy(F.col("term").alias("condition_key"))
        .agg(
            F.count_if("is_first").alias("total_trials"),
            F.count_if("possibly_outdated").alias("possibly_outdated_trials"),
            F.count_if(F.col("is_first") & recent).alias("last_12_months_trials"),
        )
        .orderBy(F.desc("total_trials"), "condition_key")
        .limit(max(C.TOP_CONDITIONS if limit is None else limit, 1))
        .select(
            "condition_key", title_case(F.col("condition_key")).alias("condition_name"), "total_trials",
            "possibly_outdated_trials", "last_12_months_trials",
        )
    )


# --- profile, trends, quality -----------------------------------------------------


def profile(trial: DataFrame, key: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Public trials per readable value; entries that share a value share a row."""
    counts = public(trial).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(vocabulary.select("id", "xml_value"), "id", "left")
        .groupBy(F.coalesce("xml_value", F.lit("Unknown")).alias(name))
        .agg(F.sum("n").alias("total_trials"))
        .orderBy(F.desc("total_trials"), name)
    )


def trials_by_year(trial: DataFrame) -> DataFrame:
    return (
        public(trial)
        .filter(F.col("date_registration").isNotNull())
        .groupBy(F.year("date_registration").alias("year"))
        .agg(F.count(F.lit(1)).alias("total_trials"))
        .orderBy("year")
    )


def trials_by_month(trial: DataFrame, as_of: dt.date, months: int = C.TREND_MONTHS) -> DataFrame:
    """The last ``months`` calendar months; months without trials have no row."""
    first = F.add_months(F.trunc(dates.day(as_of), "month"), -(months - 1))
    return (
        public(trial)
        .filter(F.col("date_registration") >= first)
        .groupBy(F.date_format("date_registration", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("total_trials"))
        .orderBy("month")
    )


# Text columns are missing when blank, the others when NULL (fixed values, in report order).
QUALITY_FIELDS = (
    "public_title", "scientific_title", "primary_sponsor", "date_registration", "date_enrolment",
    "target_size", "study_type_id", "phase_id", "recruitment_status_id", "hc_freetext", "url",
)
QUALITY_TEXT_FIELDS = ("public_title", "scientific_title", "primary_sponsor", "hc_freetext", "url")


def missing_fields(trial: DataFrame) -> DataFrame:
    """Missing values per field, all in one pass."""
    one_row = public(trial).agg(
        *[
            F.count_if(is_blank(F.col(f)) if f in QUALITY_TEXT_FIELDS else F.col(f).isNull()).alias(f)
            for f in QUALITY_FIELDS
        ]
    )
    return as_rows(one_row, ["field_name", "missing_count"], [(f, f) for f in QUALITY_FIELDS]).orderBy(
        F.desc("missing_count"), "field_name"
    )


def date_issues(trial: DataFrame, as_of: dt.date) -> DataFrame:
    today = dates.day(as_of)
    return public(trial).agg(
        F.count_if(F.col("date_enrolment") < F.col("date_registration")).alias("enrolment_before_registration"),
        F.count_if(F.col("date_registration") > today).alias("future_registration_date"),
        F.count_if(F.col("date_enrolment") > today).alias("future_enrolment_date"),
    )
