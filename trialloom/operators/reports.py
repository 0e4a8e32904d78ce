"""The six tabular reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates
from ..functions.text import delimited_date, delimited_text
from ..sources.registry import Registry
from .rules import as_rows, is_public, outdated_only, page, percentage, public, total_of, with_outdated_flag

# Codes and labels of the dashboard lines (fixed values), in report order.
DASHBOARD_LINES = (
    ("total_trials", "Total trials"),
    ("published_trials", "Published trials"),
    ("approved_trials", "Approved trials"),
    ("public_trials", "Public trials"),
    ("recruiting_trials", "Recruiting trials"),
    ("not_yet_recruiting_trials", "Not yet recruiting trials"),
    ("possibly_outdated_recruitment_trials", "Possibly outdated recruitment trials"),
    ("pending_user_requests", "Pending user requests"),
    ("active_registrants", "Active registrants"),
    ("active_reviewers", "Active reviewers"),
    ("registered_this_month", "Trials registered this month"),
    ("registered_this_year", "Trials registered this year"),
)


def registry_dashboard(registry: Registry, as_of: dt.date) -> DataFrame:
    """Twelve indicators, one conditional aggregate per base table."""
    open_code = F.col("active_code")
    registered = F.col("date_registration")
    trials = with_outdated_flag(registry["trial"], registry.vocabulary("recruitment_status"), as_of).agg(
        F.count(F.lit(1)).alias("total_trials"),
        F.count_if(F.col("status") == "published").alias("published_trials"),
        F.count_if(F.col("status") == "approved").alias("approved_trials"),
        F.count_if(is_public()).alias("public_trials"),
        F.count_if(is_public() & (open_code == "recruiting")).alias("recruiting_trials"),
        F.count_if(is_public() & (open_code == "not_yet_recruiting")).alias("not_yet_recruiting_trials"),
        F.count_if(is_public() & F.col("possibly_outdated")).alias("possibly_outdated_recruitment_trials"),
        F.count_if(dates.in_same_period(registered, as_of, "month")).alias("registered_this_month"),
        F.count_if(dates.in_same_period(registered, as_of, "year")).alias("registered_this_year"),
    )
    requests = registry["app_user_request"].agg(
        F.count_if(F.col("request_status") == "pending").alias("pending_user_requests")
    )
    role = registry["app_role"].select(F.col("id").alias("role_id"), "role_code")
    users = (
        registry["app_user"]
        .filter(F.col("user_status") == "active")
        .join(role, "role_id")
        .agg(
            F.count_if(F.col("role_code") == "registrant").alias("active_registrants"),
            F.count_if(F.col("role_code") == "reviewer").alias("active_reviewers"),
        )
    )
    columns = ["line", "metric_code", "metric_label", "count"]
    lines = [
        as_rows(
            part, columns,
            [(code, line, code, label) for line, (code, label) in enumerate(DASHBOARD_LINES) if code in part.columns],
        )
        for part in (trials, requests, users)
    ]
    return (
        lines[0].unionByName(lines[1]).unionByName(lines[2])
        .orderBy("line")
        .select("metric_code", "metric_label", F.col("count").cast("string").alias("metric_value"))
    )


def dimension_distribution(trial: DataFrame, key: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Public trials per active vocabulary entry, entries without trials included.

    The facts are counted by id first, so only the counts meet the vocabulary.
    """
    counts = public(trial).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.col("n"), F.lit(0))
    return (
        vocabulary.filter("is_active")
        .join(counts, "id", "left")
        .orderBy("sort_order", "xml_value")
        .select(
            F.col("code").alias(f"{name}_code"),
            F.col("xml_value").alias(f"{name}_label"),
            total.alias("total_trials"),
            percentage(total, total_of(counts, "n")).alias("percentage"),
        )
    )


def trials_by_recruitment_status(registry: Registry) -> DataFrame:
    return dimension_distribution(
        registry["trial"], "recruitment_status_id", registry.vocabulary("recruitment_status"), "recruitment_status"
    )


def trials_by_study_type(registry: Registry) -> DataFrame:
    return dimension_distribution(registry["trial"], "study_type_id", registry.vocabulary("study_type"), "study_type")


def trials_by_status(registry: Registry) -> DataFrame:
    counts = registry["trial"].groupBy(F.col("status").alias("status_code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "status_code").select(
        "status_code", F.col("n").alias("total_trials"), percentage(F.col("n"), total_of(counts, "n")).alias("percentage")
    )


def possibly_outdated_trials(
    registry: Registry,
    as_of: dt.date,
    limit: int | None = 50,
    offset: int | None = 0,
    after: tuple[dt.date, int] | None = None,
) -> DataFrame:
    """Public trials still marked as (about to be) recruiting a year after enrolment began.

    ``after`` (enrolment date and id of the last row of the page before) goes on
    from there without sorting the earlier pages again.
    """
    flagged = outdated_only(registry["trial"], registry.vocabulary("recruitment_status"), as_of)
    if after is not None:
        date, last_id = dates.day(after[0]), after[1]
        enrolled = F.col("date_enrolment")
        flagged = flagged.filter((enrolled > date) | ((enrolled == date) & (F.col("id") > last_id)))
    top = page(
        flagged.select(
            "id", "trial_id", "status", "active_label", "date_registration", "date_enrolment",
            "public_title", "primary_sponsor",
        ).orderBy("date_enrolment", "id"),
        limit, offset, 50,
    )
    return top.select(
        "id",
        delimited_text(F.col("trial_id")).alias("trial_id"),
        delimited_text(F.col("status")).alias("status"),
        delimited_text(F.col("active_label")).alias("recruitment_status"),
        delimited_date(F.col("date_registration")).alias("registration_date"),
        delimited_date(F.col("date_enrolment")).alias("enrolment_date"),
        dates.months_since(F.col("date_enrolment"), as_of).alias("months_since_enrolment"),
        F.lit(C.OUTDATED_FLAG).alias("flag"),
        delimited_text(F.col("public_title")).alias("public_title"),
        delimited_text(F.col("primary_sponsor")).alias("primary_sponsor"),
    )


def possibly_outdated_count(registry: Registry, as_of: dt.date) -> DataFrame:
    flagged = outdated_only(registry["trial"], registry.vocabulary("recruitment_status"), as_of)
    return flagged.agg(F.count(F.lit(1)).alias("total_trials"))
