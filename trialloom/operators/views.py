"""Derived columns and registry views.

The vocabulary joins carry no broadcast hint: vocabularies grow when documents
bring new spellings, so Spark decides by their known size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.registry import Registry
from .rules import public


def _xml_values(registry: Registry, vocabulary: str, key: str, name: str) -> DataFrame:
    return registry.vocabulary(vocabulary).select(F.col("id").alias(key), F.col("xml_value").alias(name))


def with_xml_values(df: DataFrame, registry: Registry, **names: str) -> DataFrame:
    """Left join vocabularies by ``<vocabulary>_id``; names maps vocabulary -> output column."""
    for vocabulary, name in names.items():
        key = f"{vocabulary}_id"
        df = df.join(_xml_values(registry, vocabulary, key, name), key, "left")
    return df


def study_design_text(design: DataFrame, registry: Registry) -> DataFrame:
    """Add ``full_design`` and ``compact_design`` to the study-design rows."""
    df = with_xml_values(
        design, registry,
        expanded_access="_access", study_focus="_focus", intervention_design="_design",
        masking_type="_masking", allocation_type="_allocation",
    )
    part = lambda name: F.nullif(F.col(name), F.lit(""))
    arms = F.when(F.col("number_of_arms") > 0, F.concat(F.col("number_of_arms").cast("string"), F.lit(" arms")))
    return (
        df.withColumn(
            "full_design",
            F.concat_ws(", ", part("_access"), part("_focus"), part("_design"), arms, part("_masking"), part("_allocation")),
        )
        .withColumn("compact_design", F.concat_ws(", ", part("_access"), part("_allocation"), part("_masking")))
        .drop("_access", "_focus", "_design", "_masking", "_allocation")
    )


def refresh_study_design(design: DataFrame, registry: Registry) -> DataFrame:
    """What a save does to the design rows: the stored text becomes the compact design."""
    return study_design_text(design, registry).select(
        *[F.col("compact_design").alias(c) if c == "generated_study_design" else F.col(c) for c in design.columns]
    )


def trial_main(registry: Registry) -> DataFrame:
    """One row per trial with resolved vocabularies, design text and results."""
    trial = with_xml_values(
        registry["trial"], registry,
        type_enrolment="type_enrolment", recruitment_status="recruitment_status",
        study_type="study_type", phase="phase",
    )
    design = registry["trial_study_design"].select(
        F.col("trial_id").alias("id"), F.col("generated_study_design").alias("study_design")
    )
    ipd = registry.vocabulary("ipd_plan").select(
        F.col("code").alias("ipd_plan"), F.col("xml_value").alias("results_ipd_plan")
    )
    renamed = (
        "actual_enrolment", "date_completed", "url_link", "summary", "date_posted",
        "date_first_publication", "baseline_char", "participant_flow", "adverse_events",
        "outcome_measures", "url_protocol",
    )
    results = (
        registry["trial_results"]
        .join(ipd, "ipd_plan", "left")
        .select(
            F.col("trial_id").alias("id"),
            *[F.col(c).alias(f"results_{c}") for c in renamed],
            "results_ipd_plan",
            F.col("ipd_description").alias("results_ipd_description"),
        )
    )
    return trial.join(design, "id", "left").join(results, "id", "left").select(
        "id", "trial_id", "utrn", "reg_name", "status", "date_registration", "primary_sponsor",
        "public_title", "acronym", "scientific_title", "scientific_acronym", "date_enrolment",
        "type_enrolment", "target_size", "recruitment_status", "url", "study_type", "study_design",
        "phase", "hc_freetext", "i_freetext", *[f"results_{c}" for c in renamed],
        "results_ipd_plan", "results_ipd_description",
    )


def criteria_text(registry: Registry) -> DataFrame:
    """Criteria with ages and gender written the way the registry XML writes them."""
    unit = registry.vocabulary("age_unit")
    units = lambda side: unit.select(
        F.col("code").alias(f"age_{side}_unit"), F.col("xml_value").alias(f"_{side}_suffix")
    )
    gender = registry.vocabulary("gender").select(F.col("code").alias("gender"), F.col("xml_value").alias("_gender"))

    def age(side: str) -> Column:
        number = F.col(f"age_{side}_value").cast("string")
        text = F.when(F.col(f"age_{side}_unit").isNull(), number).otherwise(
            F.concat(number, F.col(f"_{side}_suffix"))
        )
        if side == "max":
            return F.when(F.col("age_max_value") == 0, F.lit("0")).otherwise(text)
        return text

    return (
        registry["trial_criteria"]
        .join(units("min"), "age_min_unit", "left")
        .join(units("max"), "age_max_unit", "left")
        .join(gender, "gender", "left")
        .select(
            "trial_id", "inclusion_criteria", age("min").alias("agemin"), age("max").alias("agemax"),
            F.col("_gender").alias("gender"), "exclusion_criteria",
        )
    )


def public_trials(registry: Registry) -> DataFrame:
    """Approved and published trials with readable vocabularies and the design text."""
    design = registry["trial_study_design"].select(
        F.col("trial_id").alias("id"), F.col("generated_study_design").alias("study_design")
    )
    return (
        with_xml_values(
            public(registry["trial"]), registry,
            recruitment_status="recruitment_status", study_type="study_type", phase="phase",
        )
        .join(design, "id", "left")
        .select(
            "id", "trial_id", "status", F.col("date_registration").alias("registration_date"),
            F.col("date_enrolment").alias("enrolment_date"), "public_title", "scientific_title",
            "recruitment_status", "study_type", "phase", "target_size", "primary_sponsor", "url",
            "utrn", "study_design", F.col("hc_freetext").alias("health_conditions"),
        )
    )


def pending_user_requests(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("request_status") == "pending").select(
        "id", "full_name", "email", "requested_username", "requested_role", "request_reason",
        "request_status", "created_at",
    ).orderBy("created_at", "id")


def active_users(users: DataFrame, roles: DataFrame) -> DataFrame:
    role = roles.select(F.col("id").alias("role_id"), "role_code", "role_name")
    return (
        users.filter(F.col("user_status") == "active")
        .join(role, "role_id", "left")
        .select(
            "id", "username", "full_name", "email", "role_code", "role_name", "user_status",
            "created_at", "last_login_at",
        )
        .orderBy("username")
    )
