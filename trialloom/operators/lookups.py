"""Paged lists and detail lookups with delimiter-safe text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import delimited_date, delimited_text
from ..sources.registry import Registry
from . import views
from .rules import page, public

STAMP = "yyyy-MM-dd HH:mm:ss"


def _texts(*names: str) -> list[Column]:
    return [delimited_text(F.col(n)).alias(n) for n in names]


def public_trial_list(
    registry: Registry, limit: int | None = 20, offset: int | None = 0, after_id: int | None = None
) -> DataFrame:
    """One page of public trials by id.

    Every page of LIMIT/OFFSET sorts all rows before it again; ``after_id`` (the
    last id of the page before) is the cheap way through a long list.
    """
    trial = public(registry["trial"])
    if after_id is not None:
        trial = trial.filter(F.col("id") > after_id)
    # Cut the page out first: only its rows meet the vocabularies.
    rows = page(
        trial.select(
            "id", "trial_id", "status", "date_registration", "public_title", "recruitment_status_id", "study_type_id"
        ).orderBy("id"),
        limit, offset, 20,
    )
    named = views.with_xml_values(rows, registry, recruitment_status="recruitment_status", study_type="study_type")
    return named.orderBy("id").select(
        "id", *_texts("trial_id", "status"), delimited_date(F.col("date_registration")).alias("registration_date"),
        *_texts("public_title", "recruitment_status", "study_type"),
    )


def first_public_contact(contacts: DataFrame) -> DataFrame:
    """The public contact with the lowest id per trial, as a partial-aggregable minimum."""
    return (
        contacts.filter(F.col("contact_type") == "public")
        .groupBy("trial_id")
        .agg(
            F.min_by(
                F.struct(
                    F.concat_ws(" ", "firstname", "middlename", "lastname").alias("name"),
                    F.col("telephone").alias("phone"),
                    F.col("email").alias("email"),
                ),
                F.col("id"),
            ).alias("contact")
        )
        .select(
            F.col("trial_id").alias("id"),
            F.col("contact.name").alias("public_contact_name"),
            F.col("contact.phone").alias("public_contact_phone"),
            F.col("contact.email").alias("public_contact_email"),
        )
    )


def _details(trials: DataFrame, contacts: DataFrame, *extra: str) -> DataFrame:
    return trials.join(first_public_contact(contacts), "id", "left").select(
        *extra, "id",
        *_texts("trial_id", "utrn", "status", "url", "public_contact_name", "public_contact_phone", "public_contact_email"),
        delimited_date(F.col("registration_date")).alias("registration_date"),
        delimited_date(F.col("enrolment_date")).alias("enrolment_date"),
        *_texts(
            "target_size", "recruitment_status", "study_type", "study_design", "phase",
            "primary_sponsor", "public_title", "scientific_title", "health_conditions",
        ),
    )


def public_trial_by_id(registry: Registry, trial_id: int) -> DataFrame:
    """Details of one public trial; the id reaches both parquet scans as a filter."""
    return _details(
        views.public_trials(registry).filter(F.col("id") == trial_id).limit(1),
        registry["trial_contact"].filter(F.col("trial_id") == trial_id),
    )


def public_trial_by_registry_id(registry: Registry, registry_id: str) -> DataFrame:
    wanted = registry_id.strip(" ").upper()
    # Ids may differ in case alone: the lowest internal id is meant.
    same = public(registry["trial"]).filter(F.upper("trial_id") == wanted)
    first = same.agg(F.min("id").alias("id")).filter(F.col("id").isNotNull())
    found = views.public_trials(registry).join(first, "id", "left_semi")
    contacts = registry["trial_contact"].join(first.select(F.col("id").alias("trial_id")), "trial_id", "left_semi")
    return _details(found, contacts)


def public_trial(registry: Registry, key: str) -> DataFrame:
    """Route one typed key: a registry id by its prefix, anything else as internal id."""
    if key.startswith(C.REGISTRY_ID_PREFIX):
        return public_trial_by_registry_id(registry, key)
    return public_trial_by_id(registry, int(key))


def public_trial_lookup(registry: Registry, keys: DataFrame, column: str = "lookup_key") -> DataFrame:
    """Details for a whole table of keys at once, routed like ``public_trial``.

    Both kinds of key become internal ids first, so the wide public view is
    joined once.
    """
    keys = keys.select(F.col(column).alias("lookup_key")).filter(F.col("lookup_key").isNotNull()).distinct()
    by_registry_id = (
        keys.filter(F.col("lookup_key").startswith(C.REGISTRY_ID_PREFIX))
        .withColumn("_wanted", F.upper(F.trim("lookup_key")))
        .join(
            public(registry["trial"]).groupBy(F.upper("trial_id").alias("_wanted")).agg(F.min("id").alias("id")),
            "_wanted",
        )
        .select("lookup_key", "id")
    )
    by_id = (
        keys.filter(~F.col("lookup_key").startswith(C.REGISTRY_ID_PREFIX))
        .select("lookup_key", F.trim("lookup_key").try_cast("long").alias("id"))
        .filter(F.col("id").isNotNull())
    )
    wanted = by_registry_id.unionByName(by_id)
    contacts = registry["trial_contact"].join(wanted.select(F.col("id").alias("trial_id")), "trial_id", "left_semi")
    return _details(views.public_trials(registry).join(wanted, "id"), contacts, "lookup_key")


def list_pending_user_requests(requests: DataFrame) -> DataFrame:
    return views.pending_user_requests(requests).select(
        F.col("id").alias("request_id"),
        *_texts("full_name", "email", "requested_username", "requested_role", "request_reason"),
        delimited_date(F.col("created_at"), STAMP).alias("created_at"),
    )


def list_active_users(users: DataFrame, roles: DataFrame) -> DataFrame:
    return views.active_users(users, roles).select(
        F.col("id").alias("user_id"),
        *_texts("username", "full_name", "email", "role_code", "user_status"),
        delimited_date(F.col("created_at"), STAMP).alias("created_at"),
        delimited_date(F.col("last_login_at"), STAMP).alias("last_login_at"),
    )
