"""Every operator run over the given tables; ``oracles`` states the same in SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import access, insights, lookups, reports, sponsor_condition, views, vocabulary
from ..sinks import outputs, snapshots
from ..sources.registry import Registry, id_vocabulary, new_registry, roles, seed_missing
from ..staging import stage, staging_root
from .given_tables import AS_OF, GivenTables
from .ingest import IngestOptions, IngestResult, ingest_trials
from .insight_dataset import insight_document as build_document
from .insight_dataset import insight_rows as build_rows
from .insight_dataset import insight_tables
from .store import create_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable[[GivenTables], DataFrame]) -> Callable[[GivenTables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(GivenTables(spark, folder))
    return function


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """The SQL check computes percentages as DOUBLE; compare on common ground."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


# --- reports -------------------------------------------------------------------


@query
def dashboard(t: GivenTables) -> DataFrame:
    registry = t.registry(
        "status", "recruitment_status_id", "date_registration", "date_enrolment",
        also=("app_user", "app_user_request"),
    )
    return reports.registry_dashboard(registry, AS_OF)


@query
def by_recruitment(t: GivenTables) -> DataFrame:
    return as_double(reports.trials_by_recruitment_status(t.registry("status", "recruitment_status_id")), "percentage")


@query
def by_study_type(t: GivenTables) -> DataFrame:
    return as_double(reports.trials_by_study_type(t.registry("status", "study_type_id")), "percentage")


@query
def by_status(t: GivenTables) -> DataFrame:
    return as_double(reports.trials_by_status(t.registry("status")), "percentage")


OUTDATED = ("id", "trial_id", "status", "recruitment_status_id", "date_registration", "date_enrolment")


@query
def outdated_list(t: GivenTables) -> DataFrame:
    registry = t.registry(*OUTDATED, "public_title", "primary_sponsor")
    return reports.possibly_outdated_trials(registry, AS_OF, limit=50, offset=25)


@query
def outdated_count(t: GivenTables) -> DataFrame:
    return reports.possibly_outdated_count(t.registry(*OUTDATED), AS_OF)


# --- views and lookups -----------------------------------------------------------


@query
def public_trials(t: GivenTables) -> DataFrame:
    return as_text(views.public_trials(t.registry(also=("trial_study_design",))), "registration_date", "enrolment_date", "target_size")


LISTED = (
    "id", "trial_id", "status", "date_registration", "public_title", "recruitment_status_id", "study_type_id",
)


@query
def public_list(t: GivenTables) -> DataFrame:
    return lookups.public_trial_list(t.registry(*LISTED), limit=20, offset=40)


@query
def public_view(t: GivenTables) -> DataFrame:
    """Details for a key per order: registry ids of urgent orders, internal ids of the others."""
    key = F.col("o_orderkey").cast("string")
    keys = t.table("orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("RBR-"), key, F.lit(" "))).otherwise(key).alias("lookup_key")
    )
    registry = t.registry(also=("trial_study_design", "trial_contact"))
    return lookups.public_trial_lookup(registry, keys)


@query
def trial_main(t: GivenTables) -> DataFrame:
    df = views.trial_main(t.registry(also=("trial_study_design", "trial_results")))
    return as_text(
        df, "date_registration", "date_enrolment", "results_date_completed", "results_date_posted",
        "results_date_first_publication", "target_size", "results_actual_enrolment",
    )


@query
def criteria_text(t: GivenTables) -> DataFrame:
    return views.criteria_text(t.registry("id", also=("trial_criteria",)))


@query
def study_design(t: GivenTables) -> DataFrame:
    registry = t.registry("id", also=("trial_study_design",))
    return views.study_design_text(registry["trial_study_design"], registry).select(
        "trial_id", "full_design", "compact_design"
    )


@query
def pending_requests(t: GivenTables) -> DataFrame:
    return lookups.list_pending_user_requests(t.requests())


@query
def active_users(t: GivenTables) -> DataFrame:
    return lookups.list_active_users(t.users(), roles(t.spark))


# --- insights ----------------------------------------------------------------------


def recruitment(t: GivenTables) -> DataFrame:
    return id_vocabulary(t.spark, "recruitment_status")


@query
def executive_dashboard(t: GivenTables) -> DataFrame:
    return insights.executive_dashboard(t.trial("status", "date_registration"), AS_OF)


@query
def freshness_total(t: GivenTables) -> DataFrame:
    return insights.outdated_total(t.trial(*OUTDATED), recruitment(t), AS_OF)


@query
def freshness_status(t: GivenTables) -> DataFrame:
    return insights.recruitment_distribution(t.trial("status", "recruitment_status_id"), recruitment(t))


@query
def freshness_bands(t: GivenTables) -> DataFrame:
    return insights.risk_bands(t.trial(*OUTDATED), recruitment(t), AS_OF)


@query
def freshness_sponsors(t: GivenTables) -> DataFrame:
    return insights.flagged_sponsors(t.trial(*OUTDATED, "primary_sponsor"), recruitment(t), AS_OF)


@query
def freshness_oldest(t: GivenTables) -> DataFrame:
    df = insights.oldest_examples(t.trial(*OUTDATED, "public_title", "primary_sponsor"), recruitment(t), AS_OF)
    return as_text(df, "date_enrolment")


@query
def top_sponsors(t: GivenTables) -> DataFrame:
    df = insights.top_sponsors(
        t.trial(*OUTDATED, "primary_sponsor", "study_type_id"), recruitment(t),
        id_vocabulary(t.spark, "study_type"), AS_OF,
    )
    return as_double(df, "percentage")


CONDITIONS = (*OUTDATED, "primary_sponsor", "hc_freetext")


@query
def top_conditions(t: GivenTables) -> DataFrame:
    return insights.top_health_conditions(t.trial(*CONDITIONS), recruitment(t), AS_OF)


@query
def profile_type(t: GivenTables) -> DataFrame:
    return insights.profile(t.trial("status", "study_type_id"), "study_type_id", id_vocabulary(t.spark, "study_type"), "study_type")


@query
def profile_phase(t: GivenTables) -> DataFrame:
    return insights.profile(t.trial("status", "phase_id"), "phase_id", id_vocabulary(t.spark, "phase"), "phase")


@query
def trend_year(t: GivenTables) -> DataFrame:
    return insights.trials_by_year(t.trial("status", "date_registration"))


@query
def trend_month(t: GivenTables) -> DataFrame:
    return insights.trials_by_month(t.trial("status", "date_registration"), AS_OF)


@query
def quality_missing(t: GivenTables) -> DataFrame:
    return insights.missing_fields(t.trial("status", *insights.QUALITY_FIELDS))


@query
def quality_dates(t: GivenTables) -> DataFrame:
    return insights.date_issues(t.trial("status", "date_registration", "date_enrolment"), AS_OF)


def terms(t: GivenTables) -> DataFrame:
    return sponsor_condition.trial_terms(t.trial(*CONDITIONS), recruitment(t), AS_OF)


def focus(t: GivenTables) -> tuple[DataFrame, DataFrame]:
    """(focused pairs, focus conditions) from one staged pass over the trials."""
    pairs = stage(sponsor_condition.pair_counts(terms(t)), "pairs")
    conditions = sponsor_condition.focus_conditions(pairs)
    return sponsor_condition.focused_pairs(pairs, conditions), conditions


@query
def sc_conditions(t: GivenTables) -> DataFrame:
    return sponsor_condition.condition_counts(sponsor_condition.pair_counts(terms(t)))


@query
def sc_top_conditions(t: GivenTables) -> DataFrame:
    return sponsor_condition.focus_conditions(sponsor_condition.pair_counts(terms(t)))


@query
def sc_pairs(t: GivenTables) -> DataFrame:
    return sponsor_condition.top_pairs(focus(t)[0])


@query
def sc_by_sponsor(t: GivenTables) -> DataFrame:
    return sponsor_condition.sponsor_top_conditions(focus(t)[0])


@query
def sc_by_condition(t: GivenTables) -> DataFrame:
    return sponsor_condition.condition_top_sponsors(focus(t)[0])


@query
def sc_concentration(t: GivenTables) -> DataFrame:
    return as_double(sponsor_condition.condition_concentration(focus(t)[0]), "avg_trials_per_sponsor")


@query
def sc_burden(t: GivenTables) -> DataFrame:
    rows = stage(terms(t), "terms")
    conditions = sponsor_condition.focus_conditions(sponsor_condition.pair_counts(rows))
    return as_double(sponsor_condition.sponsor_outdated_burden(rows, conditions), "possibly_outdated_percentage")


# --- expressions over whole tables ----------------------------------------------------


@query
def clean_documents(t: GivenTables) -> DataFrame:
    return t.table("documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


@query
def delimited_documents(t: GivenTables) -> DataFrame:
    return t.table("documents").select("doc_id", text.delimited_text(F.col("text")).alias("line"))


@query
def codes(t: GivenTables) -> DataFrame:
    return t.table("documents").select("doc_id", parsing.normalize_code(text.clean(F.col("text"))).alias("code"))


@query
def title_case(t: GivenTables) -> DataFrame:
    spelling = F.lower(F.concat_ws("-", "p_name", "p_brand", "p_type"))
    return t.table("part").select("p_partkey", text.title_case(spelling).alias("name"))


@query
def typed_dates(t: GivenTables) -> DataFrame:
    """Order dates written in several layouts, valid and not, and read back."""
    date, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    written = (
        F.when(priority == "1-URGENT", F.date_format(date, "dd/MM/yyyy"))
        .when(priority == "2-HIGH", F.date_format(date, "yyyy-MM-dd"))
        .when(priority == "3-MEDIUM", F.date_format(date, "d-M-yyyy"))
        .when(priority == "5-LOW", F.date_format(date, "yyyy/MM/dd"))
        .otherwise(F.concat(F.lit("31/"), F.date_format(date, "MM/yyyy")))
    )
    return t.table("orders").select("o_orderkey", parsing.parse_date(written).cast("string").alias("parsed"))


@query
def typed_ages(t: GivenTables) -> DataFrame:
    size = F.col("p_size").cast("string")
    written = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(size, F.lit("Y")))
        .when(F.col("p_type") == "LARGE", F.concat(size, F.lit(" months")))
        .when(F.col("p_type") == "MEDIUM", F.concat(size, F.lit(".5Y")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("about "), size))
        .when(F.col("p_type") == "SMALL", F.concat(size, F.lit("Min")))
        .otherwise(F.concat(size, F.lit("Z")))
    )
    age = parsing.parse_age(written)
    return t.table("part").select("p_partkey", age["value"].alias("value"), age["unit"].alias("unit"))


@query
def typed_designs(t: GivenTables) -> DataFrame:
    """Design texts put together from order columns, read back as features."""
    written = F.concat(
        F.when(F.col("o_orderstatus") == "F", F.lit("Expanded Access"))
        .when(F.col("o_orderstatus") == "O", F.lit("n/a")).otherwise(F.lit(" unknown")),
        F.lit(", "),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("randomized-controlled , Double-Blind, treatment"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("non-randomized,open label,prevention, parallel"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("single blind, other, screening"))
        .otherwise(F.lit("crossover")),
        F.lit(", "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" arms"),
    )
    df = parsing.with_study_design(t.table("orders").select("o_orderkey", written.alias("text")), F.col("text"))
    return df.select("o_orderkey", "design.*").withColumn("arms", F.col("arms").cast("int"))


# --- vocabularies ------------------------------------------------------------------------


def phase_spellings(t: GivenTables) -> DataFrame:
    """A spelling per part: known ones, variants of known ones, new ones in two variants."""
    size = F.col("p_size")
    value = (
        F.when(size < 10, F.lit("Phase 1"))
        .when(size < 20, F.lit("phase-1"))
        .when(size < 30, F.col("p_brand"))
        .when(size < 40, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))))
        .otherwise(F.lit("n/a"))
    )
    events = t.table("part").select((F.col("p_partkey") + 1).alias("position"), value.alias("value"))
    return stage(
        vocabulary.match(events, F.col("value"), id_vocabulary(t.spark, "phase"), "matched_id"), "spellings"
    )


@query
def vocab_resolve(t: GivenTables) -> DataFrame:
    uses, entries = vocabulary.settle(phase_spellings(t), id_vocabulary(t.spark, "phase"))
    return vocabulary.resolve(uses, entries).select("position", F.col("matched_id").alias("id"))


@query
def vocab_grown(t: GivenTables) -> DataFrame:
    phases = id_vocabulary(t.spark, "phase")
    return vocabulary.grown(phases, vocabulary.settle(phase_spellings(t), phases)[1])


@query
def vocab_seed(t: GivenTables) -> DataFrame:
    """A vocabulary of order priorities that already has one seeded code, seeded."""
    current = t.table("orders").groupBy(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("withdrawn")).otherwise(
            parsing.normalize_code(F.col("o_orderpriority"))
        ).alias("code")
    ).agg(F.max("o_orderpriority").alias("label")).select(
        F.length("code").cast("long").alias("id"), "code", "label", F.col("label").alias("xml_value"),
        F.lit(1).alias("sort_order"), F.lit(True).alias("is_active"),
    )
    return seed_missing(current, id_vocabulary(t.spark, "recruitment_status"))


# --- access batches --------------------------------------------------------------------------

BATCH = dt.datetime(2001, 8, 2, 12)


@query
def triage(t: GivenTables) -> DataFrame:
    outcomes = access.triage_requests(t.new_requests(), t.known_users(), t.known_requests(), BATCH)[0]
    return as_text(outcomes, "request_id")


@query
def triage_requests(t: GivenTables) -> DataFrame:
    requests = access.triage_requests(t.new_requests(), t.known_users(), t.known_requests(), BATCH)[1]
    return as_text(requests, "created_at")


@query
def approvals(t: GivenTables) -> DataFrame:
    outcomes = access.apply_approvals(t.decisions(), t.open_requests(), t.staff(), roles(t.spark), BATCH)[0]
    return as_text(outcomes, "new_user_id")


@query
def approved_users(t: GivenTables) -> DataFrame:
    users = access.apply_approvals(t.decisions(), t.open_requests(), t.staff(), roles(t.spark), BATCH)[1]
    return as_text(users.select("id", "username", "email", "role_id", "user_status", "approved_by"), "approved_by")


@query
def approved_requests(t: GivenTables) -> DataFrame:
    requests = access.apply_approvals(t.decisions(), t.open_requests(), t.staff(), roles(t.spark), BATCH)[2]
    return as_text(requests.select("id", "request_status", "reviewed_by", "review_comment"), "reviewed_by")


@query
def rejections(t: GivenTables) -> DataFrame:
    return access.apply_rejections(t.decisions(), t.open_requests(), t.staff(), roles(t.spark), BATCH)[0]


@query
def rejected_requests(t: GivenTables) -> DataFrame:
    requests = access.apply_rejections(t.decisions(), t.open_requests(), t.staff(), roles(t.spark), BATCH)[1]
    return as_text(requests.select("id", "request_status", "reviewed_by", "review_comment"), "reviewed_by")


@query
def role_check(t: GivenTables) -> DataFrame:
    """May each user do what reviewers and what anybody may do?"""
    users = t.users().join(roles(t.spark).select(F.col("id").alias("role_id"), "role_code"), "role_id", "left")
    return users.select(
        "id",
        access.role_allows(F.col("role_code"), F.lit("reviewer ")).alias("may_review"),
        access.role_allows(F.col("role_code"), F.lit("")).alias("may_enter"),
    )


# --- import ------------------------------------------------------------------------------------


#: A compressed document is read by one task, so documents are of bounded size.
ELEMENTS_IN_FILE = 10_000


def documents(t: GivenTables, *statuses: str) -> str:
    """The folder of the orders with these statuses (of all orders) written as registry XML."""
    path = f"{staging_root(t.spark)}/documents-{uuid.uuid4().hex}"
    elements = t.trial_elements(statuses) if statuses else t.trial_elements()
    elements.write.option("compression", "gzip").option("maxRecordsPerFile", ELEMENTS_IN_FILE).text(path)
    return path


def imported(t: GivenTables) -> IngestResult:
    """The import of the orders written as registry XML."""
    path = documents(t)
    return ingest_trials(t.spark, path, new_registry(t.spark), IngestOptions("GIVEN", BATCH))


@query
def import_trials(t: GivenTables) -> DataFrame:
    registry = imported(t).registry
    df = registry["trial"]
    for name in ("type_enrolment", "recruitment_status", "study_type", "phase"):
        entry = registry.vocabulary(name).select(F.col("id").alias(f"{name}_id"), F.concat_ws("=", "code", "label").alias(name))
        df = df.join(entry, f"{name}_id", "left")
    df = df.select(
        "id", "trial_id", "status", "date_registration", "date_enrolment", "primary_sponsor", "public_title",
        "scientific_title", "target_size", "type_enrolment", "recruitment_status", "study_type", "phase", "hc_freetext",
    )
    return as_text(df, "date_registration", "date_enrolment")


@query
def import_children(t: GivenTables) -> DataFrame:
    """Rows per written table, and the texts that were generated or typed."""
    registry = imported(t).registry
    what = {
        "trial_study_design": F.concat_ws("/", "generated_study_design", "number_of_arms"),
        "trial_contact": F.col("contact_type"),
        "trial_country": F.col("country_code"),
        "trial_criteria": F.concat_ws("/", "age_min_value", "age_min_unit", "gender", "inclusion_criteria"),
        "trial_health_condition_keyword": F.col("keyword"),
        "trial_outcome": F.concat_ws("/", "outcome_type", "sort_order"),
        "trial_results": F.lit("results"),
        "trial_review": F.col("review_status"),
        "trial_public_snapshot": F.col("is_current").cast("string"),
    }
    parts = [
        registry[name].groupBy(F.lit(name).alias("table_name"), column.alias("content")).agg(F.count(F.lit(1)).alias("n"))
        for name, column in what.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def import_quarantine(t: GivenTables) -> DataFrame:
    return imported(t).quarantine.select("position", "trial_id", F.array_join("reasons", "; ").alias("reasons"))


@query
def import_counts(t: GivenTables) -> DataFrame:
    return imported(t).counts


# --- import into a registry that holds data ---

EARLIER = dt.datetime(2001, 7, 1, 8)


def reimported(t: GivenTables, first_status: str) -> IngestResult:
    """The orders with status F or P imported first, then all orders into the registry that this left."""
    registry = new_registry(t.spark)
    for statuses, options in (
        (("F", "P"), IngestOptions("GIVEN", EARLIER, first_status)),
        (("F", "O", "P"), IngestOptions("GIVEN", BATCH)),
    ):
        result = ingest_trials(t.spark, documents(t, *statuses), registry, options)
        registry = result.registry
    return result


def merged(t: GivenTables, first_status: str) -> Registry:
    """The same two imports into a stored registry, of which the second writes what it touches."""
    store = create_store(t.spark, f"{staging_root(t.spark)}/store-{uuid.uuid4().hex}", buckets=16)
    for statuses, options in (
        (("F", "P"), IngestOptions("GIVEN", EARLIER, first_status)),
        (("F", "O", "P"), IngestOptions("GIVEN", BATCH)),
    ):
        store.merge(documents(t, *statuses), options)
    return store.registry()


STAMPS = ("created_at", "updated_at", "approved_at", "published_at")


def imported_trials(registry: Registry) -> DataFrame:
    trial = registry["trial"]
    return as_text(trial.select("trial_id", "status", "public_title", "date_registration", *STAMPS), "date_registration", *STAMPS)


def imported_children(registry: Registry) -> DataFrame:
    country = registry["trial_country"].select(F.lit("trial_country").alias("table_name"), "trial_id", F.col("country_code").alias("content"))
    outcome = registry["trial_outcome"].select(
        F.lit("trial_outcome").alias("table_name"), "trial_id", F.concat_ws("/", "outcome_type", "sort_order", "description").alias("content")
    )
    trial = registry["trial"].select(F.col("id").alias("trial_id"), F.col("trial_id").alias("registry_id"))
    return country.unionByName(outcome).join(trial, "trial_id").select("table_name", "registry_id", "content")


def imported_reviews(registry: Registry) -> DataFrame:
    trial = registry["trial"].select(F.col("id").alias("trial_id"), F.col("trial_id").alias("registry_id"))
    history = registry["trial_review"].join(trial, "trial_id")
    return as_text(history.groupBy("registry_id", "review_status", "created_at").agg(F.count(F.lit(1)).alias("n")), "created_at")


def imported_snapshots(registry: Registry) -> DataFrame:
    snapshots_ = registry["trial_public_snapshot"]
    return as_text(snapshots_.groupBy("public_trial_id", "generated_at", "is_current").agg(F.count(F.lit(1)).alias("n")), "generated_at")


@query
def reimport_trials(t: GivenTables) -> DataFrame:
    """Updated and new trials; the first approval and creation are kept."""
    return imported_trials(reimported(t, "approved").registry)


@query
def reimport_children(t: GivenTables) -> DataFrame:
    """Rows of child tables: replaced, not added to."""
    return imported_children(reimported(t, "approved").registry)


@query
def reimport_reviews(t: GivenTables) -> DataFrame:
    """The review history grows with every import of a trial."""
    return imported_reviews(reimported(t, "approved").registry)


@query
def reimport_snapshots(t: GivenTables) -> DataFrame:
    """Stored snapshots are superseded by later ones."""
    return imported_snapshots(reimported(t, "published").registry)


@query
def merge_trials(t: GivenTables) -> DataFrame:
    return imported_trials(merged(t, "approved"))


@query
def merge_children(t: GivenTables) -> DataFrame:
    return imported_children(merged(t, "approved"))


@query
def merge_reviews(t: GivenTables) -> DataFrame:
    return imported_reviews(merged(t, "approved"))


@query
def merge_snapshots(t: GivenTables) -> DataFrame:
    return imported_snapshots(merged(t, "published"))


# --- outputs ------------------------------------------------------------------------------------


@query
def delimited_report(t: GivenTables) -> DataFrame:
    return outputs.delimited_lines(reports.trials_by_recruitment_status(t.registry("status", "recruitment_status_id")))


def snapshot_table(t: GivenTables) -> DataFrame:
    return t.table("events").select(F.col("ts").cast("timestamp_ntz").alias("generated_at"), F.col("props").alias("document"))


@query
def snapshot_freshness(t: GivenTables) -> DataFrame:
    return as_text(snapshots.freshness(snapshot_table(t), dt.datetime(2024, 2, 1)), "generated_at")


@query
def snapshot_retention(t: GivenTables) -> DataFrame:
    return as_text(snapshots.newest(snapshot_table(t)), "generated_at")


INSIGHT = tuple(dict.fromkeys((*CONDITIONS, *insights.QUALITY_FIELDS)))


def insight_sections(t: GivenTables):
    """The sections over one staged copy of the derived trial table."""
    return insight_tables(new_registry(t.spark).replace({"trial": stage(t.trial(*INSIGHT), "trial")}), AS_OF)


@query
def insight_rows(t: GivenTables) -> DataFrame:
    return build_rows(insight_sections(t))


@query
def insight_document(t: GivenTables) -> DataFrame:
    return build_document(insight_sections(t), BATCH, "given", "public").select("part", "line")
