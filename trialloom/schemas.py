"""Declared schemas of the registry tables and of the input XML.

Surrogate ids are LongType: an integer id would run out long before the data
does. Nothing is ever inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

from . import constants as C

STR, LONG, INT, DATE, TS, BOOL = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.TimestampNTZType(), T.BooleanType(),
)


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TABLES: dict[str, T.StructType] = {
    "trial": schema(
        id=LONG, trial_id=STR, utrn=STR, reg_name=STR, status=STR,
        date_registration=DATE, date_enrolment=DATE, primary_sponsor=STR,
        public_title=STR, acronym=STR, scientific_title=STR, scientific_acronym=STR,
        type_enrolment_id=LONG, target_size=INT, recruitment_status_id=LONG,
        study_type_id=LONG, phase_id=LONG, hc_freetext=STR, i_freetext=STR, url=STR,
        created_at=TS, updated_at=TS, submitted_at=TS, approved_at=TS, published_at=TS,
        created_by_user_id=LONG, submitted_by_user_id=LONG, reviewed_by_user_id=LONG, reviewed_at=TS,
    ),
    "trial_study_design": schema(
        trial_id=LONG, expanded_access_id=LONG, study_focus_id=LONG, intervention_design_id=LONG,
        number_of_arms=INT, masking_type_id=LONG, allocation_type_id=LONG,
        generated_study_design=STR, updated_at=TS,
    ),
    "trial_contact": schema(
        id=LONG, trial_id=LONG, contact_type=STR, firstname=STR, middlename=STR, lastname=STR,
        address=STR, city=STR, country_code=STR, zip=STR, telephone=STR, email=STR,
        affiliation=STR, created_at=TS,
    ),
    "trial_country": schema(id=LONG, trial_id=LONG, country_code=STR),
    "trial_criteria": schema(
        trial_id=LONG, inclusion_criteria=STR, exclusion_criteria=STR,
        age_min_value=INT, age_min_unit=STR, age_max_value=INT, age_max_unit=STR,
        gender=STR, updated_at=TS,
    ),
    "trial_health_condition_code": schema(id=LONG, trial_id=LONG, code=STR),
    "trial_health_condition_keyword": schema(id=LONG, trial_id=LONG, keyword=STR),
    "trial_intervention_code": schema(id=LONG, trial_id=LONG, code=STR),
    "trial_intervention_keyword": schema(id=LONG, trial_id=LONG, keyword=STR),
    "trial_outcome": schema(
        id=LONG, trial_id=LONG, outcome_type=STR, description=STR, sort_order=INT, created_at=TS,
    ),
    "trial_sponsor": schema(
        id=LONG, trial_id=LONG, sponsor_type=STR, sponsor_name=STR, sort_order=INT, created_at=TS,
    ),
    "trial_secondary_id": schema(
        id=LONG, trial_id=LONG, sec_id=STR, issuing_authority=STR, created_at=TS,
    ),
    "trial_ethics_review": schema(
        id=LONG, trial_id=LONG, status=STR, approval_date=DATE, contact_name=STR,
        contact_address=STR, contact_phone=STR, contact_email=STR, created_at=TS,
    ),
    "trial_results": schema(
        trial_id=LONG, actual_enrolment=INT, date_completed=DATE, url_link=STR, summary=STR,
        date_posted=DATE, date_first_publication=DATE, baseline_char=STR, participant_flow=STR,
        adverse_events=STR, outcome_measures=STR, url_protocol=STR, ipd_plan=STR,
        ipd_description=STR, updated_at=TS,
    ),
    "trial_review": schema(
        id=LONG, trial_id=LONG, review_status=STR, reviewer_name=STR, reviewer_comment=STR,
        created_at=TS,
    ),
    "trial_public_snapshot": schema(
        id=LONG, trial_id=LONG, public_trial_id=STR, xml_content=STR, generated_at=TS,
        is_current=BOOL,
    ),
    "app_role": schema(id=LONG, role_code=STR, role_name=STR, description=STR, is_active=BOOL),
    "app_user": schema(
        id=LONG, username=STR, full_name=STR, email=STR, role_id=LONG, user_status=STR,
        requested_role=STR, request_reason=STR, approved_by=LONG, approved_at=TS,
        created_at=TS, updated_at=TS, last_login_at=TS,
    ),
    "app_user_request": schema(
        id=LONG, full_name=STR, email=STR, requested_username=STR, requested_role=STR,
        request_reason=STR, request_status=STR, reviewed_by=LONG, reviewed_at=TS,
        review_comment=STR, created_at=TS,
    ),
}

CHILD_TABLES = (
    "trial_study_design", "trial_contact", "trial_country", "trial_criteria",
    "trial_health_condition_code", "trial_health_condition_keyword",
    "trial_intervention_code", "trial_intervention_keyword",
    "trial_outcome", "trial_sponsor", "trial_secondary_id", "trial_ethics_review",
    "trial_results",
)

VOCAB_BY_ID = schema(id=LONG, code=STR, label=STR, xml_value=STR, sort_order=INT, is_active=BOOL)
VOCAB_BY_CODE = schema(code=STR, label=STR, xml_value=STR, sort_order=INT, is_active=BOOL)

ID_VOCABULARIES = {
    "type_enrolment": C.TYPE_ENROLMENT,
    "recruitment_status": C.RECRUITMENT_STATUS,
    "study_type": C.STUDY_TYPE,
    "phase": C.PHASE,
    "expanded_access": C.EXPANDED_ACCESS,
    "study_focus": C.STUDY_FOCUS,
    "intervention_design": C.INTERVENTION_DESIGN,
    "masking_type": C.MASKING_TYPE,
    "allocation_type": C.ALLOCATION_TYPE,
}
CODE_VOCABULARIES = {
    "trial_status": C.TRIAL_STATUS,
    "contact_type": C.CONTACT_TYPE,
    "gender": C.GENDER,
    "age_unit": C.AGE_UNIT,
    "ethics_status": C.ETHICS_STATUS,
    "ipd_plan": C.IPD_PLAN,
    "sponsor_type": C.SPONSOR_TYPE,
    "outcome_type": C.OUTCOME_TYPE,
}

# Longest code and label an id-keyed entry may have (fixed values).
VOCAB_LIMITS = {
    "type_enrolment": (50, 100),
    "recruitment_status": (80, 150),
    "study_type": (50, 100),
    "phase": (50, 100),
}

# --- input XML ---------------------------------------------------------------
MAIN_FIELDS = (
    "trial_id", "utrn", "reg_name", "date_registration", "primary_sponsor", "public_title",
    "acronym", "scientific_title", "scientific_acronym", "date_enrolment", "type_enrolment",
    "target_size", "recruitment_status", "url", "study_type", "study_design", "phase",
    "hc_freetext", "i_freetext", "results_actual_enrolment", "results_date_completed",
    "results_url_link", "results_summary", "results_date_posted",
    "results_date_first_publication", "results_baseline_char", "results_participant_flow",
    "results_adverse_events", "results_outcome_measures", "results_url_protocol",
    "results_IPD_plan", "results_IPD_description",
)
CONTACT_FIELDS = (
    "type", "firstname", "name", "middlename", "lastname", "address", "city", "country1", "zip",
    "telephone", "email", "affiliation",
)
CRITERIA_FIELDS = ("inclusion_criteria", "agemin", "agemax", "gender", "exclusion_criteria")
SECONDARY_ID_FIELDS = ("sec_id", "issuing_authority")
ETHICS_FIELDS = (
    "status", "approval_date", "contact_name", "contact_address", "contact_phone", "contact_email",
)
# Repeated text leaves: container element -> leaf element.
TEXT_LISTS = {
    "countries": "country2",
    "health_condition_code": "hc_code",
    "health_condition_keyword": "hc_keyword",
    "intervention_code": "i_code",
    "intervention_keyword": "i_keyword",
    "primary_outcome": "prim_outcome",
    "secondary_outcome": "sec_outcome",
    "secondary_sponsor": "sponsor_name",
    "source_support": "source_name",
}

CORRUPT = "_corrupt_record"


def trial_element_schema() -> T.StructType:
    """Schema of one ``trial`` element.

    Every leaf and every container is an array, because any of them may be
    repeated in a document; the readers then take the first or all of them.
    """
    texts = T.ArrayType(STR)

    def record(fields) -> T.ArrayType:
        return T.ArrayType(T.StructType([T.StructField(name, texts) for name in fields]))

    def group(name: str, inner: T.DataType) -> T.StructField:
        return T.StructField(name, T.ArrayType(T.StructType([T.StructField(*inner)])))

    fields = [
        T.StructField("main", record(MAIN_FIELDS)),
        group("contacts", ("contact", record(CONTACT_FIELDS))),
        T.StructField("criteria", record(CRITERIA_FIELDS)),
        group("secondary_ids", ("secondary_id", record(SECONDARY_ID_FIELDS))),
        group("ethics_reviews", ("ethics_review", record(ETHICS_FIELDS))),
    ]
    fields += [group(outer, (leaf, texts)) for outer, leaf in TEXT_LISTS.items()]
    fields.append(T.StructField(CORRUPT, STR))
    return T.StructType(fields)
