"""Fixed values of the registry domain.

Everything in this file is a fixed value: results are only right when these
words, limits and messages are exactly these.
"""

# --- workflow -------------------------------------------------------------
TRIAL_STATUSES = (
    "draft", "submitted", "under_review", "returned", "approved", "rejected", "published",
)
PUBLIC_STATUSES = ("approved", "published")
ACTIVE_RECRUITMENT_CODES = ("recruiting", "not_yet_recruiting")
OUTDATED_AFTER_MONTHS = 12
OUTDATED_FLAG = "Possibly outdated"
REGISTRY_ID_PREFIX = "RBR-"

# --- vocabularies: code, label, xml value, sort order ----------------------
# The position in the list, from 1, is the id of an id-keyed entry.
TYPE_ENROLMENT = (
    ("anticipated", "Anticipated", "anticipated", 10),
    ("actual", "Actual", "actual", 20),
)
RECRUITMENT_STATUS = (
    ("not_yet_recruiting", "Not yet recruiting", "Not yet recruiting", 10),
    ("recruiting", "Recruiting", "Recruiting", 20),
    ("enrolling_by_invitation", "Enrolling by invitation", "Enrolling by invitation", 30),
    ("active_not_recruiting", "Active, not recruiting", "Active, not recruiting", 40),
    ("recruitment_completed", "Recruitment completed", "Recruitment completed", 50),
    ("suspended", "Suspended", "Suspended", 60),
    ("terminated", "Terminated", "Terminated", 70),
    ("withdrawn", "Withdrawn", "Withdrawn", 80),
    ("unknown", "Unknown", "Unknown", 90),
)
STUDY_TYPE = (
    ("intervention", "Intervention", "Intervention", 10),
    ("observational", "Observational", "Observational", 20),
    ("expanded_access", "Expanded access", "Expanded access", 30),
)
PHASE = (
    ("na", "N/A", "N/A", 10),
    ("phase_0", "Phase 0", "Phase 0", 20),
    ("phase_1", "Phase 1", "Phase 1", 30),
    ("phase_1_2", "Phase 1/Phase 2", "Phase 1/Phase 2", 40),
    ("phase_2", "Phase 2", "Phase 2", 50),
    ("phase_2_3", "Phase 2/Phase 3", "Phase 2/Phase 3", 60),
    ("phase_3", "Phase 3", "Phase 3", 70),
    ("phase_4", "Phase 4", "Phase 4", 80),
    ("not_applicable", "Not applicable", "N/A", 90),
)
EXPANDED_ACCESS = (
    ("yes", "Yes", "expanded access", 10),
    ("no", "No", "n/a", 20),
    ("unknown", "Unknown", "unknown", 30),
)
STUDY_FOCUS = (
    ("treatment", "Treatment", "treatment", 10),
    ("prevention", "Prevention", "prevention", 20),
    ("diagnostic", "Diagnostic", "diagnostic", 30),
    ("screening", "Screening", "screening", 40),
    ("supportive_care", "Supportive care", "supportive care", 50),
    ("health_services_research", "Health services research", "health services research", 60),
    ("basic_science", "Basic science", "basic science", 70),
    ("other", "Other", "other", 80),
    ("not_applicable", "Not applicable", "n/a", 90),
)
INTERVENTION_DESIGN = (
    ("single_group", "Single group", "single group", 10),
    ("parallel", "Parallel", "parallel", 20),
    ("crossover", "Crossover", "crossover", 30),
    ("factorial", "Factorial", "factorial", 40),
    ("sequential", "Sequential", "sequential", 50),
    ("not_applicable", "Not applicable", "n/a", 60),
)
MASKING_TYPE = (
    ("open_label", "Open label", "open label", 10),
    ("single_blind", "Single blind", "single-blind", 20),
    ("double_blind", "Double blind", "double-blind", 30),
    ("triple_blind", "Triple blind", "triple-blind", 40),
    ("quadruple_blind", "Quadruple blind", "quadruple-blind", 50),
    ("not_applicable", "Not applicable", "n/a", 60),
)
ALLOCATION_TYPE = (
    ("randomized", "Randomized", "randomized-controlled", 10),
    ("non_randomized", "Non-randomized", "non-randomized", 20),
    ("not_applicable", "Not applicable", "n/a", 30),
)

# --- code-keyed vocabularies: code, label, xml value, sort order -----------
# trial_status and contact_type have no xml value of their own.
TRIAL_STATUS = (
    ("draft", "Draft", None, 10),
    ("submitted", "Submitted", None, 20),
    ("under_review", "Under review", None, 30),
    ("returned", "Returned to registrant", None, 40),
    ("approved", "Approved", None, 50),
    ("rejected", "Rejected", None, 60),
    ("published", "Published", None, 70),
)
CONTACT_TYPE = (
    ("public", "Public contact", None, 10),
    ("scientific", "Scientific contact", None, 20),
)
GENDER = (
    ("all", "All", "-", 10),
    ("male", "Male", "M", 20),
    ("female", "Female", "F", 30),
)
AGE_UNIT = (
    ("Y", "Years", "Y", 10),
    ("M", "Months", "M", 20),
    ("W", "Weeks", "W", 30),
    ("D", "Days", "D", 40),
    ("H", "Hours", "H", 50),
    ("MIN", "Minutes", "Min", 60),
)
ETHICS_STATUS = (
    ("approved", "Approved", "Approved", 10),
    ("pending", "Pending", "Pending", 20),
    ("not_required", "Not required", "Not required", 30),
    ("rejected", "Rejected", "Rejected", 40),
    ("unknown", "Unknown", "Unknown", 50),
)
IPD_PLAN = (
    ("yes", "Yes", "Yes", 10),
    ("no", "No", "No", 20),
    ("undecided", "Undecided", "Undecided", 30),
)
SPONSOR_TYPE = (
    ("secondary_sponsor", "Secondary sponsor", "secondary_sponsor", 10),
    ("source_support", "Source of monetary or material support", "source_support", 20),
)
OUTCOME_TYPE = (
    ("primary", "Primary outcome", "primary_outcome", 10),
    ("secondary", "Secondary outcome", "secondary_outcome", 20),
)
CREATED_ENTRY_SORT_ORDER = 999

# --- access ----------------------------------------------------------------
ROLES = (
    ("guest", "Guest", "Public user without login"),
    ("registrant", "Registrant", "User allowed to register and submit trials"),
    ("reviewer", "Reviewer", "User allowed to review and approve trials"),
    ("admin", "Administrator", "User allowed to manage users and permissions"),
)
REQUESTABLE_ROLES = ("registrant", "reviewer")
ADMIN_ROLE = "admin"

MSG_NAME_REQUIRED = "Full name is required"
MSG_EMAIL_REQUIRED = "Email is required"
MSG_USERNAME_REQUIRED = "Requested username is required"
MSG_ROLE_INVALID = "Requested role must be registrant or reviewer"
MSG_USER_EXISTS = "There is already an application user with this username or email"
MSG_REQUEST_EXISTS = "There is already a pending request with this username or email"
MSG_REQUEST_CREATED = "Access request created successfully"
MSG_REQUEST_ID_REQUIRED = "Request ID is required"
MSG_ADMIN_ID_REQUIRED = "Admin user ID is required"
MSG_ONLY_ADMIN_APPROVES = "Only active admin users can approve requests"
MSG_ONLY_ADMIN_REJECTS = "Only active admin users can reject requests"
MSG_NOT_PENDING = "Pending request not found"
MSG_ROLE_INACTIVE = "Requested role is not valid or inactive"
MSG_SAME_USER = "User with same username or email already exists"
MSG_APPROVED = "User request approved successfully"
MSG_REJECTED = "User request rejected successfully"

# --- ingest ----------------------------------------------------------------
DEFAULT_SPONSOR = "Unknown"
DEFAULT_TITLE = "Untitled trial"
DEFAULT_RECRUITMENT = "Unknown"
DEFAULT_STUDY_TYPE = "Observational"
DEFAULT_PHASE = "N/A"
DEFAULT_VOCAB_VALUE = "unknown"
DEFAULT_CRITERIA = "Not informed"
DEFAULT_FIRSTNAME = "Unknown"
REVIEWER_NAME = "XML importer"
REVIEWER_COMMENT = "Imported from ICTRP XML"
FAILED_TRIAL_ID = "UNKNOWN_TRIAL_ID"
CODE_LENGTH = 70

AGE_UNIT_SPELLINGS = {
    "Y": ("Y", "YEAR", "YEARS"),
    "M": ("M", "MONTH", "MONTHS"),
    "W": ("W", "WEEK", "WEEKS"),
    "D": ("D", "DAY", "DAYS"),
    "H": ("H", "HOUR", "HOURS"),
    "MIN": ("MIN", "MINS", "MINUTE", "MINUTES"),
}
GENDER_MALE = ("m", "male", "masculino")
GENDER_FEMALE = ("f", "female", "feminino")
IPD_SPELLINGS = {
    "yes": ("yes", "y", "sim"),
    "no": ("no", "n", "nao", "não"),
    "undecided": ("undecided", "unknown", "not sure"),
}
STUDY_FOCUS_WORDS = (
    "treatment", "prevention", "diagnostic", "screening", "supportive care",
    "health services research", "basic science", "other",
)
INTERVENTION_DESIGN_WORDS = ("single group", "parallel", "crossover", "factorial", "sequential")

# --- condition mining --------------------------------------------------------
CONDITION_STOP_TERMS = (
    "unspecified", "not informed", "not specified", "unknown", "n/a", "na", "none",
)
STRICT_CONDITION_STOP_TERMS = CONDITION_STOP_TERMS + ("array", "other")
LEADING_CONNECTIVES = (
    "and", "or", "with", "without", "according", "after", "before", "during", "all data",
)
MIN_CONDITION_LENGTH = 3
MAX_STRICT_CONDITION_LENGTH = 80

# --- insight limits ----------------------------------------------------------
TOP_SPONSORS = 30
TOP_CONDITIONS = 30
TOP_PAIRS = 50
TOP_FLAGGED_SPONSORS = 20
OLDEST_EXAMPLES = 15
EXAMPLE_TITLE_LENGTH = 180
MIN_TRIALS_PER_CONDITION = 20
MIN_TRIALS_PER_PAIR = 3
MIN_TRIALS_FOR_BURDEN = 10
TOP_PER_GROUP = 5
TREND_MONTHS = 24

# --- insight texts -----------------------------------------------------------
FRESHNESS_DEFINITION = (
    "Trials are flagged as possibly outdated when recruitment status is Recruiting or "
    "Not yet recruiting and date_enrolment is older than 12 months."
)
QUALITY_NOTE = (
    "Missing fields and date issues are calculated locally. AI should interpret these as data "
    "governance and data quality indicators, not as clinical conclusions."
)
SPONSOR_CONDITION_DESCRIPTION = (
    "Sponsor by health condition dataset focused on the top health conditions only. This reduces "
    "free-text noise and supports strategic analysis of sponsor footprint, therapeutic "
    "concentration and data freshness risks."
)
SPONSOR_CONDITION_EXCLUDED = (
    "unspecified", "not informed", "not specified", "unknown", "n/a", "array", "other",
    "numeric-only fragments", "long free-text fragments",
)
DATASET_SCOPE = "public clinical trials registry data"
DATASET_NOTE = (
    "This dataset contains aggregated indicators, rankings and selected non-sensitive examples. "
    "It should be interpreted by AI without inventing additional numbers."
)
SNAPSHOT_MAX_AGE_HOURS = 24
SNAPSHOT_KEEP = 5
