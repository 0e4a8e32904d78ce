"""The queries of ``queries`` as plain SQL over the given tables, for checking.

Written independently of the DataFrame code: other formulas for months and
percentages, distinct counts where the operators use none.
"""

from __future__ import annotations

import json

from .. import constants as C
from ..schemas import CODE_VOCABULARIES, ID_VOCABULARIES

TODAY = "DATE '2001-08-02'"
# Unicode white space, as the registry's text clean-up understands it.
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def vocabulary(name: str) -> str:
    """CTE ``v_<name>`` with the seed entries."""
    if name in ID_VOCABULARIES:
        rows = [(i, *entry) for i, entry in enumerate(ID_VOCABULARIES[name], start=1)]
        columns = "id, code, label, xml_value, sort_order"
    else:
        rows, columns = CODE_VOCABULARIES[name], "code, label, xml_value, sort_order"
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return f"v_{name}({columns}) AS (VALUES {values})"


TRIAL = """
items AS (
  SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS first_ship, min(l_partkey) AS part_key,
         count(*) AS items, sum(CAST(l_quantity AS BIGINT)) AS quantity
  FROM lineitem GROUP BY l_orderkey),
named AS (
  SELECT l_orderkey AS named_order, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
trial AS (
  SELECT o_orderkey AS id, 'RBR-' || o_orderkey AS trial_id, 'U' || o_custkey AS utrn, 'GIVEN' AS reg_name,
    CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'approved' ELSE 'under_review' END AS status,
    CAST(o_orderdate AS DATE) AS date_registration, first_ship AS date_enrolment,
    CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_name END AS primary_sponsor,
    p_name || ' | ' || p_type || chr(10) || o_orderpriority AS public_title,
    'Study of ' || p_name AS scientific_title,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END AS type_enrolment_id,
    CAST(quantity AS INTEGER) AS target_size,
    CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '4-NOT SPECIFIED' THEN 9
      WHEN '5-LOW' THEN 5 END AS recruitment_status_id,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 1
      WHEN 'MACHINERY' THEN 2 END AS study_type_id,
    CASE r_name WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 9 WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 6 END AS phase_id,
    names || CASE WHEN items = 1 THEN '; ' || upper(p_name) ELSE '' END || ' | ' || p_brand || ', ' ||
      lower(p_type) || ' ;' || substr(o_orderpriority, 3) || ',' || p_size || '.50|' ||
      CASE WHEN c_acctbal < 0 THEN 'Oral  ' ELSE '' END || c_mktsegment || '.;' || r_name || '.' AS hc_freetext,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'https://example.org/trial/' || o_orderkey END AS url,
    items, quantity, p_name, p_type, p_size, o_orderstatus, o_orderpriority, c_mktsegment
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey LEFT JOIN named ON named_order = o_orderkey
  LEFT JOIN part ON p_partkey = part_key
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey),
public AS (SELECT * FROM trial WHERE status IN ('approved', 'published'))"""

# Completed months before today.
MONTHS = f"""((year({TODAY}) * 12 + month({TODAY})) - (year(date_enrolment) * 12 + month(date_enrolment))
  - CASE WHEN day({TODAY}) < day(date_enrolment) THEN 1 ELSE 0 END)"""
IS_OLD = f"date_enrolment <= CAST({TODAY} - INTERVAL 12 MONTH AS DATE)"
IS_RECENT = f"date_registration >= CAST({TODAY} - INTERVAL 12 MONTH AS DATE)"
FLAGGED = f"""
flagged AS (
  SELECT p.*, v.code, v.xml_value AS recruitment_status_label, {MONTHS} AS months_since_enrolment,
    coalesce(nullif(trim(primary_sponsor), ''), 'Unknown') AS sponsor
  FROM public p JOIN v_recruitment_status v ON v.id = p.recruitment_status_id
  WHERE v.code IN ('recruiting', 'not_yet_recruiting') AND {IS_OLD})"""


def half_up_percent(part: str, whole: str) -> str:
    """Integer rounding, halves up: DuckDB divides decimals as doubles."""
    return (
        f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE "
        f"(({part} * 20000 + {whole}) // (2 * {whole}))::DOUBLE / 100.0::DOUBLE END"
    )


def clean_line(column: str) -> str:
    return f"trim(translate(coalesce(CAST({column} AS VARCHAR), ''), '|' || chr(10) || chr(13), '   '))"


def clean(column: str) -> str:
    step = f"regexp_replace({column}, '\\r\\n?', chr(10), 'g')"
    step = f"regexp_replace({step}, '[ \\t]+', ' ', 'g')"
    step = f"regexp_replace({step}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"nullif(regexp_replace({step}, '^{SPACE}+|{SPACE}+$', '', 'g'), '')"


def code(column: str) -> str:
    step = f"regexp_replace(lower(coalesce({column}, 'unknown')), '[^a-z0-9]+', '_', 'g')"
    return f"coalesce(nullif(left(regexp_replace({step}, '^_+|_+$', '', 'g'), 70), ''), 'unknown')"


def title_case(column: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + " "


def distribution(name: str) -> str:
    return with_ctes(vocabulary(name), TRIAL) + f"""
      SELECT v.code AS {name}_code, v.xml_value AS {name}_label, count(p.id) AS total_trials,
        {half_up_percent('count(p.id)', '(SELECT count(*) FROM public)')} AS percentage
      FROM v_{name} v LEFT JOIN public p ON p.{name}_id = v.id GROUP BY v.code, v.xml_value"""


def profile(name: str) -> str:
    return with_ctes(vocabulary(name), TRIAL) + f"""
      SELECT coalesce(v.xml_value, 'Unknown') AS {name}, CAST(count(*) AS BIGINT) AS total_trials
      FROM public p LEFT JOIN v_{name} v ON v.id = p.{name}_id GROUP BY 1"""


def dashboard() -> str:
    month = f"date_trunc('month', {TODAY})"
    year = f"date_trunc('year', {TODAY})"
    counts = {
        ("total_trials", "Total trials"): "SELECT count(*) FROM trial",
        ("published_trials", "Published trials"): "SELECT count(*) FROM trial WHERE status = 'published'",
        ("approved_trials", "Approved trials"): "SELECT count(*) FROM trial WHERE status = 'approved'",
        ("public_trials", "Public trials"): "SELECT count(*) FROM public",
        ("recruiting_trials", "Recruiting trials"): "SELECT count(*) FROM public WHERE recruitment_status_id = 2",
        ("not_yet_recruiting_trials", "Not yet recruiting trials"):
            "SELECT count(*) FROM public WHERE recruitment_status_id = 1",
        ("possibly_outdated_recruitment_trials", "Possibly outdated recruitment trials"): "SELECT count(*) FROM flagged",
        ("pending_user_requests", "Pending user requests"): "SELECT count(*) FROM supplier WHERE s_acctbal >= 0",
        ("active_registrants", "Active registrants"):
            "SELECT count(*) FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD')",
        ("active_reviewers", "Active reviewers"):
            "SELECT count(*) FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'",
        ("registered_this_month", "Trials registered this month"):
            f"SELECT count(*) FROM trial WHERE date_registration >= {month} AND date_registration < {month} + INTERVAL 1 MONTH",
        ("registered_this_year", "Trials registered this year"):
            f"SELECT count(*) FROM trial WHERE date_registration >= {year} AND date_registration < {year} + INTERVAL 1 YEAR",
    }
    lines = [
        f"SELECT {_literal(metric)} AS metric_code, {_literal(label)} AS metric_label, CAST(({sql}) AS VARCHAR) AS metric_value"
        for (metric, label), sql in counts.items()
    ]
    return with_ctes(vocabulary("recruitment_status"), TRIAL, FLAGGED) + " UNION ALL ".join(lines)


DETAILS = f"""
design AS (
  SELECT o_orderkey AS trial_id,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS ea,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 9 END AS sf,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 4 END AS idg,
    CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 5 END AS mt,
    CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 END AS al,
    items - 1 AS arms
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
details AS (
  SELECT p.*, rs.xml_value AS recruitment_status, st.xml_value AS study_type, ph.xml_value AS phase
  FROM public p LEFT JOIN v_recruitment_status rs ON rs.id = p.recruitment_status_id
  LEFT JOIN v_study_type st ON st.id = p.study_type_id LEFT JOIN v_phase ph ON ph.id = p.phase_id)"""
VIEW_CTES = (vocabulary("recruitment_status"), vocabulary("study_type"), vocabulary("phase"), TRIAL, DETAILS)

CONTACT = """
contact AS (
  SELECT l_orderkey, 'Line' || l_linenumber || ' Part|' || l_partkey AS contact_name,
    CAST(l_suppkey AS VARCHAR) AS phone, 's' || l_suppkey || '@example.org' AS email
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
        FROM lineitem WHERE l_returnflag <> 'R') WHERE rn = 1)"""


def line(column: str, name: str | None = None) -> str:
    return f"{clean_line(column)} AS {name or column}"


STRICT_STOP = "('unspecified','not informed','not specified','unknown','n/a','na','none','array','other')"
LOOSE_STOP = "('unspecified','not informed','not specified','unknown','n/a','na','none')"
PIECES = f"""
pieces AS (
  SELECT id, date_registration, coalesce(nullif(trim(primary_sponsor), ''), 'Unknown') AS sponsor,
    coalesce(recruitment_status_id IN (1, 2) AND {IS_OLD}, false) AS outdated,
    trim(regexp_replace(unnest(string_split_regex(hc_freetext, '\\s*;\\s*|\\s*\\|\\s*|\\s*,\\s*')), '\\s+', ' ', 'g')) AS term
  FROM public WHERE coalesce(hc_freetext, '') <> '')"""
STRICT = f"""
cleaned AS (
  SELECT id, date_registration, sponsor, outdated,
    lower(trim(regexp_replace(term, '[.;:]+$', '', 'g'))) AS condition_key
  FROM pieces
  WHERE length(term) BETWEEN 3 AND 80 AND lower(term) NOT IN {STRICT_STOP}
    AND NOT regexp_matches(lower(term), '^[0-9.\\-\\s]+$')
    AND NOT regexp_matches(lower(term), '^(and|or|with|without|according|after|before|during|all data)')),
focus AS (
  SELECT condition_key, count(DISTINCT id) AS total_trials FROM cleaned GROUP BY 1 HAVING count(DISTINCT id) >= 20
  ORDER BY 2 DESC, 1 LIMIT 30),
focused AS (SELECT c.* FROM cleaned c JOIN focus USING (condition_key)),
pairs AS (
  SELECT sponsor, condition_key, {title_case('condition_key')} AS condition_name, count(DISTINCT id) AS total_trials,
    count(DISTINCT id) FILTER (WHERE outdated) AS possibly_outdated_trials,
    count(DISTINCT id) FILTER (WHERE {IS_RECENT}) AS last_12_months_trials
  FROM focused GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3)"""
SC = with_ctes(TRIAL, PIECES, STRICT)


def best(group: str, tie_break: str) -> str:
    return SC + f"""
      SELECT sponsor, condition_key, condition_name, total_trials, possibly_outdated_trials, CAST(rn AS INTEGER) AS rn
      FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY total_trials DESC, {tie_break}) AS rn FROM pairs)
      WHERE rn <= 5"""


def quality_missing() -> str:
    fields = ["public_title", "scientific_title", "primary_sponsor", "hc_freetext", "url"]
    blank = [f"SELECT '{f}' AS field_name, count(*) AS missing_count FROM public WHERE coalesce(trim({f}), '') = ''" for f in fields]
    fields = ["date_registration", "date_enrolment", "target_size", "study_type_id", "phase_id", "recruitment_status_id"]
    null = [f"SELECT '{f}' AS field_name, count(*) AS missing_count FROM public WHERE {f} IS NULL" for f in fields]
    return with_ctes(TRIAL) + " UNION ALL ".join(blank + null)


# Section of the insight dataset -> (statement, fields of an item in order). Fields marked
# with '%' are decimals with two digits.
SECTIONS = {
    "executive_dashboard": ("executive_dashboard", "total_trials public_trials published_trials approved_trials registered_this_year registered_this_month"),
    "recruitment_freshness.possibly_outdated_total": ("freshness_total", "possibly_outdated_total"),
    "recruitment_freshness.recruitment_status_distribution": ("freshness_status", "recruitment_status_label total"),
    "recruitment_freshness.risk_bands": ("freshness_bands", "risk_band total"),
    "recruitment_freshness.top_flagged_sponsors": ("freshness_sponsors", "sponsor possibly_outdated_trials"),
    "recruitment_freshness.oldest_examples": (
        "freshness_oldest", "id trial_id public_title primary_sponsor recruitment_status_label date_enrolment months_since_enrolment"),
    "top_sponsors": (
        "top_sponsors", "sponsor total_trials %percentage possibly_outdated_trials last_12_months_trials interventional_trials observational_trials"),
    "top_health_conditions": (
        "top_conditions", "condition_key condition_name total_trials possibly_outdated_trials last_12_months_trials"),
    "study_profile.study_type_distribution": ("profile_type", "study_type total_trials"),
    "study_profile.phase_distribution": ("profile_phase", "phase total_trials"),
    "temporal_trends.trials_by_year": ("trend_year", "year total_trials"),
    "temporal_trends.trials_last_24_months": ("trend_month", "month total_trials"),
    "data_quality_governance.missing_fields": ("quality_missing", "field_name missing_count"),
    "data_quality_governance.date_issues": (
        "quality_dates", "enrolment_before_registration future_registration_date future_enrolment_date"),
    "sponsor_health_condition_intelligence.top_conditions_used": ("sc_top_conditions", "condition_key condition_name total_trials"),
    "sponsor_health_condition_intelligence.top_sponsor_condition_combinations": (
        "sc_pairs", "sponsor condition_key condition_name total_trials possibly_outdated_trials last_12_months_trials"),
    "sponsor_health_condition_intelligence.sponsor_top_conditions": (
        "sc_by_sponsor", "sponsor condition_key condition_name total_trials possibly_outdated_trials rn"),
    "sponsor_health_condition_intelligence.condition_top_sponsors": (
        "sc_by_condition", "condition_key condition_name sponsor total_trials possibly_outdated_trials rn"),
    "sponsor_health_condition_intelligence.condition_concentration": (
        "sc_concentration", "condition_key condition_name total_trials unique_sponsors %avg_trials_per_sponsor"),
    "sponsor_health_condition_intelligence.sponsor_outdated_burden": (
        "sc_burden", "sponsor total_trials_in_top_conditions possibly_outdated_trials %possibly_outdated_percentage"),
}


def insight_items(sql: dict[str, str], sections: dict | None = None) -> str:
    """All sections as (section, item), the items as JSON text written field by field."""

    def field(name: str) -> str:
        if name.startswith("%"):
            return f"""'"{name[1:]}":' || printf('%.2f', {name[1:]})"""
        return f"""'"{name}":' || coalesce(CAST(to_json({name}) AS VARCHAR), 'null')"""

    parts = [
        f"SELECT '{section}' AS section, '{{' || " + " || ',' || ".join(map(field, fields.split())) + f" || '}}' AS item FROM ({sql[name]})"
        for section, (name, fields) in (sections or SECTIONS).items()
    ]
    return " UNION ALL ".join(parts)


# Order of a section's items in the document; sections without one hold a single value.
ORDERS = {
    "recruitment_freshness.recruitment_status_distribution": "total DESC, recruitment_status_label",
    "recruitment_freshness.risk_bands": "risk_band",
    "recruitment_freshness.top_flagged_sponsors": "possibly_outdated_trials DESC, sponsor",
    "recruitment_freshness.oldest_examples": "months_since_enrolment DESC, id",
    "top_sponsors": "total_trials DESC, sponsor",
    "top_health_conditions": "total_trials DESC, condition_key",
    "study_profile.study_type_distribution": "total_trials DESC, study_type",
    "study_profile.phase_distribution": "total_trials DESC, phase",
    "temporal_trends.trials_by_year": "year",
    "temporal_trends.trials_last_24_months": "month",
    "data_quality_governance.missing_fields": "missing_count DESC, field_name",
    "sponsor_health_condition_intelligence.top_conditions_used": "total_trials DESC, condition_key",
    "sponsor_health_condition_intelligence.top_sponsor_condition_combinations": "total_trials DESC, sponsor, condition_key",
    "sponsor_health_condition_intelligence.sponsor_top_conditions": "sponsor, rn",
    "sponsor_health_condition_intelligence.condition_top_sponsors": "condition_name, rn",
    "sponsor_health_condition_intelligence.condition_concentration": "total_trials DESC, condition_key",
    "sponsor_health_condition_intelligence.sponsor_outdated_burden": "possibly_outdated_percentage DESC, possibly_outdated_trials DESC, sponsor",
}


def insight_lines(sql: dict[str, str]) -> str:
    """The document's lines by part: the fixed texts stand at 0 and around the items at 2, 5, 8, ..."""
    quoted = lambda value: json.dumps(value, ensure_ascii=False)
    notes = {
        "recruitment_freshness": f'"definition":{quoted(C.FRESHNESS_DEFINITION)},',
        "sponsor_health_condition_intelligence": f'"description":{quoted(C.SPONSOR_CONDITION_DESCRIPTION)},"filtering_strategy":'
        + quoted({"source": "trial.hc_freetext", "minimum_total_trials_for_condition": 20, "maximum_number_of_conditions": 30,
                  "minimum_trials_for_sponsor_condition_pair": 3, "excluded_terms": list(C.SPONSOR_CONDITION_EXCLUDED)}) + ",",
    }
    metadata = {"generated_at": "2001-08-02T12:00:00", "database": "given", "schema": "public",
                "dataset_scope": C.DATASET_SCOPE, "ai_usage_note": C.DATASET_NOTE}
    fixed = {0: '{"metadata":' + quoted(metadata)}
    parts, names = [], list(SECTIONS)
    for i, path in enumerate(names):
        group, _, name = path.rpartition(".")
        is_first = group and not any(p.startswith(group + ".") for p in names[:i])
        is_last = group and not any(p.startswith(group + ".") for p in names[i + 1 :])
        array = path in ORDERS
        fixed[3 * i + 1] = "," + (f'"{group}":{{{notes.get(group, "")}' if is_first else "") + f'"{name}":' + ("[" if array else "")
        note = f',"interpretation_note":{quoted(C.QUALITY_NOTE)}' if group == "data_quality_governance" else ""
        fixed[3 * i + 3] = ("]" if array else "") + (note + "}" if is_last else "")
        one = {path: SECTIONS[path]}
        if array:
            numbered = f"SELECT *, row_number() OVER (ORDER BY {ORDERS[path]}) = 1 AS _first FROM ({sql[SECTIONS[path][0]]})"
            item = insight_items({SECTIONS[path][0]: numbered}, one).replace(" AS item FROM", " AS item, _first FROM")
            parts.append(f"SELECT {3 * i + 2} AS part, CASE WHEN _first THEN '' ELSE ',' END || item AS line FROM ({item})")
        elif " " in SECTIONS[path][1]:
            parts.append(f"SELECT {3 * i + 2} AS part, item AS line FROM ({insight_items(sql, one)})")
        else:
            parts.append(f"SELECT {3 * i + 2} AS part, CAST({SECTIONS[path][1]} AS VARCHAR) AS line FROM ({sql[SECTIONS[path][0]]})")
    fixed[3 * len(names) + 1] = "}"
    parts += [f"SELECT {part} AS part, {_literal(text)} AS line" for part, text in fixed.items() if text]
    return "SELECT CAST(part AS INTEGER) AS part, line FROM (" + " UNION ALL ".join(parts) + ")"


def oracle_sql() -> dict[str, str]:
    recruitment = vocabulary("recruitment_status")
    flagged = with_ctes(recruitment, TRIAL, FLAGGED)
    month_start = f"date_trunc('month', {TODAY})"
    sql = {
        "dashboard": dashboard(),
        "by_recruitment": distribution("recruitment_status"),
        "by_study_type": distribution("study_type"),
        "by_status": with_ctes(TRIAL) + f"""
          SELECT status AS status_code, count(*) AS total_trials,
            {half_up_percent('count(*)', '(SELECT count(*) FROM trial)')} AS percentage FROM trial GROUP BY status""",
        "outdated_list": flagged + f"""
          SELECT id, {line('trial_id')}, {line('status')}, {line('recruitment_status_label', 'recruitment_status')},
            CAST(date_registration AS VARCHAR) AS registration_date, CAST(date_enrolment AS VARCHAR) AS enrolment_date,
            CAST(months_since_enrolment AS INTEGER) AS months_since_enrolment, 'Possibly outdated' AS flag,
            {line('public_title')}, {line('primary_sponsor')}
          FROM flagged ORDER BY date_enrolment, id LIMIT 50 OFFSET 25""",
        "outdated_count": flagged + "SELECT count(*) AS total_trials FROM flagged",
        "public_trials": with_ctes(*VIEW_CTES) + """
          SELECT id, trial_id, status, CAST(date_registration AS VARCHAR) AS registration_date,
            CAST(date_enrolment AS VARCHAR) AS enrolment_date, public_title, scientific_title, recruitment_status,
            study_type, phase, CAST(target_size AS VARCHAR) AS target_size, primary_sponsor, url, utrn, CAST(NULL AS VARCHAR) AS study_design,
            hc_freetext AS health_conditions FROM details""",
        "public_list": with_ctes(*VIEW_CTES) + f"""
          SELECT id, {line('trial_id')}, {line('status')}, CAST(date_registration AS VARCHAR) AS registration_date,
            {line('public_title')}, {line('recruitment_status')}, {line('study_type')}
          FROM details ORDER BY id LIMIT 20 OFFSET 40""",
        "public_view": with_ctes(*VIEW_CTES, CONTACT) + f"""
          SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'RBR-' || id || ' ' ELSE CAST(id AS VARCHAR) END AS lookup_key,
            id, {line('trial_id')}, {line('utrn')}, {line('status')}, {line('url')},
            {line('contact_name', 'public_contact_name')}, {line('phone', 'public_contact_phone')},
            {line('email', 'public_contact_email')}, CAST(date_registration AS VARCHAR) AS registration_date,
            coalesce(CAST(date_enrolment AS VARCHAR), '') AS enrolment_date, {line('target_size')},
            {line('recruitment_status')}, {line('study_type')}, '' AS study_design, {line('phase')},
            {line('primary_sponsor')}, {line('public_title')}, {line('scientific_title')},
            {line('hc_freetext', 'health_conditions')}
          FROM details LEFT JOIN contact ON l_orderkey = id""",
        "trial_main": with_ctes(vocabulary("type_enrolment"), *VIEW_CTES[:3], TRIAL) + """
          SELECT t.id, trial_id, utrn, reg_name, status, CAST(date_registration AS VARCHAR) AS date_registration,
            primary_sponsor, public_title, CAST(NULL AS VARCHAR) AS acronym, scientific_title,
            CAST(NULL AS VARCHAR) AS scientific_acronym, CAST(date_enrolment AS VARCHAR) AS date_enrolment,
            te.xml_value AS type_enrolment, CAST(target_size AS VARCHAR) AS target_size, rs.xml_value AS recruitment_status, url,
            st.xml_value AS study_type, CAST(NULL AS VARCHAR) AS study_design, ph.xml_value AS phase, hc_freetext,
            CAST(NULL AS VARCHAR) AS i_freetext, CAST(quantity AS VARCHAR) AS results_actual_enrolment,
            CAST(date_enrolment AS VARCHAR) AS results_date_completed, CAST(NULL AS VARCHAR) AS results_url_link,
            CAST(NULL AS VARCHAR) AS results_summary, CAST(NULL AS VARCHAR) AS results_date_posted,
            CAST(NULL AS VARCHAR) AS results_date_first_publication, CAST(NULL AS VARCHAR) AS results_baseline_char,
            CAST(NULL AS VARCHAR) AS results_participant_flow, CAST(NULL AS VARCHAR) AS results_adverse_events,
            CAST(NULL AS VARCHAR) AS results_outcome_measures, CAST(NULL AS VARCHAR) AS results_url_protocol,
            CASE WHEN items > 4 THEN 'Yes' WHEN items > 2 THEN 'No' END AS results_ipd_plan,
            'Items: ' || items AS results_ipd_description
          FROM trial t LEFT JOIN v_type_enrolment te ON te.id = type_enrolment_id
          LEFT JOIN v_recruitment_status rs ON rs.id = recruitment_status_id
          LEFT JOIN v_study_type st ON st.id = study_type_id LEFT JOIN v_phase ph ON ph.id = phase_id""",
        "criteria_text": with_ctes(TRIAL) + """
          SELECT id AS trial_id, 'Uses ' || p_name AS inclusion_criteria, 'Not informed' AS exclusion_criteria,
            CAST(p_size AS VARCHAR) || CASE p_type WHEN 'ECONOMY' THEN 'Y' WHEN 'LARGE' THEN 'M' WHEN 'PROMO' THEN 'Min'
              ELSE '' END AS agemin,
            CASE WHEN items = 1 THEN '0' ELSE CAST(items - 1 AS VARCHAR) || CASE p_type WHEN 'SMALL' THEN 'W'
              WHEN 'PROMO' THEN 'H' WHEN 'LARGE' THEN 'D' ELSE '' END END AS agemax,
            CASE o_orderstatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'M' ELSE '-' END AS gender FROM trial""",
        "study_design": with_ctes(
            *[vocabulary(v) for v in ("expanded_access", "study_focus", "intervention_design", "masking_type", "allocation_type")],
            *VIEW_CTES,
        ) + """
          SELECT d.trial_id,
            concat_ws(', ', ea.xml_value, sf.xml_value, idg.xml_value, CASE WHEN arms > 0 THEN arms || ' arms' END,
              mt.xml_value, al.xml_value) AS full_design,
            concat_ws(', ', ea.xml_value, al.xml_value, mt.xml_value) AS compact_design
          FROM design d LEFT JOIN v_expanded_access ea ON ea.id = d.ea LEFT JOIN v_study_focus sf ON sf.id = d.sf
          LEFT JOIN v_intervention_design idg ON idg.id = d.idg LEFT JOIN v_masking_type mt ON mt.id = d.mt
          LEFT JOIN v_allocation_type al ON al.id = d.al""",
        "pending_requests": """
          SELECT s_suppkey AS request_id, s_name || ' x' AS full_name,
            CASE WHEN s_acctbal > 9000 THEN 'customer' || substr(lower(s_name), 9) ELSE lower(s_name) END AS requested_username,
            requested_username || '@example.org' AS email,
            CASE WHEN s_nationkey < 8 THEN 'registrant' WHEN s_nationkey < 16 THEN 'reviewer' ELSE 'auditor' END AS requested_role,
            'access' AS request_reason, CAST(DATE '2001-06-01' + s_nationkey AS VARCHAR)[:10] || ' 00:00:00' AS created_at
          FROM supplier WHERE s_acctbal >= 0""",
        "active_users": """
          SELECT c_custkey AS user_id, lower(c_name) AS username, c_name AS full_name, lower(c_name) || '@example.org' AS email,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'registrant' WHEN 'HOUSEHOLD' THEN 'registrant'
              WHEN 'BUILDING' THEN 'reviewer' WHEN 'FURNITURE' THEN 'admin' ELSE '' END AS role_code,
            'active' AS user_status, CAST(DATE '2001-01-01' + c_nationkey AS VARCHAR)[:10] || ' 00:00:00' AS created_at,
            '' AS last_login_at
          FROM customer WHERE c_acctbal >= 0""",
        "executive_dashboard": with_ctes(TRIAL) + f"""
          SELECT count(*) AS total_trials, count(*) FILTER (WHERE status IN ('approved', 'published')) AS public_trials,
            count(*) FILTER (WHERE status = 'published') AS published_trials,
            count(*) FILTER (WHERE status = 'approved') AS approved_trials,
            count(*) FILTER (WHERE year(date_registration) = year({TODAY})) AS registered_this_year,
            count(*) FILTER (WHERE strftime(date_registration, '%Y-%m') = strftime({TODAY}, '%Y-%m')) AS registered_this_month
          FROM trial""",
        "freshness_total": flagged + "SELECT count(*) AS possibly_outdated_total FROM flagged",
        "freshness_status": with_ctes(recruitment, TRIAL) + """
          SELECT v.xml_value AS recruitment_status_label, CAST(count(*) AS BIGINT) AS total
          FROM public p JOIN v_recruitment_status v ON v.id = p.recruitment_status_id GROUP BY 1""",
        "freshness_bands": flagged + """
          SELECT CASE WHEN months_since_enrolment BETWEEN 12 AND 23 THEN '12_23_months'
              WHEN months_since_enrolment BETWEEN 24 AND 35 THEN '24_35_months'
              WHEN months_since_enrolment >= 36 THEN '36_plus_months' ELSE 'other' END AS risk_band,
            count(*) AS total FROM flagged GROUP BY 1""",
        "freshness_sponsors": flagged + """
          SELECT sponsor, count(*) AS possibly_outdated_trials FROM flagged GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
        "freshness_oldest": flagged + """
          SELECT id, trial_id, left(coalesce(public_title, ''), 180) AS public_title,
            coalesce(primary_sponsor, 'Unknown') AS primary_sponsor, recruitment_status_label,
            CAST(date_enrolment AS VARCHAR) AS date_enrolment,
            CAST(months_since_enrolment AS INTEGER) AS months_since_enrolment
          FROM flagged ORDER BY months_since_enrolment DESC, id LIMIT 15""",
        "top_sponsors": with_ctes(TRIAL) + f"""
          SELECT coalesce(nullif(trim(primary_sponsor), ''), 'Unknown') AS sponsor, count(*) AS total_trials,
            {half_up_percent('count(*)', '(SELECT count(*) FROM public)')} AS percentage,
            count(*) FILTER (WHERE recruitment_status_id IN (1, 2) AND {IS_OLD}) AS possibly_outdated_trials,
            count(*) FILTER (WHERE {IS_RECENT}) AS last_12_months_trials,
            count(*) FILTER (WHERE study_type_id = 1) AS interventional_trials,
            count(*) FILTER (WHERE study_type_id = 2) AS observational_trials
          FROM public GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
        "top_conditions": with_ctes(TRIAL, PIECES) + f"""
          SELECT lower(term) AS condition_key, {title_case('lower(term)')} AS condition_name,
            count(DISTINCT id) AS total_trials, CAST(sum(outdated::INT) AS BIGINT) AS possibly_outdated_trials,
            count(DISTINCT id) FILTER (WHERE {IS_RECENT}) AS last_12_months_trials
          FROM pieces WHERE length(term) >= 3 AND lower(term) NOT IN {LOOSE_STOP}
          GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 30""",
        "profile_type": profile("study_type"),
        "profile_phase": profile("phase"),
        "trend_year": with_ctes(TRIAL) + """
          SELECT CAST(year(date_registration) AS INTEGER) AS year, count(*) AS total_trials FROM public
          WHERE date_registration IS NOT NULL GROUP BY 1""",
        "trend_month": with_ctes(TRIAL) + f"""
          SELECT strftime(date_registration, '%Y-%m') AS month, count(*) AS total_trials FROM public
          WHERE date_registration >= {month_start} - INTERVAL 23 MONTH GROUP BY 1""",
        "quality_missing": quality_missing(),
        "quality_dates": with_ctes(TRIAL) + f"""
          SELECT count(*) FILTER (WHERE date_enrolment < date_registration) AS enrolment_before_registration,
            count(*) FILTER (WHERE date_registration > {TODAY}) AS future_registration_date,
            count(*) FILTER (WHERE date_enrolment > {TODAY}) AS future_enrolment_date FROM public""",
        "sc_conditions": SC + "SELECT condition_key, CAST(count(DISTINCT id) AS BIGINT) AS total_trials FROM cleaned GROUP BY 1",
        "sc_top_conditions": SC + f"""
          SELECT condition_key, {title_case('condition_key')} AS condition_name, CAST(total_trials AS BIGINT) AS total_trials
          FROM focus""",
        "sc_pairs": SC + "SELECT * FROM pairs ORDER BY total_trials DESC, sponsor, condition_key LIMIT 50",
        "sc_by_sponsor": best("sponsor", "condition_name"),
        "sc_by_condition": best("condition_key", "sponsor"),
        "sc_concentration": SC + f"""
          SELECT condition_key, {title_case('condition_key')} AS condition_name, n AS total_trials, s AS unique_sponsors,
            ((n * 200 + s) // (2 * s))::DOUBLE / 100.0::DOUBLE AS avg_trials_per_sponsor
          FROM (SELECT condition_key, count(DISTINCT id) AS n, count(DISTINCT sponsor) AS s FROM focused GROUP BY 1)""",
        "sc_burden": SC + f"""
          SELECT sponsor, n AS total_trials_in_top_conditions, o AS possibly_outdated_trials,
            {half_up_percent('o', 'n')} AS possibly_outdated_percentage
          FROM (SELECT sponsor, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (WHERE outdated) AS o
                FROM focused GROUP BY 1 HAVING count(DISTINCT id) >= 10)
          ORDER BY 4 DESC, 3 DESC, 1 LIMIT 30""",
        "clean_documents": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
        "delimited_documents": f"SELECT doc_id, {clean_line('text')} AS line FROM documents",
        "codes": f"SELECT doc_id, {code(clean('text'))} AS code FROM documents",
        "title_case": f"""
          SELECT p_partkey, {title_case('spelling')} AS name
          FROM (SELECT p_partkey, lower(p_name || '-' || p_brand || '-' || p_type) AS spelling FROM part)""",
        "typed_dates": """
          SELECT o_orderkey, CASE
            WHEN o_orderpriority <> '4-NOT SPECIFIED' OR day(last_day(o_orderdate)) = 31
            THEN CAST(CAST(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN last_day(o_orderdate) ELSE o_orderdate END AS DATE) AS VARCHAR)
            END AS parsed FROM orders""",
        "typed_ages": """
          SELECT p_partkey, p_size AS value,
            CASE p_type WHEN 'ECONOMY' THEN 'Y' WHEN 'LARGE' THEN 'M' WHEN 'SMALL' THEN 'MIN' END AS unit FROM part""",
        "typed_designs": """
          SELECT o_orderkey,
            CASE o_orderstatus WHEN 'F' THEN 'expanded access' WHEN 'O' THEN 'n/a' ELSE 'unknown' END AS expanded_access,
            CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'randomized-controlled'
              WHEN o_orderstatus = 'O' THEN 'n/a' END AS allocation_type,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'double-blind' WHEN '2-HIGH' THEN 'open label'
              WHEN '3-MEDIUM' THEN 'single-blind' ELSE CASE WHEN o_orderstatus = 'O' THEN 'n/a' END END AS masking_type,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'treatment' WHEN '2-HIGH' THEN 'prevention'
              WHEN '3-MEDIUM' THEN 'screening' END AS study_focus,
            CASE WHEN o_orderpriority = '2-HIGH' THEN 'parallel'
              WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'crossover' END AS intervention_design,
            CAST(day(o_orderdate) AS INTEGER) AS arms FROM orders""",
    }
    sql["insight_rows"] = insight_items(sql)
    sql["insight_document"] = insight_lines(sql)
    sql |= later_oracles()
    # The stored registry must hold what the import into a registry in memory gives.
    sql |= {f"merge_{part}": sql[f"reimport_{part}"] for part in ("trials", "children", "reviews", "snapshots")}
    return sql


# --- vocabularies, access batches, import ---------------------------------------------

SPELLINGS = """
spellings AS (
  SELECT p_partkey + 1 AS position,
    CASE WHEN p_size < 10 THEN 'Phase 1' WHEN p_size < 20 THEN 'phase-1' WHEN p_size < 30 THEN p_brand
      WHEN p_size < 40 THEN lower(replace(p_brand, '#', '-')) ELSE 'n/a' END AS value,
    CASE WHEN p_size < 20 THEN 'phase_1' WHEN p_size < 40 THEN lower(replace(p_brand, '#', '_')) ELSE 'na' END AS code
  FROM part),
fresh AS (
  SELECT code, min(position) AS first_position FROM spellings
  WHERE code <> 'na' AND value <> 'Phase 1' GROUP BY code),
runs AS (
  SELECT s.code, value, position,
    lower(value) IS DISTINCT FROM lag(lower(value)) OVER (PARTITION BY s.code ORDER BY position) AS starts
  FROM spellings s JOIN fresh f ON f.code = s.code AND position >= first_position),
made AS (
  SELECT CASE WHEN r.code = 'phase_1' THEN 3 ELSE 9 + f.first_position END AS id, r.code, arg_max(value, position) AS label
  FROM runs r JOIN fresh f USING (code) WHERE starts GROUP BY r.code, f.first_position)"""

TRIAGE = """
asked AS (
  SELECT o_orderkey + 1 AS position, o_custkey, 'm' || (o_custkey // 2) || '@x.org' AS email_key, o_orderstatus,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Full name is required'
      WHEN o_orderstatus = 'P' THEN 'Requested role must be registrant or reviewer'
      WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
        THEN 'There is already an application user with this username or email'
      WHEN o_custkey // 2 IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)
        THEN 'There is already a pending request with this username or email' END AS refusal
  FROM orders),
judged AS (
  SELECT *, refusal IS NULL AND position = min(position) FILTER (WHERE refusal IS NULL) OVER (PARTITION BY email_key) AS won
  FROM asked),
answered AS (
  SELECT *, CASE WHEN won THEN position + (SELECT max(s_suppkey) FROM supplier) END AS request_id FROM judged)"""

DECISIONS = """
admins AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 16 AND s_acctbal >= 0),
decisions AS (
  SELECT o_orderkey + 1 AS position, o_custkey AS request_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 END AS admin,
    CASE o_orderstatus WHEN 'F' THEN 'no' ELSE '' END AS comment
  FROM orders),
checked AS (
  SELECT d.*, c_name, 'm' || (c_custkey // 2) || '@x.org' AS email, c_mktsegment,
    CASE WHEN admin IS NULL THEN 'Admin user ID is required'
      WHEN admin NOT IN (FROM admins) THEN 'Only active admin users can %s requests'
      WHEN c_acctbal < 0 THEN 'Pending request not found' END AS refusal
  FROM decisions d JOIN customer ON c_custkey = request_id)"""
APPROVALS = DECISIONS % "approve" + """,
checked2 AS (
  SELECT * REPLACE (coalesce(refusal, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Requested role is not valid or inactive'
      WHEN c_name IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier WHERE s_acctbal > 5000)
        THEN 'User with same username or email already exists' END) AS refusal) FROM checked),
judged AS (
  SELECT *, refusal IS NULL AND position = min(position) FILTER (WHERE refusal IS NULL) OVER (PARTITION BY email) AS won,
    position + (SELECT max(s_suppkey) FROM supplier) AS made_id
  FROM checked2)"""
REJECTIONS = DECISIONS % "reject" + """,
judged AS (
  SELECT *, refusal IS NULL AND position = min(position) FILTER (WHERE refusal IS NULL) OVER (PARTITION BY request_id) AS won
  FROM checked)"""

IMPORT = """
given AS (
  SELECT *, row_number() OVER (ORDER BY o_orderkey) AS position,
    CASE WHEN items IS NOT NULL THEN 'RBR-C' || o_custkey END AS trial_id,
    concat_ws('; ', CASE WHEN items IS NULL THEN 'no trial_id' END,
      CASE WHEN c_mktsegment = 'FURNITURE' AND o_orderstatus = 'P' THEN 'contacts.country1 longer than 2' END,
      CASE WHEN quantity > 250 THEN 'target_size out of range' END) AS reasons
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey LEFT JOIN named ON named_order = o_orderkey
  LEFT JOIN part ON p_partkey = part_key
  LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey),
good AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY position DESC) = 1 AS is_last,
    min(position) OVER (PARTITION BY trial_id) AS id FROM given WHERE reasons = ''),
final AS (SELECT * FROM good WHERE is_last)"""


def with_import() -> str:
    return with_ctes(TRIAL.strip().split("),\ntrial AS")[0] + ")", IMPORT)


def later_oracles() -> dict[str, str]:
    phase = vocabulary("phase")
    dist = distribution("recruitment_status")
    return {
        "vocab_resolve": with_ctes(SPELLINGS) + """
          SELECT position, CASE WHEN s.code = 'na' THEN 1 WHEN s.code = 'phase_1' THEN 3 ELSE 9 + first_position END AS id
          FROM spellings s LEFT JOIN fresh USING (code)""",
        "vocab_grown": with_ctes(phase, SPELLINGS) + """
          SELECT CAST(id AS BIGINT) AS id, code, label, xml_value, sort_order, true AS is_active FROM v_phase
          WHERE code NOT IN (SELECT code FROM made)
          UNION ALL SELECT m.id, m.code, m.label, m.label, coalesce(v.sort_order, 999), true
          FROM made m LEFT JOIN v_phase v USING (code)""",
        "vocab_seed": with_ctes(vocabulary("recruitment_status")) + f"""
          , present AS (
            SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'withdrawn' ELSE {code('o_orderpriority')} END AS code,
              max(o_orderpriority) AS label FROM orders GROUP BY 1)
          SELECT CAST(length(code) AS BIGINT) AS id, code, label, label AS xml_value, 1 AS sort_order, true AS is_active FROM present
          UNION ALL
          SELECT (SELECT max(length(code)) FROM present) + row_number() OVER (ORDER BY sort_order), code, label, xml_value,
            sort_order, true FROM v_recruitment_status WHERE code NOT IN (SELECT code FROM present)""",
        "triage": with_ctes(TRIAGE) + """
          SELECT position, won AS success, CAST(request_id AS VARCHAR) AS request_id,
            CASE WHEN won THEN 'Access request created successfully' ELSE coalesce(refusal,
              'There is already a pending request with this username or email') END AS message FROM answered""",
        "triage_requests": with_ctes(TRIAGE) + """
          SELECT s_suppkey AS id, 'S' AS full_name, 'm' || s_suppkey || '@X.org' AS email,
            'supplier' || s_suppkey AS requested_username, 'reviewer' AS requested_role, '' AS request_reason,
            CASE WHEN s_acctbal < 5000 THEN 'pending' ELSE 'rejected' END AS request_status, CAST(NULL AS VARCHAR) AS created_at
          FROM supplier
          UNION ALL SELECT request_id, 'Customer ' || o_custkey, 'M' || email_key[2:], 'u' || o_custkey,
            CASE o_orderstatus WHEN 'F' THEN 'registrant' ELSE 'reviewer' END, '', 'pending', '2001-08-02 12:00:00'
          FROM answered WHERE won""",
        "approvals": with_ctes(APPROVALS) + """
          SELECT position, won AS success, CASE WHEN won THEN CAST(made_id AS VARCHAR) END AS new_user_id,
            CASE WHEN won THEN 'User request approved successfully' WHEN refusal IS NOT NULL THEN refusal
              WHEN request_id IN (SELECT request_id FROM judged WHERE won) THEN 'Pending request not found'
              ELSE 'User with same username or email already exists' END AS message FROM judged""",
        "approved_users": with_ctes(APPROVALS) + """
          SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN replace(s_name, 'Supplier', 'CUSTOMER') ELSE s_name END AS username,
            s_name || '@y.org' AS email, CAST(CASE WHEN s_nationkey < 16 THEN 4 ELSE 2 END AS BIGINT) AS role_id,
            CASE WHEN s_acctbal < 0 THEN 'pending' ELSE 'active' END AS user_status, CAST(NULL AS VARCHAR) AS approved_by
          FROM supplier
          UNION ALL SELECT made_id, lower(c_name), email, CASE c_mktsegment WHEN 'BUILDING' THEN 3 ELSE 2 END, 'active', CAST(admin AS VARCHAR)
          FROM judged WHERE won""",
        "approved_requests": with_ctes(APPROVALS) + """
          SELECT c_custkey AS id, CASE WHEN won THEN 'approved' WHEN c_acctbal < 0 THEN 'approved' ELSE 'pending' END AS request_status,
            CAST(j.admin AS VARCHAR) AS reviewed_by, CASE WHEN won THEN 'Approved' END AS review_comment
          FROM customer LEFT JOIN (SELECT * FROM judged WHERE won) j ON j.request_id = c_custkey""",
        "rejections": with_ctes(REJECTIONS) + """
          SELECT position, won AS success, CASE WHEN won THEN 'User request rejected successfully'
            ELSE coalesce(refusal, 'Pending request not found') END AS message FROM judged""",
        "rejected_requests": with_ctes(REJECTIONS) + """
          SELECT c_custkey AS id, CASE WHEN won THEN 'rejected' WHEN c_acctbal < 0 THEN 'approved' ELSE 'pending' END AS request_status,
            CAST(j.admin AS VARCHAR) AS reviewed_by, j.comment AS review_comment
          FROM customer LEFT JOIN (SELECT * FROM judged WHERE won) j ON j.request_id = c_custkey""",
        "role_check": """
          SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'FURNITURE') AS may_review, true AS may_enter FROM customer""",
        "import_trials": with_import() + """
          SELECT id, trial_id, 'published' AS status, strftime(o_orderdate, '%Y-%m-%d') AS date_registration,
            CAST(first_ship AS VARCHAR) AS date_enrolment, c_name || ' & Co' AS primary_sponsor,
            'Order ' || o_orderkey AS public_title, 'Order ' || o_orderkey AS scientific_title,
            CAST(quantity AS INTEGER) AS target_size,
            CASE o_orderstatus WHEN 'O' THEN 'anticipated=Anticipated' ELSE 'actual=Actual' END AS type_enrolment,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'recruiting=Recruiting' WHEN '2-HIGH' THEN 'not_yet_recruiting=Not yet recruiting'
              WHEN '3-MEDIUM' THEN 'on_hold=On hold' ELSE 'unknown=Unknown' END AS recruitment_status,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'intervention=Intervention' WHEN 'MACHINERY' THEN 'expanded_access=Expanded access'
              ELSE 'observational=Observational' END AS study_type,
            CASE r_name WHEN 'AMERICA' THEN l WHEN 'ASIA' THEN l WHEN 'EUROPE' THEN 'phase_9=Phase 9' ELSE 'na=N/A' END AS phase,
            names AS hc_freetext
          FROM final, (SELECT 'phase_1=' || CASE arg_max(r_name, position) WHEN 'ASIA' THEN 'phase-1' ELSE 'Phase 1' END AS l
                       FROM good WHERE r_name IN ('AMERICA', 'ASIA'))""",
        "import_children": with_import() + """
          SELECT 'trial_study_design' AS table_name, CASE o_orderstatus WHEN 'F' THEN 'n/a, randomized, Double-Blind, 2 arms/2'
            WHEN 'O' THEN 'open label' ELSE 'unknown' END AS content, count(*) AS n FROM final GROUP BY 1, 2
          UNION ALL SELECT 'trial_contact', 'public', count(*) FROM final
          UNION ALL SELECT 'trial_country', unnest(list_distinct(['BR', r_name[:2]])) AS c, count(*) FROM final GROUP BY 1, 2
          UNION ALL SELECT 'trial_criteria', '18/Y/female/Not informed', count(*) FROM final WHERE o_orderstatus <> 'P'
          UNION ALL SELECT 'trial_health_condition_keyword', p_type, count(*) FROM final GROUP BY 1, 2
          UNION ALL SELECT 'trial_outcome', unnest(['primary/1', 'primary/2']) AS o, count(*) FROM final GROUP BY 1, 2
          UNION ALL SELECT 'trial_results', 'results', count(*) FROM final
          UNION ALL SELECT 'trial_review', 'published', count(*) FROM good
          UNION ALL SELECT 'trial_public_snapshot', CAST(is_last AS VARCHAR), count(*) FROM good GROUP BY 1, 2""",
        "import_quarantine": with_import() + """
          SELECT position, coalesce(trial_id, 'UNKNOWN_TRIAL_ID') AS trial_id, reasons FROM given WHERE reasons <> ''""",
        "import_counts": with_import() + """
          SELECT count(*) AS found, count(*) FILTER (WHERE reasons = '') AS imported,
            count(*) FILTER (WHERE reasons <> '') AS failed FROM given""",
        "reimport_trials": with_import() + """
          SELECT f.trial_id, 'published' AS status, 'Order ' || f.o_orderkey AS public_title,
            strftime(f.o_orderdate, '%Y-%m-%d') AS date_registration, first AS created_at, '2001-08-02 12:00:00' AS updated_at,
            first AS approved_at, '2001-08-02 12:00:00' AS published_at
          FROM (SELECT *, CASE WHEN trial_id IN (SELECT trial_id FROM good WHERE o_orderstatus <> 'O')
                  THEN '2001-07-01 08:00:00' ELSE '2001-08-02 12:00:00' END AS first FROM final) f""",
        "reimport_children": with_import() + """
          SELECT 'trial_country' AS table_name, trial_id AS registry_id, unnest(list_distinct(['BR', r_name[:2]])) AS content FROM final
          UNION ALL SELECT 'trial_outcome', trial_id, 'primary/1/' || p_name FROM final
          UNION ALL SELECT 'trial_outcome', trial_id, 'primary/2/' || p_brand FROM final""",
        "reimport_reviews": with_import() + """
          SELECT trial_id AS registry_id, 'published' AS review_status, '2001-08-02 12:00:00' AS created_at, count(*) AS n
          FROM good GROUP BY trial_id
          UNION ALL SELECT trial_id, 'approved', '2001-07-01 08:00:00', count(*) FROM good WHERE o_orderstatus <> 'O' GROUP BY trial_id""",
        "reimport_snapshots": with_import() + """
          SELECT trial_id AS public_trial_id, '2001-08-02 12:00:00' AS generated_at, is_last AS is_current, count(*) AS n
          FROM good GROUP BY trial_id, is_last
          UNION ALL SELECT trial_id, '2001-07-01 08:00:00', false, count(*) FROM good WHERE o_orderstatus <> 'O' GROUP BY trial_id""",
        "delimited_report": f"""
          SELECT concat_ws('|', recruitment_status_code, recruitment_status_label, total_trials, printf('%.2f', percentage)) AS line
          FROM ({dist})""",
        "snapshot_freshness": """
          SELECT true AS exists, age < 24 * 3600 AS valid, CAST(newest AS VARCHAR) AS generated_at, age AS age_seconds,
            round(age / 3600.0, 2)::DOUBLE AS age_hours, 24.0::DOUBLE AS max_age_hours
          FROM (SELECT max(ts) AS newest, greatest(0, datesub('second', max(ts), TIMESTAMP '2024-02-01')) AS age FROM events)""",
        "snapshot_retention": """
          SELECT CAST(ts AS VARCHAR) AS generated_at, props AS document FROM events
          WHERE ts IN (SELECT DISTINCT ts FROM events ORDER BY ts DESC LIMIT 5)""",
    }
