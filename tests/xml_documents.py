"""Synthetic registry documents of the shapes the import has to cope with."""

from __future__ import annotations

from xml.sax.saxutils import escape


def trial(trial_id="RBR-1", *, criteria="", extra="", **main):
    fields = {"trial_id": trial_id, **main}
    leaves = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in fields.items())
    return f"<trial>\n  <main>{leaves}</main>\n{criteria}{extra}</trial>"


def document(*trials):
    body = "\n".join(trials)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<root>\n<trials>\n{body}\n</trials>\n</root>\n'


FULL = trial(
    "RBR-full",
    utrn="U1111", date_registration="05/03/2020", primary_sponsor=" Fundação  X ", public_title="A | title",
    acronym=" ", scientific_title="Sci", date_enrolment="2020-01-31", type_enrolment="actual",
    target_size="about 30", recruitment_status="recruiting", url="http://x", study_type="Intervention",
    study_design="n/a, randomized-controlled, single-blind", phase="N/A", hc_freetext="Obesity; obesity",
    results_actual_enrolment="12", results_date_completed="31/02/2020", results_IPD_plan="Sim",
    criteria=(
        "<criteria><inclusion_criteria>in</inclusion_criteria><agemin>18Y</agemin><agemax>0</agemax>"
        "<gender>-</gender><exclusion_criteria/></criteria>"
    ),
    extra=(
        "<contacts><contact><type>Public</type><firstname>Ann</firstname><lastname>B</lastname><country1>BR</country1>"
        "<telephone>1</telephone></contact><contact><type>other</type><name>Org</name></contact></contacts>"
        "<countries><country2>Brazil</country2><country2>BR</country2><country2>Germany</country2><country2/></countries>"
        "<health_condition_code><hc_code>C1</hc_code><hc_code/><hc_code>C1</hc_code></health_condition_code>"
        "<health_condition_keyword><hc_keyword>k1</hc_keyword></health_condition_keyword>"
        "<intervention_code><i_code/></intervention_code>"
        "<intervention_keyword><i_keyword>drug</i_keyword></intervention_keyword>"
        "<primary_outcome><prim_outcome>p1</prim_outcome><prim_outcome> </prim_outcome><prim_outcome>p2</prim_outcome></primary_outcome>"
        "<secondary_outcome><sec_outcome>s1</sec_outcome></secondary_outcome>"
        "<secondary_sponsor><sponsor_name>S</sponsor_name></secondary_sponsor>"
        "<source_support><source_name>F1</source_name><source_name>F2</source_name></source_support>"
        "<secondary_ids><secondary_id><sec_id>X1</sec_id><issuing_authority>IA</issuing_authority></secondary_id>"
        "<secondary_id><issuing_authority>none</issuing_authority></secondary_id></secondary_ids>"
        "<ethics_reviews><ethics_review><status>Not approved</status><approval_date>01/02/2019</approval_date></ethics_review></ethics_reviews>"
    ),
)
