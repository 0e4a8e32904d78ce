"""Views, lookups, reports and insights on a small stored registry with hand-checked values."""

import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from trialloom import schemas as S
from trialloom.operators import insight_counts, insights, lookups, reports, sponsor_condition, views
from trialloom.plans import jobs
from trialloom.plans.insight_dataset import Section, insight_document, insight_rows, insight_tables
from trialloom.sinks import outputs, snapshots
from trialloom.sources.registry import new_registry, read_registry, small_table, write_registry
from trialloom.staging import stage

AS_OF = dt.date(2024, 2, 29)
D = dt.date


def trial(id, status="published", registered=None, enrolled=None, sponsor="S1", title="T", recruitment=2, kind=1, phase=1, text=None):
    values = dict(
        id=id, trial_id=f"RBR-{id}", reg_name="R", status=status, date_registration=registered, date_enrolment=enrolled,
        primary_sponsor=sponsor, public_title=title, scientific_title=title, recruitment_status_id=recruitment,
        study_type_id=kind, phase_id=phase, hc_freetext=text, target_size=id * 10,
    )
    return tuple(values.get(name) for name in S.TABLES["trial"].fieldNames())


TRIALS = [
    trial(1, "published", D(2024, 2, 1), D(2023, 2, 28), "S1", "Old|one\n", 2, 1, 1, "Flu; flu, Cold"),
    trial(2, "approved", D(2023, 3, 1), D(2023, 3, 1), " ", "Two", 1, 2, 9, "Cold."),
    trial(3, "draft", D(2024, 1, 5), D(2000, 1, 1), "S1", "Three", 2, 1, 3, "Flu"),
    trial(4, "published", D(2020, 5, 5), D(2021, 2, 28), "S2", None, 1, None, None, None),
    trial(5, "published", None, None, "S1", "Five", 5, 3, 6, " ; ,"),
    trial(6, "published", D(2024, 3, 1), D(2024, 3, 1), "S2", "Six", 2, 1, 1, "Flu"),
]


def row(table, **values):
    return tuple(values.get(name) for name in S.TABLES[table].fieldNames())


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    make = lambda name, rows: small_table(spark, S.TABLES[name], rows)
    contact = lambda i, t, kind, first: row("trial_contact", id=i, trial_id=t, contact_type=kind, firstname=first, lastname="Z", email="e|x")
    day = dt.datetime(2024, 1, 1, 10)
    user = lambda i, role, status: row("app_user", id=i, username=f"u{9 - i}", full_name="N", email="m", role_id=role, user_status=status, created_at=day)
    ask = lambda i, status: row("app_user_request", id=i, full_name="a|b", email="e", requested_username="u", requested_role="reviewer", request_status=status, created_at=day)
    tables = {
        "trial": make("trial", TRIALS),
        "trial_study_design": make("trial_study_design", [
            (1, 2, 1, 2, 3, 2, 1, "stored", None), (2, None, None, None, 0, None, 3, None, None)]),
        "trial_contact": make("trial_contact", [
            contact(1, 1, "scientific", "Sci"), contact(3, 1, "public", "Later"), contact(2, 1, "public", "First")]),
        "trial_criteria": make("trial_criteria", [
            (1, "i", "e", 18, "Y", 0, "Y", "all", None), (2, "i", "e", None, "Y", 30, "MIN", "male", None), (3, "i", "e", 0, None, None, None, "female", None)]),
        "trial_results": make("trial_results", [row("trial_results", trial_id=1, actual_enrolment=7, ipd_plan="undecided")]),
        "app_user": make("app_user", [user(1, 2, "active"), user(2, 3, "active"), user(3, 3, "pending"), user(4, None, "active")]),
        "app_user_request": make("app_user_request", [ask(2, "pending"), ask(1, "pending"), ask(3, "rejected")]),
    }
    path = str(tmp_path_factory.mktemp("reg") / "store")
    write_registry(new_registry(spark).replace(tables), path)
    return read_registry(spark, path)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_dashboard(registry):
    got = [(m, v) for m, _, v in rows(reports.registry_dashboard(registry, AS_OF))]
    assert got == [
        ("total_trials", "6"), ("published_trials", "4"), ("approved_trials", "1"), ("public_trials", "5"),
        ("recruiting_trials", "2"), ("not_yet_recruiting_trials", "2"), ("possibly_outdated_recruitment_trials", "2"),
        ("pending_user_requests", "2"), ("active_registrants", "1"), ("active_reviewers", "1"),
        ("registered_this_month", "1"), ("registered_this_year", "3"),
    ]


def test_distributions_keep_empty_entries(registry):
    got = {r[0]: (r[2], str(r[3])) for r in rows(reports.trials_by_recruitment_status(registry))}
    assert len(got) == 9 and got["recruiting"] == (2, "40.00") and got["suspended"] == (0, "0.00")
    got = [(r[0], r[2], str(r[3])) for r in rows(reports.trials_by_study_type(registry))]
    assert got == [("intervention", 2, "40.00"), ("observational", 1, "20.00"), ("expanded_access", 1, "20.00")]
    got = [(r[0], r[1], str(r[2])) for r in rows(reports.trials_by_status(registry))]
    assert got == [("published", 4, "66.67"), ("approved", 1, "16.67"), ("draft", 1, "16.67")]


def test_distributions_of_an_empty_registry(spark):
    got = rows(reports.trials_by_study_type(new_registry(spark)))
    assert [(r[2], str(r[3])) for r in got] == [(0, "0.00")] * 3


def test_outdated(registry):
    got = rows(reports.possibly_outdated_trials(registry, AS_OF))
    assert got == [
        (4, "RBR-4", "published", "Not yet recruiting", "2020-05-05", "2021-02-28", 36, "Possibly outdated", "", "S2"),
        (1, "RBR-1", "published", "Recruiting", "2024-02-01", "2023-02-28", 12, "Possibly outdated", "Old one", "S1"),
    ]
    assert rows(reports.possibly_outdated_trials(registry, AS_OF, 0, 1), "id") == [(1,)]
    assert rows(reports.possibly_outdated_trials(registry, AS_OF, after=(D(2021, 2, 28), 4)), "id") == [(1,)]
    assert rows(reports.possibly_outdated_trials(registry, AS_OF, after=(D(2023, 2, 28), 1)), "id") == []
    assert rows(reports.possibly_outdated_count(registry, AS_OF)) == [(2,)]


def test_lists_and_lookups(registry):
    assert rows(lookups.public_trial_list(registry, None, None), "id", "public_title") == [
        (1, "Old one"), (2, "Two"), (4, ""), (5, "Five"), (6, "Six")]
    assert rows(lookups.public_trial_list(registry, 2, 1), "id") == [(2,), (4,)]
    assert rows(lookups.public_trial_list(registry, 2, after_id=4), "id") == [(5,), (6,)]
    assert rows(lookups.public_trial_list(registry, -3, -1), "id") == [(1,)]
    one = lookups.public_trial(registry, "RBR-1").collect()
    assert [(r.id, r.public_contact_name, r.public_contact_email, r.study_design, r.target_size) for r in one] == [
        (1, "First Z", "e x", "stored", "10")]
    assert lookups.public_trial_by_registry_id(registry, " rbr-2 ").first().public_contact_name == ""
    assert lookups.public_trial(registry, "3").count() == 0
    keys = registry["trial"].sparkSession.createDataFrame([("RBR-1",), ("2",), ("3",), ("x",), ("2",)], "lookup_key string")
    assert sorted(rows(lookups.public_trial_lookup(registry, keys), "lookup_key", "id")) == [("2", 2), ("RBR-1", 1)]


def test_views(registry):
    design = {r.trial_id: (r.full_design, r.compact_design) for r in views.study_design_text(registry["trial_study_design"], registry).collect()}
    assert design == {
        1: ("n/a, treatment, parallel, 3 arms, single-blind, randomized-controlled", "n/a, randomized-controlled, single-blind"),
        2: ("n/a", "n/a"),
    }
    refreshed = views.refresh_study_design(registry["trial_study_design"], registry)
    assert sorted(rows(refreshed, "trial_id", "generated_study_design"))[1] == (2, "n/a")
    assert sorted(rows(views.criteria_text(registry), "trial_id", "agemin", "agemax", "gender")) == [
        (1, "18Y", "0", "-"), (2, None, "30Min", "M"), (3, "0", None, "F")]
    main = {r.id: r for r in views.trial_main(registry).collect()}
    assert (main[1].results_actual_enrolment, main[1].results_ipd_plan, main[1].phase, main[2].phase) == (7, "Undecided", "N/A", "N/A")
    assert len(main) == 6 and views.public_trials(registry).count() == 5
    assert rows(lookups.list_pending_user_requests(registry["app_user_request"]), "request_id", "full_name", "created_at") == [
        (1, "a b", "2024-01-01 10:00:00"), (2, "a b", "2024-01-01 10:00:00")]
    assert rows(lookups.list_active_users(registry["app_user"], registry["app_role"]), "user_id", "role_code", "last_login_at") == [
        (4, "", ""), (2, "reviewer", ""), (1, "registrant", "")]


def test_insight_rows_by_hand(registry):
    trial, recruitment = registry["trial"], registry.vocabulary("recruitment_status")
    assert rows(insights.risk_bands(trial, recruitment, AS_OF)) == [("12_23_months", 1), ("36_plus_months", 1)]
    assert rows(insights.oldest_examples(trial, recruitment, AS_OF), "id", "public_title", "months_since_enrolment") == [(4, "", 36), (1, "Old|one\n", 12)]
    assert rows(insights.recruitment_distribution(trial, recruitment)) == [
        ("Not yet recruiting", 2), ("Recruiting", 2), ("Recruitment completed", 1)]
    top = insights.top_sponsors(trial, recruitment, registry.vocabulary("study_type"), AS_OF)
    assert [(*r[:2], str(r[2]), *r[3:]) for r in rows(top)] == [
        ("S1", 2, "40.00", 1, 1, 1, 0), ("S2", 2, "40.00", 1, 1, 1, 0), ("Unknown", 1, "20.00", 0, 1, 0, 1)]
    # Trial 1 names flu twice: one trial, two outdated mentions.
    assert rows(insights.top_health_conditions(trial, recruitment, AS_OF)) == [
        ("flu", "Flu", 2, 2, 2), ("cold", "Cold", 1, 1, 1), ("cold.", "Cold.", 1, 0, 1)]
    assert rows(insights.profile(trial, "phase_id", registry.vocabulary("phase"), "phase")) == [
        ("N/A", 3), ("Phase 2/Phase 3", 1), ("Unknown", 1)]
    assert rows(insights.trials_by_year(trial)) == [(2020, 1), (2023, 1), (2024, 2)]
    assert rows(insights.trials_by_month(trial, AS_OF)) == [("2023-03", 1), ("2024-02", 1), ("2024-03", 1)]
    missing = dict(rows(insights.missing_fields(trial)))
    assert (missing["public_title"], missing["primary_sponsor"], missing["hc_freetext"], missing["url"], missing["target_size"]) == (1, 1, 1, 5, 0)
    assert rows(insights.date_issues(trial, AS_OF)) == [(1, 1, 1)]


def test_counts_of_one_pass_equal_each_section_alone(registry, tmp_path):
    """Every counted section, also of an empty table; none of them reads the trials again."""
    spark = registry["trial"].sparkSession
    names = ("recruitment_status", "study_type", "phase")
    recruitment, study_type, phase = (registry.vocabulary(n) for n in names)
    nulls = registry["trial"].limit(1).select(
        *[F.lit(c.name == "id" and 99 or None).cast(c.dataType).alias(c.name) if c.name != "status" else F.lit("published").alias("status")
          for c in registry["trial"].schema]
    )
    registry["trial"].unionByName(nulls).write.parquet(f"{tmp_path}/trial")
    stored = spark.read.parquet(f"{tmp_path}/trial")
    for trial in (stored, stored.limit(0)):
        counts = stage(insight_counts.count_groups(trial, recruitment, study_type, AS_OF), "counts")
        sections = [
            (insight_counts.executive_dashboard(counts), insights.executive_dashboard(trial, AS_OF)),
            (insight_counts.outdated_total(counts), insights.outdated_total(trial, recruitment, AS_OF)),
            (insight_counts.recruitment_distribution(counts, recruitment), insights.recruitment_distribution(trial, recruitment)),
            (insight_counts.risk_bands(counts), insights.risk_bands(trial, recruitment, AS_OF)),
            (insight_counts.flagged_sponsors(counts), insights.flagged_sponsors(trial, recruitment, AS_OF)),
            (insight_counts.top_sponsors(counts), insights.top_sponsors(trial, recruitment, study_type, AS_OF)),
            (insight_counts.profile(counts, "study_type_id", study_type, "study_type"), insights.profile(trial, "study_type_id", study_type, "study_type")),
            (insight_counts.profile(counts, "phase_id", phase, "phase"), insights.profile(trial, "phase_id", phase, "phase")),
            (insight_counts.trials_by_year(counts), insights.trials_by_year(trial)),
            (insight_counts.trials_by_month(counts, AS_OF), insights.trials_by_month(trial, AS_OF)),
            (insight_counts.missing_fields(counts), insights.missing_fields(trial)),
            (insight_counts.date_issues(counts), insights.date_issues(trial, AS_OF)),
        ]
        for one_pass, alone in sections:
            assert one_pass.columns == alone.columns and one_pass.dtypes == alone.dtypes
            assert rows(one_pass) == rows(alone)
            assert not any("/trial/" in f for f in one_pass.inputFiles())


def test_sponsor_condition_by_hand(registry):
    terms = sponsor_condition.trial_terms(registry["trial"], registry.vocabulary("recruitment_status"), AS_OF)
    pairs = sponsor_condition.pair_counts(terms)
    focus = sponsor_condition.focus_conditions(pairs, min_trials=1)
    assert rows(focus) == [("cold", "Cold", 2), ("flu", "Flu", 2)]
    focused = sponsor_condition.focused_pairs(pairs, focus)
    assert rows(sponsor_condition.top_pairs(focused, min_trials=1)) == [
        ("S1", "cold", "Cold", 1, 1, 1), ("S1", "flu", "Flu", 1, 1, 1), ("S2", "flu", "Flu", 1, 0, 1), ("Unknown", "cold", "Cold", 1, 0, 1)]
    assert sorted(rows(sponsor_condition.condition_top_sponsors(focused, 1, 1), "condition_key", "sponsor", "rn")) == [
        ("cold", "S1", 1), ("flu", "S1", 1)]
    assert sorted(rows(sponsor_condition.sponsor_top_conditions(focused, 1, 1), "sponsor", "condition_key")) == [
        ("S1", "cold"), ("S2", "flu"), ("Unknown", "cold")]
    assert [(r[0], r[2], r[3], str(r[4])) for r in rows(sponsor_condition.condition_concentration(focused))] == [
        ("cold", 2, 2, "1.00"), ("flu", 2, 2, "1.00")]
    burden = sponsor_condition.sponsor_outdated_burden(terms, focus, min_trials=1)
    assert [(*r[:3], str(r[3])) for r in rows(burden)] == [("S1", 1, 1, "100.00"), ("S2", 1, 0, "0.00"), ("Unknown", 1, 0, "0.00")]


def test_document_and_rows_hold_the_same_items(registry):
    tables = insight_tables(registry, AS_OF)
    document = json.loads("".join(r.line for r in insight_document(tables, dt.datetime(2024, 2, 29), "db", "sc").collect()))
    assert list(document) == [
        "metadata", "executive_dashboard", "recruitment_freshness", "top_sponsors", "top_health_conditions",
        "study_profile", "temporal_trends", "data_quality_governance", "sponsor_health_condition_intelligence",
    ]
    assert document["recruitment_freshness"]["possibly_outdated_total"] == 2
    assert [s["sponsor"] for s in document["top_sponsors"]] == ["S1", "S2", "Unknown"]
    assert document["study_profile"]["study_type_distribution"][0] == {"study_type": "Intervention", "total_trials": 2}
    assert document["sponsor_health_condition_intelligence"]["top_conditions_used"] == []
    assert "example" not in json.dumps(document["metadata"]) or document["metadata"]["database"] == "db"
    items = {}
    for section, item in rows(insight_rows(tables)):
        items.setdefault(section, []).append(json.loads(item))
    assert items["top_sponsors"] == document["top_sponsors"]
    assert items["data_quality_governance.date_issues"] == [document["data_quality_governance"]["date_issues"]]
    text = json.dumps(document)
    assert "First Z" not in text and "e|x" not in text


def test_document_has_no_largest_size(registry, tmp_path):
    tables = dict(insight_tables(registry, AS_OF))
    spark = registry["trial"].sparkSession
    path = "sponsor_health_condition_intelligence.sponsor_top_conditions"
    tables[path] = Section(spark.range(250_000).repartition(7).withColumn("rn", F.lit(1)), ("id",))
    out = str(tmp_path / "lines")
    insight_document(tables, dt.datetime(2024, 2, 29), "db", "sc").select("line").write.text(out)
    files = sorted(glob.glob(out + "/part-*"))
    document = json.loads("".join(open(f, encoding="utf-8").read() for f in files))
    found = document["sponsor_health_condition_intelligence"]["sponsor_top_conditions"]
    assert [x["id"] for x in found] == list(range(250_000)) and len(files) > 1


def test_registry_ids_that_differ_in_case_alone(registry, spark):
    trial = registry["trial"]
    again = trial.filter("id = 1").withColumns({"id": F.lit(99).cast("long"), "trial_id": F.lit("rbr-1")})
    both = registry.replace({"trial": trial.unionByName(again)})
    keys = spark.createDataFrame([("RBR-1",)], "lookup_key string")
    assert rows(lookups.public_trial_lookup(both, keys), "id") == [(1,)]
    assert rows(lookups.public_trial_by_registry_id(both, "RBR-1"), "id") == [(1,)]


def test_delimited_output(registry, tmp_path):
    path = str(tmp_path / "out")
    outputs.write_delimited(lookups.public_trial_list(registry), path)
    lines = [r.value for r in registry["trial"].sparkSession.read.text(path).collect()]
    assert lines[0] == "1|RBR-1|published|2024-02-01|Old one|Recruiting|Intervention" and lines[2] == "4|RBR-4|published|2020-05-05||Not yet recruiting|"


def test_snapshots(spark, registry, tmp_path):
    path = str(tmp_path / "snapshots")
    first = dt.datetime(2024, 2, 29, 12)
    assert rows(snapshots.freshness(jobs.stored_snapshots(spark, path), first), "exists", "valid", "age_seconds") == [(False, False, None)]
    assert jobs.run_insight(spark, registry, path, first)
    later = first + dt.timedelta(hours=23, minutes=59)
    assert not jobs.run_insight(spark, registry, path, later)
    assert rows(snapshots.freshness(jobs.stored_snapshots(spark, path), later), "valid", "age_seconds", "age_hours") == [(True, 86340, 23.98)]
    assert jobs.run_insight(spark, registry, path, first + dt.timedelta(hours=24))
    assert jobs.run_insight(spark, registry, path, later, force=True)
    stored = jobs.stored_snapshots(spark, path)
    assert stored.select("generated_at").distinct().count() == 3
    for keep in (1, 0):
        assert set(rows(snapshots.newest(stored, keep), "generated_at")) == {(first + dt.timedelta(hours=24),)}
    for day in range(2, 6):
        assert jobs.run_insight(spark, registry, path, first + dt.timedelta(days=day))
    times = jobs.stored_snapshots(spark, path).select("generated_at").distinct().count()
    assert times == 5


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_stored_registry_plans(registry):
    """Status prunes partitions, dates reach the scan, only needed columns are read."""
    counted = plan(reports.possibly_outdated_count(registry, AS_OF))
    assert "PartitionFilters: [status" in counted
    assert "ReadSchema: struct<date_enrolment:date,recruitment_status_id:bigint>" in counted
    assert "BroadcastNestedLoopJoin" not in counted and "CartesianProduct" not in counted
    one = plan(lookups.public_trial_by_id(registry, 1))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in one and "EqualTo(trial_id,1)" in one
    assert "ReadSchema: struct<>" in plan(reports.trials_by_status(registry))
