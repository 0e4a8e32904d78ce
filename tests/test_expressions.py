"""Input/output tables for the Column functions."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialloom.functions import conditions, dates, parsing, text
from trialloom.operators.access import role_allows
from trialloom.operators.rules import percentage


def apply(spark, expression, values, kind=pa.string()):
    table = pa.table({"n": list(range(len(values))), "v": pa.array(values, kind)})
    df = spark.createDataFrame(table).select("n", expression(F.col("v")).alias("out"))
    return [row.out for row in df.orderBy("n").collect()]


def check(spark, expression, cases, kind=pa.string()):
    assert apply(spark, expression, list(cases), kind) == list(cases.values())


def test_clean(spark):
    check(spark, text.clean, {
        "  a\t\tb\r\n\n\n\nc ": "a b\n\nc", " ": None, "": None, None: None, " x ": "x", "a\rb": "a\nb",
        "a\n \n \nb": "a\n \n \nb", "\x1fq": "q", "a \t b": "a b",
    })


def test_delimited_text(spark):
    check(spark, text.delimited_text, {None: "", "a|b\nc\rd ": "a b c d", "\tx": "\tx"})


def test_title_case(spark):
    check(spark, text.title_case, {
        "non-small cell": "Non-Small Cell", "3rd line/x": "3rd Line/X", "é a": "É A", "": "", None: None,
        "MIXED case": "Mixed Case",
    })


def test_parse_date(spark):
    day = dt.date(2026, 3, 5)
    check(spark, parsing.parse_date, {
        "5/3/2026": day, "05/03/2026": day, "2026-03-05": day, "05-03-2026": day, "2026/03/05": day,
        "31/02/2026": None, "05/03/26": None, "2026": None, None: None, "x": None, "29/02/2024": dt.date(2024, 2, 29),
    })


def test_parse_int(spark):
    check(spark, parsing.parse_int, {
        "30": 30, "about 30": 30, "1.200": 1, "-5": 5, "abc": None, "99999999999": None, None: None,
        "2147483647": 2147483647,
    })
    check(spark, parsing.int_overflows, {"30": False, "abc": False, "99999999999": True, None: False})


def test_normalize_code(spark):
    check(spark, parsing.normalize_code, {
        "Phase 1/Phase 2": "phase_1_phase_2", "--": "unknown", None: "unknown", "Não": "n_o", "_a__b_": "a_b",
        "x" * 90: "x" * 70,
    })


def test_parse_age(spark):
    check(spark, lambda c: F.concat_ws("/", parsing.parse_age(c)["value"], parsing.parse_age(c)["unit"]), {
        "0": "0", "18Y": "18/Y", "6 months": "6/M", "30Min": "30/MIN", "18.5Y": "18", "5Z": "5", "abc": "", None: "",
        "2 Weeks": "2/W", "4h": "4/H", "about 7 days": "7",
    })


def test_codes_of_fixed_lists(spark):
    check(spark, parsing.gender_code, {
        "-": "all", None: "all", "Masculino": "male", "F": "female", "male and female": "all", "?": "all",
    })
    check(spark, parsing.ipd_code, {
        "Yes": "yes", "sim": "yes", "Não": "no", "nao": "no", "Not sure": "undecided", "later": None, None: None,
    })
    check(spark, parsing.ethics_status_code, {
        "Approved": "approved", "Not approved": "approved", "aprovado": "approved", "Under review": "pending",
        "Not required": "not_required", "Rejected": "rejected", None: "unknown", "?": "unknown",
    })


@pytest.mark.parametrize("fixed, allocation", [(False, "randomized-controlled"), (True, "non-randomized")])
def test_study_design(spark, fixed, allocation):
    texts = ["n/a, randomized-controlled, single-blind", "Non-Randomized, open label , 2 arms,parallel", "expanded access", None,
             "not applicable", "unknown, triple blind, basic science, other"]
    df = spark.createDataFrame(pa.table({"n": list(range(6)), "t": texts}))
    rows = parsing.with_study_design(df, F.col("t"), fix_non_randomized=fixed).orderBy("n").collect()
    names = ("expanded_access", "allocation_type", "masking_type", "study_focus", "intervention_design", "arms")
    got = [tuple(r.design[n] for n in names) for r in rows]
    assert got == [
        ("n/a", "randomized-controlled", "single-blind", None, None, None),
        (None, allocation, "open label", None, "parallel", "2"),
        ("expanded access", None, None, None, None, None),
        (None,) * 6,
        ("n/a", "n/a", "n/a", None, None, None),
        ("unknown", None, "triple-blind", "basic science", None, None),
    ]


def test_months_and_age_rule(spark):
    def months(date, as_of):
        return apply(spark, lambda c: dates.months_since(c.cast("date"), as_of), [date])[0]

    assert months("2001-01-31", dt.date(2001, 2, 28)) == 0
    assert months("2000-02-29", dt.date(2001, 2, 28)) == 11
    assert months("2001-02-28", dt.date(2001, 2, 28)) == 0
    assert months("2000-02-28", dt.date(2001, 2, 28)) == 12
    leap = dt.date(2024, 2, 29)
    check(spark, lambda c: dates.older_than(c.cast("date"), leap), {
        "2023-02-28": True, "2023-03-01": False, None: False,
    })
    check(spark, lambda c: dates.in_same_period(c.cast("date"), leap, "month"), {
        "2024-02-01": True, "2024-03-01": False, "2024-01-31": False, None: False,
    })
    check(spark, lambda c: dates.in_same_period(c.cast("date"), leap, "year"), {"2024-12-31": True, "2025-01-01": False})


def test_percentage(spark):
    df = spark.createDataFrame(pa.table({"p": [1, 0, 2, 1], "t": [800, 0, 3, 3]}))
    assert [str(r[0]) for r in df.select(percentage(F.col("p"), F.col("t"))).collect()] == ["0.13", "0.00", "66.67", "33.33"]


def test_terms(spark):
    raw = "Obesity; obesity|OBESITY , COVID-19; Oral health;12.5;ab;n/a;:::; Dental  caries. ;dental caries;" + "x" * 81
    loose = apply(spark, conditions.loose_terms, [raw, "", None])
    assert sorted((t.term, t.is_first) for t in loose[0]) == [
        ("12.5", True), (":::", True), ("covid-19", True), ("dental caries", True), ("dental caries.", True),
        ("obesity", False), ("obesity", False), ("obesity", True), ("oral health", True), ("x" * 81, True),
    ]
    assert loose[1:] == [[], []]
    strict = apply(spark, conditions.strict_terms, [raw, "Array, other, and so on, 1-2 3, Orthopedics, with x"])
    assert strict[0] == ["obesity", "covid-19", "", "dental caries"]
    assert strict[1] == []
    bounded = apply(spark, lambda c: conditions.strict_terms(c, word_boundary=True), ["Oral health, or else, Androgen"])
    assert bounded == [["oral health", "androgen"]]


def test_role_allows(spark):
    check(spark, lambda c: role_allows(c, F.lit("reviewer ")), {"reviewer": True, "admin": True, "guest": False, None: False})
    check(spark, lambda c: role_allows(c, F.lit(" ")), {"guest": True, None: True})
