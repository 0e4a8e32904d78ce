"""Turning document text into typed values.

All functions expect text that went through ``text.clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .text import strip

# Accepted date layouts, tried in this order (fixed values).
DATE_LAYOUTS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
)


def parse_date(text: Column) -> Column:
    """First layout that fits; an impossible or partial date becomes NULL."""
    tries = [F.when(text.rlike(shape), F.try_to_date(text, layout)) for shape, layout in DATE_LAYOUTS]
    return F.coalesce(*tries)


def first_digits(text: Column) -> Column:
    return F.regexp_substr(text, F.lit("[0-9]+"))


def parse_int(text: Column) -> Column:
    """First run of digits as an int; signs and separators are not read."""
    return first_digits(text).try_cast("int")


def int_overflows(text: Column) -> Column:
    digits = first_digits(text)
    return digits.isNotNull() & digits.try_cast("int").isNull()


def normalize_code(text: Column) -> Column:
    """ASCII snake-case code, at most 70 characters, ``unknown`` when nothing is left."""
    code = F.regexp_replace(F.lower(F.coalesce(text, F.lit("unknown"))), "[^a-z0-9]+", "_")
    code = F.regexp_replace(code, "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(code, F.lit(C.CODE_LENGTH)), F.lit("")), F.lit("unknown"))


def _first_match(value: Column, choices: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(value.isin(*words), F.lit(code)) for code, words in choices.items()])


def parse_age(text: Column) -> Column:
    """``18Y``, ``6 months``, ``0`` ... as struct(value, unit); unknown units give NULL."""
    unit = F.upper(F.regexp_extract(text, r"^[0-9]+\s*([A-Za-z]+)$", 1))
    return F.struct(parse_int(text).alias("value"), _first_match(unit, C.AGE_UNIT_SPELLINGS).alias("unit"))


def gender_code(text: Column) -> Column:
    value = F.lower(text)
    return (
        F.when(value.isin(*C.GENDER_MALE), F.lit("male"))
        .when(value.isin(*C.GENDER_FEMALE), F.lit("female"))
        .otherwise(F.lit("all"))
    )


def ipd_code(text: Column) -> Column:
    return _first_match(F.lower(text), C.IPD_SPELLINGS)


def ethics_status_code(text: Column) -> Column:
    """Substring tests in a fixed order, so 'Not approved' counts as approved."""
    value = F.lower(F.coalesce(text, F.lit("unknown")))
    return (
        F.when(value.contains("approved") | (value == "aprovado"), F.lit("approved"))
        .when(value.contains("pending") | value.contains("under review"), F.lit("pending"))
        .when(value.contains("not required") | value.contains("not applicable"), F.lit("not_required"))
        .when(value.contains("reject"), F.lit("rejected"))
        .otherwise(F.lit("unknown"))
    )


def with_study_design(
    df: DataFrame, text: Column, name: str = "design", fix_non_randomized: bool = False
) -> DataFrame:
    """Add struct ``name`` with the design features found in a comma-separated text.

    ``randomized`` is looked for before ``non-randomized`` and is part of it, so
    non-randomized studies come out as randomized-controlled. That is how the
    registry data was made; ``fix_non_randomized`` tests the longer word first.
    """
    tokens, joined = f"__{name}_tokens", f"__{name}_joined"
    df = df.withColumn(
        tokens, F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), strip), lambda t: t != "")
    ).withColumn(joined, F.array_join(tokens, " | "))
    whole = F.col(joined)

    def says(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [whole.contains(w) for w in words])

    absent = F.array_contains(tokens, "n/a") | says("not applicable")
    non_randomized = says("non-randomized", "non randomized")
    randomized = says("randomized") & ~non_randomized if fix_non_randomized else says("randomized")
    first_word = lambda words: F.coalesce(*[F.when(says(w), F.lit(w)) for w in words])

    design = F.struct(
        F.when(says("expanded access"), F.lit("expanded access"))
        .when(absent, F.lit("n/a"))
        .when(says("unknown"), F.lit("unknown"))
        .alias("expanded_access"),
        F.when(randomized, F.lit("randomized-controlled"))
        .when(non_randomized, F.lit("non-randomized"))
        .when(absent, F.lit("n/a"))
        .alias("allocation_type"),
        F.when(says("quadruple-blind", "quadruple blind"), F.lit("quadruple-blind"))
        .when(says("triple-blind", "triple blind"), F.lit("triple-blind"))
        .when(says("double-blind", "double blind"), F.lit("double-blind"))
        .when(says("single-blind", "single blind"), F.lit("single-blind"))
        .when(says("open label", "open-label"), F.lit("open label"))
        .when(absent, F.lit("n/a"))
        .alias("masking_type"),
        first_word(C.STUDY_FOCUS_WORDS).alias("study_focus"),
        first_word(C.INTERVENTION_DESIGN_WORDS).alias("intervention_design"),
        F.nullif(F.regexp_extract(whole, r"([0-9]+)\s*arms?", 1), F.lit("")).alias("arms"),
    )
    return df.withColumn(name, design).drop(tokens, joined)
