"""Reading health-condition terms out of a free-text column.

The terms of one trial are cleaned, filtered and de-duplicated inside the
array of that row. A trial is one row, so counting distinct trials per term
needs no distinct aggregate and no extra shuffle later on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

SEPARATORS = " ?[;|,] ?"
# White space that is not one plain space already.
UNEVEN_SPACE = r"(?U)\s{2,}|[\s&&[^ ]]"
TRAILING_MARKS = ".;:"
NUMBERS_ONLY = r"^[0-9.\-\s]+\z"


def _pieces(text: Column) -> Column:
    """Lower-case terms without outer spaces; white space is squeezed once, before the split."""
    even = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNEVEN_SPACE, " ")
    return F.split(F.trim(even), SEPARATORS, -1)


def loose_terms(text: Column) -> Column:
    """array<struct<term, is_first>>: every term, repeated ones with is_first = false."""
    terms = F.filter(
        _pieces(text),
        lambda t: (F.length(t) >= C.MIN_CONDITION_LENGTH) & ~t.isin(*C.CONDITION_STOP_TERMS),
    )
    # One-element array around the sorted terms: names the value inside the expression,
    # so it is computed once per row.
    marked = F.transform(
        F.array(F.array_sort(terms)),
        lambda ordered: F.zip_with(
            ordered,
            F.slice(F.concat(F.array(F.lit(None).cast("string")), ordered), 1, F.size(ordered)),
            lambda term, previous: F.struct(
                term.alias("term"), (~term.eqNullSafe(previous)).alias("is_first")
            ),
        ),
    )
    return F.element_at(marked, 1)


def strict_terms(text: Column, word_boundary: bool = False) -> Column:
    """array<string> of distinct terms for the sponsor x condition datasets.

    The length, stop-word and connective tests see the term before its trailing
    marks are cut. The connective test has no word boundary ("Oral health"
    starts with "or"); ``word_boundary`` adds one.
    """
    connective = "^(" + "|".join(C.LEADING_CONNECTIVES) + ")" + (r"\b" if word_boundary else "")
    terms = F.filter(
        _pieces(text),
        lambda t: F.length(t).between(C.MIN_CONDITION_LENGTH, C.MAX_STRICT_CONDITION_LENGTH)
        & ~t.isin(*C.STRICT_CONDITION_STOP_TERMS)
        & ~t.rlike(NUMBERS_ONLY)
        & ~t.rlike(connective),
    )
    return F.array_distinct(F.transform(terms, lambda t: F.trim(F.rtrim(t, F.lit(TRAILING_MARKS)))))
