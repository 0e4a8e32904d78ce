"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Characters that count as white space at the ends of a text (fixed values).
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove any white space at both ends (``F.trim`` alone would leave tabs and line ends)."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Normalise text from a document: line ends, blank runs, white space at the ends.

    Byte replacements, and one pattern that matches only what has to change: two
    or more spaces become one, three or more line ends two.
    """
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\t", " ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(text, r"( ) +|(\n\n)\n+", "$1$2"))


def clean(text: Column) -> Column:
    """``squeeze``, and an empty text becomes NULL.

    By way of a filtered one-element array: ``nullif`` would repeat the whole
    expression, once per nesting level where it is used inside a lambda.
    """
    return F.get(F.filter(F.array(squeeze(text)), lambda t: t != ""), 0)


def delimited_text(text: Column) -> Column:
    """Make text safe for ``|``-separated, one-line-per-row output; never NULL."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for mark in ("|", "\n", "\r"):
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.trim(text)


def delimited_date(value: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.coalesce(F.date_format(value, pattern), F.lit(""))


def sponsor_name(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("Unknown"))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def title_case(text: Column) -> Column:
    """Upper-case the first letter after anything that is no letter or digit.

    ``F.initcap`` only looks at whitespace, so it would give ``Non-small`` where
    the registry reports ``Non-Small``.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(p.substr(F.lit(2), F.length(p)))),
        ),
        "",
    )
