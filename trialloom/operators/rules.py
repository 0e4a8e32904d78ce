"""Rules shared by reports and insights: what is public, what is outdated, percentages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates


def is_public(status: str | Column = "status") -> Column:
    return F.col(status).isin(*C.PUBLIC_STATUSES) if isinstance(status, str) else status.isin(*C.PUBLIC_STATUSES)


def public(trial: DataFrame) -> DataFrame:
    return trial.filter(is_public())


def total_of(counts: DataFrame, name: str) -> Column:
    """Sum of group counts as a scalar subquery: the grouping's exchange is reused, the rows are not read again."""
    return counts.agg(F.sum(name).alias("n")).scalar()


def percentage(part: Column, total: Column) -> Column:
    """Exact decimal percentage, two digits, halves away from zero; 0 for an empty total."""
    exact = lambda c: c.cast("decimal(18,0)")
    ratio = F.round(exact(part) * 100 / F.nullif(exact(total), F.lit(0).cast("decimal(18,0)")), 2)
    return F.coalesce(ratio, F.lit(0)).cast("decimal(10,2)")


def active_recruitment(recruitment: DataFrame) -> DataFrame:
    """The entries that mean recruitment is open or planned.

    ``code`` is the key of the vocabulary, so this is two rows whatever the size
    of the data, and safe to broadcast.
    """
    return F.broadcast(
        recruitment.filter(F.col("code").isin(*C.ACTIVE_RECRUITMENT_CODES)).select(
            F.col("id").alias("recruitment_status_id"),
            F.col("code").alias("active_code"),
            F.col("xml_value").alias("active_label"),
        )
    )


def outdated_only(trial: DataFrame, recruitment: DataFrame, as_of: dt.date) -> DataFrame:
    """Public trials that look out of date, with ``active_code`` and ``active_label``."""
    return (
        public(trial)
        .filter(dates.older_than(F.col("date_enrolment"), as_of))
        .join(active_recruitment(recruitment), "recruitment_status_id")
    )


def with_outdated_flag(trial: DataFrame, recruitment: DataFrame, as_of: dt.date) -> DataFrame:
    """Add ``active_code`` (NULL unless recruiting or about to) and boolean ``possibly_outdated``."""
    return trial.join(active_recruitment(recruitment), "recruitment_status_id", "left").withColumn(
        "possibly_outdated",
        F.col("active_code").isNotNull() & dates.older_than(F.col("date_enrolment"), as_of),
    )


def page(df: DataFrame, limit: int | None, offset: int | None, default_limit: int) -> DataFrame:
    """LIMIT/OFFSET with the registry's defaults: NULL takes the default, too small is raised."""
    size = max(default_limit if limit is None else limit, 1)
    skip = max(offset or 0, 0)
    return (df.offset(skip) if skip else df).limit(size)


def as_rows(one_row: DataFrame, columns: list[str], measures: list[tuple]) -> DataFrame:
    """Turn a one-row aggregate into one row per measure.

    Each measure is (column, value, value, ...): the name of the aggregate column
    and the constants for all but the last of ``columns``.
    """
    structs = [
        F.struct(
            *[F.lit(v).alias(c) for c, v in zip(columns, constants)],
            F.col(source).alias(columns[-1]),
        )
        for source, *constants in measures
    ]
    return one_row.select(F.inline(F.array(*structs)))
