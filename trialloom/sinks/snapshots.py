"""Stored insight documents: is the newest still fresh, which ones to keep.

A snapshot table has ``generated_at`` (timestamp without zone) and the lines of the
documents; all lines of one time are one document.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def freshness(snapshots: DataFrame, as_of: dt.datetime, max_age_hours: float = C.SNAPSHOT_MAX_AGE_HOURS) -> DataFrame:
    """One row: does a snapshot exist, how old is the newest, may it be reused."""
    # NULL without snapshots; ``greatest`` alone would turn that into an age of 0.
    passed = F.timestamp_diff("SECOND", F.col("generated_at"), F.lit(as_of).cast("timestamp_ntz"))
    age = F.when(F.col("generated_at").isNotNull(), F.greatest(F.lit(0), passed))
    return (
        snapshots.agg(F.max("generated_at").alias("generated_at"))
        .withColumn("age_seconds", age)
        .select(
            F.col("generated_at").isNotNull().alias("exists"),
            F.coalesce(F.col("age_seconds") < max_age_hours * 3600, F.lit(False)).alias("valid"),
            "generated_at",
            "age_seconds",
            F.round(F.col("age_seconds") / 3600, 2).alias("age_hours"),
            F.lit(float(max_age_hours)).alias("max_age_hours"),
        )
    )


def newest(snapshots: DataFrame, keep: int = C.SNAPSHOT_KEEP) -> DataFrame:
    """The newest ``keep`` snapshots (at least the latest one), with all their lines."""
    times = snapshots.select("generated_at").distinct().orderBy(F.desc("generated_at")).limit(max(keep, 1))
    return snapshots.join(times, "generated_at", "left_semi")


def as_snapshot(document: DataFrame, generated_at: dt.datetime) -> DataFrame:
    """The lines of ``document`` as rows of the snapshot table."""
    return document.select(F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"), "part", "place", "line")
