"""Sponsor x health condition: one grouped table, several small views of it.

``pair_counts`` is the only operator that touches trials in bulk: it counts
trials per (sponsor, condition) in one shuffle with map-side partial counts.
A trial has one sponsor and its terms are distinct within the row, so totals
per condition and numbers of sponsors follow by adding up pairs, with no
distinct aggregates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates
from ..functions.conditions import strict_terms
from ..functions.text import sponsor_name, title_case
from .rules import percentage, public, with_outdated_flag


def trial_terms(
    trial: DataFrame, recruitment: DataFrame, as_of: dt.date, word_boundary: bool = False
) -> DataFrame:
    """One row per public trial with text: sponsor, flags and the distinct clean terms."""
    return (
        with_outdated_flag(
            public(trial).filter(F.coalesce("hc_freetext", F.lit("")) != ""), recruitment, as_of
        )
        .select(
            "id",
            sponsor_name(F.col("primary_sponsor")).alias("sponsor"),
            "possibly_outdated",
            dates.within_last_year(F.col("date_registration"), as_of).alias("registered_recently"),
            strict_terms(F.col("hc_freetext"), word_boundary).alias("terms"),
        )
    )


def pair_counts(terms: DataFrame) -> DataFrame:
    return (
        terms.select("sponsor", "possibly_outdated", "registered_recently", F.explode("terms").alias("condition_key"))
        .groupBy("sponsor", "condition_key")
        .agg(
            F.count(F.lit(1)).alias("total_trials"),
            F.count_if("possibly_outdated").alias("possibly_outdated_trials"),
            F.count_if("registered_recently").alias("last_12_months_trials"),
        )
    )


def condition_counts(pairs: DataFrame) -> DataFrame:
    """Trials per cleaned condition."""
    return pairs.groupBy("condition_key").agg(F.sum("total_trials").alias("total_trials"))


def focus_conditions(
    pairs: DataFrame, min_trials: int = C.MIN_TRIALS_PER_CONDITION, limit: int = C.TOP_CONDITIONS
) -> DataFrame:
    """The conditions the dataset concentrates on: frequent enough, at most ``limit``."""
    return (
        condition_counts(pairs)
        .filter(F.col("total_trials") >= min_trials)
        .orderBy(F.desc("total_trials"), "condition_key")
        .limit(limit)
        .select("condition_key", title_case(F.col("condition_key")).alias("condition_name"), "total_trials")
    )


def focused_pairs(pairs: DataFrame, focus: DataFrame) -> DataFrame:
    """Pairs of the focus conditions. ``focus`` is a LIMIT, so its size is bounded."""
    return pairs.join(F.broadcast(focus.select("condition_key")), "condition_key", "left_semi")


def _frequent(focused: DataFrame, min_trials: int) -> DataFrame:
    return focused.filter(F.col("total_trials") >= min_trials).withColumn(
        "condition_name", title_case(F.col("condition_key"))
    )


def top_pairs(
    focused: DataFrame, limit: int | None = C.TOP_PAIRS, min_trials: int = C.MIN_TRIALS_PER_PAIR
) -> DataFrame:
    return (
        _frequent(focused, min_trials)
        .orderBy(F.desc("total_trials"), "sponsor", "condition_key")
        .limit(max(C.TOP_PAIRS if limit is None else limit, 1))
        .select(
            "sponsor", "condition_key", "condition_name", "total_trials", "possibly_outdated_trials",
            "last_12_months_trials",
        )
    )


def _best(focused: DataFrame, group: str, tie_break: str, top: int, min_trials: int) -> DataFrame:
    """Best ``top`` pairs per group. The rank filter lets Spark cut each group before the
    shuffle (WindowGroupLimit), so a condition with very many sponsors is no hot spot."""
    order = Window.partitionBy(group).orderBy(F.desc("total_trials"), tie_break)
    return _frequent(focused, min_trials).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)


def sponsor_top_conditions(
    focused: DataFrame, top: int = C.TOP_PER_GROUP, min_trials: int = C.MIN_TRIALS_PER_PAIR
) -> DataFrame:
    return _best(focused, "sponsor", "condition_name", top, min_trials).select(
        "sponsor", "condition_key", "condition_name", "total_trials", "possibly_outdated_trials", "rn"
    )


def condition_top_sponsors(
    focused: DataFrame, top: int = C.TOP_PER_GROUP, min_trials: int = C.MIN_TRIALS_PER_PAIR
) -> DataFrame:
    return _best(focused, "condition_key", "sponsor", top, min_trials).select(
        "condition_key", "condition_name", "sponsor", "total_trials", "possibly_outdated_trials", "rn"
    )


def condition_concentration(focused: DataFrame) -> DataFrame:
    """Trials and sponsors per focus condition. Every pair is one sponsor."""
    exact = lambda name: F.col(name).cast("decimal(18,0)")
    return (
        focused.groupBy("condition_key")
        .agg(F.sum("total_trials").alias("total_trials"), F.count(F.lit(1)).alias("unique_sponsors"))
        .orderBy(F.desc("total_trials"), "condition_key")
        .select(
            "condition_key", title_case(F.col("condition_key")).alias("condition_name"), "total_trials",
            "unique_sponsors",
            F.round(exact("total_trials") / exact("unique_sponsors"), 2)
            .cast("decimal(18,2)")
            .alias("avg_trials_per_sponsor"),
        )
    )


def sponsor_outdated_burden(
    terms: DataFrame,
    focus: DataFrame,
    min_trials: int = C.MIN_TRIALS_FOR_BURDEN,
    limit: int = C.TOP_CONDITIONS,
) -> DataFrame:
    """Share of outdated trials among a sponsor's trials in the focus conditions.

    A trial with several focus conditions counts once, so this looks at trials
    and not at pairs: a row passes when its terms meet the focus list.
    """
    keys = focus.agg(F.collect_list("condition_key").alias("keys")).scalar()
    total, outdated = F.col("total_trials_in_top_conditions"), F.col("possibly_outdated_trials")
    return (
        terms.filter(F.arrays_overlap("terms", keys))
        .groupBy("sponsor")
        .agg(
            F.count(F.lit(1)).alias("total_trials_in_top_conditions"),
            F.count_if("possibly_outdated").alias("possibly_outdated_trials"),
        )
        .filter(total >= min_trials)
        .withColumn("possibly_outdated_percentage", percentage(outdated, total))
        .orderBy(F.desc("possibly_outdated_percentage"), F.desc("possibly_outdated_trials"), "sponsor")
        .limit(limit)
    )
