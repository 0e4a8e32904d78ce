"""The insight dataset: all sections as tables, as JSON rows, or as one document.

The document is a table of lines in order, so it has no largest size either.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import insight_counts, insights, sponsor_condition
from ..sinks.outputs import json_text
from ..sources.registry import Registry
from ..staging import stage


@dataclass(frozen=True)
class Section:
    """Rows of one array of the dataset, or one row of plain values (``order`` empty)."""

    rows: DataFrame
    order: tuple[str, ...] = ()
    """Sort keys; a leading '-' means descending."""


def insight_tables(registry: Registry, as_of: dt.date) -> dict[str, Section]:
    """Every section by its dotted path in the dataset.

    All counts come from one staged pass over the trials; only the examples and
    the free-text conditions read them again.
    """
    trial = registry["trial"]
    recruitment, study_type = registry.vocabulary("recruitment_status"), registry.vocabulary("study_type")
    counts = stage(insight_counts.count_groups(trial, recruitment, study_type, as_of), "counts")
    terms = stage(sponsor_condition.trial_terms(trial, recruitment, as_of), "terms")
    pairs = stage(sponsor_condition.pair_counts(terms), "pairs")
    focus = stage(sponsor_condition.focus_conditions(pairs), "focus")
    focused = sponsor_condition.focused_pairs(pairs, focus)
    fresh, cross = "recruitment_freshness.", "sponsor_health_condition_intelligence."
    quality, profile, trends = "data_quality_governance.", "study_profile.", "temporal_trends."
    return {
        "executive_dashboard": Section(insight_counts.executive_dashboard(counts)),
        fresh + "possibly_outdated_total": Section(insight_counts.outdated_total(counts)),
        fresh + "recruitment_status_distribution": Section(
            insight_counts.recruitment_distribution(counts, recruitment), ("-total", "recruitment_status_label")
        ),
        fresh + "risk_bands": Section(insight_counts.risk_bands(counts), ("risk_band",)),
        fresh + "top_flagged_sponsors": Section(
            insight_counts.flagged_sponsors(counts), ("-possibly_outdated_trials", "sponsor")
        ),
        fresh + "oldest_examples": Section(
            insights.oldest_examples(trial, recruitment, as_of), ("-months_since_enrolment", "id")
        ),
        "top_sponsors": Section(insight_counts.top_sponsors(counts), ("-total_trials", "sponsor")),
        "top_health_conditions": Section(
            insights.top_health_conditions(trial, recruitment, as_of), ("-total_trials", "condition_key")
        ),
        profile + "study_type_distribution": Section(
            insight_counts.profile(counts, "study_type_id", study_type, "study_type"), ("-total_trials", "study_type")
        ),
        profile + "phase_distribution": Section(
            insight_counts.profile(counts, "phase_id", registry.vocabulary("phase"), "phase"), ("-total_trials", "phase")
        ),
        trends + "trials_by_year": Section(insight_counts.trials_by_year(counts), ("year",)),
        trends + "trials_last_24_months": Section(insight_counts.trials_by_month(counts, as_of), ("month",)),
        quality + "missing_fields": Section(insight_counts.missing_fields(counts), ("-missing_count", "field_name")),
        quality + "date_issues": Section(insight_counts.date_issues(counts)),
        cross + "top_conditions_used": Section(focus, ("-total_trials", "condition_key")),
        cross + "top_sponsor_condition_combinations": Section(
            sponsor_condition.top_pairs(focused), ("-total_trials", "sponsor", "condition_key")
        ),
        cross + "sponsor_top_conditions": Section(
            sponsor_condition.sponsor_top_conditions(focused), ("sponsor", "rn")
        ),
        cross + "condition_top_sponsors": Section(
            sponsor_condition.condition_top_sponsors(focused), ("condition_name", "rn")
        ),
        cross + "condition_concentration": Section(
            sponsor_condition.condition_concentration(focused), ("-total_trials", "condition_key")
        ),
        cross + "sponsor_outdated_burden": Section(
            sponsor_condition.sponsor_outdated_burden(terms, focus),
            ("-possibly_outdated_percentage", "-possibly_outdated_trials", "sponsor"),
        ),
    }


def insight_rows(tables: dict[str, Section]) -> DataFrame:
    """(section, item): every item of every section as JSON, spread over the cluster."""
    parts = [
        section.rows.select(F.lit(path).alias("section"), json_text(F.struct(*section.rows.columns)).alias("item"))
        for path, section in tables.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


PLACE = "array<struct<number:double,text:string>>"


def _place(section: Section) -> Column:
    """Sort keys of an item as one value that orders items of any section."""
    kinds = dict(section.rows.dtypes)

    def key(name: str) -> Column:
        column = F.col(name.removeprefix("-"))
        is_text = kinds[name.removeprefix("-")] == "string"
        number = F.lit(None).cast("double") if is_text else column.cast("double") * (-1 if name.startswith("-") else 1)
        return F.struct(number.alias("number"), (column if is_text else F.lit(None).cast("string")).alias("text"))

    return F.array(*map(key, section.order)).cast(PLACE)


def _items(section: Section) -> DataFrame:
    """(place, line): the JSON of each item, with a comma before all but the first in order."""
    columns = section.rows.columns
    if not section.order:
        value = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
        text = F.coalesce(value.cast("string"), F.lit("null")) if len(columns) == 1 else json_text(value)
        return section.rows.select(F.lit(None).cast(PLACE).alias("place"), text.alias("line"))
    placed = section.rows.select(_place(section).alias("place"), json_text(F.struct(*columns)).alias("item"))
    first = placed.agg(F.min("place").alias("place")).scalar()
    comma = F.when(F.col("place") == first, "").otherwise(",")
    return placed.select("place", F.concat(comma, "item").alias("line"))


def _skeleton(paths: list[str], arrays: set[str], generated_at: dt.datetime, database: str, schema: str) -> list[str | None]:
    """The fixed text of the document between the sections; None where a section's items stand."""
    text = lambda value: json.dumps(value, ensure_ascii=False)
    metadata = {
        "generated_at": generated_at.isoformat(), "database": database, "schema": schema,
        "dataset_scope": C.DATASET_SCOPE, "ai_usage_note": C.DATASET_NOTE,
    }
    strategy = {
        "source": "trial.hc_freetext",
        "minimum_total_trials_for_condition": C.MIN_TRIALS_PER_CONDITION,
        "maximum_number_of_conditions": C.TOP_CONDITIONS,
        "minimum_trials_for_sponsor_condition_pair": C.MIN_TRIALS_PER_PAIR,
        "excluded_terms": list(C.SPONSOR_CONDITION_EXCLUDED),
    }
    before = {
        "recruitment_freshness": f'"definition":{text(C.FRESHNESS_DEFINITION)},',
        "sponsor_health_condition_intelligence": f'"description":{text(C.SPONSOR_CONDITION_DESCRIPTION)},"filtering_strategy":{text(strategy)},',
    }
    after = {"data_quality_governance": f',"interpretation_note":{text(C.QUALITY_NOTE)}'}
    lines: list[str | None] = [f'{{"metadata":{text(metadata)}']
    groups = [p.rpartition(".")[0] for p in paths]
    for i, (path, group) in enumerate(zip(paths, groups, strict=True)):
        opens = bool(group) and (i == 0 or groups[i - 1] != group)
        closes = bool(group) and (i + 1 == len(paths) or groups[i + 1] != group)
        lead = f',"{group}":{{{before.get(group, "")}' if opens else ","
        lines += [f'{lead}"{path.rpartition(".")[2]}":{"[" if path in arrays else ""}', None]
        lines.append(("]" if path in arrays else "") + (f"{after.get(group, '')}}}" if closes else ""))
    return [*lines, "}"]


def insight_document(tables: dict[str, Section], generated_at: dt.datetime, database: str, schema: str) -> DataFrame:
    """(part, place, line): the whole dataset as one JSON document, a line for each item.

    Lines are range-sorted by part and place, so the files of the result, read in
    order, are the document. No section meets in one task, whatever its size.
    """
    spark = next(iter(tables.values())).rows.sparkSession
    paths = list(tables)
    skeleton = _skeleton(paths, {p for p in paths if tables[p].order}, generated_at, database, schema)
    fixed = [(part, line) for part, line in enumerate(skeleton) if line]
    lines = spark.createDataFrame(fixed, "part int, line string").select("part", F.lit(None).cast(PLACE).alias("place"), "line")
    at = [part for part, line in enumerate(skeleton) if line is None]
    for part, path in zip(at, paths, strict=True):
        lines = lines.unionByName(_items(tables[path]).select(F.lit(part).alias("part"), "place", "line"))
    return lines.orderBy("part", "place")
