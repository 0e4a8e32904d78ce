"""Vocabulary growth against a replay of the same uses one by one."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialloom.operators import vocabulary
from trialloom.sources.registry import id_vocabulary, seed_missing

SPELLINGS = [
    "Phase 1", "phase-1", "Phase-1", "PHASE 1", "phase_1", "Phase 9", "phase 9", "phase_9", "Phase-9", "New", "n-e-w",
    # Labels that do not lead to their own code, and spellings that take those codes.
    "N/A", "n/a", "na!", "N-A", "Not-applicable", "Phase 1/Phase 2", "Phase 1-2",
]


def code_of(value):
    return re.sub("[^a-z0-9]+", "_", value.lower()).strip("_")


def replay(entries, values):
    """The obvious sequential rule, on {code: [label, xml value, id]}."""
    ids = []
    for position, value in enumerate(values, start=1):
        known = [e[2] for c, e in entries.items() if value.lower() in (c, e[0].lower(), e[1].lower())]
        if known:
            ids.append(min(known))
            continue
        entry = entries.setdefault(code_of(value), [None, None, 9 + position])
        entry[:2] = [value, value]
        ids.append(entry[2])
    return ids


@pytest.mark.parametrize("seed", range(8))
def test_growth_equals_sequential_replay(spark, seed):
    values = random.Random(seed).choices(SPELLINGS, k=24)
    phases = id_vocabulary(spark, "phase")
    events = vocabulary.match(
        spark.createDataFrame(pa.table({"position": list(range(1, 25)), "value": values})), F.col("value"), phases, "matched_id"
    )
    uses, made = vocabulary.settle(events, phases)
    expected = {r.code: [r.label, r.xml_value, r.id] for r in phases.collect()}
    ids = replay(expected, values)
    got = {r.code: [r.label, r.xml_value, r.id] for r in vocabulary.grown(phases, made).collect()}
    assert got == expected
    assert [r.matched_id for r in vocabulary.resolve(uses, made).orderBy("position").collect()] == ids


def test_match_takes_lowest_id_and_missing_means_unknown(spark):
    df = spark.createDataFrame(pa.table({"v": ["n/a", "NOT APPLICABLE", "Phase 2/phase 3", "x", None]}))
    got = {r.v: r.i for r in vocabulary.match(df, F.col("v"), id_vocabulary(spark, "phase"), "i").collect()}
    assert got == {"n/a": 1, "NOT APPLICABLE": 9, "Phase 2/phase 3": 6, "x": None, None: None}
    access = vocabulary.match(df, F.col("v"), id_vocabulary(spark, "expanded_access"), "i")
    assert access.filter("v is null").first().i == 3


def test_seeding_adds_only_absent_codes(spark):
    seed = id_vocabulary(spark, "study_type")
    current = seed.filter("code = 'observational'").withColumn("label", F.lit("Changed")).withColumn("id", F.lit(40).cast("long"))
    rows = sorted((r.id, r.code, r.label) for r in seed_missing(current, seed).collect())
    assert rows == [(40, "observational", "Changed"), (41, "intervention", "Intervention"), (42, "expanded_access", "Expanded access")]
    assert seed_missing(seed, seed).count() == 3


def test_lookups_of_several_vocabularies_equal_one_by_one(spark):
    phase = id_vocabulary(spark, "phase")
    names = {"full": phase, "none": phase.limit(0), "shared": phase.unionByName(phase.withColumn("id", F.col("id") + 100))}
    df = spark.createDataFrame([("PHASE 1",), ("phase_1",), ("n/a",), ("?",), (None,), ("phase 1",)], "v string")
    together = vocabulary.match_all(df, {name: (F.col("v"), entries) for name, entries in names.items()})
    assert together.columns == ["v", "full", "none", "shared"]
    alone = df
    for name, entries in names.items():
        alone = vocabulary.match(alone, F.col("v"), entries, name)
    got = sorted(together.collect(), key=repr)
    assert got == sorted(alone.collect(), key=repr) and any(r.full for r in got)
    assert all(r.none is None and r.shared == r.full for r in got)
