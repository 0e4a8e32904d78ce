"""The registry as a set of DataFrames: tables, vocabularies, roles."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import constants as C
from .. import schemas as S


def small_table(spark: SparkSession, schema: T.StructType, rows: Iterable[tuple] = ()) -> DataFrame:
    """Rows written in the program. Spark sees a local relation and knows its size,
    so a join with it is broadcast by size and not by a blind hint."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(
        pa.table([pa.array(list(values), kind.type) for values, kind in zip(columns, arrow)], schema=arrow),
        schema,
    )


def id_vocabulary(spark: SparkSession, name: str) -> DataFrame:
    rows = [
        (number, code, label, xml_value, order, True)
        for number, (code, label, xml_value, order) in enumerate(S.ID_VOCABULARIES[name], start=1)
    ]
    return small_table(spark, S.VOCAB_BY_ID, rows)


def code_vocabulary(spark: SparkSession, name: str) -> DataFrame:
    rows = [(*entry, True) for entry in S.CODE_VOCABULARIES[name]]
    return small_table(spark, S.VOCAB_BY_CODE, rows)


def roles(spark: SparkSession) -> DataFrame:
    rows = [(number, *role, True) for number, role in enumerate(C.ROLES, start=1)]
    return small_table(spark, S.TABLES["app_role"], rows)


@dataclass(frozen=True)
class Registry:
    """Current state of a registry. Operators never change it; jobs return a new one.

    A table that was never set is empty, a vocabulary that was never set (or the
    roles) has its seed entries.
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    vocabularies: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        return roles(self.spark) if name == "app_role" else small_table(self.spark, S.TABLES[name])

    def vocabulary(self, name: str) -> DataFrame:
        if name in self.vocabularies:
            return self.vocabularies[name]
        seeded = id_vocabulary if name in S.ID_VOCABULARIES else code_vocabulary
        return seeded(self.spark, name)

    def replace(
        self, tables: dict[str, DataFrame] | None = None, vocabularies: dict[str, DataFrame] | None = None
    ) -> Registry:
        return Registry(
            self.spark, {**self.tables, **(tables or {})}, {**self.vocabularies, **(vocabularies or {})}
        )


def new_registry(spark: SparkSession) -> Registry:
    return Registry(spark)


def seed_missing(current: DataFrame, seed: DataFrame) -> DataFrame:
    """Add the seed entries whose code is absent; entries that exist are left alone.

    A vocabulary is keyed by its code, so the new entries are at most the seed
    rows of ``constants`` and numbering them in one task is safe.
    """
    missing = seed.join(current.select("code"), "code", "left_anti")
    if "id" in current.columns:
        # The aggregate without grouping is never empty, even for an empty vocabulary.
        base = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")).scalar()
        rank = F.expr("row_number() OVER (ORDER BY sort_order, code)")
        missing = missing.withColumn("id", base + rank.cast("long"))
    return current.unionByName(missing.select(*current.columns))


def write_registry(registry: Registry, path: str, mode: str = "errorifexists") -> None:
    """Write every table as parquet below ``path``, which must not hold the registry's own input.

    The trial table is partitioned by status: nearly every question asks for the
    public part only.
    """
    for name in S.TABLES:
        writer = registry[name].write.mode(mode)
        (writer.partitionBy("status") if name == "trial" else writer).parquet(f"{path}/{name}")
    for name in (*S.ID_VOCABULARIES, *S.CODE_VOCABULARIES):
        registry.vocabulary(name).write.mode(mode).parquet(f"{path}/vocab_{name}")


def read_registry(spark: SparkSession, path: str) -> Registry:
    tables = {
        name: spark.read.schema(schema).parquet(f"{path}/{name}").select(*schema.fieldNames())
        for name, schema in S.TABLES.items()
    }
    vocabularies = {name: spark.read.schema(S.VOCAB_BY_ID).parquet(f"{path}/vocab_{name}") for name in S.ID_VOCABULARIES}
    vocabularies |= {
        name: spark.read.schema(S.VOCAB_BY_CODE).parquet(f"{path}/vocab_{name}") for name in S.CODE_VOCABULARIES
    }
    return Registry(spark, tables, vocabularies)
