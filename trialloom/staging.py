"""Cutting lineage at a written table.

A staged table lives in the shared folder that ``spark.checkpoint.dir`` names,
so it survives the loss of executors. Where nothing is configured the session's
warehouse folder is used, which every executor of a cluster reaches as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Staged tables are written once and read a few times; they share the disk with shuffles.
STAGED_CODEC = "zstd"


def staging_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of the warehouse where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def stage(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write ``df`` once and read it back: computed once, with column pruning and known size.

    ``parts`` are its last columns; filters on them choose what is read, and its size is known.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).option("compression", STAGED_CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
