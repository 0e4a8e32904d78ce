"""The import job as a stream over a folder of registry documents.

Every micro-batch of new files makes the next version of the registry store
from the one before, so a batch that is retried after a failure writes the same
version again and nothing is counted twice. The stream's checkpoint remembers
which files were taken.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..plans.ingest import IngestOptions, ingest_elements
from ..sources.registry import new_registry, read_registry, write_registry
from ..sources.trials_xml import ELEMENT_END, chunk_columns, cut_elements


def version_path(store: str, batch_id: int) -> str:
    return f"{store}/version={batch_id:09d}"


def _is_complete(spark: SparkSession, version: str) -> bool:
    """The counts are written last."""
    try:
        return not spark.read.schema("found long").parquet(f"{version}/import_counts").isEmpty()
    except AnalysisException:  # no such folder
        return False


def _import_batch(chunks: DataFrame, batch_id: int, store: str, registry_name: str, trial_status: str) -> None:
    spark = chunks.sparkSession
    target = version_path(store, batch_id)
    if _is_complete(spark, target):
        return
    # The newest file of the batch dates it: a retry writes the same stamps.
    newest = chunks.agg(F.max("modified")).first()[0]
    options = IngestOptions(registry_name, newest or dt.datetime(1970, 1, 1), trial_status)
    before = read_registry(spark, version_path(store, batch_id - 1)) if batch_id else new_registry(spark)
    result = ingest_elements(cut_elements(chunks), before, options)
    write_registry(result.registry, target, mode="overwrite")
    result.quarantine.write.mode("overwrite").parquet(f"{target}/import_quarantine")
    result.counts.write.mode("overwrite").parquet(f"{target}/import_counts")


def import_folder(
    spark: SparkSession,
    folder: str,
    store: str,
    checkpoint: str,
    registry_name: str,
    trial_status: str = "published",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Import all files in ``folder`` that were not imported yet, then stop."""
    chunks = (
        spark.readStream.option("lineSep", ELEMENT_END)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select(*chunk_columns(), F.col("_metadata.file_modification_time").alias("modified"))
    )
    return (
        chunks.writeStream.foreachBatch(
            lambda batch, batch_id: _import_batch(batch, batch_id, store, registry_name, trial_status)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
