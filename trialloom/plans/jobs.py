"""The registry jobs from the command line (for spark-submit).

    jobs.py import  --registry-name NAME --xml DOCUMENTS --store NEW [--from OLD] [--limit N]
                    [--dry-run] [--trial-status STATUS] [--no-snapshot]
    jobs.py report  --store STORE --name REPORT --out DIR [--as-of DAY] [--limit N] [--offset N]
    jobs.py insight --store STORE --snapshots DIR [--as-of DAY] [--max-age-hours H] [--force]
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .. import constants as C
from ..operators import lookups, reports
from ..sinks import outputs, snapshots
from ..sources.registry import Registry, new_registry, read_registry, small_table, write_registry
from ..staging import stage
from .ingest import IngestOptions, ingest_trials
from .insight_dataset import insight_document, insight_tables

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("generated_at", T.TimestampNTZType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("place", T.ArrayType(T.StructType([T.StructField("number", T.DoubleType()), T.StructField("text", T.StringType())]))),
        T.StructField("line", T.StringType()),
    ]
)


def run_import(
    spark: SparkSession, xml: str, store: str | None, options: IngestOptions, previous: str | None = None
) -> dict[str, int]:
    """Import into a new store; without ``store`` (a dry run) everything is computed but not written."""
    before = read_registry(spark, previous) if previous else new_registry(spark)
    result = ingest_trials(spark, xml, before, options)
    if store:
        write_registry(result.registry, store)
        result.quarantine.write.mode("errorifexists").parquet(f"{store}/import_quarantine")
    return result.counts.first().asDict()


REPORTS = {
    "dashboard": lambda r, a: reports.registry_dashboard(r, a.as_of),
    "by_recruitment_status": lambda r, a: reports.trials_by_recruitment_status(r),
    "by_study_type": lambda r, a: reports.trials_by_study_type(r),
    "by_status": lambda r, a: reports.trials_by_status(r),
    "possibly_outdated": lambda r, a: reports.possibly_outdated_trials(r, a.as_of, a.limit, a.offset),
    "possibly_outdated_count": lambda r, a: reports.possibly_outdated_count(r, a.as_of),
    "public_trials": lambda r, a: lookups.public_trial_list(r, a.limit, a.offset),
    "pending_requests": lambda r, a: lookups.list_pending_user_requests(r["app_user_request"]),
    "active_users": lambda r, a: lookups.list_active_users(r["app_user"], r["app_role"]),
}


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SNAPSHOT_SCHEMA).parquet(path)
    except AnalysisException:  # nothing stored yet
        return small_table(spark, SNAPSHOT_SCHEMA)


def run_insight(
    spark: SparkSession, registry: Registry, path: str, now: dt.datetime,
    max_age_hours: float = C.SNAPSHOT_MAX_AGE_HOURS, force: bool = False, database: str = "", schema: str = "",
) -> bool:
    """Store a new insight document unless the newest is fresh; True if one was made.

    The newest documents are kept, older ones dropped.
    """
    stored = stored_snapshots(spark, path)
    fresh = snapshots.freshness(stored, now, max_age_hours).first()["valid"]
    if fresh and not force:
        return False
    document = insight_document(insight_tables(registry, now.date()), now, database, schema)
    # Staged before the stored documents, of which it holds copies, are replaced.
    kept = stage(snapshots.newest(stored.unionByName(snapshots.as_snapshot(document, now))), "snapshots")
    kept.write.mode("overwrite").parquet(path)
    return True


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="jobs.py")
    commands = parser.add_subparsers(dest="command", required=True)
    day = lambda text: dt.date.fromisoformat(text)
    command = commands.add_parser("import")
    command.add_argument("--registry-name", required=True)
    command.add_argument("--xml", required=True)
    command.add_argument("--store", required=True)
    command.add_argument("--from", dest="previous")
    command.add_argument("--limit", type=int)
    command.add_argument("--dry-run", action="store_true")
    command.add_argument("--trial-status", default="published", choices=C.TRIAL_STATUSES)
    command.add_argument("--no-snapshot", action="store_true")
    command = commands.add_parser("report")
    command.add_argument("--store", required=True)
    command.add_argument("--name", required=True, choices=REPORTS)
    command.add_argument("--out", required=True)
    command.add_argument("--as-of", type=day, default=dt.date.today())
    command.add_argument("--limit", type=int)
    command.add_argument("--offset", type=int)
    command = commands.add_parser("insight")
    command.add_argument("--store", required=True)
    command.add_argument("--snapshots", required=True)
    command.add_argument("--as-of", type=dt.datetime.fromisoformat, default=dt.datetime.now())
    command.add_argument("--max-age-hours", type=float, default=C.SNAPSHOT_MAX_AGE_HOURS)
    command.add_argument("--force", action="store_true")
    command.add_argument("--database", default="")
    command.add_argument("--schema", default="")
    return parser.parse_args(argv)


def main(argv: list[str]) -> None:
    a = _arguments(argv)
    spark = SparkSession.builder.appName(f"trialloom-{a.command}").getOrCreate()
    if a.command == "import":
        options = IngestOptions(
            a.registry_name, dt.datetime.now(), a.trial_status, not a.no_snapshot, a.limit
        )
        print(run_import(spark, a.xml, None if a.dry_run else a.store, options, a.previous))
    elif a.command == "report":
        outputs.write_delimited(REPORTS[a.name](read_registry(spark, a.store), a), a.out)
    else:
        made = run_insight(
            spark, read_registry(spark, a.store), a.snapshots, a.as_of, a.max_age_hours, a.force, a.database, a.schema
        )
        print("new document" if made else "the stored document is still fresh")


if __name__ == "__main__":
    main(sys.argv[1:])
