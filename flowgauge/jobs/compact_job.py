"""Compacts the closed dates of a raw or window table, also while its query runs.

    spark-submit flowgauge/jobs/compact_job.py --raw s3a://lake/raw --before 2026-05-09
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from flowgauge import schemas
from flowgauge.folders import Folder
from flowgauge.operators.rollup import merged_partials
from flowgauge.session import BATCH_DEFAULTS, job_session
from flowgauge.sinks.alert_log import merge_segments
from flowgauge.sinks.batch_log import BatchLog
from flowgauge.sinks.batches import partials_parquet, raw_parquet, window_parquet
from flowgauge.sinks.compaction import (
    GRACE_SECONDS,
    as_they_are,
    committed_batch,
    compact_day,
    sweep_day,
)
from flowgauge.sources.visibility import own_log
from flowgauge.streaming.queries import query_id


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Compact closed dates")
    table = parser.add_mutually_exclusive_group(required=True)
    table.add_argument("--raw", help="directory of the raw table")
    table.add_argument("--windows", help="directory of the window table")
    table.add_argument("--partials", help="directory of the hourly partials")
    table.add_argument("--alert-log", help="directory of the alert log, of which closed segments go")
    parser.add_argument("--log", help="log of the query, if it is not in the table's directory")
    parser.add_argument(
        "--checkpoint", action="append", default=[], help="of a query whose batches no log has"
    )
    parser.add_argument("--before", type=date.fromisoformat, help="first open date")
    parser.add_argument(
        "--grace-hours",
        type=float,
        default=GRACE_SECONDS / 3600,
        help="how long replaced files stay for readers that began before",
    )
    chosen = parser.parse_args(argv)
    if (chosen.partials or chosen.alert_log) and not chosen.log:
        parser.error("partials and alerts need --log, that of the raw table")
    if not chosen.alert_log and not chosen.before:
        parser.error("a table by date needs --before")
    return chosen


def compact(spark: SparkSession, chosen: argparse.Namespace) -> list[date] | list[str]:
    """The dates, or segments, that were compacted. What earlier runs replaced is removed, where it is old enough."""
    grace = 3600 * chosen.grace_hours
    if chosen.alert_log:
        return merge_segments(spark, chosen.alert_log, BatchLog(chosen.log), grace)
    fold = as_they_are
    if chosen.raw:
        table, schema = raw_parquet(chosen.raw), schemas.RAW_TABLE
    elif chosen.windows:
        table, schema = window_parquet(chosen.windows), schemas.WINDOW_TABLE
    else:
        table, schema = partials_parquet(chosen.partials), schemas.HOURLY_PARTIALS
        fold = merged_partials
    log = BatchLog(chosen.log) if chosen.log else own_log(table.path)
    committed = {query_id(spark, c): committed_batch(spark, c) for c in chosen.checkpoint}
    committed |= log.committed(spark)
    names = Folder(spark, table.path).values(table.date_column)
    closed = [d for d in map(date.fromisoformat, names) if d < chosen.before]
    done = [d for d in closed if compact_day(spark, table, schema, d, committed, fold)]
    for day in closed:
        sweep_day(spark, table, day, grace)
    return done


def main(argv: list[str] | None = None) -> None:
    chosen = arguments(argv)
    spark = job_session("compaction", defaults=BATCH_DEFAULTS)
    for day in compact(spark, chosen):
        print(f"compacted {day}")


if __name__ == "__main__":
    main()
