"""Daily report job over the raw table.

    spark-submit --conf spark.checkpoint.dir=s3a://lake/scratch flowgauge/jobs/report_job.py \
        --raw s3a://lake/raw --out s3a://lake/reports
"""

from __future__ import annotations

import argparse
import os
from datetime import date, timedelta

from pyspark.sql import SparkSession

from flowgauge import rules
from flowgauge.plans.report import CongestionReport, congestion_report, report_from_partials
from flowgauge.session import BATCH_DEFAULTS, job_session
from flowgauge.sinks.report_files import (
    current_report,
    new_version,
    publish,
    sweep_versions,
    utc_today,
    write_csv,
)
from flowgauge.sources.tables import (
    jdbc_newest,
    jdbc_options,
    jdbc_readings,
    newest_of,
    no_readings,
    trailing_partials,
    trailing_raw,
)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Daily congestion report")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--raw", help="directory of the raw table")
    source.add_argument("--raw-table", help="database table of the raw readings")
    parser.add_argument("--partials", help="directory of the hourly partials, to read in place of --raw")
    parser.add_argument("--out", required=True, help="reports go to <out>/report_date=<day>, the current version named in _current")
    parser.add_argument("--day", type=date.fromisoformat, help="name of the report; today in UTC")
    parser.add_argument("--sensors", nargs="+", help="write the matrix by these columns as well")
    parser.add_argument("--jdbc-url")
    parser.add_argument("--jdbc-user")
    parser.add_argument("--jdbc-password-env", help="environment variable that holds the password")
    parser.add_argument("--jdbc-driver")
    parser.add_argument("--partitions", type=int, default=16, help="queries of the database read")
    chosen = parser.parse_args(argv)
    if chosen.raw_table and not chosen.jdbc_url:
        parser.error("a database table needs --jdbc-url")
    if chosen.partials and not chosen.raw:
        parser.error("partials need --raw, whose log they share")
    return chosen


def report_of(spark: SparkSession, chosen: argparse.Namespace) -> CongestionReport:
    if chosen.partials:
        newest = newest_of(spark, chosen.raw)
        if newest is None:
            return congestion_report(no_readings(spark))
        return report_from_partials(*trailing_partials(spark, chosen.raw, chosen.partials, newest))
    if chosen.raw:
        rows, newest = trailing_raw(spark, chosen.raw)
        return congestion_report(rows, date_column="event_date", newest=newest)
    password = os.environ[chosen.jdbc_password_env] if chosen.jdbc_password_env else ""
    login = {"user": chosen.jdbc_user, "password": password, "driver": chosen.jdbc_driver}
    connection = jdbc_options(chosen.jdbc_url, chosen.raw_table, **login)
    newest = jdbc_newest(spark, connection)
    if newest is None:
        return congestion_report(no_readings(spark))
    since = newest - timedelta(hours=rules.TRAILING_HOURS)
    rows = jdbc_readings(spark, connection, since, newest, chosen.partitions)
    return congestion_report(rows, newest=newest)


def write_report(
    report: CongestionReport, out_dir: str, day: date, sensors: list[str] | None = None
) -> bool:
    """Write the report and the data of its chart and table; nothing when there are no readings.

    The matrix has a row per sensor; with `sensors`, which must name them all, it is written with a
    column per sensor as well. All parts are a version of the day's report, which counts from when
    it is whole; `current_report` says where it is. What the report kept is removed.
    """
    try:
        if report.is_empty():
            return False
        spark = report.hourly.sparkSession
        built = new_version(spark, out_dir, day)
        write_csv(report.rows, f"{built.path}/report", ["sensor_id", "hour_bucket"])
        write_csv(report.display(), f"{built.path}/display", ["sensor_id", "hour_bucket"])
        write_csv(report.matrix_by_sensor(), f"{built.path}/matrix_by_sensor", ["sensor_id"])
        if sensors:
            write_csv(report.matrix(sensors), f"{built.path}/matrix", ["hour_bucket"])
        write_csv(report.ticks(), f"{built.path}/ticks", ["position"])
        publish(built, out_dir, day)
        sweep_versions(spark, out_dir, day)
        return True
    finally:
        report.release()


def main(argv: list[str] | None = None) -> None:
    chosen = arguments(argv)
    spark = job_session("congestion-report", defaults=BATCH_DEFAULTS)
    report = report_of(spark, chosen)
    day = chosen.day or utc_today()
    if write_report(report, chosen.out, day, chosen.sensors):
        print(f"report written to {current_report(spark, chosen.out, day)}")
    else:
        print("no readings, no report")


if __name__ == "__main__":
    main()
