"""Streaming job: raw history, window aggregates and alerts.

    spark-submit --packages <kafka connector> flowgauge/jobs/stream_job.py \
        --servers host:9092 --topic readings --alert-topic alerts \
        --raw s3a://lake/raw --windows s3a://lake/windows --quarantine s3a://lake/quarantine \
        --checkpoints s3a://lake/checkpoints --interval "30 seconds"
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowgauge.operators.ingest import parse_messages
from flowgauge.session import job_session
from flowgauge.sinks.alert_log import AlertLog
from flowgauge.sinks.batches import (
    BatchSink,
    JdbcTable,
    TextMessages,
    TopicMessages,
    partials_parquet,
    quarantine_parquet,
    raw_parquet,
    window_parquet,
)
from flowgauge.sources.messages import MessageFiles, Topic
from flowgauge.sources.tables import jdbc_options
from flowgauge.sources.visibility import own_log
from flowgauge.streaming.queries import Pace, await_any, start_alerts, start_landing, start_windows
from flowgauge.streaming.supervision import Ledger, Supervisor


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Sensor stream job")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--topic", help="Kafka topic of the readings")
    source.add_argument("--message-files", help="directory of message files instead of a topic")
    parser.add_argument("--message-format", default="text", choices=["text", "parquet"])
    parser.add_argument("--servers", help="Kafka bootstrap servers")
    parser.add_argument("--max-offsets", type=int, help="most messages per micro-batch")
    parser.add_argument("--max-files", type=int, help="most files per micro-batch")
    parser.add_argument("--min-partitions", type=int, help="split topic partitions further")

    raw = parser.add_mutually_exclusive_group(required=True)
    raw.add_argument("--raw", help="directory of the raw table")
    raw.add_argument("--raw-table", help="database table of the raw readings")
    windows = parser.add_mutually_exclusive_group(required=True)
    windows.add_argument("--windows", help="directory of the window table")
    windows.add_argument("--window-table", help="database table of the window aggregates")
    alerts = parser.add_mutually_exclusive_group(required=True)
    alerts.add_argument("--alert-topic", help="Kafka topic of the alerts")
    alerts.add_argument("--alert-files", help="directory of alert text files instead of a topic")
    alerts.add_argument(
        "--alert-log", help="directory of the alert log instead of a topic, written by the raw query"
    )
    parser.add_argument("--partials", help="directory of hourly partials, for reports")
    parser.add_argument("--quarantine", required=True, help="directory of rejected messages")

    parser.add_argument("--jdbc-url")
    parser.add_argument("--jdbc-user")
    parser.add_argument("--jdbc-password-env", help="environment variable that holds the password")
    parser.add_argument("--jdbc-driver")
    parser.add_argument("--jdbc-connections", type=int, default=16, help="writers of a batch")

    parser.add_argument("--checkpoints", required=True, help="durable directory, one part per query")
    parser.add_argument("--interval", help="trigger interval; none means as fast as possible")
    parser.add_argument("--available-now", action="store_true", help="stop when all is processed")
    parser.add_argument(
        "--share-parse",
        action="store_true",
        help="send alerts from the raw query, so that messages are read and parsed once less",
    )
    parser.add_argument("--state-partitions", type=int, help="fixed at the first start")
    chosen = parser.parse_args(argv)
    if (chosen.topic or chosen.alert_topic) and not chosen.servers:
        parser.error("a topic needs --servers")
    if chosen.partials and not chosen.raw:
        parser.error("partials need --raw, whose log they share")
    if (chosen.raw_table or chosen.window_table) and not chosen.jdbc_url:
        parser.error("a database table needs --jdbc-url")
    return chosen


def messages(spark: SparkSession, chosen: argparse.Namespace) -> DataFrame:
    if chosen.topic:
        topic = Topic(chosen.servers, chosen.topic, chosen.max_offsets, chosen.min_partitions)
        return topic.stream(spark)
    files = MessageFiles(chosen.message_files, chosen.message_format, chosen.max_files)
    return files.stream(spark)


def database(chosen: argparse.Namespace, table: str) -> JdbcTable:
    password = os.environ[chosen.jdbc_password_env] if chosen.jdbc_password_env else ""
    login = {"user": chosen.jdbc_user, "password": password, "driver": chosen.jdbc_driver}
    return JdbcTable(jdbc_options(chosen.jdbc_url, table, **login), chosen.jdbc_connections)


def start(spark: SparkSession, chosen: argparse.Namespace) -> list[StreamingQuery]:
    """Start the queries: three, or two when the raw query also sends the alerts. What they go through
    is entered beside their checkpoints."""
    names = ("raw", "windows", "alerts")
    ledger = Ledger(f"{chosen.checkpoints}/events")
    places = {name: f"{chosen.checkpoints}/{name}" for name in names}
    spark.streams.addListener(Supervisor(spark, ledger, places))
    parsed = parse_messages(messages(spark, chosen))
    pace = Pace(chosen.interval, chosen.available_now)
    raw = raw_parquet(chosen.raw) if chosen.raw else database(chosen, chosen.raw_table)
    if chosen.windows:
        windows: BatchSink = window_parquet(chosen.windows)
    else:
        windows = database(chosen, chosen.window_table)

    shared: BatchSink | None = None
    if chosen.share_parse and chosen.alert_topic:
        shared = TopicMessages(chosen.servers, chosen.alert_topic)
    elif chosen.alert_log:
        shared = AlertLog(chosen.alert_log)
    elif chosen.share_parse:
        shared = TextMessages(chosen.alert_files)

    started = [
        start_landing(
            parsed,
            raw,
            f"{chosen.checkpoints}/raw",
            quarantine=quarantine_parquet(chosen.quarantine),
            alerts=shared,
            partials=partials_parquet(chosen.partials) if chosen.partials else None,
            pace=pace,
            name="raw",
            log=own_log(chosen.raw or chosen.quarantine),
        ),
        start_windows(
            parsed, windows, f"{chosen.checkpoints}/windows", pace=pace, name="windows"
        ),
    ]
    if shared is None:
        if chosen.alert_topic:
            kind = "kafka"
            options = TopicMessages(chosen.servers, chosen.alert_topic).options()
        else:
            kind, options = "text", {"path": chosen.alert_files}
        place = f"{chosen.checkpoints}/alerts"
        started.append(start_alerts(parsed, kind, options, place, pace=pace, name="alerts"))
    return started


def main(argv: list[str] | None = None) -> None:
    chosen = arguments(argv)
    extra = {}
    if chosen.state_partitions:
        extra["spark.sql.shuffle.partitions"] = str(chosen.state_partitions)
    spark = job_session("sensor-stream", extra)
    started = start(spark, chosen)
    if chosen.available_now:
        for query in started:
            query.awaitTermination()
    else:
        await_any(spark)


if __name__ == "__main__":
    main()
