import os
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.catalog import REGISTERED
from flowgauge.jobs import report_job, stream_job
from flowgauge.operators.rollup import trailing_readings
from flowgauge.plans.report import congestion_report
from flowgauge.session import BATCH_DEFAULTS, job_session, scratch_path, shared_dir
from flowgauge.sinks.batches import JdbcTable, TopicMessages, raw_parquet
from flowgauge.sinks.report_files import current_report, read_csv
from flowgauge.sources.messages import MessageFiles, Topic
from flowgauge.sources.tables import (
    as_messages,
    event_readings,
    jdbc_options,
    newest_options,
    raw_dates,
    raw_table,
    spread_options,
    trailing_raw,
)
from tests.helpers import at, readings, same_rows, tuples


def stream_arguments(tmp_path, *more):
    return [
        "--message-files", str(tmp_path / "messages"),
        "--raw", str(tmp_path / "raw"),
        "--windows", str(tmp_path / "windows"),
        "--alert-files", str(tmp_path / "alerts"),
        "--quarantine", str(tmp_path / "quarantine"),
        "--checkpoints", str(tmp_path / "checkpoints"),
        "--available-now",
        *more,
    ]


@pytest.mark.parametrize("share", [[], ["--share-parse"]])
def test_stream_job_then_report_job(spark, sf_dir, tmp_path, share):
    stored = event_readings(spark, sf_dir)
    as_messages(stored).write.text(str(tmp_path / "messages"))
    queries = stream_job.start(spark, stream_job.arguments(stream_arguments(tmp_path, *share)))
    assert len(queries) == (2 if share else 3)
    for query in queries:
        query.awaitTermination()

    rows = raw_table(spark, str(tmp_path / "raw")).select(*schemas.READING_COLUMNS)
    same_rows(tuples(rows), tuples(stored.select(*schemas.READING_COLUMNS)))
    assert MessageFiles(str(tmp_path / "alerts")).read(spark).count() == 1816
    chosen = report_job.arguments(["--raw", str(tmp_path / "raw"), "--out", "unused"])
    report = report_job.report_of(spark, chosen)
    day = datetime(2024, 1, 30).date()
    assert report_job.write_report(report, str(tmp_path / "out"), day)
    written = read_csv(spark, f"{current_report(spark, str(tmp_path / 'out'), day)}/report", schemas.REPORT)

    def comparable(df):
        return tuples(df.withColumns({c: F.round(c, 6) for c in ("avg_speed", "congestion_score")}))

    same_rows(comparable(written), comparable(congestion_report(stored).rows))


def test_report_reads_only_the_trailing_dates(spark, sf_dir, tmp_path):
    """The newest date is a folder's name: no scan of the probe opens or lists an older date."""
    path = str(tmp_path / "raw")
    raw_parquet(path)(event_readings(spark, sf_dir).drop("event_id"), 0)
    assert raw_dates(spark, path) == [datetime(2024, 1, 1).date() + timedelta(days=d) for d in range(30)]
    rows, newest = trailing_raw(spark, path)
    assert newest == datetime(2024, 1, 30, 23, 57, 12, 194062)
    days = {name.split("event_date=")[1][:10] for name in rows.inputFiles()}
    assert days == {"2024-01-29", "2024-01-30"}
    recent = trailing_readings(rows, newest=newest, date_column="event_date")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(event_date" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(event_time,2024-01-29T" in plan
    assert recent.count() == trailing_readings(event_readings(spark, sf_dir)).count()


def test_newest_date_without_rows(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert trailing_raw(spark, path)[1] is None
    assert congestion_report(trailing_raw(spark, path)[0]).is_empty()
    raw_parquet(path)(readings(spark, ("a", "10:00:00", 1, 1.0)), 0)
    (tmp_path / "raw/event_date=2026-05-10").mkdir()
    rows, newest = trailing_raw(spark, path)
    assert newest == at("10:00:00") and rows.count() == 1


def test_what_spark_submit_sets_stands(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert job_session("x", defaults=BATCH_DEFAULTS).conf.get(key) == "2000"
        spark.conf.set(key, "50000")
        assert job_session("x", defaults=BATCH_DEFAULTS).conf.get(key) == "50000"
    finally:
        for name in BATCH_DEFAULTS:
            spark.conf.unset(name)


def test_queries_leave_the_callers_zone_alone(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = tuples(REGISTERED["hourly_rollup"](spark, sf_dir))
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == tuples(REGISTERED["hourly_rollup"](spark, sf_dir))


def test_nothing_is_kept_once_the_report_is_written(spark, sf_dir, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr("flowgauge.session.shared_dir", lambda _: str(shared))
    report = congestion_report(event_readings(spark, sf_dir))
    assert list(shared.iterdir())
    assert report_job.write_report(report, str(tmp_path / "out"), datetime(2024, 1, 30).date())
    assert not list(shared.iterdir())
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["report_date=2024-01-30"]


@pytest.mark.parametrize(
    "argv",
    [
        ["--topic", "t", "--raw", "r", "--windows", "w", "--alert-topic", "a"],
        ["--message-files", "m", "--raw-table", "r", "--windows", "w", "--alert-files", "a"],
        ["--raw", "r", "--windows", "w", "--alert-files", "a"],
    ],
)
def test_incomplete_arguments_are_refused(argv, capsys):
    with pytest.raises(SystemExit):
        stream_job.arguments([*argv, "--quarantine", "q", "--checkpoints", "c"])
    capsys.readouterr()


def test_database_report_needs_its_url(capsys):
    with pytest.raises(SystemExit):
        report_job.arguments(["--raw-table", "t", "--out", "o"])
    capsys.readouterr()


def test_topic_options():
    topic = Topic("host:9092", "readings", max_offsets_per_trigger=10, min_partitions=8)
    assert topic.options("latest", streaming=True) == {
        "kafka.bootstrap.servers": "host:9092",
        "subscribe": "readings",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "10",
        "minPartitions": "8",
    }
    assert "maxOffsetsPerTrigger" not in topic.options("earliest", streaming=False)
    assert TopicMessages("host:9092", "alerts", {"kafka.acks": "all"}).options() == {
        "kafka.bootstrap.servers": "host:9092",
        "topic": "alerts",
        "kafka.acks": "all",
    }


def test_jdbc_options_have_no_default_login(monkeypatch):
    assert jdbc_options("jdbc:x", "t", user=None, password="", driver=None) == {
        "url": "jdbc:x",
        "dbtable": "t",
    }
    monkeypatch.setenv("DB_SECRET", "hidden")
    chosen = stream_job.arguments(
        [
            "--message-files", "m", "--raw-table", "readings", "--window-table", "windows",
            "--alert-files", "a", "--quarantine", "q", "--checkpoints", "c",
            "--jdbc-url", "jdbc:x", "--jdbc-user", "me", "--jdbc-password-env", "DB_SECRET",
        ]
    )
    table = stream_job.database(chosen, chosen.raw_table)
    assert isinstance(table, JdbcTable)
    assert table.options() == {
        "url": "jdbc:x",
        "dbtable": "readings",
        "user": "me",
        "password": "hidden",
        "batchsize": "10000",
    }


def test_database_read_is_split_and_asks_for_the_newest_time():
    connection = jdbc_options("jdbc:x", "readings", user="me")
    assert newest_options(connection) == {
        "url": "jdbc:x",
        "user": "me",
        "query": "SELECT MAX(event_time) AS newest FROM readings",
        "preferTimestampNTZ": "true",
    }
    split = spread_options(connection, datetime(2026, 5, 8), datetime(2026, 5, 9, 1, 2, 3), 16)
    assert split["dbtable"] == "readings"
    assert split["partitionColumn"] == "event_time"
    assert split["lowerBound"] == "2026-05-08 00:00:00"
    assert split["upperBound"] == "2026-05-09 01:02:03"
    assert split["numPartitions"] == "16"


@pytest.mark.parametrize("newest", [datetime(2024, 1, 30, 23, 57, 12, 194062), None])
def test_database_report(spark, sf_dir, monkeypatch, newest):
    """The report job over a table whose reader is replaced by the events."""
    asked = []

    def read(spark, connection, since, until, partitions):
        asked.append((connection["dbtable"], since, until, partitions))
        return event_readings(spark, sf_dir).select(*schemas.READING_COLUMNS)

    monkeypatch.setattr(report_job, "jdbc_newest", lambda spark, connection: newest)
    monkeypatch.setattr(report_job, "jdbc_readings", read)
    chosen = report_job.arguments(["--raw-table", "t", "--jdbc-url", "jdbc:x", "--out", "unused"])
    report = report_job.report_of(spark, chosen)
    if newest is None:
        assert report.is_empty() and not asked
    else:
        assert asked == [("t", newest - timedelta(hours=24), newest, 16)]
        assert report.hourly.count() == 113


def test_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize(
    "warehouse, master, fine",
    [
        ("file:/tmp/nowhere/warehouse", "local[2]", True),
        ("/tmp/nowhere/warehouse", "spark://host:7077", False),
        ("file:/tmp/nowhere/warehouse", "yarn", False),
        ("s3a://lake/warehouse", "yarn", True),
    ],
)
def test_without_a_setting_the_warehouse_holds_it(warehouse, master, fine):
    values = {"spark.sql.warehouse.dir": warehouse}
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: values.get(key, default)),
        sparkContext=SimpleNamespace(applicationId="app-1", master=master),
    )
    if fine:
        assert shared_dir(session) == f"{warehouse}/scratch-app-1"
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session)


def test_no_credentials_in_the_package():
    root = os.path.join(os.path.dirname(os.path.dirname(__file__)), "flowgauge")
    for folder, _, files in os.walk(root):
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file)) as source:
                    assert "password=" not in source.read().replace("password=password", "")
