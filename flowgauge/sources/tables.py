"""Stored readings: the raw table, a database table, and the events table seen as readings."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import rules, schemas
from flowgauge.folders import Folder
from flowgauge.functions.timestamps import literal_time
from flowgauge.functions.wire import json_int, reading_json
from flowgauge.operators.rollup import newest_reading
from flowgauge.sources.visibility import Snapshot, own_log, snapshot, snapshots

EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING"
)


# Files of the events table that a micro-batch takes.
STREAM_FILES = 64


def events_path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def as_readings(events: DataFrame) -> DataFrame:
    """Events in the shape of readings; `event_time` stays the bare column so that bounds on it
    reach the scan."""
    count = json_int(F.col("props"), "k")
    return events.select(
        "event_id",
        F.col("event_type").alias("sensor_id"),
        F.col("ts").alias("event_time"),
        count.alias("vehicle_count"),
        F.col("value").alias("avg_speed"),
    )


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(spark.read.schema(EVENTS).parquet(events_path(sf_dir)))


def stream_event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of readings.

    As a pattern the path may name one file or a directory; a plain path may not name a file.
    """
    files = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", STREAM_FILES)
    return as_readings(files.parquet(f"{events_path(sf_dir)}*"))


def as_messages(readings: DataFrame) -> DataFrame:
    """Readings encoded as the messages a sensor sends."""
    fields = [F.col(c) for c in schemas.READING_COLUMNS]
    return readings.select(reading_json(*fields).alias("value"))


def raw_dates(spark: SparkSession, path: str) -> list[date]:
    """Dates of the raw table, by the names of its folders."""
    return sorted(date.fromisoformat(v) for v in Folder(spark, path).values("event_date"))


def raw_table(
    spark: SparkSession,
    path: str,
    dates: list[date] | None = None,
    seen: Snapshot | None = None,
) -> DataFrame:
    """The rows of the raw table that count, with its partition columns event_date, query_id and
    batch_id; of the dates alone if some are given, so that no other folder is listed. `seen` reads
    it as it was when the snapshot was taken."""
    seen = seen or snapshot(spark, path, days=dates)
    reader = spark.read.schema(schemas.RAW_TABLE).option("basePath", path)
    if dates is None:
        rows = reader.parquet(path)
    else:
        rows = reader.parquet(*[f"{path}/event_date={d.isoformat()}" for d in dates])
    return rows.filter(seen.visible("event_date"))


def trailing_raw(
    spark: SparkSession, path: str, hours: int = rules.TRAILING_HOURS
) -> tuple[DataFrame, datetime | None]:
    """(rows of the dates that the trailing hours touch, newest event time).

    The log of the landing query knows the newest time. Without it the newest date is known by its
    folder's name, and its times alone are read for the newest of them. Older dates are not even
    listed.
    """
    dates = raw_dates(spark, path)
    newest = own_log(path).newest(spark)
    while dates and newest is None:
        newest = newest_reading(raw_table(spark, path, dates[-1:]))
        if newest is None:
            dates.pop()
    if not dates or newest is None:
        return no_readings(spark).withColumn("event_date", F.lit(None).cast("date")), None
    first = (newest - timedelta(hours=hours)).date()
    return raw_table(spark, path, [d for d in dates if d >= first]), newest


def newest_of(spark: SparkSession, path: str) -> datetime | None:
    """The newest event time of the raw table, None without readings."""
    return own_log(path).newest(spark) or trailing_raw(spark, path)[1]


def trailing_partials(
    spark: SparkSession, raw: str, partials: str, newest: datetime, hours: int = rules.TRAILING_HOURS
) -> tuple[DataFrame, DataFrame]:
    """(hourly partials of the whole hours of the trailing ones, readings of the hour that their bound
    cuts), as of the same micro-batches. No other reading is read, and no other date is listed. Fails
    if some of the readings were stored without partials."""
    since = newest - timedelta(hours=hours)
    if not own_log(raw).covers(spark, since):
        raise ValueError(f"some readings since {since} were stored without partials")
    cut = since.replace(minute=0, second=0, microsecond=0)
    whole = cut if cut == since else cut + timedelta(hours=1)
    days = [since.date() + timedelta(days=n) for n in range((newest.date() - since.date()).days + 1)]
    seen_raw, seen = snapshots(spark, [raw, partials], own_log(raw), days)
    reader = spark.read.schema(schemas.HOURLY_PARTIALS).option("basePath", partials)
    stored = [f"{partials}/hour_date={d.isoformat()}" for d in days]
    there = [path for path in stored if Folder(spark, path).exists()]
    kept = reader.parquet(*there) if there else spark.createDataFrame([], schemas.HOURLY_PARTIALS)
    if there:
        kept = kept.filter(seen.visible("hour_date"))
    kept = kept.filter(F.col("hour_bucket") >= literal_time(whole))
    if whole == cut or since.date() not in raw_dates(spark, raw):
        return kept, no_readings(spark)
    edge = raw_table(spark, raw, [since.date()], seen_raw).filter(
        (F.col("event_time") >= literal_time(since)) & (F.col("event_time") < literal_time(whole))
    )
    return kept, edge.select(*schemas.READING_COLUMNS)


def window_table(spark: SparkSession, path: str, seen: Snapshot | None = None) -> DataFrame:
    """The windows that count."""
    seen = seen or snapshot(spark, path)
    return spark.read.schema(schemas.WINDOW_TABLE).parquet(path).filter(seen.visible("window_date"))


def quarantine_table(
    spark: SparkSession, path: str, seen: Snapshot | None = None
) -> DataFrame:
    """Messages set aside; with the raw table's snapshot, those of the batches that it shows."""
    rows = spark.read.schema(schemas.QUARANTINE_TABLE).parquet(path)
    return rows.filter((seen or Snapshot()).visible())


def alert_table(spark: SparkSession, path: str, seen: Snapshot | None = None) -> DataFrame:
    """Alert messages that the landing query sent to files, with query_id and batch_id."""
    rows = spark.read.schema(schemas.ALERT_TABLE).text(path)
    return rows.filter((seen or Snapshot()).visible())


def jdbc_options(url: str, table: str, **login: str) -> dict[str, str]:
    """Connection options; user, password and driver have no defaults here."""
    return {"url": url, "dbtable": table, **{k: v for k, v in login.items() if v}}


def newest_options(connection: dict[str, str]) -> dict[str, str]:
    """Options that let the database find the newest event time; a read of the table would fetch
    every time to Spark for it."""
    login = {key: value for key, value in connection.items() if key != "dbtable"}
    query = f"SELECT MAX(event_time) AS newest FROM {connection['dbtable']}"
    return {**login, "query": query, "preferTimestampNTZ": "true"}


def spread_options(
    connection: dict[str, str], since: datetime, until: datetime, partitions: int
) -> dict[str, str]:
    """Options that split a read by event time into one query per partition. The bounds set the
    stride only; they leave no row out."""
    return {
        **connection,
        "partitionColumn": "event_time",
        "lowerBound": since.isoformat(sep=" "),
        "upperBound": until.isoformat(sep=" "),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
        "preferTimestampNTZ": "true",
    }


def jdbc_newest(spark: SparkSession, connection: dict[str, str]) -> datetime | None:
    """The newest event time of a database table, None when it has no rows."""
    return spark.read.format("jdbc").options(**newest_options(connection)).load().head()[0]


def jdbc_readings(
    spark: SparkSession,
    connection: dict[str, str],
    since: datetime,
    until: datetime,
    partitions: int,
) -> DataFrame:
    """Readings of a database table."""
    options = spread_options(connection, since, until, partitions)
    rows = spark.read.format("jdbc").options(**options).load()
    return rows.select(*schemas.READING_COLUMNS)


def no_readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.READING)
