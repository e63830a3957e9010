"""The registered queries: every operator over the whole events table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.fixtures import FILES, SENSORS, SLICES, Replay, faulty
from flowgauge.functions.wire import reading_json
from flowgauge.operators.alerts import alert_messages, parse_alerts, with_status
from flowgauge.operators.ingest import (
    keeps_contract,
    parse_messages,
    project_readings,
    quarantined,
    valid_readings,
)
from flowgauge.operators.ranking import dense_rank_by_score, scored
from flowgauge.operators.rollup import (
    hourly_traffic,
    latest_event_time,
    merged_partials,
    trailing_readings,
)
from flowgauge.operators.windows import window_congestion
from flowgauge.plans.report import CongestionReport, congestion_report
from flowgauge.plans.report import report_from_partials as report_of_partials
from flowgauge.session import in_utc, materialise, scratch_path
from flowgauge.sinks.alert_log import AlertLog, alerts_after, segment_of
from flowgauge.sinks.batch_log import BatchLog
from flowgauge.sinks.batches import (
    BatchSink,
    TextMessages,
    partials_parquet,
    quarantine_parquet,
    raw_parquet,
    window_parquet,
)
from flowgauge.sinks.compaction import compact_day
from flowgauge.sinks.report_files import read_csv, write_csv
from flowgauge.sources.messages import MessageFiles
from flowgauge.sources.state import open_windows
from flowgauge.sources.tables import (
    alert_table,
    as_messages,
    event_readings,
    newest_of,
    quarantine_table,
    raw_dates,
    raw_table,
    stream_event_readings,
    trailing_partials,
    trailing_raw,
    window_table,
)
from flowgauge.sources.visibility import own_log, snapshot
from flowgauge.streaming.queries import Pace, start_alerts, start_landing, start_windows

Query = Callable[[SparkSession, str], DataFrame]

REGISTERED: dict[str, Query] = {}
ONCE = Pace(available_now=True)


def registered(query: Query) -> Query:
    """Register under the function's name, in a session pinned to UTC."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(in_utc(spark), sf_dir)

    REGISTERED[query.__name__] = run
    return query


def rounded(rows: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six places: their sums depend on the order of addition."""
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def wire_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(as_messages(event_readings(spark, sf_dir)))


def wire_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_messages(as_messages(stream_event_readings(spark, sf_dir)))


def report_of(spark: SparkSession, sf_dir: str) -> CongestionReport:
    return congestion_report(event_readings(spark, sf_dir))


# --- messages, readings, contract ---------------------------------------------------------------


@registered
def wire_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as message text."""
    readings = event_readings(spark, sf_dir)
    text = reading_json(*[F.col(c) for c in schemas.READING_COLUMNS])
    return readings.select("event_id", text.alias("value"))


@registered
def parse_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings encoded as messages and parsed again."""
    return project_readings(wire_parsed(spark, sf_dir))


@registered
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw projection."""
    return event_readings(spark, sf_dir).select("event_id", *schemas.READING_COLUMNS)


@registered
def raw_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table as the streaming query writes it."""
    place = scratch_path(spark, "raw")
    start_landing(
        wire_stream(spark, sf_dir),
        raw_parquet(f"{place}/raw"),
        f"{place}/checkpoint",
        quarantine=quarantine_parquet(f"{place}/quarantine"),
        pace=ONCE,
    ).awaitTermination()
    return raw_table(spark, f"{place}/raw").select("event_date", *schemas.READING_COLUMNS)


@registered
def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings keep the NOT NULL contract."""
    outcome = F.when(keeps_contract(), "valid").otherwise("quarantine")
    return event_readings(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@registered
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken messages by what they lack."""
    broken = quarantined(parse_messages(faulty(event_readings(spark, sf_dir))))
    return broken.groupBy("missing").agg(
        F.count("*").alias("n"), F.count("value").alias("with_text")
    )


@registered
def valid_after_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings left of messages some of which are broken."""
    return valid_readings(parse_messages(faulty(event_readings(spark, sf_dir))))


# --- windows ------------------------------------------------------------------------------------


@registered
def window_congestion_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute windows over the stored readings."""
    windows = window_congestion(event_readings(spark, sf_dir))
    return rounded(windows, "avg_speed", "congestion_index")


@registered
def window_congestion_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows a stream over the same messages has closed."""
    place = scratch_path(spark, "windows")
    start_windows(
        wire_stream(spark, sf_dir),
        window_parquet(f"{place}/windows"),
        f"{place}/checkpoint",
        pace=ONCE,
    ).awaitTermination()
    windows = window_table(spark, f"{place}/windows").select(*schemas.WINDOW_COLUMNS)
    return rounded(windows, "avg_speed", "congestion_index")


@registered
def window_congestion_faulty_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over messages some of which are broken: those count for nothing."""
    place = scratch_path(spark, "windows")
    faulty(event_readings(spark, sf_dir)).filter("value IS NOT NULL").write.text(f"{place}/in")
    start_windows(
        parse_messages(MessageFiles(f"{place}/in").stream(spark)),
        window_parquet(f"{place}/windows"),
        f"{place}/checkpoint",
        pace=ONCE,
    ).awaitTermination()
    windows = window_table(spark, f"{place}/windows").select(*schemas.WINDOW_COLUMNS)
    return rounded(windows, "avg_speed", "congestion_index")


@registered
def window_congestion_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of readings that come in order of time, in bounded batches and over a restart,
    with one sensor's readings of a slice too late."""
    place = scratch_path(spark, "replay")
    replay = Replay(spark, sf_dir, f"{place}/in")
    for part in (range(0, 3), range(3, SLICES)):
        replay.deliver(part)
        start_windows(
            parse_messages(MessageFiles(f"{place}/in", max_files_per_trigger=FILES).stream(spark)),
            window_parquet(f"{place}/windows"),
            f"{place}/checkpoint",
            pace=ONCE,
        ).awaitTermination()
    windows = window_table(spark, f"{place}/windows").select(*schemas.WINDOW_COLUMNS)
    return rounded(windows, "avg_speed", "congestion_index")


@registered
def windows_closed_and_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the same replay, and those that are open after it, from the query's state."""
    place = scratch_path(spark, "open")
    replay = Replay(spark, sf_dir, f"{place}/in")
    for part in (range(0, 3), range(3, SLICES)):
        replay.deliver(part)
        start_windows(
            parse_messages(MessageFiles(f"{place}/in", max_files_per_trigger=FILES).stream(spark)),
            window_parquet(f"{place}/windows"),
            f"{place}/checkpoint",
            pace=ONCE,
        ).awaitTermination()
    closed = window_table(spark, f"{place}/windows").select(*schemas.WINDOW_COLUMNS)
    still_open = open_windows(spark, f"{place}/checkpoint")
    both = closed.withColumn("closed", F.lit(True)).unionByName(
        still_open.withColumn("closed", F.lit(False))
    )
    return rounded(both, "avg_speed", "congestion_index")


# --- micro-batches ------------------------------------------------------------------------------


class Fails:
    """A sink that fails in one batch after it has written it, as a driver may between two outputs."""

    def __init__(self, sink: BatchSink, batch: int) -> None:
        self.sink, self.batch = sink, batch

    def for_query(self, query_id: str) -> Fails:
        return Fails(self.sink.for_query(query_id), self.batch)

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        self.sink(rows, batch_id)
        if batch_id == self.batch:
            raise InterruptedError(f"batch {batch_id} is cut off")


def landed_over_a_crash(spark: SparkSession, sf_dir: str, place: str) -> BatchLog:
    """Faulty messages in order of time, a slice per micro-batch. The driver goes down in the third
    batch when its messages set aside, but neither its alerts nor its partials, are written."""
    replay = Replay(spark, sf_dir, f"{place}/in", faulty)
    replay.deliver(range(SLICES))
    log = own_log(f"{place}/raw")
    for quarantine in (Fails(quarantine_parquet(f"{place}/quarantine"), 2), quarantine_parquet(f"{place}/quarantine")):
        query = start_landing(
            parse_messages(MessageFiles(f"{place}/in", max_files_per_trigger=FILES).stream(spark)),
            raw_parquet(f"{place}/raw"),
            f"{place}/checkpoint",
            quarantine=quarantine,
            alerts=TextMessages(f"{place}/alerts"),
            partials=partials_parquet(f"{place}/partials"),
            pace=ONCE,
            log=log,
        )
        try:
            query.awaitTermination()
        except StreamingQueryException:
            spark.streams.resetTerminated()
    return log


@registered
def landed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crashed and resumed landing query has stored, set aside and alerted, as of the same
    micro-batches: readings and alerts by sensor, broken messages by what they lack."""
    place = scratch_path(spark, "landed")
    landed_over_a_crash(spark, sf_dir, place)
    seen = snapshot(spark, f"{place}/raw")
    by_sensor = F.col("sensor_id").alias("name")
    outputs = [
        ("raw", raw_table(spark, f"{place}/raw", seen=seen).select("batch_id", by_sensor)),
        ("quarantine", quarantine_table(spark, f"{place}/quarantine", seen).select("batch_id", F.col("missing").alias("name"))),
        ("alerts", parse_alerts(alert_table(spark, f"{place}/alerts", seen), "batch_id").select("batch_id", by_sensor)),
    ]
    every = reduce(DataFrame.unionByName, [rows.withColumn("output", F.lit(kind)) for kind, rows in outputs])
    return every.groupBy("output", "batch_id", "name").agg(F.count("*").alias("n"))


@registered
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log of that query tells of every micro-batch: messages stored, set aside and alerted,
    the least and greatest event time, and the newest so far."""
    place = scratch_path(spark, "counted")
    entries = landed_over_a_crash(spark, sf_dir, place).table(spark)
    return entries.select("batch_id", "valid", "broken", "alerts", "least", "greatest", "newest")


@registered
def report_from_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from hourly partials that the stream keeps, over late readings and a restart, the
    newest date's folded together before."""
    place = scratch_path(spark, "partials")
    replay = Replay(spark, sf_dir, f"{place}/in")
    for part in (range(0, 3), range(3, SLICES)):
        replay.deliver(part)
        start_landing(
            parse_messages(MessageFiles(f"{place}/in", max_files_per_trigger=FILES).stream(spark)),
            raw_parquet(f"{place}/raw"),
            f"{place}/checkpoint",
            partials=partials_parquet(f"{place}/partials"),
            pace=ONCE,
        ).awaitTermination()
    table, committed = partials_parquet(f"{place}/partials"), own_log(f"{place}/raw").committed(spark)
    newest = newest_of(spark, f"{place}/raw")
    compact_day(spark, table, schemas.HOURLY_PARTIALS, newest.date(), committed, merged_partials)
    parts = trailing_partials(spark, f"{place}/raw", f"{place}/partials", newest)
    return rounded(report_of_partials(*parts).rows, "avg_speed", "congestion_score")


# --- alerts -------------------------------------------------------------------------------------


@registered
def critical_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages."""
    return alert_messages(event_readings(spark, sf_dir))


@registered
def critical_alerts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages as the streaming query sends them."""
    place = scratch_path(spark, "alerts")
    start_alerts(
        wire_stream(spark, sf_dir),
        "text",
        {"path": f"{place}/alerts"},
        f"{place}/checkpoint",
        pace=ONCE,
    ).awaitTermination()
    return MessageFiles(f"{place}/alerts").read(spark)


@registered
def alerts_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages written out, read from the beginning and parsed."""
    place = scratch_path(spark, "alerts")
    alert_messages(event_readings(spark, sf_dir)).write.text(place)
    return parse_alerts(MessageFiles(place).read(spark))


@registered
def alerts_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as a reader of the log gets them: first those of three micro-batches, then, when these
    are merged and further ones have come, the rest. `read` says in which turn."""
    place = scratch_path(spark, "followed")
    replay = Replay(spark, sf_dir, f"{place}/in")
    position, turns = None, []
    for turn, part in enumerate((range(0, 3), range(3, SLICES))):
        replay.deliver(part)
        start_landing(
            parse_messages(MessageFiles(f"{place}/in", max_files_per_trigger=FILES).stream(spark)),
            raw_parquet(f"{place}/raw"),
            f"{place}/checkpoint",
            alerts=AlertLog(f"{place}/alerts"),
            pace=ONCE,
        ).awaitTermination()
        log = own_log(f"{place}/raw")
        rows, position = alerts_after(spark, f"{place}/alerts", position, log)
        turns.append(parse_alerts(rows, "batch").withColumn("read", F.lit(turn)))
        compact_day(
            spark,
            AlertLog(f"{place}/alerts"),
            schemas.ALERT_LOG,
            segment_of(0),
            log.committed(spark),
        )
    return turns[0].unionByName(turns[1])


@registered
def event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every reading."""
    return with_status(event_readings(spark, sf_dir)).select("event_id", "status")


# --- report -------------------------------------------------------------------------------------


@registered
def latest_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event time."""
    return latest_event_time(event_readings(spark, sf_dir))


@registered
def trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of the trailing day."""
    recent = trailing_readings(event_readings(spark, sf_dir))
    return recent.select("event_id", *schemas.READING_COLUMNS)


@registered
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rollup of the trailing day, in order."""
    hourly = hourly_traffic(trailing_readings(event_readings(spark, sf_dir)))
    return rounded(hourly, "avg_speed").orderBy("hour_bucket", "sensor_id")


@registered
def peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak hours of the trailing day, in order."""
    return rounded(report_of(spark, sf_dir).peaks, "avg_speed").orderBy("sensor_id")


@registered
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: peak hours with score, rank and labels."""
    return rounded(report_of(spark, sf_dir).rows, "avg_speed", "congestion_score")


@registered
def report_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as CSV and read back."""
    place = scratch_path(spark, "report")
    write_csv(report_of(spark, sf_dir).rows, place, ["sensor_id", "hour_bucket"])
    return rounded(read_csv(spark, place, schemas.REPORT), "avg_speed", "congestion_score")


@registered
def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sensor-hour of the whole history ranked by score."""
    ranked = dense_rank_by_score(materialise(scored(hourly_traffic(event_readings(spark, sf_dir)))))
    return rounded(ranked, "avg_speed", "congestion_score")


@registered
def report_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from the raw table that the stream wrote, its newest dates compacted before."""
    place = scratch_path(spark, "lake")
    start_landing(
        wire_stream(spark, sf_dir), raw_parquet(f"{place}/raw"), f"{place}/checkpoint", pace=ONCE
    ).awaitTermination()
    committed = own_log(f"{place}/raw").committed(spark)
    for day in raw_dates(spark, f"{place}/raw")[-2:]:
        compact_day(spark, raw_parquet(f"{place}/raw"), schemas.RAW_TABLE, day, committed)
    rows, latest = trailing_raw(spark, f"{place}/raw")
    report = congestion_report(rows, date_column="event_date", newest=latest)
    return rounded(report.rows, "avg_speed", "congestion_score")


# --- chart and table ----------------------------------------------------------------------------


@registered
def hourly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles per hour and sensor, one column per sensor."""
    return report_of(spark, sf_dir).matrix(SENSORS).orderBy("hour_bucket")


@registered
def sensor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row per sensor."""
    return report_of(spark, sf_dir).matrix_by_sensor()


@registered
def hour_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis labels of the chart."""
    return report_of(spark, sf_dir).ticks()


@registered
def report_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as printed."""
    return report_of(spark, sf_dir).display()
