"""Raw history, window aggregates and alerts as streaming queries over one parsed stream.

Each query has its own checkpoint and offsets; what one query writes in a micro-batch becomes visible
together.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.storagelevel import StorageLevel

from flowgauge import rules
from flowgauge.folders import Folder
from flowgauge.operators.alerts import alert_messages
from flowgauge.operators.ingest import keeps_contract, quarantined, valid_readings, with_watermark
from flowgauge.operators.rollup import hourly_partials
from flowgauge.operators.windows import window_partials, windows_from
from flowgauge.sinks.batch_log import BatchLog
from flowgauge.sinks.batches import BatchSink, ParquetTable
from flowgauge.sources.visibility import own_log

WINDOW_SETTINGS = {
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@dataclass(frozen=True)
class Pace:
    """When micro-batches run: every `interval`, or once through all there is; with neither, as
    soon as the last one is done."""

    interval: str | None = None
    available_now: bool = False

    def apply(self, writer: DataStreamWriter) -> DataStreamWriter:
        if self.available_now:
            return writer.trigger(availableNow=True)
        if self.interval:
            return writer.trigger(processingTime=self.interval)
        return writer


def start_landing(
    parsed: DataFrame,
    raw: BatchSink,
    checkpoint: str,
    quarantine: BatchSink | None = None,
    alerts: BatchSink | None = None,
    partials: BatchSink | None = None,
    pace: Pace = Pace(),
    name: str | None = None,
    log: BatchLog | None = None,
) -> StreamingQuery:
    """Store every valid reading, late ones included, and set the others aside.

    With an alert sink the alerts leave in the same query; with one for partials, so do the sums that
    the hourly rollup is merged from, to which late readings and replays add what they should. Each micro-batch is parsed once and kept
    while its outputs are written; a lost executor's part is read and parsed again. The source's
    limit per trigger bounds what is kept.

    The log (the raw table's own, if it is a table of files) gets its entry when all outputs are
    written, and with it they become visible together. What it tells of a batch is counted while
    the outputs are written.
    """
    entered = Entered(checkpoint, log or log_of(raw))
    outputs = [
        (raw, valid_readings, "valid", {"least": F.min("event_time"), "greatest": F.max("event_time")}),
        (quarantine, quarantined, "broken", {}),
        (alerts, alert_messages, "alerts", {}),
        (partials, lambda rows: hourly_partials(valid_readings(rows)), "partials", {}),
    ]
    wanted = [output for output in outputs if output[0] is not None]

    def land(batch: DataFrame, batch_id: int) -> None:
        if entered.holds(batch.sparkSession, batch_id):
            return
        if len(wanted) > 1:
            batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            entered.write(batch, batch_id, wanted)
        finally:
            if len(wanted) > 1:
                batch.unpersist()

    writer = parsed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(land)
    return pace.apply(writer).start(queryName=name)


def start_windows(
    parsed: DataFrame,
    sink: BatchSink,
    checkpoint: str,
    delay: str = rules.WATERMARK_DELAY,
    width: str = rules.WINDOW_WIDTH,
    pace: Pace = Pace(),
    name: str | None = None,
    log: BatchLog | None = None,
) -> StreamingQuery:
    """Emit each window once, when the watermark has passed its end; later rows for it are dropped.

    Only messages that keep the raw table's contract count, so that the windows agree with those of
    the stored history. The index of a window at a standstill is NULL, as no number would be right.
    """
    valid = parsed.filter(keeps_contract())
    closed = window_partials(with_watermark(valid, delay), width)

    entered = Entered(checkpoint, log or log_of(sink))

    def store(batch: DataFrame, batch_id: int) -> None:
        if not entered.holds(batch.sparkSession, batch_id):
            entered.write(batch, batch_id, [(sink, windows_from, "windows", {})])

    writer = (
        closed.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    with window_settings(parsed.sparkSession):
        return pace.apply(writer).start(queryName=name)


def start_alerts(
    parsed: DataFrame,
    sink_format: str,
    sink_options: dict[str, str],
    checkpoint: str,
    pace: Pace = Pace(),
    name: str | None = None,
) -> StreamingQuery:
    """Send an alert for every critical reading, late ones included, through a streaming sink
    (`kafka` with its options, or `text` with a path). A known speed is all an alert needs: a message
    that breaks the contract elsewhere still raises one, without the fields it lacks."""
    writer = (
        alert_messages(parsed)
        .writeStream.outputMode("append")
        .format(sink_format)
        .options(**sink_options)
        .option("checkpointLocation", checkpoint)
    )
    return pace.apply(writer).start(queryName=name)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a query keeps over restarts, from its checkpoint."""
    return json.loads(Folder(spark, checkpoint).text("metadata"))["id"]


def log_of(sink: BatchSink) -> BatchLog | None:
    """The log that readers of a table of files go by; other sinks have none."""
    return own_log(sink.path) if isinstance(sink, ParquetTable) else None


Output = tuple[BatchSink, Callable[[DataFrame], DataFrame], str, dict[str, Column]]


@dataclass
class Entered:
    """A query's outputs and the log that they are entered in. The query's id is read once, from the
    checkpoint, at the first batch."""

    checkpoint: str
    log: BatchLog | None
    id: str | None = None

    def query(self, spark: SparkSession) -> str:
        self.id = self.id or query_id(spark, self.checkpoint)
        return self.id

    def holds(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether the batch was entered before the query was restarted."""
        return self.log is not None and self.log.entry(spark, self.query(spark), batch_id) is not None

    def write(self, batch: DataFrame, batch_id: int, outputs: list[Output]) -> None:
        """Write the batch's outputs, each a sink, what makes its rows, and under which name they are
        counted, with further facts; then enter the batch."""
        spark, seen = batch.sparkSession, []
        for sink, rows, name, facts in outputs:
            counted = Observation()
            found = rows(batch).observe(
                counted, F.count(F.lit(1)).alias(name), *[c.alias(n) for n, c in facts.items()]
            )
            if hasattr(sink, "for_query"):
                sink = sink.for_query(self.query(spark))
            sink(found, batch_id)
            seen.append(counted)
        if self.log is not None:
            facts = {key: value for counted in seen for key, value in counted.get.items()}
            self.log.commit(spark, self.query(spark), batch_id, facts)


@contextmanager
def window_settings(spark: SparkSession) -> Iterator[None]:
    """Settings a window query takes over when it starts, put back for the session's other queries.

    Late rows are dropped by the watermark of the running batch: Spark allows chains of stateful
    operators by default and then goes by the previous batch's, so a row may join a window that is
    about to be emitted. State is kept in RocksDB, on disk: open windows grow with the sensors.
    """
    before = {key: spark.conf.get(key, None) for key in WINDOW_SETTINGS}
    for key, value in WINDOW_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def await_any(spark: SparkSession) -> None:
    """Block until one query ends, then stop the others; a failure is raised."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for query in spark.streams.active:
            query.stop()
