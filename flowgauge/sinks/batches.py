"""Writers for `foreachBatch`. A batch that is replayed after a failure replaces its first try."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F


class BatchSink(Protocol):
    """Writes a batch: at least one action over its rows, by which they are counted."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None: ...


# The query id of rows that no streaming query wrote.
NO_QUERY = "none"


@dataclass(frozen=True)
class ParquetTable:
    """Appends micro-batches to a parquet table partitioned by date, then by query and batch.

    Only the partitions of this query's batch are overwritten, and they are swapped in when the
    write commits, so a replay leaves neither duplicates nor gaps. The query's id comes from its
    checkpoint: a query that starts anew, or a second writer, counts its batches from 0 again and
    must not meet the first one's. Dates come first so that a reader's date bound prunes whole
    branches. Rows are sorted within files, which gives row groups narrow ranges. A batch is written
    by the tasks that computed it; `compaction` makes large files of closed dates.
    """

    path: str
    time_column: str | None = None
    date_column: str | None = None
    sort_by: tuple[str, ...] = ()
    query_id: str = NO_QUERY

    def for_query(self, query_id: str) -> ParquetTable:
        return replace(self, query_id=query_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.store(batch, batch_id, F.to_date(self.time_column) if self.date_column else None)

    def store(self, batch: DataFrame, batch_id: int, date: Column | None) -> None:
        rows, keys = numbered(batch, self.query_id, batch_id)
        if date is not None:
            keys.insert(0, self.date_column)
            rows = rows.withColumn(self.date_column, date)
        if self.sort_by:
            rows = rows.sortWithinPartitions(*keys, *self.sort_by)
        overwriting(rows, keys).parquet(self.path)


def numbered(batch: DataFrame, query_id: str, batch_id: int) -> tuple[DataFrame, list[str]]:
    """The rows with their query and batch, and the names of these columns."""
    columns = {"query_id": F.lit(query_id), "batch_id": F.lit(batch_id).cast("bigint")}
    return batch.withColumns(columns), list(columns)


def overwriting(rows: DataFrame, keys: list[str]) -> DataFrameWriter:
    """A writer that replaces the partitions the rows are in."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return writer.partitionBy(*keys)


def raw_parquet(path: str) -> ParquetTable:
    return ParquetTable(path, "event_time", "event_date", ("sensor_id", "event_time"))


def window_parquet(path: str) -> ParquetTable:
    return ParquetTable(path, "window_start", "window_date", ("sensor_id", "window_start"))


def partials_parquet(path: str) -> ParquetTable:
    return ParquetTable(path, "hour_bucket", "hour_date", ("sensor_id", "hour_bucket", "band"))


def quarantine_parquet(path: str) -> ParquetTable:
    return ParquetTable(path)


@dataclass(frozen=True)
class TextMessages:
    """Writes the messages of a batch as text lines under its own query's and batch's directory."""

    path: str
    query_id: str = NO_QUERY

    def for_query(self, query_id: str) -> TextMessages:
        return replace(self, query_id=query_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows, keys = numbered(batch, self.query_id, batch_id)
        overwriting(rows, keys).text(self.path)


@dataclass(frozen=True)
class TopicMessages:
    """Sends the messages of a batch to a Kafka topic, at least once."""

    servers: str
    topic: str
    extra: dict[str, str] = field(default_factory=dict)

    def options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic, **self.extra}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.select("value").write.format("kafka").options(**self.options()).save()


@dataclass(frozen=True)
class JdbcTable:
    """Appends to a database table, at least once: a replayed batch is appended again.

    Each task holds one connection. Rows are spread over `connections` tasks by a shuffle, not by
    the writer's own numPartitions: that coalesces, and would parse the batch in as few tasks.
    """

    connection: dict[str, str]
    connections: int = 16
    batch_size: int = 10_000

    def options(self) -> dict[str, str]:
        return {**self.connection, "batchsize": str(self.batch_size)}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spread = batch.repartition(self.connections)
        spread.write.format("jdbc").options(**self.options()).mode("append").save()
