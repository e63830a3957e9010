"""Alerts as a log that readers follow, each from a position of its own.

An alert's position is its query, micro-batch and place in the batch. Alerts lie in segments of
SEGMENT batches; a segment whose batches are all finished is merged into sorted files once, and never
again, so that an alert is rewritten once at most. Positions stay what they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.folders import Folder
from flowgauge.sinks.batch_log import BatchLog
from flowgauge.sinks.batches import ParquetTable
from flowgauge.sinks.compaction import GRACE_SECONDS, compact_day, sweep_day
from flowgauge.sources.visibility import own_log, snapshot

SEGMENT = 1000

# A reader's position: of each query the last micro-batch that it has read.
Position = dict[str, int]


def segment_of(batch: int) -> str:
    """Names of segments sort like their batches."""
    return f"{batch // SEGMENT:015d}"


@dataclass(frozen=True)
class AlertLog(ParquetTable):
    """A sink of alert messages, which become visible with the other outputs of their batch."""

    date_column: str = "segment"
    sort_by: tuple[str, ...] = ("source", "batch", "place")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        placed = batch.select(
            "value",
            F.lit(self.query_id).alias("source"),
            F.lit(batch_id).cast("bigint").alias("batch"),
            F.monotonically_increasing_id().alias("place"),
        )
        self.store(placed, batch_id, F.lit(segment_of(batch_id)))


def alerts_after(
    spark: SparkSession, path: str, position: Position | None = None, log: BatchLog | None = None
) -> tuple[DataFrame, Position]:
    """(alerts that came after a position, the position after them): of every query the batches
    finished since, each once, whatever was merged meanwhile. From None on, all alerts.

    Segments before the position are not listed, as far as it names every query.
    """
    position = position or {}
    seen = snapshot(spark, path, log)
    committed = seen.committed or {}
    reader = spark.read.schema(schemas.ALERT_LOG).option("basePath", path)
    first = segment_of(min([position.get(q, -1) + 1 for q in committed] or [0]))
    parts = [s for s in Folder(spark, path).values("segment") if s >= first]
    if not parts:
        return spark.createDataFrame([], schemas.ALERT_LOG).drop("segment", "query_id", "batch_id"), dict(committed)
    rows = reader.parquet(*[f"{path}/segment={s}" for s in parts]).filter(seen.visible("segment"))
    read = F.lit(-1)
    for query, batch in position.items():
        read = F.when(F.col("source") == query, F.lit(batch)).otherwise(read)
    later = rows.filter(F.col("batch") > read).select("value", "source", "batch", "place")
    return later, position | committed


def merge_segments(
    spark: SparkSession, path: str, log: BatchLog | None = None, grace: float = GRACE_SECONDS
) -> list[str]:
    """Merge the segments that every query has left behind; names of those merged now. What earlier
    runs replaced is removed, where it is old enough."""
    table, committed = AlertLog(path), (log or own_log(path)).committed(spark)
    if not committed:
        return []
    open_from = segment_of(min(committed.values()) + 1)
    closed = [s for s in Folder(spark, path).values("segment") if s < open_from]
    done = [s for s in closed if compact_day(spark, table, schemas.ALERT_LOG, s, committed)]
    for segment in closed:
        sweep_day(spark, table, segment, grace)
    return done
