"""Tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge import rules, schemas
from flowgauge.functions.measures import congestion_index
from flowgauge.functions.timestamps import zoneless
from flowgauge.operators.exact_sums import accumulated, with_means


def window_partials(readings: DataFrame, width: str = rules.WINDOW_WIDTH) -> DataFrame:
    """Vehicle sum and exact sum of the speeds per window, sensor and band of speeds. On a stream this
    is the one stateful aggregation; all bands of a window are emitted in the same micro-batch.

    The sums combine map-side, so a sensor with a third of all rows sends the shuffle no more than
    one row per task, window and band.
    """
    span = F.window("event_time", width).alias("span")
    return accumulated(
        readings, [span, "sensor_id"], "avg_speed", total_vehicles=F.sum("vehicle_count")
    )


def windows_from(partials: DataFrame) -> DataFrame:
    """Unweighted mean speed, vehicle sum and their ratio per window and sensor."""
    means = with_means(partials, ["span", "sensor_id"], "avg_speed", "total_vehicles")
    return means.select(
        "sensor_id",
        zoneless(F.col("span.start")).alias("window_start"),
        zoneless(F.col("span.end")).alias("window_end"),
        "avg_speed",
        "total_vehicles",
        congestion_index(F.col("total_vehicles"), F.col("avg_speed")).alias("congestion_index"),
    ).select(*schemas.WINDOW_COLUMNS)


def window_congestion(readings: DataFrame, width: str = rules.WINDOW_WIDTH) -> DataFrame:
    """The same of stored readings."""
    return windows_from(window_partials(readings, width))
