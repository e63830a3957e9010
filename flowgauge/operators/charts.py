"""Data behind the report's chart and table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge import rules
from flowgauge.functions.measures import round_half_even
from flowgauge.functions.timestamps import literal_time, minute_label


def listed(value: Column, among: list, what: str) -> Column:
    """The value, if it is one of the list; otherwise the query fails: a pivot would drop it."""
    message = F.concat(F.lit(f"{what} outside the matrix: "), value.cast("string"))
    return F.when(value.isin(among), value).otherwise(F.raise_error(message))


def hourly_matrix(hourly: DataFrame, sensors: list[str]) -> DataFrame:
    """One row per hour, one column per sensor, 0 where a sensor has no readings.

    For a stated list of sensors, as columns have to be; `sensor_matrix` takes any number.
    """
    named = hourly.withColumn("sensor_id", listed(F.col("sensor_id"), sensors, "sensor"))
    return named.groupBy("hour_bucket").pivot("sensor_id", sensors).sum("total_vehicles").na.fill(0)


def sensor_matrix(hourly: DataFrame, hours: int = rules.TRAILING_HOURS) -> DataFrame:
    """The same matrix turned on its side, for any number of sensors: one row per sensor, columns
    h00, h01, ... counting hours from the first one (a span of hours touches one more than it has).
    An hour beyond the span fails the query.
    """
    first = hourly.agg(F.min("hour_bucket")).head()[0] or datetime.min
    numbers = list(range(hours + 1))
    hour_no = F.timestamp_diff("HOUR", literal_time(first), F.col("hour_bucket"))
    by_sensor = hourly.withColumn("hour_no", listed(hour_no, numbers, "hour")).groupBy("sensor_id")
    wide = by_sensor.pivot("hour_no", numbers).sum("total_vehicles").na.fill(0)
    return wide.toDF("sensor_id", *[f"h{n:02d}" for n in numbers])


def hour_ticks(hourly: DataFrame, most: int = rules.MAX_HOUR_LABELS) -> DataFrame:
    """Axis labels: every n-th distinct hour, at most `most` of them.

    The window has no partition key, over at most 25 distinct hours of a trailing day.
    """
    hours = hourly.select("hour_bucket").distinct()
    in_order = Window.orderBy("hour_bucket")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = hours.select(
        "hour_bucket",
        (F.row_number().over(in_order) - 1).alias("position"),
        F.count("*").over(everything).alias("hours"),
    )
    step = F.greatest(F.lit(1), F.expr(f"(hours + {most - 1}) div {most}"))
    return numbered.filter(F.col("position") % step == 0).select(
        "position", minute_label(F.col("hour_bucket")).alias("label")
    )


def display_table(report: DataFrame) -> DataFrame:
    """The report as printed: hours as text, speed and score to two places."""
    return report.withColumns(
        {
            "hour_bucket": minute_label(F.col("hour_bucket")),
            "avg_speed": round_half_even(F.col("avg_speed")),
            "congestion_score": round_half_even(F.col("congestion_score")),
        }
    )
