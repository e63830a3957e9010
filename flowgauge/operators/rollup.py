"""The trailing day of readings and its hourly rollup."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge import rules
from flowgauge.functions.timestamps import hour_of, literal_date, literal_time
from flowgauge.operators.exact_sums import accumulated, merged, with_means

HOUR = ["sensor_id", "hour_bucket"]
HOUR_SUMS = ["total_vehicles", "digits", "undecided"]

# Speeds below are summed as decimals; of 10^11 of them the sum still fits.
MOST_DECIMAL = 1e9


def latest_event_time(readings: DataFrame) -> DataFrame:
    """One row: the newest event time, or the current time when there are no readings."""
    newest = F.coalesce(F.max("event_time"), F.localtimestamp())
    return readings.agg(newest.alias("latest_event_time"))


def newest_reading(readings: DataFrame) -> datetime | None:
    """The latest event time as a value, None without readings; scans the time column."""
    return readings.agg(F.max("event_time")).head()[0]


def trailing_readings(
    readings: DataFrame,
    hours: int = rules.TRAILING_HOURS,
    date_column: str | None = None,
    newest: datetime | None = None,
) -> DataFrame:
    """Readings not older than `hours` before the newest one (lower bound included).

    The bound is worked out first and put in as a literal: the scan then skips row groups by their
    statistics, and whole dates where the table is partitioned by one. A subquery in its place
    would reach neither, and a join with the one-row bound would add a nested loop. A source that
    knows its newest time can pass it.
    """
    newest = newest or newest_reading(readings)
    if newest is None:
        return readings.filter(F.lit(False))
    since = newest - timedelta(hours=hours)
    kept = readings.filter(F.col("event_time") >= literal_time(since))
    if date_column is not None:
        kept = kept.filter(F.col(date_column) >= literal_date(since))
    return kept


def hourly_partials(readings: DataFrame) -> DataFrame:
    """What the hourly rollup is merged from: per sensor, hour and band of speeds, the vehicle sum and
    exact sums of the speeds. Partials of any parts of the readings add up to those of the whole.

    Speeds are summed as the decimals they are written as, so that hours whose speeds add up to the
    same have the same mean; `undecided` counts those that no decimal of 18 places stands for.
    """
    speed = F.col("avg_speed")
    digits = F.when(F.abs(speed) < MOST_DECIMAL, speed.try_cast("decimal(38,18)"))
    decided = digits.cast("double") == speed
    hours = readings.withColumn("hour_bucket", hour_of(F.col("event_time")))
    return accumulated(
        hours,
        HOUR,
        "avg_speed",
        total_vehicles=F.sum("vehicle_count"),
        digits=F.sum(F.when(decided, digits)),
        undecided=F.count_if(speed.isNotNull() & ~F.coalesce(decided, F.lit(False))),
    )


def hourly_from(partials: DataFrame) -> DataFrame:
    """Vehicle sum and unweighted mean speed per sensor and hour, of one partial for each band. Where
    some speed is no decimal, the mean is that of the doubles."""
    sums = with_means(partials, HOUR, "exact", *HOUR_SUMS)
    decimal = F.try_divide(F.col("digits").cast("double"), F.col("n_values"))
    mean = F.when(F.col("undecided") == 0, decimal).otherwise(F.col("exact"))
    return sums.select(*HOUR, "total_vehicles", mean.alias("avg_speed"))


def merged_partials(partials: DataFrame) -> DataFrame:
    """Partials of several micro-batches as one for each sensor, hour and band."""
    return merged(partials, HOUR, *HOUR_SUMS)


def hourly_traffic(readings: DataFrame) -> DataFrame:
    """Vehicle sum and unweighted mean speed per sensor and hour. The mean is the exact one: its last
    digit decides ties of the ranking."""
    return hourly_from(hourly_partials(readings))
