"""Threshold alerts and event status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge import rules, schemas
from flowgauge.functions.timestamps import from_iso, zoneless
from flowgauge.functions.wire import alert_json


def is_critical(below: float = rules.ALERT_SPEED_BELOW) -> Column:
    return F.col("avg_speed") < below


def critical_readings(readings: DataFrame, below: float = rules.ALERT_SPEED_BELOW) -> DataFrame:
    """Readings strictly below the speed; an unknown speed raises no alert."""
    return readings.filter(is_critical(below))


def alert_messages(readings: DataFrame, below: float = rules.ALERT_SPEED_BELOW) -> DataFrame:
    """One JSON `value` per critical reading."""
    fields = [F.col(c) for c in schemas.READING_COLUMNS]
    return critical_readings(readings, below).select(alert_json(*fields).alias("value"))


def parse_alerts(messages: DataFrame, *carry: str) -> DataFrame:
    """Alerts read back from their JSON text, with the columns `carry` of the messages."""
    fields = F.inline(F.array(F.from_json(F.col("value").cast("string"), schemas.ALERT)))
    return messages.select(*carry, fields).select(
        *carry,
        "sensor_id",
        zoneless(from_iso(F.col("timestamp"))).alias("event_time"),
        "avg_speed",
        "vehicle_count",
    )


def with_status(readings: DataFrame, below: float = rules.ALERT_SPEED_BELOW) -> DataFrame:
    """Add `status`; an unknown speed counts as normal."""
    status = F.when(is_critical(below), rules.STATUS_CRITICAL).otherwise(rules.STATUS_NORMAL)
    return readings.withColumn("status", status)
