"""From message text to readings that keep the table contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge import rules, schemas
from flowgauge.functions.timestamps import from_iso, zoned, zoneless


def parse_messages(messages: DataFrame) -> DataFrame:
    """Expand `value` (binary or text) into the wire fields plus `event_time`.

    Every message gives exactly one row: text that is no JSON, and a NULL value, give NULL fields.
    `inline` rather than a struct column and `d.*`: filters cannot be pushed below a generator, so
    each message is parsed once however many fields the later filters test. With a struct column
    the contract filter alone parses it four more times.
    """
    text = messages.select(F.col("value").cast("string").alias("value"))
    fields = F.inline(F.array(F.from_json("value", schemas.WIRE)))
    return text.select("value", fields).withColumn("event_time", from_iso(F.col("timestamp")))


def keeps_contract(columns: list[str] = schemas.READING_COLUMNS) -> Column:
    """No required column is NULL. (`dropna` would reject NaN speeds too, which tables accept.)"""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def missing_columns(columns: list[str] = schemas.READING_COLUMNS) -> Column:
    """Names of the required columns that are NULL, comma-separated."""
    return F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def valid_readings(parsed: DataFrame) -> DataFrame:
    """Rows that keep the contract, as stored: four columns, zone-less event time."""
    return project_readings(parsed.filter(keeps_contract()))


def quarantined(parsed: DataFrame) -> DataFrame:
    """Rows that break the contract, with the original text and the columns it lacks."""
    broken = parsed.filter(~keeps_contract())
    return broken.select("value", missing_columns().alias("missing"))


def project_readings(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sensor_id", zoneless(F.col("event_time")).alias("event_time"), "vehicle_count", "avg_speed"
    )


def with_watermark(rows: DataFrame, delay: str = rules.WATERMARK_DELAY) -> DataFrame:
    """Watermark on the event time; a stored (zone-less) time is made an instant first."""
    return rows.withColumn("event_time", zoned(F.col("event_time"))).withWatermark(
        "event_time", delay
    )
