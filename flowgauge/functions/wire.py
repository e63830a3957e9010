"""JSON text of incoming messages and of alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowgauge.functions.measures import round_cents
from flowgauge.functions.timestamps import to_iso, zoned


def reading_json(sensor: Column, when: Column, count: Column, speed: Column) -> Column:
    """Message text of a reading, speed to two places. Names and order of the fields are the
    message format."""
    return F.to_json(
        F.struct(
            sensor.alias("sensor_id"),
            to_iso(when).alias("timestamp"),
            count.alias("vehicle_count"),
            round_cents(speed).alias("avg_speed"),
        )
    )


def alert_json(sensor: Column, when: Column, count: Column, speed: Column) -> Column:
    """Alert text: plain time text without offset, NULL fields left out."""
    return F.to_json(
        F.struct(
            sensor.alias("sensor_id"),
            zoned(when).cast("string").alias("timestamp"),
            speed.alias("avg_speed"),
            count.alias("vehicle_count"),
        )
    )


def json_int(text: Column, key: str) -> Column:
    """Integer at `key` of a JSON object, NULL when there is none.

    Text of the exact form {"key": 123} needs no JSON parser, which is what most of a scan's time
    would go into. Its number counts only if it reads the same when written again (so not 007, +7
    or 7 with a blank); all other text goes through the parser.
    """
    head = f'{{"{key}": '
    inside = F.substr(text, F.lit(len(head) + 1), F.length(text) - F.lit(len(head) + 1))
    number = inside.try_cast("int")
    plain = text.startswith(head) & text.endswith("}") & (number.cast("string") == inside)
    return F.when(plain, number).otherwise(F.get_json_object(text, f"$.{key}").try_cast("int"))
