"""Declared schemas; nothing in this package infers one."""

from __future__ import annotations

# JSON object carried in the `value` of an incoming message.
WIRE = "sensor_id STRING, timestamp STRING, vehicle_count INT, avg_speed DOUBLE"

# JSON object carried in the `value` of an alert; field order is part of the format.
ALERT = "sensor_id STRING, timestamp STRING, avg_speed DOUBLE, vehicle_count INT"

# A reading at rest. Event times are UTC wall-clock times without a zone.
READING = "sensor_id STRING, event_time TIMESTAMP_NTZ, vehicle_count INT, avg_speed DOUBLE"
READING_COLUMNS = ["sensor_id", "event_time", "vehicle_count", "avg_speed"]

# Partition columns the batch writer adds below a table directory.
RAW_TABLE = f"{READING}, event_date DATE, query_id STRING, batch_id BIGINT"

QUARANTINE_TABLE = "value STRING, missing STRING, query_id STRING, batch_id BIGINT"

ALERT_TABLE = "value STRING, query_id STRING, batch_id BIGINT"

# An alert with its position: the query that raised it, its micro-batch, and its place in that.
ALERT_LOG = (
    "value STRING, source STRING, batch BIGINT, place BIGINT, "
    "segment STRING, query_id STRING, batch_id BIGINT"
)

WINDOW = (
    "sensor_id STRING, window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, "
    "avg_speed DOUBLE, total_vehicles BIGINT, congestion_index DOUBLE"
)
WINDOW_COLUMNS = [
    "sensor_id",
    "window_start",
    "window_end",
    "avg_speed",
    "total_vehicles",
    "congestion_index",
]
WINDOW_TABLE = f"{WINDOW}, window_date DATE, query_id STRING, batch_id BIGINT"

# Sums that an hour's rollup is merged from, one row for each micro-batch, sensor, hour and band of
# speeds; hours are partitioned by date like the readings.
HOURLY_PARTIALS = (
    "sensor_id STRING, hour_bucket TIMESTAMP_NTZ, band INT, high BIGINT, middle BIGINT, low BIGINT, "
    "odd DOUBLE, n_values BIGINT, total_vehicles BIGINT, digits DECIMAL(38,18), undecided BIGINT, "
    "hour_date DATE, query_id STRING, batch_id BIGINT"
)

HOURLY = "sensor_id STRING, hour_bucket TIMESTAMP_NTZ, total_vehicles BIGINT, avg_speed DOUBLE"

REPORT = (
    f"{HOURLY}, congestion_score DOUBLE, congestion_rank INT, "
    "intervention_required STRING, recommendation STRING"
)
REPORT_COLUMNS = [
    "sensor_id",
    "hour_bucket",
    "total_vehicles",
    "avg_speed",
    "congestion_score",
    "congestion_rank",
    "intervention_required",
    "recommendation",
]
