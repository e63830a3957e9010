
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowgauge.catalog import REGISTERED  # noqa: E402


def present(module: str) -> bool:
    try:
        return importlib.util.find_spec(module) is not None
    except ModuleNotFoundError:
        return False


# The training-data operators and their pipeline come and go together, apart from the rest.
HAS_LLM = present("flowgauge.llm.queries")
HAS_PIPELINE = HAS_LLM and present("corpus_pipeline")

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """The congestion report over the trailing day."""
    return REGISTERED["report_rows"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(REGISTERED)
    if HAS_LLM:
        from flowgauge.llm.queries import QUERIES

        found.update(QUERIES)
    if HAS_PIPELINE:
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    return found


S = """
WITH s AS (
  SELECT event_id, event_type AS sensor_id, ts AS event_time,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS vehicle_count, value AS avg_speed
  FROM events)
"""

T = (
    S
    + """
, newest AS (SELECT max(event_time) AS latest FROM s)
, recent AS (SELECT s.* FROM s, newest WHERE event_time >= latest - INTERVAL '1 day')
"""
)

# Mean of the speeds as written, exact before the division.
MEAN = """
  CAST(sum(CAST(CAST(avg_speed AS VARCHAR) AS DECIMAL(38, 18))) AS DOUBLE) / count(avg_speed)"""

H = (
    T
    + f"""
, hourly AS (
  SELECT sensor_id, date_trunc('hour', event_time) AS hour_bucket,
         CAST(sum(vehicle_count) AS BIGINT) AS total_vehicles, {MEAN} AS mean_speed
  FROM recent GROUP BY sensor_id, date_trunc('hour', event_time))
"""
)

P = (
    H
    + """
, peak AS (
  SELECT sensor_id, hour_bucket, total_vehicles, mean_speed
  FROM (SELECT *, rank() OVER (PARTITION BY sensor_id ORDER BY total_vehicles DESC) AS place
        FROM hourly) WHERE place = 1)
"""
)

SCORE = """
  CASE WHEN mean_speed = 0 AND total_vehicles > 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN mean_speed = 0 THEN NULL ELSE total_vehicles / mean_speed END"""

# The label texts and their bounds.
R = (
    P
    + f"""
, scored AS (SELECT *, {SCORE} AS congestion_score FROM peak)
, report AS (
  SELECT *, CAST(dense_rank() OVER (ORDER BY congestion_score DESC) AS INTEGER) AS congestion_rank
  FROM scored WHERE congestion_score IS NOT NULL)
, labelled AS (
  SELECT *,
    CASE WHEN congestion_rank = 1 OR mean_speed < 15 THEN 'Yes' ELSE 'Monitor' END
      AS intervention_required,
    CASE WHEN congestion_rank = 1 THEN 'Priority police deployment'
         WHEN mean_speed < 15 THEN 'Deploy if speeds drop below 15 km/h'
         ELSE 'Continue monitoring' END AS recommendation
  FROM report)
"""
)

WINDOWS = """
SELECT sensor_id, time_bucket(INTERVAL '5 minutes', event_time) AS window_start,
       time_bucket(INTERVAL '5 minutes', event_time) + INTERVAL '5 minutes' AS window_end,
       round(avg(s.avg_speed), 6) AS avg_speed,
       CAST(sum(vehicle_count) AS BIGINT) AS total_vehicles,
       round(sum(vehicle_count) / NULLIF(avg(s.avg_speed), 0), 6) AS congestion_index
FROM s GROUP BY ALL
"""

ALERT_VALUE = """
CAST(to_json({'sensor_id': sensor_id, 'timestamp': CAST(event_time AS VARCHAR),
              'avg_speed': avg_speed, 'vehicle_count': vehicle_count}) AS VARCHAR)"""

REPORT_SELECT = """
SELECT sensor_id, hour_bucket, total_vehicles, round(mean_speed, 6) AS avg_speed,
       round(congestion_score, 6) AS congestion_score, congestion_rank,
       intervention_required, recommendation FROM labelled
"""


# The replay's slices: equal parts of the time span, but for one sensor's late readings. With slow
# readings' messages broken in a way that their sensor decides.
SLICED = """
, span AS (SELECT min(event_time) AS a, max(event_time) AS b FROM s)
, timed AS (
  SELECT s.*, CAST(least(floor(date_diff('microsecond', a, event_time) / 1e6
                               / (date_diff('microsecond', a, b) / 1e6 / 6)), 5) AS BIGINT) AS part
  FROM s, span)
, sliced AS (
  SELECT * EXCLUDE (part), CASE WHEN part = 1 AND sensor_id = 'view' THEN 4 ELSE part END AS batch_id
  FROM timed)
"""

BROKEN = """
CASE sensor_id WHEN 'purchase' THEN 'vehicle_count' WHEN 'click' THEN 'vehicle_count'
               WHEN 'view' THEN 'event_time'
               ELSE 'sensor_id,event_time,vehicle_count,avg_speed' END"""


def _matrix_columns() -> str:
    sensors = ["click", "error", "purchase", "signup", "view"]
    return ", ".join(
        f"CAST(coalesce(sum(total_vehicles) FILTER (WHERE sensor_id = '{s}'), 0) AS BIGINT) AS {s}"
        for s in sensors
    )


def _hour_columns() -> str:
    return ", ".join(
        "CAST(coalesce(sum(total_vehicles) FILTER "
        f"(WHERE hour_bucket = first_hour + INTERVAL '{n} hours'), 0) AS BIGINT) AS h{n:02d}"
        for n in range(25)
    )


def oracle_sql() -> dict[str, str]:
    found = own_sql()
    if HAS_LLM:
        from flowgauge.llm.queries import ORACLE_SQL

        found.update(ORACLE_SQL)
    if HAS_PIPELINE:
        import corpus_pipeline

        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def own_sql() -> dict[str, str]:
    return {
        "wire_encode": S
        + """
SELECT event_id,
  CAST(to_json({'sensor_id': sensor_id,
                'timestamp': CASE WHEN microsecond(event_time) % 1000000 = 0
                    THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S')
                    ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00',
                'vehicle_count': vehicle_count,
                'avg_speed': CAST(printf('%.2f', avg_speed) AS DOUBLE)}) AS VARCHAR)
    AS value
FROM s""",
        "parse_wire": S + "SELECT sensor_id, event_time, vehicle_count, avg_speed FROM s",
        "raw_events": S + "SELECT event_id, sensor_id, event_time, vehicle_count, avg_speed FROM s",
        "raw_events_stream": S
        + """
SELECT CAST(event_time AS DATE) AS event_date, sensor_id, event_time, vehicle_count, avg_speed
FROM s""",
        "contract_split": S
        + """
SELECT CASE WHEN sensor_id IS NOT NULL AND event_time IS NOT NULL AND vehicle_count IS NOT NULL
             AND avg_speed IS NOT NULL THEN 'valid' ELSE 'quarantine' END AS outcome,
       count(*) AS n
FROM s GROUP BY ALL""",
        "contract_faults": S
        + """
SELECT CASE sensor_id WHEN 'purchase' THEN 'vehicle_count' WHEN 'click' THEN 'vehicle_count'
                      WHEN 'view' THEN 'event_time'
                      ELSE 'sensor_id,event_time,vehicle_count,avg_speed' END AS missing,
       count(*) AS n, count(*) FILTER (WHERE sensor_id <> 'signup') AS with_text
FROM s WHERE avg_speed < 10 GROUP BY ALL""",
        "valid_after_faults": S
        + "SELECT sensor_id, event_time, vehicle_count, avg_speed FROM s WHERE avg_speed >= 10",
        "window_congestion_batch": S + WINDOWS,
        "window_congestion_stream": S
        + f"""
SELECT * FROM ({WINDOWS})
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
        "window_congestion_faulty_stream": S
        + f"""
, kept AS (SELECT * FROM s WHERE avg_speed >= 10)
SELECT * FROM ({WINDOWS.replace("FROM s", "FROM kept AS s")})
WHERE window_end <= (SELECT max(event_time) FROM kept) - INTERVAL '10 minutes'""",
        # A slice is a micro-batch. Readings of the second slice that come with the fifth find a
        # watermark ten minutes behind the newest reading of the fourth, and their window closed.
        "window_congestion_replay": S
        + f"""
, span AS (SELECT min(event_time) AS a, max(event_time) AS b FROM s)
, sliced AS (
  SELECT s.*, least(floor(date_diff('microsecond', a, event_time) / 1e6
                          / (date_diff('microsecond', a, b) / 1e6 / 6)), 5) AS part
  FROM s, span)
, mark AS (
  SELECT max(event_time) - INTERVAL '10 minutes' AS closed FROM sliced WHERE part <= 3)
, kept AS (
  SELECT sliced.* FROM sliced, mark
  WHERE NOT (part = 1 AND sensor_id = 'view'
             AND time_bucket(INTERVAL '5 minutes', event_time) + INTERVAL '5 minutes' <= closed))
SELECT * FROM ({WINDOWS.replace("FROM s", "FROM kept AS s")})
WHERE window_end <= (SELECT max(event_time) FROM s) - INTERVAL '10 minutes'""",
        "windows_closed_and_open": S
        + f"""
, span AS (SELECT min(event_time) AS a, max(event_time) AS b FROM s)
, sliced AS (
  SELECT s.*, least(floor(date_diff('microsecond', a, event_time) / 1e6
                          / (date_diff('microsecond', a, b) / 1e6 / 6)), 5) AS part
  FROM s, span)
, mark AS (
  SELECT max(event_time) - INTERVAL '10 minutes' AS closed FROM sliced WHERE part <= 3)
, kept AS (
  SELECT sliced.* FROM sliced, mark
  WHERE NOT (part = 1 AND sensor_id = 'view'
             AND time_bucket(INTERVAL '5 minutes', event_time) + INTERVAL '5 minutes' <= closed))
SELECT *, window_end <= (SELECT max(event_time) FROM s) - INTERVAL '10 minutes' AS closed
FROM ({WINDOWS.replace("FROM s", "FROM kept AS s")})""",
        "landed_outputs": S
        + SLICED
        + f"""
SELECT 'raw' AS output, batch_id, sensor_id AS name, count(*) AS n
FROM sliced WHERE avg_speed >= 10 GROUP BY ALL
UNION ALL
SELECT 'quarantine' AS output, batch_id, {BROKEN} AS name, count(*) AS n
FROM sliced WHERE avg_speed < 10 AND sensor_id <> 'signup' GROUP BY ALL
UNION ALL
SELECT 'alerts' AS output, batch_id, sensor_id AS name, count(*) AS n
FROM sliced WHERE avg_speed < 10 AND sensor_id NOT IN ('signup', 'error') GROUP BY ALL""",
        "batch_counts": S
        + SLICED
        + """
, counted AS (
  SELECT batch_id, count(*) FILTER (WHERE avg_speed >= 10) AS valid,
         count(*) FILTER (WHERE avg_speed < 10 AND sensor_id <> 'signup') AS broken,
         count(*) FILTER (WHERE avg_speed < 10 AND sensor_id NOT IN ('signup', 'error')) AS alerts,
         min(event_time) FILTER (WHERE avg_speed >= 10) AS least,
         max(event_time) FILTER (WHERE avg_speed >= 10) AS greatest
  FROM sliced GROUP BY batch_id)
SELECT *, max(greatest) OVER (ORDER BY batch_id) AS newest FROM counted""",
        "report_from_raw": R + REPORT_SELECT,
        "report_from_partials": R + REPORT_SELECT,
        "critical_alerts": S + f"SELECT {ALERT_VALUE} AS value FROM s WHERE avg_speed < 10",
        "critical_alerts_stream": S + f"SELECT {ALERT_VALUE} AS value FROM s WHERE avg_speed < 10",
        "alerts_readback": S
        + "SELECT sensor_id, event_time, avg_speed, vehicle_count FROM s WHERE avg_speed < 10",
        "alerts_followed": S
        + SLICED
        + """
SELECT sensor_id, event_time, avg_speed, vehicle_count, batch_id AS batch,
       CASE WHEN batch_id < 3 THEN 0 ELSE 1 END AS read
FROM sliced WHERE avg_speed < 10""",
        "event_status": S
        + """
SELECT event_id, CASE WHEN avg_speed < 10 THEN 'CRITICAL' ELSE 'NORMAL' END AS status FROM s""",
        "latest_reading": "SELECT max(ts) AS latest_event_time FROM events",
        "trailing_day": T
        + "SELECT event_id, sensor_id, event_time, vehicle_count, avg_speed FROM recent",
        "hourly_rollup": H
        + """
SELECT sensor_id, hour_bucket, total_vehicles, round(mean_speed, 6) AS avg_speed FROM hourly
ORDER BY hour_bucket, sensor_id""",
        "peak_hour": P
        + """
SELECT sensor_id, hour_bucket, total_vehicles, round(mean_speed, 6) AS avg_speed FROM peak
ORDER BY sensor_id""",
        "report_rows": R + REPORT_SELECT,
        "report_csv_roundtrip": R + REPORT_SELECT,
        "score_rank": S
        + f"""
, hourly AS (
  SELECT sensor_id, date_trunc('hour', event_time) AS hour_bucket,
         CAST(sum(vehicle_count) AS BIGINT) AS total_vehicles,
         {MEAN} AS mean_speed
  FROM s GROUP BY sensor_id, date_trunc('hour', event_time))
, scored AS (SELECT *, {SCORE} AS congestion_score FROM hourly)
SELECT sensor_id, hour_bucket, total_vehicles, round(mean_speed, 6) AS avg_speed,
       round(congestion_score, 6) AS congestion_score, CAST(dense_rank() OVER (ORDER BY congestion_score DESC) AS INTEGER)
         AS congestion_rank
FROM scored WHERE congestion_score IS NOT NULL""",
        "hourly_matrix": H
        + f"""
SELECT hour_bucket, {_matrix_columns()} FROM hourly GROUP BY hour_bucket ORDER BY hour_bucket""",
        "sensor_matrix": H
        + f"""
, placed AS (SELECT *, min(hour_bucket) OVER () AS first_hour FROM hourly)
SELECT sensor_id, {_hour_columns()} FROM placed GROUP BY sensor_id""",
        "hour_ticks": H
        + """
, h AS (SELECT DISTINCT hour_bucket FROM hourly)
, r AS (SELECT hour_bucket, row_number() OVER (ORDER BY hour_bucket) - 1 AS i,
               count(*) OVER () AS n FROM h)
SELECT CAST(i AS INTEGER) AS position, strftime(hour_bucket, '%Y-%m-%d %H:%M') AS label
FROM r WHERE i % greatest(1, (n + 11) // 12) = 0""",
        "report_display": R
        + """
SELECT sensor_id, strftime(hour_bucket, '%Y-%m-%d %H:%M') AS hour_bucket, total_vehicles,
       round_even(mean_speed * 100, 0) / 100 AS avg_speed,
       round_even(congestion_score * 100, 0) / 100 AS congestion_score, congestion_rank,
       intervention_required, recommendation FROM labelled""",
    }
