"""Small builders and comparisons shared by the tests."""

from __future__ import annotations

import os
from datetime import datetime

from flowgauge import schemas


def at(text: str, day: str = "2026-05-09") -> datetime:
    return datetime.fromisoformat(f"{day} {text}")


def readings(spark, *rows):
    """Readings from (sensor, 'HH:MM:SS[.ffffff]' or datetime, count, speed)."""
    stored = [(s, at(t) if isinstance(t, str) else t, c, v) for s, t, c, v in rows]
    return spark.createDataFrame(stored, schemas.READING)


def hourly(spark, *rows):
    """Hourly rows from (sensor, hour of the day, total, speed)."""
    return spark.createDataFrame(
        [(s, at(f"{h:02d}:00:00"), t, v) for s, h, t, v in rows], schemas.HOURLY
    )


def tuples(df):
    return [tuple(row) for row in df.collect()]


def unordered(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


def same_rows(left, right):
    assert unordered(left) == unordered(right)


def message(sensor, time, count, speed, day="2026-05-09"):
    return (
        f'{{"sensor_id":"{sensor}","timestamp":"{day}T{time}+00:00",'
        f'"vehicle_count":{count},"avg_speed":{speed}}}'
    )


class MessageDir:
    """Text files of messages, each newer than the one before."""

    def __init__(self, path):
        self.path = path
        path.mkdir(parents=True, exist_ok=True)
        self.written = 0

    def add(self, lines):
        file = self.path / f"part-{self.written:03d}.txt"
        hidden = self.path / f".part-{self.written:03d}.tmp"
        hidden.write_text("".join(f"{line}\n" for line in lines))
        stamp = 1_700_000_000 + self.written
        os.utime(hidden, (stamp, stamp))
        hidden.rename(file)
        self.written += 1
