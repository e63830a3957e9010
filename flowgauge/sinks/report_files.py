"""The dated report directory: versions of the day's report, and which one counts."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from flowgauge.folders import Folder

CSV_TIME = "yyyy-MM-dd HH:mm:ss"

# How long versions stay that a later one has replaced, or that no run has finished.
GRACE_SECONDS = 24 * 3600.0


def utc_today() -> date:
    return datetime.now(timezone.utc).date()


def report_dir(out_dir: str, day: date) -> str:
    return f"{out_dir}/report_date={day.isoformat()}"


def write_csv(rows: DataFrame, path: str, order_by: list[str]) -> None:
    """CSV with header, replacing an earlier run: range-sorted parts that keep the order when read
    by name. Adaptive execution makes one part of a small table."""
    rows.orderBy(*order_by).write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", CSV_TIME
    ).csv(path)


def new_version(spark: SparkSession, out_dir: str, day: date) -> Folder:
    """A folder of the day's for a run to write its report in; it counts once it is published."""
    return Folder(spark, f"{report_dir(out_dir, day)}/version={uuid.uuid4().hex}")


def pointers(spark: SparkSession, out_dir: str, day: date) -> tuple[Folder, list[int]]:
    """The folder of a day's pointers, small files that name a version, and their numbers; the
    highest one counts."""
    place = Folder(spark, f"{report_dir(out_dir, day)}/_current")
    return place, sorted(int(n) for n in place.names() if n.isdigit())


def publish(version: Folder, out_dir: str, day: date) -> None:
    """Make a finished version the day's report: one small file is created, so that readers find the
    earlier report or this one at every moment. Of two runs the one that publishes later counts."""
    place, numbers = pointers(version.spark, out_dir, day)
    number = numbers[-1] + 1 if numbers else 0
    while not place.create(str(number), version.name):
        number += 1


def current_report(spark: SparkSession, out_dir: str, day: date) -> str | None:
    """Where a day's report is, None if there is none."""
    place, numbers = pointers(spark, out_dir, day)
    return f"{report_dir(out_dir, day)}/{place.text(str(numbers[-1]))}" if numbers else None


def sweep_versions(
    spark: SparkSession, out_dir: str, day: date, grace: float = GRACE_SECONDS
) -> list[str]:
    """Remove a day's versions that do not count, with their pointers, once they are older than
    `grace` seconds: readers of earlier ones are done, and runs that had begun one are lost."""
    place, numbers = pointers(spark, out_dir, day)
    kept = place.text(str(numbers[-1])) if numbers else None
    if kept and (place / str(numbers[-1])).age_seconds() < grace:
        return []
    folder, removed = Folder(spark, report_dir(out_dir, day)), []
    for value in folder.values("version"):
        version = folder / f"version={value}"
        if version.name != kept and version.age_seconds() >= grace:
            version.delete()
            removed.append(version.name)
    for number in numbers[:-1]:
        (place / str(number)).delete()
    return removed


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True)
    return reader.option("timestampNTZFormat", CSV_TIME).csv(path)
