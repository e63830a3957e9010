"""The daily congestion report over the trailing day."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame

from flowgauge import rules, schemas
from flowgauge.operators.charts import display_table, hour_ticks, hourly_matrix, sensor_matrix
from flowgauge.operators.labels import with_labels
from flowgauge.operators.ranking import dense_rank_by_score, peak_hours, scored
from flowgauge.operators.rollup import (
    hourly_from,
    hourly_partials,
    hourly_traffic,
    merged_partials,
    newest_reading,
    trailing_readings,
)
from flowgauge.session import Scratch


@dataclass(frozen=True)
class CongestionReport:
    """All outputs of one report, derived from one hourly rollup so that they agree.

    `hourly` holds at most `hours` + 1 rows per sensor. It is the only relation computed from
    readings and is kept in the shared folder: the ranking, the chart and the table read it, not the
    readings. `release` removes what was kept, when all outputs are written.
    """

    hourly: DataFrame
    hours: int
    scratch: Scratch

    def is_empty(self) -> bool:
        return self.hourly.isEmpty()

    @cached_property
    def peaks(self) -> DataFrame:
        return peak_hours(self.hourly)

    @cached_property
    def rows(self) -> DataFrame:
        """Peak hours with score, rank and labels."""
        return with_labels(dense_rank_by_score(scored(self.peaks), keep=self.scratch.keep))

    def matrix(self, sensors: list[str]) -> DataFrame:
        return hourly_matrix(self.hourly, sensors)

    def matrix_by_sensor(self) -> DataFrame:
        return sensor_matrix(self.hourly, self.hours)

    def ticks(self) -> DataFrame:
        return hour_ticks(self.hourly)

    def display(self) -> DataFrame:
        return display_table(self.rows)

    def release(self) -> None:
        self.scratch.remove()


def congestion_report(
    readings: DataFrame,
    hours: int = rules.TRAILING_HOURS,
    date_column: str | None = None,
    newest: datetime | None = None,
) -> CongestionReport:
    """Report over the readings of the trailing day; reads them once for the bound (times only),
    unless the source knows it, and once for the rollup (the trailing day only). Without readings
    there is nothing to read a second time."""
    spark = readings.sparkSession
    scratch = Scratch(spark)
    newest = newest or newest_reading(readings)
    if newest is None:
        return CongestionReport(spark.createDataFrame([], schemas.HOURLY), hours, scratch)
    recent = trailing_readings(readings, hours, date_column, newest)
    return CongestionReport(scratch.keep(hourly_traffic(recent)), hours, scratch)


def report_from_partials(
    partials: DataFrame, edge: DataFrame, hours: int = rules.TRAILING_HOURS
) -> CongestionReport:
    """The same report from the hourly partials of whole hours, and the readings of the hour that the
    trailing bound cuts: what it reads grows with the sensors, not with the readings."""
    scratch = Scratch(partials.sparkSession)
    first = hourly_partials(edge)
    every = merged_partials(partials.select(*first.columns).unionByName(first))
    return CongestionReport(scratch.keep(hourly_from(every)), hours, scratch)
