"""Peak hours per sensor and the global rank by congestion score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.measures import congestion_score
from flowgauge.session import materialise

# monotonically_increasing_id keeps the row number within a partition in its lower 33 bits.
ROW_BITS = 33


def peak_hours(hourly: DataFrame) -> DataFrame:
    """The busiest hour of each sensor, several where hours tie.

    A sensor has at most 25 hours in a trailing day, so no window partition grows with the data.
    """
    by_volume = Window.partitionBy("sensor_id").orderBy(F.desc("total_vehicles"))
    ranked = hourly.withColumn("volume_rank", F.rank().over(by_volume))
    return ranked.filter(F.col("volume_rank") == 1).select(
        "sensor_id", "hour_bucket", "total_vehicles", "avg_speed"
    )


def scored(hours: DataFrame) -> DataFrame:
    """Add the congestion score; hours that have none (neither traffic nor speed, or a speed that
    is no number) are left out."""
    score = congestion_score(F.col("total_vehicles"), F.col("avg_speed"))
    has_score = F.col("congestion_score").isNotNull() & ~F.isnan("congestion_score")
    return hours.withColumn("congestion_score", score).filter(has_score)


def dense_rank_by_score(
    rows: DataFrame,
    score: str = "congestion_score",
    rank: str = "congestion_rank",
    keep: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """Add the dense rank over the whole relation, highest score first, without a global window:
    the place of each distinct score in one range sort. `rows` must give the same scores each time
    it is read.

    Distinct scores are combined map-side, range-partitioned and sorted; a score's rank is its row
    number within its slice plus the number of scores in the slices before. The slices are
    materialised first because range bounds are sampled anew whenever the shuffle is planned. The
    join back is by equality, so a score shared by a third of the rows is split as a skewed key.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keep(
        rows.select(score)
        .distinct()
        .repartitionByRange(slices, F.desc(score))
        .sortWithinPartitions(F.desc(score))
        .select(score, F.monotonically_increasing_id().alias("place"))
    )
    slice_no = F.shiftright("place", ROW_BITS)
    within = F.col("place").bitwiseAND((1 << ROW_BITS) - 1)
    before = Window.orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice, never more than `slices` of them: a single-task window and a broadcast.
    offsets = (
        placed.groupBy(slice_no.alias("slice_no"))
        .agg(F.count("*").alias("scores"))
        .select("slice_no", F.coalesce(F.sum("scores").over(before), F.lit(0)).alias("ahead"))
    )
    ranks = (
        placed.withColumn("slice_no", slice_no)
        .join(F.broadcast(offsets), "slice_no")
        .select(score, (F.col("ahead") + within + 1).cast("int").alias(rank))
    )
    return rows.join(ranks, score).select(*rows.columns, rank)
