"""Windows that a query has not closed yet, read from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators.windows import windows_from

VALUE = (
    "STRUCT<high: BIGINT, middle: BIGINT, low: BIGINT, odd: DOUBLE, n_values: BIGINT, "
    "total_vehicles: BIGINT>"
)


def open_windows(spark: SparkSession, checkpoint: str, batch_id: int | None = None) -> DataFrame:
    """The windows still open after a query's last finished micro-batch, or after the given one, in
    the shape of the closed ones: what they hold so far. Rows that came too late are not in them.

    The state is read where the query keeps it, a task for each of its partitions; the query may be
    running. Spark keeps the states of the last batches (100, unless set otherwise).
    """
    reader = spark.read.format("statestore")
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    # The state's sums have one name all, but the order that they were declared in: as a struct they
    # are renamed by place.
    state = reader.load(checkpoint).select("key.*", F.col("value").cast(VALUE).alias("value"))
    return windows_from(state.select(F.col("window").alias("span"), "sensor_id", "band", "value.*"))
