"""Session settings shared by the jobs, and the shared folder they cut lineage in."""

from __future__ import annotations

import atexit
import shutil
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from flowgauge.folders import Folder

CHECKPOINT_CONF = "spark.checkpoint.dir"
WAREHOUSE_CONF = "spark.sql.warehouse.dir"
ZONE_CONF = "spark.sql.session.timeZone"

# Results depend on the zone; the rest is stated because the plans count on it.
JOB_SETTINGS = {
    ZONE_CONF: "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# A day of readings is shuffled in many small parts, which adaptive execution joins to this size;
# what spark-submit or the session already sets stands.
BATCH_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def job_session(
    app_name: str,
    extra: dict[str, str] | None = None,
    defaults: dict[str, str] | None = None,
) -> SparkSession:
    """Session of a job; master, memory and partition counts come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**JOB_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    given = session.conf.getAll
    for key, value in (defaults or {}).items():
        if key not in given:
            session.conf.set(key, value)
    return session


def in_utc(spark: SparkSession) -> SparkSession:
    """The session itself if its zone is UTC, else one beside it that is: stored event times are UTC
    wall-clock times, and the caller's own queries keep their zone."""
    if spark.conf.get(ZONE_CONF) == "UTC":
        return spark
    beside = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            beside.conf.set(key, value)
    beside.conf.set(ZONE_CONF, "UTC")
    return beside


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, else one of this application's
    own in the warehouse, which is shared as tables are. A warehouse on the driver's own disk will do
    for a local master alone."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    warehouse, context = spark.conf.get(WAREHOUSE_CONF).rstrip("/"), spark.sparkContext
    if warehouse.startswith(("file:", "/")) and not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    return _own_dir(warehouse, context.applicationId)


@cache
def _own_dir(warehouse: str, application: str) -> str:
    path = f"{warehouse}/scratch-{application}"
    local = path.removeprefix("file:")
    if local.startswith("/"):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and keep the rows as a table in the shared folder.

    Later actions then agree on the rows, and a lost executor costs a re-read instead of a
    recomputation. A table rather than `checkpoint()`: it is read by column, and its size on disk
    tells the planner which joins may broadcast.
    """
    return Scratch(df.sparkSession).keep(df)


class Scratch:
    """Tables kept for a purpose, removed together when it is served."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.places: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "kept")
        self.places.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        while self.places:
            Folder(self.spark, self.places.pop()).delete()
