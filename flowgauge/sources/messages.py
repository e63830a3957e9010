"""Messages (one `value` column) from a topic or from files, as a stream or as a batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MESSAGE = "value STRING"


@dataclass(frozen=True)
class Topic:
    """A Kafka topic. The connector jar comes with spark-submit (--packages)."""

    servers: str
    name: str
    max_offsets_per_trigger: int | None = None
    min_partitions: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def options(self, starting: str, streaming: bool) -> dict[str, str]:
        chosen = {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": self.name,
            "startingOffsets": starting,
        }
        if streaming and self.max_offsets_per_trigger:
            chosen["maxOffsetsPerTrigger"] = str(self.max_offsets_per_trigger)
        if self.min_partitions:
            chosen["minPartitions"] = str(self.min_partitions)
        return {**chosen, **self.extra}

    def stream(self, spark: SparkSession) -> DataFrame:
        """New messages from now on; a restarted query goes on from its checkpoint instead."""
        return self._load(spark.readStream, "latest", True)

    def read(self, spark: SparkSession) -> DataFrame:
        """Every message the topic still holds."""
        return self._load(spark.read, "earliest", False)

    def _load(self, reader, starting: str, streaming: bool) -> DataFrame:
        return reader.format("kafka").options(**self.options(starting, streaming)).load().select("value")


@dataclass(frozen=True)
class MessageFiles:
    """A directory of message files: text lines, or parquet with a `value` column. Partition columns
    of its subdirectories are no part of a message."""

    path: str
    format: str = "text"
    max_files_per_trigger: int | None = None

    def stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.format(self.format).schema(MESSAGE)
        if self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        return reader.load(self.path).select("value")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.format(self.format).schema(MESSAGE).load(self.path).select("value")
