"""Which rows of a table count: those of finished micro-batches, and of what was compacted either the
batches or the file that holds them."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from flowgauge.folders import Folder
from flowgauge.sinks.batch_log import BatchLog
from flowgauge.sinks.batches import NO_QUERY

# The query id of compacted rows; their batch id is the number of the compacted output.
COMPACTED = "compacted"

MARK = "day STRING, number BIGINT, output BIGINT, folded MAP<STRING, BIGINT>"


@dataclass(frozen=True)
class Mark:
    """What the compacted output of a date replaces: of each query all batches up to one. The mark
    with the highest number counts."""

    number: int
    output: int
    folded: dict[str, int]


@dataclass(frozen=True)
class Marks:
    """The marks of a table, a small file each, created if absent: of two compactions of the same
    date at a time one has the number, and the other's output never counts."""

    spark: SparkSession
    table: str

    @property
    def place(self) -> Folder:
        return Folder(self.spark, f"{self.table}/_marks")

    def numbers(self) -> dict[str, list[int]]:
        """Numbers of each date's marks, ascending."""
        found: dict[str, list[int]] = {}
        for name in self.place.names():
            if not name.startswith("."):
                day, _, number = name.removesuffix(".json").rpartition(".")
                found.setdefault(day, []).append(int(number))
        return {day: sorted(numbers) for day, numbers in found.items()}

    def latest(self, days: Iterable[str] | None = None) -> dict[str, Mark]:
        """The mark that counts of each date, or of those given."""
        if days is None:
            return self._all()
        numbers, found = self.numbers(), {}
        for day in days:
            if day in numbers:
                entry = json.loads(self.place.text(file_name(day, numbers[day][-1])))
                found[day] = Mark(entry["number"], entry["output"], entry["folded"])
        return found

    def _all(self) -> dict[str, Mark]:
        """Read by Spark: there is one for each compacted date."""
        if not self.place.names():
            return {}
        found: dict[str, Mark] = {}
        rows = self.spark.read.schema(MARK).json(self.place.path).orderBy("number").collect()
        for row in rows:
            found[row["day"]] = Mark(row["number"], row["output"], row["folded"] or {})
        return found

    def add(self, day: str, mark: Mark) -> bool:
        """False if another compaction has taken the number."""
        entry = {"day": day, "number": mark.number, "output": mark.output, "folded": mark.folded}
        return self.place.create(file_name(day, mark.number), json.dumps(entry))


def file_name(day: str, number: int) -> str:
    return f"{day}.{number}.json"


@dataclass(frozen=True)
class Snapshot:
    """What counts at one time. Outputs of a query that are read through the same snapshot agree.

    `committed` is None for tables without a log, of which every batch counts.
    """

    committed: dict[str, int] | None = None
    marks: dict[str, Mark] = field(default_factory=dict)

    def visible(self, date_column: str | None = None) -> Column:
        """A predicate on the partition columns alone, so that Spark drops whole folders by it."""
        query, batch = F.col("query_id"), F.col("batch_id")
        alive = F.lit(True)
        if self.committed is not None:
            each = [(query == q) & (batch <= n) for q, n in self.committed.items()]
            alive = reduce(Column.__or__, each, query == NO_QUERY)
        if date_column is None or not self.marks:
            return (query != COMPACTED) & alive
        day = F.col(date_column).cast("string")
        folded = {f"{d}/{q}": n for d, mark in self.marks.items() for q, n in mark.folded.items()}
        output = {d: mark.output for d, mark in self.marks.items()}
        open_batch = F.coalesce(looked_up(folded, F.concat_ws("/", day, query)), F.lit(-1)) < batch
        chosen = F.coalesce(looked_up(output, day) == batch, F.lit(False))
        return F.when(query == COMPACTED, chosen).otherwise(alive & open_batch)


def looked_up(values: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    if not pairs:
        return F.lit(None).cast("bigint")
    return F.try_element_at(F.create_map(*pairs), key).cast("bigint")


def own_log(table: str) -> BatchLog:
    """The log of the query that writes a table, unless another one is named."""
    return BatchLog(f"{table}/_log")


def snapshot(
    spark: SparkSession, table: str, log: BatchLog | None = None, days: list[date] | None = None
) -> Snapshot:
    """What counts of a table now, of some dates alone if they are given."""
    return snapshots(spark, [table], log or own_log(table), days)[0]


def snapshots(
    spark: SparkSession, tables: list[str], log: BatchLog, days: list[date] | None = None
) -> list[Snapshot]:
    """The same of tables that one query writes, so that they agree on the batches.

    Marks before the log: a batch that a mark replaces is then in the log as well, so that no batch
    is seen in part. Replaced batches stay for a while, so files listed later are still there.
    """
    named = None if days is None else [d.isoformat() for d in days]
    marks = [Marks(spark, table).latest(named) for table in tables]
    committed = log.committed(spark) if log.exists(spark) else None
    return [Snapshot(committed, m) for m in marks]
