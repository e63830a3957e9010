"""Large files in place of the many small ones that micro-batches leave in a closed date.

Nothing is moved. The compacted rows of a date are written beside its batches, where no reader sees
them, and then one mark says that they stand for the batches up to a given one. Batches that land
meanwhile, or later, are not among those and stay as they are; the next run folds them in. What is
replaced goes in a later run, when no reader can have begun before the mark.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.folders import Folder
from flowgauge.sinks.batches import ParquetTable
from flowgauge.sources.visibility import COMPACTED, Mark, Marks, Snapshot

# How long replaced files stay for readers that began before the mark.
GRACE_SECONDS = 24 * 3600.0


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a query has finished for good, by its checkpoint; -1 before the first."""
    done = (Folder(spark, checkpoint) / "commits").names()
    return max((int(n) for n in done if n.isdigit()), default=-1)


def as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def compact_day(
    spark: SparkSession,
    table: ParquetTable,
    schema: str,
    day: date | str,
    committed: dict[str, int],
    fold: Callable[[DataFrame], DataFrame] = as_they_are,
) -> bool:
    """Write one date of a table (or what else it is partitioned by) as sorted files that stand for
    its finished batches; False if none has come in since the last time, or another run was faster.

    `committed` says, per query id, the last finished batch: later ones, which may be being written,
    and batches of other queries are left as they are. A run that is cut off leaves files that never
    count. `fold` makes fewer rows that stand for the same, as of partial sums.
    """
    name, marks = str(day), Marks(spark, table.path)
    place = Folder(spark, f"{table.path}/{table.date_column}={name}")
    earlier = marks.latest([name]).get(name, Mark(-1, -1, {}))
    fresh = {
        query: committed[query]
        for query in place.values("query_id")
        if query in committed and last_of(place, query, committed[query]) > earlier.folded.get(query, -1)
    }
    if not fresh:
        return False
    known = {day: mark for day, mark in [(name, earlier)] if mark.number >= 0}
    stored = spark.read.schema(schema).option("basePath", table.path).parquet(place.path)
    wanted = Snapshot(fresh, known).visible(table.date_column)
    # What an earlier run has folded in comes from its output, also of queries that wrote no more.
    rows = stored.filter(wanted & (F.col("query_id").isin([COMPACTED, *fresh])))
    output = secrets.randbits(62)
    built = place / f"query_id={COMPACTED}" / f"batch_id={output}"
    kept = [c for c in stored.columns if c not in (table.date_column, "query_id", "batch_id")]
    rows = fold(rows.select(*kept))
    rows.orderBy(*table.sort_by).write.parquet(built.path)
    if marks.add(name, Mark(earlier.number + 1, output, earlier.folded | fresh)):
        return True
    built.delete()
    return False


def last_of(place: Folder, query: str, most: int) -> int:
    """The last batch of a query in a date, up to one."""
    batches = (place / f"query_id={query}").values("batch_id")
    return max((n for n in map(int, batches) if n <= most), default=-1)


def sweep_day(
    spark: SparkSession, table: ParquetTable, day: date | str, grace: float = GRACE_SECONDS
) -> list[str]:
    """Remove what the date's mark replaces, and outputs that never got one, once they are older than
    `grace` seconds; what was removed."""
    name, marks = str(day), Marks(spark, table.path)
    place = Folder(spark, f"{table.path}/{table.date_column}={name}")
    numbers = marks.numbers().get(name, [])
    mark = marks.latest([name]).get(name)
    settled = mark is not None and (marks.place / f"{name}.{mark.number}.json").age_seconds() >= grace
    removed = []
    for query in place.values("query_id"):
        folder = place / f"query_id={query}"
        for batch in folder.values("batch_id"):
            one = folder / f"batch_id={batch}"
            if query == COMPACTED:
                # An output without a mark may be on its way to one; so may an earlier one's readers.
                current = mark is not None and int(batch) == mark.output
                replaced = settled or mark is None
                gone = not current and replaced and one.age_seconds() >= grace
            else:
                gone = settled and int(batch) <= mark.folded.get(query, -1)
            if gone:
                one.delete()
                removed.append(f"{query}/{batch}")
    if settled:
        for number in numbers[:-1]:
            (marks.place / f"{name}.{number}.json").delete()
    return removed
