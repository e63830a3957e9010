"""The log of finished micro-batches: what makes all outputs of a batch visible together.

A batch writes its outputs first, each under its query's and batch's own folders, then one entry of
this log. Readers leave out batches without an entry, so they see all outputs of a batch or none, also
after a crash between two sinks. A replayed batch that has its entry writes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.folders import Folder

# Entries to a folder: finding the last one lists two folders of bounded length.
PER_FOLDER = 1000

ENTRY = (
    "query_id STRING, batch_id BIGINT, since BIGINT, valid BIGINT, broken BIGINT, alerts BIGINT, "
    "partials BIGINT, windows BIGINT, least STRING, greatest STRING, newest STRING"
)


@dataclass(frozen=True)
class BatchLog:
    """Entries of one or more queries, a small file each; batches of a query finish in order.

    An entry holds the batch's counts and its least and greatest event time, and over all batches
    of the query so far the first logged one (`since`), the newest event time, and that of batches
    without hourly partials (`uncovered`).
    """

    path: str

    def exists(self, spark: SparkSession) -> bool:
        return Folder(spark, self.path).exists()

    def committed(self, spark: SparkSession) -> dict[str, int]:
        """The last finished batch of each query."""
        found = {query: self._last(spark, query) for query in Folder(spark, self.path).names()}
        return {query: last for query, last in found.items() if last >= 0}

    def _last(self, spark: SparkSession, query: str) -> int:
        place = Folder(spark, f"{self.path}/{query}")
        groups = sorted(int(n) for n in place.names() if n.isdigit())
        while groups:
            names = (place / str(groups.pop())).names()
            batches = [int(n.removesuffix(".json")) for n in names if n[0].isdigit()]
            if batches:
                return max(batches)
        return -1

    def entry(self, spark: SparkSession, query: str, batch_id: int) -> dict | None:
        text = self._place(spark, query, batch_id).text(f"{batch_id}.json")
        return json.loads(text) if text else None

    def _place(self, spark: SparkSession, query: str, batch_id: int) -> Folder:
        return Folder(spark, f"{self.path}/{query}/{batch_id // PER_FOLDER}")

    def commit(self, spark: SparkSession, query: str, batch_id: int, facts: dict) -> None:
        """Enter a batch whose outputs are all written. `facts`: its counts by output, `least` and
        `greatest` event time (None without rows)."""
        before = self.entry(spark, query, batch_id - 1) or {"since": batch_id}
        times = {k: text_of(facts.get(k)) for k in ("least", "greatest")}
        later = lambda name: max(before.get(name) or "", times["greatest"] or "") or None
        entry = {"query_id": query, "batch_id": batch_id, "since": before["since"]}
        entry["newest"] = later("newest")
        entry["uncovered"] = before.get("uncovered") if "partials" in facts else later("uncovered")
        text = json.dumps(entry | facts | times)
        self._place(spark, query, batch_id).create(f"{batch_id}.json", text)

    def newest(self, spark: SparkSession) -> datetime | None:
        """The newest event time of all finished batches; None where the log does not know: it was
        begun after a query's first batch, or no batch had rows."""
        last = [self.entry(spark, query, n) for query, n in self.committed(spark).items()]
        if any(entry["since"] != 0 for entry in last):
            return None
        times = [entry["newest"] for entry in last if entry["newest"]]
        return datetime.fromisoformat(max(times)) if times else None

    def covers(self, spark: SparkSession, since: datetime) -> bool:
        """Whether every reading from a time on is in hourly partials too, as far as the log knows."""
        last = [self.entry(spark, query, n) for query, n in self.committed(spark).items()]
        return all(e["since"] == 0 and (e["uncovered"] or "") < text_of(since) for e in last)

    def table(self, spark: SparkSession) -> DataFrame:
        """All entries, times as times."""
        entries = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(self.path)
        times = {c: F.col(c).cast("timestamp_ntz") for c in ("least", "greatest", "newest")}
        return entries.withColumns(times)


def text_of(time: datetime | None) -> str | None:
    """A time as text that sorts like it."""
    return time and time.isoformat(timespec="microseconds")
