"""Compaction beside a running query, and micro-batches whose outputs become visible together."""

import json
from datetime import date, timedelta

import pytest

from flowgauge import schemas
from flowgauge.folders import Folder
from flowgauge.jobs import compact_job, report_job, stream_job
from flowgauge.operators.ingest import parse_messages
from flowgauge.plans.report import congestion_report
from flowgauge.sinks import alert_log
from flowgauge.sinks.alert_log import AlertLog, alerts_after, merge_segments
from flowgauge.sinks.batch_log import PER_FOLDER, BatchLog
from flowgauge.sinks.batches import TextMessages, quarantine_parquet, raw_parquet, window_parquet
from flowgauge.sinks.compaction import committed_batch, compact_day, sweep_day
from flowgauge.sources import tables
from flowgauge.sources.messages import MessageFiles
from flowgauge.sources.tables import alert_table, quarantine_table, raw_table, trailing_raw, window_table
from flowgauge.sources.visibility import Mark, Marks, own_log, snapshot
from flowgauge.streaming.queries import Pace, query_id, start_landing, start_windows
from tests.helpers import MessageDir, at, message, readings, same_rows, tuples

ONCE = Pace(available_now=True)
EARLY, LATE_DAY = date(2026, 5, 8), date(2026, 5, 9)


def parsed(spark, files):
    return parse_messages(MessageFiles(str(files.path), max_files_per_trigger=1).stream(spark))


class Lake:
    """A raw table that a landing query writes, a micro-batch to a file of messages."""

    def __init__(self, spark, tmp_path, batches=0):
        self.spark, self.place = spark, tmp_path
        self.files = MessageDir(tmp_path / "messages")
        self.path, self.checkpoint = str(tmp_path / "raw"), str(tmp_path / "checkpoint")
        for n in range(batches):
            self.files.add(
                [message(f"s{k}", f"10:{n:02d}:00", n, 1.0 + k, str(day)) for k in range(5) for day in (EARLY, LATE_DAY)]
            )
        if batches:
            self.land()

    def land(self, *lines, raw=None, **sinks):
        if lines:
            self.files.add(list(lines))
        raw = raw or raw_parquet(self.path)
        start_landing(parsed(self.spark, self.files), raw, self.checkpoint, pace=ONCE, **sinks).awaitTermination()

    def rows(self, dates=None):
        return tuples(raw_table(self.spark, self.path, dates).select(*schemas.READING_COLUMNS))

    def compact(self, day=EARLY):
        committed = own_log(self.path).committed(self.spark)
        return compact_day(self.spark, raw_parquet(self.path), schemas.RAW_TABLE, day, committed)

    def job(self, *more, before="2026-05-09"):
        argv = ["--raw", self.path, "--before", before, *more]
        return [str(d) for d in compact_job.compact(self.spark, compact_job.arguments(argv))]

    def parts(self, day=EARLY):
        return len(list((self.place / f"raw/event_date={day}").rglob("*.parquet")))


# --- compaction ---------------------------------------------------------------------------------


def test_compaction_keeps_the_rows(spark, tmp_path):
    lake = Lake(spark, tmp_path, 6)
    before = lake.rows()
    assert lake.parts() >= 6
    assert lake.job() == ["2026-05-08"]
    same_rows(lake.rows(), before)
    same_rows(lake.rows([EARLY]), [r for r in before if r[1].date() == EARLY])
    assert raw_table(spark, lake.path, [EARLY]).select("query_id", "batch_id").distinct().count() == 1
    assert lake.job("--grace-hours", "0") == []  # nothing new; the replaced batches go
    assert lake.parts() == 1 and lake.parts(LATE_DAY) >= 6
    same_rows(lake.rows(), before)
    lake.land(message("late", "12:00:00", 1, 1.0, "2026-05-08"))
    with_late = [*before, ("late", at("12:00:00", "2026-05-08"), 1, 1.0)]
    same_rows(lake.rows(), with_late)
    assert lake.job() == ["2026-05-08"] and lake.job("--grace-hours", "0") == []
    assert lake.parts() == 1
    same_rows(lake.rows(), with_late)


def test_a_reading_that_lands_during_compaction_stays(spark, tmp_path, monkeypatch):
    """The stream writes to the date after its files were listed and before the mark is there."""
    lake = Lake(spark, tmp_path, 2)
    before = lake.rows()
    add = Marks.add

    def late_then_mark(self, day, mark):
        lake.land(message("late", "12:00:00", 1, 1.0, "2026-05-08"))
        same_rows(lake.rows(), [*before, ("late", at("12:00:00", "2026-05-08"), 1, 1.0)])
        return add(self, day, mark)

    monkeypatch.setattr(Marks, "add", late_then_mark)
    assert lake.compact()
    monkeypatch.setattr(Marks, "add", add)
    want = [*before, ("late", at("12:00:00", "2026-05-08"), 1, 1.0)]
    same_rows(lake.rows(), want)
    assert sweep_day(spark, raw_parquet(lake.path), EARLY, 0)
    same_rows(lake.rows(), want)
    assert lake.compact()
    same_rows(lake.rows(), want)


def test_the_report_is_whole_at_every_step(spark, tmp_path, monkeypatch):
    """Both trailing dates are read before, during and after compaction and removal."""
    lake = Lake(spark, tmp_path, 3)
    want = lake.rows()
    seen = []

    def look(function):
        def looked(*args, **kw):
            seen.append(tuples(trailing_raw(spark, lake.path, 48)[0].select(*schemas.READING_COLUMNS)))
            try:
                return function(*args, **kw)
            finally:
                seen.append(tuples(trailing_raw(spark, lake.path, 48)[0].select(*schemas.READING_COLUMNS)))

        return looked

    monkeypatch.setattr(Marks, "add", look(Marks.add))
    monkeypatch.setattr(Folder, "delete", look(Folder.delete))
    for day in (EARLY, LATE_DAY):
        assert lake.compact(day)
        sweep_day(spark, raw_parquet(lake.path), day, 0)
    assert len(seen) > 10
    for rows in seen:
        same_rows(rows, want)


def test_a_reader_that_began_before_the_mark_reads_on(spark, tmp_path):
    """Within the grace nothing that it has listed goes away."""
    lake = Lake(spark, tmp_path, 3)
    before = lake.rows()
    begun = raw_table(spark, lake.path)
    assert lake.compact()
    assert sweep_day(spark, raw_parquet(lake.path), EARLY) == []
    same_rows(tuples(begun.select(*schemas.READING_COLUMNS)), before)


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch):
    lake = Lake(spark, tmp_path, 2)
    before, add, inner = lake.rows(), Marks.add, []

    def overtaken(self, day, mark):
        if not inner:
            inner.append(True)
            inner.append(lake.compact())
        return add(self, day, mark)

    monkeypatch.setattr(Marks, "add", overtaken)
    assert lake.compact() is False and inner == [True, True]
    same_rows(lake.rows(), before)
    sweep_day(spark, raw_parquet(lake.path), EARLY, 0)
    same_rows(lake.rows(), before)
    assert lake.parts() == 1


@pytest.mark.parametrize("cut", ["write", "mark"])
def test_a_compaction_that_is_cut_off_never_counts(spark, tmp_path, monkeypatch, cut):
    lake = Lake(spark, tmp_path, 3)
    before = lake.rows()
    if cut == "mark":
        monkeypatch.setattr(Marks, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("cut")))
        with pytest.raises(RuntimeError):
            lake.compact()
        monkeypatch.undo()
    else:
        half = raw_table(spark, lake.path, [EARLY]).drop("event_date", "query_id", "batch_id").limit(2)
        half.write.parquet(f"{lake.path}/event_date={EARLY}/query_id=compacted/batch_id=77")
    same_rows(lake.rows(), before)
    assert lake.compact()
    same_rows(lake.rows(), before)
    sweep_day(spark, raw_parquet(lake.path), EARLY, 0)
    assert lake.parts() == 1
    same_rows(lake.rows(), before)


def test_unfinished_batches_and_other_queries_are_left_alone(spark, tmp_path):
    lake = Lake(spark, tmp_path, 2)
    before = lake.rows()
    row = readings(spark, ("z", at("10:00:00", "2026-05-08"), 1, 1.0))
    raw_parquet(lake.path).for_query("another")(row, 7)  # not entered: being written, or lost
    same_rows(lake.rows(), before)
    assert lake.compact() and not lake.compact()
    own_log(lake.path).commit(spark, "another", 7, {"valid": 1})
    want = [*before, *tuples(row)]
    same_rows(lake.rows(), want)
    assert lake.compact()
    sweep_day(spark, raw_parquet(lake.path), EARLY, 0)
    assert lake.parts() == 1
    same_rows(lake.rows(), want)


def test_batches_without_a_log_are_folded_by_their_checkpoint(spark, tmp_path):
    lake = Lake(spark, tmp_path, 2)
    before, query = lake.rows(), query_id(spark, lake.checkpoint)
    other = str(tmp_path / "elsewhere")
    stored = raw_table(spark, lake.path)
    stored.write.partitionBy("event_date", "query_id", "batch_id").parquet(other)
    assert compact_day(spark, raw_parquet(other), schemas.RAW_TABLE, EARLY, {query: committed_batch(spark, lake.checkpoint)})
    same_rows(tuples(raw_table(spark, other).select(*schemas.READING_COLUMNS)), before)
    assert Marks(spark, other).latest()[str(EARLY)].folded == {query: 1}


def test_windows_are_compacted(spark, tmp_path):
    files, path = MessageDir(tmp_path / "messages"), str(tmp_path / "windows")
    for n in range(0, 50, 12):
        files.add([message("a", f"10:{n:02d}:00", n, 2.0)])
    start_windows(parsed(spark, files), window_parquet(path), str(tmp_path / "c"), pace=ONCE).awaitTermination()
    before = tuples(window_table(spark, path).select(*schemas.WINDOW_COLUMNS))
    assert len(before) == 3
    argv = ["--windows", path, "--before", "2026-05-10"]
    assert compact_job.compact(spark, compact_job.arguments(argv)) == [LATE_DAY]
    same_rows(tuples(window_table(spark, path).select(*schemas.WINDOW_COLUMNS)), before)


def test_marks(spark, tmp_path):
    marks = Marks(spark, str(tmp_path / "t"))
    assert marks.latest() == {} and marks.latest(["2026-05-08"]) == {}
    first, second = Mark(0, 5, {"q": 3}), Mark(1, 6, {"q": 9, "r": 0})
    assert marks.add("2026-05-08", first) and marks.add("2026-05-08", second)
    assert not marks.add("2026-05-08", Mark(1, 8, {}))
    assert marks.add("2026-05-09", Mark(0, 7, {}))
    assert marks.latest() == {"2026-05-08": second, "2026-05-09": Mark(0, 7, {})}
    assert marks.latest(["2026-05-08", "2026-01-01"]) == {"2026-05-08": second}


def test_the_predicate_prunes_folders(spark, tmp_path):
    lake = Lake(spark, tmp_path, 3)
    lake.compact()
    for rows in (raw_table(spark, lake.path), raw_table(spark, lake.path, [EARLY, LATE_DAY])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "+- Filter" not in plan and "Filter (" not in plan
        assert "PartitionFilters: [CASE WHEN (query_id" in plan


# --- the log ------------------------------------------------------------------------------------

BROKEN = "not json"


class Fails:
    """A sink that fails in one batch, after it has written it."""

    def __init__(self, sink, batch):
        self.sink, self.batch, self.path = sink, batch, sink.path

    def for_query(self, query):
        return Fails(self.sink.for_query(query), self.batch)

    def __call__(self, rows, batch_id):
        self.sink(rows, batch_id)
        if batch_id == self.batch:
            raise RuntimeError("lost")


@pytest.mark.parametrize("failing", ["raw", "quarantine", "alerts", "log"])
def test_outputs_of_a_batch_are_visible_together(spark, tmp_path, monkeypatch, failing):
    """A crash after any of the sinks, or before the entry: readers see nothing of the batch; after
    the restart they see all of it, once."""
    lake = Lake(spark, tmp_path)
    for n in range(3):
        lake.files.add([message("a", f"10:{n:02d}:00", n, 5.0), message("b", f"10:{n:02d}:30", n, 50.0), BROKEN])
    sinks = {
        "raw": raw_parquet(lake.path),
        "quarantine": quarantine_parquet(str(tmp_path / "quarantine")),
        "alerts": TextMessages(str(tmp_path / "alerts")),
    }
    log = own_log(lake.path)

    def found():
        seen = snapshot(spark, lake.path)
        outputs = (
            raw_table(spark, lake.path, seen=seen),
            quarantine_table(spark, str(tmp_path / "quarantine"), seen),
            alert_table(spark, str(tmp_path / "alerts"), seen),
        )
        return [sorted(r.batch_id for r in rows.collect()) for rows in outputs]

    crashing = {k: Fails(v, 1) if k == failing else v for k, v in sinks.items()}
    if failing == "log":
        commit = BatchLog.commit

        def lost(self, spark, query, batch_id, facts):
            if batch_id == 1:
                raise RuntimeError("lost")
            commit(self, spark, query, batch_id, facts)

        monkeypatch.setattr(BatchLog, "commit", lost)
    with pytest.raises(Exception, match="lost"):
        lake.land(**crashing, log=log)
    monkeypatch.undo()
    assert found() == [[0, 0], [0], [0]]
    lake.land(**sinks, log=log)
    assert found() == [[0, 0, 1, 1, 2, 2], [0, 1, 2], [0, 1, 2]]


def test_an_entered_batch_is_not_written_again(spark, tmp_path):
    """Spark had not noted the batch when the driver went: it runs again, and its outputs stay."""
    lake = Lake(spark, tmp_path, 2)
    written = []

    class Watched:
        path = lake.path

        def for_query(self, query):
            return self

        def __call__(self, rows, batch_id):
            written.append(batch_id)

    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink()
    before = lake.rows()
    lake.land(raw=Watched(), log=own_log(lake.path))
    assert written == []
    same_rows(lake.rows(), before)


def test_entries(spark, tmp_path):
    lake = Lake(spark, tmp_path)
    lake.land(
        message("a", "10:00:00", 1, 5.0),
        message("a", "09:00:00", 1, 50.0),
        BROKEN,
        quarantine=quarantine_parquet(str(tmp_path / "q")),
        alerts=TextMessages(str(tmp_path / "a")),
    )
    lake.land(BROKEN, quarantine=quarantine_parquet(str(tmp_path / "q")))
    lake.land(message("a", "08:00:00", 1, 50.0))
    rows = own_log(lake.path).table(spark).orderBy("batch_id").drop("query_id", "since", "partials", "windows").collect()
    ten = at("10:00:00")
    assert [tuple(r) for r in rows] == [
        (0, 2, 1, 1, at("09:00:00"), ten, ten),
        (1, 0, 1, None, None, None, ten),
        (2, 1, None, None, at("08:00:00"), at("08:00:00"), ten),
    ]


def test_the_newest_time_comes_from_the_log(spark, tmp_path, monkeypatch):
    """No reading is read for it, over replays, compaction and a second query; equal to the scan."""
    lake = Lake(spark, tmp_path, 3)
    scanned = trailing_raw(spark, lake.path)[1]
    tables_newest = tables.newest_reading
    lake.compact()

    def unwanted(rows):
        raise AssertionError("read the readings")

    monkeypatch.setattr(tables, "newest_reading", unwanted)
    rows, newest = trailing_raw(spark, lake.path)
    assert newest == scanned == at("10:02:00") == tables_newest(raw_table(spark, lake.path))
    assert sorted({r[0] for r in rows.select("event_date").collect()}) == [EARLY, LATE_DAY]
    other = Lake(spark, tmp_path / "other")
    other.path = lake.path
    other.land(message("x", "00:30:00", 1, 1.0, "2026-05-11"))
    rows, newest = trailing_raw(spark, lake.path)
    assert newest == at("00:30:00", "2026-05-11")
    assert {r[0] for r in rows.select("event_date").distinct().collect()} == {newest.date()}
    report = congestion_report(rows, date_column="event_date", newest=newest)
    assert [r.sensor_id for r in report.rows.collect()] == ["x"]


def test_a_log_begun_later_does_not_answer(spark, tmp_path):
    lake = Lake(spark, tmp_path)
    files = lake.files
    files.add([message("a", "10:00:00", 1, 1.0, "2026-05-11")])

    class Unlogged:
        def __init__(self, sink):
            self.sink = sink

        def for_query(self, query):
            return Unlogged(self.sink.for_query(query))

        def __call__(self, rows, batch_id):
            self.sink(rows, batch_id)

    lake.land(raw=Unlogged(raw_parquet(lake.path)))
    assert not own_log(lake.path).exists(spark) and len(lake.rows()) == 1
    lake.land(message("b", "10:00:00", 1, 1.0))
    assert own_log(lake.path).newest(spark) is None
    assert len(lake.rows()) == 2 and trailing_raw(spark, lake.path)[1] == at("10:00:00", "2026-05-11")


def test_last_entry_over_folders(spark, tmp_path):
    log = BatchLog(str(tmp_path / "log"))
    assert log.committed(spark) == {} and not log.exists(spark)
    for batch in (0, PER_FOLDER - 1, PER_FOLDER, 10 * PER_FOLDER + 3, 9 * PER_FOLDER):
        log.commit(spark, "q", batch, {"valid": batch})
    assert log.committed(spark) == {"q": 10 * PER_FOLDER + 3}
    log.commit(spark, "q", 5, {"valid": 1})
    log.commit(spark, "q", 5, {"valid": 2})  # the first entry stays
    assert log.entry(spark, "q", 5)["valid"] == 1 and log.entry(spark, "q", 6) is None


def test_files_are_created_once(spark, tmp_path):
    place = Folder(spark, str(tmp_path / "new/folder"))
    assert place.text("a") is None
    assert place.create("a", "één") and not place.create("a", "two")
    assert place.text("a") == "één" and place.names() == ["a"]
    assert place.age_seconds() < timedelta(minutes=5).total_seconds()


def test_report_job_reads_a_compacted_table(spark, tmp_path):
    lake = Lake(spark, tmp_path, 3)
    chosen = report_job.arguments(["--raw", lake.path, "--out", str(tmp_path / "out")])
    before = tuples(report_job.report_of(spark, chosen).rows)
    lake.job(before="2026-05-10")
    lake.job("--grace-hours", "0", before="2026-05-10")
    same_rows(tuples(report_job.report_of(spark, chosen).rows), before)


# --- alerts -------------------------------------------------------------------------------------


def alerts_in(rows):
    return sorted((r["batch"], r["place"], r["value"]) for r in rows.collect())


def test_readers_follow_the_alerts_from_their_own_positions(spark, tmp_path, monkeypatch):
    """Before, between and after merges each reader gets each alert once; what a reader has listed
    stays for it."""
    monkeypatch.setattr(alert_log, "SEGMENT", 2)
    lake, path = Lake(spark, tmp_path), str(tmp_path / "alerts")
    log = own_log(lake.path)
    after = lambda position=None: alerts_after(spark, path, position, log)
    assert after()[0].count() == 0
    merged, at_two = [], None
    for n in range(7):
        fast = [message("fast", f"10:{n:02d}:00", 1, 99.0)]
        slow = [message(f"s{k}", f"10:{n:02d}:00", k, 1.0 + k) for k in range(3 if n != 4 else 0)]
        lake.land(*fast, *slow, alerts=AlertLog(path), log=log)
        if n == 2:
            rows, at_two = after()
            assert [b for b, _, _ in alerts_in(rows)] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
            begun = after()[0]
        if n in (3, 6):
            before = alerts_in(after()[0])
            merged.append(merge_segments(spark, path, log))
            assert alerts_in(after()[0]) == before
    assert [[int(s) for s in names] for names in merged] == [[0, 1], [2]]
    assert [b for b, _, _ in alerts_in(begun)] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    rows, end = after(at_two)
    assert sorted({b for b, _, _ in alerts_in(rows)}) == [3, 5, 6] and rows.count() == 9
    assert after(end)[0].count() == 0 and after(end)[1] == end
    assert merge_segments(spark, path, log, grace=0) == []
    assert alerts_in(after(at_two)[0]) == alerts_in(rows)
    assert len(list((tmp_path / "alerts").rglob("*.parquet"))) < 7
    other = Lake(spark, tmp_path / "other")
    other.path = lake.path
    other.land(message("x", "11:00:00", 1, 3.0), alerts=AlertLog(path), log=log)
    rows, last = after(end)
    assert [json_of(r)["sensor_id"] for r in rows.collect()] == ["x"] and len(last) == 2
    assert after(last)[0].count() == 0


def json_of(row):
    return json.loads(row["value"])


def test_job_writes_and_merges_the_alert_log(spark, tmp_path):
    files = MessageDir(tmp_path / "messages")
    files.add([message("a", "10:00:00", 1, 2.0), message("a", "10:30:00", 3, 40.0)])
    argv = ["--message-files", str(files.path), "--raw", str(tmp_path / "raw"), "--windows", str(tmp_path / "w"),
            "--alert-log", str(tmp_path / "a"), "--quarantine", str(tmp_path / "q"), "--available-now",
            "--checkpoints", str(tmp_path / "c")]
    for query in stream_job.start(spark, stream_job.arguments(argv)):
        query.awaitTermination()
    rows, _ = alerts_after(spark, str(tmp_path / "a"), None, own_log(str(tmp_path / "raw")))
    assert [json_of(r)["avg_speed"] for r in rows.collect()] == [2.0]
    argv = ["--alert-log", str(tmp_path / "a"), "--log", str(tmp_path / "raw/_log")]
    assert compact_job.compact(spark, compact_job.arguments(argv)) == []
