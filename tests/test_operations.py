"""Publishing reports, and what is entered about queries."""

import time
from datetime import date

import pytest

from flowgauge import schemas
from flowgauge.folders import Folder
from flowgauge.jobs import report_job
from flowgauge.jobs.report_job import write_report
from flowgauge.operators.ingest import parse_messages
from flowgauge.operators.rollup import latest_event_time
from flowgauge.plans.report import congestion_report
from flowgauge.sinks import report_files
from flowgauge.sinks.batches import raw_parquet, window_parquet
from flowgauge.sinks.report_files import current_report, new_version, publish, read_csv, report_dir, sweep_versions, utc_today
from flowgauge.sources.messages import MessageFiles, Topic
from flowgauge.streaming.queries import Pace, await_any, start_landing, start_windows
from flowgauge.streaming.supervision import BATCH, ENDED, STARTED, Ledger, Supervisor
from tests.helpers import MessageDir, message, readings, tuples

DAY = date(2026, 5, 9)
ONCE = Pace(available_now=True)


def report(spark, count):
    return congestion_report(readings(spark, ("a", "10:00:00", count, 2.5)))


def totals(spark, out):
    place = current_report(spark, out, DAY)
    return None if place is None else [r.total_vehicles for r in read_csv(spark, f"{place}/report", schemas.REPORT).collect()]


@pytest.mark.parametrize("step", ["report", "display", "matrix_by_sensor", "ticks", "publish", "pointer"])
@pytest.mark.parametrize("earlier", [False, True])
def test_a_crash_leaves_the_old_report_or_the_new(spark, tmp_path, monkeypatch, step, earlier):
    out = str(tmp_path / "out")
    if earlier:
        assert write_report(report(spark, 1), out, DAY)
    write = report_job.write_csv

    def cut(rows, path, order_by):
        if path.endswith(f"/{step}"):
            raise InterruptedError(step)
        write(rows, path, order_by)

    def lost(*_):
        raise InterruptedError(step)

    monkeypatch.setattr(report_job, "write_csv", cut)
    if step == "publish":
        monkeypatch.setattr(report_job, "publish", lost)
    if step == "pointer":
        monkeypatch.setattr(Folder, "create", lost)
    with pytest.raises(InterruptedError):
        write_report(report(spark, 2), out, DAY)
    assert totals(spark, out) == ([1] if earlier else None)
    monkeypatch.undo()
    assert write_report(report(spark, 3), out, DAY)
    assert totals(spark, out) == [3]
    sweep_versions(spark, out, DAY, grace=0)
    assert totals(spark, out) == [3]
    names = [n for n in Folder(spark, report_dir(out, DAY)).names() if n.startswith("version=")]
    assert [f"{report_dir(out, DAY)}/{n}" for n in names] == [current_report(spark, out, DAY)]


def test_readers_find_a_report_while_one_is_published(spark, tmp_path, monkeypatch):
    out, seen = str(tmp_path), []
    assert write_report(report(spark, 1), out, DAY)
    create = Folder.create

    def look(self, name, text):
        seen.append(totals(spark, out))
        made = create(self, name, text)
        seen.append(totals(spark, out))
        return made

    monkeypatch.setattr(Folder, "create", look)
    assert write_report(report(spark, 2), out, DAY)
    assert seen == [[1], [2]]


def test_of_two_runs_the_later_counts(spark, tmp_path):
    out = str(tmp_path)
    one, two = new_version(spark, out, DAY), new_version(spark, out, DAY)
    publish(two, out, DAY)
    publish(one, out, DAY)
    assert current_report(spark, out, DAY).endswith(one.name)
    place, numbers = report_files.pointers(spark, out, DAY)
    assert numbers == [0, 1] and place.text("0") == two.name
    assert sweep_versions(spark, out, DAY) == [] and report_files.pointers(spark, out, DAY)[1] == [0, 1]


def test_the_day_is_the_utc_date():
    assert utc_today().isoformat() == time.strftime("%Y-%m-%d", time.gmtime())
    assert report_dir("s3a://x/out", DAY) == "s3a://x/out/report_date=2026-05-09"


def test_now_stands_in_without_readings(spark):
    nothing = spark.createDataFrame([], schemas.READING)
    found = latest_event_time(nothing).head()[0]
    assert abs((found.date() - utc_today()).days) <= 1


def test_a_topic_starts_at_the_newest_message():
    topic = Topic("host:9092", "readings")
    assert topic.options("latest", True)["startingOffsets"] == "latest"
    assert topic.options("earliest", False)["startingOffsets"] == "earliest"


# --- supervision --------------------------------------------------------------------------------


def settled(ledger, spark, wanted):
    """Events arrive on the listener's own thread."""
    for _ in range(100):
        if Folder(spark, ledger.path).exists():
            rows = ledger.table(spark).orderBy("at").collect()
            if wanted(rows):
                return rows
        time.sleep(0.2)
    raise AssertionError("events are missing")


@pytest.fixture
def supervised(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "events"))
    places = {"raw": str(tmp_path / "c-raw"), "windows": str(tmp_path / "c-windows")}
    supervisor = Supervisor(spark, ledger, places)
    spark.streams.addListener(supervisor)
    yield ledger
    spark.streams.removeListener(supervisor)
    spark.streams.resetTerminated()


def test_a_failure_and_the_restart_are_entered(spark, tmp_path, supervised):
    files = MessageDir(tmp_path / "messages")
    for n in range(3):
        files.add([message("a", f"10:0{n}:00", n, 1.0)])
    table = raw_parquet(str(tmp_path / "raw"))

    def failing(rows, batch_id):
        table(rows, batch_id)
        if batch_id == 1:
            raise RuntimeError("the sink is gone")

    def land(sink):
        parsed = parse_messages(MessageFiles(str(files.path), max_files_per_trigger=1).stream(spark))
        return start_landing(parsed, sink, str(tmp_path / "c-raw"), pace=ONCE, name="raw")

    with pytest.raises(Exception, match="the sink is gone"):
        land(failing).awaitTermination()
    land(table).awaitTermination()
    rows = settled(supervised, spark, lambda rows: sum(r.kind == ENDED for r in rows) == 2)
    ended = {r.run: r for r in rows if r.kind == ENDED}
    assert "the sink is gone" in ended[0].cause and ended[0].batch_id == 1
    assert ended[1].cause is None and ended[1].batch_id is None
    assert sorted(r.run for r in rows if r.kind == STARTED) == [0, 1]
    assert {r.query for r in rows} == {"raw"} and len({r.query_id for r in rows}) == 1
    batches = {(r.run, r.batch_id): r.rows for r in rows if r.kind == BATCH and r.rows}
    assert batches == {(0, 0): 1, (1, 1): 1, (1, 2): 1}


def test_late_rows_are_entered_by_batch(spark, tmp_path, supervised):
    files = MessageDir(tmp_path / "messages")
    files.add([message("a", "10:01:00", 1, 1.0)])
    files.add([message("a", "10:30:00", 1, 1.0)])
    files.add([message("a", "10:02:00", 1, 1.0), message("b", "10:03:00", 1, 1.0), message("a", "10:31:00", 1, 1.0)])
    parsed = parse_messages(MessageFiles(str(files.path), max_files_per_trigger=1).stream(spark))
    start_windows(parsed, window_parquet(str(tmp_path / "w")), str(tmp_path / "c-windows"), pace=ONCE, name="windows").awaitTermination()
    rows = settled(supervised, spark, lambda rows: any(r.kind == ENDED for r in rows))
    late = {r.batch_id: r.late for r in rows if r.kind == BATCH and r.rows}
    assert late == {0: 0, 1: 0, 2: 2}
    assert rows[-1].kind == ENDED and rows[-1].cause is None
    assert [r.watermark[:16] for r in rows if r.kind == BATCH and r.batch_id == 2] == ["2026-05-09T10:20"]


def test_any_end_stops_all(spark, tmp_path, supervised):
    """The application ends with the query that fails first; both ends are entered."""
    files = MessageDir(tmp_path / "messages")
    files.add([message("a", "10:01:00", 1, 1.0)])
    parsed = parse_messages(MessageFiles(str(files.path)).stream(spark))
    lasting = start_landing(parsed, raw_parquet(str(tmp_path / "raw")), str(tmp_path / "c-raw"), pace=Pace("300 milliseconds"), name="raw")

    def broken(rows, batch_id):
        raise RuntimeError("no room")

    start_windows(parsed, broken, str(tmp_path / "c-windows"), name="windows")
    with pytest.raises(Exception, match="no room"):
        await_any(spark)
    rows = settled(supervised, spark, lambda rows: sum(r.kind == ENDED for r in rows) == 2)
    assert not lasting.isActive
    causes = {r.query: r.cause for r in rows if r.kind == ENDED}
    assert causes["raw"] is None and "no room" in causes["windows"]
    assert len(tuples(supervised.table(spark))) == len(rows)
