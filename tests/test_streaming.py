import pytest
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.operators.alerts import parse_alerts
from flowgauge.operators.ingest import parse_messages
from flowgauge.operators.windows import window_congestion
from flowgauge.sinks.batches import (
    TextMessages,
    quarantine_parquet,
    raw_parquet,
    window_parquet,
)
from flowgauge.sources.messages import MessageFiles
from flowgauge.sources.tables import (
    as_messages,
    event_readings,
    quarantine_table,
    raw_table,
    window_table,
)
from flowgauge.streaming.queries import (
    WINDOW_SETTINGS,
    Pace,
    await_any,
    start_alerts,
    start_landing,
    start_windows,
    window_settings,
)
from tests.helpers import MessageDir, at, message, readings, same_rows, tuples

ONCE = Pace(available_now=True)

# One file per micro-batch; the first row of the third file is late.
REPLAY = [
    [("17:00:00", 10, 20.0), ("17:04:59", 10, 40.0), ("17:05:00", 7, 7.0)],
    [("17:16:00", 1, 10.0)],
    [("17:03:00", 99, 5.0), ("17:07:00", 3, 9.99)],
    [("17:20:00", 1, 10.0)],
    [("17:20:01", 1, 10.0)],
]


@pytest.fixture
def replay(tmp_path):
    files = MessageDir(tmp_path / "messages")
    for rows in REPLAY:
        files.add([message("j1", *row) for row in rows])
    return files


def parsed_stream(spark, files):
    return parse_messages(MessageFiles(str(files.path), max_files_per_trigger=1).stream(spark))


def run(query):
    query.awaitTermination()
    return query


def windows_of(spark, path):
    return window_table(spark, str(path)).select(*schemas.WINDOW_COLUMNS)


def test_late_rows_miss_the_window(spark, replay, tmp_path):
    query = run(
        start_windows(
            parsed_stream(spark, replay),
            window_parquet(str(tmp_path / "windows")),
            str(tmp_path / "checkpoint"),
            pace=ONCE,
        )
    )
    in_time = (7.0 + 9.99) / 2
    same_rows(
        tuples(windows_of(spark, tmp_path / "windows")),
        [
            ("j1", at("17:00:00"), at("17:05:00"), 30.0, 20, 20 / 30.0),
            ("j1", at("17:05:00"), at("17:10:00"), in_time, 10, 10 / in_time),
        ],
    )
    dropped = {
        p["batchId"]: p["stateOperators"][0]["numRowsDroppedByWatermark"]
        for p in query.recentProgress
        if p["stateOperators"]
    }
    assert {batch for batch, rows in dropped.items() if rows} == {2}
    assert sum(dropped.values()) == 1


def test_settings_are_put_back(spark):
    before = {key: spark.conf.get(key, None) for key in WINDOW_SETTINGS}
    assert before != WINDOW_SETTINGS
    with pytest.raises(RuntimeError):
        with window_settings(spark):
            assert {key: spark.conf.get(key) for key in WINDOW_SETTINGS} == WINDOW_SETTINGS
            raise RuntimeError
    assert {key: spark.conf.get(key, None) for key in WINDOW_SETTINGS} == before


@pytest.mark.parametrize("shared", [False, True])
def test_late_rows_are_stored_and_alerted(spark, replay, tmp_path, shared):
    replay.add(["not json", message("j2", "17:21:00", 1, 9.0)])
    parsed = parsed_stream(spark, replay)
    alerts_dir = str(tmp_path / "alerts")
    run(
        start_landing(
            parsed,
            raw_parquet(str(tmp_path / "raw")),
            str(tmp_path / "c-raw"),
            quarantine=quarantine_parquet(str(tmp_path / "quarantine")),
            alerts=TextMessages(alerts_dir) if shared else None,
            pace=ONCE,
        )
    )
    if not shared:
        run(
            start_alerts(parsed, "text", {"path": alerts_dir}, str(tmp_path / "c-alerts"), pace=ONCE)
        )
    raw = raw_table(spark, str(tmp_path / "raw"))
    want = [("j1", at(t), c, s) for rows in REPLAY for t, c, s in rows]
    same_rows(
        tuples(raw.select(*schemas.READING_COLUMNS)), [*want, ("j2", at("17:21:00"), 1, 9.0)]
    )
    assert [str(r[0]) for r in raw.select("event_date").distinct().collect()] == ["2026-05-09"]
    assert [r.value for r in quarantine_table(spark, str(tmp_path / "quarantine")).collect()] == [
        "not json"
    ]
    sent = MessageFiles(alerts_dir).read(spark)
    assert sent.columns == ["value"]
    alerts = parse_alerts(sent)
    assert sorted(r.avg_speed for r in alerts.collect()) == [5.0, 7.0, 9.0, 9.99]


def test_only_required_outputs(spark, replay, tmp_path):
    run(
        start_landing(
            parsed_stream(spark, replay),
            raw_parquet(str(tmp_path / "raw")),
            str(tmp_path / "checkpoint"),
            pace=ONCE,
        )
    )
    assert raw_table(spark, str(tmp_path / "raw")).count() == 8


def event_lines(spark, sf_dir):
    rows = event_readings(spark, sf_dir).orderBy("event_id")
    return [r.value for r in as_messages(rows).collect()]


def test_stream_equals_batch_over_a_restart(spark, sf_dir, tmp_path):
    lines = event_lines(spark, sf_dir)
    files = MessageDir(tmp_path / "messages")

    def go_on():
        parsed = parsed_stream(spark, files)
        run(
            start_windows(
                parsed, window_parquet(str(tmp_path / "windows")), str(tmp_path / "c-w"), pace=ONCE
            )
        )
        run(
            start_landing(
                parsed, raw_parquet(str(tmp_path / "raw")), str(tmp_path / "c-r"), pace=ONCE
            )
        )

    for part in range(2):
        files.add(lines[part * 2000 : (part + 1) * 2000])
    go_on()
    for part in range(2, 5):
        files.add(lines[part * 2000 : (part + 1) * 2000])
    go_on()

    stored = event_readings(spark, sf_dir)
    newest = stored.agg(F.max("event_time")).head()[0]
    closed = window_congestion(stored).filter(
        F.col("window_end") <= F.lit(str(newest)).cast("timestamp_ntz") - F.expr("INTERVAL 10 MINUTES")
    )

    def comparable(df):
        return tuples(
            df.withColumns({c: F.round(c, 6) for c in ("avg_speed", "congestion_index")})
        )

    found = windows_of(spark, tmp_path / "windows")
    assert found.count() == 8951
    same_rows(comparable(found), comparable(closed))
    raw = raw_table(spark, str(tmp_path / "raw")).select(*schemas.READING_COLUMNS)
    same_rows(tuples(raw), tuples(stored.select(*schemas.READING_COLUMNS)))


def test_replayed_batch_replaces_itself(spark, tmp_path):
    first = readings(spark, ("a", "10:00:00", 1, 1.0), ("a", at("23:59:59", "2026-05-08"), 2, 2.0))
    second = readings(spark, ("b", "10:00:00", 3, 3.0))
    sink = raw_parquet(str(tmp_path / "raw"))
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sink(rows, batch)
    table = raw_table(spark, str(tmp_path / "raw"))
    same_rows(tuples(table.select(*schemas.READING_COLUMNS)), tuples(first.union(second)))
    assert sorted((str(r.event_date), r.batch_id) for r in table.collect()) == [
        ("2026-05-08", 0),
        ("2026-05-09", 0),
        ("2026-05-09", 1),
    ]


def test_a_crash_between_sink_and_commit_leaves_no_duplicates(spark, replay, tmp_path):
    """The batch whose sink fails after writing is run again by the next start."""
    table = raw_parquet(str(tmp_path / "raw"))

    class FailsOnceWritten:
        def __init__(self, table):
            self.table = table

        def for_query(self, query_id):
            return FailsOnceWritten(self.table.for_query(query_id))

        def __call__(self, batch, batch_id):
            self.table(batch, batch_id)
            if batch_id == 2:
                raise RuntimeError("lost")

    parsed = parsed_stream(spark, replay)
    checkpoint = str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="lost"):
        run(start_landing(parsed, FailsOnceWritten(table), checkpoint, pace=ONCE))
    assert raw_table(spark, str(tmp_path / "raw")).count() == 6
    run(start_landing(parsed, table, checkpoint, pace=ONCE))
    assert raw_table(spark, str(tmp_path / "raw")).count() == 8


def test_a_new_checkpoint_or_a_second_writer_adds_its_rows(spark, tmp_path):
    """Both count their batches from 0; neither may replace what the other stored."""
    files = MessageDir(tmp_path / "messages")
    path = str(tmp_path / "raw")
    files.add([message("a", "10:00:00", 1, 1.0)])
    run(start_landing(parsed_stream(spark, files), raw_parquet(path), str(tmp_path / "c1"), pace=ONCE))
    other = MessageDir(tmp_path / "others")
    other.add([message("b", "10:00:00", 2, 2.0), "no json"])
    sinks = {"quarantine": quarantine_parquet(str(tmp_path / "q")), "alerts": TextMessages(str(tmp_path / "a"))}
    for checkpoint, source in (("c2", other), ("c3", files)):
        parsed = parsed_stream(spark, source)
        run(start_landing(parsed, raw_parquet(path), str(tmp_path / checkpoint), pace=ONCE, **sinks))
    rows = raw_table(spark, path)
    assert sorted(r.sensor_id for r in rows.collect()) == ["a", "a", "b"]
    assert {r.batch_id for r in rows.collect()} == {0}
    assert rows.select("query_id").distinct().count() == 3
    assert MessageFiles(str(tmp_path / "a")).read(spark).count() == 2
    assert quarantine_table(spark, str(tmp_path / "q")).count() == 1


def test_windows_count_valid_messages_only(spark, tmp_path):
    files = MessageDir(tmp_path / "messages")
    good = message("a", "10:01:00", 10, 20.0)
    files.add(
        [good, good.replace("10,", '"10",'), good.replace('"sensor_id":"a",', ""), good.replace("20.0", "null")]
    )
    files.add([message("a", "11:00:00", 1, 1.0)])
    files.add([message("a", "11:00:01", 1, 1.0)])
    path = str(tmp_path / "windows")
    run(start_windows(parsed_stream(spark, files), window_parquet(path), str(tmp_path / "c"), pace=ONCE))
    same_rows(tuples(windows_of(spark, path)), [("a", at("10:00:00"), at("10:05:00"), 20.0, 10, 0.5)])


def test_pace_and_end_of_the_application(spark, replay, tmp_path):
    """With an interval the queries go on until one of them ends; then all are stopped."""
    spark.streams.resetTerminated()
    parsed = parsed_stream(spark, replay)
    lasting = start_landing(
        parsed, raw_parquet(str(tmp_path / "raw")), str(tmp_path / "c1"), pace=Pace("200 milliseconds")
    )

    def broken(batch, batch_id):
        raise RuntimeError("sink is gone")

    start_windows(parsed, broken, str(tmp_path / "c2"))
    with pytest.raises(Exception, match="sink is gone"):
        await_any(spark)
    assert not lasting.isActive
    assert not spark.streams.active
    spark.streams.resetTerminated()
