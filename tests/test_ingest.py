import pytest
from pyspark.sql import functions as F

from flowgauge import schemas
from flowgauge.functions.wire import json_int, reading_json
from flowgauge.operators.alerts import alert_messages, parse_alerts, with_status
from flowgauge.operators.ingest import parse_messages, quarantined, valid_readings
from tests.helpers import at, readings, same_rows, tuples

MESSAGES = {
    "a": '{"sensor_id":"a","timestamp":"2026-05-09T17:00:00.123400+00:00","vehicle_count":5,"avg_speed":9.5}',
    "b": '{"sensor_id":"b","timestamp":"2026-05-09T17:00:00+05:30","avg_speed":9.5}',
    "c": '{"sensor_id":"c","timestamp":"2026-05-09T17:00:00+00:00","vehicle_count":"7","avg_speed":10}',
    "d": '{"sensor_id":"d","timestamp":"x","vehicle_count":7.5,"avg_speed":1}',
    "text": "not json",
    "empty": "",
    "array": "[1, 2]",
    "null": None,
}


@pytest.fixture
def parsed(spark):
    rows = [(m,) for m in MESSAGES.values()]
    return parse_messages(spark.createDataFrame(rows, "value STRING"))


def test_every_message_gives_one_row(parsed):
    assert parsed.count() == len(MESSAGES)


def test_fields_and_event_time(parsed):
    found = {
        row.sensor_id: (row.event_time, row.vehicle_count, row.avg_speed)
        for row in parsed.filter("sensor_id IS NOT NULL").collect()
    }
    zone_less = {
        row.sensor_id: row.event_time
        for row in parsed.select("sensor_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))
        .filter("sensor_id IS NOT NULL")
        .collect()
    }
    assert zone_less["a"] == at("17:00:00.123400")
    assert zone_less["b"] == at("11:30:00")
    assert found["a"][1:] == (5, 9.5)
    assert found["b"][1:] == (None, 9.5)
    assert found["c"][1:] == (None, 10.0)
    assert found["d"] == (None, None, 1.0)


def test_binary_values_parse_like_text(spark):
    binary = spark.createDataFrame([(MESSAGES["a"].encode(),)], "value BINARY")
    assert tuples(valid_readings(parse_messages(binary))) == [("a", at("17:00:00.123400"), 5, 9.5)]


def test_valid_and_quarantined_split_the_input(parsed):
    valid = valid_readings(parsed)
    assert valid.schema.simpleString() == (
        "struct<sensor_id:string,event_time:timestamp_ntz,vehicle_count:int,avg_speed:double>"
    )
    assert tuples(valid) == [("a", at("17:00:00.123400"), 5, 9.5)]
    everything = "sensor_id,event_time,vehicle_count,avg_speed"
    same_rows(
        tuples(quarantined(parsed)),
        [
            (MESSAGES["b"], "vehicle_count"),
            (MESSAGES["c"], "vehicle_count"),
            (MESSAGES["d"], "event_time,vehicle_count"),
            (MESSAGES["text"], everything),
            (MESSAGES["empty"], everything),
            (MESSAGES["array"], everything),
            (None, everything),
        ],
    )


def test_a_speed_that_is_no_number_keeps_the_contract(spark):
    text = MESSAGES["a"].replace("9.5", "NaN")
    parsed = parse_messages(spark.createDataFrame([(text,)], "value STRING"))
    assert valid_readings(parsed).count() == 1
    assert quarantined(parsed).count() == 0


def test_contract_filter_parses_each_message_once(parsed):
    plan = valid_readings(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_alert_text(parsed):
    assert [r.value for r in alert_messages(parsed).collect()] == [
        '{"sensor_id":"a","timestamp":"2026-05-09 17:00:00.1234","avg_speed":9.5,"vehicle_count":5}',
        '{"sensor_id":"b","timestamp":"2026-05-09 11:30:00","avg_speed":9.5}',
        '{"sensor_id":"d","avg_speed":1.0}',
    ]


def test_alert_threshold_is_strict(spark):
    rows = readings(
        spark, ("x", "10:00:00", 1, 9.99), ("y", "10:00:00", 1, 10.0), ("z", "10:00:00", 1, None)
    )
    assert [r.sensor_id for r in parse_alerts(alert_messages(rows)).collect()] == ["x"]
    status = {r.sensor_id: r.status for r in with_status(rows).collect()}
    assert status == {"x": "CRITICAL", "y": "NORMAL", "z": "NORMAL"}


def test_alerts_read_back(spark):
    rows = readings(spark, ("x", "10:00:00.5", 3, 0.25))
    assert tuples(parse_alerts(alert_messages(rows))) == [("x", at("10:00:00.5"), 0.25, 3)]


def test_encoded_readings_parse_back(spark):
    rows = readings(spark, ("x", "10:00:00.000001", 3, 1.239), ("y", "23:59:59.999999", 0, 0.0))
    text = rows.select(reading_json(*[F.col(c) for c in schemas.READING_COLUMNS]).alias("value"))
    same_rows(
        tuples(valid_readings(parse_messages(text))),
        [("x", at("10:00:00.000001"), 3, 1.24), ("y", at("23:59:59.999999"), 0, 0.0)],
    )


def test_json_int_agrees_with_the_parser(spark):
    texts = [
        '{"k": 5}', '{"k": -5}', '{"k":5}', '{ "k": 5 }', '{"k": 5, "z": 1}', '{"z": 1, "k": 5}',
        '{"k": 0}', '{"k": 007}', '{"k": +7}', '{"k": 7 }', '{"k": 7.5}', '{"k": 1e2}',
        '{"k": 2147483647}', '{"k": 2147483648}', '{"k": -2147483648}', '{"k": "7"}', '{"k": null}',
        '{"k": {"k": 5}}', '{"k": }', '{"k": ', '{"k": 5', "", "5}", '{"j": 5}', None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    both = rows.select(
        "t",
        json_int(F.col("t"), "k").alias("got"),
        F.get_json_object("t", "$.k").try_cast("int").alias("want"),
    ).collect()
    assert [(r.t, r.got) for r in both] == [(r.t, r.want) for r in both]
