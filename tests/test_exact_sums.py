"""Sums of doubles: exact, and the same to the last bit under any partitioning."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.operators.exact_sums import HIGHEST, LOWEST, accumulated, banded, merged, with_means
from flowgauge.operators.rollup import hourly_traffic
from flowgauge.operators.windows import window_congestion
from flowgauge.sources.tables import event_readings
from tests.helpers import tuples

EDGES = [math.ldexp(1.0, 32 * k) for k in range(LOWEST + 1, HIGHEST + 1)]
NEAR_EDGES = [f(e) for e in EDGES for f in (float, lambda e: math.nextafter(e, 0.0), lambda e: -e)]
EXTREME = [0.0, -0.0, 5e-324, -5e-324, 2.2e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, -0.3]


def table(spark, groups):
    rows = [(g, v) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "g string, v double")


def means(spark, rows, others=()):
    partials = accumulated(rows, ["g"], "v", n=F.count("*"))
    return {r["g"]: r["m"] for r in with_means(partials, ["g"], "m", "n").collect()}


def test_parts_are_the_value(spark):
    rng = np.random.default_rng(0)
    values = [*EXTREME, *NEAR_EDGES, *(rng.normal(size=2000) * 2.0 ** rng.integers(-1070, 1020, 2000)).tolist()]
    for row in banded(table(spark, {"a": values}), "v").collect():
        assert LOWEST <= row["band"] <= HIGHEST
        assert abs(row["low"]) < 1 << 28 and abs(row["middle"]) < 1 << 28 and abs(row["high"]) <= 1 << 29
        whole = (row["high"] << 56) + (row["middle"] << 28) + row["low"]
        assert whole * Fraction(2) ** (32 * row["band"] - 52) == Fraction(row["v"])


@pytest.mark.parametrize("seed", range(3))
def test_means_are_exact(spark, seed):
    """Against rational arithmetic, over every magnitude and with all but everything cancelling."""
    rng = np.random.default_rng(seed)
    wide = lambda n: (rng.normal(size=n) * 2.0 ** rng.integers(-1000, 900, n)).tolist()
    big = wide(40)
    groups = {
        "speeds": rng.uniform(0, 560, 500).tolist(),
        "cents": np.round(rng.uniform(0, 90, 500), 2).tolist(),
        "wide": wide(60),
        "cancel": [*big, *(-v for v in big), 0.1, 3e-300],
        "tiny": (rng.normal(size=50) * 5e-320).tolist(),
        "edges": [*NEAR_EDGES, *EXTREME[:5]],
        "one": [0.1],
        "zero": [0.0, -0.0],
    }
    found = means(spark, table(spark, groups).repartition(5))
    for name, values in groups.items():
        # Two roundings: of the sum and of the quotient.
        assert found[name] == math.fsum(values) / len(values), name
        assert found[name] == pytest.approx(float(sum(map(Fraction, values)) / len(values)), rel=1e-15, abs=5e-324)


def test_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    groups = {
        "null": [None, None], "some": [None, 2.0, 4.0], "inf": [1.0, inf], "minus": [-inf, 5.0],
        "both": [inf, -inf], "nan": [nan, 1.0], "over": [1.7e308, 1.7e308, 1.0], "back": [1.7e308, 1.7e308, -1.7e308],
    }
    found = means(spark, table(spark, groups))
    assert found["null"] is None and found["some"] == 3.0
    assert found["inf"] == inf and found["minus"] == -inf and found["over"] == inf
    assert math.isnan(found["both"]) and math.isnan(found["nan"])
    assert found["back"] == 1.7e308 / 3


def test_partials_merge_in_any_order(spark):
    rng = np.random.default_rng(5)
    values = (rng.normal(size=3000) * 2.0 ** rng.integers(-40, 40, 3000)).tolist()
    want = math.fsum(values) / len(values)
    for order in range(3):
        shuffled = rng.permutation(values).tolist()
        cuts = sorted(rng.integers(0, 3000, 4).tolist())
        parts = [
            accumulated(table(spark, {"a": shuffled[a:b]}), ["g"], "v", n=F.count("*"))
            for a, b in zip([0, *cuts], [*cuts, 3000])
        ]
        together = parts[0]
        for part in parts[1:]:
            together = merged(together.unionByName(part), ["g"], "n")
        row = with_means(together, ["g"], "m", "n").head()
        assert row["m"] == want and row["n"] == 3000


@pytest.mark.parametrize("operator", [hourly_traffic, window_congestion])
def test_no_partitioning_changes_a_bit(spark, sf_dir, operator):
    readings = event_readings(spark, sf_dir).withColumn("avg_speed", F.col("avg_speed") / 7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        results = []
        for parts, adaptive in ((1, "true"), (13, "false"), (64, "true")):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            results.append(sorted(tuples(operator(readings.repartition(parts, F.rand(parts)))), key=str))
        assert results[0] == results[1] == results[2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_equal_to_the_plain_mean_within_rounding(spark, sf_dir):
    readings = event_readings(spark, sf_dir)
    exact = window_congestion(readings).select("sensor_id", "window_start", "avg_speed")
    plain = readings.groupBy("sensor_id", F.window("event_time", "5 minutes").alias("w")).agg(F.avg("avg_speed").alias("p"))
    joined = exact.join(plain.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")), ["sensor_id", "window_start"])
    assert joined.count() == exact.count()
    assert joined.filter(F.abs(F.col("p") - F.col("avg_speed")) > 1e-12 * F.abs("p")).count() == 0
