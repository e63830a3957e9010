import math
import random

import pytest

from flowgauge.operators.ranking import dense_rank_by_score
from flowgauge.session import materialise
from tests.helpers import tuples


def brute_force(scores):
    place = {s: i + 1 for i, s in enumerate(sorted(set(scores), reverse=True))}
    return [(n, s, place[s]) for n, s in enumerate(scores)]


@pytest.fixture(params=["mixed", "one score", "all different", "single row"])
def scores(request):
    rng = random.Random(7)
    if request.param == "mixed":
        # A third of the rows share one score.
        spread = [round(rng.uniform(-5, 50), 2) for _ in range(2000)]
        return [7.5] * 1000 + spread + [math.inf, math.inf, 0.0, -0.0]
    if request.param == "one score":
        return [3.25] * 500
    if request.param == "all different":
        return rng.sample(range(100_000), 3000)
    return [1.0]


def test_rank_agrees_with_brute_force(spark, scores):
    rows = materialise(
        spark.createDataFrame([(n, float(s)) for n, s in enumerate(scores)], "n INT, score DOUBLE")
    )
    want = brute_force([float(s) for s in scores])
    spread = dense_rank_by_score(rows, "score", "place")
    assert spread.schema["place"].dataType.simpleString() == "int"
    # -0.0 and 0.0 are one score; compare values, not their text.
    assert sorted(tuples(spread)) == sorted(want)


def test_no_rows(spark):
    rows = materialise(spark.createDataFrame([], "score DOUBLE"))
    assert dense_rank_by_score(rows, "score", "place").collect() == []
