"""Decision labels of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge import rules, schemas


def with_labels(ranked: DataFrame, below: float = rules.REPORT_SPEED_BELOW) -> DataFrame:
    """Add both labels. The top rank decides before the speed does."""
    top = F.col("congestion_rank") == 1
    slow = F.col("avg_speed") < below
    intervene = F.when(top | slow, rules.INTERVENE).otherwise(rules.WATCH)
    advice = (
        F.when(top, rules.ADVICE_TOP_RANK)
        .when(slow, rules.ADVICE_SLOW)
        .otherwise(rules.ADVICE_DEFAULT)
    )
    return ranked.withColumns(
        {"intervention_required": intervene, "recommendation": advice}
    ).select(*schemas.REPORT_COLUMNS)
