"""Threshold predictions over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessella.operators.models import logit, threshold_predict


def score_stream(rows: DataFrame, weights: dict[str, float], intercept: float, threshold: float) -> DataFrame:
    """Adds p and yhat to a streaming (or static) DataFrame: no state, so any output mode works."""
    return threshold_predict(rows.withColumn("p", logit(weights, intercept)), threshold)
