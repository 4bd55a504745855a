"""The best split of a numeric feature by Gini impurity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.running import running


def best_split(df: DataFrame, feature: str, label: Column, digits: int = 6) -> DataFrame:
    """(threshold, impurity, n_left, n_right): the midpoint of two values with the least weighted impurity of both sides.

    Rows are summed by value first, and running sums of the values come in parts. Ties go to the smaller threshold.
    """
    y = label.cast("long")
    values = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("double").alias("v")).agg(F.count("*").alias("c"), F.sum(y).alias("pos"))
    total = values.agg(F.sum("c").alias("n"), F.sum("pos").alias("p"))
    steps = running(values, [], "v", sums={"nl": F.col("c"), "pl": F.col("pos")}, following={"next": F.col("v")}).join(F.broadcast(total))
    steps = steps.where(F.col("next").isNotNull()).withColumn("nr", F.col("n") - F.col("nl")).withColumn("pr", F.col("p") - F.col("pl"))
    gini = lambda p, n: 2.0 * (F.col(p) / F.col(n)) * (1 - F.col(p) / F.col(n))
    cost = (F.col("nl") * gini("pl", "nl") + F.col("nr") * gini("pr", "nr")) / F.col("n")
    return steps.select(((F.col("v") + F.col("next")) / 2).alias("threshold"), F.round(cost, digits).alias("impurity"), F.col("nl").alias("n_left"), F.col("nr").alias("n_right")).orderBy("impurity", "threshold").limit(1)
