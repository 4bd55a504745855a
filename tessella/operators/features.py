"""Scaling and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(df: DataFrame, columns: list[str], train: Column, suffix: str = "_z") -> DataFrame:
    """Adds (x - mean) / population deviation with both from the rows where `train` holds; a constant column is only centred."""
    stats = df.agg(*[f(F.when(train, F.col(c).cast("double"))).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.join(F.broadcast(stats))
    z = lambda i, c: (F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)
    return joined.withColumns({c + suffix: z(i, c) for i, c in enumerate(columns)}).select(*df.columns, *[c + suffix for c in columns])


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): all rows over the number of classes and the class's rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))
