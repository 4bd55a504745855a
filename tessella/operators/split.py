"""Deterministic stratified splits, folds and training sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.running import running


def order_key(key: Column, seed: int = 42) -> Column:
    """A random order that is a function of seed and key alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stratum_ranks(df: DataFrame, label: str, key: str, seed: int | None = 42, bins: int = 4096) -> DataFrame:
    """Adds _rank (from 1) and _n, the place in the random order within the label's rows and their number.

    The order is dealt out by its leading bits: a window holds one bin of one label, and the bins' counts, which are
    `bins` rows a label at most, give its start. So no task holds a whole label. Without a seed, rows are ordered by
    the key itself, a number that tells them apart, and ranks are running counts in parts of it.
    """
    if seed is None:
        counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
        ranked = running(df, [label], key, sums={"_rank": F.lit(1).cast("long")})
        return ranked.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    order = order_key(F.col(key), seed)
    width = len(f"{bins - 1:x}")
    df = df.withColumn("_order", order).withColumn("_bin", F.substring("_order", 1, width))
    counts = df.groupBy(label, "_bin").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(label)
    starts = counts.select(F.col(label).alias("_label"), F.col("_bin").alias("_b"), (F.sum("_c").over(w.orderBy("_bin")) - F.col("_c")).alias("_start"), F.sum("_c").over(w).alias("_n"))
    joined = df.join(starts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bin") == F.col("_b")))
    within = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_order", key))
    return joined.withColumn("_rank", F.col("_start") + within).drop("_label", "_b", "_start", "_order", "_bin")


def stratified_split(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds `split`. shares: of the parts but the last, e.g. {"train": 0.6, "val": 0.2, "test": 0.2}; each cut is the floor of its share of a label's rows."""
    ranked = stratum_ranks(df, label, key, seed)
    names, upto, choice = list(shares), 0.0, None
    for name in names[:-1]:
        upto += shares[name]
        inside = F.col("_rank") <= F.floor(F.col("_n") * F.lit(round(upto, 9)))
        choice = F.when(inside, name) if choice is None else choice.when(inside, name)
    return ranked.withColumn("split", choice.otherwise(names[-1])).drop("_rank", "_n")


def kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int | None = 42) -> DataFrame:
    """Adds `fold` from 0: each label's rows are dealt in turn, in random order or, without a seed, in order of the key."""
    return stratum_ranks(df, label, key, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("long")).drop("_rank", "_n")


def training_sizes(n: DataFrame, steps: int = 10) -> DataFrame:
    """(step, size) of the prefixes 1/steps .. 1 of a one-row count table n(n)."""
    return n.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(steps).cast("long"))).alias("step"), "n").select("step", F.floor(F.col("n") * F.col("step") / steps).alias("size"))
