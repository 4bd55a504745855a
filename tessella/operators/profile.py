"""Profiles: counts, nulls, distributions, histograms and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.quantiles import exact_quantiles


#: Rows of a table of groups that is broadcast; a larger one is joined by its keys.
SMALL = 100_000


def small(groups: DataFrame) -> DataFrame:
    """groups, to be broadcast if it has SMALL rows at most, so that no task receives a large group's rows."""
    return F.broadcast(groups) if groups.limit(SMALL + 1).count() <= SMALL else groups


def _long(row: DataFrame, items: list[tuple[str, list[Column]]], names: list[str]) -> DataFrame:
    """One aggregated row turned into a row for each item: (first name: the item, the others its values)."""
    structs = [F.struct(F.lit(key).alias(names[0]), *[v.alias(n) for v, n in zip(values, names[1:], strict=True)]) for key, values in items]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def column_info(df: DataFrame) -> DataFrame:
    """(column, non_null) of every column, in one pass."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return _long(row, [(c, [F.col(f"c{i}")]) for i, c in enumerate(df.columns)], ["column", "non_null"])


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_total) of the columns, in one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return _long(row, [(c, [F.col("n") - F.col(f"c{i}"), F.col("n")]) for i, c in enumerate(columns)], ["column", "n_null", "n_total"])


def describe(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max): sample deviation, exact interpolated quartiles."""
    aggs, items, quartiles = [], [], exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts = {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
        aggs += [v.alias(f"{k}{i}") for k, v in parts.items()]
        r = lambda v: F.round(v, digits)
        q = [r(F.lit(v).cast("double")) for v in quartiles[c]]
        items.append((c, [F.col(f"n{i}"), r(F.col(f"mean{i}")), r(F.col(f"std{i}")), F.col(f"min{i}"), *q, F.col(f"max{i}")]))
    return _long(df.agg(*aggs), items, ["column", "n", "mean", "std", "min", "q25", "q50", "q75", "max"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) without nulls."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def class_balance(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """(value, n, share): shares of the counts, which are few rows, not of the table."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), digits).alias("share"))


def class_means(df: DataFrame, target: str, columns: list[str], digits: int = 4) -> DataFrame:
    """(class, feature, mean): grouped means of all columns, turned to rows."""
    wide = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("class")).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])
    structs = [F.struct(F.lit(c).alias("feature"), F.round(f"m{i}", digits).alias("mean")) for i, c in enumerate(columns)]
    return wide.select("class", F.explode(F.array(*structs)).alias("r")).select("class", "r.*")


def class_gap(df: DataFrame, target: str, columns: list[str], digits: int = 4) -> DataFrame:
    """(feature, mean0, mean1, gap_pct) between the classes 0 and 1."""
    pick = lambda c, k: F.avg(F.when(F.col(target) == k, F.col(c).cast("double")))
    row = df.agg(*[pick(c, k).alias(f"m{k}_{i}") for i, c in enumerate(columns) for k in (0, 1)])
    gap = lambda i: F.when(F.col(f"m0_{i}") != 0, (F.col(f"m1_{i}") - F.col(f"m0_{i}")) / F.col(f"m0_{i}") * 100)
    items = [(c, [F.round(f"m0_{i}", digits), F.round(f"m1_{i}", digits), F.round(gap(i), digits)]) for i, c in enumerate(columns)]
    return _long(row, items, ["feature", "mean0", "mean1", "gap_pct"])


def histogram(df: DataFrame, column: str, by: str, bins: int = 10) -> DataFrame:
    """(by, bin, n) of equal bins over each group's own range; the last bin holds the maximum."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(F.col(by), x.alias("x"))
    ranges = small(rows.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    joined = rows.alias("r").join(ranges.alias("g"), F.col(f"r.{by}").eqNullSafe(F.col(f"g.{by}"))).select(F.col(f"r.{by}").alias(by), "x", "lo", "hi")
    return joined.groupBy(by, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """(f1, f2, r) of all pairs with f1 before f2, all in one aggregation."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.round(f"r{i}", digits).alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def correlations_with(df: DataFrame, target: Column, columns: list[str], top: int, digits: int = 6) -> DataFrame:
    """(feature, r) of the features most correlated with the target, by absolute value."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), target.cast("double")).alias(f"r{i}") for i, c in enumerate(columns)])
    found = _long(row, [(c, [F.round(f"r{i}", digits)]) for i, c in enumerate(columns)], ["feature", "r"])
    return found.orderBy(F.abs("r").desc_nulls_last(), "feature").limit(top)


def redundant_pairs(df: DataFrame, columns: list[str], least: float, below: float = 1.0) -> DataFrame:
    """Pairs of columns with an absolute correlation above `least` and below `below`."""
    return correlations(df, columns).where((F.abs("r") > least) & (F.abs("r") < below))
