"""Running sums, maxima and next values in an order, without a window that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Equal parts of a group's range of the order; a window holds one part of one group, or one row a part.
PARTS = 1024


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, earlier: dict[str, Column] | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """df with running values in order of a number `order`, which tells the rows of a group `by` apart.

    sums, highs: up to the row, inclusive. earlier: the highest before the row. following: the value of the next row.
    Nulls are passed over. The parts' own sums and maxima, few rows a group, give what stands before each part.
    """
    sums, highs, earlier, following = sums or {}, highs or {}, earlier or {}, following or {}
    keys, rows = by, df
    rows = rows.withColumns({f"_v_{k}": v for part in (sums, highs, earlier, following) for k, v in part.items()})
    x = F.col(order).cast("double")
    ranges = rows.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    same = lambda a, b: " and ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys)
    placed = rows.alias("r").join(ranges.alias("g"), F.expr(same("r", "g"))) if by else rows.alias("r").join(F.broadcast(ranges))
    rows = placed.select("r.*", F.when(F.col("_high") > F.col("_low"), F.least(F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int").alias("_part"))
    aggs = [F.sum(f"_v_{k}").alias(f"_p_{k}") for k in sums] + [F.max(f"_v_{k}").alias(f"_p_{k}") for k in (*highs, *earlier)] + [F.min_by(f"_v_{k}", x).alias(f"_p_{k}") for k in following]
    parts = rows.groupBy(*keys, "_part").agg(*aggs)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_part")
    starts = [F.sum(f"_p_{k}").over(before).alias(f"_s_{k}") for k in sums] + [F.max(f"_p_{k}").over(before).alias(f"_s_{k}") for k in (*highs, *earlier)] + [F.lead(f"_p_{k}").over(after).alias(f"_s_{k}") for k in following]
    parts = parts.select(*keys, "_part", *starts)
    joined = rows.alias("r").join(parts.alias("p"), F.expr(" and ".join([*([same("r", "p")] if by else []), "r._part = p._part"]))).select("r.*", *[f"p._s_{k}" for k in (*sums, *highs, *earlier, *following)])
    own = Window.partitionBy(*keys, "_part").orderBy(order)
    upto, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    high = lambda k, w: F.greatest(F.col(f"_s_{k}"), F.max(f"_v_{k}").over(w))
    made = {k: F.coalesce(F.col(f"_s_{k}"), F.lit(0)) + F.coalesce(F.sum(f"_v_{k}").over(upto), F.lit(0)) for k in sums}
    made |= {k: high(k, upto) for k in highs} | {k: high(k, ahead) for k in earlier} | {k: F.coalesce(F.lead(f"_v_{k}").over(own), F.col(f"_s_{k}")) for k in following}
    return joined.select(*df.columns, *[v.alias(k) for k, v in made.items()])
