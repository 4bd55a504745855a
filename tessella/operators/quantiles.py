"""Exact quantiles that hold few values at once."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the sketch that brackets order statistics at first; a bracket holds about 4 / ACCURACY of the rows and what ties with them.
ACCURACY = 10_000
#: Parts of a bracket whose rows are counted in a pass.
PARTS = 4096


def _part(x: Column, low: float, high: float) -> Column:
    """The part of [low, high] that x is in, in order; the ends have parts of their own, so that every pass gets on."""
    inner = F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * PARTS)
    return F.when(x == low, 0).when(x == high, PARTS - 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(PARTS - 2), F.coalesce(inner, F.lit(1))))).cast("int")


def order_statistics(df: DataFrame, wanted: list[tuple[Column, int, float, float]]) -> list[float]:
    """Of each wanted (x, k, low, high) the k-th smallest value of x, counted from 0, which lies within [low, high].

    Each pass counts the rows of each bracket by its parts and goes on within the part that has the k-th, until a part
    has one value. All brackets share a pass, of which PARTS rows a bracket at most come to the driver, whatever ties.
    """
    found: list[float | None] = [low if low == high else None for _, _, low, high in wanted]
    todo = {j: [low, high, None] for j, (_, _, low, high) in enumerate(wanted) if low != high}
    while todo:
        inside = []
        for j, (low, high, _) in todo.items():
            x = wanted[j][0]
            place = F.when(x < low, -1).when(x <= high, _part(x, low, high)) if todo[j][2] is None else F.when((x >= low) & (x <= high), _part(x, low, high))
            inside.append(F.when(place.isNotNull(), F.struct(F.lit(j).alias("j"), place.alias("part"), x.alias("x"))))
        rows = df.select(F.explode(F.array_compact(F.array(*inside))).alias("r")).select("r.*")
        counts: dict[int, list] = {j: [] for j in todo}
        for r in rows.groupBy("j", "part").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
            counts[r["j"]].append((r["part"], r["n"], r["low"], r["high"]))
        for j, parts in counts.items():
            below, k = todo[j][2] or 0, wanted[j][1]
            for part, n, low, high in sorted(parts):
                if part >= 0 and k < below + n:
                    break
                below += n
            else:
                raise ArithmeticError(f"the bracket {todo[j][:2]} misses order statistic {k}")
            if low == high:
                found[j] = low
                del todo[j]
            else:
                todo[j] = [low, high, below]
    return found


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column with linear interpolation between order statistics, None for a column without values.

    Counts, then a mergeable sketch that brackets each order statistic, then order_statistics() within the brackets:
    no task and no array holds a column's values, however many are equal. NaN counts as null.
    """
    cols = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    counts = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(cols)]).first()
    ranks = {(i, k): k / max(counts[f"n{i}"] - 1, 1) for i in range(len(columns)) if counts[f"n{i}"] for p in probs for k in (floor((counts[f"n{i}"] - 1) * p), ceil((counts[f"n{i}"] - 1) * p))}
    value: dict[tuple[int, int], float] = {}
    if ranks:
        ends, aggs = {}, []
        for i in {i for i, _ in ranks}:
            slack = 2 / ACCURACY + 2 / counts[f"n{i}"]
            ends[i] = sorted({e for (c, _), p in ranks.items() if c == i for e in (max(0.0, p - slack), min(1.0, p + slack))})
            aggs += [F.percentile_approx(cols[i], ends[i], ACCURACY).alias(f"e{i}"), F.min(cols[i]).alias(f"l{i}"), F.max(cols[i]).alias(f"h{i}")]
        bounds = df.agg(*aggs).first()
        wanted = []
        for (i, k), p in ranks.items():
            slack = 2 / ACCURACY + 2 / counts[f"n{i}"]
            at = lambda e: bounds[f"e{i}"][ends[i].index(e)]  # noqa: B023, E731
            low = bounds[f"l{i}"] if p - slack <= 0 else at(p - slack)
            wanted.append((cols[i], k, low, bounds[f"h{i}"] if p + slack >= 1 else at(p + slack)))
        value = dict(zip(ranks, order_statistics(df, wanted), strict=True))
    found: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        found[c] = [None] * len(probs)
        if n := counts[f"n{i}"]:
            for x, p in enumerate(probs):
                at = (n - 1) * p
                low, high = value[i, floor(at)], value[i, ceil(at)]
                found[c][x] = low if low == high else low + (high - low) * (at - floor(at))
    return found
