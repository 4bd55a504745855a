"""Exact nearest neighbours of a query set, and classification by their votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalar import ratio


#: Rows of a block of queries and of training rows, about.
QUERY_ROWS, TRAIN_ROWS = 4096, 16_384
#: Numbers of a matrix of distances that a task holds at once.
AT_ONCE = 4_000_000


def nearest(qid: np.ndarray, q: np.ndarray, tid: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """(qid, tid, dist) of the k rows of x nearest to each row of q: rough distances by products, then exact ones of all that may be among them."""
    k, found = min(k, len(x)), []
    square = (x * x).sum(axis=1)
    step = max(1, AT_ONCE // max(len(x), 1))
    for at in range(0, len(q), step):
        own = q[at : at + step]
        size = (own * own).sum(axis=1)[:, None]
        rough = size + square[None, :] - 2 * own @ x.T
        slack = 1e-9 * (size[:, 0] + square.max(initial=0.0) + 1)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + slack
        for i in range(len(own)):
            may = np.flatnonzero(rough[i] <= limit[i])
            exact = np.sqrt(((x[may] - own[i]) ** 2).sum(axis=1))
            best = np.lexsort((tid[may], exact))[:k]
            found.append((np.full(k, qid[at + i]), tid[may][best], exact[best]))
    return pd.DataFrame(dict(zip(("qid", "tid", "dist"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def knn(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(qid, tid, dist, rank) of the k nearest train(tid, vector) of each queries(qid, vector), by Euclidean distance.

    Both sides are dealt into blocks by their ids; a task has one block of either, and sends k rows a query on, of which
    the k best are kept. Nothing passes through the driver but the two counts, no side is broadcast, and the plan is the
    same for any size. Ties go to the smaller tid. qid and tid are not null and tell rows apart.
    """
    sizes = [max(1, -(-df.count() // n)) for df, n in ((queries, QUERY_ROWS), (train, TRAIN_ROWS))]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}, vector), {n}) as int)")
    left = queries.select(F.col("qid").cast("long").alias("qid"), "vector", place("qid", sizes[0]).alias("i"), each(sizes[1]).alias("j"))
    right = train.select(F.col("tid").cast("long").alias("tid"), "vector", place("tid", sizes[1]).alias("j"), each(sizes[0]).alias("i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qid": [], "tid": [], "dist": []})
        q, x = (np.array(side["vector"].tolist(), np.float64) for side in (a, b))
        return nearest(a["qid"].to_numpy(np.int64), q, b["tid"].to_numpy(np.int64), x, k)

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "qid long, tid long, dist double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "tid")).cast("long")
    return found.select("qid", "tid", "dist", rank.alias("rank")).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, k, votes, yhat) of labels(tid, y) for every k up to the neighbours' number: 1 if more than half vote for it."""
    joined = neighbours.join(labels, "tid")
    upto = F.sum("y").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    counted = joined.select("qid", F.col("rank").alias("k"), upto.cast("long").alias("votes"))
    return counted.withColumn("yhat", (F.col("votes") * 2 > F.col("k")).cast("long"))


def k_sweep(voted: DataFrame, truth: DataFrame, digits: int = 6) -> DataFrame:
    """(k, f1, error) of truth(qid, y) for every k, from one list of neighbours."""
    joined = voted.join(truth, "qid")
    n = lambda y, h: F.count_if((F.col("y") == y) & (F.col("yhat") == h))
    cells = joined.groupBy("k").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return cells.select("k", F.round(f1, digits).alias("f1"), F.round(1 - f1, digits).alias("error"))
