"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import materialize


#: Links that one file of the loop's tables holds at least: few links make few files, whatever the shuffle partitions.
FILE_LINKS = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b), component being the smallest node reachable.

    Each round lets every node point at its smallest neighbour, follows the pointers to their roots, and goes on with
    the links between different roots. Pointers strictly decrease, so there are no cycles; every table is written to
    the shared folder, and nothing but row counts reaches the driver. A node of very many links, or a component of very
    many nodes, makes a skewed partition of a merge join, which Spark's adaptive execution splits; minima are taken in
    each task before they are shuffled. Null ends and self links are ignored; an empty table gives an empty result.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = materialize(links, "links")
    parts = max(8, links.count() // FILE_LINKS)
    write = lambda df, name: materialize(df.coalesce(parts), name)
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"))
        up = _roots(write(up, "pointers"), write)
        labels = up if labels is None else _follow(labels, up)
        labels = write(labels, "labels")
        left = up.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        across = links.join(left, "a").join(right, "b").where("ra <> rb")
        links = write(across.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _follow(labels: DataFrame, up: DataFrame) -> DataFrame:
    step = up.select(F.col("node").alias("component"), F.col("component").alias("next"))
    return labels.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))


def _roots(up: DataFrame, write) -> DataFrame:
    """Pointer jumping until every node points at a root."""
    while True:
        step = up.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = write(up.join(step, "component").select("node", F.col("next").alias("component"), (F.col("next") < F.col("component")).alias("moved")), "pointers")
        up = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return up
