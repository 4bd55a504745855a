"""Explanations: linear contributions, Shapley values of trees and of any predictor, and rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contributions(df: DataFrame, key: list[str], scaled: dict[str, str], weights: dict[str, float], digits: int = 6) -> DataFrame:
    """(key, feature, value, contribution): weight times scaled value; scaled maps a feature to its column."""
    structs = [F.struct(F.lit(f).alias("feature"), F.round(c, digits).alias("value"), F.round(F.col(c) * weights[f], digits).alias("contribution")) for f, c in scaled.items()]
    return df.select(*key, F.explode(F.array(*structs)).alias("r")).select(*key, "r.*")


def top_features(contribs: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k largest contributions of each row by absolute value, ranked."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.abs("contribution").desc(), "feature", "value")).cast("long")
    return contribs.withColumn("rank", rank).where(F.col("rank") <= k)


def linear_shap(df: DataFrame, key: list[str], weights: dict[str, float], background: DataFrame, digits: int = 6) -> DataFrame:
    """(key, feature, value, phi): weight times the distance to the background's mean."""
    means = background.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in weights])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.round((F.col(c) - F.col(f"_m_{c}")) * w, digits).alias("phi")) for c, w in weights.items()]
    return df.join(F.broadcast(means)).select(*key, F.explode(F.array(*structs)).alias("r")).select(*key, "r.*")


def global_ranking(phis: DataFrame, top: int, digits: int = 6) -> DataFrame:
    """(feature, importance): mean absolute value, the largest first."""
    found = phis.groupBy("feature").agg(F.round(F.avg(F.abs("phi")), digits).alias("importance"))
    return found.orderBy(F.col("importance").desc(), "feature").limit(top)


def tree_nodes(model) -> list[dict]:
    """Nodes of a fitted pyspark.ml tree, children by index; value is the share of class 1."""
    nodes: list[dict] = []

    def walk(node) -> int:
        at, counts = len(nodes), list(node.impurityStats().stats())
        total = sum(counts)
        nodes.append({"weight": total, "value": counts[1] / total if len(counts) > 1 and total else 0.0, "feature": -1})
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[at] |= {"feature": split.featureIndex(), "threshold": split.threshold()}
            nodes[at] |= {"left": walk(node.leftChild()), "right": walk(node.rightChild())}
        return at

    walk(model._call_java("rootNode"))
    return nodes


def tree_predict(nodes: list[dict], x: np.ndarray, known: frozenset[int] | None = None, at: int = 0) -> np.ndarray:
    """Expected share of class 1 of rows x when the features in `known` are known (None: all); unknown splits by the training weights."""
    node = nodes[at]
    if node["feature"] < 0:
        return np.full(len(x), node["value"])
    left, right = (tree_predict(nodes, x, known, node[s]) for s in ("left", "right"))
    if known is None or node["feature"] in known:
        return np.where(x[:, node["feature"]] <= node["threshold"], left, right)
    share = nodes[node["left"]]["weight"] / node["weight"]
    return share * left + (1 - share) * right


def tree_score(nodes: list[dict], features: list[str], at: int = 0) -> Column:
    """The value of the leaf that a row reaches, as an expression; a null feature goes to the right."""
    node = nodes[at]
    if node["feature"] < 0:
        return F.lit(float(node["value"]))
    left, right = (tree_score(nodes, features, node[s]) for s in ("left", "right"))
    return F.when(F.col(features[node["feature"]]) <= F.lit(float(node["threshold"])), left).otherwise(right)


def tree_counts(df: DataFrame, features: list[str], label: Column, nodes: list[dict]) -> DataFrame:
    """(node, n, pos) of the rows of df that pass each node of a tree, in one aggregation."""
    passes: dict[int, Column] = {0: F.lit(True)}

    def walk(at: int) -> None:
        if nodes[at]["feature"] >= 0:
            low = F.coalesce(F.col(features[nodes[at]["feature"]]) <= F.lit(float(nodes[at]["threshold"])), F.lit(False))
            passes[nodes[at]["left"]], passes[nodes[at]["right"]] = passes[at] & low, passes[at] & ~low
            walk(nodes[at]["left"])
            walk(nodes[at]["right"])

    walk(0)
    row = df.agg(*[f.alias(f"{n}{i}") for i, c in passes.items() for n, f in (("n", F.count_if(c)), ("p", F.count_if(c & (label == 1))))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("node"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("pos")) for i in passes])).alias("r")).select("r.*")


def tree_gains(counts: DataFrame, features: list[str], nodes: list[dict], digits: int = 6) -> DataFrame:
    """(feature, importance): the features' decreases of Gini impurity by tree_counts(), which add up to 1 or are all 0."""
    side = {n[s]: i for i, n in enumerate(nodes) if n["feature"] >= 0 for s in ("left", "right")}
    mass = 2.0 * F.col("pos") * (F.lit(1.0) - F.col("pos") / F.when(F.col("n") > 0, F.col("n")).otherwise(1))
    parts = [F.when(F.col("node") == i, F.lit(n["feature"])) for i, n in enumerate(nodes) if n["feature"] >= 0] + [F.when(F.col("node") == i, F.lit(-1)) for i, n in enumerate(nodes) if n["feature"] < 0]
    own = counts.select(F.coalesce(*parts).alias("f"), F.coalesce(*[F.when(F.col("node") == i, F.lit(nodes[up]["feature"])) for i, up in side.items()]).alias("up"), mass.alias("mass"))
    each = own.select(F.explode(F.array(F.struct("f", F.col("mass").alias("gain")), F.struct(F.col("up").alias("f"), (-F.col("mass")).alias("gain")))).alias("r")).select("r.*").where("f >= 0")
    gains = each.groupBy("f").agg(F.sum("gain").alias("gain"))
    total = gains.agg(F.sum("gain").alias("total"))
    names = F.array(*map(F.lit, features))
    share = F.when(F.col("total") > 0, F.col("gain") / F.col("total")).otherwise(0.0)
    return gains.join(F.broadcast(total)).select(F.element_at(names, F.col("f") + 1).alias("feature"), F.round(share, digits).alias("importance"))


def leaf_paths(nodes: list[dict]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, {feature: (low, high, share)}) of each leaf: the range low < x <= high of a feature on its path, and the share of training weight that its splits let through."""
    found = []

    def walk(at: int, path: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[at]
        if node["feature"] < 0:
            found.append((node["value"], path))
            return
        f = node["feature"]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for side, ends in (("left", (low, min(high, node["threshold"]))), ("right", (max(low, node["threshold"]), high))):
            walk(node[side], path | {f: (*ends, share * nodes[node[side]]["weight"] / node["weight"])})

    walk(0, {})
    return found


def tree_phi(x: np.ndarray, leaves: list[tuple[float, dict[int, tuple[float, float, float]]]]) -> np.ndarray:
    """Path-dependent Shapley values of rows x, leaf by leaf.

    A leaf's expected value with the features S known is its value times a product over its features: whether x is in
    the range, for those in S, or the share, for the others. Such a product game has the Shapley value of a feature
    from the coefficients of the product of the others' (share + inside * t): the one of t ** k weighs
    k! (m - 1 - k)! / m!. So the cost grows with the leaves and the squares of their depths, for any number of features.
    """
    phi = np.zeros_like(x)
    for value, path in leaves:
        m = len(path)
        inside = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in path.items()}
        for f, (_, _, share) in path.items():
            terms = np.zeros((len(x), m))
            terms[:, 0] = 1
            for g, (_, _, other) in path.items():
                if g != f:
                    terms[:, 1:] = terms[:, 1:] * other + terms[:, :-1] * inside[g][:, None]
                    terms[:, 0] *= other
            weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
            phi[:, f] += value * (inside[f] - share) * (terms @ weights)
    return phi


def _long_phi(df: DataFrame, key: str, features: list[str], phi_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, feature, phi) of phi_of(rows of the features); null features count as NaN."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            phi = phi_of(pdf[features].to_numpy(np.float64))
            for j, name in enumerate(features):
                yield pd.DataFrame({key: pdf[key], "feature": name, "phi": phi[:, j]})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, f"{key} long, feature string, phi double")


def tree_shap(df: DataFrame, key: str, features: list[str], nodes: list[dict]) -> DataFrame:
    """(key, feature, phi) of exact path-dependent Shapley values of class 1."""
    leaves = leaf_paths(nodes)
    return _long_phi(df, key, features, lambda x: tree_phi(x, leaves))


def kernel_phi(x: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray) -> np.ndarray:
    """Exact Shapley values of any predictor: all coalitions of the features, the others from every row of the background."""
    m, b = x.shape[1], len(background)
    value = {}
    for n in range(m + 1):
        for s in combinations(range(m), n):
            rows = np.tile(background, (len(x), 1))
            rows[:, list(s)] = np.repeat(x[:, list(s)], b, axis=0)
            value[s] = predict(rows).reshape(len(x), b).mean(axis=1)
    phi = np.zeros_like(x)
    for j in range(m):
        rest = [f for f in range(m) if f != j]
        for n in range(m):
            w = factorial(n) * factorial(m - n - 1) / factorial(m)
            for s in combinations(rest, n):
                phi[:, j] += w * (value[tuple(sorted((*s, j)))] - value[s])
    return phi


def kernel_shap(df: DataFrame, key: str, features: list[str], predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, most: int = 12, at_once: int = 64) -> DataFrame:
    """(key, feature, phi) of any predictor against a bounded background: exact up to `most` features, by random orders of them beyond."""
    if len(features) > most:
        return sampled_shap(df, key, features, predict, background)
    return _long_phi(df, key, features, lambda x: np.concatenate([kernel_phi(x[i : i + at_once], predict, background) for i in range(0, len(x), at_once)] or [x]))


def sampled_shap(df: DataFrame, key: str, features: list[str], predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, orders: int = 64, seed: int = 42) -> DataFrame:
    """(key, feature, phi) of any predictor by random orders of the features, against rows of a bounded background.

    Differences along an order add up to prediction minus background, so that additivity holds for each row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[features].to_numpy(np.float64)
            phi = np.zeros_like(x)
            rng = np.random.default_rng(seed)
            for _ in range(orders):
                order, base = rng.permutation(len(features)), background[rng.integers(len(background))]
                now = np.tile(base, (len(x), 1))
                before = predict(now)
                for j in order:
                    now[:, j] = x[:, j]
                    after = predict(now)
                    phi[:, j] += (after - before) / orders
                    before = after
            for j, name in enumerate(features):
                yield pd.DataFrame({key: pdf[key], "feature": name, "phi": phi[:, j]})

    return df.select(key, *[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(run, f"{key} long, feature string, phi double")
