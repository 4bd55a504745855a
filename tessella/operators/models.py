"""Classifiers: scoring expressions, Spark ML fits, tuning, persistence and validation."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import ratio
from tessella.operators.features import balanced_weights, scale
from tessella.operators.metrics import confusion, rates
from tessella.operators.solver import fit_logistic, predict_logistic


def logit(weights: dict[str, float], intercept: float) -> Column:
    """The probability of a linear model with fixed weights."""
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + F.col(name).cast("double") * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def threshold_predict(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds yhat: p >= threshold."""
    return scores.withColumn("yhat", (F.col("p") >= F.lit(float(threshold))).cast("int"))


def fit_lr(df: DataFrame, features: list[str], label: str, c: float = 1.0, penalty: str = "l2", balanced: bool = False, penalize_intercept: bool = False, max_iter: int = 1000) -> tuple[dict[str, float], float]:
    """Weights and intercept that minimize c * sum of losses + penalty, on features that are scaled already.

    Spark ML minimizes the weighted mean of losses + regParam * penalty, so regParam is 1 / (c * sum of weights). To
    penalize the intercept too, it becomes a feature whose sign, with the label's and all features', alternates by row:
    the loss is the same, and Spark does not drop the column as a constant.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"))
    if balanced:
        rows = rows.join(F.broadcast(balanced_weights(rows, "label").select("label", "weight")), "label")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    inputs = list(features)
    if penalize_intercept:
        flip = F.when(F.xxhash64(*features) % 2 == 0, 1.0).otherwise(-1.0)
        rows = rows.withColumn("_s", flip)
        rows = rows.select(*[(F.col(f) * F.col("_s")).alias(f) for f in features], F.col("_s").alias("_one"), F.when(F.col("_s") > 0, F.col("label")).otherwise(1 - F.col("label")).alias("label"), "weight")
        inputs = [*features, "_one"]
    total = rows.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1 / (c * total), elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False, fitIntercept=not penalize_intercept, maxIter=max_iter, tol=1e-10)
    model = lr.fit(VectorAssembler(inputCols=inputs, outputCol="x").transform(rows))
    w = model.coefficients.toArray()
    if penalize_intercept:
        return dict(zip(features, map(float, w[:-1]), strict=True)), float(w[-1])
    return dict(zip(features, map(float, w), strict=True)), float(model.intercept)


def lr_pipeline(features: list[str], label: str, n: int, c: float = 1.0) -> Pipeline:
    """Assembler and L2 logistic regression over scaled features, with regParam for n training rows."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"),
        LogisticRegression(labelCol=label, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=1000),
    ])


def tree_pipeline(features: list[str], label: str, depth: int, seed: int = 42, bins: int = 256) -> Pipeline:
    """Assembler and a Gini decision tree on raw features."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"),
        DecisionTreeClassifier(labelCol=label, impurity="gini", maxDepth=depth, maxBins=bins, seed=seed),
    ])


def predictions(model: PipelineModel, df: DataFrame, name: str, key: str, label: str, group: str) -> DataFrame:
    """The long table (model, row_id, y, p, yhat, grp) of a fitted pipeline's predictions."""
    p = vector_to_array("probability")[1]
    scored = model.transform(df)
    return threshold_predict(scored.select(F.lit(name).alias("model"), F.col(key).alias("row_id"), F.col(label).cast("int").alias("y"), p.alias("p"), F.col(group).cast("double").alias("grp")))


def tune_depth(train: DataFrame, val: DataFrame, features: list[str], label: str, depths: range, key: str) -> tuple[int, float]:
    """The depth of the highest F1 on val, the smallest among ties."""
    best = (-1.0, 0)
    for d in depths:
        model = tree_pipeline(features, label, d).fit(train)
        f1 = rates(confusion(predictions(model, val, "tree", key, label, key), "model")).first()["f1"]
        if f1 > best[0]:
            best = (f1, d)
    return best[1], best[0]


def tree_importance(model: PipelineModel, spark: SparkSession, features: list[str]) -> DataFrame:
    """(feature, importance), Gini gains normalized to 1."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def save_model(model: PipelineModel, path: str, params: dict) -> None:
    """The pipeline with its parameters (threshold and the like) beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(params, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/params").collect()))


def missing_artifacts(required: DataFrame, existing: DataFrame) -> DataFrame:
    """Names that are required and do not exist."""
    return required.join(existing, "name", "left_anti")


def same_predictions(a: DataFrame, b: DataFrame) -> bool:
    """Whether two prediction tables hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def run_metadata(seed: int, source: str, dropped: list[str], best_k: int, best_depth: int, scores: dict[str, float]) -> dict:
    """The record of a baseline run."""
    return {"random_state": seed, "dataset_path": source, "dropped_columns": dropped, "best_k": best_k, "best_depth": best_depth, "test_metrics": scores}


def f1_score(y: np.ndarray, yhat: np.ndarray) -> float:
    tp, wrong = int(((y == 1) & (yhat == 1)).sum()), int((y != yhat).sum())
    return 2 * tp / (2 * tp + wrong) if tp else 0.0


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int) -> list[dict]:
    """Nodes, as explain.tree_nodes() gives them, of a Gini tree over all midpoints of values; ties go to the first feature, then the smaller threshold."""
    nodes: list[dict] = []

    def grow(rows: np.ndarray, left: int) -> int:
        at, n, pos = len(nodes), len(rows), int(y[rows].sum())
        nodes.append({"weight": float(n), "value": pos / n if n else 0.0, "feature": -1})
        best = None
        for f in range(x.shape[1]) if left and 0 < pos < n else ():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, up = x[order, f], np.cumsum(y[order])[:-1]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if len(cuts):
                nl, pl = cuts + 1.0, up[cuts].astype(float)
                nr, pr = n - nl, pos - pl
                cost = 2 * (pl * (1 - pl / nl) + pr * (1 - pr / nr)) / n
                k = int(np.argmin(cost))
                if best is None or cost[k] < best[0] - 1e-12:
                    best = (float(cost[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if best is not None and best[0] < 2 * pos / n * (1 - pos / n) - 1e-12:
            low = x[rows, best[1]] <= best[2]
            nodes[at] |= {"feature": best[1], "threshold": best[2]}
            nodes[at] |= {"left": grow(rows[low], left - 1), "right": grow(rows[~low], left - 1)}
        return at

    grow(np.arange(len(x)), depth)
    return nodes


def learning_curve(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, steps: int = 10, most: int = 4000, k: int = 7, depth: int = 4) -> DataFrame:
    """(model, step, fold, n_train, f1_train, f1_val) of logistic regression, neighbours and tree on growing prefixes of each fold's training rows.

    Models are fit on the `most` first rows in the random order at most, whose prefixes the steps are; each is one
    task's work. f1_train is over the rows that a model is fit on, and f1_val over all rows of the fold in df, scored
    where they are by all models in one pass. df has a column fold.
    """
    from tessella.operators import explain
    from tessella.operators.split import order_key

    spark = df.sparkSession
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias("y"), F.col("fold").cast("long").alias("fold"))
    sample = rows.orderBy(order_key(F.col(key)), key).limit(most).toPandas().sort_values(key, kind="stable")
    parts = {}
    for part in range(folds):
        own = sample[sample["fold"] != part]
        parts[part] = (own[features].to_numpy(np.float64), own["y"].to_numpy(np.int64))
    cells = [(model, step, part) for model in ("lr", "knn", "tree") for step in range(1, steps + 1) for part in range(folds)]
    shared = spark.sparkContext.broadcast(parts)

    def prefix(step: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, y = shared.value[part]
        n = min(len(x), max(2, len(x) * step // steps))
        x, y = x[:n], y[:n]
        mean, std = (x.mean(axis=0), x.std(axis=0)) if n else (np.zeros(len(features)), np.ones(len(features)))
        return x, y, mean, np.where(std > 0, std, 1.0)

    def fitted(model: str, step: int, part: int):
        x, y, mean, std = prefix(step, part)
        if not len(x) or model == "knn":
            return None
        return fit_tree(x, y, depth) if model == "tree" else fit_logistic((x - mean) / std, y, 1.0, "l2").tolist()

    def predict(model: str, step: int, part: int, own, x: np.ndarray) -> np.ndarray:
        train, y, mean, std = prefix(step, part)
        if not len(train):
            return np.zeros(len(x), int)
        if model == "tree":
            return (explain.tree_predict(own, x) >= 0.5).astype(int)
        if model == "lr":
            return (predict_logistic((x - mean) / std, np.array(own)) >= 0.5).astype(int)
        return knn_predictor((train - mean) / std, y, min(k, len(train)))((x - mean) / std).astype(int)

    def fit_cells(batches):
        for pdf in batches:
            out = []
            for model, step, part in pdf.itertuples(index=False):
                x, y, _, _ = prefix(step, part)
                own = fitted(model, step, part)
                out.append((model, step, part, len(x), f1_score(y, predict(model, step, part, own, x)) if len(x) else 0.0, json.dumps(own)))
            yield pd.DataFrame(out, columns=["model", "step", "fold", "n_train", "f1_train", "made"])

    tasks = spark.createDataFrame(cells, "model string, step long, fold long").repartition(spark.sparkContext.defaultParallelism * 2)
    made = tasks.mapInPandas(fit_cells, "model string, step long, fold long, n_train long, f1_train double, made string").collect()
    ready = spark.sparkContext.broadcast({(r["model"], r["step"], r["fold"]): json.loads(r["made"]) for r in made})

    def score_rows(batches):
        counts = np.zeros((len(cells), 3), np.int64)
        for pdf in batches:
            for c, (model, step, part) in enumerate(cells):
                inside = (pdf["fold"] == part).to_numpy()
                if inside.any():
                    x, y = pdf.loc[inside, features].to_numpy(np.float64), pdf.loc[inside, "y"].to_numpy(np.int64)
                    yhat = predict(model, step, part, ready.value[model, step, part], x)
                    counts[c] += ((y == 1) & (yhat == 1)).sum(), ((y == 0) & (yhat == 1)).sum(), ((y == 1) & (yhat == 0)).sum()
        yield pd.DataFrame([(*cell, *map(int, n)) for cell, n in zip(cells, counts, strict=True)], columns=["model", "step", "fold", "tp", "fp", "fn"])

    scored = rows.drop(key).mapInPandas(score_rows, "model string, step long, fold long, tp long, fp long, fn long")
    sums = scored.groupBy("model", "step", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    found = spark.createDataFrame([tuple(r)[:5] for r in made], "model string, step long, fold long, n_train long, f1_train double")
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return found.join(sums, ["model", "step", "fold"], "left").select("model", "step", "fold", "n_train", "f1_train", F.coalesce(f1, F.lit(0.0)).alias("f1_val"))


def cross_validate_logistic(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """(model, row_id, fold, y, p, yhat) of a logistic regression for each fold, scaled and fit on the other folds' rows."""
    out, z = None, [f + "_z" for f in features]
    for part in range(folds):
        scaled = scale(df, features, F.col("fold") != part)
        weights, intercept = fit_lr(scaled.where(F.col("fold") != part), z, label)
        rows = scaled.where(F.col("fold") == part).select(F.lit("lr").alias("model"), F.col(key).alias("row_id"), "fold", F.col(label).cast("int").alias("y"), logit(weights, intercept).alias("p"))
        out = threshold_predict(rows) if out is None else out.unionByName(threshold_predict(rows))
    return out


def cross_validate(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, k: int = 7, depth: int = 4) -> DataFrame:
    """(model, metric, mean, std) of accuracy, recall and F1 over the folds: logistic regression, neighbours and tree, fit anew on the rows outside each fold.

    Scaling is learned outside the fold as well. df has a column fold.
    """
    from tessella.operators.metrics import fold_summary

    columns = ["model", "row_id", "y", "yhat"]
    out = cross_validate_logistic(df, features, label, key, folds).select(*columns, "fold")
    for part in range(folds):
        scaled = scale(df, features, F.col("fold") != part)
        train, val = scaled.where(F.col("fold") != part), scaled.where(F.col("fold") == part)
        tree = predictions(tree_pipeline(features, label, depth).fit(train), val, "tree", key, label, key).select(*columns)
        near = knn_predictions(train, val, key, label, [f + "_z" for f in features], k).select(*columns)
        out = out.unionByName(tree.unionByName(near).withColumn("fold", F.lit(part).cast(out.schema["fold"].dataType)))
    return fold_summary(rates(confusion(out, "model", "fold")), ["accuracy", "recall", "f1"])


def _vectors(df: DataFrame, key: str, z: list[str], name: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(name), F.array(*[F.col(c).cast("double") for c in z]).alias("vector"))


def tune_k(train: DataFrame, key: str, label: str, z: list[str], most_k: int, folds: int = 5) -> tuple[int, float]:
    """The k up to most_k with the highest mean F1 over the folds, the smallest among ties, and that F1.

    train has scaled columns z and a column fold. One list of neighbours a fold gives all k, over all rows.
    """
    from tessella.operators import knn

    rows = train.select(key, label, "fold", *z)
    labels = rows.select(F.col(key).cast("long").alias("tid"), F.col(label).cast("long").alias("y"))
    sweeps = None
    for k in range(folds):
        inside = F.col("fold") == k
        near = knn.knn(_vectors(rows.where(inside), key, z, "qid"), _vectors(rows.where(~inside), key, z, "tid"), most_k)
        sweep = knn.k_sweep(knn.votes(near, labels), labels.withColumnRenamed("tid", "qid")).select("k", "f1")
        sweeps = sweep if sweeps is None else sweeps.unionByName(sweep)
    best = sweeps.groupBy("k").agg(F.round(F.avg("f1"), 9).alias("f1")).orderBy(F.col("f1").desc(), "k").first()
    return int(best["k"]), float(best["f1"])


def knn_predictions(train: DataFrame, rows: DataFrame, key: str, label: str, z: list[str], k: int) -> DataFrame:
    """The long table of predictions of k nearest neighbours; p is the share of votes."""
    from tessella.operators import knn

    labels = train.select(F.col(key).cast("long").alias("tid"), F.col(label).cast("long").alias("y"))
    voted = knn.votes(knn.knn(_vectors(rows, key, z, "qid"), _vectors(train, key, z, "tid"), k), labels).where(F.col("k") == k)
    truth = rows.select(F.col(key).cast("long").alias("qid"), F.col(label).cast("int").alias("y"))
    joined = voted.join(truth, "qid")
    return joined.select(F.lit("knn").alias("model"), F.col("qid").alias("row_id"), "y", (F.col("votes") / F.col("k")).alias("p"), F.col("yhat").cast("int").alias("yhat"))


def export_baselines(df: DataFrame, features: list[str], label: str, key: str, path: str, depths: range = range(2, 6), most_k: int = 15) -> dict:
    """Train logistic regression, neighbours and tree on 60 %, save all three, and return metadata with F1 on the last 20 %.

    df has the columns split (train, val, test) and fold. The depth is tuned on val, the number of neighbours by
    cross-validation on train; the neighbours' artifact is the scaled training table with its k.
    """
    scaled = scale(df, features, F.col("split") == "train")
    scaled.write.mode("overwrite").parquet(f"{path}/scaled")  # every fit and fold reads it, none repeats what made it
    scaled = df.sparkSession.read.schema(scaled.schema).parquet(f"{path}/scaled")
    z = [f + "_z" for f in features]
    train, val, test = (scaled.where(F.col("split") == s) for s in ("train", "val", "test"))
    depth, _ = tune_depth(train, val, features, label, depths, key)
    k, _ = tune_k(train, key, label, z, most_k)
    lr = lr_pipeline(z, label, train.count()).fit(train)
    tree = tree_pipeline(features, label, depth).fit(train)
    save_model(lr, f"{path}/lr", {"threshold": 0.5})
    save_model(tree, f"{path}/tree", {"threshold": 0.5, "depth": depth})
    train.select(key, label, *z).write.mode("overwrite").parquet(f"{path}/knn_k{k}")
    f1 = lambda predicted: rates(confusion(predicted, "model")).first()["f1"]
    scores = {
        "lr_test_f1": f1(predictions(lr, test, "lr", key, label, key)),
        "knn_test_f1": f1(knn_predictions(train, test, key, label, z, k)),
        "dt_test_f1": f1(predictions(tree, test, "tree", key, label, key)),
    }
    return run_metadata(42, path, [], k, depth, scores)


def validate_baselines(spark: SparkSession, path: str, best_k: int, rows: DataFrame, features: list[str], label: str, key: str, n: int = 5) -> DataFrame:
    """(model, row_id, y, p, yhat) of the n first rows by key, from the three artifacts of export_baselines() loaded anew.

    rows has the scaled columns too. Raises FileNotFoundError where an artifact is missing.
    """
    z = [f + "_z" for f in features]
    required = [f"{path}/{x}" for x in ("lr/model", "tree/model", f"knn_k{best_k}")]
    there = [(x,) for x in required if (where := spark._jvm.org.apache.hadoop.fs.Path(x)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)]
    lost = missing_artifacts(spark.createDataFrame([(x,) for x in required], "name string"), spark.createDataFrame(there, "name string")).collect()
    if lost:
        raise FileNotFoundError(", ".join(r["name"] for r in lost))
    first = rows.orderBy(key).limit(n)
    made = [predictions(load_model(spark, f"{path}/{name}")[0], first, name, key, label, key).drop("grp") for name in ("lr", "tree")]
    made.append(knn_predictions(spark.read.parquet(f"{path}/knn_k{best_k}"), first, key, label, z, best_k))
    columns = ["model", "row_id", "y", "p", "yhat"]
    return made[0].select(*columns).unionByName(made[1].select(*columns)).unionByName(made[2].select(*columns))


def save_linear(spark: SparkSession, path: str, model: dict) -> None:
    """A linear model over raw features as one JSON document: features, means, deviations, weights, intercept, threshold, settings."""
    from tessella.sources.files import write_document

    write_document(spark, path, model)


def load_linear(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def scale_as(df: DataFrame, model: dict, suffix: str = "_z") -> DataFrame:
    """Adds the features of df scaled by the means and deviations of a saved model."""
    return df.withColumns({f + suffix: (F.col(f).cast("double") - F.lit(m)) / F.lit(d) for f, m, d in zip(model["features"], model["means"], model["deviations"], strict=True)})


def knn_predictor(train: np.ndarray, y: np.ndarray, k: int, at_once: int = 4_000_000):
    """A predictor of KNN labels over a bounded training array; ties go to the first rows."""
    square = (train * train).sum(axis=1)

    def predict(x: np.ndarray) -> np.ndarray:
        out, step = np.zeros(len(x)), max(1, at_once // max(len(train), 1))
        for i in range(0, len(x), step):
            d = square[None, :] - 2 * x[i : i + step] @ train.T
            near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(train) else np.broadcast_to(np.arange(len(train)), d.shape)
            out[i : i + step] = 2 * y[near].sum(axis=1) > near.shape[1]
        return out

    return predict
