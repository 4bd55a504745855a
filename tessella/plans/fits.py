"""Queries that fit models: no SQL says what they return, so tests check their invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import clean, explain, features, ga, models, split
from tessella.plans import report
from tessella.plans.catalog import Query
from tessella.session import load_table
from tessella.sources import files

FEATURES = ["n_chars", "n_lines", "n_marks", "toxic"]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def modelling_table(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, quality, features, split, fold) of the labelled documents, written once for all passes of a fit."""
    docs = load_table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("n_chars"), F.regexp_count("text", F.lit("\n")).cast("double").alias("n_lines"), F.regexp_count("text", F.lit("[%&$#|!*]")).cast("double").alias("n_marks"))
    rows = docs.join(load_table(spark, sf, "labels").select("doc_id", "quality", F.col("toxic").cast("double").alias("toxic")), "doc_id")
    rows = clean.impute_median(rows, FEATURES)
    rows = split.stratified_split(rows, "quality", "doc_id", {"train": 0.6, "val": 0.2, "test": 0.2})
    rows = split.kfold(rows, "quality", "doc_id")
    path = files.scratch_path(spark, "modelling")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return features.scale(modelling_table(spark, sf), FEATURES, F.col("split") == "train", "_z")


_Z = [f + "_z" for f in FEATURES]


def _weights_table(spark: SparkSession, found: tuple[dict[str, float], float]) -> DataFrame:
    return spark.createDataFrame([*found[0].items(), ("intercept", found[1])], "feature string, weight double")


@query
def lr_fit_l2(spark: SparkSession, sf: str) -> DataFrame:
    """M8 M16"""
    return _weights_table(spark, models.fit_lr(_scaled(spark, sf).where("split = 'train'"), _Z, "quality"))


@query
def lr_fit_l1_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """M9 M10"""
    return _weights_table(spark, models.fit_lr(_scaled(spark, sf).where("split = 'train'"), _Z, "quality", 0.5, "l1", balanced=True, penalize_intercept=True))


@query
def tree_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of the tree"""
    model = models.tree_pipeline(FEATURES, "quality", 3).fit(modelling_table(spark, sf).where("split = 'train'"))
    nodes = explain.tree_nodes(model.stages[-1])
    return spark.createDataFrame([(i, n["feature"], float(n.get("threshold", 0.0)), float(n["weight"]), float(n["value"])) for i, n in enumerate(nodes)], "node int, feature int, threshold double, weight double, value double")


@query
def tree_importance(spark: SparkSession, sf: str) -> DataFrame:
    """M28"""
    model = models.tree_pipeline(FEATURES, "quality", 3).fit(modelling_table(spark, sf).where("split = 'train'"))
    return models.tree_importance(model, spark, FEATURES)


@query
def pipeline_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a reloaded pipeline, which must be those of the one that was saved"""
    rows = modelling_table(spark, sf)
    path = files.scratch_path(spark, "model")
    model = models.tree_pipeline(FEATURES, "quality", 3).fit(rows.where("split = 'train'"))
    models.save_model(model, path, {"threshold": 0.5})
    loaded, params = models.load_model(spark, path)
    made = [models.predictions(m, rows, "tree", "doc_id", "quality", "n_chars") for m in (model, loaded)]
    if params["threshold"] != 0.5 or not models.same_predictions(*made):
        raise ValueError("the reloaded model predicts otherwise")
    return made[1]


@query
def tree_shap(spark: SparkSession, sf: str) -> DataFrame:
    """M31"""
    rows = modelling_table(spark, sf)
    model = models.tree_pipeline(FEATURES, "quality", 3).fit(rows.where("split = 'train'"))
    return explain.tree_shap(rows, "doc_id", FEATURES, explain.tree_nodes(model.stages[-1]))


@query
def kernel_shap_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours among 2000 training rows, all coalitions of the features against 25 background rows"""
    rows = _scaled(spark, sf)
    train = rows.where("split = 'train'").orderBy(split.order_key(F.col("doc_id")), "doc_id").limit(2000).select(*_Z, "quality").toPandas()
    x = train[_Z].to_numpy(np.float64)
    return explain.kernel_shap(rows.where("split = 'test'"), "doc_id", _Z, models.knn_predictor(x, train["quality"].to_numpy(), 7), x[:25])


@query
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Three models, each fit on prefixes of 4000 rows at most and validated on all rows"""
    return models.learning_curve(modelling_table(spark, sf), FEATURES, "quality", "doc_id")


@query
def cv_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Each model fit anew for each fold"""
    return models.cross_validate(modelling_table(spark, sf), FEATURES, "quality", "doc_id")


@query
def baseline_validate(spark: SparkSession, sf: str) -> DataFrame:
    """The three exported baselines, loaded anew, on five rows each"""
    path, rows = files.scratch_path(spark, "baselines"), modelling_table(spark, sf)
    meta = models.export_baselines(rows, FEATURES, "quality", "doc_id", path)
    scaled = spark.read.parquet(f"{path}/scaled").where("split = 'test'")
    return models.validate_baselines(spark, path, meta["best_k"], scaled, FEATURES, "quality", "doc_id")


@query
def baseline_export(spark: SparkSession, sf: str) -> DataFrame:
    """M11 M12 M15 M40 S7"""
    path = files.scratch_path(spark, "baselines")
    meta = models.export_baselines(modelling_table(spark, sf), FEATURES, "quality", "doc_id", path)
    files.write_document(spark, f"{path}/metadata", meta)
    return spark.createDataFrame([(meta["best_k"], meta["best_depth"], *meta["test_metrics"].values())], "best_k int, best_depth int, lr_test_f1 double, knn_test_f1 double, dt_test_f1 double")


@query
def ga_run(spark: SparkSession, sf: str) -> DataFrame:
    """The three experiments; each search sees 3000 training rows, refits and scores see all"""
    rows = modelling_table(spark, sf)
    found = [tuple(v for k, v in ga.run_experiment(spark, rows, FEATURES, "quality", "n_chars", "doc_id", how, 3000).items() if k != "model") for how in ga.EXPERIMENTS]
    return spark.createDataFrame(found, "exp_id string, generations_run int, best_fitness double, best_c double, best_penalty string, best_class_weight string, best_threshold double, test_recall double, test_specificity double, test_f1 double, test_disparity double, n_train long, runtime_seconds double")


@query
def case_report(spark: SparkSession, sf: str) -> DataFrame:
    """T6x T2x T3x T4x M35 S9: the winner of a search is saved, loaded and explains cases with its threshold; CSV, matrix and JSON lines are written, and the CSV read back"""
    rows = modelling_table(spark, sf)
    path = files.scratch_path(spark, "cases")
    best = report.run_search(spark, rows, FEATURES, "quality", "n_chars", "doc_id", [ga.EXPERIMENTS[1]], f"{path}/search", 1000)
    report.explain_saved(spark, rows.where("split = 'test'"), best, "doc_id", "quality", 8, path, "20240101T000000Z")
    return files.read_table(spark, f"{path}/responses", "csv", report.RESPONSE_SCHEMA)


@query
def search_report(spark: SparkSession, sf: str) -> DataFrame:
    """The three experiments against a baseline, written as CSV and summary, and the CSV read back; each search sees 2000 training rows"""
    rows = modelling_table(spark, sf)
    path = files.scratch_path(spark, "search")
    report.run_search(spark, rows, FEATURES, "quality", "n_chars", "doc_id", list(ga.EXPERIMENTS), path, 2000)
    return files.read_table(spark, f"{path}/experiments", "csv", report.SEARCH_SCHEMA)
