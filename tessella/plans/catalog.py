"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalar import rounded, snake, to_number, uniform
from tessella.operators import clean, explain, features, ga, gini, knn, metrics, models, narrate, profile, split
from tessella.session import load_table
from tessella.sources import files, settings, sheets

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: Fixed coefficients of two linear models over labels and documents.
MODEL_A = ({"n_chars": -0.0004, "toxic": 0.3}, 1.2)
MODEL_B = ({"n_chars": 0.0003, "toxic": 0.5}, -0.3)
#: Fixed coefficients of a linear model over the scaled columns of lineitem.
WEIGHTS = {"l_quantity": 0.8, "l_extendedprice": -0.5, "l_discount": 0.3, "l_tax": -0.2}
THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Shared inputs.


def with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with nulls in two columns where l_orderkey is a multiple of 7 or 11."""
    li = load_table(spark, sf, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))).withColumn("l_discount", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_discount")))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return load_table(spark, sf, "labels").join(load_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(model, row_id, y, p, grp) of both fixed models."""
    rows = labelled(spark, sf)
    both = [F.struct(F.lit(n).alias("model"), F.round(models.logit(*m), 6).alias("p")) for n, m in (("a", MODEL_A), ("b", MODEL_B))]
    return rows.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("grp"), "toxic", F.explode(F.array(*both)).alias("m")).select("m.model", "row_id", "y", "m.p", "grp", "toxic")


def predicted(spark: SparkSession, sf: str, threshold: float = 0.6) -> DataFrame:
    return models.threshold_predict(scored(spark, sf), threshold)


def _fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    folds = split.kfold(load_table(spark, sf, "labels"), "quality", "doc_id").select(F.col("doc_id").alias("row_id"), "fold")
    return metrics.rates(metrics.confusion(predicted(spark, sf).join(folds, "row_id"), "model", "fold"))


# Sources and sinks.


@query
def scan_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S2 S6"""
    rows = load_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = files.scratch_path(spark, "csv")
    files.write_table(rows, path, "csv")
    return files.read_table(spark, path, "csv", rows.schema)


@query
def scan_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S3"""
    rows = load_table(spark, sf, "nation").select("n_nationkey", "n_name")
    path = files.scratch_path(spark, "json")
    files.write_document(spark, path, {"nations": [r.asDict() for r in rows.orderBy("n_nationkey").collect()]})
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "nations array<struct<n_nationkey:int,n_name:string>>")
    return whole.select(F.explode(parsed["nations"]).alias("n")).select("n.*")


@query
def jsonl_documents(spark: SparkSession, sf: str) -> DataFrame:
    """S8"""
    rows = load_table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = files.scratch_path(spark, "jsonl")
    files.write_table(rows, path, "jsonl")
    return files.read_table(spark, path, "jsonl", rows.schema).select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def scan_sheet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook written and read, numbers inferred"""
    rows = load_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy("s_suppkey")
    path = files.scratch_path(spark, "sheet") + ".xlsx"
    sheets.write_sheet(rows, path, "Suppliers")
    return sheets.read_sheet(spark, path, "Suppliers").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_acctbal")


@query
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """S4"""
    days = load_table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return files.latest(days, "day").select("event_id", "event_type", "value")


@query
def experiment_config_table(spark: SparkSession, sf: str) -> DataFrame:
    """S11 G14"""
    return ga.config_table(spark)


# Projections, filters and predicates.


@query
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P1"""
    return clean.drop_tolerant(load_table(spark, sf, "part"), ["p_name", "p_type", "no_such_column"])


@query
def project_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P2"""
    return load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query
def rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P5"""
    return load_table(spark, sf, "part").select("p_partkey", "p_size").withColumnsRenamed({"p_partkey": "part_id", "p_size": "size"})


@query
def select_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """P3"""
    part = load_table(spark, sf, "part")
    return part.select(*clean.numeric_columns(part))


@query
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    """F8"""
    return load_table(spark, sf, "part").select("p_partkey", snake(F.concat(F.lit("  "), "p_type", F.lit(" (Y/N)\n"))).alias("name"))


@query
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """P6"""
    raw = F.get_json_object("props", "$.k")
    dirty = F.when(F.col("event_id") % 13 == 0, "a").when(F.col("event_id") % 17 == 0, F.concat(raw, F.lit(".5."))).when(F.col("event_id") % 19 == 0, F.concat(F.lit(" "), raw, F.lit("e1 "))).otherwise(raw)
    return load_table(spark, sf, "events").select("event_id", to_number(dirty).alias("k"))


@query
def filter_conjunction(spark: SparkSession, sf: str) -> DataFrame:
    """P8"""
    return load_table(spark, sf, "orders").where((F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") < "4")).select("o_orderkey", "o_totalprice")


@query
def filter_isin(spark: SparkSession, sf: str) -> DataFrame:
    """P9"""
    return load_table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query
def label_recode(spark: SparkSession, sf: str) -> DataFrame:
    """P11"""
    name = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return load_table(spark, sf, "labels").select("doc_id", name.alias("quality_name"))


@query
def risk_band(spark: SparkSession, sf: str) -> DataFrame:
    """P19 F13"""
    return scored(spark, sf).select("model", "row_id", narrate.risk_band(F.coalesce("p", F.lit(0.0))).alias("band"))


@query
def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """P16"""
    return with_nulls(spark, sf).dropna(subset=["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A4 A5 A6 P20"""
    return profile.null_profile(with_nulls(spark, sf), NUMERIC)


@query
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    """M1 A7"""
    rows = with_nulls(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return clean.impute_median(rows, ["l_quantity", "l_discount"])


# Profiles.


@query
def table_shape(spark: SparkSession, sf: str) -> DataFrame:
    """A1"""
    return profile.shape(load_table(spark, sf, "lineitem"))


@query
def column_info(spark: SparkSession, sf: str) -> DataFrame:
    """A3"""
    return profile.column_info(with_nulls(spark, sf).select(*NUMERIC, "l_returnflag"))


@query
def describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """A2 A20"""
    return profile.describe(load_table(spark, sf, "lineitem"), NUMERIC)


@query
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A8"""
    return profile.value_counts(load_table(spark, sf, "orders"), "o_orderpriority")


@query
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """A9"""
    return profile.class_balance(load_table(spark, sf, "labels"), "quality")


@query
def class_means_long(spark: SparkSession, sf: str) -> DataFrame:
    """A10 P13"""
    return profile.class_means(load_table(spark, sf, "lineitem"), "l_returnflag", NUMERIC)


@query
def class_gap_pct(spark: SparkSession, sf: str) -> DataFrame:
    """A11"""
    return profile.class_gap(labelled(spark, sf), "quality", ["n_chars", "toxic"])


@query
def histogram_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """A12 A13"""
    return profile.histogram(load_table(spark, sf, "events"), "value", "event_type", 20)


@query
def corr_matrix_lower(spark: SparkSession, sf: str) -> DataFrame:
    """A14 P15"""
    return profile.correlations(load_table(spark, sf, "lineitem"), NUMERIC)


@query
def corr_with_target_top(spark: SparkSession, sf: str) -> DataFrame:
    """A15 K2"""
    return profile.correlations_with(load_table(spark, sf, "lineitem"), (F.col("l_returnflag") == "R").cast("int"), NUMERIC, 3)


@query
def high_corr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """M38 P14 A22"""
    li = load_table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return profile.redundant_pairs(li, [*NUMERIC, "net"], 0.9)


# Joins.


@query
def doc_label_join(spark: SparkSession, sf: str) -> DataFrame:
    """J1 J2"""
    return labelled(spark, sf).select("doc_id", "quality", "toxic", "n_chars")


@query
def broadcast_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """J3 G15 F18"""
    rows = metrics.rates(metrics.confusion(predicted(spark, sf), "model")).select("model", "recall", "f1")
    base = rows.where("model = 'a'").select(F.col("recall").alias("baseline_recall"), F.col("f1").alias("baseline_f1"))
    joined = rows.join(F.broadcast(base), how="left")
    return joined.select("*", F.round(F.when(F.col("baseline_f1").isNotNull(), F.col("f1") - F.col("baseline_f1")), 6).alias("delta_f1"))


@query
def missing_artifacts_anti(spark: SparkSession, sf: str) -> DataFrame:
    """J5 M39"""
    required = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("name"))
    return models.missing_artifacts(required, load_table(spark, sf, "orders").select(F.col("o_custkey").alias("name")))


# Splits, folds and scaling.


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """M2 M3 W6"""
    parts = {"train": 0.6, "val": 0.2, "test": 0.2}
    return split.stratified_split(load_table(spark, sf, "labels"), "quality", "doc_id", parts).select("doc_id", "quality", "split")


@query
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    """M5 M6"""
    return split.kfold(load_table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "quality", "fold")


@query
def scale_train_only(spark: SparkSession, sf: str) -> DataFrame:
    """M4"""
    made = features.scale(load_table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], F.col("l_orderkey") % 5 != 0)
    return made.select("l_orderkey", "l_linenumber", F.round("l_quantity_z", 6).alias("quantity_z"), F.round("l_tax_z", 6).alias("tax_z"))


@query
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    """M10"""
    return features.balanced_weights(load_table(spark, sf, "labels"), "quality").select("quality", "n", F.round("weight", 6).alias("weight"))


@query
def learning_curve_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """W7 F17"""
    return split.training_sizes(load_table(spark, sf, "labels").agg(F.count("*").alias("n")))


# Scores and metrics.


@query
def logit_score(spark: SparkSession, sf: str) -> DataFrame:
    """M18 M8"""
    return scored(spark, sf).select("model", "row_id", "p")


@query
def threshold_predict(spark: SparkSession, sf: str) -> DataFrame:
    """P10 M17 M19"""
    return predicted(spark, sf).select("model", "row_id", "yhat")


@query
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """M19"""
    return metrics.threshold_sweep(scored(spark, sf), THRESHOLDS)


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """M20"""
    return metrics.confusion(predicted(spark, sf), "model")


@query
def metrics_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """M21 M22 M37 J6"""
    return metrics.rates(metrics.confusion(predicted(spark, sf), "model"))


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    """M23"""
    return metrics.classification_report(predicted(spark, sf))


@query
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    """M24 W4"""
    return metrics.roc_curve(scored(spark, sf))


@query
def auc_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """M25 W5"""
    return metrics.auc(scored(spark, sf))


@query
def demographic_disparity(spark: SparkSession, sf: str) -> DataFrame:
    """M26"""
    return metrics.disparity(predicted(spark, sf))


@query
def cv_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    """M7 A16 A17"""
    return metrics.fold_summary(_fold_metrics(spark, sf), ["accuracy", "recall", "f1"])


@query
def compare_delta(spark: SparkSession, sf: str) -> DataFrame:
    """P12 M37"""
    rows = metrics.rates(metrics.confusion(predicted(spark, sf), "model")).withColumn("n_train", F.when(F.col("model") == "a", 60).otherwise(80))
    return metrics.compare(rows, rows.where("model = 'a'"), ["recall", "f1"])


@query
def error_slices(spark: SparkSession, sf: str) -> DataFrame:
    """A21"""
    return metrics.error_slices(predicted(spark, sf).where("model = 'a'"))


@query
def error_slice_means(spark: SparkSession, sf: str) -> DataFrame:
    """A23 M36"""
    return metrics.slice_means(predicted(spark, sf).where("model = 'a'"), ["grp", "toxic"])


# Neighbours and trees.


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = load_table(spark, sf, "embeddings")
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    return rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), vector), rows.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("tid"), vector)


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    labels = load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), (F.col("label") >= 5).cast("long").alias("y"))
    return knn.votes(knn.knn(*_vectors(spark, sf), 15), labels)


def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    truth = load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), (F.col("label") >= 5).cast("long").alias("y"))
    return knn.k_sweep(_votes(spark, sf), truth)


@query
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """M11 J4 W8"""
    return knn.knn(*_vectors(spark, sf), 5).select("qid", "tid", F.round("dist", 6).alias("dist"), "rank")


@query
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    """M11"""
    return _votes(spark, sf).where("k = 7").select("qid", "votes", "yhat")


@query
def knn_k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """M12"""
    return _sweep(spark, sf)


@query
def grid_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """A19 M15"""
    return metrics.grid_best(_sweep(spark, sf), "f1", "k")


@query
def gini_best_split(spark: SparkSession, sf: str) -> DataFrame:
    """M14"""
    return gini.best_split(load_table(spark, sf, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")


# Explanations.


@query
def linear_shap(spark: SparkSession, sf: str) -> DataFrame:
    """M30 M34"""
    li = load_table(spark, sf, "lineitem")
    return explain.linear_shap(li, ["l_orderkey", "l_linenumber"], WEIGHTS, li.where("l_orderkey % 5 <> 0"), 4)


@query
def shap_global(spark: SparkSession, sf: str) -> DataFrame:
    """M33"""
    li = load_table(spark, sf, "lineitem")
    return explain.global_ranking(explain.linear_shap(li, ["l_orderkey", "l_linenumber"], WEIGHTS, li), 3, 4)


@query
def local_top_features(spark: SparkSession, sf: str) -> DataFrame:
    """M35 W1"""
    z = {f: f"{f}_z" for f in WEIGHTS}
    made = features.scale(load_table(spark, sf, "lineitem"), list(WEIGHTS), F.col("l_orderkey") % 5 != 0)
    return explain.top_features(explain.contributions(made, ["l_orderkey", "l_linenumber"], z, WEIGHTS, 4), ["l_orderkey", "l_linenumber"], 2)


@query
def case_ids(spark: SparkSession, sf: str) -> DataFrame:
    """W2 F9"""
    return narrate.case_ids(load_table(spark, sf, "orders"), "o_orderkey", 8).select("o_orderkey", "case_id")


@query
def head_n(spark: SparkSession, sf: str) -> DataFrame:
    """K3 K4"""
    return load_table(spark, sf, "orders").orderBy("o_orderkey").limit(5).select("o_orderkey", "o_custkey", "o_totalprice")


# Genetic search.


def _population(spark: SparkSession, sf: str) -> DataFrame:
    return ga.init_population(load_table(spark, sf, "embeddings").select(F.col("vec_id").alias("ind_id")))


def _scored_population(spark: SparkSession, sf: str, tag: str = "fit") -> DataFrame:
    return _population(spark, sf).withColumn("fitness", F.round(uniform(tag, F.col("ind_id")), 3))


def _rounded(population: DataFrame) -> DataFrame:
    return population.withColumns({"log10_c": F.round("log10_c", 6), "threshold": F.round("threshold", 6)})


@query
def ga_init_population(spark: SparkSession, sf: str) -> DataFrame:
    """G1 G2"""
    return _rounded(_population(spark, sf))


@query
def ga_decode(spark: SparkSession, sf: str) -> DataFrame:
    """G3 F3 F4 F5"""
    return ga.decode(_population(spark, sf))


@query
def ga_fitness(spark: SparkSession, sf: str) -> DataFrame:
    """G4"""
    folds = split.kfold(load_table(spark, sf, "labels"), "quality", "doc_id").select(F.col("doc_id").alias("row_id"), "fold")
    each = scored(spark, sf).where("model = 'a'").join(folds, "row_id").select("y", "p", "grp", "fold", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    each = each.withColumn("yhat", (F.col("p") >= F.col("threshold")).cast("int")).withColumn("model", F.concat_ws("/", "threshold", "fold"))
    cells = metrics.rates(metrics.confusion(each, "model", "threshold"), 9).join(metrics.disparity(each, 9).select("model", "disparity"), "model")
    means = cells.groupBy("threshold").agg(*[F.avg(c).alias(c) for c in ("recall", "specificity", "f1", "disparity")])
    return means.select("threshold", F.round(ga.fitness_of(*[F.col(c) for c in ("recall", "specificity", "f1", "disparity")]), 6).alias("fitness"))


@query
def ga_select_best(spark: SparkSession, sf: str) -> DataFrame:
    """K5"""
    return ga.select_best(_scored_population(spark, sf), 10).select("ind_id", "fitness")


@query
def ga_tournament(spark: SparkSession, sf: str) -> DataFrame:
    """G5"""
    return ga.tournament(_scored_population(spark, sf), 500)


@query
def ga_crossover(spark: SparkSession, sf: str) -> DataFrame:
    """G6 G8"""
    return _rounded(ga.crossover(_population(spark, sf), 0.7, "uniform"))


@query
def ga_crossover_one_point(spark: SparkSession, sf: str) -> DataFrame:
    """G7 G8"""
    return _rounded(ga.crossover(_population(spark, sf), 0.8, "one_point"))


@query
def ga_mutate(spark: SparkSession, sf: str) -> DataFrame:
    """G9"""
    return _rounded(ga.mutate(_population(spark, sf), 0.5, 0.4))


@query
def ga_elitism(spark: SparkSession, sf: str) -> DataFrame:
    """G11 K6"""
    return ga.elitism(_scored_population(spark, sf), _scored_population(spark, sf, "child"), 2).select("ind_id", "fitness", "origin")


@query
def early_stop_trace(spark: SparkSession, sf: str) -> DataFrame:
    """G12 W3"""
    history = load_table(spark, sf, "orders").select(F.col("o_orderkey").alias("gen"), F.round("o_totalprice", 2).alias("best"))
    return ga.early_stop_trace(history, 4)


@query
def best_experiment(spark: SparkSession, sf: str) -> DataFrame:
    """K1 G16"""
    rows = metrics.rates(metrics.confusion(predicted(spark, sf), "model")).select("model", "f1")
    return metrics.grid_best(rows, "f1", "model")


@query
def union_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    """set operations"""
    rows = load_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    parts = [rows.where(F.col("o_orderstatus") == s).withColumn("part", F.lit(s)) for s in ("O", "F", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Narratives.


@query
def anonymize(spark: SparkSession, sf: str) -> DataFrame:
    """T1x F14"""
    rows = load_table(spark, sf, "customer").withColumn(" key ", F.md5(F.concat(F.lit("salt:"), F.col("c_custkey").cast("string")).cast("binary")))
    return narrate.anonymize(rows, ["c_name", "c_custkey"])


@query
def prompt_payload_json(spark: SparkSession, sf: str) -> DataFrame:
    """T2x F11 F16"""
    rows = load_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    body = narrate.payload("o_custkey", "o_orderstatus")
    return rows.select("o_orderkey", body.alias("payload"), F.length(body).cast("long").alias("n"))


@query
def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    """T2x F9"""
    p = rounded(F.col("value") / 500, 3)
    top = F.to_json(F.array(F.struct(F.lit("value").alias("feature"), F.col("event_id").alias("contribution"))))
    made = narrate.prompt(F.format_string("P_%03d", F.col("event_id")), p, (p >= 0.5).cast("int"), narrate.payload("user_id", "event_type"), top, F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return load_table(spark, sf, "events").select("event_id", made.alias("prompt"))


@query
def fallback_text(spark: SparkSession, sf: str) -> DataFrame:
    """T3x F9 F10"""
    p = F.round(F.col("value") / 500, 6)
    factor = lambda n, v: F.struct(F.lit(n).alias("feature"), v.alias("contribution"))
    factors = F.array(factor("value", F.round(F.col("value") / 7, 4)), factor("user", -F.round(F.col("user_id") / 9, 4)))
    text = narrate.template_text(p, (p >= 0.5).cast("int"), factors)
    return load_table(spark, sf, "events").select("event_id", text.alias("text"))


@query
def rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    """T4x F6 F7"""
    rows = load_table(spark, sf, "conversations").withColumn("text", F.concat_ws(" ", "text", F.when(F.col("turn") % 2 == 0, "Recomendações e LIMITES"), F.when(F.col("turn") % 3 == 0, "linguagem acolhedora"), F.when(F.col("turn") % 5 == 0, "Critérios")))
    return narrate.rubric(rows, "text").select("conv_id", "turn", *narrate.RUBRIC, "overall")


@query
def rubric_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A18 T6x"""
    marked = rubric_scores(spark, sf)
    return marked.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in (*narrate.RUBRIC, "overall")])


# Models with fixed or closed-form fits, which SQL can follow.

#: A fixed tree over n_chars and toxic.
TREE = [
    {"feature": 0, "threshold": 1500.0, "left": 1, "right": 2, "weight": 100.0, "value": 0.6}, {"feature": -1, "weight": 30.0, "value": 0.3},
    {"feature": 1, "threshold": 0.5, "left": 3, "right": 4, "weight": 70.0, "value": 0.7}, {"feature": -1, "weight": 50.0, "value": 0.9}, {"feature": -1, "weight": 20.0, "value": 0.2},
]
#: A fixed linear model of raw features with its scaling and threshold.
SAVED = {"name": "fixed", "features": ["n_chars", "toxic"], "means": [1800.0, 0.1], "deviations": [2400.0, 0.3], "weights": [-0.7, 0.4], "intercept": 0.25, "threshold": 0.55}
#: Background rows (n_chars, toxic) of a Shapley value.
BACKGROUND = [[200.0, 0.0], [5000.0, 1.0], [1200.0, 0.0]]


@query
def feature_target(spark: SparkSession, sf: str) -> DataFrame:
    """Features and target apart, joined again by their key"""
    rows = labelled(spark, sf)
    target = rows.select("doc_id", F.col("quality").alias("target"))
    return rows.drop("quality").join(target, "doc_id")


@query
def tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A tree's scores as one expression"""
    return labelled(spark, sf).select("doc_id", explain.tree_score(TREE, ["n_chars", "toxic"]).alias("p"))


@query
def tree_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and positives of each node"""
    return explain.tree_counts(labelled(spark, sf), ["n_chars", "toxic"], F.col("quality"), TREE)


@query
def tree_gini_gains(spark: SparkSession, sf: str) -> DataFrame:
    """Importances by the decrease of impurity over the table"""
    counts = explain.tree_counts(labelled(spark, sf), ["n_chars", "toxic"], F.col("quality"), TREE)
    return explain.tree_gains(counts, ["n_chars", "toxic"], TREE)


@query
def tree_shap_values(spark: SparkSession, sf: str) -> DataFrame:
    """Path-dependent Shapley values of the fixed tree"""
    return explain.tree_shap(labelled(spark, sf), "doc_id", ["n_chars", "toxic"], TREE).select("doc_id", "feature", F.round("phi", 6).alias("phi"))


@query
def kernel_shap_values(spark: SparkSession, sf: str) -> DataFrame:
    """Shapley values of a predictor of labels over all coalitions and background rows"""
    predict = lambda x: ((x[:, 0] > 1500) & (x[:, 1] < 0.5)).astype(float)
    return explain.kernel_shap(labelled(spark, sf), "doc_id", ["n_chars", "toxic"], predict, np.array(BACKGROUND)).select("doc_id", "feature", F.round("phi", 6).alias("phi"))


@query
def lr_fit_converged(spark: SparkSession, sf: str) -> DataFrame:
    """Weight and intercept of a ridge logistic regression on one scaled feature"""
    rows = features.scale(labelled(spark, sf), ["n_chars"], F.lit(True))
    weights, intercept = models.fit_lr(rows, ["n_chars_z"], "quality")
    return spark.createDataFrame([("n_chars_z", weights["n_chars_z"]), ("intercept", intercept)], "feature string, weight double").select("feature", F.round("weight", 3).alias("weight"))


@query
def cv_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """A logistic regression fit anew for each fold"""
    rows = split.kfold(labelled(spark, sf), "quality", "doc_id")
    path = files.scratch_path(spark, "folds")
    rows.write.parquet(path)  # each fold's fit reads it
    rows = spark.read.schema(rows.schema).parquet(path)
    judged = models.cross_validate_logistic(rows, ["n_chars"], "quality", "doc_id")
    return metrics.fold_summary(metrics.rates(metrics.confusion(judged, "model", "fold")), ["accuracy", "recall", "f1"])


@query
def saved_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model saved below a new folder, loaded and applied"""
    path = files.scratch_path(spark, "models") + "/new/folder"
    models.save_linear(spark, path, SAVED)
    model = models.load_linear(spark, path)
    rows = models.scale_as(labelled(spark, sf), model)
    p = models.logit({f + "_z": w for f, w in zip(model["features"], model["weights"], strict=True)}, model["intercept"])
    return models.threshold_predict(rows.select("doc_id", p.alias("p")), model["threshold"]).select("doc_id", F.round("p", 6).alias("p"), "yhat")


@query
def artifact_check(spark: SparkSession, sf: str) -> DataFrame:
    """A saved model, loaded anew, on the five first rows"""
    return saved_model_scores(spark, sf).orderBy("doc_id").limit(5)


@query
def run_metadata_record(spark: SparkSession, sf: str) -> DataFrame:
    """The record of a run as one pretty JSON document, read back"""
    path = files.scratch_path(spark, "metadata")
    counts = labelled(spark, sf).agg(F.count("*").alias("n"), F.sum("quality").alias("pos")).first()
    files.write_document(spark, path, models.run_metadata(42, "documents", ["text"], 7, 3, {"rows": counts["n"], "positives": counts["pos"]}))
    got = files.read_table(spark, path, "json", "random_state long, dataset_path string, dropped_columns array<string>, best_k long, best_depth long, test_metrics struct<rows:long,positives:long>")
    return got.select("random_state", "dataset_path", F.array_join("dropped_columns", ",").alias("dropped"), "best_k", "best_depth", "test_metrics.rows", "test_metrics.positives")


@query
def run_keys(spark: SparkSession, sf: str) -> DataFrame:
    """timestamps as keys of runs, in UTC"""
    return load_table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("run_key"))


@query
def ga_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Who must be evaluated again after mutation"""
    before = _population(spark, sf)
    return ga.changed(before, ga.mutate(before, 0.5, 0.4))


@query
def settings_modes(spark: SparkSession, sf: str) -> DataFrame:
    """S14 T5x: settings of NAME=value lines, and the mode of texts that they choose"""
    lines = {"key": "TEXT_API_KEY=k\nTEXT_API_URL='http://h'", "forced": "export TEXT_API_KEY=k # secret\nTEXT_API_URL=http://h\nTEXT_FORCE_LOCAL=true", "none": "# nothing\n"}
    found = [(name, len(own := settings.parse_lines(text)), settings.text_mode(own)) for name, text in lines.items()]
    return spark.createDataFrame(found, "name string, n_settings long, mode string")


@query
def generated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """S13 T5x: texts of a client, and the marked template where the client fails"""
    def call(prompt: str) -> str:
        if prompt.endswith("7"):
            raise TimeoutError
        return prompt.upper()

    texts = load_table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("ask "), F.col("c_custkey").cast("string")).alias("prompt"), F.concat(F.lit("plain "), F.col("c_mktsegment")).alias("template"))
    return narrate.generate(texts, call).select("c_custkey", "mode", "response")


@query
def console_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that the console shows of a table"""
    rows = load_table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame(list(enumerate(files.text_lines(rows, 3))), "line long, text string")
