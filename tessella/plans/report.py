"""Whole runs: explained cases with their three files, and searches with theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ga, models, narrate
from tessella.operators.metrics import confusion, disparity, rates
from tessella.sources import files

# The columns of the two tables.
RESPONSE_SCHEMA = (
    "timestamp_utc string, patient_id string, sample_index long, mode string, model_file string, predicted_label int, predicted_probability_pcos double, ground_truth_label int, "
    "top_features string, llm_response string, medical_precision int, cultural_sensitivity int, language_adequacy int, overall int"
)
SEARCH_SCHEMA = (
    "exp_id string, population int, generations int, mutation_rate double, crossover_rate double, crossover_type string, best_fitness double, best_C double, best_penalty string, best_class_weight string, "
    "best_threshold double, test_recall double, test_specificity double, test_f1 double, test_disparity double, runtime_seconds double, saved_model string, baseline_recall double, baseline_specificity double, "
    "baseline_f1 double, baseline_disparity double, delta_f1_vs_baseline double, delta_recall_vs_baseline double"
)
_MARKS = [*narrate.RUBRIC, "overall"]


def _top(scaled: dict[str, str], weights: dict[str, float], k: int) -> Column:
    """The k largest contributions of a row, as an array of (feature, contribution), without turning it to rows."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(z) * F.lit(float(weights[f]))).alias("contribution")) for f, z in scaled.items()])
    order = lambda a, b: F.when(F.abs(a["contribution"]) != F.abs(b["contribution"]), F.signum(F.abs(b["contribution"]) - F.abs(a["contribution"])).cast("int")).when(a["feature"] < b["feature"], -1).otherwise(1)
    return F.slice(F.array_sort(each, order), 1, k)


def build_cases(rows: DataFrame, key: str, label: str, scaled: dict[str, str], weights: dict[str, float], intercept: float, n: int, age: Column | None = None) -> DataFrame:
    """(case_id, sample_index, p, y, features, top, age) of the n first rows by key; features is the anonymous JSON of the raw columns."""
    first = narrate.case_ids(rows, key, n)
    p = models.logit({z: weights[f] for f, z in scaled.items()}, intercept)
    return first.select("case_id", F.col(key).cast("long").alias("sample_index"), p.alias("p"), F.col(label).cast("int").alias("y"), narrate.payload(*scaled).alias("features"), _top(scaled, weights, 5).alias("top"), (F.lit(None).cast("double") if age is None else age).alias("age"))


def explain_cases(cases: DataFrame, threshold: float, model_file: str, run_key: str, call=None) -> DataFrame:
    """Cases with prompt, response and marks: one plan, without a loop over rows."""
    label = (F.col("p") >= threshold).cast("int")
    top = F.to_json(F.transform("top", lambda t: F.array(t["feature"], F.round(t["contribution"], 6).cast("string"))))
    texts = cases.select(
        F.lit(run_key).alias("timestamp_utc"), F.col("case_id").alias("patient_id"), "sample_index", F.lit(model_file).alias("model_file"), label.alias("predicted_label"),
        F.round("p", 6).alias("predicted_probability_pcos"), F.col("y").alias("ground_truth_label"), top.alias("top_features"),
        narrate.prompt(F.col("case_id"), F.col("p"), label, F.col("features"), top, F.col("age")).alias("prompt"), narrate.template_text(F.col("p"), label, F.col("top")).alias("template"),
    )
    made = narrate.rubric(narrate.generate(texts, call).withColumnRenamed("response", "llm_response"), "llm_response")
    names = [f.split()[0] for f in RESPONSE_SCHEMA.split(", ")]
    return made.select(*names, "prompt")


def write_cases(cases: DataFrame, path: str) -> None:
    """Below path: responses (CSV), matrix (CSV of the marks), documents (JSON lines) and summary (means of the marks)."""
    held = cases.cache()
    files.write_table(held.drop("prompt").coalesce(1), f"{path}/responses", "csv")
    files.write_table(held.select("patient_id", *_MARKS).coalesce(1), f"{path}/matrix", "csv")
    meta = ["timestamp_utc", "patient_id", "mode", "model_file", "predicted_label", "predicted_probability_pcos", "ground_truth_label"]
    nested = held.select(F.struct(*meta).alias("metadata"), "prompt", F.col("llm_response").alias("response"), F.struct(*_MARKS).alias("qualitative_scores"))
    files.write_table(nested, f"{path}/documents", "jsonl")
    means = held.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in _MARKS]).first().asDict()
    files.write_document(cases.sparkSession, f"{path}/summary", means)
    held.unpersist()


def run_search(spark: SparkSession, rows: DataFrame, features: list[str], label: str, group: str, key: str, hows: list[ga.Experiment], path: str, most: int = 20_000) -> str:
    """Run the experiments, compare each with a baseline, and write the winners' models, the table and a summary; the path of the best model.

    rows has the columns split and fold. Both sides of a comparison are fit on all rows of split train and scored on
    all of split test; a search itself sees `most` training rows at most.
    """
    from tessella.operators.features import scale

    z = [f + "_z" for f in features]
    scaled = scale(rows, features, F.col("split") == "train")
    weights, intercept = models.fit_lr(scaled.where("split = 'train'"), z, label)
    scored = scaled.where("split = 'test'").select(F.lit("baseline").alias("model"), F.col(label).cast("int").alias("y"), models.logit(weights, intercept).alias("p"), F.col(group).cast("double").alias("grp"))
    judged = models.threshold_predict(scored)
    base, gap = rates(confusion(judged, "model")).first(), disparity(judged).first()["disparity"]
    out = []
    for how in hows:
        r = ga.run_experiment(spark, rows, features, label, group, key, how, most)
        saved = f"{path}/{how.exp_id}"
        models.save_linear(spark, saved, r["model"])
        out.append((how.exp_id, how.population_size, how.generations, how.mutpb, how.cxpb, how.crossover, r["best_fitness"], r["best_C"], r["best_penalty"], r["best_class_weight"], r["best_threshold"],
                    r["test_recall"], r["test_specificity"], r["test_f1"], r["test_disparity"], r["runtime_seconds"], saved, base["recall"], base["specificity"], base["f1"], gap, r["test_f1"] - base["f1"], r["test_recall"] - base["recall"]))
    table = spark.createDataFrame(out, SEARCH_SCHEMA)
    files.write_table(table.coalesce(1), f"{path}/experiments", "csv")
    best = max(out, key=lambda r: r[6])[0]
    files.write_document(spark, f"{path}/summary", {"results_csv": f"{path}/experiments", "experiments_run": len(out), "best_experiment_by_fitness": best})
    return f"{path}/{best}"


def explain_saved(spark: SparkSession, rows: DataFrame, model_file: str, key: str, label: str, n: int, path: str, run_key: str, call=None) -> None:
    """Explain the n first rows by key with a saved model and its threshold, and write the responses' files."""
    model = models.load_linear(spark, model_file)
    weights = dict(zip(model["features"], model["weights"], strict=True))
    cases = build_cases(models.scale_as(rows, model), key, label, {f: f + "_z" for f in weights}, weights, model["intercept"], n)
    write_cases(explain_cases(cases, model["threshold"], model_file, run_key, call), path)
