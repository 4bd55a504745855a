"""Metrics over a long table of predictions: (model, row_id, y, p, yhat, grp), y and yhat 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalar import ratio
from tessella.operators.running import running


def _cell(y: int, yhat: int) -> Column:
    return F.count_if((F.col("y") == y) & (F.col("yhat") == yhat))


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """(by..., tp, fp, fn, tn) in one aggregation."""
    return predictions.groupBy(*by).agg(_cell(1, 1).alias("tp"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(0, 0).alias("tn"))


def rates(cells: DataFrame, digits: int = 6) -> DataFrame:
    """confusion() with accuracy, precision, recall, specificity and f1, 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    made = {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }
    return cells.select(*cells.columns, *[F.round(v, digits).alias(k) for k, v in made.items()])


def classification_report(predictions: DataFrame, digits: int = 6) -> DataFrame:
    """(model, class, precision, recall, f1, support) of each class, and their plain and weighted means."""
    cells = confusion(predictions, "model")
    each = cells.select("model", F.explode(F.array(
        F.struct(F.lit("0").alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed")),
        F.struct(F.lit("1").alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed")),
    )).alias("c")).select("model", "c.*")
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    each = each.select("model", "class", ratio(hit, hit + wrong).alias("precision"), ratio(hit, hit + missed).alias("recall"), ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))
    names = ("precision", "recall", "f1")
    macro = each.groupBy("model").agg(F.lit("macro").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = each.groupBy("model").agg(F.lit("weighted").alias("class"), *[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted).select("model", "class", *[F.round(n, digits).alias(n) for n in names], "support")


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """rates() of each model at each threshold, from one pass: yhat is p >= threshold."""
    each = scores.select("model", "y", "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return rates(confusion(each.withColumn("yhat", (F.col("p") >= F.col("threshold")).cast("int")), "model", "threshold"))


def _score_steps(scores: DataFrame) -> DataFrame:
    """(model, p, pos, neg): positives and negatives of each distinct score."""
    return scores.groupBy("model", "p").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def _running(steps: DataFrame, names: list[str], descending: bool, bins: int = 4096) -> DataFrame:
    """Adds before_NAME, the sum over the model's rows that come before in order of p, and all_NAME.

    Sums of bins of p, `bins` + 1 rows a model at most, give where each bin starts; windows hold one bin's rows. So no
    task holds all scores of a model. Scores beyond [0, 1] fall into the outer bins.
    """
    rows = steps.withColumn("_bin", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * bins))
    turn = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    earlier = Window.partitionBy("model").orderBy(turn("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("model", "_bin").agg(*[F.sum(n).alias(n) for n in names])
    starts = sums.select("model", "_bin", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_s_{n}") for n in names], *[F.sum(n).over(Window.partitionBy("model")).alias(f"all_{n}") for n in names])
    within = Window.partitionBy("model", "_bin").orderBy(turn("p")).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"before_{n}": F.col(f"_s_{n}") + F.coalesce(F.sum(n).over(within), F.lit(0)) for n in names}
    return rows.join(starts, ["model", "_bin"]).select("*", *[v.alias(k) for k, v in before.items()])


def roc_curve(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(model, threshold, fpr, tpr), a point for each distinct score; rows of a score are summed first."""
    sums = _running(_score_steps(scores), ["pos", "neg"], True)
    point = lambda n: F.round(ratio(F.col(f"before_{n}") + F.col(n), F.col(f"all_{n}")), digits)
    return sums.select("model", F.col("p").alias("threshold"), point("neg").alias("fpr"), point("pos").alias("tpr"))


def auc(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(model, auc): the share of pairs of a positive and a negative that are in order, ties as a half."""
    sums = _running(_score_steps(scores), ["neg"], False)
    won = F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)
    out = sums.groupBy("model").agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return out.select("model", F.round(ratio(F.col("won"), F.col("pos") * F.col("neg")), digits).alias("auc"))


def disparity(predictions: DataFrame, digits: int = 6) -> DataFrame:
    """(model, median, recall_low, recall_high, disparity): gap of recalls of grp <= its median and above; 0 if a side has no rows."""
    counted = predictions.where(F.col("grp").isNotNull()).groupBy("model", F.col("grp").cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = running(counted, ["model"], "v", sums={"upto": F.col("c")}).join(F.broadcast(counted.groupBy("model").agg(F.sum("c").alias("total"))), "model")
    holds = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("c") <= k)
    at = lambda k: F.max(F.when(holds(k), F.col("v")))
    middle = placed.groupBy("model").agg(((at(F.floor((F.col("total") - 1) / 2)) + at(F.ceil((F.col("total") - 1) / 2))) / 2).alias("median"))
    high = F.col("grp") > F.col("median")
    joined = predictions.join(F.broadcast(middle), "model").where(F.col("grp").isNotNull())
    n = lambda c: F.count_if(c)
    pos = (F.col("y") == 1) & (F.col("yhat") == 1)
    out = joined.groupBy("model", "median").agg(
        n(pos & ~high).alias("tl"), n((F.col("y") == 1) & ~high).alias("pl"), n(~high).alias("nl"),
        n(pos & high).alias("th"), n((F.col("y") == 1) & high).alias("ph"), n(high).alias("nh"),
    )
    low, up = ratio(F.col("tl"), F.col("pl")), ratio(F.col("th"), F.col("ph"))
    gap = F.when((F.col("nl") > 0) & (F.col("nh") > 0), F.abs(low - up)).otherwise(F.lit(0.0))
    return out.select("model", "median", F.round(low, digits).alias("recall_low"), F.round(up, digits).alias("recall_high"), F.round(gap, digits).alias("disparity"))


def fold_summary(folds: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """(model, metric, mean, std) over rows of a fold each; the deviation is the population's."""
    aggs = [f(F.col(m)).alias(f"{n}{i}") for i, m in enumerate(metrics) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    structs = [F.struct(F.lit(m).alias("metric"), F.round(f"m{i}", digits).alias("mean"), F.round(f"s{i}", digits).alias("std")) for i, m in enumerate(metrics)]
    return folds.groupBy("model").agg(*aggs).select("model", F.explode(F.array(*structs)).alias("r")).select("model", "r.*")


def compare(results: DataFrame, baseline: DataFrame, metrics: list[str], digits: int = 6) -> DataFrame:
    """results(model, n_train, metrics) against one baseline row: delta and delta_pct of each, and both sides' training rows."""
    base = baseline.select(F.col("n_train").alias("baseline_n_train"), *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    joined = results.join(F.broadcast(base))
    out = []
    for m in metrics:
        gap = F.col(m) - F.col(f"baseline_{m}")
        out += [F.round(gap, digits).alias(f"delta_{m}"), F.round(F.when(F.col(f"baseline_{m}") != 0, gap / F.col(f"baseline_{m}") * 100), digits).alias(f"delta_{m}_pct")]
    return joined.select("model", "n_train", "baseline_n_train", *out)


def error_slices(predictions: DataFrame) -> DataFrame:
    """(slice, n) of the four outcomes of one model."""
    return predictions.select(slice_of().alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))


def slice_of() -> Column:
    y, yhat = F.col("y") == 1, F.col("yhat") == 1
    return F.when(y & yhat, "TP").when(y, "FN").when(yhat, "FP").otherwise("TN")


def slice_means(predictions: DataFrame, features: list[str], digits: int = 4) -> DataFrame:
    """(feature, mean_fn, mean_tp, diff_pct): missed positives against those found."""
    s = slice_of()
    aggs = [F.avg(F.when(s == k, F.col(c).cast("double"))).alias(f"{k}{i}") for i, c in enumerate(features) for k in ("FN", "TP")]
    gap = lambda i: F.when(F.col(f"TP{i}") != 0, (F.col(f"FN{i}") - F.col(f"TP{i}")) / F.col(f"TP{i}") * 100)
    structs = [F.struct(F.lit(c).alias("feature"), F.round(f"FN{i}", digits).alias("mean_fn"), F.round(f"TP{i}", digits).alias("mean_tp"), F.round(gap(i), digits).alias("diff_pct")) for i, c in enumerate(features)]
    return predictions.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def grid_best(results: DataFrame, metric: str, key: str) -> DataFrame:
    """The row of the highest metric, the smallest grid key among ties."""
    return results.orderBy(F.col(metric).desc(), key).limit(1)
