"""A genetic search of hyper-parameters with a fairness-aware fitness."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalar import clip, uniform
from tessella.operators.running import running
from tessella.operators.solver import balanced, fit_logistic, predict_logistic

#: Weights of recall, specificity, F1 and (subtracted) disparity.
FITNESS = (0.4, 0.2, 0.3, 0.1)
#: An improvement must exceed this to count.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Experiment:
    exp_id: str
    population_size: int
    generations: int
    cxpb: float
    mutpb: float
    tournament_size: int
    crossover: str
    mutation_indpb: float
    elitism_count: int = 2
    early_stop_patience: int = 4


#: Fixed values of the three experiments.
EXPERIMENTS = (
    Experiment("high_mut_uniform", 100, 20, 0.7, 0.5, 3, "uniform", 0.4, 2, 4),
    Experiment("low_mut_onepoint", 100, 10, 0.8, 0.2, 3, "one_point", 0.2, 2, 5),
    Experiment("balanced_config", 100, 20, 0.75, 0.3, 3, "uniform", 0.3, 2, 5),
)
GENES = ("log10_c", "penalty", "class_weight", "threshold")


def config_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(e).values()) for e in EXPERIMENTS], "exp_id string, population_size int, generations int, cxpb double, mutpb double, tournament_size int, crossover string, mutation_indpb double, elitism_count int, early_stop_patience int")


# The operators of one generation as table expressions: random numbers are MD5s of a tag and the individual's id.


def init_population(ids: DataFrame, tag: str = "init") -> DataFrame:
    """(ind_id, genes): log10_c in [-2, 1), penalty and class_weight 0 or 1, threshold in [0.3, 0.7)."""
    u = lambda g: uniform(f"{tag}:{g}", F.col("ind_id"))
    return ids.select("ind_id", (u("c") * 3 - 2).alias("log10_c"), F.floor(u("p") * 2).cast("int").alias("penalty"), F.floor(u("w") * 2).cast("int").alias("class_weight"), (u("t") * F.lit(0.4) + F.lit(0.3)).alias("threshold"))


def decode(population: DataFrame, digits: int = 6) -> DataFrame:
    """(ind_id, c, penalty, class_weight, threshold) as a model takes them; binary genes are rounded half to even."""
    return population.select(
        "ind_id",
        F.round(F.pow(F.lit(10.0), F.col("log10_c")), digits).alias("c"),
        F.when(F.bround(F.col("penalty").cast("double"), 0) == 0, "l1").otherwise("l2").alias("penalty"),
        F.when(F.bround(F.col("class_weight").cast("double"), 0) == 0, F.lit(None).cast("string")).otherwise("balanced").alias("class_weight"),
        F.round(clip(F.col("threshold"), 0.3, 0.7), digits).alias("threshold"),
    )


def fitness_of(recall: Column, specificity: Column, f1: Column, gap: Column) -> Column:
    return F.lit(FITNESS[0]) * recall + F.lit(FITNESS[1]) * specificity + F.lit(FITNESS[2]) * f1 - F.lit(FITNESS[3]) * gap


def select_best(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.col("fitness").desc(), "ind_id").limit(n)


def tournament(scored: DataFrame, n: int, size: int = 3, tag: str = "tour") -> DataFrame:
    """(slot, ind_id, fitness): for each of n slots the best of `size` draws with replacement; ind_id is 0 .. n-1."""
    spark = scored.sparkSession
    draws = spark.range(n).select(F.col("id").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("draw"))
    draws = draws.select("slot", F.floor(uniform(tag, F.col("slot"), F.col("draw")) * n).alias("ind_id"))
    best = draws.join(scored.select("ind_id", "fitness"), "ind_id").groupBy("slot").agg(F.max(F.struct("fitness", (-F.col("ind_id")).alias("neg"))).alias("b"))
    return best.select("slot", (-F.col("b.neg")).alias("ind_id"), F.col("b.fitness").alias("fitness"))


def crossover(population: DataFrame, cxpb: float, kind: str, tag: str = "cx") -> DataFrame:
    """Pairs (2i, 2i+1) swap genes, with probability cxpb: each gene with one half, or all from a cut of 1 to 3 on."""
    pair = F.floor(F.col("ind_id") / 2)
    w = Window.partitionBy("_pair")
    pop = population.withColumn("_pair", pair)
    mates = uniform(f"{tag}:gate", F.col("_pair")) < cxpb
    full = F.count("*").over(w) == 2
    cut = F.floor(uniform(f"{tag}:cut", F.col("_pair")) * 3) + 1
    out = []
    for i, g in enumerate(GENES):
        swap = uniform(f"{tag}:{i}", F.col("_pair")) < 0.5 if kind == "uniform" else F.lit(i) >= cut
        other = F.sum(g).over(w) - F.col(g) if g in ("penalty", "class_weight") else F.when(F.col("ind_id") % 2 == 0, F.max_by(g, "ind_id").over(w)).otherwise(F.min_by(g, "ind_id").over(w))
        out.append(F.when(mates & full & swap, other).otherwise(F.col(g)).cast(dict(population.dtypes)[g]).alias(g))
    return pop.select("ind_id", *out)


def mutate(population: DataFrame, mutpb: float, indpb: float, tag: str = "mut") -> DataFrame:
    """With probability mutpb, each gene with indpb: numbers move by a bounded uniform step and are clipped, flags flip."""
    u = lambda t: uniform(f"{tag}:{t}", F.col("ind_id"))
    gate = u("gate") < mutpb
    hit = lambda g: gate & (u(f"{g}:hit") < indpb)
    return population.select(
        "ind_id",
        F.when(hit("c"), clip(F.col("log10_c") + (u("c:step") * F.lit(0.8) - F.lit(0.4)), -2, 1)).otherwise(F.col("log10_c")).alias("log10_c"),
        F.when(hit("p"), 1 - F.col("penalty")).otherwise(F.col("penalty")).alias("penalty"),
        F.when(hit("w"), 1 - F.col("class_weight")).otherwise(F.col("class_weight")).alias("class_weight"),
        F.when(hit("t"), clip(F.col("threshold") + (u("t:step") * F.lit(0.2) - F.lit(0.1)), 0.3, 0.7)).otherwise(F.col("threshold")).alias("threshold"),
    )


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ind_id, changed): whether an individual's genes differ from before, so that its fitness must be found anew."""
    same = F.expr(" and ".join(f"b.{g} <=> a.{g}" for g in GENES))
    return after.alias("a").join(before.alias("b"), "ind_id", "left").select("ind_id", (~same).alias("changed"))


def elitism(parents: DataFrame, offspring: DataFrame, n: int) -> DataFrame:
    """The n best parents in place of the n worst offspring."""
    worst = offspring.orderBy("fitness", F.col("ind_id").desc()).limit(n).select("ind_id")
    kept = offspring.join(worst, "ind_id", "left_anti").withColumn("origin", F.lit("offspring"))
    return kept.unionByName(select_best(parents, n).withColumn("origin", F.lit("elite")))


def early_stop_trace(history: DataFrame, patience: int) -> DataFrame:
    """(gen, best, best_so_far, stagnation, stopped) of history(gen, best), a row for each generation."""
    marked = running(history.select("gen", "best"), [], "gen", highs={"best_so_far": F.col("best")}, earlier={"before": F.col("best")})
    better = F.col("before").isNull() | (F.col("best") > F.col("before") + LEAST_GAIN)
    traced = running(marked, [], "gen", highs={"last": F.when(better, F.col("gen"))})
    stale = F.col("gen") - F.col("last")
    return traced.select("gen", "best", "best_so_far", stale.alias("stagnation"), (stale >= patience).alias("stopped"))


# The search itself. A population is some hundred rows of four numbers, so it evolves on the driver; fits are dealt out.


def recall_gap(y: np.ndarray, yhat: np.ndarray, group: np.ndarray) -> float:
    low = group <= np.median(group)
    if low.all() or not low.any():
        return 0.0
    recall = lambda m: float(((y == 1) & (yhat == 1) & m).sum() / max(((y == 1) & m).sum(), 1))
    return abs(recall(low) - recall(~low))


def score(y: np.ndarray, yhat: np.ndarray, group: np.ndarray) -> tuple[float, float, float, float]:
    """Recall, specificity, F1 and recall gap, 0 where undefined."""
    tp, fn = int(((y == 1) & (yhat == 1)).sum()), int(((y == 1) & (yhat == 0)).sum())
    fp, tn = int(((y == 0) & (yhat == 1)).sum()), int(((y == 0) & (yhat == 0)).sum())
    over = lambda a, b: a / b if b else 0.0
    return over(tp, tp + fn), over(tn, tn + fp), over(2 * tp, 2 * tp + fp + fn), recall_gap(y, yhat, group)


def _settings(genes: np.ndarray) -> tuple[float, str, bool, float]:
    return float(10 ** genes[0]), "l1" if round(float(genes[1])) == 0 else "l2", round(float(genes[2])) == 1, float(np.clip(genes[3], 0.3, 0.7))


class Search:
    """Evaluates populations over a bounded training sample: one Spark job a generation, a task for some (individual, fold) fits.

    Folds are standardized once, not once an individual; fits are remembered by decoded genes without the threshold,
    and fitness by all genes.
    """

    def __init__(self, spark: SparkSession, x: np.ndarray, y: np.ndarray, fold: np.ndarray, group: np.ndarray):
        folds = []
        for k in sorted(set(fold.tolist())):
            train, val = fold != k, fold == k
            mean, std = x[train].mean(axis=0), x[train].std(axis=0)
            std[std == 0] = 1
            folds.append(((x[train] - mean) / std, y[train], (x[val] - mean) / std, y[val], group[val]))
        self.spark, self.n_folds = spark, len(folds)
        self.shared = spark.sparkContext.broadcast(folds)
        self.known: dict[tuple, float] = {}

    def fitness(self, population: np.ndarray) -> np.ndarray:
        keys = [tuple(np.round(np.array([np.log10(s[0]), s[1] == "l2", s[2], s[3]], float), 9)) for s in map(_settings, population)]
        new = sorted(set(keys) - set(self.known))
        if new:
            tasks = pd.DataFrame([(i, k, *new[i]) for i in range(len(new)) for k in range(self.n_folds)], columns=["i", "fold", "g0", "g1", "g2", "g3"])
            shared = self.shared

            def run(batches):
                for pdf in batches:
                    out = []
                    for r in pdf.itertuples(index=False):
                        xt, yt, xv, yv, gv = shared.value[int(r.fold)]
                        w = fit_logistic(xt, yt, 10**r.g0, "l2" if r.g1 else "l1", balanced(yt) if r.g2 else None)
                        out.append((r.i, *score(yv, (predict_logistic(xv, w) >= r.g3).astype(int), gv)))
                    yield pd.DataFrame(out, columns=["i", "recall", "specificity", "f1", "gap"])

            frame = self.spark.createDataFrame(tasks).repartition(min(len(tasks), self.spark.sparkContext.defaultParallelism * 2))
            rows = frame.mapInPandas(run, "i long, recall double, specificity double, f1 double, gap double").collect()
            means = pd.DataFrame([r.asDict() for r in rows]).groupby("i").mean()
            for i, m in means.iterrows():
                self.known[new[int(i)]] = float(FITNESS[0] * m.recall + FITNESS[1] * m.specificity + FITNESS[2] * m.f1 - FITNESS[3] * m.gap)
        return np.array([self.known[k] for k in keys])


def evolve(search: Search, how: Experiment, seed: int = 42) -> tuple[np.ndarray, float, list[float]]:
    """The best genes, their fitness, and the best fitness after each generation."""
    rng = np.random.default_rng(seed)
    n = how.population_size
    pop = np.column_stack([rng.uniform(-2, 1, n), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.uniform(0.3, 0.7, n)])
    fit = search.fitness(pop)
    history, stale = [float(fit.max())], 0
    for _ in range(how.generations):
        order = np.argsort(-fit, kind="stable")
        elite, elite_fit = pop[order[: how.elitism_count]].copy(), fit[order[: how.elitism_count]]
        draws = rng.integers(0, n, (n, how.tournament_size))
        chosen = draws[np.arange(n), np.argmax(fit[draws], axis=1)]
        child = pop[chosen].copy()
        for i in range(0, n - 1, 2):
            if rng.random() < how.cxpb:
                cut = rng.integers(1, 4)
                swap = rng.random(4) < 0.5 if how.crossover == "uniform" else np.arange(4) >= cut
                child[i, swap], child[i + 1, swap] = child[i + 1, swap].copy(), child[i, swap].copy()
        for row in child:
            if rng.random() < how.mutpb:
                hit = rng.random(4) < how.mutation_indpb
                if hit[0]:
                    row[0] = np.clip(row[0] + rng.uniform(-0.4, 0.4), -2, 1)
                row[1:3] = np.where(hit[1:3], 1 - np.round(row[1:3]), row[1:3])
                if hit[3]:
                    row[3] = np.clip(row[3] + rng.uniform(-0.1, 0.1), 0.3, 0.7)
        pop, fit = child, search.fitness(child)
        worst = np.argsort(fit, kind="stable")[: how.elitism_count]
        pop[worst], fit[worst] = elite, elite_fit
        top = float(fit.max())
        stale = 0 if top > history[-1] + LEAST_GAIN else stale + 1
        history.append(max(top, history[-1]))
        if stale >= how.early_stop_patience:
            break
    at = int(np.argmax(fit))
    return pop[at], float(fit[at]), history


def run_experiment(spark: SparkSession, rows: DataFrame, features: list[str], label: str, group: str, key: str, how: Experiment, most: int = 20_000) -> dict:
    """Search on training rows, refit the winner on all of them, and score it on all test rows; `model` is what models.save_linear() saves.

    rows has columns split and fold. The search alone sees the `most` first training rows in the random order at most;
    the refit and the scores are distributed, and the metrics those of a baseline scored in the same way.
    """
    from tessella.operators import models
    from tessella.operators.features import scale
    from tessella.operators.metrics import confusion, disparity, rates
    from tessella.operators.split import order_key

    start = time.time()
    ordered = rows.orderBy(order_key(F.col(key)), key)
    train = ordered.where("split = 'train'").select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("int").alias("_y"), F.col(group).cast("double").alias("_g"), "fold").limit(most).toPandas()
    x, y = train[features].to_numpy(), train["_y"].to_numpy()
    genes, best, history = evolve(Search(spark, x, y, train["fold"].to_numpy(), train["_g"].to_numpy()), how)
    c, penalty, weighted, threshold = _settings(genes)
    z = [f + "_z" for f in features]
    scaled = scale(rows, features, F.col("split") == "train")
    whole = scaled.where("split = 'train'")
    stats = rows.where("split = 'train'").agg(F.count("*").alias("n"), *[f(F.col(x).cast("double")).alias(f"{n}{i}") for i, x in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    weights, intercept = models.fit_lr(whole, z, label, c, penalty, balanced=weighted, penalize_intercept=True)
    scored = scaled.where("split = 'test'").select(F.lit(how.exp_id).alias("model"), F.col(label).cast("int").alias("y"), models.logit(weights, intercept).alias("p"), F.col(group).cast("double").alias("grp"))
    judged = models.threshold_predict(scored, threshold)
    rate, gap = rates(confusion(judged, "model")).first(), disparity(judged).first()
    recall, specificity, f1, gap = (rate["recall"], rate["specificity"], rate["f1"], gap["disparity"]) if rate else (0.0, 0.0, 0.0, 0.0)
    return {
        "exp_id": how.exp_id, "generations_run": len(history) - 1, "best_fitness": best, "best_C": c, "best_penalty": penalty, "best_class_weight": "balanced" if weighted else "None",
        "best_threshold": threshold, "test_recall": recall, "test_specificity": specificity, "test_f1": f1, "test_disparity": gap, "n_train": stats["n"], "runtime_seconds": round(time.time() - start, 2),
        "model": {
            "name": how.exp_id, "features": features, "means": [stats[f"m{i}"] for i in range(len(features))], "deviations": [stats[f"s{i}"] or 1.0 for i in range(len(features))],
            "weights": [weights[f + "_z"] for f in features], "intercept": intercept, "threshold": threshold, "C": c, "penalty": penalty, "class_weight": "balanced" if weighted else None, "fitness": best,
        },
    }
