"""Known numbers, invariants and edge cases of the tabular operators."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__
from tessella.functions.scalar import rounded, snake, to_number
from tessella.operators import clean, explain, features, ga, metrics, models, narrate, profile, solver, split
from tessella.operators.quantiles import exact_quantiles
from tessella.plans import fits
from tessella.sources import files


def frame(spark, tp, fn, fp, tn, model="m"):
    rows = [(model, 1, 1)] * tp + [(model, 1, 0)] * fn + [(model, 0, 1)] * fp + [(model, 0, 0)] * tn
    return spark.createDataFrame([(m, i, y, h, float(i)) for i, (m, y, h) in enumerate(rows)], "model string, row_id long, y int, yhat int, grp double")


@pytest.mark.parametrize(("cells", "recall", "specificity", "f1"), [((30, 6, 7, 66), 0.833333, 0.904110, 0.821918), ((21, 15, 2, 71), 0.583333, 0.972603, 0.711864), ((24, 12, 5, 68), 0.666667, 0.931507, 0.738462), ((31, 5, 4, 69), 0.861111, 0.945205, 0.873239), ((0, 0, 0, 5), 0.0, 1.0, 0.0)])
def test_published_confusion_counts(spark, cells, recall, specificity, f1):
    r = metrics.rates(metrics.confusion(frame(spark, *cells), "model")).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == cells
    assert (r["recall"], r["specificity"], r["f1"]) == (recall, specificity, f1)


def test_coercion_and_names(spark):
    texts = ["2.07", "42", "-3", ".5", "5.", "1e3", " 2.5 ", "a", "1.99.", "", "1d", "1_000", "nan", "inf", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_number(F.col("t"))).collect()]
    assert got == [2.07, 42, -3, 0.5, 5, 1000, 2.5] + [None] * 8
    assert spark.createDataFrame([("  I   beta-HCG(mIU/mL)\n",)], "t string").select(snake(F.col("t"))).first()[0] == "i_beta_hcg_miu_ml"


def test_doubles_are_rounded_as_sql_rounds_them(spark):
    edges = [0.5035, 0.5075, 0.4995, 0.0005, -0.0005, 0.0015, 0.0025, -2.5, 4.9999999999999994e-4, 5e-324, -0.0, 9007199254740.993, 4503599627370.4955, 1e300, 1.7e308, -1.7e308, float("inf"), float("-inf")]
    values = edges + [k / 50000 for k in range(60000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(*[rounded(F.col("v"), d) for d in (2, 3, 6)]).collect()
    rows = pa.table({"i": range(len(values)), "v": pa.array(values, pa.float64())})  # noqa: F841
    want = duckdb.sql("select round(v, 2), round(v, 3), round(v, 6) from rows order by i").fetchall()
    assert [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(rounded(F.col("v"), 3)).collect()
    assert odd[0][0] is None and odd[1][0] != odd[1][0]


def test_hormone_miniature(spark):
    rows = [(1, 0, "2.0", 1.5), (2, 1, "8.0", 2.5), (3, 0, "a", 1.5), (4, 1, "6.0", 90.0), (5, 0, "4.0", None), (6, 0, "1.99.", float("nan"))]
    df = clean.coerce(spark.createDataFrame(rows, "id int, y int, amh string, hcg double"), ["id", "y"])
    got = {r["id"]: (r["amh"], r["hcg"]) for r in clean.impute_median(df, ["amh", "hcg"]).collect()}
    assert got[3][0] == got[6][0] == 5.0 and got[5][1] == got[6][1] == 2.0
    train = clean.impute_median(df, ["amh"], fit_on=df.where("id <= 2"))
    assert {r["id"]: r["amh"] for r in train.collect()}[3] == 5.0
    assert clean.impute_median(df.limit(0), ["amh"]).collect() == []
    assert clean.drop_tolerant(df, ["amh", "absent"]).columns == ["id", "y", "hcg"]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    for x in (rng.normal(size=5000), np.concatenate([np.full(40_000, 0.05), rng.normal(size=3000)]), np.array([-np.inf, 0.0, 1.0, 2.0, np.inf, 1e300]), np.exp(rng.normal(size=2000) * 30), rng.integers(0, 3, 999).astype(float), np.array([1.0, 2.0, 3.0, 4.0]), np.array([7.0])):
        df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None), (float("nan"), None)], "x double, e double").repartition(5)
        got = exact_quantiles(df, ["x", "e"], probs)
        with np.errstate(invalid="ignore"):
            want = np.quantile(x, probs)
        assert all(a == b or np.isclose(a, b, rtol=1e-12) or np.isnan(b) for a, b in zip(got["x"], want, strict=True)) and got["e"] == [None] * len(probs)


def test_quantiles_of_a_million_equal_values(spark):
    """Order statistics come from counts: the values that tie are never gathered."""
    from tessella.operators import quantiles

    df = spark.range(1_000_000).select(F.when(F.col("id") % 10 == 0, F.col("id") / 1e6).otherwise(0.05).alias("x"))
    got = exact_quantiles(df, ["x"], [0.05, 0.25, 0.5, 0.99])["x"]
    assert np.allclose(got, np.quantile(np.where(np.arange(1_000_000) % 10 == 0, np.arange(1_000_000) / 1e6, 0.05), [0.05, 0.25, 0.5, 0.99]))
    plan = df.agg(F.count("x"))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and quantiles.PARTS * 8 < 100_000


def test_running_values(spark):
    from tessella.operators.running import running

    rng = np.random.default_rng(8)
    rows = [(g, float(v), int(c)) for g in ("a", "b", None) for v, c in zip(rng.choice(100_000, 3000, replace=False) ** 2, rng.integers(0, 9, 3000), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, c long").repartition(7)
    got = running(df, ["g"], "v", sums={"s": F.col("c")}, highs={"h": F.col("c")}, earlier={"e": F.col("c")}, following={"n": F.col("c")})
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append(r)
    for g, found in by.items():
        found.sort(key=lambda r: r["v"])
        c = np.array([x for _, x in sorted((v, c) for k, v, c in rows if k == g)])
        assert [r["s"] for r in found] == np.cumsum(c).tolist() and [r["h"] for r in found] == np.maximum.accumulate(c).tolist()
        assert [r["e"] for r in found] == [None, *np.maximum.accumulate(c)[:-1].tolist()] and [r["n"] for r in found] == [*c[1:].tolist(), None]
    assert running(df.limit(0), [], "v", sums={"s": F.col("c")}).collect() == []


def test_neighbours_match_brute_force(spark, monkeypatch):
    from tessella.operators import knn

    monkeypatch.setattr(knn, "QUERY_ROWS", 30)
    monkeypatch.setattr(knn, "TRAIN_ROWS", 50)
    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 3, (300, 3)).astype(float), rng.integers(0, 3, (70, 3)).astype(float)  # many ties
    frame = lambda name, a: spark.createDataFrame([(2**60 + i, v.tolist()) for i, v in enumerate(a)], f"{name} long, vector array<double>")
    got = {(r["qid"], r["rank"]): (r["tid"], r["dist"]) for r in knn.knn(frame("qid", q), frame("tid", x), 9).collect()}
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(axis=1))
        for rank, j in enumerate(np.lexsort((np.arange(300), d))[:9], 1):
            assert got[2**60 + i, rank] == (2**60 + j, d[j])
    assert knn.knn(frame("qid", q), frame("tid", x[:0]), 3).collect() == [] and knn.knn(frame("qid", q[:0]), frame("tid", x), 3).collect() == []


def test_shapley_values_match_their_definition():
    from itertools import permutations

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2) | (x[:, 3] > 1)).astype(int)
    nodes = models.fit_tree(x, y, 5)
    phi = explain.tree_phi(x[:20], explain.leaf_paths(nodes))
    want = np.zeros((20, 4))
    for order in permutations(range(4)):
        for i, f in enumerate(order):
            want[:, f] += (explain.tree_predict(nodes, x[:20], frozenset(order[: i + 1])) - explain.tree_predict(nodes, x[:20], frozenset(order[:i]))) / 24
    assert np.allclose(phi, want, atol=1e-12)
    assert np.mean((explain.tree_predict(nodes, x) >= 0.5) == y) > 0.9
    predict = lambda z: (z[:, 0] * z[:, 1] > 0).astype(float) + z[:, 2]
    got, want = explain.kernel_phi(x[:5], predict, x[100:110]), np.zeros((5, 4))
    for order in permutations(range(4)):
        for b in x[100:110]:
            now = np.tile(b, (5, 1))
            for f in order:
                before = predict(now)
                now[:, f] = x[:5, f]
                want[:, f] += (predict(now) - before) / 240
    assert np.allclose(got, want, atol=1e-12)


def test_many_features_are_explained():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 30))
    nodes = models.fit_tree(x, (x.sum(axis=1) > 0).astype(int), 7)
    phi = explain.tree_phi(x[:50], explain.leaf_paths(nodes))
    assert len({n["feature"] for n in nodes} - {-1}) > 12
    assert np.allclose(phi.sum(axis=1), explain.tree_predict(nodes, x[:50]) - explain.tree_predict(nodes, x[:1], frozenset())[0])


def test_learning_curve_validates_on_all_rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600)
    a = rng.normal(size=600) + 3 * y
    rows = spark.createDataFrame([(i, float(a[i]), int(y[i]), i % 5) for i in range(600)], "id long, a double, y int, fold int")
    got = models.learning_curve(rows, ["a"], "y", "id", most=100).collect()
    assert len(got) == 3 * 10 * 5 and {r["model"] for r in got} == {"lr", "knn", "tree"} and max(r["n_train"] for r in got) <= 100
    assert all(r["f1_val"] > 0.8 for r in got if r["step"] == 10)
    # f1_val counts each row of a fold, although models are fit on 100 rows: its denominators show that.
    import math
    assert all(any(math.isclose(r["f1_val"], 2 * tp / (2 * tp + w)) for tp in range(30, 121) for w in range(0, 60)) for r in got if r["step"] == 10)


def test_saved_winner_explains_with_its_threshold(spark):
    from tessella.plans import report

    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3), "train" if i % 3 else "test", i % 5) for i in range(200)], "id long, a double, b double, y int, split string, fold int")
    path = files.scratch_path(spark, "chain")
    best = report.run_search(spark, rows, ["a", "b"], "y", "a", "id", [ga.Experiment("t", 6, 1, 0.7, 0.5, 3, "uniform", 0.4)], path, 100)
    model = models.load_linear(spark, best)
    assert model["features"] == ["a", "b"] and 0.3 <= model["threshold"] <= 0.7
    report.explain_saved(spark, rows.where("split = 'test'"), best, "id", "y", 4, path, "20240101T000000Z")
    got = files.read_table(spark, f"{path}/responses", "csv", report.RESPONSE_SCHEMA).orderBy("patient_id").collect()
    test = [r for r in rows.where("split = 'test'").orderBy("id").limit(4).collect()]
    for r, t in zip(got, test, strict=True):
        z = sum(w * (t[f] - m) / d for f, w, m, d in zip(model["features"], model["weights"], model["means"], model["deviations"], strict=True))
        p = 1 / (1 + np.exp(-z - model["intercept"]))
        assert abs(r["predicted_probability_pcos"] - p) < 1e-5 and r["predicted_label"] == int(p >= model["threshold"]) and r["model_file"] == best


def test_sheets(spark, tmp_path):
    from tessella.sources import sheets

    df = spark.createDataFrame([(1, "a <b> & ü", 1.5), (2, None, None), (3, "  x ", -2e-7)], "id long, `name, x` string, v double")
    sheets.write_sheet(df, f"file://{tmp_path}/t.xlsx", "Data")
    got = sheets.read_sheet(spark, f"file://{tmp_path}/t.xlsx", "Data")
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1.0, "a <b> & ü", 1.5), (2.0, None, None), (3.0, "  x ", -2e-7)]
    assert files.read_table(spark, f"file://{tmp_path}/t.xlsx", "xlsx").count() == 3
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_sheet(spark, f"file://{tmp_path}/t.xlsx", "Other").collect()
    import io
    import zipfile

    shared = '<?xml version="1.0"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>k</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>'
    body = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>7</v></c></row><row r="3"/><row r="4"><c r="A4" t="e"><v>#N/A</v></c><c r="C4"><v>5</v></c></row></sheetData></worksheet>'
    data = sheets.sheet_bytes(["x"], [])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, body if "sheet1" in name else old.read(name))
        new.writestr("xl/sharedStrings.xml", shared)
    (tmp_path / "s.xlsx").write_bytes(out.getvalue())
    got = sheets.read_sheet(spark, f"file://{tmp_path}/s.xlsx")
    assert got.columns[:3] == ["k", "Unnamed: 1", "k.1"] and len(got.columns) == 28
    assert [(r["k"], r["k.1"], r["Unnamed: 27"]) for r in got.collect()] == [("rich", None, 7.0), (None, 5.0, None)]


def test_settings(tmp_path, monkeypatch):
    from tessella.sources import settings

    (tmp_path / ".env").write_text("# c\nexport A=1\nB = 'x # y' \nC=z # w\nTEXT_API_KEY=k\nTEXT_API_URL=http://h\nbad line\n")
    own = settings.load_settings(str(tmp_path / ".env"), {"A": "0"})
    assert (own["A"], own["B"], own["C"]) == ("0", "x # y", "z") and settings.load_settings(str(tmp_path / ".env"), {"A": "0"}, True)["A"] == "1"
    assert settings.load_settings(str(tmp_path / "none"), {"A": "0"}) == {"A": "0"}
    assert settings.text_mode(own) == "api" and settings.text_mode(own, True) == settings.text_mode({}) == settings.text_mode(own | {"TEXT_FORCE_LOCAL": "true"}) == "local_fallback"

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return b'{"output_text": " hi "}'

    sent = []
    monkeypatch.setattr(settings.urllib.request, "urlopen", lambda r, timeout: sent.append(r) or Answer())
    assert settings.text_client(own, "m")("ask") == "hi" and b'"model": "m"' in sent[0].data and sent[0].headers["Authorization"] == "Bearer k"
    assert len(settings.run_key()) == 16


def test_splits_and_folds(spark):
    df = spark.range(541).select("id", (F.col("id") < 177).cast("int").alias("y"))
    parts = split.stratified_split(df, "y", "id", {"train": 0.6, "val": 0.2, "test": 0.2})
    counts = {(r["y"], r["split"]): r["n"] for r in parts.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "train"): 218, (0, "val"): 73, (0, "test"): 73, (1, "train"): 106, (1, "val"): 35, (1, "test"): 36}
    assert parts.count() == 541 and parts.exceptAll(split.stratified_split(df.repartition(5), "y", "id", {"train": 0.6, "val": 0.2, "test": 0.2})).isEmpty()
    for seed in (42, None):
        n = [r["n"] for r in split.kfold(df, "y", "id", 5, seed).groupBy("y", "fold").agg(F.count("*").alias("n")).where("y = 1").collect()]
        assert len(n) == 5 and max(n) - min(n) <= 1 and sum(n) == 177


def test_folds_without_a_seed_follow_the_key(spark):
    rng = np.random.default_rng(6)
    ids = rng.choice(10**12, 700, replace=False)
    rows = [(int(i), int(c)) for i, c in zip(ids, rng.integers(0, 3, 700), strict=True)]
    got = {r["id"]: r["fold"] for r in split.kfold(spark.createDataFrame(rows, "id long, y int").repartition(5), "y", "id", 4, seed=None).collect()}
    for label in range(3):
        assert [got[i] for i in sorted(i for i, c in rows if c == label)] == [k % 4 for k in range(sum(c == label for _, c in rows))]


def test_scaling_uses_training_rows_and_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 100.0, 9.0)], "id int, x double, c double")
    got = {r["id"]: (r["x_z"], r["c_z"]) for r in features.scale(df, ["x", "c"], F.col("id") < 3).collect()}
    assert got[1] == (-1.0, 0.0) and got[2] == (1.0, 0.0) and got[3] == (98.0, 4.0)


def test_auc_with_ties_and_roc(spark):
    df = spark.createDataFrame([("m", 0, 0.1), ("m", 0, 0.4), ("m", 1, 0.4), ("m", 1, 0.4), ("m", 0, 0.4), ("m", 1, 0.9)], "model string, y int, p double")
    assert metrics.auc(df).first()["auc"] == 0.777778
    last = metrics.roc_curve(df).orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_disparity_of_an_empty_side_is_zero(spark):
    df = frame(spark, 3, 1, 0, 0).withColumn("grp", F.lit(1.0))
    assert metrics.disparity(df).first()["disparity"] == 0.0


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "t int, x double")
    assert profile.describe(df, ["x"]).first()["n"] == 0 and profile.histogram(df, "x", "t").collect() == [] and profile.class_balance(df, "t").collect() == []


def test_solvers_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.0] + 0.3 + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    for penalty in ("l2", "l1"):
        w = solver.fit_logistic(x, y, 0.5, penalty, solver.balanced(y), rounds=5000, tolerance=1e-12)
        found, intercept = models.fit_lr(df, ["a", "b", "c"], "y", 0.5, penalty, balanced=True, penalize_intercept=True)
        assert np.allclose([*found.values(), intercept], w, atol=2e-4)


def test_genetic_search_keeps_the_best(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + rng.normal(size=200) > 0.4).astype(int)
    search = ga.Search(spark, x, y, np.arange(200) % 5, rng.normal(size=200))
    how = ga.Experiment("t", 10, 4, 0.7, 0.5, 3, "one_point", 0.4, 2, 10)
    genes, best, history = ga.evolve(search, how)
    assert history == sorted(history) and best == history[-1] <= 0.9 and len(history) == 5
    assert -2 <= genes[0] <= 1 and genes[1] in (0, 1) and genes[2] in (0, 1) and 0.3 <= genes[3] <= 0.7
    assert ga.evolve(search, how)[1] == best


def test_mutation_stays_in_bounds(spark):
    pop = ga.init_population(spark.range(500).select(F.col("id").alias("ind_id")))
    bad = ga.mutate(ga.crossover(pop, 1.0, "uniform"), 1.0, 1.0).where("log10_c < -2 or log10_c > 1 or penalty not in (0, 1) or threshold < 0.3 or threshold > 0.7")
    assert bad.isEmpty()


def test_tree_shap_adds_up(spark):
    sf = "/root/testdata/sf0.01"
    rows = fits.modelling_table(spark, sf)
    model = models.tree_pipeline(fits.FEATURES, "quality", 3).fit(rows.where("split = 'train'"))
    nodes = explain.tree_nodes(model.stages[-1])
    phi = {r["doc_id"]: r["s"] for r in explain.tree_shap(rows, "doc_id", fits.FEATURES, nodes).groupBy("doc_id").agg(F.sum("phi").alias("s")).collect()}
    p = {r["row_id"]: r["p"] for r in models.predictions(model, rows, "t", "doc_id", "quality", "n_chars").collect()}
    base = explain.tree_predict(nodes, np.zeros((1, 4)), frozenset())[0]
    assert max(abs(phi[i] + base - p[i]) for i in p) < 1e-9


def test_sampled_shap_adds_up(spark):
    background = np.array([[0.0, 0.0], [1.0, 1.0]])
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, b double")
    got = explain.sampled_shap(df, "id", ["a", "b"], lambda x: x[:, 0] * x[:, 1], background, 200).agg(F.sum("phi")).first()[0]
    assert 5.0 <= got <= 6.0


def test_narratives(spark):
    factors = F.array(F.struct(F.lit("AMH").alias("feature"), F.lit(0.5).alias("contribution")))
    df = spark.createDataFrame([(0.5041,)], "p double").select(narrate.template_text(F.col("p"), F.lit(0), factors).alias("t"))
    assert "probabilidade 50.41% de PCOS, com risco baixa a moderada" in df.first()["t"] and "AMH (+0.50)" in df.first()["t"]
    df = df.union(spark.createDataFrame([("nothing",), (None,), ("linguagem SENSÍVEL, critérios; recomendações",)], "t string"))
    assert [tuple(r)[1:] for r in narrate.rubric(df, "t").collect()] == [(4, 3, 4, 4), (3, 3, 3, 3), (3, 3, 3, 3), (4, 4, 3, 4)]
    texts = spark.createDataFrame([("ask", "plain")], "prompt string, template string")
    assert narrate.generate(texts).first()["response"] == "plain"

    def fails(_):
        raise RuntimeError

    assert narrate.generate(texts, fails).first()["response"] == "[fallback] RuntimeError\nplain"
    assert narrate.generate(texts, str.upper).first()["response"] == "ASK"


def test_text_survives_csv_and_old_spreadsheets_are_refused(spark):
    rows = spark.createDataFrame([(1, 'line one\nline "two", end'), (2, "")], "id int, t string")
    path = files.scratch_path(spark, "t")
    files.write_table(rows, path, "csv")
    assert files.read_table(spark, path, "csv", rows.schema).where("id = 1").first()["t"] == 'line one\nline "two", end'
    with pytest.raises(ValueError, match="convert"):
        files.read_table(spark, "x", "xls")


def test_streams_are_scored(spark, tmp_path):
    from tessella.streaming.score import score_stream

    spark.range(10).select(F.col("id").cast("double").alias("x")).write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema("x double").parquet(str(tmp_path / "in")), {"x": 1.0}, -4.5, 0.5)
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").where("yhat = 1").count() == 5


@pytest.mark.parametrize("name", sorted(fits.queries()))
def test_fits_give_rows(spark, name):
    assert fits.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_case_report_files(spark):
    rows = fits.case_report(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 8 and [r["patient_id"] for r in rows] == [f"P_{i:03d}" for i in range(1, 9)]
    assert all((r["medical_precision"], r["cultural_sensitivity"], r["language_adequacy"], r["overall"]) == (4, 3, 4, 4) for r in rows)
    assert all(r["llm_response"].startswith("Interpretação do caso:\n") and r["mode"] == "local_fallback" and r["top_features"].count("[") == 5 for r in rows)


def test_command_line(spark, capsys, tmp_path):
    from tessella.__main__ import main

    main(["table_shape", "/root/testdata/sf0.001"])
    assert "n_rows" in capsys.readouterr().out
    main(["head_n", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--format", "csv"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).count() == 5
    models.save_linear(spark, f"file://{tmp_path}/m", {"features": fits.FEATURES, "means": [0.0] * 4, "deviations": [1.0] * 4, "weights": [0.001, 0.0, 0.0, 0.0], "intercept": 0.0, "threshold": 0.4})
    main(["explain", "/root/testdata/sf0.001", "--model-file", f"file://{tmp_path}/m", "--sample-count", "3", "--force-local", "--out", f"file://{tmp_path}/cases"])
    assert "local_fallback" in capsys.readouterr().out
    assert len([p for p in (tmp_path / "cases").iterdir()]) == 4
    with pytest.raises(SystemExit):
        main(["explain", "/root/testdata/sf0.001"])


def test_the_winner_of_a_search_is_refit_and_scored_on_whole_splits(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 900)
    x = rng.normal(size=(900, 2)) + 0.8 * y[:, None]
    part = np.where(np.arange(900) % 3 == 2, "test", "train")
    rows = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), int(y[i]), str(part[i]), i % 5) for i in range(900)], "id long, a double, b double, y int, split string, fold int")
    got = ga.run_experiment(spark, rows, ["a", "b"], "y", "a", "id", ga.Experiment("t", 6, 1, 0.7, 0.5, 3, "uniform", 0.4), most=60)
    train, test = part == "train", part == "test"
    mean, std = x[train].mean(axis=0), x[train].std(axis=0)
    w = solver.fit_logistic((x[train] - mean) / std, y[train], got["best_C"], got["best_penalty"], solver.balanced(y[train]) if got["best_class_weight"] == "balanced" else None)
    yhat = (solver.predict_logistic((x[test] - mean) / std, w) >= got["best_threshold"]).astype(int)
    assert got["n_train"] == 600
    assert np.allclose([got[f"test_{k}"] for k in ("recall", "specificity", "f1", "disparity")], ga.score(y[test], yhat, x[test, 0]), atol=1e-6)


def test_neighbours_are_tuned_on_all_rows(spark):
    # Only rows beyond the first 20000 in the random order are positives, far from the others.
    ids = spark.range(20_400)
    place = F.row_number().over(Window.orderBy(split.order_key(F.col("id")), "id"))
    rows = ids.withColumn("place", place).withColumn("late", F.col("place") > 20_000)
    rows = rows.select("id", F.when(F.col("late"), 1).otherwise(0).alias("y"), F.when(F.col("late"), 1e6 + F.col("place")).otherwise(F.col("place").cast("double")).alias("a_z"), (F.col("place") % 5).alias("fold"))
    assert models.tune_k(rows, "id", "y", ["a_z"], 1) == (1, 1.0)
