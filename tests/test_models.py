import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import pipeline as MP
from quarry.models.knn import knn_candidates, knn_predict
from quarry.models.metrics import evaluate
from quarry.models.prep import poly_terms, split


@pytest.fixture(scope="module")
def reg_frame(spark):
    # FIXTURES B2: y = 2·f0 − 1.5·f1² + 0.5·f2·f3 + noise + 5, 200 rows, seed 42
    rng = np.random.default_rng(42)
    X = rng.uniform(size=(200, 5))
    y = 2 * X[:, 0] - 1.5 * X[:, 1] ** 2 + 0.5 * X[:, 2] * X[:, 3] + rng.normal(0, 0.5, 200) + 5
    rows = [tuple(float(v) for v in X[i]) + (float(y[i]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, f3 double, f4 double, y double, id long")
    return df, X, y


FEATS = ["f0", "f1", "f2", "f3", "f4"]


def _std(X):
    return (X - X.mean(0)) / X.std(0)


def test_ridge_closed_form(reg_frame):
    df, X, y = reg_frame
    fm = MP.fit(df, FEATS, "y", "ridge", alpha=10.0)
    Z = _std(X)
    w = np.linalg.solve(Z.T @ Z + 10.0 * np.eye(5), Z.T @ (y - y.mean()))
    pred = np.array([r["prediction"] for r in fm.transform(df).orderBy("id").collect()])
    assert np.allclose(pred, y.mean() + Z @ w, atol=1e-6)


def test_linear_equals_ols_and_poly_names(reg_frame):
    df, X, y = reg_frame
    fm = MP.fit(df, FEATS, "y", "polynomial", degree=2)
    assert fm.expanded[:6] == ["f0", "f1", "f2", "f3", "f4", "f0^2"] and fm.expanded[6] == "f0 f1"
    assert len(fm.expanded) == len(poly_terms(FEATS, 2)) == 20
    ev = evaluate(fm.transform(df), "y").first()
    assert ev["r2"] > 0.35


def test_bayesian_ridge_close_to_ols(reg_frame):
    df, X, y = reg_frame
    b = MP.fit(df, FEATS, "y", "bayesian_ridge").transform(df).orderBy("id").select("prediction").collect()
    o = MP.fit(df, FEATS, "y", "linear").transform(df).orderBy("id").select("prediction").collect()
    diff = np.abs(np.array([r[0] for r in b]) - np.array([r[0] for r in o]))
    assert diff.max() < 0.05


def test_svr_linear_and_rbf(spark):
    xs = np.linspace(-3, 3, 300)
    lin = spark.createDataFrame([(float(x), float(3 * x + 1)) for x in xs], "x double, y double")
    fm = MP.fit(lin, ["x"], "y", "svr", kernel="linear", C=100.0, epsilon=0.01)
    ev = evaluate(fm.transform(lin), "y").first()
    assert ev["r2"] > 0.99
    sine = spark.createDataFrame([(float(x), float(math.sin(2 * x))) for x in xs], "x double, y double")
    fm = MP.fit(sine, ["x"], "y", "svr", kernel="rbf", C=10.0, epsilon=0.05)
    assert evaluate(fm.transform(sine), "y").first()["r2"] > 0.5


def test_knn_brute_force_ties_and_zero_distance(spark):
    rng = np.random.default_rng(5)
    T = np.round(rng.normal(size=(60, 3)), 1)
    Q = np.vstack([T[:5], np.round(rng.normal(size=(20, 3)), 1)])  # some queries equal training points
    yt = rng.normal(size=60)
    tr = spark.createDataFrame([(i, [float(v) for v in T[i]], float(yt[i])) for i in range(60)], "tid long, x array<double>, y double")
    q = spark.createDataFrame([(i, [float(v) for v in Q[i]]) for i in range(len(Q))], "qid long, x array<double>")
    c = knn_candidates(q, tr, 4, 2.0, block_rows=16)  # several blocks each side
    got = {r["qid"]: r["prediction"] for r in knn_predict(c, "distance").collect()}
    uni = {r["qid"]: r["prediction"] for r in knn_predict(c, "uniform").collect()}
    for i in range(len(Q)):
        d = np.sqrt(((T - Q[i]) ** 2).sum(1))
        order = sorted(range(60), key=lambda j: (d[j], j))[:4]
        assert math.isclose(uni[i], yt[order].mean(), rel_tol=1e-9, abs_tol=1e-12)
        dd = d[order]
        exp = yt[order][dd == 0].mean() if (dd == 0).any() else (yt[order] / dd).sum() / (1 / dd).sum()
        assert math.isclose(got[i], exp, rel_tol=1e-9, abs_tol=1e-12)


def test_split_and_cv_folds(reg_frame):
    from quarry.models.selection import cross_validate, cv_summary

    df, X, y = reg_frame
    tr, te = split(df, ["id"], 0.2)
    assert tr.count() + te.count() == 200 and 25 <= te.count() <= 55
    assert tr.join(te, "id").count() == 0
    cv = cross_validate(df, FEATS, "y", "linear", ["id"], 5)
    assert cv.count() == 5 and cv.agg(F.sum("n")).first()[0] == 200
    s = cv_summary(cv).first()
    assert s["cv_r2_mean"] is not None and s["cv_r2_std"] >= 0


def test_auto_select_and_grid(reg_frame):
    from quarry.models.selection import auto_select, grid_search

    df, X, y = reg_frame
    cands = [("Linear Regression", "linear", {}), ("Decision Tree", "tree", {"max_depth": 1}),
             ("Broken", "lasso", {"alpha": "not-a-number"})]
    label, model, params, res = auto_select(df, FEATS, "y", ["id"], 3, cands)
    assert label == "Linear Regression" and res.filter("error IS NOT NULL").count() == 3
    fm, best, score, table = grid_search(df, FEATS, "y", "ridge", {"alpha": [0.01, 1000.0]}, ["id"], 3)
    assert best == {"alpha": 0.01} and table.count() == 2


def test_registry_roundtrip_and_stream_equals_batch(spark, reg_frame, tmpdir_path):
    from quarry.models.registry import ModelRegistry
    from quarry.models.scoring import score
    from quarry.streaming.score import file_stream, run_to_completion, score_stream

    df, X, y = reg_frame
    fm = MP.fit(df, FEATS, "y", "forest", n_estimators=5, max_depth=4)
    reg = ModelRegistry(spark, tmpdir_path + "/reg")
    reg.save(fm, "m1", {"r2": 1.0})
    back = reg.load("m1")
    a = score(fm, df).orderBy("id").select("Predicted_Value").collect()
    b = score(back, df).orderBy("id").select("Predicted_Value").collect()
    assert a == b
    assert [r["name"] for r in reg.list().collect()] == ["m1"]
    reg.delete("m1")
    assert reg.list().count() == 0
    src = tmpdir_path + "/in"
    df.write.parquet(src)
    streamed = run_to_completion(score_stream(back, file_stream(spark, src)))
    s = streamed.orderBy("id").select("Predicted_Value").collect()
    assert s == b


def test_score_names_defaults_and_unknown_category(spark):
    from quarry.models.scoring import fit_defaults, output_name, score

    assert output_name(["a", "Predicted_Value", "Predicted_Value_1"]) == "Predicted_Value_2"
    tr = spark.createDataFrame([(1.0, "a", 2.0), (2.0, "b", 4.0), (3.0, "a", 6.5), (4.0, "b", 8.0)], "x double, c string, y double")
    fm = MP.fit(tr, ["x", "c"], "y", "linear")
    fm.defaults = fit_defaults(tr, ["x", "c"])
    new = spark.createDataFrame([(None, "zzz"), (2.0, None)], "x double, c string")
    out = score(fm, new, fill_defaults=True).collect()
    assert len(out) == 2 and all(r["Predicted_Value"] is not None for r in out)
    with pytest.raises(ValueError):
        score(fm, new.select("x"))


def test_string_target_is_encoded_and_decodes(spark):
    from quarry.models.scoring import decode_prediction

    rows = [(float(i % 10), "hi" if i % 10 >= 5 else "lo") for i in range(100)]
    df = spark.createDataFrame(rows, "x double, t string")
    fm = MP.fit(df, ["x"], "t", "tree", max_depth=2)
    assert fm.params["target_labels"] == ["hi", "lo"]
    out = decode_prediction(fm.transform(df), "prediction", fm.params["target_labels"], "label").collect()
    assert all(r["label"] == ("hi" if r["x"] >= 5 else "lo") for r in out)


def test_knn_hierarchical_merge_many_blocks(spark):
    import quarry.models.knn as K

    rng = np.random.default_rng(9)
    T = rng.normal(size=(300, 2))
    Q = rng.normal(size=(12, 2))
    tr = spark.createDataFrame([(i, [float(v) for v in T[i]], float(i)) for i in range(300)], "tid long, x array<double>, y double")
    q = spark.createDataFrame([(i, [float(v) for v in Q[i]]) for i in range(12)], "qid long, x array<double>")
    old = K.MERGE_FANIN
    K.MERGE_FANIN = 2  # force several merge levels: 300 rows / 4-row blocks = 75 blocks
    try:
        c = K.knn_candidates(q, tr, 3, 2.0, block_rows=4).collect()
    finally:
        K.MERGE_FANIN = old
    got = {}
    for r in c:
        got.setdefault(r["qid"], []).append((r["rank"], r["tid"]))
    for i in range(12):
        d = np.sqrt(((T - Q[i]) ** 2).sum(1))
        exp = sorted(range(300), key=lambda j: (d[j], j))[:3]
        assert [t for _, t in sorted(got[i])] == exp


@pytest.mark.parametrize("model,params", [
    ("tree", {"max_depth": 5}), ("forest", {"n_estimators": 10, "max_depth": 5}),
    ("xgboost", {"n_estimators": 10}), ("lightgbm", {"n_estimators": 10, "num_leaves": 7}),
    ("huber", {}), ("svr", {"kernel": "linear"}), ("svr", {"kernel": "rbf"}), ("bayesian_ridge", {}),
    ("knn", {"n_neighbors": 5}), ("isotonic", {}),
])
def test_every_model_beats_the_mean(reg_frame, model, params):
    # SURVEY §5 property: R² above the mean predictor's 0 on held-out rows
    df, X, y = reg_frame
    tr, te = split(df, ["id"], 0.3)
    feats = ["f0"] if model == "isotonic" else FEATS
    fm = MP.fit(tr, feats, "y", model, **params)
    assert evaluate(fm.transform(te), "y").first()["r2"] > 0.0


def test_score_leaves_the_input_as_it_is(spark, reg_frame):
    from quarry.models.scoring import score

    df, X, _ = reg_frame
    fm = MP.fit(df, FEATS, "y", "linear")
    new = spark.createDataFrame([(1, None, 0.5, float("nan"), 0, 0.25, "p"), (2, 0.5, 0.5, 0.5, 1, 0.25, "q")],
                                "id long, f0 double, f1 double, f2 double, f3 int, f4 double, prediction string")
    got = score(fm, new)
    assert got.dtypes == new.dtypes + [("Predicted_Value", "double")]
    rows = {r["id"]: r for r in got.collect()}
    assert rows[1]["f0"] is None and math.isnan(rows[1]["f2"]) and rows[2]["f3"] == 1 and rows[2]["prediction"] == "q"
    zero = spark.createDataFrame([(0.0, 0.5, 0.0, 0.0, 0.25)], ", ".join(f"{c} double" for c in FEATS))
    assert rows[1]["Predicted_Value"] == pytest.approx(fm.transform(zero).first()["prediction"])
