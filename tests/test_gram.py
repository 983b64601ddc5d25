"""Moments, linear solvers, label dictionaries and isotonic blocks against numpy, at any partition count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import gram, isotonic
from quarry.models import pipeline as MP
from quarry.models.registry import ModelRegistry
from quarry.models.scoring import score
from quarry.models.selection import FoldMoments, cross_validate, grid_search

RNG = np.random.default_rng(7)
X = RNG.normal(size=(400, 4)) * [1, 10, 1e-3, 1] + [0, 1e6, 5, -3]
Y = X @ [2.0, -0.5, 300.0, 0.0] + RNG.normal(size=400)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(*map(float, x), float(v), i) for i, (x, v) in enumerate(zip(X, Y, strict=True))]
    return spark.createDataFrame(rows, "`a.b` double, `a b` double, `a/b` double, `a``b` double, `y.z` double, id long").cache()


COLS = ["a.b", "a b", "a/b", "a`b"]


@pytest.mark.parametrize("parts", [1, 8, 80])
def test_moments_merge_and_subtract(spark, frame, parts):
    x = F.array(*[F.col("`" + c.replace("`", "``") + "`") for c in COLS])
    got = gram.moments(frame.repartition(parts), x, F.col("`y.z`"), F.col("id") % 3)
    table = np.concatenate([X, Y[:, None]], 1)
    for k in range(3):
        rows = table[k::3]
        rest = rows - rows.mean(0)
        assert got[k].n == len(rows) and np.allclose(got[k].mean, rows.mean(0)) and np.allclose(got[k].cross, rest.T @ rest, rtol=1e-9, atol=1e-6)
    total = gram.total_of(got)
    left = gram.without(total, got[1])
    rows = np.delete(table, np.s_[1::3], 0)
    rest = rows - rows.mean(0)
    assert left.n == len(rows) and np.allclose(left.cross, rest.T @ rest, rtol=1e-8, atol=1e-5)


def closed_form(name, x, y, p):
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    n, yc = len(y), y - y.mean()
    if name == "linear":
        return np.linalg.lstsq(z, yc, rcond=None)[0]
    if name == "ridge":
        return np.linalg.solve(z.T @ z + p["alpha"] * np.eye(x.shape[1]), z.T @ yc)
    w = np.zeros(x.shape[1])  # proximal gradient
    l1, l2 = p["alpha"] * p.get("l1_ratio", 1.0), p["alpha"] * (1 - p.get("l1_ratio", 1.0))
    step = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + l2)
    for _ in range(20_000):
        g = w - step * (z.T @ (z @ w - yc) / n + l2 * w)
        w = np.sign(g) * np.maximum(np.abs(g) - step * l1, 0)
    return w


@pytest.mark.parametrize("name,params", [("linear", {}), ("ridge", {"alpha": 25.0}), ("lasso", {"alpha": 0.4}), ("elasticnet", {"alpha": 0.5, "l1_ratio": 0.3})])
def test_linear_models_with_odd_names(spark, frame, name, params):
    fm = MP.fit(frame, COLS, "y.z", name, **params)
    w = closed_form(name, X, Y, params)
    assert [f for f, _ in MP.importances(fm)] == COLS
    assert np.allclose([v for _, v in MP.importances(fm)], w, rtol=1e-6, atol=1e-7)
    got = [r.prediction for r in fm.transform(frame).orderBy("id").select("prediction").collect()]
    assert np.allclose(got, Y.mean() + ((X - X.mean(0)) / X.std(0)) @ w, rtol=1e-9)
    scored = score(fm, frame.select(*[f"`{c.replace('`', '``')}`" for c in COLS], "id"))
    assert scored.columns == [*COLS, "id", "Predicted_Value"]


@pytest.mark.parametrize("name", ["tree", "forest", "huber", "isotonic", "svr"])
def test_other_models_with_odd_names(spark, frame, name):
    params = {"forest": {"n_estimators": 3, "max_depth": 3}, "svr": {"kernel": "linear"}}.get(name, {})
    fm = MP.fit(frame, ["a.b", "a b"], "y.z", name, **params)
    assert fm.transform(frame).where("prediction is null").count() == 0


@pytest.mark.parametrize("scale", [True, False])
def test_vector_features(spark, frame, scale):
    from pyspark.ml.functions import array_to_vector

    df = frame.select(array_to_vector(F.array("`a.b`", "`a b`")).alias("v.1"), F.col("`a/b`").alias("x"), F.col("`y.z`").alias("y"), "id")
    fm = MP.fit(df, ["v.1", "x"], "y", "ridge", scale=scale, alpha=2.0)
    part = X[:, :3]
    z = (part - part.mean(0)) / (part.std(0) if scale else 1)
    w = np.linalg.solve(z.T @ z + 2.0 * np.eye(3), z.T @ (Y - Y.mean()))
    got = [r.prediction for r in fm.transform(df).orderBy("id").select("prediction").collect()]
    assert np.allclose(got, Y.mean() + z @ w, rtol=1e-7)
    assert MP.fit(df, ["v.1", "x"], "y", "tree", scale=scale).transform(df).where("prediction is null").count() == 0


def test_constant_collinear_and_missing(spark):
    rows = [(float(i), 2.0 * i, 7.0, 3.0 * i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    got = [r.prediction for r in MP.fit(df, ["a", "b", "c"], "y", "linear").transform(df).orderBy("a").collect()]
    assert np.allclose(got, [r[3] for r in rows])
    with pytest.raises(ValueError, match="2 rows"):
        MP.fit(df.withColumn("a", F.when(F.col("a") < 2, None).otherwise(F.col("a"))), ["a"], "y")
    with pytest.raises(ValueError, match="no complete rows"):
        MP.fit(df.limit(0), ["a"], "y")


def test_folds_equal_fits_of_their_own(spark, frame):
    """CV and grid search read the data once and agree with a fit for each fold."""
    folds = FoldMoments(frame, COLS, "y.z", ["id"], 4)
    from quarry.models.metrics import evaluate
    from quarry.models.prep import fold_column

    d = frame.withColumn("_f", fold_column(["id"], 4, "_f"))
    for name, params in (("linear", {}), ("ridge", {"alpha": 3.0}), ("bayesian_ridge", {}), ("lasso", {"alpha": 0.2})):
        got = {r["fold"]: r for r in folds.metrics(name, params)}
        for k in range(4):
            fm = MP.fit(d.where(F.col("_f") != k), COLS, "y.z", name, **params)
            want = evaluate(fm.transform(d.where(F.col("_f") == k)), "y.z").first()
            assert got[k]["n"] == want.n and np.isclose(got[k]["r2"], want.r2, atol=1e-7) and np.isclose(got[k]["mse"], want.mse, rtol=1e-6)
    cv = cross_validate(frame, COLS, "y.z", "ridge", ["id"], 4, alpha=3.0).orderBy("fold").collect()
    assert [r.fold for r in cv] == [0, 1, 2, 3]
    fm, best, top, res = grid_search(frame, COLS, "y.z", "ridge", {"alpha": [0.01, 1e4]}, ["id"], 4)
    assert best == {"alpha": 0.01} and res.count() == 2 and fm.n_train == 400


def test_fit_is_one_scan(spark, frame, tmp_path):
    """The plan behind the moments reads its source once and shuffles one row a partition and fold."""
    path = str(tmp_path / "t")
    frame.select(F.col("`a.b`").alias("a"), F.col("`y.z`").alias("y"), "id").write.parquet(path)
    stored = spark.read.parquet(path)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-scan", "grid search")
    grid_search(stored, ["a"], "y", "elasticnet", {"alpha": [0.1, 1.0, 5.0], "l1_ratio": [0.1, 0.9]}, ["id"], 5)
    spark.sparkContext.setJobGroup("others", "")
    assert len(jobs.getJobIdsForGroup("one-scan")) <= 2  # the scan and the sum, for 30 fits and the refit


def test_label_dictionary_of_any_size(spark, tmp_path, monkeypatch):
    n = 20_000
    df = spark.range(n).select(F.concat(F.lit("k"), F.lpad("id", 6, "0")).alias("c.1"), (F.col("id") * 2.0).alias("y"), "id")
    fm = MP.fit(df, ["c.1"], "y", "linear")
    assert "k000007" not in str(fm.pipeline.stages[0].extractParamMap())
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    reg.save(fm, "labels")
    back = reg.load("labels")
    new = spark.createDataFrame([("k000100", 1), ("k019999", 2), ("zzz", 3), (None, 4)], "`c.1` string, id long")
    for broadcast in (None, 0):
        if broadcast is not None:
            monkeypatch.setattr("quarry.models.dictionary.BROADCAST_BYTES", broadcast)
        got = {r.id: r.Predicted_Value for r in score(back, new).collect()}
        assert np.allclose([got[i] for i in (1, 2, 3, 4)], [200, 2 * 19_999, 0, 0], atol=1e-6)
    # a string target: all labels decode, none of them in the plan
    t = spark.range(3000).select((F.col("id") * 1.0).alias("x"), F.concat(F.lit("label"), F.lpad("id", 5, "0")).alias("t"))
    ft = MP.fit(t, ["x"], "t", "linear")
    reg.save(ft, "target")
    out = score(reg.load("target"), t.where("x in (0, 1500, 2999)"))
    assert [r.Predicted_Value for r in out.orderBy("x").collect()] == ["label00000", "label01500", "label02999"]
    assert "label01500" not in out._jdf.queryExecution().toString() and "target_labels" not in ft.params


def pav(x, y):
    """Pool adjacent violators in memory: fitted value of each distinct x."""
    at, which = np.unique(x, return_inverse=True)
    w = np.bincount(which).astype(float)
    s = np.bincount(which, y)
    out = []
    for a, b in zip(w, s, strict=True):
        block = [a, b, 1]
        while out and out[-1][1] / out[-1][0] > block[1] / block[0]:
            last = out.pop()
            block = [last[0] + block[0], last[1] + block[1], last[2] + block[2]]
        out.append(block)
    return at, np.concatenate([[b / a] * n for a, b, n in out])


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "first is huge", "last is tiny", "saw"])
@pytest.mark.parametrize("run", [7, 1 << 20])
def test_isotonic_over_many_cuts(spark, shape, run):
    n = 500
    x = RNG.permutation(np.repeat(np.arange(n // 2), 2)).astype(float) / 3
    noise = RNG.normal(size=n)
    y = {"noise": x / 20 + noise, "rising": x, "falling": -x, "first is huge": np.where(x == 0, 1e6, x), "last is tiny": np.where(x == x.max(), -1e6, x),
         "saw": x % 11 + x / 50}[shape]
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1.0), (1.0, None), (float("nan"), 2.0)], "x double, y double")
    got = isotonic.blocks(df, F.col("x"), F.col("y"), run).select("lo", "hi", (F.col("s") / F.col("w")).alias("v")).orderBy("lo").collect()
    at, want = pav(x, y)
    value = {a: r.v for r in got for a in at[(at >= r.lo) & (at <= r.hi)]}
    assert np.allclose([value[a] for a in at], want) and all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("broadcast", [True, False])
def test_isotonic_model_interpolates(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(isotonic, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(isotonic, "STRETCH", 4)
    x = np.sort(RNG.uniform(0, 100, 300))
    y = x + RNG.normal(size=300) * 5
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    fm = MP.fit(df, ["x"], "y", "isotonic", scale=False)
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    reg.save(fm, "iso")
    at, want = pav(x, y)
    asked = np.concatenate([[-5.0, 105.0, at[0], at[-1]], RNG.uniform(0, 100, 100)])
    new = spark.createDataFrame([(float(v), 1) for v in asked] + [(None, 2)], "x double, k int")
    got = {r.x: r.prediction for r in reg.load("iso").transform(new).collect()}
    assert np.allclose([got[v] for v in asked], np.interp(asked, at, want)) and got[None] is None


def test_huber_penalty_is_that_of_the_sum(spark):
    """The fit minimises sum(s + H((y − Xw − b)/s)·s) + alpha·|w|² over w, b and s, H quadratic up to epsilon."""
    x = RNG.normal(size=80)
    y = 3 * x + RNG.standard_t(2, 80)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double").coalesce(1)
    z = (x - x.mean()) / x.std()

    def loss(w, b, s, alpha, eps=1.35):
        r = np.abs(y - z * w - b) / s
        return (s + np.where(r < eps, r * r, 2 * eps * r - eps * eps) * s).sum() + alpha * w * w

    for alpha in (0.0001, 20.0):
        fm = MP.fit(df, ["x"], "y", "huber", alpha=alpha)
        last = fm.pipeline.stages[-1]
        w, b, s = last.coefficients[0], last.intercept, last.scale
        best = loss(w, b, s, alpha)
        for dw, db, ds in [(1e-2, 0, 0), (-1e-2, 0, 0), (0, 1e-2, 0), (0, -1e-2, 0), (0, 0, 1e-2), (0, 0, -1e-2)]:
            assert loss(w + dw, b + db, s + ds, alpha) > best
