"""SVR: converged, the same for any partitions, equal to a nested search on one feature."""

import warnings

import numpy as np
import pytest

from quarry.models import pipeline as MP
from quarry.models.metrics import evaluate

RNG = np.random.default_rng(11)


def objective(z, y, w, b, C, eps):
    return 0.5 * np.sum(np.square(w)) + C * np.maximum(np.abs(y - z @ w - b) - eps, 0).sum()


def golden(f, lo, hi, rounds=90):
    r = (5 ** 0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return min(fa, fb)


@pytest.mark.parametrize("C,eps", [(1.0, 0.1), (0.01, 0.5), (50.0, 0.0)])
def test_linear_svr_reaches_the_optimum(spark, C, eps):
    x = RNG.normal(3, 2, 120)
    y = 2 * x - 1 + RNG.standard_t(2, 120)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double").coalesce(1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        fm = MP.fit(df, ["x"], "y", "svr", kernel="linear", C=C, epsilon=eps)
    z = ((x - x.mean()) / x.std())[:, None]
    form = fm.pipeline.stages[-1]
    got = objective(z, y, form.getOrDefault(form.coefficients), form.getOrDefault(form.intercept), C, eps)
    best = golden(lambda w: golden(lambda b: objective(z, y, np.array([w]), b, C, eps), -40, 40), -40, 40)
    assert got <= best * (1 + 1e-3) + 1e-9


@pytest.mark.parametrize("kernel", ["linear", "rbf"])
def test_partitions_do_not_matter(spark, kernel):
    x = RNG.uniform(-3, 3, (600, 2))
    y = np.sin(x[:, 0]) * 3 + x[:, 1] + RNG.normal(0, 0.1, 600)
    df = spark.createDataFrame([(*map(float, r), float(v), i) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, i int")
    said = []
    for parts in (1, 8, 80):
        fm = MP.fit(df.repartition(parts), ["a", "b"], "y", "svr", kernel=kernel)
        said.append(np.array([r.prediction for r in fm.transform(df).orderBy("i").collect()]))
        if kernel == "rbf":
            assert evaluate(fm.transform(df), "y").first()["r2"] > 0.97
    assert np.allclose(said[0], said[1], atol=1e-3) and np.allclose(said[0], said[2], atol=1e-3)


def test_constant_label_and_few_passes(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "x double, y double")
    assert all(abs(r.prediction - 5) < 0.2 for r in MP.fit(df, ["x"], "y", "svr", kernel="linear").transform(df).collect())
    from pyspark.ml.feature import VectorAssembler

    from quarry.models.custom import SVRegressor

    x = RNG.normal(size=50)
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(v), float(3 * v + RNG.normal())) for v in x], "x double, label double"))
    with pytest.warns(UserWarning, match="duality gap"):
        SVRegressor(kernel="linear", maxIter=2).fit(d)


def test_a_pass_takes_slices_by_the_width_of_its_rows(spark):
    """Many sums of narrow rows: the rows of a step do not shrink with the number of sums."""
    from quarry.models.custom import block_rows, sum_over_rows

    rows = spark.range(0, 5000, 1, 2).selectExpr("array(cast(id as double), 1.0D) as x", "cast(id % 7 as double) as y")
    width = 40_000

    def fn(X, y):
        out = np.zeros(width)
        out[:3] = X[:, 0].sum(), y.sum(), 1
        return out

    s = sum_over_rows(block_rows(rows), fn, width, 200)
    assert s[0] == 5000 * 4999 / 2 and s[1] == sum(i % 7 for i in range(5000))
    assert s[2] <= 20  # 26 rows a step before: some 200 steps


def test_blocks_refuse_vectors_of_several_lengths(spark):
    from quarry.models.custom import block_rows

    rows = spark.createDataFrame([([1.0, 2.0], 1.0), ([3.0], 2.0)], "x array<double>, y double").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        block_rows(rows).collect()
