import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import charts as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.gamma(2.0, 3.0, 1500)
    cat = rng.choice(list("ABCDEFGHIJ"), 1500, p=[.3, .2, .1, .1, .05, .05, .05, .05, .05, .05])
    df = spark.createDataFrame([(float(a), str(c), int(i)) for i, (a, c) in enumerate(zip(x, cat))],
                               "x double, c string, i long")
    return df, x, cat


@pytest.mark.parametrize("rule", ["fd", "auto", "sturges", "sqrt", "rice", "scott", 15])
def test_histogram_matches_numpy(data, rule):
    df, x, _ = data
    h = V.histogram(df, "x", rule).orderBy("bin").collect()
    counts, edges = np.histogram(x, bins=rule)
    assert len(h) == len(counts)
    assert [r["count"] for r in h] == list(counts)
    assert np.allclose([r["lo"] for r in h], edges[:-1])


def test_histogram_max_in_last_bin_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "x double")
    h = V.histogram(df, "x", 2).orderBy("bin").collect()
    assert [r["count"] for r in h] == [1, 2]
    c = V.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", "fd").collect()
    assert len(c) == 1 and c[0]["lo"] == 2.5 and c[0]["hi"] == 3.5


def test_kde_matches_direct_sum(data):
    df, x, _ = data
    k = V.kde(df, "x").collect()
    h = len(x) ** (-0.2) * x.std(ddof=1)
    g = np.array([r["x"] for r in k])
    dens = np.exp(-0.5 * ((g[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert len(k) == 200 and np.allclose([r["density"] for r in k], dens)
    assert math.isclose(g[0], x.min() - 3 * h)


def test_box_whiskers(data):
    df, x, cat = data
    stats, out = V.box_stats(df, "c", "x")
    for r in stats.collect():
        v = x[cat == r["c"]]
        q1, q3 = np.quantile(v, [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        assert math.isclose(r["whisker_lo"], inside.min()) and math.isclose(r["whisker_hi"], inside.max())
        assert r["n_outliers"] == int(((v < lo) | (v > hi)).sum())
    assert out.count() == sum(r["n_outliers"] for r in stats.collect())


def test_pie_rollup(data):
    df, _, cat = data
    p = V.pie_data(df, "c", max_slices=7).collect()
    assert len(p) == 7 and p[-1]["category"] == "Other (4)"
    counts = sorted(((-(cat == c).sum(), c) for c in set(cat)))
    assert [r["category"] for r in p[:6]] == [c for _, c in counts[:6]]
    assert math.isclose(sum(r["pct"] for r in p), 100.0)
    empty = V.pie_data(df.withColumn("neg", -F.col("x")), "c", "neg")
    assert empty.count() == 0


def test_line_area_bar(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0, "h1"), ("2024-01-01", 3.0, "h2"), ("2024-01-01", 5.0, "h2"),
                                ("bad", 9.0, "h3")], "d string, y double, h string")
    line = V.line_data(df, "d", "y").collect()
    assert [(str(r["d"])[:10], r["y"]) for r in line] == [("2024-01-01", 4.0), ("2024-01-02", 1.0)]
    area = V.area_data(df, "d", "y", hue="h", max_hues=1).collect()
    assert {r["h"] for r in area} == {"h2"}
    bar = V.bar_data(df, "h", "y", estimator="median").collect()
    assert dict((r["h"], r["value"]) for r in bar) == {"h1": 1.0, "h2": 4.0, "h3": 9.0}


def test_pair_data(data):
    df, x, _ = data
    pd_ = V.pair_data(df.select("x", "i", "c"), bins=20, grid_bins=5)
    diag = pd_.filter("col_x = 'x' AND col_y = 'x'").orderBy("bin_x").collect()
    assert [r["count"] for r in diag] == [c for c in np.histogram(x, 20)[0] if c > 0] or sum(r["count"] for r in diag) == len(x)
    cells = pd_.filter("col_x = 'x' AND col_y = 'i'").agg(F.sum("count")).first()[0]
    assert cells == len(x)


def test_kde_prebinned_close_to_exact(data):
    df, x, _ = data
    exact = [r["density"] for r in V.kde(df, "x").collect()]
    approx = [r["density"] for r in V.kde(df, "x", prebin=4096).collect()]
    assert np.max(np.abs(np.array(exact) - np.array(approx))) < 1e-3 * max(exact)


def test_pair_data_with_hue(data):
    df, x, cat = data
    for gb in (20, 5):  # joint-bin path and expand path
        p = V.pair_data(df.select("x", "i", "c"), grid_bins=gb, hue="c")
        assert "c" in p.columns
        per_hue = {r["c"]: r["n"] for r in p.filter("col_x = 'x' AND col_y = 'x'").groupBy("c").agg(
            F.sum("count").alias("n")).collect()}
        assert per_hue == {k: int((cat == k).sum()) for k in set(cat)}


def test_own_estimator_is_summed_before_the_shuffle(spark):
    from quarry.plans import q_charts

    got = q_charts.bar_pandas_udf(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "partial_max" in plan and "partial_min" in plan
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").toPandas()
    want = orders.groupby("o_orderstatus").o_totalprice.agg(lambda y: float(y.max()) - float(y.min()))
    assert {r.o_orderstatus: r.value for r in got.collect()} == pytest.approx(want.to_dict(), abs=1e-3)


# ---------------------------------------------------------------- one scan: kernels, cells, pairwise moments


def test_kde_equals_numpy_and_binning_stays_in_its_bound(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000), rng.normal(8, 0.3, 500)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "`x.y` double").repartition(7)
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    got = V.kde(df, "x.y").toPandas()
    assert np.allclose(got["x"], grid) and np.allclose(got["density"], want, rtol=1e-10)
    for bins in (50, 400):
        delta = (x.max() - x.min()) / (bins - 1)
        near = V.kde(df, "x.y", prebin=bins).toPandas()
        assert np.abs(near["density"] - want).max() <= delta ** 2 / (8 * h ** 3 * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("bins,grid", [(20, 20), (4, 7)])
def test_pair_cells_by_hue(spark, bins, grid):
    rng = np.random.default_rng(4)
    t = rng.normal(size=(400, 3))
    t[rng.random((400, 3)) < 0.1] = np.nan
    hue = [None if i % 9 == 0 else f"h{i % 40}" for i in range(400)]
    rows = [(*[None if np.isnan(v) else float(v) for v in r], h) for r, h in zip(t, hue, strict=True)]
    df = spark.createDataFrame(rows, "`a.b` double, c double, d double, `h.x` string").repartition(3)
    got = {(r.col_x, r.col_y, r.bin_x, r.bin_y, r["h.x"]): r["count"] for r in V.pair_data(df, bins=bins, grid_bins=grid, hue="h.x").collect()}
    names, want = ["a.b", "c", "d"], {}
    lo, hi = np.nanmin(t, 0), np.nanmax(t, 0)

    def place(v, i, k):
        return int(min(np.floor((v - lo[i]) * (k / (hi[i] - lo[i]))), k - 1))

    for r, h in zip(t, hue, strict=True):
        for i in range(3):
            for j in range(3):
                if not np.isnan(r[i]) and not np.isnan(r[j]):
                    key = (names[i], names[j], place(r[i], i, bins if i == j else grid), None if i == j else place(r[j], j, grid), h)
                    want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("tile,parts", [(128, 1), (3, 5), (2, 40)])
def test_correlations_of_masked_columns(spark, tile, parts):
    from quarry.operators.pairwise import correlations

    rng = np.random.default_rng(5)
    t = rng.normal(size=(200, 7)) + [0, 1e8, 0, 0, 0, 0, 0]
    t[:, 2] = t[:, 1] * 2 - 5
    t[:, 3] = 7.1
    t[rng.random(t.shape) < 0.3] = np.nan
    t[:, 5] = np.where(np.isnan(t[:, 4]), 1.5, np.nan)  # no row in common with column 4
    t[0, 6] = np.inf
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in t], ", ".join(f"c{i} double" for i in range(7))).repartition(parts)
    got = {(r.i, r.j): (r.n, r.corr) for r in correlations(df, [F.col(f"c{i}") for i in range(7)], tile).collect()}
    assert len(got) == 49
    for (i, j), (n, r) in got.items():
        both = ~np.isnan(t[:, i]) & ~np.isnan(t[:, j])
        assert n == both.sum()
        if 3 in (i, j) or 6 in (i, j) or 5 in (i, j) or not n:
            assert r is None
        else:
            assert np.isclose(r, np.corrcoef(t[both, i], t[both, j])[0, 1], atol=1e-7)


def test_too_many_bins_are_refused(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(1000)] + [(1e15,)], "x double")
    with pytest.raises(ValueError, match="asks for"):
        V.histogram(df, "x", "fd")
    with pytest.raises(ValueError, match="more than"):
        V.histogram(df, "x", V.MAX_BINS + 1)
    assert V.histogram(df, "x", 10).count() == 10
