import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.quantiles import column_quantiles, grouped_mode, grouped_quantiles


def _df(spark, vals, key=None):
    rows = [(float(v) if v is not None else None, key[i] if key else "g") for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "x double, k string")


@pytest.mark.parametrize("final_rows,buckets", [(500_000, 4096), (7, 4), (1, 2)])
def test_exact_matches_numpy_with_refinement(spark, final_rows, buckets):
    rng = np.random.default_rng(0)
    vals = list(rng.normal(size=300)) + [5.0] * 150 + list(rng.integers(0, 5, 100).astype(float))
    df = _df(spark, vals + [None, float("nan")])
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = column_quantiles(df, ["x"], probs, final_rows=final_rows, buckets=buckets)["x"]
    assert np.allclose(got, np.quantile(np.array(vals), probs), atol=1e-12)


def test_hot_value_holding_a_third(spark):
    # one value holds a third of the rows: resolved as a constant interval, never ranked in one task
    vals = [1.0] * 400 + list(np.linspace(-3, 3, 800))
    got = column_quantiles(_df(spark, vals), ["x"], [0.25, 0.5, 0.75], final_rows=10, buckets=8)["x"]
    assert np.allclose(got, np.quantile(vals, [0.25, 0.5, 0.75]))


def test_grouped_and_fixture_quartiles(spark):
    # FIXTURES C: x = 1, 2, 4, 10, NULL → Q1 1.75, median 3, Q3 5.5
    df = _df(spark, [1, 2, 4, 10, None])
    q = column_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    assert q == [1.75, 3.0, 5.5]
    rng = np.random.default_rng(1)
    keys = list(rng.choice(["a", "b", "c"], 500))
    vals = list(rng.exponential(size=500))
    g = grouped_quantiles(_df(spark, vals, keys), ["k"], "x", [0.1, 0.5], final_rows=20, buckets=4).collect()
    for r in g:
        sub = [v for v, k in zip(vals, keys) if k == r["k"]]
        assert abs(np.quantile(sub, r["p"]) - r["q"]) < 1e-12


def test_empty_group_absent_and_approx(spark):
    df = _df(spark, [None, None])
    assert column_quantiles(df, ["x"], [0.5])["x"] == [None]
    q = grouped_quantiles(_df(spark, list(range(100))), [], "x", [0.5], method="approx").first()
    assert abs(q["q"] - 49.5) <= 1.0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string").withColumn("g", F.lit(1))
    m = grouped_mode(df, ["g"], "v").first()
    assert (m["mode"], m["mode_count"], m["n_distinct"]) == ("a", 2, 2)


def test_hot_group_holds_a_third(spark):
    # one group key holds a third of all rows; refinement keeps every window partition bounded
    rng = np.random.default_rng(11)
    keys = ["hot"] * 600 + list(rng.choice(["a", "b", "c", "d"], 1200))
    vals = list(rng.normal(size=1800))
    df = _df(spark, vals, keys)
    got = grouped_quantiles(df, ["k"], "x", [0.05, 0.5, 0.95], final_rows=25, buckets=16, accuracy=50).collect()
    for r in got:
        sub = [v for v, k in zip(vals, keys) if k == r["k"]]
        assert abs(np.quantile(sub, r["p"]) - r["q"]) < 1e-12
    m = grouped_mode(spark.createDataFrame([(k, int(v * 2)) for k, v in zip(keys, vals)], "k string, v long"), ["k"], "v")
    assert m.count() == 5


def test_close_probabilities_share_ranks(spark):
    # p values closer than the bracket width: overlapping brackets, one output row per p
    vals = [float(v) for v in ([2.0] * 50 + list(range(100)))]
    df = _df(spark, vals)
    probs = [0.5, 0.50001, 0.5001, 0.9]
    got = grouped_quantiles(df, [], "x", probs, accuracy=100).collect()
    assert len(got) == len(probs)
    for r in got:
        assert abs(np.quantile(vals, r["p"]) - r["q"]) < 1e-9
