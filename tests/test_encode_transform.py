
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import encode as E
from quarry.operators import transform as T


def test_label_encode_nan_category_and_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("B",), ("a",)], "s string")
    out, d = E.label_encode(df, ["s"])
    codes = dict((r["value"], r["code"]) for r in d["s"].collect())
    assert codes == {"B": 0, "a": 1, "b": 2, "nan": 3}  # code-point order; missing → 'nan'
    assert sorted(r["s"] for r in out.collect()) == [0, 1, 1, 2, 3]


def test_dictionary_offsets_across_partitions(spark):
    df = spark.range(5000).select(F.format_string("k%05d", (F.col("id") * 7919) % 5000).alias("k")).repartition(13)
    d = E.build_dictionary(df, "k").collect()
    got = sorted((r["value"], r["code"]) for r in d)
    assert [c for _, c in got] == list(range(5000))


def test_one_hot_drop_first_and_level_guard(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "c string, v int")
    out, info = E.one_hot(df, ["c"])
    assert out.columns == ["v", "c_y"] and info == {"c": ["c_y"]}
    assert [r["c_y"] for r in out.orderBy("v").collect()] == [False, True, False]
    many = spark.range(30).select(F.col("id").cast("string").alias("c"))
    with pytest.warns(UserWarning):
        out2, _ = E.one_hot(many, ["c"])
    assert out2.columns == ["c"]


def test_apply_dictionary_unknown(spark):
    train = spark.createDataFrame([("a",), ("b",)], "s string")
    d = E.build_dictionary(train, "s")
    new = spark.createDataFrame([("b",), ("zzz",)], "s string")
    assert [r["s"] for r in E.apply_dictionary(new, "s", d, "zero").collect()] == [1, 0]
    with pytest.raises(Exception):
        E.apply_dictionary(new, "s", d, "error").collect()


def test_scalers_constant_and_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (10.0, 5.0), (None, 5.0)], "x double, c double")
    st, _ = T.scale(df, None, "standard")
    xs = [r["x"] for r in st.collect()]
    v = np.array([1, 2, 4, 10.0])
    assert np.allclose(xs[:4], (v - v.mean()) / v.std()) and xs[4] is None
    assert {r["c"] for r in st.collect()} == {0.0}
    mm, _ = T.scale(df, None, "minmax")
    assert [r["x"] for r in mm.collect()][:4] == [0.0, 1 / 9, 3 / 9, 1.0]
    rb, _ = T.scale(df, None, "robust")
    assert np.allclose([r["x"] for r in rb.collect()][:4], (v - 3.0) / 3.75)
    assert {r["c"] for r in rb.collect()} == {0.0}
    with pytest.raises(ValueError):
        T.scale(df, None, "bogus")


def test_deskew_gates_and_methods(spark):
    vals = [0.5, 1.0, 1.0, 2.0, 3.0, 50.0]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(vals)], "x double, flat double")
    out, info = T.deskew(df, None, "log")
    assert [r["column"] for r in info.collect()] == ["x"]
    assert np.allclose([r["x"] for r in out.collect()], np.log(vals))
    neg = spark.createDataFrame([(v - 1.0,) for v in vals], "x double")
    out, _ = T.deskew(neg, None, "log")
    assert np.allclose([r["x"] for r in out.collect()], np.log1p(np.array(vals) - 1.0 - (-0.5)))
    with pytest.warns(UserWarning):
        out, info = T.deskew(neg, None, "sqrt")
    assert info.count() == 0


def test_boxcox_lambda_matches_likelihood_grid(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(0.0, 0.6, 2000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = T.boxcox_lambda(df, "x")

    def llf(l):
        y = np.log(x) if abs(l) < 1e-12 else (x ** l - 1) / l
        return (l - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())

    grid = np.linspace(-2, 2, 40001)
    best = grid[np.argmax([llf(l) for l in grid])]
    assert abs(lam - best) < 1e-3


def test_few_classes_are_not_dealt_by_class(spark, tmp_path):
    """Two values in a million rows: no task gets all rows of one."""
    from quarry.plans import REGISTRY

    spark.createDataFrame([(i, 1, None if i % 10 == 9 else "FO"[i % 2]) for i in range(40)], "l_orderkey long, l_linenumber int, l_linestatus string").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a table too large to be sent by itself
    try:
        got = REGISTRY["decode_prediction"].fn(spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted((r.l_orderkey, r.prediction, r.label) for r in got.collect()) == [
        (i, (0.2, 0.9)["FO"[i % 2] == "O"], "FO"[i % 2]) for i in range(40) if i % 10 != 9]
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
