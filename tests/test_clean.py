import math

import pytest

from quarry.operators import clean as C
from quarry.operators import outliers as X

# demo cleaning frame (FIXTURES B1): one missing value each in Age/City/Salary, two outliers
B1 = [
    (25.0, "New York", 50000.0, 2, "M"), (30.0, "London", 60000.0, 5, "F"), (None, "Paris", 55000.0, 3, "M"),
    (35.0, None, 65000.0, 7, "F"), (40.0, "New York", None, 10, "M"), (120.0, "London", 70000.0, 8, "F"),
    (28.0, "Paris", 52000.0, 4, "M"), (33.0, "New York", 500000.0, 6, "F"), (45.0, "London", 80000.0, 12, "M"),
    (29.0, "Paris", 54000.0, 3, "F"), (31.0, "New York", 58000.0, 5, "M"),
]
B1_SCHEMA = "Age double, City string, Salary double, Experience bigint, Gender string"


@pytest.fixture
def b1(spark):
    return spark.createDataFrame(B1, B1_SCHEMA)


def test_handle_missing_defaults(b1):
    out = C.handle_missing(b1).collect()
    ages = sorted(r["Age"] for r in out)
    assert 32.0 in ages  # median of the ten present ages
    assert all(r["City"] is not None and r["Salary"] is not None for r in out)
    city = [r["City"] for r in out if r["Age"] == 35.0][0]
    assert city == "New York"  # the mode


def test_drop_col_threshold_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, None, 3.0), (None, None, 4.0)], "a double, b double, c double")
    assert C.drop_columns_by_null_share(df, 0.5).columns == ["a", "c"]
    assert C.drop_all_null_columns(df).columns == ["a", "c"]
    assert C.drop_all_null_columns(df.limit(0)).columns == ["a", "b", "c"]


def test_gui_chain_order(spark):
    # categorical mode is taken AFTER numeric row removal
    df = spark.createDataFrame([(None, "x"), (None, "x"), (None, "x"), (1.0, "y"), (2.0, None)], "n double, s string")
    out = C.gui_clean_missing(df, numeric="Remove Rows with NaN", categorical="Mode").collect()
    assert sorted((r["n"], r["s"]) for r in out) == [(1.0, "y"), (2.0, "y")]


def test_impute_strategies(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, None), (3, 4.0, "b"), (None, 4.0, "b")], "i long, d double, s string")
    mean = C.impute(df, ["i", "d"], "mean").collect()
    assert [r["i"] for r in mean] == [1.0, 2.0, 3.0, 2.0]
    med = C.impute(df, ["d"], "median").collect()
    assert [r["d"] for r in med] == [1.0, 4.0, 4.0, 4.0]
    mode = C.impute(df, ["s"], "mode").collect()
    assert [r["s"] for r in mode] == ["a", "b", "b", "b"]
    const = C.impute(df, ["s"], "constant", "Unknown").collect()
    assert const[1]["s"] == "Unknown"
    # columns without a missing value keep their type
    assert dict(C.impute(df, None, "median").dtypes)["i"] == "double"


def test_duplicates_null_nan_equal(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (float("nan"), "a"), (float("nan"), "a"), (2.0, "b")],
                               "x double, s string")
    assert C.drop_duplicates(df).count() == 3
    assert C.drop_duplicates(df, keep=False).count() == 1
    assert C.duplicate_count(df).first()[0] == 2


def test_sort_nulls_last_stable(spark):
    df = spark.createDataFrame([(3.0, 1), (None, 2), (1.0, 3), (3.0, 4), (float("nan"), 5)], "x double, id int")
    asc = [r["id"] for r in C.sort_stable(df, "x").collect()]
    desc = [r["id"] for r in C.sort_stable(df, "x", ascending=False).collect()]
    assert asc[:3] == [3, 1, 4] and set(asc[3:]) == {2, 5}
    assert desc[:3] == [1, 4, 3] and set(desc[3:]) == {2, 5}


def test_drop_columns_refuses_all(b1):
    with pytest.raises(ValueError):
        C.drop_columns(b1, b1.columns)
    assert C.drop_columns(b1, ["Age", "nope"]).columns == ["City", "Salary", "Experience", "Gender"]


def test_outliers_fixture(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,), (100.0,)], "x double")
    lo, hi = X.iqr_fences(df.filter("x <= 10 OR x IS NULL"), "x")
    assert (lo, hi) == (-3.875, 11.125)
    flags = [r["is_outlier"] for r in X.flag_outliers(df, "x").collect()]
    assert flags[4] is False and flags[5] is True
    capped = [r["x"] for r in X.treat_outliers(df, "x", "cap").collect()]
    assert capped[4] is None and capped[5] == 22.0
    assert X.treat_outliers(df, "x", "remove").count() == 4
    with pytest.raises(ValueError):
        X.treat_outliers(df, "x", "bogus")
    with pytest.warns(UserWarning):
        assert X.treat_outliers(df, "nope").count() == 6


def test_cleaning_demo_chain(b1):
    # missing → dedupe → cap Age → dummies → log Salary → standard scale (the reference's demo)
    from quarry.operators import encode as E
    from quarry.operators import transform as T

    d = C.handle_missing(b1)
    d = C.drop_duplicates(d)
    d = X.treat_outliers(d, "Age", "cap")
    d, info = E.encode(d, ["City", "Gender"], "dummy")
    assert info["City"] == ["City_New York", "City_Paris"] and info["Gender"] == ["Gender_M"]
    d, applied = T.deskew(d, ["Salary"], "log")
    d, stats = T.scale(d)
    r = d.agg({"Experience": "avg"}).first()[0]
    assert math.isclose(r, 0.0, abs_tol=1e-9)


def test_validation_and_feature_selection(b1):
    from quarry.functions.columns import classify, select_type_class, validate_columns

    with pytest.raises(ValueError):
        validate_columns(b1, ["nope"])
    with pytest.raises(TypeError):
        validate_columns(b1, numeric=["City"])
    with pytest.raises(ValueError):
        validate_columns(b1.limit(0), ["Age"], non_empty=True)
    assert select_type_class(b1, "numeric").columns == ["Age", "Salary", "Experience"]
    assert classify(b1.schema)["Gender"] == "categorical"
    with pytest.raises(ValueError):
        C.select_features(b1, ["Age"], "Age")
    assert C.select_features(b1, ["Age", "City"], "Salary").columns == ["Age", "City", "Salary"]
    assert C.target_candidates(b1) == ["Age", "Salary", "Experience"]


def test_workspace_reset_commit(b1):
    from quarry.operators.workspace import Workspace

    ws = Workspace(b1)
    ws.apply(C.handle_missing)
    ws.apply(C.drop_duplicates)
    assert ws.current.count() == 11 and ws.history == ["handle_missing", "drop_duplicates"]
    assert ws.reset().filter("Age IS NULL").count() == 1
    ws.apply(C.drop_rows_with_missing)
    committed = ws.commit()
    assert committed.count() == 8 and ws.reset().count() == 8


def test_gui_cleaner_b4(spark):
    # 25 rows + 3 duplicates, an all-missing column (FIXTURES B4)
    rows = [(i, float(20 + i) if i % 6 else None, "ABC"[i % 3] if i % 8 else None,
             float(1000 * i) if i % 5 else None, i % 4, "XY"[i % 2] if i % 9 else None, None) for i in range(25)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "ID_Col long, Age_Num double, City_Cat string, Salary_Num_Missing double, "
                                     "Experience_Num long, Dept_Cat_Missing string, All_NaN_Col double")
    out = C.gui_clean_missing(df, numeric="Median", categorical="Mode", drop_all_null_cols=True)
    assert "All_NaN_Col" not in out.columns
    assert out.filter("Age_Num IS NULL OR City_Cat IS NULL OR Salary_Num_Missing IS NULL").count() == 0
    assert C.drop_duplicates(out).count() == 25 and C.duplicate_count(out).first()[0] == 3
