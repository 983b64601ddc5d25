import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import profile as P


def test_profile_fixture_values(spark):
    df = spark.createDataFrame(
        [(1.0, "b", 5.0, "x" * 60), (2.0, "a", 5.0, "y"), (4.0, "b", 5.0, "x" * 60), (10.0, "a", 5.0, "z"),
         (None, None, 5.0, None)],
        "x double, s string, c double, t string")
    rows = {r["column"]: r for r in P.profile(df).collect()}
    x = rows["x"]
    assert (x["count"], x["null_count"], x["null_pct"]) == (4, 1, 20.0)
    assert x["mean"] == 4.25 and x["median"] == 3.0 and x["q25"] == 1.75 and x["q75"] == 5.5
    assert math.isclose(x["std"], 4.031129, rel_tol=1e-6)
    assert math.isclose(x["skewness"], 1.469335, rel_tol=1e-6)
    assert x["top"] is None and x["unique"] is None
    s = rows["s"]
    assert (s["top"], s["freq_top"], s["unique"]) == ("a", 2, 2)  # ties → smallest
    assert rows["c"]["skewness"] is None  # constant column: N/A
    assert rows["t"]["top"] == "x" * 50 + "..."
    assert [r["column"] for r in P.profile(df).collect()] == ["x", "s", "c", "t"]


def test_correlation_guards_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.1, 3.0), (3.0, 6.2, 3.0), (None, 1.0, 3.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "b")] == pytest.approx(got[("b", "a")])
    assert got[("a", "b")] > 0.99
    assert got[("a", "c")] is None and got[("c", "c")] is None
    with pytest.raises(ValueError):
        P.correlation_matrix(df.select("a"))


def test_null_share_value_counts_shape(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (3, None)], "n long, s string")
    ns = {r["column"]: (r["null_count"], round(r["null_pct"], 2)) for r in P.null_share(df).collect()}
    assert ns == {"n": (1, 33.33), "s": (1, 33.33)}
    vc = P.value_counts(df, "s").collect()
    assert [(r["s"], r["count"]) for r in vc] == [("a", 2)]
    assert P.shape(df).first().asDict() == {"rows": 3, "columns": 2}


def test_profile_mixed_types_b5(spark):
    import datetime as dt

    rows = []
    for i in range(100):
        rows.append((
            float(i) if i % 10 else float("nan"),       # numeric with NaN
            i,                                           # int
            None if i % 7 == 0 else f"s{i % 3}",         # string with missing
            (i % 2 == 0) if i % 5 else None,             # nullable boolean
            dt.datetime(2024, 1, 1) + dt.timedelta(days=i),
            None,                                        # all missing
            "only" if i == 0 else None,                  # one value in 100
        ))
    df = spark.createDataFrame(rows, "num double, i long, s string, b boolean, ts timestamp, allnan double, one string")
    got = {r["column"]: r for r in P.profile(df).collect()}
    assert got["num"]["count"] == 90 and got["num"]["null_count"] == 10
    assert got["b"]["top"] == "false" and got["b"]["unique"] == 2 and got["b"]["mean"] is None
    assert got["ts"]["first"].startswith("2024-01-01") and got["ts"]["last"].startswith("2024-04-09")
    assert got["allnan"]["count"] == 0 and got["allnan"]["null_pct"] == 100.0 and got["allnan"]["median"] is None
    assert (got["one"]["count"], got["one"]["unique"], got["one"]["top"]) == (1, 1, "only")
    assert got["i"]["skewness"] == pytest.approx(0.0, abs=1e-12)


def test_profile_of_long_and_distinct_text(spark):
    """No text longer than what is shown is shuffled; ties, long common beginnings and nulls as for short ones."""
    same = "a" * 60
    rows = [(same + str(i % 3), f"k{i}", None, "") for i in range(30)] + [(same + "1", "zz", None, None), (None, "zz", None, "b")]
    df = spark.createDataFrame(rows, "`long.text` string, k string, none string, s string")
    got = {r.column: r for r in P.profile(df).collect()}
    assert (got["long.text"].top, got["long.text"].freq_top, got["long.text"].unique, got["long.text"]["count"]) == ("a" * 50 + "...", 11, 3, 31)
    assert (got["k"].top, got["k"].freq_top, got["k"].unique) == ("zz", 2, 31)
    assert (got["none"].top, got["none"]["count"], got["none"].unique) == (None, 0, 0)
    assert (got["s"].top, got["s"].freq_top, got["s"].null_count) == ("", 30, 1)
    near = {r.column: r for r in P.profile(df, exact=False).collect()}
    assert (near["long.text"].top, near["long.text"].freq_top, near["k"].top, near["none"].top) == ("a" * 50 + "...", 11, "zz", None)
    assert abs(near["k"].unique - 31) <= 2


def test_sketch_of_rare_values_names_one(spark):
    """So many values, each met once, that the frequent-items sketch names none."""
    df = spark.range(60_000).select(F.format_string("name-%07d", "id").alias("s"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    rows = {r["column"]: r for r in P.profile(df, exact=False).collect()}
    assert rows["s"]["top"] == "name-0000000" and rows["s"]["freq_top"] == 1
    assert rows["d"]["top"] == "1900-01-01" and rows["d"]["first"] == "1900-01-01" and rows["d"]["freq_top"] == 1
    for r in rows.values():
        assert r["count"] == 60_000 and abs(r["unique"] - 60_000) <= 3 * P.SKETCH_RSD * 60_000
