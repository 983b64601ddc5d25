import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 11 and df.columns[0] == "column"


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


@pytest.mark.parametrize("name", ["profile_lineitem", "impute_median", "hist_fd", "pie_other", "label_encode",
                                  "scale_robust", "box_stats", "ridge_1f", "knn_exact"])
def test_oracle_small(spark, name):
    from tools.check_oracle import _rows

    con = duckdb.connect()
    for t in E.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a = _rows(E.queries()[name](spark, SF).toPandas())
    b = _rows(con.execute(E.oracle_sql()[name]).df())
    assert a == b


def test_facades_expose_the_proposed_names(spark):
    from quarry import charts, clean, io, ml

    df = io.load(spark, f"{SF}/orders.parquet")
    prof = clean.profile(df.select("o_totalprice", "o_orderpriority"))
    assert prof.count() == 2
    h = charts.histogram(df, "o_totalprice", "sturges")
    assert h.agg({"count": "sum"}).first()[0] == df.count()
    assert callable(ml.train) and callable(ml.score_stream) and callable(clean.Workspace)
