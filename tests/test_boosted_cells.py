"""Boosted trees are fitted on cells of bins, with the trees of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from quarry.models import pipeline as MP
from quarry.models.metrics import evaluate


@pytest.fixture
def seen(monkeypatch):
    """How many rows each boosted fit is given."""
    counts, fit = [], GBTRegressor._fit

    def counted(self, df):
        counts.append(df.count())
        return fit(self, df)

    monkeypatch.setattr(GBTRegressor, "_fit", counted)
    return counts


@pytest.mark.parametrize("model,params", [("xgboost", {"max_depth": 3}), ("lightgbm", {"num_leaves": 15})])
def test_cells_give_the_trees_of_all_rows(spark, monkeypatch, seen, model, params):
    df = spark.range(0, 6000, 1, 4).selectExpr("id", "cast(id % 13 as double) as a", "cast((id * 7) % 11 as int) as `b.c`",
                                                "cast(id % 13 as double) * 3 + pow((id * 7) % 11, 2) + (id % 97) / 50 as y")
    one = MP.fit(df, ["a", "b.c"], "y", model, n_estimators=6, **params)
    assert seen == [13 * 11] and one.n_train == 6000  # 6,000 rows before
    monkeypatch.setattr(MP, "BOOSTED", ())
    all_rows = MP.fit(df, ["a", "b.c"], "y", model, n_estimators=6, **params)
    got, exp = (np.array([r["prediction"] for r in m.transform(df).orderBy("id").collect()]) for m in (one, all_rows))
    assert seen[1] == 6000 and np.allclose(got, exp, rtol=1e-9)
    assert np.allclose([v for _, v in MP.importances(one)], [v for _, v in MP.importances(all_rows)], atol=1e-9)


def test_many_values_are_cut_at_quantiles(spark, seen, tmpdir_path):
    from pyspark.ml import PipelineModel

    df = spark.range(0, 4000, 1, 4).select("id", F.sqrt("id").alias("a"), (F.col("id") % 3).alias("b")).withColumn("y", F.col("a") * 2 + F.col("b"))
    fm = MP.fit(df, ["a", "b"], "y", "gbt", n_estimators=20, max_bins=32)
    assert len(seen) == 1 and 3 * 28 <= seen[0] <= 3 * 32
    assert evaluate(fm.transform(df), "y").first()["r2"] > 0.95
    fm.pipeline.save(f"{tmpdir_path}/m")
    again = PipelineModel.load(f"{tmpdir_path}/m").transform(df).orderBy("id").select("prediction").collect()
    assert again == fm.transform(df).orderBy("id").select("prediction").collect()


def test_few_rows_a_cell_or_missing_values_are_fitted_as_they_are(spark, seen):
    df = spark.range(0, 300, 1, 2).select(F.sqrt("id").alias("a"), F.col("id").cast("double").alias("y"))
    MP.fit(df, ["a"], "y", "gbt", n_estimators=2)
    assert seen == [300]
    bad = spark.range(0, 300, 1, 2).select((F.col("id") % 3).alias("a"), F.when(F.col("id") > 0, F.col("id").cast("double")).alias("y"))
    with pytest.raises(Exception, match="[Ll]abel"):
        MP.fit(bad, ["a"], "y", "gbt", n_estimators=2)
