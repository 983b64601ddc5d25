"""Fits and predictions compute what rows of equal features share once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


def test_a_block_holds_equal_features_once(spark):
    from quarry.models.custom import block_rows, sum_over_groups, sum_over_rows

    rows = spark.range(0, 20_000, 1, 1).selectExpr("array(cast(id % 8 as double), cast(id % 5 as double)) as x", "cast(id as double) as y")
    blocks = block_rows(rows).cache()
    held = sum(len(r["x"]) for r in blocks.collect())
    assert held == 40 * 2 * 8  # all 20,000 rows of two numbers before
    s = sum_over_groups(blocks, lambda X, n, y: np.array([len(X), n.sum(), y.sum(), X[:, 0] @ np.add.reduceat(y, np.cumsum(n) - n)]), 4)
    assert s.tolist() == [40, 20_000, 19_999 * 10_000, sum((i % 8) * i for i in range(20_000))]
    assert sum_over_rows(blocks, lambda X, y: np.array([X[:, 0] @ y]), 1)[0] == s[3]


def test_rows_without_equals_stay_whole(spark):
    from quarry.models.custom import block_rows, sum_over_rows

    rows = spark.range(0, 3000, 1, 3).select(F.array(F.sqrt("id"), -F.sqrt("id")).alias("x"), F.col("id").cast("double").alias("y"))
    s = sum_over_rows(block_rows(rows), lambda X, y: np.array([len(y), np.abs(X[:, 0] ** 2 - y).max() < 1e-6, (X.sum(1) == 0).all()]), 3)
    assert s[0] == 3000 and s[1] == s[2]


def test_rbf_predictions_of_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    from quarry.models.custom import SVRModel

    omega, phase, w = np.arange(6.0), np.array([0.1, 0.2, 0.3]), np.array([1.0, -2.0, 0.5])
    model = SVRModel(kernel="rbf", omega=omega.tolist(), phase=phase.tolist(), coefficients=w.tolist(), intercept=4.0)
    x = [(0, Vectors.dense(1.0, 2.0)), (2, Vectors.sparse(2, [1], [3.0]))]
    df = spark.createDataFrame(x, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("features", VectorUDT())]))
    got = {r["i"]: r["prediction"] for r in model.transform(df).collect()}
    for i, v in ((0, [1.0, 2.0]), (2, [0.0, 3.0])):
        assert abs(got[i] - (4 + np.sqrt(2 / 3) * np.cos(omega.reshape(3, 2) @ v + phase) @ w)) < 1e-9
