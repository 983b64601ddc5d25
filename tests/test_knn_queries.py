"""kNN: equal queries are asked once, candidates of many partitions are merged in turns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import knn
from quarry.models import pipeline as MP


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_equal_queries_are_asked_once(spark, monkeypatch, weights):
    asked, search = [], knn.knn_candidates

    def counted(q, t, k, p, rows):
        asked.append(q.count())
        return search(q, t, k, p, rows)

    monkeypatch.setattr(knn, "knn_candidates", counted)
    train = spark.createDataFrame([(i, float(i % 20), float(i)) for i in range(60)], "id long, x double, y double")
    fm = MP.fit(train, ["x"], "y", "knn", n_neighbors=3, weights=weights, id_col="id", scale=False)
    q = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 8 + 0.25).alias("x"), F.lit("kept").alias("z"))
    got = fm.transform(q).collect()
    assert asked == [8] and len(got) == 400 and {r["z"] for r in got} == {"kept"}  # 400 before
    X, y = np.array([i % 20 for i in range(60)], float), np.arange(60.0)
    for r in got:
        d = np.abs(X - r["x"])
        near = sorted(range(60), key=lambda j: (d[j], j))[:3]
        w = np.ones(3) if weights == "uniform" else 1 / d[near]
        assert r["prediction"] == pytest.approx((w @ y[near]) / w.sum())


def test_candidates_are_merged_in_turns(spark, monkeypatch):
    T = np.random.default_rng(3).normal(size=(200, 2))
    tr = spark.createDataFrame([(i, [float(v) for v in T[i]], float(i)) for i in range(200)], "tid long, x array<double>, y double")
    q = tr.where("tid < 9").select(F.col("tid").alias("qid"), "x")
    whole = sorted(map(tuple, knn.knn_candidates(q, tr, 4, block_rows=5).collect()))
    monkeypatch.setattr(knn, "MERGE_FANIN", 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)  # many partitions of training blocks
    try:
        turns = knn.knn_candidates(q, tr, 4, block_rows=5)
        assert sorted(map(tuple, turns.collect())) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
