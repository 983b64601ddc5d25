"""Nearest neighbours: slices of any size, ties, hash tables against the exact way, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.models import knn
from quarry.models import pipeline as MP
from quarry.models.registry import ModelRegistry

RNG = np.random.default_rng(5)


def brute(Q, T, k, p):
    out = []
    for i, q in enumerate(Q):
        d = (np.abs(q - T) ** p).sum(1) ** (1 / p)
        out += [(i, int(j)) for j in np.lexsort((np.arange(len(T)), d))[:k]]
    return out


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("budget", [1, 4000, 64 << 20])
def test_nearest_in_slices(monkeypatch, p, budget):
    monkeypatch.setattr(knn, "SLICE_BYTES", budget)
    T = RNG.integers(-3, 4, (150, 3)).astype(float) + 1e6  # many ties, far from zero
    Q = np.concatenate([T[:20], RNG.integers(-3, 4, (30, 3)) + 1e6])
    i, j, dist = knn.nearest(Q, T, 7, p)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == brute(Q, T, 7, p)
    assert np.allclose(dist, (np.abs(Q[i] - T[j]) ** p).sum(1) ** (1 / p))
    assert len(knn.nearest(Q, T[:3], 7, p)[0]) == 3 * len(Q)


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_hash_tables_find_most_and_never_fewer(spark, monkeypatch, p):
    monkeypatch.setattr(knn, "SLICE_ROWS", 50)
    centres = RNG.normal(0, 20, (30, 12))
    T = np.concatenate([centres[RNG.integers(0, 30, 1500)] + RNG.normal(size=(1500, 12)), np.tile(centres[0], (500, 1))])  # a hot bucket
    Q = np.concatenate([centres[RNG.integers(0, 30, 100)] + RNG.normal(size=(100, 12)), centres[:1], [[1e4] * 12]])  # the last meets nothing
    train = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(T)], "tid long, x array<double>, y double").repartition(4)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(Q)], "qid long, x array<double>").repartition(3)
    got = knn.lsh_candidates(asked, train, 5, p).collect()
    assert sorted((r.qid, r["rank"]) for r in got) == [(q, r) for q in range(len(Q)) for r in range(1, 6)]
    pairs, want = {(r.qid, r.tid) for r in got}, set(brute(Q, T, 5, p))
    assert len(pairs & want) / len(want) >= 0.9
    assert {t for q, t in pairs if q == 101} == {t for q, t in want if q == 101}  # by the exact way
    assert all(np.isclose(r.dist, (np.abs(Q[r.qid] - T[r.tid]) ** p).sum() ** (1 / p)) for r in got)


def test_collision_chance(spark):
    for p, draw in ((2, RNG.normal), (1, None)):
        a = RNG.normal(size=200_000) if p == 2 else RNG.standard_cauchy(200_000)
        for u in (0.3, 1.0, 3.0):
            shift = RNG.uniform(0, 4, 200_000)
            seen = (np.floor((a * u + shift) / 4) == np.floor(shift / 4)).mean()
            assert abs(seen - knn.collision(np.array([u]), 4.0, p)[0]) < 0.01


@pytest.mark.parametrize("method", ["exact", "lsh"])
def test_saved_model_holds_its_rows(spark, tmp_path, method):
    df = spark.createDataFrame([(float(i), float(i % 10), i) for i in range(200)], "`a.b` double, y double, id long")
    fm = MP.fit(df, ["a.b"], "y", "knn", id_col="id", n_neighbors=3, method=method)
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    first = reg.save(fm, "knn")
    want = {r["a.b"]: r.prediction for r in fm.transform(df.drop("y")).collect()}
    import shutil

    shutil.rmtree(fm.pipeline.stages[-1].getOrDefault("tablePath"))  # the scratch table goes, the model's own stays
    back = reg.load("knn")
    assert {r["a.b"]: r.prediction for r in back.transform(df.drop("y")).collect()} == want
    # saving again leaves the older version as it was
    version = reg.details("knn")["version"]
    other = MP.fit(df.withColumn("y", F.col("y") + 100), ["a.b"], "y", "knn", id_col="id", n_neighbors=3, method=method)
    second = reg.save(other, "knn")
    assert first != second and reg.versions("knn").count() == 2
    assert {r["a.b"]: r.prediction for r in reg.load("knn", version).transform(df.drop("y")).collect()} == want
    assert all(r.prediction > 99 for r in reg.load("knn").transform(df.drop("y")).collect())
    reg.delete("knn")
    with pytest.raises(KeyError):
        reg.load("knn")
    assert reg.load("knn", version).n_train == 200


def test_rows_are_not_copied_for_the_blocks_of_the_other_side(spark):
    """Close blocks of many rows, ties over block borders, a point that most training rows share, rows far from all."""
    T = np.concatenate([RNG.integers(0, 12, (1200, 2)), np.full((600, 2), 3), [[900, -900]]]).astype(float)
    Q = np.concatenate([RNG.integers(0, 12, (300, 2)), [[1e6, 5], [3, 3]]]).astype(float)
    train = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(T)], "tid long, x array<double>, y double").repartition(3)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(Q)], "qid long, x array<double>")
    for p in (1.0, 2.0, 3.0):
        got = knn.knn_candidates(asked, train, 7, p, block_rows=32)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no explode over blocks
        rows = sorted((r.qid, r["rank"], r.tid, r.y) for r in got.collect())
        want = brute(Q, T, 7, p)
        assert rows == [(q, n % 7 + 1, t, float(t)) for n, (q, t) in enumerate(want)]
    assert knn.knn_candidates(asked, train.limit(3), 7).count() == 3 * len(Q)
    assert knn.knn_candidates(asked.where("false"), train, 7).count() == 0 and knn.knn_candidates(asked, train.where("false"), 7).count() == 0


def test_large_buckets_travel_with_the_tasks(spark, monkeypatch):
    """Hash tables: each copy of a row is shuffled once, to the bucket it meets others in."""
    monkeypatch.setattr(knn, "knn_candidates", lambda q, t, k, p, rows: q.where("false").selectExpr("qid", "0L tid", "0D dist", "0D y", "1 rank"))
    joins = []
    real = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, eager=True: (joins.append(self._jdf.queryExecution().executedPlan().toString()), real(self, eager))[1])
    df = spark.createDataFrame([(i, [float(i % 50), float(i % 7)], 1.0) for i in range(400)], "tid long, x array<double>, y double")
    knn.lsh_candidates(df.selectExpr("tid as qid", "x"), df, 3).count()
    found = next(j for j in joins if "FlatMapCoGroupsInArrow" in j)
    assert "BroadcastHashJoin" in found and "SortMergeJoin" not in found
    assert found.count("Generate") == 2
