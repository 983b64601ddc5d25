"""Cross-validation (M17), automatic model selection (M18) and grid search.

Folds come from a hash of the row key (deterministic, engine-independent, recomputable after
an executor loss). Linear models of any penalty share one scan: the moments of every fold
(``models.gram``), from which each training part, each parameter and each test metric follow without
the data. Other (candidate, fold) fits are ordinary distributed Spark ML fits; up to
``parallelism`` of them run concurrently from driver threads, as CrossValidator does. One fit
per fold yields both R² and MSE (the reference fitted twice). Results are returned as
DataFrames of (candidate, fold, metric) rows.
"""

from __future__ import annotations

import itertools
import json
import statistics
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.models import gram
from quarry.models import pipeline as MP
from quarry.models.metrics import evaluate
from quarry.models.prep import fold_column

# fixed values: the reference's auto-select candidates and their hyper-parameters
AUTO_CANDIDATES = [
    ("Linear Regression", "linear", {}),
    ("Ridge Regression", "ridge", {"alpha": 1.0}),
    ("Lasso Regression", "lasso", {"alpha": 1.0}),
    ("Decision Tree", "tree", {"max_depth": 5}),
    ("Random Forest", "forest", {"n_estimators": 30, "max_depth": 10}),
    ("SVR", "svr", {"kernel": "rbf", "C": 1.0}),
    ("K-Nearest Neighbors", "knn", {"n_neighbors": 5}),
    ("XGBoost", "xgboost", {"n_estimators": 30, "max_depth": 3}),
    ("LightGBM", "lightgbm", {"n_estimators": 30, "num_leaves": 15}),
]


def _with_folds(df: DataFrame, key_cols: Sequence[str], folds: int) -> DataFrame:
    return df.withColumn("_fold", fold_column(key_cols, folds, "_fold")).cache()


def _fold_metrics(d: DataFrame, features, target, model, fold, poly_degree, params):
    train, test = d.filter(F.col("_fold") != fold), d.filter(F.col("_fold") == fold)
    fm = MP.fit(train.drop("_fold"), features, target, model, poly_degree=poly_degree, **params)
    r = evaluate(fm.transform(test.drop("_fold")), target).first()
    return {"fold": fold, "r2": r["r2"], "mse": r["mse"], "n": r["n"]}


class FoldMoments:
    """Moments of every fold, from one scan; string features are encoded with one dictionary, as the reference does."""

    def __init__(self, df: DataFrame, features, target, key_cols, folds: int, poly_degree: int | None = None):
        fold = fold_column(key_cols, folds, "_fold")
        self.enc = MP.encode(df.withColumn("quarry_fold", fold), features, target, poly_degree, keep=["quarry_fold"])
        self.parts = MP.linear_moments(self.enc, F.col("quarry_fold"))
        self.total, self.folds = gram.total_of(self.parts), folds

    def metrics(self, name: str, params: dict) -> list[dict]:
        """One row a fold: fitted on the others, tested on it."""
        p, out = {**MP.DEFAULTS[name], **params}, []
        for k in range(self.folds):
            part = self.parts.get(k)
            if part is None:
                out.append({"fold": k, "n": 0, "r2": None, "mse": None})
                continue
            rest = gram.without(self.total, part)
            if not rest.n:
                raise ValueError(f"fold {k} holds every row: nothing is left to fit")
            out.append({"fold": k, **gram.score(gram.solve(name, rest, p), part)})
        return out

    def fit(self, name: str, features, target, params: dict, poly_degree: int | None = None) -> MP.FittedModel:
        """The model on all rows."""
        solved = gram.solve(name, self.total, {**MP.DEFAULTS[name], **params})
        return MP.result(self.enc, MP.linear_pipeline(self.enc, solved), name, features, target, {**params, "poly_degree": poly_degree}, solved.n)


def cv_table(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["fold"], r["n"], r["r2"], r["mse"]) for r in rows], "fold int, n bigint, r2 double, mse double")


def cross_validate(df: DataFrame, features: Sequence[str], target: str, model: str = "linear",
                   key_cols: Sequence[str] = (), folds: int = 5, poly_degree: int | None = None,
                   parallelism: int = 2, **params) -> DataFrame:
    """K-fold CV → rows (fold, n, r2, mse). Summaries: ``cv_summary``. A fold without rows has no metrics."""
    if not key_cols:
        raise ValueError("key_cols are needed to assign folds deterministically")
    name = MP.canonical(model)
    if name in gram.LINEAR_FAMILY:
        degree, rest = MP.degree_of(name, poly_degree, params)
        return cv_table(df.sparkSession, FoldMoments(df, features, target, key_cols, folds, degree).metrics(name, rest))
    d = _with_folds(df, key_cols, folds)
    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            rows = list(ex.map(lambda i: _fold_metrics(d, features, target, model, i, poly_degree, params),
                               range(folds)))
    finally:
        d.unpersist()
    return cv_table(df.sparkSession, rows)


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and population std of R² and MSE over the folds."""
    return cv.agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
                  F.avg("mse").alias("cv_mse_mean"), F.stddev_pop("mse").alias("cv_mse_std"))


def auto_select(df: DataFrame, features: Sequence[str], target: str, key_cols: Sequence[str], folds: int = 3,
                candidates=None, parallelism: int = 2) -> tuple[str, str, dict, DataFrame]:
    """K-fold R² for every candidate; best mean wins; failing candidates are skipped;
    error if none succeeds. Returns (display name, model, params, per-fold results)."""
    cands = candidates or AUTO_CANDIDATES
    linear = [c for c in cands if MP.canonical(c[1]) in gram.LINEAR_FAMILY]
    others = [c for c in cands if c not in linear]
    rows, errors = [], {}
    shared: dict = {}  # one scan for each polynomial degree among the linear candidates
    for label, model, params in linear:
        try:
            name = MP.canonical(model)
            degree, rest = MP.degree_of(name, None, params)
            if degree not in shared:
                shared[degree] = FoldMoments(df, features, target, key_cols, folds, degree)
            rows += [(label, model, json.dumps(params), m["fold"], m["r2"], m["mse"], None) for m in shared[degree].metrics(name, rest)]
        except Exception as e:  # noqa: BLE001 — a failing candidate is skipped, like the reference
            errors[label] = f"{type(e).__name__}: {e}"[:300]
            rows += [(label, model, json.dumps(params), k, None, None, errors[label]) for k in range(folds)]
    d = _with_folds(df, key_cols, folds)

    def run(task):
        (label, model, params), fold = task
        try:
            m = _fold_metrics(d, features, target, model, fold, None, params)
            return (label, model, json.dumps(params), fold, m["r2"], m["mse"], None)
        except Exception as e:  # noqa: BLE001 — a failing candidate is skipped, like the reference
            return (label, model, json.dumps(params), fold, None, None, f"{type(e).__name__}: {e}"[:300])

    try:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            for r in ex.map(run, list(itertools.product(others, range(folds)))):
                if r[-1]:
                    errors[r[0]] = r[-1]
                rows.append(r)
    finally:
        d.unpersist()
    res = df.sparkSession.createDataFrame(
        rows, "candidate string, model string, params string, fold int, r2 double, mse double, error string")
    ok = {}
    for label, model, params, _fold, r2, _mse, err in rows:
        if label in errors:
            continue
        ok.setdefault((label, model, params), []).append(r2 if r2 is not None else float("-inf"))
    if not ok:
        raise RuntimeError(f"no candidate model could be trained: {errors}")
    # of equal means the one named first, as in the grid search
    place = {c[0]: i for i, c in enumerate(cands)}
    (label, model, params), _ = max(ok.items(), key=lambda kv: (statistics.fmean(kv[1]), -place[kv[0][0]]))
    return label, model, json.loads(params), res


def rank_candidates(results: DataFrame) -> DataFrame:
    """Mean R² per candidate, best first (failures excluded)."""
    failed = results.filter(F.col("error").isNotNull()).select("candidate").distinct()
    return (results.join(failed, "candidate", "left_anti").groupBy("candidate", "model")
            .agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"))
            .orderBy(F.desc("mean_r2"), "candidate"))


def grid_search(df: DataFrame, features: Sequence[str], target: str, model: str, grid: dict[str, list],
                key_cols: Sequence[str], folds: int = 5, metric: str = "r2", parallelism: int = 2):
    """Every combination × k folds; the best mean score is refit on all of ``df``.
    Returns (FittedModel, best params, best score, per-combination results DataFrame)."""
    keys = sorted(grid)
    combos = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    name, shared = MP.canonical(model), {}
    if name in gram.LINEAR_FAMILY:
        out = []
        for ci, combo in enumerate(combos):
            degree, rest = MP.degree_of(name, None, combo)
            if degree not in shared:
                shared[degree] = FoldMoments(df, features, target, key_cols, folds, degree)
            out += [(ci, m["fold"], m) for m in shared[degree].metrics(name, rest)]
    else:
        d = _with_folds(df, key_cols, folds)
        try:
            with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
                out = list(ex.map(lambda t: (t[0], t[1], _fold_metrics(d, features, target, model, t[1], None, combos[t[0]])),
                                  list(itertools.product(range(len(combos)), range(folds)))))
        finally:
            d.unpersist()
    scores: dict[int, list[float]] = {}
    for ci, _f, m in out:
        v = m[metric]
        if m["n"]:  # a fold without rows says nothing
            scores.setdefault(ci, []).append(float("-inf") if v is None else -v if metric == "mse" else v)
    best = max(scores, key=lambda ci: statistics.fmean(scores[ci]))
    best_score = statistics.fmean(scores[best])
    res = df.sparkSession.createDataFrame(
        [(json.dumps(combos[ci]), statistics.fmean(v)) for ci, v in scores.items()], "params string, mean_score double")
    if shared:
        degree, rest = MP.degree_of(name, None, combos[best])
        fm = shared[degree].fit(name, features, target, rest, degree)
    else:
        fm = MP.fit(df, features, target, model, **combos[best])
    return fm, combos[best], (-best_score if metric == "mse" else best_score), res
