"""The end-to-end training run (the reference's TrainingThread): prepare → split → [auto-select]
→ fit → CV → metrics → importances → run record, plus the report tables (M17–M21, M27, M28,
V13, V14)."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import classify, qcol
from quarry.models import gram
from quarry.models import pipeline as MP
from quarry.models.metrics import evaluate
from quarry.models.prep import prepare, split
from quarry.models.scoring import fit_defaults
from quarry.operators.clean import apply_fill, drop_rows_with_missing, training_fills
from quarry.session import materialize
from quarry.models.selection import FoldMoments, auto_select, cross_validate, cv_summary, cv_table


@dataclass
class TrainResult:
    model: MP.FittedModel
    label: str
    metrics: dict
    cv: DataFrame
    test_predictions: DataFrame
    importances: DataFrame
    selection: DataFrame | None = None


def importance_table(fm: MP.FittedModel, spark, k: int | None = None) -> DataFrame:
    """M20 + O3: (feature, score) ordered by |score| desc, ties by name; top-k if given."""
    df = spark.createDataFrame(MP.importances(fm), "feature string, score double")
    out = df.orderBy(F.abs("score").desc(), "feature")
    return out.limit(k) if k else out


def actual_vs_predicted(pred: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Scored test points and the ideal line from min to max of both columns."""
    pts = pred.select(F.col(target).cast("double").alias("actual"), F.col("prediction").alias("predicted"))
    line = pts.agg(F.least(F.min("actual"), F.min("predicted")).alias("lo"),
                   F.greatest(F.max("actual"), F.max("predicted")).alias("hi"))
    return pts, line


def train(df: DataFrame, features: Sequence[str], target: str, model: str = "auto", key_cols: Sequence[str] = (),
          poly_degree: int | None = None, test_size: float = 0.2, cv_folds: int = 5, impute_target: bool = False,
          candidates=None, registry=None, parallelism: int = 2, **params) -> TrainResult:
    """Prepare, split by ``key_cols`` (which need not be features), fit and evaluate. Fills and the defaults
    for scoring come from the training part alone; only ``impute_target`` asks for the reference's order, which
    fills before it splits. The prepared rows are stored once and read by every later pass."""
    spark = df.sparkSession
    key_cols = list(key_cols) or [c for c in features if classify(df.schema).get(c) == "numeric"] + [target]
    unknown = [c for c in key_cols if c not in df.columns]
    if unknown:
        raise ValueError(f"no such key columns: {unknown}")
    keys = list(key_cols)
    data = df.select(*[qcol(c) for c in dict.fromkeys([*features, target, *keys])])
    if impute_target:
        train_df, test_df = split(materialize(prepare(data, features, target, True, keys=keys), "prepared"), keys, test_size)
    else:
        tr, te = split(drop_rows_with_missing(data, [target]), keys, test_size)
        fills = training_fills(tr.select(*[qcol(c) for c in features]))
        train_df = materialize(prepare(tr, features, target, keys=keys), "prepared")
        test_df = materialize(apply_fill(te, fills), "prepared-test")
    selection = None
    label = model
    if model == "auto":
        label, model, sel_params, selection = auto_select(train_df, features, target, keys, 3, candidates, parallelism)
        params = {**sel_params, **params}
    name = MP.canonical(model)
    if name in gram.LINEAR_FAMILY:
        # fit, folds and training metrics from one scan
        degree, rest = MP.degree_of(name, poly_degree, params)
        folds = FoldMoments(train_df, features, target, keys, cv_folds, degree)
        fm = folds.fit(name, features, target, rest, degree)
        cv = cv_table(spark, folds.metrics(name, rest))
        tr = gram.score(gram.solve(name, folds.total, {**MP.DEFAULTS[name], **rest}), folds.total)
    else:
        fm = MP.fit(train_df, features, target, model, poly_degree=poly_degree, **params)
        cv = cross_validate(train_df, features, target, model, keys, cv_folds, poly_degree, parallelism, **params)
        tr = evaluate(fm.transform(train_df), target).first()
    fm.defaults = fit_defaults(train_df, features)
    cvs = cv_summary(cv).first().asDict()
    te_pred = fm.transform(test_df)
    te = evaluate(te_pred, target).first()
    metrics = {
        "train_r2": tr["r2"], "train_mse": tr["mse"], "test_r2": te["r2"], "test_mse": te["mse"],
        **cvs, "n_train": tr["n"], "n_test": te["n"], "n_features": len(fm.expanded),
    }
    if registry is not None:
        rec = {**metrics, "run_id": registry.next_run_id(label), "model": label,
               "created_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
               "params": json.dumps(fm.params, default=str)}
        registry.append_run(rec)
    return TrainResult(fm, label, metrics, cv, te_pred, importance_table(fm, spark), selection)


def report_tables(res: TrainResult, spark) -> dict[str, DataFrame]:
    """Configuration, metrics, test predictions and the top-10 importances."""
    conf = spark.createDataFrame([(k, json.dumps(v, default=str)) for k, v in
                                  {"model": res.label, "features": res.model.features, "target": res.model.target,
                                   **res.model.params}.items()], "key string, value string")
    mets = spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in res.metrics.items()],
                                 "metric string, value double")
    pts, _ = actual_vs_predicted(res.test_predictions, res.model.target)
    return {"configuration": conf, "metrics": mets, "predictions": pts,
            "importances": res.importances.limit(10)}
