"""Scoring (M25, M26, E6): append predictions to every input column, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import classify, qcol
from quarry.models.pipeline import FittedModel
from quarry.operators.clean import fill_values


def check_features(fm: FittedModel, df: DataFrame, allow_defaults: bool = False) -> None:
    """Every model feature must be present (unless training defaults can stand in)."""
    missing = [c for c in fm.features if c not in df.columns]
    if missing and not (allow_defaults and all(c in fm.defaults for c in missing)):
        raise ValueError(f"missing feature columns: {missing}")


def fit_defaults(train: DataFrame, features: Sequence[str]) -> dict:
    """Training-set defaults — median for numeric features, mode for string features."""
    cls = classify(train.schema)
    num = [c for c in features if cls.get(c) == "numeric"]
    cat = [c for c in features if cls.get(c) == "categorical"]
    out = {}
    out.update(fill_values(train, num, "median"))
    out.update(fill_values(train, cat, "mode", empty_default="Unknown"))
    return out


def output_name(columns: Sequence[str], base: str = "Predicted_Value") -> str:
    """``Predicted_Value``, or ``_1``, ``_2``… when taken."""
    if base not in columns:
        return base
    i = 1
    while f"{base}_{i}" in columns:
        i += 1
    return f"{base}_{i}"


def score(fm: FittedModel, df: DataFrame, out: str = "Predicted_Value", fill_defaults: bool = False) -> DataFrame:
    """Features → (M26 defaults) → I11 zero fill → model → ``out`` appended to ALL input
    columns, which keep their values and types (with ``fill_defaults`` features show their defaults). Narrow (no shuffle for linear/tree models) and works on streaming DataFrames."""
    check_features(fm, df, allow_defaults=fill_defaults)
    name = output_name(df.columns, out)
    d = df
    if fill_defaults:
        absent = {c: F.lit(fm.defaults[c]) for c in fm.features if c not in df.columns}
        if absent:
            d = d.withColumns(absent)
        cls = classify(d.schema)
        fills = {}
        for c in fm.features:
            v = fm.defaults.get(c)
            if v is None:
                continue
            if cls.get(c) == "numeric":
                x = qcol(c).cast("double")
                fills[c] = F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(float(v)))
            else:
                fills[c] = F.coalesce(qcol(c).cast("string"), F.lit(str(v)))
        d = d.withColumns(fills)
    # Anything still missing among numeric features → 0, on a copy: the input columns travel beside it in a
    # struct, so they come back with their own values and types, whatever names the model's stages use
    cls = classify(d.schema)
    carried = output_name(fm.features, "_input")
    ready = [F.coalesce(F.nanvl(qcol(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c)
             if cls.get(c) == "numeric" else qcol(c) for c in fm.features]
    keep = [c for c in d.columns if c in df.columns or c in fm.features]
    scored_in = d.select(F.struct(*[qcol(c).alias(c) for c in keep]).alias(carried), *ready)
    out = fm.transform(scored_in).select(f"{carried}.*", F.col("prediction").alias(name))
    if fm.target_dictionary is not None:
        # the target was label-encoded at training: report the class label
        out = fm.target_dictionary.decode(out, name)
    return out


def decode_prediction(df: DataFrame, col: str, labels: Sequence[str], out: str | None = None) -> DataFrame:
    """Class index → label from a short list of labels (round, then look up). Models decode with their dictionary
    table instead (``FittedModel.target_dictionary.decode``)."""
    arr = F.array(*[F.lit(v) for v in labels])
    idx = F.round(qcol(col)).cast("int")
    lab = F.when((idx >= 0) & (idx < len(labels)), F.element_at(arr, idx + 1))
    return df.withColumn(out or col, lab)
