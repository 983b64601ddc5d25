"""IQR outlier detection and treatment.

Fences come from exact distributed quartiles (one bounded summary per column) and are
applied as literals in a narrow projection / filter — no join, no shuffle of the data.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import is_numeric, qcol
from quarry.operators.quantiles import column_quantiles


def iqr_fences(df: DataFrame, col: str, threshold: float = 1.5, **qkw) -> tuple[float | None, float | None]:
    q1, q3 = column_quantiles(df, [col], [0.25, 0.75], **qkw)[col]
    if q1 is None:
        return None, None
    iqr = q3 - q1
    return q1 - threshold * iqr, q3 + threshold * iqr


def _check(df: DataFrame, col: str) -> bool:
    types = {f.name: f.dataType for f in df.schema.fields}
    return col in types and is_numeric(types[col])


def flag_outliers(df: DataFrame, col: str, threshold: float = 1.5, out: str = "is_outlier") -> DataFrame:
    """Append boolean ``out`` = x < Q1 − t·IQR or x > Q3 + t·IQR; missing → False."""
    if not _check(df, col):
        raise ValueError(f"cannot compute fences: {col!r} is no numeric column of this table")
    lo, hi = iqr_fences(df, col, threshold)
    x = qcol(col).cast("double")
    if lo is None:
        return df.withColumn(out, F.lit(False))
    flag = F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
    return df.withColumn(out, F.when(F.isnan(x), False).otherwise(flag))


def treat_outliers(df: DataFrame, col: str, method: str = "cap", threshold: float = 1.5) -> DataFrame:
    """X2 cap (winsorise to the fences, result double, missing stays missing) /
    X3 remove (keep lo <= x <= hi; rows with a missing x go too). X4: a non-numeric or
    absent column returns the input unchanged with a warning; an unknown method raises."""
    if method not in ("cap", "remove"):
        raise ValueError(f"unknown method {method!r}: outliers are capped ('cap') or removed ('remove')")
    if not _check(df, col):
        warnings.warn(f"left unchanged: {col!r} is no numeric column of this table")
        return df
    lo, hi = iqr_fences(df, col, threshold)
    x = qcol(col).cast("double")
    x = F.when(F.isnan(x), None).otherwise(x)
    if method == "cap":
        if lo is None:
            return df.withColumn(col, x)
        # not greatest/least: those skip NULL instead of keeping it
        capped = F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
        return df.withColumn(col, capped)
    if lo is None:
        return df.limit(0)
    # on the raw column so the fences reach the Parquet scan (NULL fails both; NaN sorts above hi)
    raw = qcol(col)
    return df.filter((raw >= F.lit(lo)) & (raw <= F.lit(hi)))
