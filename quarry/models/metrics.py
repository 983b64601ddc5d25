"""Regression metrics (M16) and overfitting flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import qcol


def evaluate(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One aggregate → (n, r2, mse, rmse, mae). R² = 1 − SSE / (n · var_pop(y)) — the
    coefficient of determination, not the squared correlation; NULL (not an ANSI error) for an
    empty input or a constant label."""
    y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    ok = df.filter(y.isNotNull() & p.isNotNull())
    e = y - p
    agg = ok.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_var"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
    )
    return agg.select(
        "n",
        (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("n") * F.col("_var"))).alias("r2"),
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
    )


def overfit_flags(runs: DataFrame, r2_gap: float = -0.05, mse_ratio: float = 0.2) -> DataFrame:
    """Flags on a run table with train/test R² and MSE columns:
    r2_overfit when test − train R² < −0.05; mse_overfit when (test − train)/train MSE > 0.2
    and train MSE > 1e-9."""
    return runs.withColumn("r2_overfit", (F.col("test_r2") - F.col("train_r2")) < F.lit(r2_gap)).withColumn(
        "mse_overfit",
        F.when(F.col("train_mse") > 1e-9,
               F.try_divide(F.col("test_mse") - F.col("train_mse"), F.col("train_mse")) > F.lit(mse_ratio))
        .otherwise(F.lit(False)),
    )
