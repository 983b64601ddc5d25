"""Linear fits from grouped second moments (M4–M8, and CV / grid search over them: M17, M19).

One scan turns every partition into one row a fold: the number of rows, the means and the centred cross products of
all features and the label (numpy on Arrow batches). Such rows merge exactly (Chan, Golub & LeVeque 1983), so they are
summed again in a few tasks before the driver receives them, and a fold can be taken out of the total. Everything else
happens on d×d summaries: standardisation, every penalty, every fold's training part, and the test metrics too, since
a squared error is a quadratic form in the moments. No combination of folds and parameters reads the data again.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Models whose fit needs the moments alone.
LINEAR_FAMILY = ("linear", "polynomial", "ridge", "lasso", "elasticnet", "bayesian_ridge")

_SCHEMA = "fold int, n double, missing long, mean array<double>, cross array<double>"


@dataclass
class Moments:
    """Rows, means and centred cross products of (features…, label); ``missing`` counts rows left out."""

    n: float
    mean: np.ndarray
    cross: np.ndarray
    missing: int = 0

    @property
    def width(self) -> int:
        return len(self.mean) - 1


def merge(a: Moments, b: Moments) -> Moments:
    if not a.n or not b.n:
        some = a if a.n else b
        return Moments(some.n, some.mean, some.cross, a.missing + b.missing)
    n, gap = a.n + b.n, b.mean - a.mean
    return Moments(n, a.mean + gap * (b.n / n), a.cross + b.cross + np.outer(gap, gap) * (a.n * b.n / n), a.missing + b.missing)


def without(total: Moments, part: Moments) -> Moments:
    """``total`` less one of the parts that were merged into it."""
    n = total.n - part.n
    if n <= 0:
        return Moments(0.0, np.zeros_like(total.mean), np.zeros_like(total.cross), total.missing - part.missing)
    mean = total.mean + (total.mean - part.mean) * (part.n / n)
    gap = part.mean - mean
    return Moments(n, mean, total.cross - part.cross - np.outer(gap, gap) * (part.n * n / total.n), total.missing - part.missing)


def moments(df: DataFrame, x: Column, y: Column, fold: Column | None = None) -> dict[int, Moments]:
    """Moments of the array column ``x`` with ``y`` for each fold (one fold 0 if none is named), in one scan.

    Rows with a missing (null or NaN) component or label are left out and counted."""
    src = df.select(x.cast("array<double>").alias("x"), y.cast("double").alias("y"),
                    (F.lit(0) if fold is None else fold).cast("int").alias("fold"))

    def of(rows: np.ndarray) -> tuple:
        mean = rows.mean(0)
        rest = rows - mean
        return float(len(rows)), mean, rest.T @ rest

    def add(a, b):
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def rows_out(held: dict, missing: dict) -> pa.RecordBatch:
        keys = sorted(held.keys() | missing.keys())
        some = {k: held.get(k, (0.0, np.zeros(0), np.zeros(0))) for k in keys}
        return pa.RecordBatch.from_pydict(
            {"fold": pa.array(keys, pa.int32()), "n": pa.array([some[k][0] for k in keys], pa.float64()),
             "missing": pa.array([missing.get(k, 0) for k in keys], pa.int64()),
             "mean": pa.array([some[k][1] for k in keys], pa.list_(pa.float64())),
             "cross": pa.array([some[k][2].ravel() for k in keys], pa.list_(pa.float64()))})

    def scan(batches: Iterable[pa.RecordBatch]):
        held, missing = {}, {}
        for b in batches:
            if not b.num_rows:
                continue
            lists, fold_of = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            y_of = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            if lists.null_count or len(flat) % b.num_rows:
                raise ValueError("feature vectors must be present and of one length")
            table = np.concatenate([flat.reshape(b.num_rows, -1), y_of[:, None]], 1)
            whole = ~np.isnan(table).any(1)
            for k in np.unique(fold_of).tolist():
                at = fold_of == k
                missing[k] = missing.get(k, 0) + int((at & ~whole).sum())
                rows = table[at & whole]
                if len(rows):
                    held[k] = add(held[k], of(rows)) if k in held else of(rows)
        if held or missing:
            yield rows_out(held, missing)

    def again(batches: Iterable[pa.RecordBatch]):
        held, missing = {}, {}
        for b in batches:
            for r in b.to_pylist():
                k = r["fold"]
                missing[k] = missing.get(k, 0) + r["missing"]
                if r["n"]:
                    one = (r["n"], np.asarray(r["mean"]), np.asarray(r["cross"]).reshape(len(r["mean"]), -1))
                    held[k] = add(held[k], one) if k in held else one
        if held or missing:
            yield rows_out(held, missing)

    spark = df.sparkSession
    few = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    out: dict[int, Moments] = {}
    for r in src.mapInArrow(scan, _SCHEMA).repartition(few).mapInArrow(again, _SCHEMA).collect():  # at most ``few`` rows a fold
        mean = np.asarray(r["mean"], float)
        one = Moments(r["n"], mean, np.asarray(r["cross"], float).reshape(len(mean), -1), r["missing"])
        out[r["fold"]] = merge(out[r["fold"]], one) if r["fold"] in out else one
    return out


def total_of(parts: dict[int, Moments]) -> Moments:
    total = None
    for k in sorted(parts):
        total = parts[k] if total is None else merge(total, parts[k])
    if total is None or not total.n:
        raise ValueError("there are no complete rows to fit" + (f" ({total.missing} rows with missing values)" if total else ""))
    return total


@dataclass
class LinearFit:
    """Weights of the standardised features, with the centre and scale that standardise them."""

    weights: np.ndarray
    intercept: float
    centre: np.ndarray
    scale: np.ndarray
    n: int

    def raw(self) -> tuple[np.ndarray, float]:
        """Weights and intercept for features as they are."""
        w = self.weights / self.scale
        return w, float(self.intercept - w @ self.centre)


def solve(model: str, m: Moments, params: dict, scale: bool = True) -> LinearFit:
    """Fit one of LINEAR_FAMILY on moments; objectives as in scikit-learn, on features standardised with the
    population deviation (a constant feature becomes 0)."""
    d = m.width
    var = np.clip(np.diagonal(m.cross)[:d] / m.n, 0, None)
    # what is left of a constant by rounding is no spread
    flat = var <= (8 * np.finfo(float).eps * np.abs(m.mean[:d])) ** 2
    sd = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var))) if scale else np.ones(d)
    centre = m.mean[:d] if scale else np.zeros(d)
    a = m.cross[:d, :d] / np.outer(sd, sd)
    b = m.cross[:d, d] / sd
    if flat.any():
        a[flat, :], a[:, flat], b[flat] = 0.0, 0.0, 0.0
    if model in ("linear", "polynomial"):
        w = _least_squares(a, b)
    elif model == "ridge":
        w = _least_squares(a + float(params["alpha"]) * np.eye(d), b)
    elif model in ("lasso", "elasticnet"):
        l1 = 1.0 if model == "lasso" else float(params["l1_ratio"])
        w = coordinate_descent(a / m.n, b / m.n, float(params["alpha"]) * l1, float(params["alpha"]) * (1 - l1))
    elif model == "bayesian_ridge":
        w = evidence(a, b, float(m.cross[d, d]), m.n, params)
    else:
        raise ValueError(f"{model!r} is not fitted from moments")
    mean = (m.mean[:d] - centre) / sd
    return LinearFit(w, float(m.mean[d] - w @ mean), centre, sd, int(m.n))


def _least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of least norm of a·w = b for a symmetric matrix without negative eigenvalues."""
    if not len(b):
        return np.zeros(0)
    e, v = np.linalg.eigh(a)
    keep = e > max(e.max(), 0.0) * len(b) * np.finfo(float).eps
    return v[:, keep] @ ((v[:, keep].T @ b) / e[keep])


def coordinate_descent(a: np.ndarray, b: np.ndarray, l1: float, l2: float, tol: float = 1e-12, rounds: int = 100_000) -> np.ndarray:
    """Minimise ½wᵀaw − bᵀw + l1‖w‖₁ + ½l2‖w‖² one weight at a time, until no weight moves by more than ``tol`` of the
    largest."""
    d = len(b)
    w, grad = np.zeros(d), -b.astype(float)  # grad = a·w − b
    for _ in range(rounds):
        moved = 0.0
        for j in range(d):
            if a[j, j] + l2 <= 0:
                continue
            z = a[j, j] * w[j] - grad[j]
            new = math.copysign(max(abs(z) - l1, 0.0), z) / (a[j, j] + l2)
            if new != w[j]:
                grad += a[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tol * max(1e-300, np.abs(w).max(initial=0)):
            return w
    warnings.warn(f"coordinate descent stopped after {rounds} rounds")
    return w


def evidence(a: np.ndarray, b: np.ndarray, c: float, n: float, params: dict, tol: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Bayesian ridge (MacKay 1992; Tipping 2001) on centred sums a = XᵀX, b = Xᵀy, c = yᵀy: w = (a + λ/α·I)⁻¹b,
    γ = Σ αe/(λ + αe), λ = (γ + 2λ₁)/(‖w‖² + 2λ₂), α = (n − γ + 2α₁)/(sse + 2α₂), until Σ|Δw| < tol."""
    e, v = np.linalg.eigh(a)
    e, vb = np.clip(e, 0, None), v.T @ b
    alpha, lam, old = 1.0 / (c / n + np.finfo(float).eps), 1.0, None
    tol, rounds = float(params.get("tol", tol)), int(params.get("max_iter", rounds))
    for _ in range(rounds):
        w = v @ (vb / (e + lam / alpha))
        sse = max(c - 2 * w @ b + w @ a @ w, 0.0)
        gamma = float(np.sum(alpha * e / (lam + alpha * e)))
        lam = (gamma + 2 * params["lambda_1"]) / (float(w @ w) + 2 * params["lambda_2"])
        alpha = (n - gamma + 2 * params["alpha_1"]) / (sse + 2 * params["alpha_2"])
        if old is not None and np.sum(np.abs(old - w)) < tol:
            break
        old = w
    return v @ (vb / (e + lam / alpha))


def score(fit: LinearFit, m: Moments) -> dict:
    """n, r2 and mse of a fit on the rows behind ``m``, which it need not have seen."""
    if not m.n:
        return {"n": 0, "r2": None, "mse": None}
    w, b = fit.raw()
    d = m.width
    q = np.append(-w, 1.0)  # the residual y − b − w·x as a combination of the columns
    bias = float(m.mean[d] - b - w @ m.mean[:d])
    sse = max(float(q @ m.cross @ q), 0.0) + m.n * bias * bias
    spread = float(m.cross[d, d])
    return {"n": int(m.n), "r2": 1.0 - sse / spread if spread > 0 else None, "mse": sse / m.n}
