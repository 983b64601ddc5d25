"""Pairwise-complete correlations of any number of columns in one scan.

With missing values every pair of columns has rows of its own, so a pair's moments are sums over both columns' masks:
with X zero where missing and M the mask, MᵀM counts, XᵀM sums, (X∘X)ᵀM squares and XᵀX products of all pairs at
once. A task turns its batches into such matrices by tiles of columns, centred, and merges them with the
pairwise update of Chan, Golub & LeVeque; a tile's rows from all tasks meet in two steps and come out as
correlations. The driver sees none of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a tile: a task hands on six matrices of at most TILE × TILE numbers for each pair of tiles.
TILE = 128


def correlations(df: DataFrame, columns: list[Column], tile: int | None = None) -> DataFrame:
    """(i, j, n, corr) for all ordered pairs of the columns, doubles with null or NaN for missing. ``n`` counts the rows
    where both are present; ``corr`` is null where a column is constant on them, or infinite, or there are no such rows."""
    d, tile = len(columns), tile or TILE
    starts = list(range(0, d, tile))

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The six matrices of two tiles: n, mean of x, mean of y, squares of x, squares of y, products (centred)."""
        out = []
        for t in (x, y):
            m = ~np.isnan(t)
            pivot = np.where(m, t, 0).sum(0) / np.maximum(m.sum(0), 1)
            out.append((m.astype(float), np.where(m, t - pivot, 0.0), pivot))
        (mx, x0, px), (my, y0, py) = out
        n = mx.T @ my
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            some = np.maximum(n, 1)
            sx, sy = x0.T @ my, mx.T @ y0
            return np.stack([n, px[:, None] + sx / some, py[None] + sy / some, (x0 * x0).T @ my - sx * sx / some,
                             mx.T @ (y0 * y0) - sy * sy / some, x0.T @ y0 - sx * sy / some])

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            n = a[0] + b[0]
            part = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
            gx, gy, both = b[1] - a[1], b[2] - a[2], a[0] * part
            # a side without rows has no mean of its own
            gx, gy = np.where(a[0] > 0, gx, 0), np.where(a[0] > 0, gy, 0)
            mean = [np.where(a[0] > 0, a[k] + g * part, b[k]) for k, g in ((1, gx), (2, gy))]
            return np.stack([n, *mean, a[3] + b[3] + gx * gx * both, a[4] + b[4] + gy * gy * both, a[5] + b[5] + gx * gy * both])

    def row(p: int, q: int, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "q": pa.array([q], pa.int32()),
                                           "m": pa.array([held.ravel()], pa.list_(pa.float64()))})

    def scan(batches):
        held = {}
        for b in batches:
            if b.num_rows:
                table = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, d)
                for k, p in enumerate(starts):
                    for q in starts[k:]:
                        one = of(table[:, p:p + tile], table[:, q:q + tile])
                        held[p, q] = add(held[p, q], one) if (p, q) in held else one
        for (p, q), m in held.items():
            yield row(p, q, m)

    def merged(batches):
        """One row a pair of tiles, from rows in the order of p and q."""
        here, held = None, None
        for b in batches:
            for i in range(b.num_rows):
                key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                one = b.column(2)[i].values.to_numpy().reshape(6, min(tile, d - key[0]), min(tile, d - key[1]))
                if key != here:
                    if here is not None:
                        yield here, held
                    here, held = key, one
                else:
                    held = add(held, one)
        if here is not None:
            yield here, held

    def again(batches):
        for (p, q), m in merged(batches):
            yield row(p, q, m)

    def finish(batches):
        for (p, q), (n, mx, my, vx, vy, c) in merged(batches):
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                # what rounding leaves of a constant is no spread
                tiny = 8 * np.finfo(float).eps
                spread = (vx > n * (tiny * mx) ** 2) & (vy > n * (tiny * my) ** 2)
                r = np.clip(c / (np.sqrt(vx) * np.sqrt(vy)), -1.0, 1.0)
            known = spread & np.isfinite(r)
            i, j = (np.broadcast_to(a, n.shape).ravel() for a in (p + np.arange(n.shape[0])[:, None], q + np.arange(n.shape[1])[None]))
            told = pa.array(np.where(known, r, 0.0).ravel(), pa.float64(), mask=~known.ravel())
            twice = [(i, j)] if p == q else [(i, j), (j, i)]
            for a, b in twice:
                yield pa.RecordBatch.from_pydict({"i": pa.array(a, pa.int32()), "j": pa.array(b, pa.int32()),
                                                  "n": pa.array(n.ravel().astype(np.int64)), "corr": told})

    few = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = df.select(F.array(*[c.cast("double") for c in columns]).alias("x")).mapInArrow(scan, "p int, q int, m array<double>")
    half = parts.withColumn("salt", F.spark_partition_id() % few).repartition("p", "q", "salt").sortWithinPartitions("p", "q").drop("salt")
    whole = half.mapInArrow(again, "p int, q int, m array<double>").repartition("p", "q").sortWithinPartitions("p", "q")
    return whole.mapInArrow(finish, "i int, j int, n long, corr double")
