"""Estimators Spark ML lacks: a linear form (for the models solved from moments) and ε-insensitive SVR.

Proper ``pyspark.ml`` Estimator/Model pairs (persistable inside a PipelineModel). Data never leaves the executors: a
pass turns each partition into ONE row of partial sums (numpy on Arrow batches), which are summed again in a few
tasks before the driver receives them.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import qcol

#: Numbers of one numpy step: rows are taken in slices of SLICE_CELLS / their width, however many sums they go into.
SLICE_CELLS = 1 << 17
#: Numbers of one stored block of rows.
BLOCK_CELLS = 1 << 16
#: Blocks of a task in a pass, where there are many.
TASK_BLOCKS = 8
#: Numbers that a task holds to bring rows with equal features together.
HELD_CELLS = 1 << 21


def block_rows(rows: DataFrame) -> DataFrame:
    """Rows (x array<double>, y double) as blocks (x, n, y binary), dealt out evenly however the input is laid out: feature
    vectors, how many rows of the block have each, and their labels in this order. What depends on the features alone is
    computed once for them; where no two rows are equal, a block holds its rows as they are."""
    def by_features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the rows in which equal ones (mostly) follow each other, and where it begins a new one."""
        bits = np.ascontiguousarray(x).view("uint64")
        mix = (np.arange(1, x.shape[1] + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        key = ((bits ^ (bits >> np.uint64(29))) * mix).sum(1, dtype="uint64")
        order = np.argsort(key ^ (key >> np.uint64(32)), kind="stable")
        x = x[order]
        return order, np.append(True, (x[1:] != x[:-1]).any(1))

    def blocks(held):
        x, y = (np.concatenate(v) for v in zip(*held, strict=True))
        order, new = by_features(x)
        x, y = x[order], y[order]
        step = max(1, BLOCK_CELLS // max(1, x.shape[1]))
        for at in range(0, len(y), step):
            starts = np.flatnonzero(np.append(True, new[at + 1:at + step]))
            some = y[at:at + step]
            yield pa.RecordBatch.from_pydict({"x": pa.array([x[at + starts].tobytes()], pa.binary()),
                                              "n": pa.array([np.diff(np.append(starts, len(some))).astype("int64").tobytes()], pa.binary()),
                                              "y": pa.array([some.tobytes()], pa.binary())})

    def pack(batches):
        held, cells = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            if b.column(0).null_count or len(flat) % b.num_rows or held and held[0][0].shape[1] * b.num_rows != len(flat):
                raise ValueError("feature vectors must be present and of one length")
            held.append((flat.reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False).astype(float)))
            cells += len(flat)
            if cells >= HELD_CELLS:
                yield from blocks(held)
                held, cells = [], 0
        if held:
            yield from blocks(held)

    # a task of a pass has a few blocks, unless that leaves cores idle; the session's partitions at most
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    count = -(-size["n"] * (size["d"] or 0) // BLOCK_CELLS)
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), count, max(spark.sparkContext.defaultParallelism, count // TASK_BLOCKS))
    return rows.mapInArrow(pack, "x binary, n binary, y binary").repartition(max(1, tasks))


def sum_over_rows(blocks: DataFrame, fn, width: int, cells: int = 1) -> np.ndarray:
    """Sum of ``fn(X, y)`` (a vector of ``width``) over the rows in ``block_rows`` blocks, in any number of partitions;
    ``cells``: the numbers that ``fn`` makes of a row."""
    return sum_over_groups(blocks, lambda X, n, y: fn(np.repeat(X, n, 0), y), width, cells)


def sum_over_groups(blocks: DataFrame, fn, width: int, cells: int = 1) -> np.ndarray:
    """As ``sum_over_rows`` for ``fn(X, n, y)``: features, how many of the rows have them, and the labels of all rows;
    ``cells``: the numbers that ``fn`` makes of one row of X."""
    def scan(batches):
        total = np.zeros(width)
        for b in batches:
            for bx, bn, by in zip(b.column(0), b.column(1), b.column(2), strict=True):
                n, y = np.frombuffer(bn.as_buffer(), "int64"), np.frombuffer(by.as_buffer())
                x = np.frombuffer(bx.as_buffer()).reshape(len(n), -1)
                ends = np.append(0, np.cumsum(n))
                step = max(1, SLICE_CELLS // max(cells, x.shape[1]))
                for at in range(0, len(n), step):
                    total += fn(x[at:at + step], n[at:at + step], y[ends[at]:ends[min(at + step, len(n))]])
        yield pa.RecordBatch.from_pydict({"s": pa.array([total], pa.list_(pa.float64()))})

    def again(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += b.column(0).flatten().to_numpy().reshape(b.num_rows, width).sum(0)
        yield pa.RecordBatch.from_pydict({"s": pa.array([total], pa.list_(pa.float64()))})

    few = max(1, math.isqrt(blocks.rdd.getNumPartitions()))
    out = np.zeros(width)
    for r in blocks.mapInArrow(scan, "s array<double>").repartition(few).mapInArrow(again, "s array<double>").collect():
        out += np.asarray(r["s"])
    return out


class _LinearParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    coefficients = Param(Params._dummy(), "coefficients", "weights", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "bias", typeConverter=TypeConverters.toFloat)


class LinearFormModel(Model, _LinearParams, DefaultParamsReadable, DefaultParamsWritable):
    """prediction = intercept + coefficientsᵀ·features, evaluated JVM-side (no Python UDF)."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", coefficients=None,
                 intercept=0.0):
        super().__init__()
        self._setDefault(coefficients=[], intercept=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = self.getOrDefault(self.coefficients)
        arr = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))
        pred = F.lit(float(self.getOrDefault(self.intercept)))
        for i, wi in enumerate(w):
            pred = pred + F.lit(float(wi)) * arr[i]
        return df.withColumn(self.getOrDefault(self.predictionCol), pred)


class SVRModel(Model, _LinearParams, DefaultParamsReadable, DefaultParamsWritable):
    """prediction = b + wᵀz(x); z = x (linear) or √(2/D)·cos(Ωx + φ) (random Fourier features)."""

    kernel = Param(Params._dummy(), "kernel", "", typeConverter=TypeConverters.toString)
    omega = Param(Params._dummy(), "omega", "flattened D×d", typeConverter=TypeConverters.toListFloat)
    phase = Param(Params._dummy(), "phase", "", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", coefficients=None,
                 intercept=0.0, kernel="linear", omega=None, phase=None):
        super().__init__()
        self._setDefault(coefficients=[], intercept=0.0, kernel="linear", omega=[], phase=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        w = self.getOrDefault(self.coefficients)
        arr = vector_to_array(F.col(self.getOrDefault(self.featuresCol)))
        b = float(self.getOrDefault(self.intercept))
        if self.getOrDefault(self.kernel) == "linear":
            pred = F.lit(b)
            for i, wi in enumerate(w):
                pred = pred + F.lit(float(wi)) * arr[i]
            return df.withColumn(self.getOrDefault(self.predictionCol), pred)
        ph = self.getOrDefault(self.phase)
        om = self.getOrDefault(self.omega)
        D = len(ph)
        d = len(om) // D if D else 0
        scale = math.sqrt(2.0 / D)
        w, ph, om = np.array(w) * scale, np.array(ph), np.array(om).reshape(D, d)
        step = max(1, SLICE_CELLS // max(1, D))

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), d)
            return pa.array(np.concatenate([np.zeros(0)] + [np.cos(rows[at:at + step] @ om.T + ph) @ w + b for at in range(0, len(rows), step)]))

        return df.withColumn(self.getOrDefault(self.predictionCol), predicted(arr))


class SVRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed, DefaultParamsReadable,
                  DefaultParamsWritable):
    """ε-insensitive SVR, objective ½‖w‖² + C·Σ max(0, |y − f(x)| − ε) (Smola & Schölkopf 2004).

    The loss is smoothed: quadratic over a width μ beyond ε. Newton's method solves the smoothed problem (one pass for
    loss, gradient and Hessian, two more where the whole step is refused), then μ shrinks. The smoothed slopes
    C·L′ are dual variables, so every pass also gives the duality gap; the fit ends when it is at most ``tol`` of the
    objective and warns if ``maxIter`` passes did not suffice. All sums are over rows: the result does not depend on the
    partitions. A pass computes what rows of equal features share once for each block. kernel='linear' works on x; 'rbf' on random Fourier features (Rahimi & Recht 2007) with
    γ = 1/(d·var(X)) ('scale')."""

    kernel = Param(Params._dummy(), "kernel", "", typeConverter=TypeConverters.toString)
    C = Param(Params._dummy(), "C", "", typeConverter=TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "", typeConverter=TypeConverters.toFloat)
    n_components = Param(Params._dummy(), "n_components", "", typeConverter=TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "duality gap as a share of the objective", typeConverter=TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "passes over the data, besides the search for a shorter step", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", kernel="rbf", C=1.0,
                 epsilon=0.1, n_components=200, tol=1e-3, maxIter=100, seed=42):
        super().__init__()
        self._setDefault(kernel="rbf", C=1.0, epsilon=0.1, n_components=200, tol=1e-3, maxIter=100, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SVRModel:
        fc, lc = self.getOrDefault(self.featuresCol), self.getOrDefault(self.labelCol)
        kernel = self.getOrDefault(self.kernel)
        if kernel not in ("linear", "rbf"):
            raise ValueError("SVR kernels built: 'linear' and 'rbf' (poly/sigmoid need an exact kernel solver)")
        rows = df.select(vector_to_array(qcol(fc)).alias("x"), qcol(lc).cast("double").alias("y")).where("y is not null")
        blocks = block_rows(rows).persist(StorageLevel.MEMORY_AND_DISK)  # every pass reads the features alone
        try:
            first = blocks.first()
            if first is None:
                raise ValueError("there are no rows to fit")
            return self._solve(blocks, len(first["x"]) // len(first["n"]), kernel)
        finally:
            blocks.unpersist()

    def _solve(self, blocks: DataFrame, d: int, kernel: str) -> SVRModel:
        n, sy, syy, sx, sxx = sum_over_rows(blocks, lambda X, y: np.array([len(y), y.sum(), y @ y, X.sum(), (X * X).sum()]), 5)
        omega = phase = None
        if kernel == "rbf":
            rng = np.random.default_rng(self.getOrDefault(self.seed))
            var = sxx / (n * d) - (sx / (n * d)) ** 2
            D = self.getOrDefault(self.n_components)
            omega = rng.normal(0.0, math.sqrt(2 / (d * var)) if var > 0 else math.sqrt(2.0), size=(D, d))
            phase = rng.uniform(0, 2 * math.pi, size=D)

            def feats(X):
                return math.sqrt(2.0 / D) * np.cos(X @ omega.T + phase)
        else:
            D = d

            def feats(X):
                return X

        C, eps = self.getOrDefault(self.C), self.getOrDefault(self.epsilon)
        steps = 0.5 ** np.arange(10)
        width = 5 + (D + 1) + (D + 1) ** 2

        def design(X):
            Z = np.ones((len(X), D + 1))
            Z[:, :D] = feats(X)
            return Z

        def losses(over: np.ndarray, mu: float) -> np.ndarray:
            """Smoothed losses of each row of ``over`` (taken as working space), summed."""
            np.maximum(over, 0, out=over)
            bend = np.minimum(over, mu)
            return (np.einsum("ij,ij->i", bend, over) - 0.5 * np.einsum("ij,ij->i", bend, bend)) / mu

        def state(theta: np.ndarray, mu: float) -> dict:
            """At theta = (w, b): smoothed and exact loss, dual sums, gradient and Hessian of the smoothed loss."""
            def fn(X, n, y):
                Z, starts = design(X), np.cumsum(n) - n
                r = y - np.repeat(Z @ theta, n)
                over = np.abs(r) - eps
                slope = np.clip(over / mu, 0, 1) * np.sign(r)  # β / C
                bent = np.add.reduceat(((over > 0) & (over < mu)).astype(float), starts)  # rows of each
                Zb, bent = Z[bent > 0], bent[bent > 0]
                exact = np.maximum(over, 0).sum()
                return np.concatenate([losses(over[None], mu), [exact, slope @ y, np.abs(slope).sum(), slope.sum()],
                                       Z.T @ np.add.reduceat(slope, starts), ((Zb * bent[:, None]).T @ Zb).ravel() / mu])

            s = sum_over_groups(blocks, fn, width, D + 1)
            w = theta[:D]
            beta = C * s[5:6 + D]
            return {"loss": C * s[0], "smooth": 0.5 * w @ w + C * s[0], "primal": 0.5 * w @ w + C * s[1],
                    "dual": -0.5 * beta[:D] @ beta[:D] + C * s[2] - eps * C * s[3], "leak": abs(C * s[4]),
                    "grad": np.append(w, 0.0) - beta, "hess": C * s[6 + D:].reshape(D + 1, D + 1)}

        def shorter(theta: np.ndarray, move: np.ndarray, mu: float) -> np.ndarray:
            """The smoothed loss at theta + t·move for each step t but the first."""
            def fn(X, n, y):
                Z = design(X)
                moved = np.repeat(Z @ theta, n) + np.multiply.outer(steps[1:], np.repeat(Z @ move, n))
                np.subtract(y, moved, out=moved)
                np.abs(moved, out=moved)
                moved -= eps
                return losses(moved, mu)

            return C * sum_over_groups(blocks, fn, len(steps) - 1, D + 1)

        spread = math.sqrt(max(syy / n - (sy / n) ** 2, 0.0))
        theta = np.append(np.zeros(D), sy / n)
        scale = max(spread, eps, 1e-12)
        mu, tol, left = scale, self.getOrDefault(self.tol), self.getOrDefault(self.maxIter)
        here, left = state(theta, mu), left - 1
        gap = float("inf")
        while left > 0:
            # a gradient below this moves the objective by less than the gap allows (the intercept's by its spread)
            if np.abs(here["grad"]).max() <= 1e-6 * C * n:
                gap = here["primal"] - here["dual"] + here["leak"] * scale
                if gap <= tol * max(here["primal"], 1e-12 * C * n * scale) or mu <= 1e-9 * scale:
                    break
                mu /= 10
                here, left = state(theta, mu), left - 1
                continue
            hess = here["hess"] + np.diag(np.append(np.ones(D), 1e-8 * C * n / scale))
            move = -np.linalg.solve(hess, here["grad"])
            there, left = state(theta + move, mu), left - 1
            slope = here["grad"] @ move
            w = theta[:D]

            def fits(t, loss):
                return 0.5 * np.sum((w + t * move[:D]) ** 2) + loss <= here["smooth"] + 1e-4 * t * slope

            if fits(1.0, there["loss"]):
                good = 0
            else:
                good = next((i for i, loss in enumerate(shorter(theta, move, mu), 1) if fits(steps[i], loss)), None)
            if good is None:  # no step helps beyond rounding: this μ is solved
                gap = here["primal"] - here["dual"] + here["leak"] * scale
                if gap <= tol * max(here["primal"], 1e-12 * C * n * scale) or mu <= 1e-9 * scale:
                    break
                mu /= 10
                here, left = state(theta, mu), left - 1
            elif good == 0:
                theta, here = theta + move, there
            else:
                theta = theta + steps[good] * move
                here, left = state(theta, mu), left - 1
        else:
            warnings.warn(f"SVR stopped after {self.getOrDefault(self.maxIter)} passes; its duality gap was last measured as {gap:g}")
        return SVRModel(featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
                        predictionCol=self.getOrDefault(self.predictionCol), coefficients=[float(v) for v in theta[:D]], intercept=float(theta[D]),
                        kernel=kernel, omega=[] if omega is None else [float(v) for v in omega.ravel()],
                        phase=[] if phase is None else [float(v) for v in phase])
