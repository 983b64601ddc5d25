"""Regression pipelines: [label-encode strings] → [polynomial terms] → assemble → standardise
(population std, like sklearn) → regressor (M2–M15, M27).

Everything is a Spark ML stage, so a fitted model is one ``PipelineModel`` that saves/loads
as a directory and scores batch or streaming DataFrames with a narrow ``transform``. The linear
family is solved from second moments (``models.gram``): one scan, nothing cached. Columns that the
stages add have names of their own (``quarry_…``), so feature and target names may hold anything.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.feature import (
    Bucketizer,
    ElementwiseProduct,
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
    VectorSizeHint,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import classify, qcol
from quarry.models import gram
from quarry.models.dictionary import LabelDictionary, LabelDictionaryModel
from quarry.models.prep import poly_sql, poly_terms
from quarry.session import checkpoint_dir

MAX_TREE_DEPTH = 30  # Spark's limit; deeper requests are clamped with a warning
# sklearn's trees split on exact thresholds; Spark bins continuous features (default 32).
# 128 bins keeps every midpoint for features with up to 128 distinct values.
DEFAULT_MAX_BINS = 128
#: Models of squared loss that see a row's features by their bins alone: rows of the same bins enter as one, with their
#: mean label and their number as weight.
BOOSTED = ("xgboost", "gbt", "lightgbm")
#: Rows a cell of bins must have on average for that; else the rows are fitted as they are. Cells of a task.
CELL_ROWS, TASK_CELLS = 4, 50_000

# fixed values: the reference's default hyper-parameters per model
DEFAULTS = {
    "linear": {},
    "polynomial": {"degree": 2},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0},
    "elasticnet": {"alpha": 1.0, "l1_ratio": 0.5},
    "bayesian_ridge": {"alpha_1": 1e-6, "alpha_2": 1e-6, "lambda_1": 1e-6, "lambda_2": 1e-6},
    "tree": {"max_depth": 5, "min_samples_split": 2},
    "forest": {"n_estimators": 100, "max_depth": 10},
    "xgboost": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "lightgbm": {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1},
    "svr": {"kernel": "rbf", "C": 1.0, "epsilon": 0.1},
    "knn": {"n_neighbors": 5, "weights": "uniform", "p": 2},
    "huber": {"epsilon": 1.35, "alpha": 0.0001},
    "gbt": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "bagging": {"n_estimators": 10, "max_depth": 10},
    "isotonic": {},
}

ALIASES = {
    "linear regression": "linear", "polynomial regression": "polynomial", "ridge regression": "ridge",
    "lasso regression": "lasso", "elastic net": "elasticnet", "bayesian ridge": "bayesian_ridge",
    "decision tree": "tree", "random forest": "forest", "xgboost": "xgboost", "lightgbm": "lightgbm",
    "svr": "svr", "k-nearest neighbors": "knn", "knn": "knn", "huber regressor": "huber",
    "gradient boosting": "gbt", "bagging regressor": "bagging", "isotonic regression": "isotonic",
}


def canonical(name: str) -> str:
    n = name.strip().lower()
    n = ALIASES.get(n, n)
    if n not in DEFAULTS:
        raise ValueError(f"unknown model {name!r}")
    return n


def _depth(d) -> int:
    if d is None or d == -1:
        return MAX_TREE_DEPTH
    d = int(d)
    if d > MAX_TREE_DEPTH:
        warnings.warn(f"max_depth {d} clamped to Spark's limit {MAX_TREE_DEPTH}")
        return MAX_TREE_DEPTH
    return max(d, 1)


LABEL = "quarry_label"  # the target as double, where a stage is fitted


def make_regressor(name: str, label: str, n_train: int = 1, features_col: str = "features", seed: int = 42, **params):
    """An estimator for the named model. ``n_train`` turns sklearn's Huber penalty, which goes with the sum of
    the losses, into Spark's, which goes with half their mean."""
    name = canonical(name)
    p = {**DEFAULTS[name], **params}
    common = dict(featuresCol=features_col, labelCol=label, predictionCol="prediction")
    if name in gram.LINEAR_FAMILY:
        raise ValueError(f"{name} is fitted from moments (quarry.models.gram), not by an estimator")
    if name == "huber":
        return LinearRegression(loss="huber", epsilon=max(p["epsilon"], 1.0 + 1e-9), regParam=p["alpha"] / max(n_train, 1),
                                elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9, **common)
    bins = int(p.get("max_bins", DEFAULT_MAX_BINS))
    if name == "tree":
        return DecisionTreeRegressor(maxDepth=_depth(p["max_depth"]),
                                     minInstancesPerNode=max(1, math.ceil(p["min_samples_split"] / 2)), seed=seed,
                                     maxBins=bins, **common)
    if name in ("forest", "bagging"):
        return RandomForestRegressor(numTrees=int(p["n_estimators"]), maxDepth=_depth(p.get("max_depth")),
                                     featureSubsetStrategy="all", bootstrap=True, seed=seed, maxBins=bins, **common)
    if name in ("xgboost", "gbt"):
        return GBTRegressor(maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                            maxDepth=_depth(p["max_depth"]), seed=seed, maxBins=bins, **common)
    if name == "lightgbm":
        depth = math.ceil(math.log2(max(int(p["num_leaves"]), 2)))
        if p["max_depth"] not in (None, -1):
            depth = min(depth, int(p["max_depth"]))
        return GBTRegressor(maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                            maxDepth=_depth(depth), seed=seed, maxBins=bins, **common)
    if name == "isotonic":
        from quarry.models.isotonic import IsotonicRegressor

        return IsotonicRegressor(**common)
    if name == "svr":
        from quarry.models.custom import SVRegressor

        return SVRegressor(featuresCol=features_col, labelCol=label, kernel=p["kernel"], C=float(p["C"]),
                           epsilon=float(p["epsilon"]), seed=seed)
    if name == "knn":
        from quarry.models.knn import KNNRegressor

        return KNNRegressor(featuresCol=features_col, labelCol=label, k=int(p["n_neighbors"]),
                            weights=p["weights"], p=float(p["p"]), idCol=p.get("id_col") or "", method=p.get("method", "exact"),
                            recall=float(p.get("recall", 0.95)))
    raise ValueError(name)


@dataclass
class FittedModel:
    """A fitted pipeline plus what is needed to use it: feature names after expansion, the
    target, its dictionary if it is a string, and the training defaults for missing inputs (M26)."""

    pipeline: PipelineModel
    model_name: str
    features: list[str]
    target: str
    expanded: list[str]
    params: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    n_train: int = 0
    target_dictionary: LabelDictionaryModel | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


@dataclass
class Encoded:
    """Features made numeric: the stages that do it, the columns they leave (numbers or vectors), the names of the
    features after expansion, and the data behind the stages with the target as LABEL."""

    stages: list
    inputs: list[str]
    names: list[str]
    data: DataFrame
    target_dictionary: LabelDictionaryModel | None = None

    @property
    def vectors(self) -> list[str]:
        types = {f.name: f.dataType for f in self.data.schema.fields}
        return [c for c in self.inputs if isinstance(types.get(c), VectorUDT)]

    def x(self) -> Column:
        """All inputs as one array."""
        vec = set(self.vectors)
        parts = [vector_to_array(qcol(c)) if c in vec else F.array(qcol(c).cast("double")) for c in self.inputs]
        return F.concat(*parts) if vec else F.array(*[qcol(c).cast("double") for c in self.inputs])


#: A model reports the labels of a target with at most this many; all of them are in its dictionary table.
REPORTED_LABELS = 1000


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v: float) -> str:
    return repr(float(v))


def encode(df: DataFrame, features: Sequence[str], target: str, poly_degree: int | None = None, unknown: str = "zero",
           keep: Sequence[str] = ()) -> Encoded:
    """E4 + M2: string features become codes, a string target too, then the polynomial terms. ``keep``: other columns
    to carry along."""
    features = list(features)
    cls = classify(df.schema)
    dictionary = None
    d = df
    if cls.get(target) == "categorical":
        # predictions are decoded with the dictionary (E6); rows without a label take no part
        d = d.where(qcol(target).isNotNull())
        dictionary = LabelDictionary(inputCol=target, outputCol=LABEL).fit(d)
        d = dictionary.transform(d)
    else:
        d = d.withColumn(LABEL, qcol(target).cast("double"))
    d = d.select(*[qcol(c) for c in dict.fromkeys([*features, *keep])], LABEL)
    stages, inputs = [], []
    for i, c in enumerate(features):
        if cls.get(c) == "categorical":
            stages.append(LabelDictionary(inputCol=c, outputCol=f"quarry_code{i}", unknown=unknown).fit(d))
            inputs.append(f"quarry_code{i}")
        else:
            inputs.append(c)
    names = list(features)
    if poly_degree and poly_degree > 1:
        pairs, sel = poly_sql(inputs, poly_degree)
        stages.append(SQLTransformer(statement=f"SELECT *, {sel} FROM __THIS__"))
        # same index combinations, labelled with the user's feature names
        names = [label for label, _combo in poly_terms(features, poly_degree)]
        inputs = [safe for _l, safe in pairs]
    return Encoded(stages, inputs, names, PipelineModel(stages=list(stages)).transform(d) if stages else d, dictionary)


def _raw(enc: Encoded, out: str) -> tuple[list, int]:
    """Stages that put the inputs as they are into one vector column, and its length."""
    cols = ", ".join(f"{_sql(c)} AS `quarry_x{i}`" for i, c in enumerate(enc.inputs))
    stages, width, vec = [SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")], 0, set(enc.vectors)
    for i, c in enumerate(enc.inputs):
        size = 1
        if c in vec:
            size = enc.data.select(qcol(c)).first()[0].size  # one row: vectors of a feature column share a size
            stages.append(VectorSizeHint(inputCol=f"quarry_x{i}", size=size, handleInvalid="optimistic"))
        width += size
    return [*stages, VectorAssembler(inputCols=[f"quarry_x{i}" for i in range(len(enc.inputs))], outputCol=out, handleInvalid="keep")], width


def _assemble(enc: Encoded, centre: Sequence[float], scale: Sequence[float]) -> tuple[list, bool]:
    """Stages from the encoded inputs to the vector column ``features``, and whether it is centred (a vector input is
    scaled only: its centre belongs into the model's intercept)."""
    if enc.vectors:
        return [*_raw(enc, "quarry_raw")[0],
                ElementwiseProduct(scalingVec=Vectors.dense([1.0 / s for s in scale]), inputCol="quarry_raw", outputCol="features")], False
    cols = [f"(CAST({_sql(c)} AS DOUBLE) - ({_lit(m)})) / ({_lit(s)}) AS `quarry_z{i}`"
            for i, (c, m, s) in enumerate(zip(enc.inputs, centre, scale, strict=True))]
    return [SQLTransformer(statement=f"SELECT *, {', '.join(cols)} FROM __THIS__"),
            VectorAssembler(inputCols=[f"quarry_z{i}" for i in range(len(cols))], outputCol="features", handleInvalid="keep")], True


def linear_moments(enc: Encoded, fold: Column | None = None) -> dict[int, gram.Moments]:
    parts = gram.moments(enc.data, enc.x(), F.col(LABEL), fold)
    missing = sum(m.missing for m in parts.values())
    if missing:
        raise ValueError(f"{missing} rows have a missing feature or target: fill or drop them before the fit")
    return parts


def linear_pipeline(enc: Encoded, fit: gram.LinearFit) -> PipelineModel:
    """The pipeline of a solved linear model; its coefficients are those of the standardised features."""
    from quarry.models.custom import LinearFormModel

    stages, centred = _assemble(enc, fit.centre, fit.scale)
    intercept = fit.intercept if centred else fit.intercept - float(fit.weights @ (fit.centre / fit.scale))
    form = LinearFormModel(featuresCol="features", labelCol=LABEL, coefficients=[float(w) for w in fit.weights], intercept=intercept)
    return PipelineModel(stages=[*enc.stages, *stages, form])


def _spread(s: float | None) -> float:
    return s if s and s == s else 1.0  # constant → 0, like sklearn


def _fit_estimator(enc: Encoded, name: str, scale: bool, params: dict) -> tuple[PipelineModel, int]:
    """Models that need more than moments: population-std standardisation (one aggregate, applied as literals; vector
    inputs by StandardScaler × √(n/(n−1))), then the estimator's own passes."""
    exprs = [F.count(LABEL).alias("n")]
    flat = scale and not enc.vectors
    if flat:
        for i, c in enumerate(enc.inputs):
            x = qcol(c).cast("double")
            exprs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = enc.data.agg(*exprs).first()
    n = int(r["n"])
    if flat:
        centre = [r[f"m{i}"] or 0.0 for i in range(len(enc.inputs))]
        spread = [_spread(r[f"s{i}"]) for i in range(len(enc.inputs))]
        stages = _assemble(enc, centre, spread)[0]
    elif scale:
        stages, width = _raw(enc, "quarry_raw")
        f = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        stages += [StandardScaler(withMean=True, withStd=True, inputCol="quarry_raw", outputCol="quarry_ss"),
                   ElementwiseProduct(scalingVec=Vectors.dense([f] * width), inputCol="quarry_ss", outputCol="features")]
    else:
        stages, _width = _raw(enc, "features")
    fitted = Pipeline(stages=[*stages, make_regressor(name, LABEL, n, **params)]).fit(enc.data)
    return PipelineModel(stages=[*enc.stages, *fitted.stages]), n


def _fit_cells(enc: Encoded, name: str, scale: bool, params: dict) -> tuple[PipelineModel, int] | None:
    """A boosted fit on cells: one row for all rows of the same bins. A feature of more values than bins is cut at its
    quantiles, as Spark's trees do themselves on a sample of rows; any other keeps its values. Each tree's splits and
    leaves follow from the sums of the cells, so two scans serve all trees. None where the cells could be nearly as many
    as the rows, or where a feature or label is missing (the estimator's own checks tell)."""
    if enc.vectors or not enc.inputs:
        return None
    bins = int(params.get("max_bins", DEFAULT_MAX_BINS))
    x, y = [qcol(c).cast("double") for c in enc.inputs], F.col(LABEL)
    bad = [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in (*x, y)]
    exprs = [F.count("*").alias("n"), F.count_if(F.greatest(*[b.cast("int") for b in bad]) == 1).alias("bad")]
    for i, v in enumerate(x):
        exprs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"), F.approx_count_distinct(v).alias(f"d{i}")]
    r = enc.data.agg(*exprs).first()
    n, width = int(r["n"]), range(len(x))
    most = math.prod(min(r[f"d{i}"], bins) for i in width)
    if r["bad"] or not n or most * CELL_ROWS > n:
        return None
    cut = [i for i in width if r[f"d{i}"] > bins]
    edges = {}
    if cut:
        q = enc.data.agg(*[F.percentile_approx(x[i], [j / bins for j in range(1, bins)], 10_000).alias(f"q{i}") for i in cut]).first()
        edges = {i: sorted(set(q[f"q{i}"])) for i in cut}
    # the columns of the features: standardised values, or numbers of bins
    centre = [r[f"m{i}"] if scale else 0.0 for i in width]
    spread = [_spread(r[f"s{i}"]) if scale else 1.0 for i in width]
    values = [f"(CAST({_sql(c)} AS DOUBLE) - ({_lit(centre[i])})) / ({_lit(spread[i])}) AS `quarry_z{i}`" if i not in edges
              else f"CAST({_sql(c)} AS DOUBLE) AS `quarry_z{i}`" for i, c in enumerate(enc.inputs)]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(values)} FROM __THIS__")]
    if cut:
        stages.append(Bucketizer(splitsArray=[[-math.inf, *edges[i], math.inf] for i in cut], inputCols=[f"quarry_z{i}" for i in cut],
                                 outputCols=[f"quarry_b{i}" for i in cut], handleInvalid="keep"))
    names = [f"quarry_b{i}" if i in edges else f"quarry_z{i}" for i in width]
    rows = PipelineModel(stages=list(stages)).transform(enc.data)
    cells = rows.groupBy(*names).agg(F.avg(LABEL).alias(LABEL), F.count("*").cast("double").alias("quarry_weight"))
    path = f"{checkpoint_dir(enc.data.sparkSession).rstrip('/')}/quarry/cells-{uuid.uuid4().hex}"
    cells.repartition(max(1, min(int(enc.data.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // TASK_CELLS)))).write.parquet(path)
    cells = enc.data.sparkSession.read.schema(cells.schema).parquet(path)
    assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    fitted = make_regressor(name, LABEL, n, **params).setWeightCol("quarry_weight").fit(assemble.transform(cells))
    return PipelineModel(stages=[*enc.stages, *stages, assemble, fitted]), n


def result(enc: Encoded, pm: PipelineModel, name: str, features: Sequence[str], target: str, params: dict, n: int) -> FittedModel:
    extra = {}
    if enc.target_dictionary is not None:
        d = enc.target_dictionary
        if d.getOrDefault(d.labels) <= REPORTED_LABELS:
            extra["target_labels"] = [r["value"] for r in d.table(enc.data.sparkSession).orderBy("code").collect()]
    return FittedModel(pm, name, list(features), target, enc.names, {**DEFAULTS[name], **params, **extra}, n_train=n,
                       target_dictionary=enc.target_dictionary)


def degree_of(name: str, poly_degree: int | None, params: dict) -> tuple[int | None, dict]:
    """'polynomial' means polynomial terms + linear fit (what the name promises; the reference
    skipped the expansion for that model)."""
    rest = {k: v for k, v in params.items() if k != "degree"}
    if name == "polynomial" and not poly_degree:
        poly_degree = int(params.get("degree", DEFAULTS["polynomial"]["degree"]))
    return poly_degree, rest


def fit(df: DataFrame, features: Sequence[str], target: str, model: str = "linear", poly_degree: int | None = None,
        unknown: str = "zero", scale: bool = True, **params) -> FittedModel:
    """Fit the reference's recipe ``[poly] → StandardScaler → regressor`` on ``df``. The linear family refuses rows with
    a missing feature or target, in the scan that fits it."""
    name = canonical(model)
    poly_degree, params = degree_of(name, poly_degree, params)
    id_col = [params["id_col"]] if params.get("id_col") in df.columns else []
    enc = encode(df, features, target, poly_degree, unknown, keep=id_col)
    if name in gram.LINEAR_FAMILY:
        solved = gram.solve(name, gram.total_of(linear_moments(enc)), {**DEFAULTS[name], **params}, scale)
        pm, n = linear_pipeline(enc, solved), solved.n
    else:
        done = _fit_cells(enc, name, scale, params) if name in BOOSTED else None
        if done is None:
            # several passes over the encoded columns alone, persisted (MEMORY_AND_DISK, recomputed from lineage if an
            # executor is lost)
            enc.data = enc.data.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                done = _fit_estimator(enc, name, scale, params)
            finally:
                enc.data.unpersist()
        pm, n = done
    return result(enc, pm, name, features, target, {**params, "poly_degree": poly_degree}, n)


def importances(fm: FittedModel) -> list[tuple[str, float]]:
    """feature_importances_ if the model has them, else coefficients, else none. Names are
    the expanded feature names; generic names on a length mismatch."""
    last = fm.pipeline.stages[-1]
    vals = None
    if hasattr(last, "featureImportances"):
        vals = list(last.featureImportances.toArray())
    elif hasattr(last, "coefficients"):
        c = last.coefficients
        if isinstance(c, Param):  # this library's own linear models hold their weights as a parameter
            c = last.getOrDefault(c)
        if len(c) != len(fm.expanded):  # random features of a kernel are not the user's
            return []
        vals = list(c.toArray()) if hasattr(c, "toArray") else list(c)
    if vals is None:
        return []
    names = fm.expanded if len(fm.expanded) == len(vals) else [f"feature_{i}" for i in range(len(vals))]
    return list(zip(names, [float(v) for v in vals]))
