"""Model registry and run history.

A registry is a folder on shared storage: each save writes a folder of its own,
``models/<version>/`` (the PipelineModel with all tables that its stages need, and the target's
dictionary), and only then one row to ``registry/``, an append-only Parquet table (a delete appends a
tombstone). That row is the one commit point: a save that fails before it leaves the older versions
as they are. ``runs/`` is an append-only table of training-run records. Readers take the
latest row per name; every version whose row is there stays loadable.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.models.dictionary import LabelDictionaryModel
from quarry.models.pipeline import FittedModel
from quarry.session import checkpoint_dir, path_exists

_REG_SCHEMA = ("name string, model string, features string, target string, expanded string, params string, "
               "defaults string, metrics string, path string, created_at timestamp, deleted boolean, version string, "
               "n_train bigint, has_target_table boolean")
_RUN_SCHEMA = ("run_id string, model string, created_at timestamp, train_r2 double, test_r2 double, train_mse double, "
               "test_mse double, cv_r2_mean double, cv_r2_std double, cv_mse_mean double, cv_mse_std double, "
               "n_features bigint, n_train bigint, n_test bigint, params string")


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{checkpoint_dir(spark).rstrip('/')}/quarry/registry").rstrip("/")

    # ------------------------------------------------------------ models
    def _stored(self, folder: str, schema: str) -> DataFrame:
        path = f"{self.root}/{folder}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, folder: str, schema: str, record: dict) -> None:
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        row = self.spark.createDataFrame([tuple(record.get(c) for c in names)], schema)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/{folder}")

    def _table(self) -> DataFrame:
        return self._stored("registry", _REG_SCHEMA)

    def save(self, fm: FittedModel, name: str, metrics: dict | None = None) -> str:
        """A folder for this version, then its metadata row."""
        version = uuid.uuid4().hex
        path = f"{self.root}/models/{version}"
        fm.pipeline.write().save(f"{path}/pipeline")
        if fm.target_dictionary is not None:
            fm.target_dictionary.write().save(f"{path}/target")
        self._append("registry", _REG_SCHEMA, {
            "name": name, "model": fm.model_name, "features": json.dumps(fm.features), "target": fm.target, "expanded": json.dumps(fm.expanded),
            "params": json.dumps(fm.params, default=str), "defaults": json.dumps(fm.defaults, default=str),
            "metrics": json.dumps(metrics or {}, default=str), "path": path, "created_at": _now(), "deleted": False, "version": version,
            "n_train": fm.n_train, "has_target_table": fm.target_dictionary is not None})
        return path

    def list(self) -> DataFrame:
        """Latest live row per model name, newest first."""
        w = Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("version"))
        t = self._table().withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
        return t.filter(~F.col("deleted")).orderBy(F.desc("created_at"))

    def versions(self, name: str) -> DataFrame:
        """Every version saved under a name, newest first (deleted names too)."""
        return self._table().filter((F.col("name") == name) & ~F.col("deleted")).orderBy(F.desc("created_at"), F.desc("version"))

    def details(self, name: str, version: str | None = None) -> dict:
        found = self.list() if version is None else self.versions(name).filter(F.col("version") == version)
        rows = found.filter(F.col("name") == name).limit(1).collect()
        if not rows:
            raise KeyError(name if version is None else f"{name} {version}")
        r = rows[0].asDict()
        for k in ("features", "expanded", "params", "defaults", "metrics"):
            r[k] = json.loads(r[k])
        return r

    def load(self, name: str, version: str | None = None) -> FittedModel:
        """Pipeline + features, target, expanded names and scoring defaults, of the latest or the named version."""
        r = self.details(name, version)
        target = LabelDictionaryModel.load(f"{r['path']}/target") if r["has_target_table"] else None
        return FittedModel(PipelineModel.load(f"{r['path']}/pipeline"), r["model"], r["features"], r["target"], r["expanded"], r["params"],
                           r["defaults"], r["n_train"] or 0, target)

    def delete(self, name: str) -> None:
        """Tombstone row (the folders are left for the storage's own retention)."""
        r = self.details(name)
        for k in ("features", "expanded", "params", "defaults", "metrics"):
            r[k] = json.dumps(r[k])
        self._append("registry", _REG_SCHEMA, {**r, "created_at": _now(), "deleted": True, "version": uuid.uuid4().hex})

    # ------------------------------------------------------------ runs
    def runs(self) -> DataFrame:
        return self._stored("runs", _RUN_SCHEMA)

    def next_run_id(self, model_label: str) -> str:
        """``<Model>_Run<n>``."""
        n = self.runs().filter(F.col("model") == model_label).count()
        return f"{model_label.replace(' ', '_')}_Run{n + 1}"

    def append_run(self, record: dict) -> None:
        """One row per training run."""
        self._append("runs", _RUN_SCHEMA, record)

    def history(self) -> DataFrame:
        """Run history, newest first."""
        return self.runs().orderBy(F.desc("created_at"), F.desc("run_id"))
