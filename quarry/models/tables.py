"""Fitted models whose state is a Parquet table: saved with the model, read from its folder when loaded."""

from __future__ import annotations

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class _Writer(MLWriter):
    def __init__(self, instance: "TableState"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        # copied by the executors, whatever its size
        self.instance.table(self.sparkSession).write.parquet(f"{path}/table")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> "TableState":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out._set(tablePath=f"{path}/table")


class TableState(Params, MLReadable, MLWritable):
    """Mixin of a model: its table lies at ``tablePath`` and has the columns of ``TABLE``."""

    TABLE = ""
    tablePath = Param(Params._dummy(), "tablePath", "Parquet table of the model's state", typeConverter=TypeConverters.toString)

    def table(self, spark) -> DataFrame:
        return spark.read.schema(self.TABLE).parquet(self.getOrDefault(self.tablePath))

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)
