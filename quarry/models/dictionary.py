"""Label dictionaries as pipeline stages (E4–E6): string → code, for any number of labels.

The state of a fitted dictionary is a Parquet table (value, code), not a list: fitting builds it with a distributed
distinct and sort, scoring joins it (broadcast while its measured bytes are few, else a shuffle join whose hot values
AQE splits), saving the model copies it into the model's folder and loading reads it from there. The driver and the
query plan hold its path, its number of labels and its bytes.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import qcol
from quarry.models.tables import TableState
from quarry.operators.encode import build_dictionary
from quarry.operators.quantiles import BROADCAST_BYTES, table_bytes
from quarry.session import scratch_path


class _DictionaryParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "string column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "code column", typeConverter=TypeConverters.toString)
    unknown = Param(Params._dummy(), "unknown", "zero|error|null, for labels not in the table", typeConverter=TypeConverters.toString)
    labels = Param(Params._dummy(), "labels", "number of labels", typeConverter=TypeConverters.toInt)
    tableBytes = Param(Params._dummy(), "tableBytes", "bytes of the table's values", typeConverter=TypeConverters.toInt)


class LabelDictionaryModel(Model, _DictionaryParams, TableState):
    """outputCol = the code of inputCol's label as double; a missing or unknown label is 0 ('zero'), null ('null') or an
    error at run time ('error')."""

    TABLE = "value string, code bigint"

    @keyword_only
    def __init__(self, inputCol="", outputCol="", unknown="zero", tablePath="", labels=0, tableBytes=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _join(self, df: DataFrame, table: DataFrame, on) -> DataFrame:
        small = self.getOrDefault(self.tableBytes) <= BROADCAST_BYTES
        return df.join(F.broadcast(table) if small else table, on, "left")

    def _transform(self, df: DataFrame) -> DataFrame:
        name, out, unknown = (self.getOrDefault(p) for p in (self.inputCol, self.outputCol, self.unknown))
        code, value = f"{self.uid}_code", f"{self.uid}_value"
        t = self.table(df.sparkSession).select(F.col("value").alias(value), F.col("code").cast("double").alias(code))
        got = self._join(df, t, qcol(name).cast("string") == F.col(value))
        told = F.col(code)
        if unknown == "zero":
            told = F.coalesce(told, F.lit(0.0))
        elif unknown == "error":
            said = F.concat(F.lit(f"{name}: no such label "), F.coalesce(qcol(name).cast("string"), F.lit("(missing)")))
            told = F.when(told.isNull(), F.raise_error(said).cast("double")).otherwise(told)
        return got.select(*[qcol(c) for c in df.columns if c != out], told.alias(out))

    def decode(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        """The label of the rounded code in ``col`` (null beyond the table), as ``out`` or in its place."""
        out = out or col
        code, value = f"{self.uid}_code", f"{self.uid}_value"
        t = self.table(df.sparkSession).select(F.col("value").alias(value), F.col("code").alias(code))
        got = self._join(df, t, F.round(qcol(col)).cast("bigint") == F.col(code))
        columns = [F.col(value).alias(c) if c == out else qcol(c) for c in df.columns]
        return got.select(*columns, *([] if out in df.columns else [F.col(value).alias(out)]))


class LabelDictionary(Estimator, _DictionaryParams):
    """Fit the codes 0..k−1 of inputCol's labels in code-point order; missing labels get none."""

    @keyword_only
    def __init__(self, inputCol="", outputCol="", unknown="zero"):
        super().__init__()
        self._setDefault(unknown="zero")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LabelDictionaryModel:
        spark, name = df.sparkSession, self.getOrDefault(self.inputCol)
        path = scratch_path(spark, "labels")
        build_dictionary(df.where(qcol(name).isNotNull()), name).write.parquet(path)
        size = table_bytes(spark.read.parquet(path))
        return LabelDictionaryModel(inputCol=name, outputCol=self.getOrDefault(self.outputCol), unknown=self.getOrDefault(self.unknown),
                                    tablePath=path, labels=size.rows, tableBytes=size.bytes)
