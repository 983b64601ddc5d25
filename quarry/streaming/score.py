"""Streaming batch-scoring (the M25 extension): a fitted model applied to a Structured
Streaming DataFrame. Scoring is stateless and narrow, so no watermark or state store is
needed; the sink is exactly-once through the checkpointed file sink or ``foreachBatch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.models.pipeline import FittedModel
from quarry.models.scoring import score
from quarry.session import scratch_path


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, max_files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """A streaming source over a folder of files (new files are new micro-batches)."""
    r = spark.readStream.format(fmt)
    if schema is None:
        schema = spark.read.format(fmt).options(**options).load(path).schema
    r = r.schema(schema)
    if _is_file(spark, path):
        # the file stream source lists folders or globs: match exactly this one file
        path = path[:-1] + "[" + path[-1] + "]"
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.options(**options).load(path)


def score_stream(fm: FittedModel, sdf: DataFrame, out: str = "Predicted_Value", fill_defaults: bool = False) -> DataFrame:
    """The same scoring plan as batch ``score``; ``isStreaming`` stays true."""
    return score(fm, sdf, out=out, fill_defaults=fill_defaults)


def start_parquet_sink(scored: DataFrame, path: str, checkpoint: str | None = None, trigger_once: bool = False) -> StreamingQuery:
    """Append scored rows to a Parquet folder with a checkpoint (exactly-once file sink)."""
    spark = scored.sparkSession
    w = scored.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")).option("path", path)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def run_to_completion(scored: DataFrame, path: str | None = None) -> DataFrame:
    """Drive a stream over everything currently available (availableNow trigger) into a
    Parquet folder under the shared checkpoint folder and return the written rows."""
    spark = scored.sparkSession
    path = path or scratch_path(spark, "stream-out")
    q = start_parquet_sink(scored, path, trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(path)
