"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.session import checkpoint_dir

#: Java and RE2 pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Spark removes a job's shuffle files when it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet under the folder in spark.checkpoint.dir and read it again. Once the table
    is written nothing reads the shuffles that made it, so they go at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/quarry-llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table of ``stored`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getParent().getName() == "quarry-llm":
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remainder(id_col: str, k: int):
    """crc32 of the id's text, modulo ``k`` (a null id counts as the empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % k


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow with a generator of column dicts; empty batches are skipped."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        drop_old_state()
        try:
            for cols in fn(b for b in batches if b.num_rows):
                yield pa.RecordBatch.from_arrays(
                    [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], type=f.type) for f in out],
                    schema=out)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def _state() -> dict:
    home = sys.modules.setdefault("_quarry_llm_state", types.ModuleType("_quarry_llm_state"))
    return home.__dict__.setdefault("held", {})


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task does not hold what the last took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def drop_old_state() -> None:
    """At the beginning of a task: a worker that comes from another stage gives up what it kept for it."""
    from pyspark import TaskContext

    held, task = _state(), TaskContext.get()
    stage = None if task is None else task.stageId()
    if held.get("stage", stage) != stage:
        held.clear()
        give_back()
    held["stage"] = stage


def worker_state(key, build):
    """A value that a Python worker keeps between its tasks of one stage (a cache or a loaded tokenizer). It keeps one at
    a time, so the caches of one operator don't add to another's."""
    held = _state()
    stage = held.get("stage")
    if key not in held:
        held.clear()
        held.update({key: build(), "stage": stage})
    return held[key]


def slices(batches, size: int = 512):
    """Batches of few rows, so that what a task holds for one doesn't grow with Arrow's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def as_list(values, offsets, typ) -> pa.Array:
    """A list column from its flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=typ))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


#: Counts below this are told apart; above, 256 steps for every doubling.
EXACT_COUNTS = 4096


def frequent_from(counted: DataFrame, most: int, n_col: str = "n") -> int:
    """The least count that at most ``most`` rows of ``counted`` reach: a filter for the most frequent ones that needs no
    sort. One row for each step of the scale comes to the driver."""
    n = F.col(n_col).cast("double")
    step = F.when(n < EXACT_COUNTS, n).otherwise(EXACT_COUNTS + F.floor(F.log2(n / EXACT_COUNTS) * 256)).cast("long")
    cut, held = None, 0
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min(n_col).alias("least")).collect(), reverse=True):
        held += r["rows"]
        if held > most:
            break
        cut = r["least"]
    return cut if cut is not None else 1 << 62
