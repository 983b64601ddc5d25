"""Categorical encoding.

Label codes are 0..k−1 in code-point order of the string values. The dictionary is built
distributed: distinct values (a partial-aggregated shuffle), a range-partitioned sort, and
per-partition offsets (one small row per partition) — no global window, no driver-side list,
so it works for dictionaries far larger than driver memory. It is joined back to the data:
broadcast when its (counted) size is small, otherwise a shuffle join whose hot values AQE
splits.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import qcol, string_columns
from quarry.operators.quantiles import join_small
from quarry.session import ensure_checkpoint_dir

MAX_ONEHOT_LEVELS = 25  # fixed value: one-hot only when a column has fewer distinct values


def _as_label_string(col: str):
    # astype(str) semantics: a missing value becomes its own category 'nan'
    return F.coalesce(qcol(col).cast("string"), F.lit("nan"))


def build_dictionary(df: DataFrame, col: str, value_col: str = "value", index_col: str = "code") -> DataFrame:
    """Distinct values of ``col`` (missing → 'nan') with dense codes in sorted order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = df.select(_as_label_string(col).alias(value_col)).distinct()
    nparts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = (
        d.repartitionByRange(nparts, value_col)
        .sortWithinPartitions(value_col)
        .select(value_col, F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
        .checkpoint(eager=True)
    )
    # offsets: one row per partition
    sizes = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = {r["_pid"]: r["_n"] for r in sizes.collect()}
    acc, start = 0, {}
    for pid in sorted(offs):
        start[pid] = acc
        acc += offs[pid]
    if not start:
        return d.select(value_col, F.lit(0).cast("bigint").alias(index_col)).limit(0)
    off_map = F.create_map(*[x for pid, s in start.items() for x in (F.lit(pid), F.lit(s))])
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return d.select(value_col, (off_map[F.col("_pid")] + pos).cast("bigint").alias(index_col))


def label_encode(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Replace each column by its code; returns (df, {column: dictionary DataFrame})."""
    cols = list(cols) if cols is not None else string_columns(df)
    out, dicts = df, {}
    for c in cols:
        if c not in out.columns:
            warnings.warn(f"nothing to encode: no column {c!r}")
            continue
        d = build_dictionary(out, c, "_lv", "_code")
        dicts[c] = d.withColumnRenamed("_lv", "value").withColumnRenamed("_code", "code")
        others = [x for x in out.columns]
        out = (
            join_small(out.withColumn("_lv", _as_label_string(c)), d, ["_lv"], "left")
            .select(*[F.col("_code").alias(x) if x == c else qcol(x) for x in others])
        )
    return out, dicts


def one_hot(df: DataFrame, cols: Sequence[str] | None = None, drop_first: bool = True,
            max_levels: int = MAX_ONEHOT_LEVELS) -> tuple[DataFrame, dict[str, list[str]]]:
    """``<col>_<value>`` boolean columns in sorted value order, first dropped by default,
    missing → all False, source column removed, new columns appended. Columns with
    ``max_levels`` or more distinct values are skipped with a warning. The level check pulls at
    most ``max_levels`` values to the driver."""
    cols = list(cols) if cols is not None else string_columns(df)
    out, info = df, {}
    for c in cols:
        if c not in out.columns:
            warnings.warn(f"nothing to encode: no column {c!r}")
            continue
        levels = [r[0] for r in out.select(qcol(c)).filter(qcol(c).isNotNull()).distinct().limit(max_levels).collect()]
        if len(levels) >= max_levels:
            warnings.warn(f"{c!r} has {max_levels} distinct values or more and gets no indicator columns")
            continue
        levels = sorted(levels, key=lambda v: (str(v).encode("utf-8")) if isinstance(v, str) else v)
        keep = levels[1:] if drop_first else levels
        new = {f"{c}_{v}": F.coalesce(qcol(c) == F.lit(v), F.lit(False)) for v in keep}
        out = out.withColumns(new).drop(c)
        info[c] = list(new)
    return out, info


def encode(df: DataFrame, cols: Sequence[str] | None = None, method: str = "label", drop_first: bool = True):
    """Method 'label', 'onehot' or 'dummy' (the last two are the same operation)."""
    if method == "label":
        return label_encode(df, cols)
    if method in ("onehot", "dummy"):
        return one_hot(df, cols, drop_first)
    raise ValueError(f"unknown encoding {method!r}: label, onehot and dummy are known")


def apply_dictionary(df: DataFrame, col: str, dictionary: DataFrame, unknown: str = "zero") -> DataFrame:
    """E5: scoring-time encoding with a fitted dictionary (value, code).

    unknown='zero' reproduces the reference (unknown → missing → 0, the first category);
    unknown='error' raises at run time; unknown='null' leaves it missing.
    """
    d = dictionary.select(F.col("value").alias("_lv"), F.col("code").alias("_code"))
    others = list(df.columns)
    j = join_small(df.withColumn("_lv", F.coalesce(qcol(col).cast("string"), F.lit("nan"))), d, ["_lv"], "left")
    if unknown == "zero":
        code = F.coalesce(F.col("_code"), F.lit(0).cast("bigint"))
    elif unknown == "error":
        code = F.when(F.col("_code").isNull(), F.raise_error(F.concat(F.lit(f"unknown category in {col}: "), F.col("_lv")))).otherwise(F.col("_code"))
    else:
        code = F.col("_code")
    return j.select(*[code.alias(x) if x == col else qcol(x) for x in others])


def decode(df: DataFrame, col: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """Map a (rounded) class index back to its label."""
    out = out or col
    d = dictionary.select(F.col("code").alias("_code"), F.col("value").alias("_lv"))
    j = join_small(df.withColumn("_code", F.round(qcol(col)).cast("bigint")), d, ["_code"], "left")
    keep = [qcol(c) for c in df.columns if c != out]
    return j.select(*keep, F.col("_lv").alias(out))
