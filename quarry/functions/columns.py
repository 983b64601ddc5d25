"""Column-expression helpers shared by all operators (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qcol(name: str) -> Column:
    """A column reference that tolerates spaces, dots, slashes and parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    # booleans are not numeric here (pinned: profiled as categorical, never imputed/scaled)
    return isinstance(dt, T.NumericType)


def is_categorical(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def classify(schema: T.StructType) -> dict[str, str]:
    """type class per column — 'numeric', 'categorical', 'temporal' or 'other'."""
    out = {}
    for f in schema.fields:
        if is_numeric(f.dataType):
            out[f.name] = "numeric"
        elif is_categorical(f.dataType):
            out[f.name] = "categorical"
        elif is_temporal(f.dataType):
            out[f.name] = "temporal"
        else:
            out[f.name] = "other"
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_type_class(df: DataFrame, kind: str = "numeric") -> DataFrame:
    """project the columns of one type class ('numeric', 'categorical', 'all')."""
    if kind == "all":
        return df
    cls = classify(df.schema)
    return df.select(*[qcol(c) for c, k in cls.items() if k == kind])


def g1_skew(pop_skew: Column, n: Column) -> Column:
    """Bias-corrected sample skewness G1 from Spark's population skewness g1.

    G1 = g1 * sqrt(n (n-1)) / (n-2); NULL when n <= 2 or the column is constant.
    """
    nd = n.cast("double")
    return F.when(n > 2, F.try_divide(pop_skew * F.sqrt(nd * (nd - 1)), nd - 2))


def hash_bucket(*key_cols: Column | str, buckets: int = 100) -> Column:
    """Deterministic bucket in [0, buckets) of a row key: the first 32 bits of md5 of the
    '-'-joined key, mod ``buckets``. Identical in DuckDB, so splits are oracle-checkable."""
    key = F.concat_ws("-", *[qcol(c) if isinstance(c, str) else c for c in key_cols])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("bigint")


def validate_columns(df: DataFrame, required=(), numeric=(), categorical=(), non_empty: bool = False) -> None:
    """column existence/type checks on the driver (schema only, no job),
    emptiness via ``isEmpty`` only when asked."""
    cols = set(df.columns)
    missing = [c for c in list(required) + list(numeric) + list(categorical) if c and c not in cols]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [c for c in numeric if c and not is_numeric(types[c])]
    if bad:
        raise TypeError(f"columns must be numeric: {bad}")
    badc = [c for c in categorical if c and is_numeric(types[c])]
    if badc:
        raise TypeError(f"columns must be categorical: {badc}")
    if non_empty and df.isEmpty():
        raise ValueError("the table is empty")
