"""Column/row filters, missing-value imputation, duplicates and sorting (F*, I*, R*, O1, O7).

Statistics for imputation come from one aggregate pass (null counts + means), the exact
quantile primitive (medians) and the bounded mode primitive; the fill itself is a narrow
``withColumns`` projection. Only columns that actually contain a missing value are touched.
NaN counts as missing everywhere (the reference does not distinguish the two).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import classify, qcol, string_columns
from quarry.operators.quantiles import column_quantiles, grouped_mode, long_numeric

NUMERIC_STRATEGIES = ("mean", "median", "mode", "zero", "specific", "constant", "drop_col", "drop_row", "none")
CATEGORICAL_STRATEGIES = ("mode", "constant", "drop_col", "drop_row", "none")


def _missing(c: str, dt: T.DataType):
    x = qcol(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def _clean(c: str, dt: T.DataType):
    x = qcol(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(x), None).otherwise(x)
    return x


# ---------------------------------------------------------------- column / row filters


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop named columns; unknown names are ignored; dropping every column is refused."""
    valid = [c for c in cols if c in df.columns]
    if len(set(cols)) >= len(df.columns) or len(valid) >= len(df.columns):
        raise ValueError("cannot remove all columns")
    return df.drop(*valid) if valid else df


def select_features(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """features + target with the reference's checks."""
    features = list(features)
    if not features:
        raise ValueError("select at least one feature")
    if target in features:
        raise ValueError("the target must not be a feature")
    missing = [c for c in features + [target] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[qcol(c) for c in features], qcol(target))


def target_candidates(df: DataFrame) -> list[str]:
    """numeric columns if any, else all columns."""
    cls = classify(df.schema)
    num = [c for c, k in cls.items() if k == "numeric"]
    return num or list(df.columns)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, tuple[int, int]]:
    """{column: (missing, rows)} from one aggregate per 200 columns (a bounded summary)."""
    cols = list(cols) if cols is not None else list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = {}
    for start in range(0, len(cols), 200):  # ≤ 200 aggregates per pass stays inside codegen
        batch = cols[start : start + 200]
        row = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count_if(_missing(c, types[c])).alias(f"m{i}") for i, c in enumerate(batch)]).first()
        out.update({c: (row[f"m{i}"], row["_rows"]) for i, c in enumerate(batch)})
    return out


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """drop columns that are 100 % missing (pinned: an empty table keeps its columns)."""
    nc = null_counts(df)
    drop = [c for c, (m, n) in nc.items() if n > 0 and m == n]
    return df.drop(*drop) if drop else df


def drop_columns_by_null_share(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """drop columns whose missing share is strictly greater than ``threshold``."""
    nc = null_counts(df)
    drop = [c for c, (m, n) in nc.items() if n > 0 and m / n > threshold]
    return df.drop(*drop) if drop else df


def drop_rows_with_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing (NULL or NaN) value in ``subset`` (default: all columns)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(subset) if subset is not None else list(df.columns)
    if not cols:
        return df
    cond = None
    for c in cols:
        m = _missing(c, types[c])
        cond = m if cond is None else (cond | m)
    return df.filter(~cond)


# ---------------------------------------------------------------- imputation


def fill_values(df: DataFrame, cols: Sequence[str], strategy: str, value=None, empty_default=None) -> dict[str, object]:
    """Fill value per column for ``strategy`` in mean/median/mode/zero/specific/constant.

    mean: one aggregate; median: exact distributed quantiles; mode: bounded grouped mode
    (ties → smallest). A column without any value gets ``empty_default`` (mean/median → NULL,
    i.e. the column stays missing, like pandas).
    """
    cols = list(cols)
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    if strategy in ("zero",):
        return {c: 0.0 for c in cols}
    if strategy in ("specific", "constant"):
        return {c: value for c in cols}
    if strategy == "mean":
        row = df.agg(*[F.avg(_clean(c, types[c])).alias(f"a{i}") for i, c in enumerate(cols)]).first()
        return {c: row[f"a{i}"] for i, c in enumerate(cols)}
    if strategy == "median":
        q = column_quantiles(df, cols, [0.5])
        return {c: q[c][0] for c in cols}
    if strategy == "mode":
        # whole numbers as they are: beyond 2^53 doubles would merge neighbours
        whole = [c for c in cols if isinstance(types[c], T.IntegralType)]
        num = [c for c in cols if isinstance(types[c], T.NumericType) and c not in whole]
        oth = [c for c in cols if c not in num and c not in whole]
        out = {}
        if whole:
            vals = [F.struct(F.lit(c).alias("column"), qcol(c).cast("bigint").alias("value")) for c in whole]
            longs = df.select(F.explode(F.array(*vals)).alias("_s")).select("_s.column", "_s.value")
            out.update({r["column"]: r["mode"] for r in grouped_mode(longs, ["column"], "value").collect()})
        if num:
            m = grouped_mode(long_numeric(df, num), ["column"], "value")
            out.update({r["column"]: r["mode"] for r in m.collect()})
        if oth:
            vals = [F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")) for c in oth]
            longs = df.select(F.explode(F.array(*vals)).alias("_s")).select("_s.column", "_s.value")
            m = grouped_mode(longs, ["column"], "value")
            out.update({r["column"]: r["mode"] for r in m.collect()})
        return {c: out.get(c, empty_default) for c in cols}
    raise ValueError(f"unknown fill strategy {strategy!r}")


def apply_fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Narrow projection: ``coalesce(col, value)``; numeric columns become double (pandas turns an
    int column holding a missing value into float)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for c, v in values.items():
        if v is None:
            continue
        dt = types[c]
        if isinstance(dt, T.NumericType):
            new[c] = F.coalesce(_clean(c, dt).cast("double"), F.lit(float(v)))
        else:
            new[c] = F.coalesce(qcol(c).cast("string"), F.lit(str(v)))
    return df.withColumns(new) if new else df


def impute(df: DataFrame, cols: Sequence[str] | None, strategy: str, value=None, *, only_missing: bool = True,
           empty_default=None) -> DataFrame:
    """Fill missing values of ``cols`` (default: all numeric for numeric strategies, all
    string columns for categorical) with one strategy. Only columns with a missing value change."""
    cls = classify(df.schema)
    if cols is None:
        cols = [c for c, k in cls.items() if k == "numeric"] if strategy in ("mean", "median", "zero") else string_columns(df) if strategy == "mode" else list(df.columns)
    cols = list(cols)
    if only_missing:
        nc = null_counts(df, cols)
        cols = [c for c in cols if nc[c][0] > 0]
    return apply_fill(df, fill_values(df, cols, strategy, value, empty_default))


def handle_missing(df: DataFrame, numeric_strategy: str = "median", numeric_specific_value: float = 0.0,
                   categorical_strategy: str = "mode", categorical_constant_value: str = "Unknown",
                   drop_col_threshold: float = 0.5) -> DataFrame:
    """I9 (util composite): F5 → numeric strategy → categorical strategy → F7 if either is drop_row.

    numeric: mean, median, mode (all-missing → ``numeric_specific_value``), zero, specific, drop_col.
    categorical (string columns): mode (all-missing → ``categorical_constant_value``), constant, drop_col.
    """
    if numeric_strategy not in NUMERIC_STRATEGIES or categorical_strategy not in CATEGORICAL_STRATEGIES:
        raise ValueError("unknown strategy")
    nc = null_counts(df)
    drop = [c for c, (m, n) in nc.items() if n > 0 and m / n > drop_col_threshold]
    out = df.drop(*drop) if drop else df
    cls = classify(out.schema)
    num = [c for c in out.columns if cls[c] == "numeric" and nc[c][0] > 0]
    cat = [c for c in string_columns(out) if nc[c][0] > 0]
    # both strategies see the frame after the column drop; fills do not change the other class's stats
    fills: dict[str, object] = {}
    drop_cols: list[str] = []
    if numeric_strategy == "drop_col":
        drop_cols += num
    elif numeric_strategy in ("mean", "median", "mode", "zero", "specific", "constant"):
        fills.update(fill_values(out, num, numeric_strategy, numeric_specific_value, numeric_specific_value))
    if categorical_strategy == "drop_col":
        drop_cols += cat
    elif categorical_strategy in ("mode", "constant"):
        fills.update(fill_values(out, cat, categorical_strategy, categorical_constant_value, categorical_constant_value))
    out = apply_fill(out, {k: v for k, v in fills.items() if k not in drop_cols})
    if drop_cols:
        out = out.drop(*drop_cols)
    if numeric_strategy == "drop_row" or categorical_strategy == "drop_row":
        out = drop_rows_with_missing(out)
    return out


def gui_clean_missing(df: DataFrame, numeric: str = "None", categorical: str = "None", numeric_value: str | float = "",
                      categorical_value: str = "", drop_all_null_cols: bool = False,
                      drop_any_null_rows: bool = False) -> DataFrame:
    """I8 (GUI composite), in the reference's order:
    (1) drop all-missing columns, (2) numeric ∈ None/Mean/Median/Mode/Fill Specific/Remove Rows,
    (3) categorical ∈ None/Mode/Fill Specific/Remove Rows — its statistics are taken *after* step 2's
    row removal, (4) drop rows with any missing value."""
    out = drop_all_null_columns(df) if drop_all_null_cols else df
    cls = classify(out.schema)
    num = [c for c in out.columns if cls[c] == "numeric"]
    cat = string_columns(out)
    if numeric != "None" and num:
        if numeric == "Remove Rows with NaN":
            out = drop_rows_with_missing(out, num)
        else:
            if numeric == "Fill Specific":
                v = float(numeric_value) if str(numeric_value).strip() else 0.0
                out = impute(out, num, "specific", v)
            else:
                strat = {"Mean": "mean", "Median": "median", "Mode": "mode"}[numeric]
                out = impute(out, num, strat, empty_default=0.0)
    if categorical != "None" and cat:
        if categorical == "Remove Rows with NaN":
            out = drop_rows_with_missing(out, cat)
        elif categorical == "Mode":
            out = impute(out, cat, "mode", empty_default="Unknown")
        elif categorical == "Fill Specific":
            out = impute(out, cat, "constant", categorical_value)
    if drop_any_null_rows:
        out = drop_rows_with_missing(out)
    return out


def training_clean(df: DataFrame, fill_method_numeric: str = "median", fill_method_object: str = "mode",
                   remove_duplicates: bool = True) -> DataFrame:
    """Numeric median/mean (else 0), strings mode (else 'Unknown'), then R1 on these columns."""
    out = apply_fill(df, training_fills(df, fill_method_numeric, fill_method_object))
    return drop_duplicates(out) if remove_duplicates else out


def training_fills(df: DataFrame, fill_method_numeric: str = "median", fill_method_object: str = "mode") -> dict[str, object]:
    """The fill value of each column of ``df`` with a missing value."""
    cls = classify(df.schema)
    num = [c for c in df.columns if cls[c] == "numeric"]
    cat = string_columns(df)
    nc = null_counts(df, num + cat)
    num = [c for c in num if nc[c][0] > 0]
    cat = [c for c in cat if nc[c][0] > 0]
    fills = {}
    if fill_method_numeric in ("median", "mean"):
        fills.update(fill_values(df, num, fill_method_numeric))
    else:
        fills.update({c: 0.0 for c in num})
    if fill_method_object == "mode":
        fills.update(fill_values(df, cat, "mode", empty_default="Unknown"))
    else:
        fills.update({c: "Unknown" for c in cat})
    return fills


def scoring_fill(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Any remaining missing numeric value → 0 (narrow)."""
    cls = classify(df.schema)
    cols = list(cols) if cols is not None else [c for c in df.columns if cls[c] == "numeric"]
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(_clean(c, types[c]), F.lit(0).cast(types[c])) for c in cols})


# ---------------------------------------------------------------- duplicates


def drop_duplicates(df: DataFrame, keep: str | bool = "first", subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-row duplicates (NULL equals NULL, NaN equals NaN).

    ``keep='first'`` or ``'last'`` keep one copy (the copies are identical, so which one is
    immaterial); ``keep=False`` drops every member of a duplicated group. Both are one hash
    aggregate with map-side combine, so a hot group of copies collapses before the shuffle.
    """
    cols = list(subset) if subset is not None else list(df.columns)
    if keep in ("first", "last"):
        return df.dropDuplicates(cols) if subset is not None else df.dropDuplicates()
    if keep is False or keep == "none":
        if subset is not None and set(cols) != set(df.columns):
            singles = df.groupBy(*[qcol(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
            return df.join(singles, on=cols, how="left_semi")
        return (
            df.groupBy(*[qcol(c) for c in df.columns])
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == 1)
            .drop("_n")
        )
    raise ValueError(f"keep must be 'first', 'last' or False, got {keep!r}")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of rows a keep-first de-duplication removes — one aggregate over the groups."""
    g = df.groupBy(*[qcol(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates_removed"))


# ---------------------------------------------------------------- sort / head


def sort_stable(df: DataFrame, col: str, ascending: bool = True) -> DataFrame:
    """O1: sort by one column, missing last in both directions, ties in input order.

    Input order is captured with ``monotonically_increasing_id`` (partition, offset) before the
    range-partitioned global sort, so the sort stays distributed and stable.
    """
    x = qcol(col)
    o = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    if isinstance(dict((f.name, f.dataType) for f in df.schema.fields)[col], (T.DoubleType, T.FloatType)):
        # NaN is missing: sort it with the NULLs
        o = F.asc_nulls_last(F.when(F.isnan(x), None).otherwise(x)) if ascending else \
            F.desc_nulls_last(F.when(F.isnan(x), None).otherwise(x))
    return df.withColumn("_ord", F.monotonically_increasing_id()).orderBy(o, F.col("_ord")).drop("_ord")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """Preview of the first rows."""
    return df.limit(n)
