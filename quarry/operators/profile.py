"""Column profiling and plain aggregates.

``profile`` = one wide partial aggregate (counts, mean, std, min, max, skewness for every
column, batched so each aggregate stays inside whole-stage codegen) + exact quantiles from the
bounded-state primitive in ``quantiles.py`` + one ``groupBy(column, value)`` shuffle for distinct
count / mode of the non-numeric columns. The driver never sees more than one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import classify, g1_skew, qcol
from quarry.operators.pairwise import correlations
from quarry.operators.quantiles import grouped_mode, grouped_quantiles, long_numeric

PROFILE_COLUMNS = [
    "column", "data_type", "count", "null_count", "null_pct", "unique", "mean", "median", "std",
    "min", "max", "q25", "q75", "skewness", "top", "freq_top", "first", "last",
]



def _clean_num(name: str):
    x = qcol(name).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def profile(df: DataFrame, cols: Sequence[str] | None = None, *, exact: bool = True, **qkw) -> DataFrame:
    """A1: one row per column with the reference's summary fields (NULL where not applicable).

    Numeric columns: count, missing, mean, median, sample std, min, max, 25 %, 75 %, G1 skewness.
    String / boolean / temporal columns: count, missing, distinct count, most frequent value (ties →
    smallest; cut to 50 characters + '...') and its frequency; temporal columns also their first
    and last value. NaN counts as missing.

    Plan: the numeric columns are unpivoted (an Expand, no shuffle) and ALL their statistics ride
    in the first pass of the exact-quantile primitive (one partial aggregate per column: count,
    mean, std, min, max, skewness + sketch), followed by its two bounded passes; the other
    columns take one ``groupBy(column, value)`` pass (distinct count, mode, non-missing count,
    extent). The row total is a metadata count. The driver sees one row per column.

    Strings are counted by digest (SHA-256) beside the part that is shown, so a value of any length moves at most
    SHOWN + 1 characters. ``exact=False`` replaces every shuffle of values by mergeable sketches: quantiles by
    ``percentile_approx``, distinct counts by HyperLogLog++ (relative deviation SKETCH_RSD), most frequent values by
    Spark's frequent-items sketch (frequencies off by at most SKETCH_ERROR of the column's values; where
    none is that frequent any value may be shown; if the sketch names none, the smallest with frequency 1).
    """
    spark = df.sparkSession
    cols = list(cols) if cols is not None else list(df.columns)
    if not cols:
        return spark.createDataFrame([], _profile_schema())
    cls = classify(df.schema)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    num = [c for c in cols if cls[c] == "numeric"]
    other = [c for c in cols if cls[c] != "numeric"]
    temporal = [c for c in other if cls[c] == "temporal"]
    total = df.count()

    order = spark.createDataFrame([(c, types[c], i) for i, c in enumerate(cols)],
                                  "column string, data_type string, _ord int")
    dnull = F.lit(None).cast("double")
    if num:
        extra = {"_mean": F.avg, "_std": F.stddev_samp, "_min": F.min, "_max": F.max, "_sk": F.skewness}
        qkw.setdefault("max_group_rows", total)  # a column holds at most the table's rows
        q = grouped_quantiles(long_numeric(df, num), ["column"], "value", [0.25, 0.5, 0.75],
                              method="exact" if exact else "approx", extra_aggs=extra, **qkw)
        nq = q.groupBy("column").agg(
            F.max("n").alias("_n"),
            F.max("_mean").alias("mean"), F.max("_std").alias("std"),
            F.max("_min").alias("min"), F.max("_max").alias("max"), F.max("_sk").alias("_sk"),
            F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q25"),
            F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
            F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q75"),
        ).withColumn("skewness", F.when(F.col("min") < F.col("max"), g1_skew(F.col("_sk"), F.col("_n")))).drop("_sk")
    if other:
        texts = [c for c in other if types[c] == "string"]
        m = None
        for group, summary in ((texts, _text_summary), ([c for c in other if c not in texts], _value_summary)):
            if group:
                vals = [F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value")) for c in group]
                longs = df.select(F.explode(F.array(*vals)).alias("_s")).select("_s.column", "_s.value").where("value is not null")
                one = summary(longs, exact)
                m = one if m is None else m.unionByName(one)
        shown = F.when(F.length("mode") > SHOWN, F.concat(F.substring("mode", 1, SHOWN), F.lit("..."))).otherwise(F.col("mode"))
        is_t = F.col("column").isin(temporal) if temporal else F.lit(False)
        m = m.select("column", F.col("n_values").alias("_n"), shown.alias("top"), F.col("mode_count").alias("freq_top"),
                     F.col("n_distinct").alias("unique"),
                     # ISO 'yyyy-MM-dd HH:mm:ss' text sorts chronologically
                     F.when(is_t, F.col("min_value")).alias("first"), F.when(is_t, F.col("max_value")).alias("last"))

    parts = []
    if num:
        parts.append(order.filter(F.col("column").isin(num)).join(nq, "column", "left").select(
            "column", "data_type", "_ord", F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"),
            F.lit(None).cast("bigint").alias("unique"), "mean", "median", "std", "min", "max", "q25", "q75",
            "skewness", F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq_top"),
            F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last")))
    if other:
        parts.append(order.filter(F.col("column").isin(other)).join(m, "column", "left").select(
            "column", "data_type", "_ord", F.coalesce("_n", F.lit(0)).cast("bigint").alias("count"),
            F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
            *[dnull.alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75", "skewness")],
            "top", F.coalesce("freq_top", F.lit(0)).cast("bigint").alias("freq_top"), "first", "last"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    out = out.withColumn("null_count", (F.lit(total) - F.col("count")).cast("bigint")).withColumn(
        "null_pct", F.try_divide(F.col("null_count") * 100.0, F.lit(total).cast("double")))
    return out.orderBy("_ord").select(*PROFILE_COLUMNS)


#: Characters of a most frequent value that a profile shows.
SHOWN = 50
#: What a sketched profile promises.
SKETCH_RSD, SKETCH_ITEMS = 0.02, 10_000
SKETCH_ERROR = 3.5 / SKETCH_ITEMS


def _value_summary(longs: DataFrame, exact: bool) -> DataFrame:
    """Summary of (column, value) rows whose values are short."""
    if not exact:
        return _sketch(longs, F.col("value"))
    return grouped_mode(longs, ["column"], "value")


def _text_summary(longs: DataFrame, exact: bool) -> DataFrame:
    """The same for texts of any length. Texts that agree in what is shown cannot be told apart in the result, so the
    smallest shown part among the most frequent texts is the shown part of the smallest."""
    head = F.substring("value", 1, SHOWN + 1)
    if not exact:
        return _sketch(longs, F.concat(F.lpad(F.hex(F.xxhash64("value")), 16, "0"), head), 17)
    digest = F.unhex(F.sha2(F.col("value").cast("binary"), 256))
    counts = longs.select("column", digest.alias("d"), head.alias("x")).groupBy("column", "d").agg(F.count("*").alias("n"), F.first("x").alias("x"))
    none = F.lit(None).cast("string")
    return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("m"), F.count("*").alias("n_distinct"),
                                        F.sum("n").alias("n_values")).select(
        "column", F.col("m.x").alias("mode"), (-F.col("m.n")).alias("mode_count"), "n_distinct", "n_values", none.alias("min_value"), none.alias("max_value"))


def _sketch(longs: DataFrame, item, skip: int = 1) -> DataFrame:
    """One pass, one bounded sketch a column and task; ``item`` is what is counted, shown from its character ``skip`` on.
    A column of so many rare values that the sketch names none shows its smallest, as met once."""
    top = F.try_element_at("top", F.lit(1))
    return (longs.groupBy("column").agg(F.approx_count_distinct("value", SKETCH_RSD).alias("n_distinct"), F.count("*").alias("n_values"),
                                        F.call_function("approx_top_k", item, F.lit(1), F.lit(SKETCH_ITEMS)).alias("top"),
                                        F.min(F.substring("value", 1, SHOWN + 1)).alias("min_value"), F.max(F.substring("value", 1, SHOWN + 1)).alias("max_value"))
            .select("column", F.coalesce(F.substring(top["item"], skip, SHOWN + 1), "min_value").alias("mode"),
                    F.coalesce(top["count"], F.lit(1)).cast("long").alias("mode_count"), "n_distinct", "n_values",
                    "min_value", "max_value"))


def _profile_schema() -> T.StructType:
    d, s, b = T.DoubleType(), T.StringType(), T.LongType()
    types = [s, s, b, b, d, b, d, d, d, d, d, d, d, d, s, b, s, s]
    return T.StructType([T.StructField(n, t) for n, t in zip(PROFILE_COLUMNS, types)])


def null_share(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: (column, null_count, null_pct) for every column in one aggregate."""
    cols = list(cols) if cols is not None else list(df.columns)
    cls = classify(df.schema)
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        x = _clean_num(c) if cls[c] == "numeric" else qcol(c)
        exprs.append(F.count_if(x.isNull()).alias(f"z{i}"))
    wide = df.agg(*exprs)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"z{i}").alias("null_count"),
            F.try_divide(F.col(f"z{i}") * 100.0, F.col("_rows")).alias("null_pct"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Number of distinct non-missing values (exact, or HyperLogLog++ when only a guard)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(f(qcol(col)).alias("n_distinct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) with missing excluded, most frequent first (ties by value)."""
    return (
        df.filter(qcol(col).isNotNull())
        .groupBy(qcol(col).alias(col))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(col))
    )


def group_sum_positive(df: DataFrame, group: str, value: str) -> DataFrame:
    """A10: sum of the positive values of ``value`` per ``group`` (missing groups excluded)."""
    return (
        df.filter((qcol(value) > 0) & qcol(group).isNotNull())
        .groupBy(qcol(group).alias(group))
        .agg(F.sum(qcol(value)).alias("sum"))
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation, pairwise-complete, long form (col_a, col_b, corr), in one scan for any number of
    columns (``operators.pairwise``). NULL where a column is constant on a pair's rows or they have none in common; an
    empty table gives no rows. Needs at least 2 numeric columns."""
    cls = classify(df.schema)
    cols = [c for c in (cols or df.columns) if cls[c] == "numeric"]
    if len(cols) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    names = F.array(*[F.lit(c) for c in cols])
    found = correlations(df, [qcol(c) for c in cols])
    return found.select(F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), "corr")


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))
