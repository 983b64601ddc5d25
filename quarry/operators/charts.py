"""The aggregates behind every chart (V1–V14, O2–O6, U1). Drawing is not built.

Each function returns a small DataFrame (bins, grid points, groups) computed on the executors
with partial aggregation; row-level outputs (scatter points, area points, box outliers) stay
distributed DataFrames. Bin counts, grids and fences are derived on the driver from bounded
one-row summaries and applied as literals.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import classify, qcol, validate_columns
from quarry.operators.quantiles import _ckpt, column_quantiles, grouped_quantiles, join_small

BIN_RULES = ("fd", "auto", "sturges", "sqrt", "rice", "scott")
#: A histogram's bins are rows of the result and literals of no plan, but they are meant to be drawn: more are refused.
MAX_BINS = 1_000_000
#: Values whose kernels one numpy step evaluates (times the grid's points, 8 bytes each).
KDE_ROWS = 2048


def _x(c: str) -> Column:
    x = qcol(c).cast("double")
    return F.when(F.isnan(x), None).otherwise(x)


def _is_integer(df: DataFrame, col: str) -> bool:
    dt = dict((f.name, f.dataType) for f in df.schema.fields)[col]
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


# ---------------------------------------------------------------- V1 / V2 histogram


def bin_layout(df: DataFrame, col: str, bins: int | str = "fd") -> tuple[float, float, int, int]:
    """(first_edge, last_edge, n_bins, n) following numpy's histogram_bin_edges rules."""
    s = df.agg(F.count(_x(col)).alias("n"), F.min(_x(col)).alias("mn"), F.max(_x(col)).alias("mx"),
               F.stddev_pop(_x(col)).alias("sd")).first()
    n, mn, mx, sd = s["n"], s["mn"], s["mx"], s["sd"]
    if not n:
        return 0.0, 1.0, 1, 0
    first, last = float(mn), float(mx)
    if first == last:
        first, last = first - 0.5, last + 0.5
    if isinstance(bins, int):
        if bins < 1:
            raise ValueError("a histogram needs one bin or more")
        if bins > MAX_BINS:
            raise ValueError(f"{bins} bins are more than a histogram is drawn with ({MAX_BINS})")
        return first, last, bins, n
    if bins not in BIN_RULES:
        raise ValueError(f"no bin rule is called {bins!r}; there are {', '.join(BIN_RULES)}")
    ptp = float(mx) - float(mn)
    sturges = ptp / (math.log2(n) + 1.0)
    sqrt_w = ptp / math.sqrt(n)
    if bins in ("fd", "auto"):
        q1, q3 = column_quantiles(df, [col], [0.25, 0.75])[col]
        fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    if bins == "fd":
        width = fd
    elif bins == "auto":
        width = min(max(fd, sqrt_w / 2), sturges)
    elif bins == "sturges":
        width = sturges
    elif bins == "sqrt":
        width = sqrt_w
    elif bins == "rice":
        width = ptp / (2.0 * n ** (1.0 / 3.0))
    else:  # scott
        width = (24.0 * math.pi ** 0.5 / n) ** (1.0 / 3.0) * (sd or 0.0)
    if width:
        if _is_integer(df, col) and width < 1:
            width = 1.0
        k = int(math.ceil((last - first) / width))
    else:
        k = 1
    if k > MAX_BINS:  # far outliers around a narrow middle: the rule's bins grow with the range
        raise ValueError(f"the {bins} rule asks for {k} bins of {col!r} ({MAX_BINS} at most): name a number of bins, or remove outliers")
    return first, last, max(k, 1), n


def bin_index(x: Column, first: float, last: float, k: int) -> Column:
    """Equal-width bin of x in [first, last]; the maximum falls in the last bin."""
    norm = k / (last - first)
    return F.least(F.floor((x - F.lit(first)) * F.lit(norm)).cast("bigint"), F.lit(k - 1))


def histogram(df: DataFrame, col: str, bins: int | str = "fd", density: bool = False) -> DataFrame:
    """V1: (bin, lo, hi, count, density) over non-missing values; empty bins included."""
    validate_columns(df, [col], numeric=[col])
    first, last, k, n = bin_layout(df, col, bins)
    x = _x(col)
    counts = df.filter(x.isNotNull()).groupBy(bin_index(x, first, last, k).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    w = (last - first) / k
    spark = df.sparkSession
    out = (
        spark.range(k).withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.lit(first) + F.col("bin") * F.lit(w)).alias("lo"),
            (F.lit(first) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
            F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        )
        .withColumn("density", F.col("count") / F.lit(float(max(n, 1)) * w))
    )
    return out


def distribution(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """V2: histogram with bins='auto' in density units, plus the KDE curve."""
    return histogram(df, col, "auto", density=True), kde(df, col)


# ---------------------------------------------------------------- V3 / V6 KDE


def _kernel_sums(rows: DataFrame, gridsize: int) -> DataFrame:
    """(g, i, k): for each group g the sums of weight · exp(−½z²) at grid point i, z = (start + i·step − x) / h, in one
    scan of rows (g long, x, w, start, step, h). Each batch is summed by group with numpy, then Spark adds up."""
    def run(batches):
        point = np.arange(gridsize)
        for b in batches:
            for at in range(0, b.num_rows, KDE_ROWS):
                g, x, w, start, step, h = (b.column(i).slice(at, KDE_ROWS).to_numpy(zero_copy_only=False) for i in range(6))
                order = np.argsort(g, kind="stable")
                g, x, w, start, step, h = (v[order] for v in (g, x, w, start, step, h))
                z = (start[:, None] + point * step[:, None] - x[:, None]) / h[:, None]
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                sums = np.add.reduceat(w[:, None] * np.exp(-0.5 * z * z), first, axis=0)
                yield pa.RecordBatch.from_pydict({"g": pa.array(np.repeat(g[first], gridsize), pa.int64()),
                                                  "i": pa.array(np.tile(point, len(first)), pa.int32()), "k": pa.array(sums.ravel())})

    return rows.mapInArrow(run, "g long, i int, k double").groupBy("g", "i").agg(F.sum("k").alias("k"))


def kde(df: DataFrame, col: str, gridsize: int = 200, cut: float = 3.0, bw_method: str | float = "scott",
        prebin: int | None = None) -> DataFrame:
    """V3: Gaussian KDE on a ``gridsize`` grid, Scott bandwidth n^(−1/5)·std (sample std),
    grid from min − cut·h to max + cut·h. Exact: one statistics aggregate, then one scan that sums the
    kernels of every batch in numpy — no row explosion. Needs ≥ 2 values.

    ``prebin=B`` (opt-in, for tables too large for gridsize·n kernels) first spreads each value over the two
    nearest of B grid points in proportion to their nearness (linear binning, one partial-aggregated
    ``groupBy``) and evaluates the kernels on the points: gridsize·B kernels instead of gridsize·n. The
    density is then off by at most δ²/(8·h³·√(2π)) with δ = (max − min)/(B − 1), from the interpolation
    error of the kernel, whose second derivative is at most 1/(h³·√(2π))."""
    validate_columns(df, [col], numeric=[col])
    s = df.agg(F.count(_x(col)).alias("n"), F.stddev_samp(_x(col)).alias("sd"), F.min(_x(col)).alias("mn"),
               F.max(_x(col)).alias("mx")).first()
    n = s["n"] or 0
    spark = df.sparkSession
    if n < 2 or not s["sd"]:
        return spark.createDataFrame([], "x double, density double")
    factor = n ** (-1.0 / 5.0) if bw_method == "scott" else float(bw_method)
    h = factor * s["sd"]
    lo, hi = s["mn"] - cut * h, s["mx"] + cut * h
    src = df.select(_x(col).alias("x")).where("x is not null").withColumn("w", F.lit(1.0))
    if prebin:
        if prebin < 2:
            raise ValueError("linear binning needs two points or more")
        delta = (s["mx"] - s["mn"]) / (prebin - 1)
        at = (F.col("x") - F.lit(s["mn"])) / F.lit(delta)
        left = F.least(F.floor(at), F.lit(prebin - 2))
        ends = F.array(F.struct(left.alias("b"), (left + 1 - at).alias("w")), F.struct((left + 1).alias("b"), (at - left).alias("w")))
        src = (src.select(F.explode(ends).alias("e")).groupBy("e.b").agg(F.sum("e.w").alias("w"))
               .select((F.lit(s["mn"]) + F.col("b") * F.lit(delta)).alias("x"), "w"))
    step = (hi - lo) / (gridsize - 1)
    sums = _kernel_sums(src.select(F.lit(0).cast("long").alias("g"), "x", "w", F.lit(lo).alias("start"), F.lit(step).alias("step"),
                                   F.lit(h).alias("h")), gridsize)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    grid = F.lit(lo) + F.lit(hi - lo) * F.col("i") / F.lit(float(gridsize - 1))
    return sums.select(grid.alias("x"), (F.col("k") * F.lit(norm)).alias("density")).orderBy("x")


def violin(df: DataFrame, x_cat: str, y_num: str, hue: str | None = None, gridsize: int = 100,
           bw: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """V6: per-group KDE (bandwidth ``bw``·std, grid clipped to the group's [min, max], cut 0)
    and per-group quartiles. Group statistics are materialised and joined back (broadcast while their bytes
    are few), then one scan sums the kernels of every group (``_kernel_sums``)."""
    validate_columns(df, [x_cat, y_num], numeric=[y_num])
    keys = [x_cat] + ([hue] if hue else [])
    K = [f"k{i}" for i in range(len(keys))]
    d = df.select(*[qcol(k).alias(a) for k, a in zip(keys, K, strict=True)], _x(y_num).alias("x")).where("x is not null")
    for k in K:  # missing categories are left out, as in the quartiles
        d = d.where(F.col(k).isNotNull())
    st = d.groupBy(*K).agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("start"), F.max("x").alias("mx"))
    st = st.where("n >= 2 and sd > 0").select(
        *K, "n", "start", (F.lit(bw) * F.col("sd")).alias("h"), ((F.col("mx") - F.col("start")) / F.lit(gridsize - 1)).alias("step"),
        F.monotonically_increasing_id().alias("g"))
    st = _ckpt(st)  # one row per group; fixes the group numbers
    j = join_small(d, st, K)
    sums = _kernel_sums(j.select("g", "x", F.lit(1.0).alias("w"), "start", "step", "h"), gridsize)
    norm = F.lit(1.0) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    curve = join_small(sums, st, ["g"]).select(
        *[F.col(a).alias(k) for k, a in zip(keys, K, strict=True)], "i", (F.col("start") + F.col("i") * F.col("step")).alias("y"),
        (F.col("k") * norm).alias("density"))
    return curve, _quartiles(df, keys, y_num)


def _quartiles(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    q = grouped_quantiles(df, keys, y, [0.25, 0.5, 0.75])
    at = {p: F.max(F.when(F.col("p") == p, F.col("q"))) for p in (0.25, 0.5, 0.75)}
    return q.groupBy(*[qcol(k).alias(k) for k in keys]).agg(at[0.25].alias("q1"), at[0.5].alias("median"), at[0.75].alias("q3"))


# ---------------------------------------------------------------- V4 scatter


def scatter_points(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """V4: the points where both coordinates are present (a distributed DataFrame)."""
    validate_columns(df, [x, y] + ([hue] if hue else []), numeric=[x, y])
    cols = [_x(x).alias(x), _x(y).alias(y)] + ([qcol(hue).alias(hue)] if hue else [])
    return df.select(*cols).filter(qcol(x).isNotNull() & qcol(y).isNotNull())


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50, hue: str | None = None) -> DataFrame:
    """V4 at scale: 2-D grid counts (bin_x, bin_y[, hue], count) instead of raw points."""
    pts = scatter_points(df, x, y, hue)
    a, b = qcol(x), qcol(y)
    s = pts.agg(F.min(a).alias("ax"), F.max(a).alias("bx"), F.min(b).alias("ay"), F.max(b).alias("by")).first()
    if s["ax"] is None:
        return df.sparkSession.createDataFrame([], "bin_x bigint, bin_y bigint, count bigint")
    fx, lx = (s["ax"], s["bx"]) if s["ax"] < s["bx"] else (s["ax"] - 0.5, s["bx"] + 0.5)
    fy, ly = (s["ay"], s["by"]) if s["ay"] < s["by"] else (s["ay"] - 0.5, s["by"] + 0.5)
    keys = [bin_index(a, fx, lx, bins).alias("bin_x"), bin_index(b, fy, ly, bins).alias("bin_y")]
    if hue:
        keys.append(qcol(hue).alias(hue))
    return pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- V5 box


def box_stats(df: DataFrame, x_cat: str, y_num: str, hue: str | None = None, whis: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """V5: per group q1, median, q3, whisker_lo/hi (most extreme values inside the 1.5·IQR fences),
    n and outlier count; plus the outlier points (a distributed DataFrame)."""
    validate_columns(df, [x_cat, y_num] + ([hue] if hue else []), numeric=[y_num])
    keys = [x_cat] + ([hue] if hue else [])
    K = [f"k{i}" for i in range(len(keys))]
    named = [F.col(a).alias(k) for k, a in zip(keys, K, strict=True)]
    inner = df.select(*[qcol(k).alias(a) for k, a in zip(keys, K, strict=True)], _x(y_num).alias("x"))
    fence = F.lit(whis) * (F.col("q3") - F.col("q1"))
    quart = _quartiles(inner, K, "x").withColumn("lo", F.col("q1") - fence).withColumn("hi", F.col("q3") + fence)
    # one row per group, materialised; null group keys drop out (pandas/seaborn drop them too)
    j = join_small(inner.where("x is not null"), _ckpt(quart), K)
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    stats = j.groupBy(*K, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~inside).alias("n_outliers"),
    )
    outliers = j.filter(~inside).select(*named, F.col("x").alias(y_num))
    return stats.select(*named, "q1", "median", "q3", "whisker_lo", "whisker_hi", "n", "n_outliers"), outliers


# ---------------------------------------------------------------- U1 estimators / V10 bar / A11 / A12


ESTIMATORS = {
    "mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp, "stddev_samp": F.stddev_samp, "var": F.var_samp,
}


def group_aggregate(df: DataFrame, x: str, y: str, hue: str | None = None,
                    estimator: str | Callable = "mean", out: str = "value") -> DataFrame:
    """estimator(y) per x (and hue). ``estimator`` is a built-in name (mean, sum,
    min, max, count, std, var, median — median uses the exact distributed quantiles) or a function
    Column -> Column of aggregates (``lambda y: F.max(y) - F.min(y)``), which Spark sums up before the
    shuffle. A grouped-aggregate ``pandas_udf`` (Series -> scalar) is taken too, but holds each
    group's rows in one worker: only for groups known to be small."""
    keys = [x] + ([hue] if hue else [])
    d = df.filter(qcol(x).isNotNull() & (qcol(hue).isNotNull() if hue else F.lit(True)))
    if estimator == "median":
        q = grouped_quantiles(d, keys, y, [0.5])
        return q.select(*[qcol(k) for k in keys], F.col("q").alias(out))
    if isinstance(estimator, str):
        if estimator not in ESTIMATORS:
            raise ValueError(f"unknown estimator {estimator!r}")
        return d.groupBy(*[qcol(k).alias(k) for k in keys]).agg(ESTIMATORS[estimator](_x(y)).alias(out))
    return d.groupBy(*[qcol(k).alias(k) for k in keys]).agg(estimator(_x(y)).alias(out))


def bar_data(df: DataFrame, x_cat: str, y_num: str, hue: str | None = None, estimator: str | Callable = "mean") -> DataFrame:
    """estimator(y) by category (+hue), sorted by category."""
    validate_columns(df, [x_cat, y_num] + ([hue] if hue else []), numeric=[y_num])
    keys = [x_cat] + ([hue] if hue else [])
    return group_aggregate(df, x_cat, y_num, hue, estimator).orderBy(*[qcol(k) for k in keys])


def _parse_x(df: DataFrame, x: str, parse_x_as_date: bool) -> Column:
    dt = dict((f.name, f.dataType) for f in df.schema.fields)[x]
    if parse_x_as_date and isinstance(dt, T.StringType):
        return F.try_to_timestamp(qcol(x))
    if isinstance(dt, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        # pinned: numeric X stays numeric (the reference would read it as epoch nanoseconds)
        return qcol(x)
    raise ValueError(f"line data need a number, date or timestamp as x; {x!r} is {dt.simpleString()}")


def line_data(df: DataFrame, x: str, y: str, hue: str | None = None, parse_x_as_date: bool = True,
              bucket: str | None = None) -> DataFrame:
    """Mean of y per x (and hue), ordered by x. ``bucket`` ('day', 'hour', …)
    truncates a timestamp X first, which bounds the output at scale."""
    validate_columns(df, [x, y] + ([hue] if hue else []), numeric=[y])
    xc = _parse_x(df, x, parse_x_as_date)
    if bucket:
        xc = F.date_trunc(bucket, xc)
    keys = [xc.alias(x)] + ([qcol(hue).alias(hue)] if hue else [])
    d = df.select(*keys, _x(y).alias(y)).filter(qcol(x).isNotNull())
    by = [qcol(x)] + ([qcol(hue)] if hue else [])
    return d.groupBy(*[c.alias(k) for c, k in zip(by, [x, hue], strict=False)]).agg(F.avg(qcol(y)).alias(y)).orderBy(*by)


def first_hues(df: DataFrame, x: str, hue: str, k: int = 10) -> DataFrame:
    """The first ``k`` hue values in order of appearance after sorting by x
    (= smallest min(x); ties by hue value). A distributed top-k over the groups."""
    return (df.filter(qcol(hue).isNotNull() & qcol(x).isNotNull())
            .groupBy(qcol(hue).alias(hue)).agg(F.min(qcol(x)).alias("_first"))
            .orderBy("_first", qcol(hue)).limit(k).select(qcol(hue)))


def area_data(df: DataFrame, x: str, y: str, hue: str | None = None, parse_x_as_date: bool = True,
              max_hues: int = 10) -> DataFrame:
    """V9: raw (x, y[, hue]) points sorted by x; with a hue, only the first ``max_hues`` hues
    (semi-join against the small top-k)."""
    validate_columns(df, [x, y] + ([hue] if hue else []), numeric=[y])
    xc = _parse_x(df, x, parse_x_as_date)
    names = [x, y] + ([hue] if hue else [])
    d = df.select(xc.alias("x"), _x(y).alias("y"), *([qcol(hue).alias("hue")] if hue else []))
    # input order as the last sort key: equal x values (one hot timestamp may hold a third of the
    # rows) are then spread over several range partitions instead of one
    d = d.withColumn("ord", F.monotonically_increasing_id())
    if hue:
        top = first_hues(d, "x", "hue", max_hues)
        d = d.join(F.broadcast(top), "hue", "left_semi")  # at most max_hues rows: a proven bound
    d = d.orderBy(F.asc_nulls_last("x"), *(["hue"] if hue else []), "ord")
    return d.select(*[F.col(a).alias(k) for a, k in zip(["x", "y", "hue"], names, strict=False)])


# ---------------------------------------------------------------- V11 pie / O4


def pie_data(df: DataFrame, category: str, value: str | None = None, max_slices: int = 7) -> DataFrame:
    """Per-category sums of positive ``value`` (or counts); beyond ``max_slices`` the
    top (max_slices−1) by size (ties by name) are kept and the rest summed into 'Other (m)'
    (kept only if > 1e-9); pct = 100·share. Empty when everything is ≤ 1e-9.

    Top-k is a distributed TakeOrdered (bounded) and the roll-up is total − top, so no step
    ever holds all groups in one task; the result (≤ max_slices rows) is materialised and the
    cached group sums released."""
    validate_columns(df, [category] + ([value] if value else []), numeric=[value] if value else [])
    if value:
        g = df.filter((_x(value) > 0) & qcol(category).isNotNull()).groupBy(qcol(category).cast("string").alias("category")) \
            .agg(F.sum(_x(value)).cast("double").alias("value"))
    else:
        g = df.filter(qcol(category).isNotNull()).groupBy(qcol(category).cast("string").alias("category")) \
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
    g = g.cache()
    tot = g.agg(F.count(F.lit(1)).alias("m"), F.sum("value").alias("total"), F.max("value").alias("mx")).first()
    spark = df.sparkSession
    schema = "category string, value double, pct double"
    if not tot["m"] or tot["mx"] is None or tot["mx"] <= 1e-9:
        g.unpersist()
        return spark.createDataFrame([], schema)
    total, m = tot["total"], tot["m"]
    if m <= max_slices:
        rows = [(r["category"], r["value"]) for r in g.collect()]  # ≤ max_slices rows
    else:
        top = [(r["category"], r["value"]) for r in
               g.orderBy(F.desc("value"), F.asc("category")).limit(max_slices - 1).collect()]
        rest = total - sum(v for _, v in top)
        rows = top + ([(f"Other ({m - (max_slices - 1)})", rest)] if rest > 1e-9 else [])
    g.unpersist()
    shown = sum(v for _, v in rows)
    return spark.createDataFrame([(c, v, v * 100.0 / shown) for c, v in rows], schema)


# ---------------------------------------------------------------- V12 pair plot / O6


def first_numeric(df: DataFrame, k: int = 5) -> list[str]:
    """The first ``k`` numeric columns in schema order."""
    cls = classify(df.schema)
    return [c for c in df.columns if cls[c] == "numeric"][:k]


def pair_data(df: DataFrame, max_numeric_cols: int = 5, bins: int = 20, grid_bins: int = 20,
              hue: str | None = None) -> DataFrame:
    """Long form (col_x, col_y, bin_x, bin_y[, hue], count): the diagonal holds each column's
    ``bins``-bin histogram (bin_y NULL), off-diagonal cells 2-D grid counts per pair; with a
    ``hue`` the counts are split by its value.

    One stats aggregate for the edges, then ONE scan in which a task adds up fixed-size arrays of
    cells (d·bins + d(d−1)/2·grid_bins² counts, for each hue it has met since it last handed them on) and hands on
    the cells that are not empty."""
    cols = first_numeric(df, max_numeric_cols)
    if len(cols) < 2:
        raise ValueError("pair data need two numeric columns or more")
    s = df.agg(*[F.min(_x(c)).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(_x(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    edges = []
    for i in range(len(cols)):
        a, b = s[f"a{i}"], s[f"b{i}"]
        if a is None:
            a, b = 0.0, 1.0
        edges.append((a, b) if a < b else (a - 0.5, b + 0.5))
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    size = d * bins + len(pairs) * grid_bins * grid_bins
    keep_hues = max(1, (8 << 20) // (8 * size))  # hues whose cells a task holds at a time: 8 MB

    def cells(x: np.ndarray) -> np.ndarray:
        """Counts of all cells, histograms first."""
        here = ~np.isnan(x)
        filled = np.where(here, x, [e[0] for e in edges])

        def place(i: int, k: int) -> np.ndarray:
            first, last = edges[i]
            return np.minimum(np.floor((filled[:, i] - first) * (k / (last - first))), k - 1).astype(np.int64)

        out = np.zeros(size, np.int64)
        for i in range(d):
            out[i * bins:(i + 1) * bins] = np.bincount(place(i, bins)[here[:, i]], minlength=bins)
        grid = [place(i, grid_bins) for i in range(d)]
        for n, (i, j) in enumerate(pairs):
            both = here[:, i] & here[:, j]
            at = d * bins + n * grid_bins * grid_bins
            out[at:at + grid_bins * grid_bins] = np.bincount((grid[i] * grid_bins + grid[j])[both], minlength=grid_bins * grid_bins)
        return out

    def run(batches):
        held: dict = {}

        def told():
            for h, c in held.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_pydict({"hue": pa.array([h] * len(at), pa.string()), "at": pa.array(at, pa.int32()),
                                                  "n": pa.array(c[at], pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, d)
            coded = b.column(1).dictionary_encode() if hue else None
            which = coded.indices.fill_null(-1).to_numpy() if hue else np.zeros(b.num_rows, int)
            for k in np.unique(which).tolist():
                h = coded.dictionary[k].as_py() if hue and k >= 0 else None
                if h not in held and len(held) >= keep_hues:
                    yield from told()
                    held.clear()
                held[h] = held.get(h, 0) + cells(x[which == k])
        yield from told()

    src = df.select(F.array(*[_x(c) for c in cols]).alias("x"), (qcol(hue).cast("string") if hue else F.lit(None).cast("string")).alias("hue"))
    counts = src.mapInArrow(run, "hue string, at int, n long").groupBy("hue", "at").agg(F.sum("n").alias("count"))
    # a place in the array → its cell, and for a pair its mirror image
    names = F.array(*[F.lit(c) for c in cols])
    ends = F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in pairs])
    at, rest = F.col("at"), F.col("at") - F.lit(d * bins)
    pair = F.element_at(ends, F.floor(rest / (grid_bins * grid_bins)).cast("int") + 1)
    bx, by = F.floor(F.pmod(rest, F.lit(grid_bins * grid_bins)) / grid_bins).cast("bigint"), F.pmod(rest, F.lit(grid_bins)).cast("bigint")

    def cell(cx, cy, x, y):
        return F.struct(F.element_at(names, cx + 1).alias("col_x"), F.element_at(names, cy + 1).alias("col_y"),
                        x.cast("bigint").alias("bin_x"), y.cast("bigint").alias("bin_y"))

    column = F.floor(at / bins).cast("int")
    single = F.array(cell(column, column, F.pmod(at, F.lit(bins)), F.lit(None)))
    double = F.array(cell(pair[0], pair[1], bx, by), cell(pair[1], pair[0], by, bx))
    shown = counts.select("hue", "count", F.explode(F.when(at < d * bins, single).otherwise(double)).alias("c"))
    return shown.select("c.col_x", "c.col_y", "c.bin_x", "c.bin_y", *([F.col("hue").alias(hue)] if hue else []), "count")
