"""Exact grouped quantiles and modes that never hold a whole group in one task.

Spark's exact ``percentile`` / ``median`` / ``mode`` aggregates keep a value->count map per
group and merge it in a single task; a group that holds a third of a 100 TB table would not
fit. Here exact quantiles never rank more than ``final_rows`` rows in one task. If a cheap
row count proves every group is that small, one window pass ranks each group; otherwise three
scans with bounded state:

1. one partial aggregate gives n, min, max and a Greenwald–Khanna sketch
   (``percentile_approx``, bounded memory, mergeable) per group; the sketch brackets every
   wanted rank between two values ``p ± 3/accuracy``;
2. one pass counts, per bracket, the rows below it and inside it — which *verifies* the
   bracket (a bracket that does not contain its rank falls back to the group's full range,
   so exactness never rests on the sketch's error bound);
3. rows inside a bracket holding at most ``final_rows`` rows are ranked with ``row_number``
   (a window partition bounded by ``final_rows``).

Brackets larger than ``final_rows`` (only for groups of more than ~accuracy·final_rows/6
rows) go through *histogram refinement* first: each pass buckets the bracket's rows into
``buckets`` equal-width buckets (partial aggregation: at most ``buckets`` rows per group and
task reach the shuffle), a window over the small histogram gives cumulative counts, and the
rank moves into the bucket that holds it (the bucket's min/max become the new interval).

Each row meets at most ``2 * len(probs)`` bracket rows in the (AQE-size-checked) lookup join.
State between passes is tiny and is checkpointed to the shared checkpoint folder.
Linear interpolation between ranks matches ``quantile_cont`` / numpy's default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import qcol
from quarry.session import ensure_checkpoint_dir

DEFAULT_BUCKETS = 4096
# rows one window partition may rank in a single task (the window sort spills to disk, so this
# bounds task time, not memory correctness); groups proven smaller are ranked in ONE pass
DEFAULT_FINAL_ROWS = 2_000_000


BROADCAST_BYTES = 32 << 20  # a lookup table of at most this many bytes of values is broadcast


@dataclass
class TableSize:
    rows: int
    bytes: int


def table_bytes(df: DataFrame) -> TableSize:
    """Rows and bytes of a materialised table's values, from one aggregate: the length of every string, 8 bytes for any
    other value, 16 for a row."""
    fixed = 16 + 8 * sum(not isinstance(f.dataType, T.StringType) for f in df.schema)
    texts = [F.coalesce(F.sum(F.octet_length(qcol(f.name))), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    r = df.agg(F.count("*").alias("n"), sum(texts, F.lit(0)).cast("bigint").alias("b")).first()
    return TableSize(r["n"], r["b"] + fixed * r["n"])


def _ckpt(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a materialised lookup table: broadcast it when its measured bytes are few, otherwise a regular shuffle join
    (AQE's skew handling splits hot keys)."""
    if table_bytes(small).bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on=on, how=how)
    return big.join(small, on=on, how=how)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    method: str = "exact",
    accuracy: int = 10_000,
    buckets: int = DEFAULT_BUCKETS,
    final_rows: int = DEFAULT_FINAL_ROWS,
    max_passes: int = 24,
    extra_aggs: dict | None = None,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Quantiles of ``value`` per group of ``keys``.

    Returns ``keys + [p double, q double, n bigint]`` with one row per group and
    probability; NULL/NaN values and rows with a NULL key are ignored, groups without values are absent.
    ``method='approx'`` uses ``percentile_approx`` (one pass, bounded memory, not exact).
    ``extra_aggs`` = {name: fn(Column) -> aggregate Column} rides along in the first pass
    (e.g. mean/std/min/max for a profile) and is returned as extra columns.

    Small-group fast path: when every group is proven to hold at most ``final_rows`` rows
    (``max_group_rows``, or else the input's row count — metadata-only for a Parquet scan), the
    quantiles come from ONE window pass (row_number + count per group, bounded partitions)
    instead of sketch → verify → rank.
    """
    keys = list(keys)
    inner = [f"_k{i}" for i in range(len(keys))]  # key names may hold dots
    src = df.select(*[qcol(k).alias(a) for k, a in zip(keys, inner, strict=True)], qcol(value).alias("_value"))
    out = _grouped(src, inner, "_value", [float(p) for p in probs], method, accuracy, buckets, final_rows, max_passes, extra_aggs or {}, max_group_rows)
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, inner, strict=True)], "p", "q", "n", *(extra_aggs or {}))


def _grouped(df: DataFrame, keys: list[str], value: str, probs: list[float], method: str, accuracy: int, buckets: int, final_rows: int,
             max_passes: int, extra_aggs: dict, max_group_rows: int | None) -> DataFrame:
    added_key = not keys
    if added_key:
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    v = qcol(value).cast("double")
    data = df.select(*[qcol(k).alias(k) for k in keys], F.when(F.isnan(v), None).otherwise(v).alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    # rows without a group take no part, however large the table (the lookup joins below could not match them)
    for k in keys:
        data = data.filter(F.col(k).isNotNull())
    K = [F.col(k) for k in keys]

    if method == "approx":
        out = (
            data.groupBy(*K)
            .agg(F.percentile_approx("_v", probs, accuracy).alias("_qs"), F.count("_v").alias("n"),
                 *[fn(F.col("_v")).alias(name) for name, fn in extra_aggs.items()])
            .select(*K, "n", *extra_aggs, F.posexplode("_qs").alias("_i", "q"))
            .withColumn("p", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1))
            .select(*K, "p", "q", "n", *extra_aggs)
        )
        return out.drop("_g") if added_key else out

    if max_group_rows is None:
        if added_key:
            max_group_rows = df.count()  # one group: a metadata count for a Parquet scan
        else:
            # largest group, from one count-only partial aggregate
            max_group_rows = data.groupBy(*K).count().agg(F.max("count")).first()[0] or 0
    if max_group_rows <= final_rows:
        out = _ranked_quantiles(data, keys, probs, extra_aggs)
        return out.drop("_g") if added_key else out

    # pass 1: n, min, max and a bounded GK sketch bracketing every wanted rank
    eps = 3.0 / accuracy
    brk = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    pos = {q: i + 1 for i, q in enumerate(brk)}
    stats = data.groupBy(*K).agg(F.count("_v").alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"),
                                 F.percentile_approx("_v", brk, accuracy).alias("_qs"),
                                 *[fn(F.col("_v")).alias(name) for name, fn in extra_aggs.items()])
    tgt = F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"),
                 F.element_at("_qs", pos[min(1.0, max(0.0, p - eps))]).alias("_lo"),
                 F.element_at("_qs", pos[min(1.0, max(0.0, p + eps))]).alias("_hi"))
        for p in probs]))
    targets = (
        stats.select(*K, "_n", "_mn", "_mx", *extra_aggs, tgt.alias("_t"))
        .select(*K, "_n", "_mn", "_mx", *extra_aggs, "_t.*")
        .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
        .withColumn("_r0", F.floor("_h").cast("bigint"))
        .withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1))
    )
    targets = _ckpt(targets)
    # pass 2: rows below / inside each bracket (each row meets at most 2·len(probs) brackets)
    br = targets.select(*K, "_lo", "_hi").distinct()  # a projection of a checkpointed frame
    cnt = join_small(data, br, keys).groupBy(*K, "_lo", "_hi").agg(
        F.count_if(F.col("_v") < F.col("_lo")).alias("_below"),
        F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_cnt"))
    ranks = targets.select(*K, "_n", "_mn", "_mx", "_lo", "_hi", F.explode(F.array("_r0", "_r1")).alias("_r")).distinct()
    st = ranks.join(cnt, on=keys + ["_lo", "_hi"], how="left")
    ok = (F.col("_below") <= F.col("_r")) & (F.col("_r") < F.col("_below") + F.col("_cnt"))
    # a bracket that does not verify falls back to the full range (never trust the sketch bound)
    state = st.select(
        *K, "_r",
        F.when(ok, F.col("_lo")).otherwise(F.col("_mn")).alias("_a"),
        F.when(ok, F.col("_hi")).otherwise(F.col("_mx")).alias("_b"),
        F.when(ok, F.col("_below")).otherwise(F.lit(0)).cast("bigint").alias("_below"),
        F.when(ok, F.col("_cnt")).otherwise(F.col("_n")).cast("bigint").alias("_cnt"),
    )
    state = _ckpt(state)
    IV = keys + ["_a", "_b", "_below"]
    is_open = (F.col("_cnt") > final_rows) & (F.col("_a") < F.col("_b"))

    for _ in range(max_passes):
        open_ = state.filter(is_open)
        if open_.isEmpty():
            break
        iv = open_.select(*IV).distinct()
        inside = join_small(data, iv, keys).filter(F.col("_v").between(F.col("_a"), F.col("_b")))
        width = F.col("_b") - F.col("_a")
        bucket = F.least(F.floor((F.col("_v") - F.col("_a")) / width * buckets).cast("bigint"), F.lit(buckets - 1))
        hist = inside.groupBy(*[F.col(c) for c in IV], bucket.alias("_bk")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        w = Window.partitionBy(*IV).orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_end", F.col("_below") + F.sum("_c").over(w)).withColumn(
            "_start", F.col("_end") - F.col("_c")
        )
        moved = (
            open_.join(hist, on=IV)
            .filter((F.col("_r") >= F.col("_start")) & (F.col("_r") < F.col("_end")))
            .select(
                *K,
                "_r",
                F.col("_lo").alias("_a"),
                F.col("_hi").alias("_b"),
                F.col("_start").alias("_below"),
                F.col("_c").alias("_cnt"),
            )
        )
        state = _ckpt(state.filter(~is_open).unionByName(moved))

    const = state.filter(F.col("_a") == F.col("_b")).select(*K, "_r", F.col("_a").alias("_val"))
    fin = state.filter(F.col("_a") < F.col("_b"))
    fiv = fin.select(*IV).distinct()
    wr = Window.partitionBy(*IV).orderBy("_v")
    ranked = (
        join_small(data, fiv, keys)
        .filter(F.col("_v").between(F.col("_a"), F.col("_b")))
        .withColumn("_rank", F.col("_below") + F.row_number().over(wr) - 1)
    )
    picked = (
        fin.join(ranked, on=IV)
        .filter(F.col("_rank") == F.col("_r"))
        .select(*K, "_r", F.col("_v").alias("_val"))
    )
    # a rank reached through two overlapping brackets has one value: keep one row per rank
    vals = const.unionByName(picked).dropDuplicates(keys + ["_r"])
    v0 = vals.select(*K, F.col("_r").alias("_r0"), F.col("_val").alias("_v0"))
    v1 = vals.select(*K, F.col("_r").alias("_r1"), F.col("_val").alias("_v1"))
    out = (
        targets.join(v0, on=keys + ["_r0"])
        .join(v1, on=keys + ["_r1"])
        .select(
            *K,
            "p",
            (F.col("_v0") + (F.col("_h") - F.col("_r0")) * (F.col("_v1") - F.col("_v0"))).alias("q"),
            F.col("_n").alias("n"),
            *extra_aggs,
        )
    )
    return out.drop("_g") if added_key else out


def _ranked_quantiles(data: DataFrame, keys: list[str], probs: list[float], extra_aggs: dict) -> DataFrame:
    """One window pass for groups proven to hold at most ``final_rows`` rows: equal values are counted first (repeats
    collapse before the shuffle), the window runs over a group's distinct values, and the ≤ 2·len(probs) values that
    cover the interpolation ranks are kept. Other statistics come from a plain partial aggregate."""
    K = [F.col(k) for k in keys]
    w = Window.partitionBy(*K)
    counted = data.groupBy(*K, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select(*K, "_v", "_c", F.sum("_c").over(upto).alias("_end"), F.sum("_c").over(w).alias("_n"))
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("_c"))  # the value holds ranks _start … _end − 1

    def holds(r):
        return (F.col("_start") <= r) & (r < F.col("_end"))

    def low(p):
        return F.floor((F.col("_n") - 1).cast("double") * p).cast("bigint")

    # the few values at a wanted rank first, so that only they are copied once per probability
    wanted = F.lit(False)
    for p in probs:
        wanted = wanted | holds(low(F.lit(p))) | holds(F.least(low(F.lit(p)) + 1, F.col("_n") - 1))
    t = (
        ranked.filter(wanted).withColumn("p", F.explode(F.array(*[F.lit(p) for p in probs])))
        .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
        .withColumn("_r0", F.floor("_h").cast("bigint"))
        .withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1))
    )
    g = t.groupBy(*K, "p").agg(
        F.max(F.when(holds(F.col("_r0")), F.col("_v"))).alias("_v0"),
        F.max(F.when(holds(F.col("_r1")), F.col("_v"))).alias("_v1"),
        F.max("_h").alias("_h"), F.max("_r0").alias("_r0"), F.max("_n").alias("n"),
    )
    out = g.select(*K, "p", (F.col("_v0") + (F.col("_h") - F.col("_r0")) * (F.col("_v1") - F.col("_v0"))).alias("q"), "n")
    if not extra_aggs:
        return out
    return out.join(data.groupBy(*K).agg(*[fn(F.col("_v")).alias(name) for name, fn in extra_aggs.items()]), on=keys)


def long_numeric(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (column, value double), NaN mapped to NULL (an Expand, no shuffle)."""
    vals = []
    for c in cols:
        x = qcol(c).cast("double")
        vals.append(F.struct(F.lit(c).alias(name), F.when(F.isnan(x), None).otherwise(x).alias(value)))
    return df.select(F.explode(F.array(*vals)).alias("_s")).select(f"_s.{name}", f"_s.{value}")


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list]:
    """Exact quantiles per column, collected as {column: [q per prob]} (a bounded summary:
    one row per column and probability). Columns with no values map to Nones."""
    cols = list(cols)
    if not cols:
        return {}
    # each column-group holds at most the table's rows (a metadata count for a Parquet scan)
    kw.setdefault("max_group_rows", df.count())
    q = grouped_quantiles(long_numeric(df, cols), ["column"], "value", probs, **kw)
    got: dict[str, dict[float, float]] = {}
    for r in q.collect():
        got.setdefault(r["column"], {})[r["p"]] = r["q"]
    return {c: [got.get(c, {}).get(float(p)) for p in probs] for c in cols}


def grouped_mode(df: DataFrame, keys: Sequence[str], value: str, order_value=None) -> DataFrame:
    """Most frequent non-null value per group, ties to the smallest value.

    ``groupBy(keys, value).count()`` (partial aggregation, so hot values collapse map-side)
    then a ``min(struct(-count, value))`` aggregate per group — bounded state, no group is
    ever materialised. Returns ``keys + [mode, mode_count, n_distinct, n_values, min_value,
    max_value]`` (the last three: non-missing count and value extent, from the same pass).
    """
    keys = list(keys)
    K = [qcol(k).alias(k) for k in keys]
    x = qcol(value)
    if order_value is not None:
        x = order_value
    counts = df.select(*K, x.alias("_x")).filter(F.col("_x").isNotNull()).groupBy(*keys, "_x").count()
    best = counts.groupBy(*keys).agg(
        F.min(F.struct((-F.col("count")).alias("nc"), F.col("_x").alias("x"))).alias("_m"),
        F.count("*").alias("n_distinct"),
        F.sum("count").alias("n_values"),
        F.min("_x").alias("min_value"),
        F.max("_x").alias("max_value"),
    )
    return best.select(
        *keys,
        F.col("_m.x").alias("mode"),
        (-F.col("_m.nc")).alias("mode_count"),
        "n_distinct",
        "n_values",
        "min_value",
        "max_value",
    )
