"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import charts as V
from quarry.plans.q_profile import lineitem_n
from quarry.plans.registry import query, round_half_away, rounded, table
from quarry.plans.sqlgen import LINEITEM_N_SQL


def _hist_sql(src: str, x: str, width_sql: str, fixed_k: int | None = None) -> str:
    k_expr = (f"{fixed_k}::BIGINT" if fixed_k else
              f"CASE WHEN w > 0 THEN greatest(CAST(ceil((l - f) / w) AS BIGINT), 1) ELSE 1 END")
    return (
        f"WITH d AS (SELECT {x}::DOUBLE AS x FROM ({src}) WHERE {x} IS NOT NULL), "
        "s AS (SELECT count(*) AS n, min(x) AS mn, max(x) AS mx, quantile_cont(x, 0.25) AS q1, "
        "quantile_cont(x, 0.75) AS q3, stddev_pop(x) AS sd FROM d), "
        "e AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS f, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS l, "
        f"{width_sql} AS w FROM s), "
        f"k AS (SELECT n, f, l, {k_expr} AS k FROM e), "
        "b AS (SELECT least(CAST(floor((x - f) * (k / (l - f))) AS BIGINT), k - 1) AS bin, count(*) AS cnt FROM d, k GROUP BY 1), "
        "g AS (SELECT unnest(range(k)) AS bin FROM k) "
        "SELECT g.bin, round(f + g.bin * ((l - f) / k), 4) AS lo, round(f + (g.bin + 1) * ((l - f) / k), 4) AS hi, "
        "coalesce(cnt, 0)::BIGINT AS \"count\", round(coalesce(cnt, 0) / (n * ((l - f) / k)), 4) AS density "
        "FROM g LEFT JOIN b ON g.bin = b.bin, k"
    )


_FD = "2.0 * (q3 - q1) * pow(n, -1.0 / 3.0)"
_STURGES = "(mx - mn) / (log2(n) + 1.0)"
_SQRTW = "(mx - mn) / sqrt(n)"


@query("hist_fd", _hist_sql("SELECT * FROM lineitem", "l_extendedprice", _FD), ops="V1 (fd)")
def hist_fd(spark, sf):
    return rounded(V.histogram(table(spark, sf, "lineitem"), "l_extendedprice", "fd"))


@query("hist_auto", _hist_sql("SELECT * FROM events", "value", f"least(greatest({_FD}, {_SQRTW} / 2), {_STURGES})"),
       ops="V1 V2 (auto, density)")
def hist_auto(spark, sf):
    return rounded(V.histogram(table(spark, sf, "events"), "value", "auto", density=True))


@query("hist_sturges", _hist_sql("SELECT * FROM orders", "o_totalprice", _STURGES), ops="V1 (sturges)")
def hist_sturges(spark, sf):
    return rounded(V.histogram(table(spark, sf, "orders"), "o_totalprice", "sturges"))


@query("hist_int_bins", _hist_sql(LINEITEM_N_SQL, "l_quantity", "0", fixed_k=15), ops="V1 (bins=15, missing values)")
def hist_int_bins(spark, sf):
    return rounded(V.histogram(lineitem_n(spark, sf), "l_quantity", 15))


@query(
    "kde_grid",
    "WITH d AS (SELECT value AS x FROM events WHERE value IS NOT NULL), "
    "s AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM d), "
    "p AS (SELECT n, pow(n, -0.2) * sd AS h, mn, mx FROM s), "
    "g AS (SELECT (mn - 3.0 * h) + ((mx + 3.0 * h) - (mn - 3.0 * h)) * i / 199 AS gx, h, n "
    "FROM p, (SELECT unnest(range(200)) AS i)) "
    "SELECT round(gx, 4) AS x, round(sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi())), 6) "
    "AS density FROM g, d GROUP BY gx, h, n",
    ops="V3",
)
def kde_grid(spark, sf):
    out = V.kde(table(spark, sf, "events"), "value")
    return out.select(round_half_away(F.col("x"), 4).alias("x"), round_half_away(F.col("density"), 6).alias("density"))


@query(
    "scatter_grid",
    "WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL "
    "AND l_extendedprice IS NOT NULL), s AS (SELECT min(x) ax, max(x) bx, min(y) ay, max(y) AS by_ FROM d) "
    "SELECT least(CAST(floor((x - ax) * (50 / (bx - ax))) AS BIGINT), 49) AS bin_x, "
    "least(CAST(floor((y - ay) * (50 / (by_ - ay))) AS BIGINT), 49) AS bin_y, count(*) AS \"count\" "
    "FROM d, s GROUP BY 1, 2",
    ops="V4",
)
def scatter_grid(spark, sf):
    return V.scatter_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", bins=50)


@query(
    "scatter_points",
    f"SELECT l_quantity, l_extendedprice, l_returnflag FROM ({LINEITEM_N_SQL}) "
    "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
    ops="V4 (points, hue)",
)
def scatter_points(spark, sf):
    return V.scatter_points(lineitem_n(spark, sf), "l_quantity", "l_extendedprice", "l_returnflag")


_BOX_SQL = (
    "WITH d AS (SELECT event_type, value FROM events WHERE value IS NOT NULL), "
    "q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, "
    "quantile_cont(value, 0.75) AS q3 FROM d GROUP BY 1), "
    "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
)


@query(
    "box_stats",
    _BOX_SQL + "SELECT d.event_type, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, "
    "round(min(CASE WHEN value BETWEEN lo AND hi THEN value END), 4) AS whisker_lo, "
    "round(max(CASE WHEN value BETWEEN lo AND hi THEN value END), 4) AS whisker_hi, count(*) AS n, "
    "count(*) FILTER (WHERE NOT (value BETWEEN lo AND hi)) AS n_outliers "
    "FROM d JOIN f ON d.event_type = f.event_type GROUP BY d.event_type, q1, med, q3",
    ops="V5",
)
def box_stats(spark, sf):
    stats, _ = V.box_stats(table(spark, sf, "events"), "event_type", "value")
    return rounded(stats)


@query(
    "box_outliers",
    _BOX_SQL + "SELECT d.event_type, round(value, 4) AS value FROM d JOIN f ON d.event_type = f.event_type "
    "WHERE NOT (value BETWEEN lo AND hi)",
    ops="V5 (outlier points)",
)
def box_outliers(spark, sf):
    _, pts = V.box_stats(table(spark, sf, "events"), "event_type", "value")
    return rounded(pts)


@query(
    "violin_quartiles",
    "SELECT event_type, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, "
    "round(quantile_cont(value, 0.75), 4) AS q3 FROM events WHERE value IS NOT NULL GROUP BY 1",
    ops="V6 (quartiles)",
)
def violin_quartiles(spark, sf):
    _, q = V.violin(table(spark, sf, "events"), "event_type", "value")
    return rounded(q)


@query(
    "violin_kde",
    "WITH d AS (SELECT event_type, value AS y FROM events WHERE value IS NOT NULL), "
    "s AS (SELECT event_type, count(*) AS n, 0.2 * stddev_samp(y) AS h, min(y) AS mn, (max(y) - min(y)) / 99 AS step "
    "FROM d GROUP BY 1 HAVING count(*) >= 2 AND stddev_samp(y) > 0), "
    "g AS (SELECT s.*, i, mn + i * step AS gy FROM s, (SELECT unnest(range(100)) AS i)) "
    "SELECT g.event_type, i::INTEGER AS i, round(gy, 4) AS y, "
    "round(sum(exp(-0.5 * ((gy - y) / h) * ((gy - y) / h))) / (n * h * sqrt(2 * pi())), 6) AS density "
    "FROM g JOIN d ON g.event_type = d.event_type GROUP BY g.event_type, i, gy, n, h",
    ops="V6 (per-group KDE)",
)
def violin_kde(spark, sf):
    curve, _ = V.violin(table(spark, sf, "events"), "event_type", "value")
    return curve.select("event_type", "i", round_half_away(F.col("y"), 4).alias("y"),
                        round_half_away(F.col("density"), 6).alias("density"))


@query(
    "line_daily_mean",
    "SELECT date_trunc('day', ts) AS ts, event_type, round(avg(value), 4) AS value FROM events "
    "WHERE ts IS NOT NULL GROUP BY 1, 2",
    ops="V8 A12 O2",
)
def line_daily_mean(spark, sf):
    out = V.line_data(table(spark, sf, "events"), "ts", "value", hue="event_type", bucket="day")
    return rounded(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(
    "line_numeric_x",
    "SELECT l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem "
    "WHERE l_quantity IS NOT NULL GROUP BY 1",
    ops="V8 (numeric X)",
)
def line_numeric_x(spark, sf):
    return rounded(V.line_data(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@query(
    "area_top_hues",
    "WITH top AS (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL "
    "GROUP BY o_custkey ORDER BY min(o_orderdate), o_custkey LIMIT 10) "
    "SELECT o_orderdate, round(o_totalprice, 4) AS o_totalprice, o_custkey FROM orders "
    "WHERE o_custkey IN (SELECT o_custkey FROM top)",
    ops="V9 O5",
)
def area_top_hues(spark, sf):
    return rounded(V.area_data(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", hue="o_custkey"))


@query(
    "bar_estimator",
    "SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS value FROM lineitem "
    "WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2",
    ops="V10 A11 U1 (mean)",
)
def bar_estimator(spark, sf):
    return rounded(V.bar_data(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", hue="l_linestatus"))


@query(
    "bar_median",
    "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS value FROM orders "
    "WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1",
    ops="V10 U1 (median)",
)
def bar_median(spark, sf):
    return rounded(V.bar_data(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", estimator="median"))


@query(
    "bar_pandas_udf",
    "SELECT o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 4) AS value FROM orders "
    "WHERE o_orderstatus IS NOT NULL GROUP BY 1",
    ops="U1 (own estimator, Column -> Column)",
)
def bar_pandas_udf(spark, sf):
    return rounded(V.bar_data(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", estimator=lambda y: F.max(y) - F.min(y)))


@query(
    "pie_other",
    "WITH g AS (SELECT CAST(p_type AS VARCHAR) AS category, count(*)::DOUBLE AS value FROM part "
    "WHERE p_type IS NOT NULL GROUP BY 1), "
    "t AS (SELECT * FROM g ORDER BY value DESC, category LIMIT 6), "
    "o AS (SELECT 'Other (' || ((SELECT count(*) FROM g) - 6) || ')' AS category, "
    "(SELECT sum(value) FROM g) - (SELECT sum(value) FROM t) AS value), "
    "u AS (SELECT * FROM t UNION ALL SELECT * FROM o WHERE value > 1e-9) "
    "SELECT category, round(value, 4) AS value, round(value * 100.0 / (SELECT sum(value) FROM u), 4) AS pct FROM u",
    ops="V11 O4 A9",
)
def pie_other(spark, sf):
    return rounded(V.pie_data(table(spark, sf, "part"), "p_type"))


@query(
    "pie_sum",
    "WITH u AS (SELECT o_orderpriority AS category, sum(o_totalprice) AS value FROM orders WHERE o_totalprice > 0 "
    "AND o_orderpriority IS NOT NULL GROUP BY 1) "
    "SELECT category, round(value, 4) AS value, round(value * 100.0 / (SELECT sum(value) FROM u), 4) AS pct FROM u",
    ops="V11 A10",
)
def pie_sum(spark, sf):
    return rounded(V.pie_data(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


_PAIR = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def _pair_sql() -> str:
    stats = ", ".join(f"min({c})::DOUBLE AS a_{c}, max({c})::DOUBLE AS b_{c}" for c in _PAIR)
    edges = ", ".join(
        f"CASE WHEN a_{c} < b_{c} THEN a_{c} ELSE a_{c} - 0.5 END AS f_{c}, "
        f"CASE WHEN a_{c} < b_{c} THEN b_{c} ELSE b_{c} + 0.5 END AS l_{c}" for c in _PAIR)

    def b(c, k=20):
        return f"least(CAST(floor(({c} - f_{c}) * ({k} / (l_{c} - f_{c}))) AS BIGINT), {k - 1})"

    parts = []
    for cx in _PAIR:
        for cy in _PAIR:
            if cx == cy:
                parts.append(f"SELECT '{cx}' AS col_x, '{cy}' AS col_y, {b(cx)} AS bin_x, NULL::BIGINT AS bin_y, "
                             f"count(*) AS \"count\" FROM src, e WHERE {cx} IS NOT NULL GROUP BY 3")
            else:
                parts.append(f"SELECT '{cx}', '{cy}', {b(cx)}, {b(cy)}, count(*) FROM src, e "
                             f"WHERE {cx} IS NOT NULL AND {cy} IS NOT NULL GROUP BY 3, 4")
    return (f"WITH src AS ({LINEITEM_N_SQL}), s AS (SELECT {stats} FROM src), e AS (SELECT {edges} FROM s) "
            + " UNION ALL ".join(parts))


@query("pair_hist", _pair_sql(), ops="V12 O6")
def pair_hist(spark, sf):
    return V.pair_data(lineitem_n(spark, sf))


@query(
    "distribution_curve",
    "WITH d AS (SELECT o_totalprice AS x FROM orders WHERE o_totalprice IS NOT NULL), "
    "s AS (SELECT count(*) AS n, pow(count(*), -0.2) * stddev_samp(x) AS h, min(x) AS mn, max(x) AS mx FROM d), "
    "g AS (SELECT (mn - 3.0 * h) + ((mx + 3.0 * h) - (mn - 3.0 * h)) * i / 199 AS gx, h, n "
    "FROM s, (SELECT unnest(range(200)) AS i)) "
    "SELECT round(gx, 2) AS x, round(1e6 * sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi())), 4) "
    "AS density FROM g, d GROUP BY gx, h, n",
    ops="V2 (curve beside the density histogram)",
)
def distribution_curve(spark, sf):
    _hist, curve = V.distribution(table(spark, sf, "orders"), "o_totalprice")
    return curve.select(round_half_away(F.col("x"), 2).alias("x"), round_half_away(F.col("density") * 1e6, 4).alias("density"))


_ODD = {"l_returnflag": "flag.a b", "l_linestatus": "status/x", "l_quantity": "q.t", "l_extendedprice": "price (net)", "l_shipdate": "day.of ship"}


@query(
    "odd_names",
    "WITH q AS (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.5) AS m FROM lineitem GROUP BY 1), "
    "l AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) "
    "SELECT 'box' AS chart, f AS k, round(m, 4) AS v FROM q "
    "UNION ALL SELECT 'bar', l_returnflag || l_linestatus, round(avg(l_extendedprice), 4) FROM lineitem GROUP BY l_returnflag, l_linestatus "
    "UNION ALL SELECT 'line', l_linestatus, round(sum(m), 4) FROM (SELECT l_shipdate, l_linestatus, avg(l_extendedprice) AS m "
    "FROM lineitem GROUP BY 1, 2) GROUP BY 2 "
    "UNION ALL SELECT 'scatter', l_returnflag, round(sum(l_quantity), 4) FROM lineitem GROUP BY 2 "
    "UNION ALL SELECT 'area', l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY 2 "
    "UNION ALL SELECT 'violin', l_returnflag, 100.0 FROM lineitem GROUP BY 2 "
    "UNION ALL SELECT 'fit', '', round(avg(a + b * l_quantity), 4) FROM lineitem, l",
    ops="V4 V5 V6 V8 V9 V10 M4 (column names with dots, spaces, slashes, parentheses)",
)
def odd_names(spark, sf):
    from quarry.models import pipeline as MP

    df = table(spark, sf, "lineitem").select(*[F.col(c).alias(n) for c, n in _ODD.items()])
    flag, status, q, price, day = (F.col(f"`{n}`") for n in _ODD.values())
    f_, s_, q_, p_, d_ = _ODD.values()
    box, _points = V.box_stats(df, f_, p_)
    curve, _quart = V.violin(df, f_, p_)
    fm = MP.fit(df, [q_], p_, "linear")
    parts = [
        box.select(F.lit("box").alias("chart"), flag.alias("k"), F.col("median").alias("v")),
        V.bar_data(df, f_, p_, hue=s_).select(F.lit("bar"), F.concat(flag, status), "value"),
        V.line_data(df, d_, p_, hue=s_).groupBy(status.alias("k")).agg(F.sum(price).alias("v")).select(F.lit("line"), "k", "v"),
        V.scatter_points(df, q_, p_, f_).groupBy(flag.alias("k")).agg(F.sum(q).alias("v")).select(F.lit("scatter"), "k", "v"),
        V.area_data(df, d_, p_, hue=f_).groupBy(flag.alias("k")).agg(F.count("*").cast("double").alias("v")).select(F.lit("area"), "k", "v"),
        curve.groupBy(flag.alias("k")).agg(F.count("*").cast("double").alias("v")).select(F.lit("violin"), "k", "v"),
        fm.transform(df).agg(F.avg("prediction").alias("v")).select(F.lit("fit"), F.lit(""), "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return rounded(out)


@query(
    "quartiles_by_brackets",
    "SELECT l_returnflag, p, round(CASE p WHEN 0.25 THEN q1 WHEN 0.5 THEN q2 ELSE q3 END, 4) AS q, n FROM ("
    "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, "
    "quantile_cont(l_extendedprice, 0.75) AS q3, count(l_extendedprice) AS n FROM lineitem GROUP BY 1), (SELECT unnest([0.25, 0.5, 0.75]) AS p)",
    ops="A4 (the way of large groups: sketch, verified brackets, refinement, bounded rank)",
)
def quartiles_by_brackets(spark, sf):
    from quarry.operators.quantiles import grouped_quantiles

    # groups of the given tables are small: a bound of 500 rows a rank sends them through every step of the large way
    return rounded(grouped_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75],
                                     final_rows=500, buckets=64, accuracy=200))
