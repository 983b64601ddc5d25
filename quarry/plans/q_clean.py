"""Cleaning, outlier, encoding, skew and scaling queries (F*, I*, R*, O1, X*, E*, K*, Z*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean as C
from quarry.operators import encode as E
from quarry.operators import outliers as X
from quarry.operators import transform as T
from quarry.plans.q_profile import lineitem_n
from quarry.plans.registry import query, rounded, table
from quarry.plans.sqlgen import LINEITEM_N_SQL

SRC = f"WITH src AS ({LINEITEM_N_SQL}) "

# ------------------------------------------------------------------ missing values / filters

# a mostly-missing column (line numbers above 2 → NULL) and an all-missing one
_SPARSE = "CASE WHEN l_linenumber > 2 THEN NULL ELSE l_tax END"


def _li4(spark, sf):
    return lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "drop_cols_threshold",
    SRC + "SELECT l_orderkey, l_linenumber, l_quantity FROM src",
    ops="F5 F1",
)
def drop_cols_threshold(spark, sf):
    df = lineitem_n(spark, sf).selectExpr("l_orderkey", "l_linenumber", "l_quantity", f"{_SPARSE} AS l_tax_sparse")
    return C.drop_columns_by_null_share(df, 0.5)


@query(
    "drop_all_null_cols",
    SRC + "SELECT l_orderkey, l_quantity FROM src",
    ops="F4",
)
def drop_all_null_cols(spark, sf):
    df = lineitem_n(spark, sf).selectExpr("l_orderkey", "l_quantity", "CAST(NULL AS DOUBLE) AS all_null")
    return C.drop_all_null_columns(df)


def _fill_sql(stat_q: str, stat_d: str) -> str:
    return (
        SRC + f"SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, ({stat_q})), 4) AS l_quantity, "
        f"round(coalesce(l_discount, ({stat_d})), 4) AS l_discount FROM src"
    )


def _mode_sql(col: str, src: str = "src") -> str:
    return (f"SELECT v FROM (SELECT {col} AS v, count(*) AS c FROM {src} WHERE {col} IS NOT NULL "
            f"GROUP BY 1 ORDER BY c DESC, v LIMIT 1)")


@query("impute_mean", _fill_sql("SELECT avg(l_quantity) FROM src", "SELECT avg(l_discount) FROM src"), ops="I1")
def impute_mean(spark, sf):
    return rounded(C.impute(_li4(spark, sf), ["l_quantity", "l_discount"], "mean"))


@query(
    "impute_median",
    _fill_sql("SELECT quantile_cont(l_quantity, 0.5) FROM src", "SELECT quantile_cont(l_discount, 0.5) FROM src"),
    ops="I2",
)
def impute_median(spark, sf):
    return rounded(C.impute(_li4(spark, sf), ["l_quantity", "l_discount"], "median"))


@query("impute_mode_num", _fill_sql(_mode_sql("l_quantity"), _mode_sql("l_discount")), ops="I3")
def impute_mode_num(spark, sf):
    return rounded(C.impute(_li4(spark, sf), ["l_quantity", "l_discount"], "mode", empty_default=0.0))


@query(
    "impute_mode_cat",
    SRC + f"SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, ({_mode_sql('l_returnflag')})) AS l_returnflag FROM src",
    ops="I4",
)
def impute_mode_cat(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    return C.impute(df, ["l_returnflag"], "mode", empty_default="Unknown")


@query(
    "impute_constant",
    SRC + "SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -1.0) AS l_quantity, "
    "coalesce(l_returnflag, 'Unknown') AS l_returnflag FROM src",
    ops="I5 I6",
)
def impute_constant(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    df = C.impute(df, ["l_quantity"], "specific", -1.0)
    return C.impute(df, ["l_returnflag"], "constant", "Unknown")


@query(
    "clean_util_chain",
    SRC + "SELECT l_orderkey, l_linenumber, "
    "round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM src)), 4) AS l_quantity, "
    "round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM src)), 4) AS l_discount, "
    f"coalesce(l_returnflag, ({_mode_sql('l_returnflag')})) AS l_returnflag FROM src",
    ops="I9 F5 I2 I4",
)
def clean_util_chain(spark, sf):
    df = lineitem_n(spark, sf).selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
                                          f"{_SPARSE} AS l_tax_sparse")
    return rounded(C.handle_missing(df))


@query(
    "clean_util_dropcol_droprow",
    SRC + "SELECT l_orderkey, l_linenumber, l_returnflag FROM src WHERE l_returnflag IS NOT NULL",
    ops="I7 I9 F7",
)
def clean_util_dropcol_droprow(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return C.handle_missing(df, numeric_strategy="drop_col", categorical_strategy="drop_row")


@query(
    "clean_gui_chain",
    SRC + ", s2 AS (SELECT * FROM src WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL) "
    "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, "
    f"coalesce(l_returnflag, ({_mode_sql('l_returnflag', 's2')})) AS l_returnflag FROM s2",
    ops="I8 F4 F6",
)
def clean_gui_chain(spark, sf):
    df = lineitem_n(spark, sf).selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag",
                                          "CAST(NULL AS DOUBLE) AS all_null")
    return C.gui_clean_missing(df, numeric="Remove Rows with NaN", categorical="Mode", drop_all_null_cols=True,
                               drop_any_null_rows=True)


@query(
    "drop_rows_any",
    SRC + "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM src "
    "WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL",
    ops="F7",
)
def drop_rows_any(spark, sf):
    return C.drop_rows_with_missing(_li4(spark, sf))


@query(
    "scoring_fill_zero",
    SRC + "SELECT l_orderkey, l_linenumber, coalesce(l_quantity, 0.0) AS l_quantity, "
    "coalesce(l_discount, 0.0) AS l_discount FROM src",
    ops="I11",
)
def scoring_fill_zero(spark, sf):
    return C.scoring_fill(_li4(spark, sf), ["l_quantity", "l_discount"])


@query(
    "training_clean",
    SRC + "SELECT DISTINCT round(coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM src)), 4) AS l_quantity, "
    f"coalesce(l_returnflag, ({_mode_sql('l_returnflag')})) AS l_returnflag, l_linestatus FROM src",
    ops="I10 R1",
)
def training_clean(spark, sf):
    df = lineitem_n(spark, sf).select("l_quantity", "l_returnflag", "l_linestatus")
    return rounded(C.training_clean(df))


# ------------------------------------------------------------------ duplicates / sort


@query("dedupe_rows", SRC + "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM src", ops="R1")
def dedupe_rows(spark, sf):
    return C.drop_duplicates(lineitem_n(spark, sf).select("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "dedupe_keep_none",
    SRC + "SELECT l_suppkey, l_quantity, l_returnflag FROM src GROUP BY ALL HAVING count(*) = 1",
    ops="R2",
)
def dedupe_keep_none(spark, sf):
    return C.drop_duplicates(lineitem_n(spark, sf).select("l_suppkey", "l_quantity", "l_returnflag"), keep=False)


@query(
    "duplicate_count",
    SRC + "SELECT ((SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, "
    "l_quantity FROM src)))::BIGINT AS duplicates_removed",
    ops="R3",
)
def duplicate_count(spark, sf):
    return C.duplicate_count(lineitem_n(spark, sf).select("l_returnflag", "l_linestatus", "l_quantity"))


@query("sort_nulls_last", SRC + "SELECT l_orderkey, l_linenumber, l_quantity FROM src", ops="O1")
def sort_nulls_last(spark, sf):
    return C.sort_stable(lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity",
                         ascending=False)


# ------------------------------------------------------------------ outliers

_FENCE = ("WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), "
          "f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) ")


@query(
    "outlier_flag",
    _FENCE + "SELECT event_id, round(value, 4) AS value, coalesce(value < lo OR value > hi, false) AS is_outlier "
    "FROM events, f",
    ops="X1",
)
def outlier_flag(spark, sf):
    return rounded(X.flag_outliers(table(spark, sf, "events").select("event_id", "value"), "value"))


@query(
    "outlier_cap",
    _FENCE + "SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 4) AS value "
    "FROM events, f",
    ops="X2",
)
def outlier_cap(spark, sf):
    return rounded(X.treat_outliers(table(spark, sf, "events").select("event_id", "value"), "value", "cap"))


@query(
    "outlier_remove",
    _FENCE + "SELECT event_id, round(value, 4) AS value FROM events, f WHERE value BETWEEN lo AND hi",
    ops="X3",
)
def outlier_remove(spark, sf):
    return rounded(X.treat_outliers(table(spark, sf, "events").select("event_id", "value"), "value", "remove"))


# ------------------------------------------------------------------ encoding


@query(
    "label_encode",
    SRC + ", d AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code FROM "
    "(SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM src)) "
    "SELECT l_orderkey, l_linenumber, d.code AS l_returnflag FROM src JOIN d ON coalesce(l_returnflag, 'nan') = d.v",
    ops="E1 E3",
)
def label_encode(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    out, _ = E.encode(df, ["l_returnflag"], "label")
    return out


@query(
    "label_encode_ptype",
    "WITH d AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code FROM "
    "(SELECT DISTINCT coalesce(p_type, 'nan') AS v FROM part)) "
    "SELECT p_partkey, d.code AS p_type FROM part JOIN d ON coalesce(p_type, 'nan') = d.v",
    ops="E1 (150-level dictionary)",
)
def label_encode_ptype(spark, sf):
    out, _ = E.label_encode(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"])
    return out


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot_dropfirst",
    "SELECT o_orderkey, o_totalprice, "
    + ", ".join(f"coalesce(o_orderpriority = '{p}', false) AS \"o_orderpriority_{p}\"" for p in _PRIOS[1:])
    + " FROM orders",
    ops="E2 E3",
)
def one_hot_dropfirst(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out, _ = E.encode(df, ["o_orderpriority"], "dummy", drop_first=True)
    return out


@query(
    "score_time_encode",
    SRC + ", d AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code FROM "
    "(SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM src WHERE l_linestatus = 'O')) "
    "SELECT l_orderkey, l_linenumber, coalesce(d.code, 0)::BIGINT AS l_returnflag FROM src "
    "LEFT JOIN d ON coalesce(l_returnflag, 'nan') = d.v",
    ops="E5",
)
def score_time_encode(spark, sf):
    li = lineitem_n(spark, sf)
    d = E.build_dictionary(li.filter("l_linestatus = 'O'"), "l_returnflag").withColumnRenamed("code", "code")
    return E.apply_dictionary(li.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", d, "zero")


# ------------------------------------------------------------------ skew transforms

_SKEW = "(SELECT skewness(value) FROM events)"


@query(
    "skew_log",
    f"SELECT event_id, round(CASE WHEN abs({_SKEW}) > 0.75 THEN (CASE WHEN (SELECT min(value) FROM events) <= 0 "
    "THEN ln(1 + value - (SELECT min(value) FROM events)) ELSE ln(value) END) ELSE value END, 4) AS value FROM events",
    ops="K1 K2",
)
def skew_log(spark, sf):
    out, _ = T.deskew(table(spark, sf, "events").select("event_id", "value"), None, "log", 0.75)
    return rounded(out)


@query(
    "skew_sqrt",
    f"SELECT event_id, round(CASE WHEN abs({_SKEW}) > 0.75 THEN sqrt(value) ELSE value END, 4) AS value FROM events",
    ops="K1 K3",
)
def skew_sqrt(spark, sf):
    out, _ = T.deskew(table(spark, sf, "events").select("event_id", "value"), None, "sqrt", 0.75)
    return rounded(out)


@query(
    "skew_log_shifted",
    "SELECT o_orderkey, round(CASE WHEN abs((SELECT skewness(o_totalprice - 200000) FROM orders)) > 0.1 THEN "
    "ln(1 + (o_totalprice - 200000) - (SELECT min(o_totalprice - 200000) FROM orders)) "
    "ELSE o_totalprice - 200000 END, 4) AS centred FROM orders",
    ops="K2 (min <= 0 branch)",
)
def skew_log_shifted(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") - 200000).alias("centred"))
    out, _ = T.deskew(df, ["centred"], "log", 0.1)
    return rounded(out)


@query(
    "boxcox_fixed_lambda",
    "SELECT event_id, round((pow(value, 0.25) - 1) / 0.25, 4) AS value FROM events",
    ops="K4 (given lambda)",
)
def boxcox_fixed_lambda(spark, sf):
    out, _ = T.deskew(table(spark, sf, "events").select("event_id", "value"), ["value"], "boxcox", 0.75,
                      lambdas={"value": 0.25})
    return rounded(out)


def _boxcox_sql(rounds: int = 4, grid: int = 41) -> str:
    """The same λ search replayed in SQL: each round scans a 41-point grid (one var_pop per λ on
    x / geometric-mean), then narrows to the bracket around the best point."""
    g1 = grid - 1
    parts = [
        "WITH d AS (SELECT value AS x FROM events WHERE value IS NOT NULL), ",
        "gm AS (SELECT exp(avg(ln(x))) AS gm FROM d), xs AS (SELECT x / gm AS z FROM d, gm), ",
        f"grid AS (SELECT unnest(range({grid})) AS i), ",
        "b0 AS (SELECT -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi)",
    ]
    for r in range(1, rounds + 1):
        parts.append(
            f", v{r} AS (SELECT i, lo, hi, lo + (hi - lo) * i / {g1} AS lam FROM b{r - 1}, grid), "
            f"e{r} AS (SELECT i, lo, hi, lam, var_pop(CASE WHEN abs(lam) < 1e-12 THEN ln(z) "
            f"ELSE (pow(z, lam) - 1) / lam END) AS v FROM v{r}, xs GROUP BY i, lo, hi, lam), "
            f"b{r} AS (SELECT lam - (hi - lo) / {g1} AS lo, lam + (hi - lo) / {g1} AS hi FROM e{r} "
            f"WHERE v > 0 AND isfinite(v) ORDER BY v, i LIMIT 1)")
    parts.append(
        f" SELECT 'value' AS \"column\", round((SELECT skewness(value) FROM events), 4) AS skew, 'boxcox' AS method, "
        f"round((lo + hi) / 2, 4) AS lambda, 0.0 AS shift FROM b{rounds}")
    return "".join(parts)


@query("boxcox_mle", _boxcox_sql(), ops="K4 (maximum-likelihood lambda)")
def boxcox_mle(spark, sf):
    _, info = T.deskew(table(spark, sf, "events").select("value"), ["value"], "boxcox", 0.75)
    return rounded(info)


# ------------------------------------------------------------------ scaling


def _scale_sql(expr: str) -> str:
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    return SRC + "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round({expr.format(c=c)}, 4) AS {c}" for c in cols) + " FROM src"


_SCALED = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"]


@query(
    "scale_standard",
    _scale_sql("({c} - (SELECT avg({c}) FROM src)) / coalesce(nullif((SELECT stddev_pop({c}) FROM src), 0), 1)"),
    ops="Z1 Z4",
)
def scale_standard(spark, sf):
    out, _ = T.scale(lineitem_n(spark, sf).select(*_SCALED), ["l_quantity", "l_discount", "l_extendedprice"], "standard")
    return rounded(out)


@query(
    "scale_minmax",
    _scale_sql("({c} - (SELECT min({c}) FROM src)) / coalesce(nullif((SELECT max({c}) - min({c}) FROM src), 0), 1)"),
    ops="Z2 Z4",
)
def scale_minmax(spark, sf):
    out, _ = T.scale(lineitem_n(spark, sf).select(*_SCALED), ["l_quantity", "l_discount", "l_extendedprice"], "minmax")
    return rounded(out)


@query(
    "scale_robust",
    _scale_sql("({c} - (SELECT quantile_cont({c}, 0.5) FROM src)) / coalesce(nullif((SELECT quantile_cont({c}, 0.75) "
               "- quantile_cont({c}, 0.25) FROM src), 0), 1)"),
    ops="Z3 Z5",
)
def scale_robust(spark, sf):
    out, _ = T.scale(lineitem_n(spark, sf).select(*_SCALED), ["l_quantity", "l_discount", "l_extendedprice"], "robust")
    return rounded(out)
