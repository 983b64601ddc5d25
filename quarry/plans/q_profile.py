"""Profiling / aggregate queries (A1–A14) over the driver tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.plans.registry import query, rounded, table
from quarry.plans.sqlgen import LINEITEM_N_EXPRS, LINEITEM_N_SQL, profile_sql


def lineitem_n(spark, sf):
    """lineitem with NULLs injected identically to the SQL oracle."""
    return table(spark, sf, "lineitem").selectExpr(*LINEITEM_N_EXPRS)


_LI_COLS = [
    ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
    ("l_linenumber", "int", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("l_returnflag", "string", "other"),
    ("l_linestatus", "string", "other"), ("l_shipdate", "timestamp_ntz", "other"),
]
_EV_COLS = [
    ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "other"), ("user_id", "bigint", "numeric"),
    ("event_type", "string", "other"), ("value", "double", "numeric"), ("props", "string", "other"),
]


@query("profile_lineitem", profile_sql(LINEITEM_N_SQL, _LI_COLS), ops="A1-A7 S3")
def profile_lineitem(spark, sf):
    return rounded(P.profile(lineitem_n(spark, sf)))


@query("profile_events", profile_sql("SELECT * FROM events", _EV_COLS), ops="A1-A7")
def profile_events(spark, sf):
    return rounded(P.profile(table(spark, sf, "events")))


@query(
    "profile_orders_customer",
    profile_sql(
        "SELECT o_totalprice, o_orderstatus, o_orderpriority, c_acctbal, c_mktsegment "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
        [("o_totalprice", "double", "numeric"), ("o_orderstatus", "string", "other"),
         ("o_orderpriority", "string", "other"), ("c_acctbal", "double", "numeric"),
         ("c_mktsegment", "string", "other")],
    ),
    ops="A1 (joined input)",
)
def profile_orders_customer(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey).select("o_totalprice", "o_orderstatus", "o_orderpriority",
                                                      "c_acctbal", "c_mktsegment")
    return rounded(P.profile(j))


_NULL_SHARE_SQL = (
    f"WITH src AS ({LINEITEM_N_SQL}) "
    "SELECT \"column\", null_count, round(null_count*100.0/n, 4) AS null_pct FROM ("
    "SELECT 'l_quantity' AS \"column\", count(*)-count(l_quantity) AS null_count, count(*) AS n FROM src UNION ALL "
    "SELECT 'l_discount', count(*)-count(l_discount), count(*) FROM src UNION ALL "
    "SELECT 'l_returnflag', count(*)-count(l_returnflag), count(*) FROM src UNION ALL "
    "SELECT 'l_tax', count(*)-count(l_tax), count(*) FROM src)"
)


@query("null_share", _NULL_SHARE_SQL, ops="A2")
def null_share(spark, sf):
    return rounded(P.null_share(lineitem_n(spark, sf), ["l_quantity", "l_discount", "l_returnflag", "l_tax"]))


@query(
    "value_counts_event_type",
    "SELECT event_type, count(*) AS \"count\" FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    ops="A9",
)
def value_counts_event_type(spark, sf):
    return P.value_counts(table(spark, sf, "events"), "event_type")


@query(
    "value_counts_labels",
    "SELECT quality, count(*) AS \"count\" FROM labels WHERE quality IS NOT NULL GROUP BY quality",
    ops="A9",
)
def value_counts_labels(spark, sf):
    return P.value_counts(table(spark, sf, "labels"), "quality")


@query(
    "distinct_count_partkey",
    "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem",
    ops="A8",
)
def distinct_count_partkey(spark, sf):
    return P.distinct_count(table(spark, sf, "lineitem"), "l_partkey")


@query(
    "group_sum_positive",
    "SELECT o_orderpriority, round(sum(o_totalprice), 4) AS \"sum\" FROM orders "
    "WHERE o_totalprice > 0 AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority",
    ops="A10 F8",
)
def group_sum_positive(spark, sf):
    return rounded(P.group_sum_positive(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for a in _CORR_COLS:
        for b in _CORR_COLS:
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                f"round(CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0 THEN "
                f"greatest(-1.0, least(1.0, corr({a}, {b}))) END, 4) AS corr FROM src"
            )
    return f"WITH src AS ({LINEITEM_N_SQL}) " + " UNION ALL ".join(parts)


@query("corr_matrix_lineitem", _corr_sql(), ops="A13 V7")
def corr_matrix_lineitem(spark, sf):
    return rounded(P.correlation_matrix(lineitem_n(spark, sf), _CORR_COLS))


# one hundred columns: four of the table under 25 rules each for what is missing
_WIDE = [(f"c{i:02d}", _CORR_COLS[i % 4], i) for i in range(100)]
_WIDE_SHOWN = [0, 1, 2, 3, 41, 62, 98, 99]  # columns whose pairs the query returns


def _wide_case(col: str, i: int) -> str:
    return f"CASE WHEN (l_orderkey * {i + 3} + l_linenumber) % {i + 5} = 0 THEN NULL ELSE {col} END"


def _corr_wide_sql():
    src = ", ".join(f"{_wide_case(_WIDE[i][1], i)} AS {_WIDE[i][0]}" for i in _WIDE_SHOWN)
    names = [_WIDE[i][0] for i in _WIDE_SHOWN]
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS corr FROM src" for a in names for b in names]
    return f"WITH src AS (SELECT {src} FROM lineitem) " + " UNION ALL ".join(parts)


@query("corr_matrix_wide", _corr_wide_sql(), ops="A13 V7 (100 columns with missing values, one scan)")
def corr_matrix_wide(spark, sf):
    src = table(spark, sf, "lineitem").select(*[F.expr(_wide_case(c, i)).alias(n) for n, c, i in _WIDE])
    names = [_WIDE[i][0] for i in _WIDE_SHOWN]
    return rounded(P.correlation_matrix(src).where(F.col("col_a").isin(names) & F.col("col_b").isin(names)))


@query("shape_lineitem", "SELECT count(*) AS \"rows\", 11::BIGINT AS \"columns\" FROM lineitem", ops="A14")
def shape_lineitem(spark, sf):
    return P.shape(table(spark, sf, "lineitem"))


@query(
    "profile_part",
    profile_sql("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
                [("p_partkey", "bigint", "numeric"), ("p_name", "string", "other"), ("p_brand", "string", "other"),
                 ("p_type", "string", "other"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")]),
    ops="A1 A6 (ties → smallest)",
)
def profile_part(spark, sf):
    return rounded(P.profile(table(spark, sf, "part")))


@query(
    "numeric_projection",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
    "FROM lineitem",
    ops="F3 O6",
)
def numeric_projection(spark, sf):
    from quarry.functions.columns import select_type_class

    return select_type_class(table(spark, sf, "lineitem"), "numeric")


@query(
    "drop_columns",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders",
    ops="F1",
)
def drop_columns_q(spark, sf):
    from quarry.operators.clean import drop_columns

    return drop_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "not_a_column"])


@query(
    "select_features",
    "SELECT c_acctbal, c_nationkey, c_mktsegment FROM customer",
    ops="F2",
)
def select_features_q(spark, sf):
    from quarry.operators.clean import select_features

    return rounded(select_features(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment"))


@query("head_preview", "SELECT * FROM lineitem LIMIT 5", ops="O7 (preview: the limit is the feature)")
def head_preview(spark, sf):
    from quarry.operators.clean import head

    return head(table(spark, sf, "lineitem"), 5)


@query(
    "profile_documents",
    profile_sql("SELECT doc_id, text, lang, source, n_chars FROM documents",
                [("doc_id", "bigint", "numeric"), ("text", "string", "other"), ("lang", "string", "other"),
                 ("source", "string", "other"), ("n_chars", "bigint", "numeric")]),
    ops="A1 A6 (whole long texts; modal text cut to 50 characters)",
)
def profile_documents(spark, sf):
    return rounded(P.profile(table(spark, sf, "documents")))


@query(
    "profile_sketch",
    'SELECT c AS "column", n AS "count", true AS unique_near, true AS frequency_near, true AS median_near FROM ('
    "SELECT 'c_name' AS c, count(c_name) AS n FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer "
    "UNION ALL SELECT 'c_custkey', count(c_custkey) FROM customer UNION ALL SELECT 'c_acctbal', count(c_acctbal) FROM customer)",
    ops="A1 A4 A6 A8 (exact=False: mergeable sketches within their stated errors)",
)
def profile_sketch(spark, sf):
    cols = ["c_name", "c_mktsegment", "c_custkey", "c_acctbal"]
    df = table(spark, sf, "customer").select(*cols)
    near, true = (P.profile(df, exact=e).select("column", "count", "unique", "freq_top", "median", "min", "max") for e in (False, True))
    both = near.alias("a").join(true.alias("b"), "column")

    def within(c, bound):
        return F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= bound, F.lit(True))

    return both.select(
        "column", F.col("b.count").alias("count"), within("unique", 3 * P.SKETCH_RSD * F.col("b.unique")).alias("unique_near"),
        within("freq_top", F.ceil(P.SKETCH_ERROR * F.col("b.count"))).alias("frequency_near"),
        within("median", 0.01 * (F.col("b.max") - F.col("b.min"))).alias("median_near"))
