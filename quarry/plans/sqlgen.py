"""Small helpers that write the DuckDB oracle SQL for the registered queries."""

from __future__ import annotations

# Identical NULL injection in both engines (the driver tables carry no NULLs).
LINEITEM_N_EXPRS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "CASE WHEN (l_orderkey*7+l_linenumber)%11=0 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_extendedprice",
    "CASE WHEN (l_orderkey*5+l_linenumber)%17=0 THEN NULL ELSE l_discount END AS l_discount",
    "l_tax",
    "CASE WHEN (l_orderkey*3+l_linenumber)%13=0 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "l_linestatus", "l_shipdate",
]
LINEITEM_N_SQL = "SELECT " + ", ".join(LINEITEM_N_EXPRS) + " FROM lineitem"


def with_views(body: str, **views: str) -> str:
    ctes = ", ".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {ctes} {body}" if ctes else body


def profile_sql(src: str, cols: list[tuple[str, str, str]]) -> str:
    """cols = [(name, spark_type, kind)] with kind 'numeric' or 'other'."""
    parts = []
    for i, (c, dtype, kind) in enumerate(cols):
        if kind == "numeric":
            x = f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END"
            parts.append(
                f"SELECT {i} AS ord, '{c}' AS \"column\", '{dtype}' AS data_type, count({x}) AS \"count\", "
                f"count(*)-count({x}) AS null_count, (count(*)-count({x}))*100.0/count(*) AS null_pct, "
                f"NULL::BIGINT AS \"unique\", avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, "
                f"stddev_samp({x}) AS std, min({x}) AS \"min\", max({x}) AS \"max\", "
                f"quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.75) AS q75, "
                f"CASE WHEN min({x}) < max({x}) THEN skewness({x}) END AS skewness, "
                f"NULL::VARCHAR AS top, NULL::BIGINT AS freq_top, NULL::VARCHAR AS \"first\", "
                f"NULL::VARCHAR AS \"last\" FROM src"
            )
        else:
            temporal = dtype.startswith("timestamp") or dtype == "date"
            fl = (f"CAST(min({c}) AS VARCHAR) AS \"first\", CAST(max({c}) AS VARCHAR) AS \"last\"" if temporal
                  else "NULL::VARCHAR AS \"first\", NULL::VARCHAR AS \"last\"")
            x = f"CAST({c} AS VARCHAR)"
            parts.append(
                f"SELECT {i} AS ord, '{c}' AS \"column\", '{dtype}' AS data_type, count({x}) AS \"count\", "
                f"count(*)-count({x}) AS null_count, (count(*)-count({x}))*100.0/count(*) AS null_pct, "
                f"(SELECT count(DISTINCT {x}) FROM src) AS \"unique\", NULL::DOUBLE AS mean, NULL::DOUBLE AS median, "
                f"NULL::DOUBLE AS std, NULL::DOUBLE AS \"min\", NULL::DOUBLE AS \"max\", NULL::DOUBLE AS q25, "
                f"NULL::DOUBLE AS q75, NULL::DOUBLE AS skewness, "
                f"(SELECT CASE WHEN length(v) > 50 THEN substr(v, 1, 50) || '...' ELSE v END FROM "
                f"(SELECT {x} AS v, count(*) AS cnt FROM src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, v LIMIT 1)) AS top, "
                f"coalesce((SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM src WHERE {c} IS NOT NULL GROUP BY {x})), 0) AS freq_top, "
                f"{fl} FROM src"
            )
    body = " UNION ALL ".join(parts)
    cols_out = ('"column", data_type, "count", null_count, round(null_pct, 4) AS null_pct, "unique", '
                'round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round("min", 4) AS "min", '
                'round("max", 4) AS "max", round(q25, 4) AS q25, round(q75, 4) AS q75, round(skewness, 4) AS skewness, '
                'top, freq_top, "first", "last"')
    return f"WITH src AS ({src}) SELECT {cols_out} FROM ({body}) ORDER BY ord"
