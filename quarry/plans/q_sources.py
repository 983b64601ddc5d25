"""Source/sink queries (S1–S9): driver tables written out by Spark, read back by our readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.registry import query, rounded, table
from quarry.session import scratch_path
from quarry.sources import readers as R

# NA tokens injected identically in both engines: 'NA' for some prices, 'null' for some priorities
_PRICE_NA = "(o_orderkey * 7) % 19 = 0"
_PRIO_NA = "(o_orderkey * 3) % 23 = 0"


@query(
    "csv_roundtrip",
    f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN {_PRICE_NA} THEN NULL ELSE round(o_totalprice, 4) END "
    f"AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, CASE WHEN {_PRIO_NA} THEN NULL ELSE o_orderpriority "
    "END AS o_orderpriority FROM orders",
    ops="S1 S2 S3 S6 S8",
)
def csv_roundtrip(spark, sf):
    o = table(spark, sf, "orders")
    out = o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.expr(_PRICE_NA), F.lit("NA")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        F.when(F.expr(_PRIO_NA), F.lit("null")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    path = scratch_path(spark, "orders-csv") + ".csv"
    R.write_table(out, path, "csv")
    return rounded(R.load(spark, path))


@query(
    "json_lines_roundtrip",
    "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment "
    "FROM customer",
    ops="S4 S6",
)
def json_lines_roundtrip(spark, sf):
    path = scratch_path(spark, "customer-json") + ".json"
    table(spark, sf, "customer").write.json(path)
    d = R.load(spark, path)
    return rounded(d.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("load_parquet", "SELECT * FROM nation", ops="S6 (parquet)")
def load_parquet(spark, sf):
    return R.load(spark, f"{sf.rstrip('/')}/nation.parquet")


@query(
    "load_many_union",
    "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 4) AS s_acctbal, NULL::VARCHAR AS r_name FROM supplier "
    "UNION ALL SELECT NULL, NULL, NULL, NULL, r_name FROM region",
    ops="S3 (unionByName, missing columns)",
)
def load_many_union(spark, sf):
    d = R.load_many(spark, [f"{sf.rstrip('/')}/supplier.parquet", f"{sf.rstrip('/')}/region.parquet"])
    return rounded(d.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal", "r_name"))


@query(
    "csv_folder_orders",
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus, "
    "round(o_totalprice, 4) AS o_totalprice, CASE WHEN o_orderkey % 3 = 2 THEN 'x' || o_custkey END AS note FROM orders",
    ops="S1 S3 (a folder whose files have their columns in different orders, and columns of their own)",
)
def csv_folder_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"))
    path = scratch_path(spark, "orders-folder")
    kinds = [["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], ["o_totalprice", "o_custkey", "o_orderkey"],
             ["o_orderstatus", "note", "o_orderkey", "o_totalprice", "o_custkey"]]
    for k, columns in enumerate(kinds):
        part = o.where(F.col("o_orderkey") % 3 == k).withColumn("note", F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
        part.select(*columns).write.mode("append").option("header", True).csv(path)
    return rounded(R.read_csv(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "note"))


@query(
    "csv_awkward",
    "SELECT c_custkey AS \"k.x\", c_custkey * 2 AS \"K.x.1\", c_name || chr(10) || '\"' || c_mktsegment || '\", é' AS \"text of, it\", "
    "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE round(c_acctbal, 4) END AS bal FROM customer",
    ops="S1 S2 (UTF-16, quoted line breaks and separators, names that differ in case alone, missing tokens)",
)
def csv_awkward(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.col("c_name"), F.lit('\n"'), F.col("c_mktsegment"), F.lit('", é'))
    bal = F.when(F.col("c_custkey") % 5 == 0, F.lit("#N/A")).otherwise(F.col("c_acctbal").cast("string"))
    path = scratch_path(spark, "customer-utf16")
    out = c.select(F.col("c_custkey").alias("k.x"), (F.col("c_custkey") * 2).alias("two"), text.alias("text of, it"), bal.alias("bal"))
    # the header is written as a row: a table cannot have two names that differ in case alone
    lines = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(f"`{n}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for n in out.columns])
    out.repartition(2).select(lines.alias("line")).mapInArrow(_utf16_files(path), "n long").agg(F.sum("n")).collect()
    return rounded(R.read_csv(spark, path))


def _utf16_files(path: str):
    """Task function: each partition's lines become one UTF-16 file with a byte-order mark under ``path``."""
    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        lines = ['"k.x",K.x,"text of, it",bal']
        for b in batches:
            lines += b.column(0).to_pylist()
        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{uuid.uuid4().hex}.csv") as f:
            f.write("\r\n".join(lines).encode("utf-16"))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(lines) - 1], pa.int64())})

    return run
