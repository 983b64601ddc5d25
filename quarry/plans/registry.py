"""Registry of named queries over the driver tables, each with an optional DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str  # SURVEY operator ids covered


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def round_half_away(c, digits: int = 4):
    """round(x, digits) the way the SQL oracle's engine does it: scale in binary floating point,
    round half away from zero, scale back. (Spark's ``round`` rounds the shortest decimal text
    half-up instead, so exact ties such as 38.37875 would round apart.)"""
    m = F.lit(10.0 ** digits)
    scaled = c.cast("double") * m
    return F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)) / m


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every float column (the oracle compare is on rounded values)."""
    return df.select(
        *[
            round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
