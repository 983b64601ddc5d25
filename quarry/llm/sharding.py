"""Sharding by extendible hashing.

Rows are cells of a directory indexed by the leading bits of a hash of their key. A bucket that exceeds the byte
limit splits on the next bit, the others stay, until every bucket fits. Only sums by prefix are moved: one row for
each of the finest cells, whose number follows the number of shards, not of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: Bits of the hash; bits by which the finest cells of a pass are deeper than a shard of average size.
HASH_BITS, SPARE_BITS = 60, 6


def hash_of(*keys):
    """60 bits of the md5 of the keys' texts (null: empty text; the texts are joined by a line feed)."""
    text = F.concat_ws("\n", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def directory(cells: DataFrame, limit: int) -> DataFrame:
    """Rows (hash, bytes) -> buckets: depth, prefix, n_rows, n_bytes, oversized. A bucket of one hash value that is
    too large cannot split: it stays whole and is marked oversized. One pass covers a directory some bits deeper
    than shards of average size need; only cells that are too large even there take another, deeper pass."""
    total = cells.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    top, finest, found = 0, min(HASH_BITS, math.ceil(math.log2(max(total / limit, 1))) + SPARE_BITS), []
    todo = cells
    while True:
        cell = F.shiftrightunsigned("hash", HASH_BITS - finest)
        sums = todo.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        # a cell's ancestor at every depth of the pass with its sums; its bucket is the first that fits
        levels = F.explode(F.sequence(F.lit(top), F.lit(finest))).alias("depth")
        prefix = F.expr(f"shiftrightunsigned(cell, {finest} - depth)")
        tree = (sums.select("cell", "bytes", "n", levels).groupBy("depth", prefix.alias("prefix"))
                .agg(F.sum("bytes").alias("n_bytes"), F.sum("n").alias("n_rows")))
        last = F.lit(finest == HASH_BITS) & (F.col("depth") == finest)
        tree = stored(tree.withColumn("fits", (F.col("n_bytes") <= limit) | last), "tree")
        parent = tree.where("not fits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        own = tree.where("fits").withColumn("parent", F.shiftrightunsigned("prefix", 1))
        found.append(own.where(F.col("depth") == top).drop("parent", "fits"))
        found.append(own.where(F.col("depth") > top).join(parent, ["depth", "parent"], "left_semi").drop("parent", "fits"))
        large = tree.where((F.col("depth") == finest) & ~F.col("fits")).select(F.col("prefix").alias("c"))
        if large.isEmpty():
            break
        todo = todo.join(large, cell == F.col("c"), "left_semi")
        top, finest = finest + 1, min(HASH_BITS, finest + 12)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return stored(out.select("depth", "prefix", "n_rows", "n_bytes", (F.col("n_bytes") > limit).alias("oversized")), "directory")


def shard(df: DataFrame, limit: int, key_cols: tuple[str, ...] = ("doc_id",), size=None) -> DataFrame:
    """The directory and each row's place in it: the columns of ``df`` and a struct ``shard`` (depth, prefix, id,
    n_rows, n_bytes, oversized). ``size``: a column expression for a row's bytes (the text's by default).

    Null keys count as empty texts and null sizes as 0. Rows with equal keys share a hash, so they stay in one
    shard, marked oversized where they exceed the limit. An empty table gives no rows. ``df`` is read twice or more:
    give a stored table."""
    from quarry.llm.common import free_name

    size = F.octet_length("text") if size is None else size
    place = F.struct(hash_of(*[F.col(f"`{k}`") for k in key_cols]).alias("hash"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))
    at = free_name(df, "shard_place")
    held = df.withColumn(at, place)
    buckets = directory(held.select(f"{at}.*"), limit)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most one a bit of the hash
    # a row's bucket is the one of its prefixes that is in the directory
    prefixes = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned(f"{at}.hash", HASH_BITS - d).alias("prefix")) for d in sorted(depths)])
    key = free_name(df, "shard_key")
    known = buckets.select(F.struct("depth", "prefix").alias(key), F.struct(
        "depth", "prefix", F.concat(F.col("depth").cast("string"), F.lit("-"), F.col("prefix").cast("string")).alias("id"),
        "n_rows", "n_bytes", "oversized").alias("shard"))
    return held.withColumn(key, F.explode(prefixes)).join(known, key).drop(key, at)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, written by one task each."""
    flat = sharded.withColumn("shard_id", F.col("shard.id")).drop("shard")
    flat.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
