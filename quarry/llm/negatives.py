"""Hard-negative mining by secondary sort.

A pair of an anchor and another row travels as one packed key of fixed width: the anchor, the score (descending), the
kind (a row of the anchor's label before one of another) and the other row's id. ``repartitionAndSortWithinPartitions``
deals the keys by anchor and sorts them by the rest, so a task streams each anchor's pairs from the best down: a
positive opens a window of allowed scores, a negative goes to every open window that admits it and still has room. A
task holds the open windows of one anchor (``n_pos`` counters), never an anchor's pairs.

Not every pair is packed. Anchors and rows are dealt into blocks by hash, each anchor block meets every row block
(a stated query set against all rows, in blocks), and a pair of blocks hands on what can still matter: first each
anchor's best ``n_pos`` rows of its label, from which the anchor's windows follow; then, for each window, the best
``n_neg`` negatives inside it. Both are exact: what a block leaves out is outranked within that block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_list, map_arrow, stored

#: Rows of a block.
ANCHOR_BLOCK, ROW_BLOCK = 256, 2048
#: anchor (id, dimension, block, place), score from the top, kind, id: compares as bytes in the order wanted.
KEY = ">QIIIQBQ"
ANCHOR_BYTES, BIAS = 20, 1 << 63
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack(anchor: tuple, score: int, kind: int, other: int) -> bytes:
    """``anchor`` is (id, dimension, block, place in the block)."""
    a, dim, block, at = anchor
    return struct.pack(KEY, a + BIAS, dim, block, at, BIAS - 1 - score, kind, other + BIAS)


def stream(keys, n_neg: int, low: tuple[int, int], high: tuple[int, int]):
    """The negatives of each window, from keys in order."""
    here, windows = None, []
    for key in keys:
        a, _, _, _, s, kind, other = struct.unpack(KEY, key)
        if key[:ANCHOR_BYTES] != here:
            here, windows = key[:ANCHOR_BYTES], []
        score, other = BIAS - 1 - s, other - BIAS
        if kind == 0:
            windows.append([other, score, 0])
            continue
        for w in windows:
            if w[2] < n_neg and low[0] * w[1] <= low[1] * score and high[1] * score <= high[0] * w[1]:
                w[2] += 1
                yield a - BIAS, w[0], w[2], other, w[1], score


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` the k with the highest score, ties to the smaller id."""
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products; an error where one may not fit 64 bits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    raise OverflowError("inner products beyond 64 bits")


def _blocks(rows: DataFrame, size: int, seed: str) -> DataFrame:
    """Rows (id, label, v, dim) packed into one row a block, in a fixed order."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", F.lit(seed)), F.lit(n)).cast("int"))
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())),
                        ("labels", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))])

    def pack_block(key, t):
        flat = t.column("v").combine_chunks().flatten()
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "ids": [t.column("id").to_pylist()],
                         "labels": [t.column("label").to_pylist()], "v": as_list(flat, [0, len(flat)], pa.float64())}, schema=schema)

    return dealt.groupBy("dim", "block").applyInArrow(pack_block, "dim int, block int, ids array<long>, labels array<long>, v array<double>")


def _meet(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Each anchor block with every row block of its dimension."""
    last = rows.groupBy("dim").agg(F.max("block").alias("last"))
    theirs = rows.select("dim", F.col("block").alias("r_block"), F.col("ids").alias("r_ids"), F.col("labels").alias("r_labels"), F.col("v").alias("r_v"))
    return (anchors.join(last, "dim").withColumn("r_block", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
            .join(theirs, ["dim", "r_block"]))


def _pairs(batches):
    """(row of the batch as a dict, its anchors' ids and labels, its rows' ids and labels, scores)."""
    for b in batches:
        for r in range(b.num_rows):
            row = {n: b.column(i)[r] for i, n in enumerate(b.schema.names)}
            dim = row["dim"].as_py()
            ids, labels, v, r_ids, r_labels, r_v = (row[n].values.to_numpy(zero_copy_only=False) for n in ("ids", "labels", "v", "r_ids", "r_labels", "r_v"))
            yield row, ids, labels, r_ids, r_labels, _products(v.reshape(-1, dim), r_v.reshape(-1, dim))


def valid_rows(vectors: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    v = F.col(vec_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(good)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))
            .distinct())


def mine(vectors: DataFrame, is_anchor: Column, n_pos: int = 5, n_neg: int = 10, low: tuple[int, int] = (30, 100),
         high: tuple[int, int] = (90, 100), id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``; ``label`` an expression over ``vectors`` (else its column
    ``label``). An anchor's positives are its first ``n_pos`` other rows of its label by inner product, ties to the
    smaller id; for each, the first ``n_neg`` rows of another label with low <= negative / positive <= high, as
    low[0] * positive <= low[1] * negative and high[1] * negative <= high[0] * positive. Fewer are returned where
    there are fewer; a negative positive score admits none.

    Components are whole numbers (``topk.quantise``). Rows with a null id or label or with a vector that is null, empty
    or holds a null or non-finite component take no part, nor do rows whose vector's length differs from the
    anchor's. Rows alike in id, label and vector count once; other rows that share an id are anchors of their own and
    never each other's partners. Empty tables give no rows, other columns are not read, scores beyond 64 bits raise
    an error."""
    spark = vectors.sparkSession
    rows = valid_rows(vectors, id_col, vec_col, F.col("label") if label is None else label)
    x = stored(_blocks(rows, ROW_BLOCK, "row"), "rows")
    a = stored(_blocks(rows.where(is_anchor), ANCHOR_BLOCK, "anchor"), "anchors")

    def positives(batches):
        for row, ids, labels, r_ids, r_labels, scores in _pairs(batches):
            got = [(i, j) for i in range(len(ids))
                   for j in _best(scores[i], r_ids, np.flatnonzero((r_labels == labels[i]) & (r_ids != ids[i])), n_pos)]
            yield {"dim": [row["dim"].as_py()] * len(got), "block": [row["block"].as_py()] * len(got), "place": [i for i, _ in got],
                   "anchor": [int(ids[i]) for i, _ in got], "other": [int(r_ids[j]) for _, j in got], "score": [int(scores[i, j]) for i, j in got]}

    near = map_arrow(_meet(a, x), positives, "dim int, block int, place int, anchor long, other long, score long")
    best = F.row_number().over(Window.partitionBy("dim", "block", "place").orderBy(F.desc("score"), "other"))
    near = stored(near.withColumn("r", best).where(F.col("r") <= n_pos).drop("r"), "positives")
    windows = near.groupBy("dim", "block").agg(F.collect_list(F.struct("place", "score")).alias("windows"))

    def opened(batches):
        for b in batches:
            yield {"key": [pack((r["anchor"], r["dim"], r["block"], r["place"]), r["score"], 0, r["other"]) for r in b.to_pylist()]}

    def negatives(batches):
        for row, ids, labels, r_ids, r_labels, scores in _pairs(batches):
            found = set()
            for w in sorted({(w["place"], w["score"]) for w in row["windows"].as_py()}):
                i, p = w
                s = scores[i]
                least, most = -(-low[0] * p // low[1]), high[0] * p // high[1]
                inside = np.flatnonzero((s >= max(least, -BIAS)) & (s <= most) & (r_labels != labels[i]) & (r_ids != ids[i]))
                found.update((i, int(j)) for j in _best(s, r_ids, inside, n_neg))
            dim, block = row["dim"].as_py(), row["block"].as_py()
            yield {"key": [pack((int(ids[i]), dim, block, i), int(scores[i, j]), 1, int(r_ids[j])) for i, j in sorted(found)]}

    keys = map_arrow(near, opened, "key binary").unionAll(map_arrow(_meet(a, x).join(windows, ["dim", "block"]), negatives, "key binary"))
    dealt = keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(
        int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:ANCHOR_BYTES]))
    return spark.createDataFrame(dealt.keys().mapPartitions(lambda part: stream(part, n_neg, low, high)), OUT)
