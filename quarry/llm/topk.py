"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector's segment of w components with mean m and deviation s (root of the summed squares about the mean) bounds
the product with another's: w m m' - s s' <= sum <= w m m' + s s'. Summed over segments this is a bound on the
score, and, with the norms, on the distance; halving the segments tightens it. For a block of queries and a block
of candidates the bounds of all pairs at one resolution are one small matrix product: coarse to fine, each keeps
the candidates whose upper bound reaches the query's k-th best lower bound so far; what is left is computed exactly.

Queries and candidates are dealt into blocks by hash. Each query block meets every candidate block (a stated query
set against all rows, in blocks); a task holds one pair of blocks, returns k rows a query, and the best k are kept
by a ranking that Spark limits before it shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_list, map_arrow, stored

#: Rows of a block and segments at each resolution.
QUERY_BLOCK, ROW_BLOCK, RESOLUTIONS = 512, 4096, (1, 4, 16)


def quantise(column, scale: float = 64.0):
    """floor(scale * x) of each component, as doubles that hold whole numbers; null where a component is null or not
    finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")))


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means and deviations of each row's segments."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        m = x[:, a:b].mean(1)
        means.append(m * np.sqrt(b - a))
        devs.append(np.sqrt(((x[:, a:b] - m[:, None]) ** 2).sum(1)))
    return np.stack(means, 1), np.stack(devs, 1)


def _kth(a: np.ndarray, k: int) -> np.ndarray:
    return np.partition(a, a.shape[1] - k, axis=1)[:, a.shape[1] - k] if a.shape[1] >= k else np.full(len(a), -np.inf)


def block_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """The k best rows of ``x`` for each row of ``q`` (own id left out; ties to the smaller id) as
    (query number, row id, score)."""
    least = np.full(len(q), -np.inf)
    alive = np.ones((len(q), len(x)), bool)
    own = q_ids[:, None] == x_ids[None]
    slack = 1e-6 * (1 + np.abs(q).max(initial=0)) * (1 + np.abs(x).max(initial=0)) * q.shape[1]
    for n in RESOLUTIONS:
        if n > 2 * q.shape[1]:
            break
        qm, qd = _stats(q, n)
        xm, xd = _stats(x, n)
        mid, wide = qm @ xm.T, qd @ xd.T
        least = np.maximum(least, _kth(np.where(own, -np.inf, mid - wide), k) - slack)
        alive &= mid + wide + slack >= least[:, None]
    alive &= ~own
    out = []
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    exact = "float64" if largest < 2**53 else "int64" if largest < 2**63 else object
    if exact is object:
        q, x = np.vectorize(int, otypes=[object])(q), np.vectorize(int, otypes=[object])(x)
    else:
        q, x = q.astype(exact), x.astype(exact)
    cols = np.flatnonzero(alive.any(0))  # candidates that survive for some query
    scores = q @ x[cols].T
    for i in range(len(q)):
        j = np.flatnonzero(alive[i, cols])
        if len(j):
            s, ids = scores[i, j], x_ids[cols[j]]
            if len(j) > k and exact == "float64":
                at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                s, ids, j = s[at], ids[at], j[at]
            best = sorted(range(len(j)), key=lambda t: (-s[t], ids[t]))[:k]
            out.extend((i, int(ids[t]), int(s[t])) for t in best)
    return out


def _blocks(rows: DataFrame, size: int, n_rows: int, name: str) -> DataFrame:
    """Rows (id, v, dim) packed into one row a block: dim, block, ids, flat vectors."""
    n = max(1, -(-n_rows // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n)).cast("int"))

    def pack(key, table):
        v = table.column("v").combine_chunks()
        return pa.table({"dim": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "ids": [table.column("id").to_pylist()],
                         "v": as_list(v.flatten(), [0, len(v.flatten())], pa.float64())},
                        schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))]))

    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids array<long>, v array<double>")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each row of ``queries`` with the rows of ``vectors`` of the same length, its
    own id left out: query_id, rank, vec_id, score; ties go to the smaller id.

    Components are whole numbers (see ``quantise``). Rows whose id or vector is null, empty, or holds a null or
    non-finite component take no part; rows of one id with one vector count once; a query with fewer candidates returns what there
    is; empty tables give no rows; other columns are not read. Scores beyond 64 bits raise an error."""
    def clean(df):
        v = F.col(vec_col)
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return (df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(good)
                .select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim")).distinct())

    rows, asked = clean(vectors), clean(queries)
    x = stored(_blocks(rows, ROW_BLOCK, rows.count(), "row"), "rows")
    q = stored(_blocks(asked, QUERY_BLOCK, asked.count(), "query"), "queries")
    # each query block's row once for every row block of its dimension: an equi-join on the dimension's block list
    targets = q.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    most = x.groupBy("dim").agg(F.max("block").alias("last"))
    pairs = (targets.join(most, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), "last")))
             .join(x, ["dim", "block"]).select("dim", "q_ids", "q_v", "ids", "v"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                q_ids, q_v, ids, v = (b.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(1, 5))
                got = block_topk(q_v.reshape(-1, dim), q_ids, v.reshape(-1, dim), ids, k)
                yield {"query_id": [int(q_ids[i]) for i, _, _ in got], "vec_id": [j for _, j, _ in got], "score": [s for _, _, s in got]}

    found = map_arrow(pairs, run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
