"""k-nearest-neighbour regression (M14): exact by blocks, or by hash tables on request.

The exact way packs queries and training rows into blocks of ≤ ``block_rows`` rows that lie close together (cells from a
bounded sample, halved further in their tasks), one block a row of a stored table, with its bounding box. Blocks meet in
a nested-loop join that shuffles neither the rows nor their copies; a training block whose box is farther from the query
block's than every query's k-th nearest of the sample is left out, as none of its rows can be among the k. A task keeps a
query block's best k over all training blocks of its partition; a window merges those of the partitions. Of equal training rows
only the k smallest keys take part, and equal queries are asked once. Where boxes tell nothing apart (many dimensions) every pair is compared, as it must.

``method='lsh'`` costs less than |Q|·|T|: p-stable hash tables (Datar et al. 2004) with multi-probe look-ups (Lv et al.
2007) bring together rows that are likely near, their distances are exact, and queries that meet fewer than k rows
take the exact way. The tables are laid out on a bounded sample (``SAMPLE`` rows) for a wanted recall; every row is
indexed. Large buckets are cut into slices on both sides.

No pair is ever emitted as a row. A task's distances are computed in slices of ``SLICE_BYTES``. Ties on distance go to
the smaller training key. ``weights='distance'`` uses 1/d; if any neighbour has distance 0, the prediction is the mean
of the zero-distance labels.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.columns import qcol
from quarry.models.tables import TableState
from quarry.session import checkpoint_dir, ensure_checkpoint_dir

_CAND = "tb long, qid long, tid long, dist double, y double"
#: Halvings of the space into cells, from the sample: at most 256 cells.
CELL_LEVELS = 8
#: Bytes of a task's distance matrix (and of the differences behind it).
SLICE_BYTES = 64 << 20
#: Partitions of training blocks whose candidates meet in one window; those of more are merged in turns.
MERGE_FANIN = 1024
#: Hash tables, look-ups a table (the bucket and its nearest neighbours), rows of a bucket's slice, sample for the layout.
TABLES, PROBES, SLICE_ROWS, SAMPLE = 8, 4, 16_384, 2000


def _distances(Q: np.ndarray, T: np.ndarray, p: float) -> np.ndarray:
    """Row-wise Minkowski distances of two arrays that broadcast."""
    if p == 2:
        return np.sqrt(((Q - T) ** 2).sum(-1))
    if p == 1:
        return np.abs(Q - T).sum(-1)
    return (np.abs(Q - T) ** p).sum(-1) ** (1.0 / p)


def nearest(Q: np.ndarray, T: np.ndarray, k: int, p: float):
    """(query, training row, distance) of each query's k nearest, ties to the smaller row; exact, in slices.

    For p = 2 one matrix product sorts out rows that cannot be among the k, allowing for its rounding; what is left
    is compared by its differences, as for any other p."""
    k = min(k, len(T))
    d = Q.shape[1]
    rows, cols, dists = [], [], []
    if p == 2:
        step = max(1, SLICE_BYTES // (24 * max(len(T), 1)))
        centre = T.mean(0)
        Tc, t2 = T - centre, ((T - centre) ** 2).sum(1)
        for at in range(0, len(Q), step):
            q = Q[at:at + step] - centre
            q2 = (q ** 2).sum(1)
            near = q2[:, None] + t2[None] - 2 * (q @ Tc.T)
            slack = 32 * np.finfo(float).eps * d * (q2[:, None] + t2.max(initial=0)) + np.finfo(float).tiny
            kth = np.partition(near, k - 1, axis=1)[:, k - 1:k]
            i, j = np.nonzero(near <= kth + slack)
            exact = np.empty(len(i))
            part = max(1, SLICE_BYTES // (16 * d))
            for a in range(0, len(i), part):
                exact[a:a + part] = _distances(Q[at + i[a:a + part]], T[j[a:a + part]], 2)
            order = np.lexsort((j, exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            rows.append(at + i[keep])
            cols.append(j[keep])
            dists.append(exact[keep])
    else:
        step = max(1, SLICE_BYTES // (16 * max(len(T), 1) * d))
        for at in range(0, len(Q), step):
            m = _distances(Q[at:at + step, None, :], T[None], p)
            idx = np.argsort(m, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(at, at + len(m)), k))
            cols.append(idx.ravel())
            dists.append(np.take_along_axis(m, idx, 1).ravel())
    return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((rows, int), (cols, int), (dists, float)))


def _block_topk(k: int, p: float, part: int):
    """Cogroup function; ``part``: which of the key's columns is returned as ``tb``."""
    schema = pa.schema([("tb", pa.int64()), ("qid", pa.int64()), ("tid", pa.int64()), ("dist", pa.float64()), ("y", pa.float64())])

    def matrix(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)

    def fn(key, q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return schema.empty_table()
        t = t.sort_by("tid")
        rows, cols, dist = nearest(matrix(q, "x"), matrix(t, "tx"), k, p)
        return pa.table({"tb": pa.array(np.full(len(rows), key[part].as_py()), pa.int64()), "qid": q.column("qid").to_numpy()[rows],
                         "tid": t.column("tid").to_numpy()[cols], "dist": dist, "y": t.column("y").to_numpy()[cols]}, schema=schema)

    return fn


def sample_of(train: DataFrame, size: int) -> np.ndarray:
    """The vectors of at most ``size`` training rows, chosen by a hash of their keys."""
    rows = train.select("x", F.xxhash64("tid").alias("h")).orderBy("h").limit(size).select("x").toArrow()
    return rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)


def cells(sample: np.ndarray, levels: int) -> list[list[tuple[int, float]]]:
    """For each level and cell the dimension and the value it is split at: the median of the widest one in the sample."""
    out, parts = [], [sample]
    for _ in range(levels):
        cuts, nxt = [], []
        for x in parts:
            dim = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
            at = float(np.median(x[:, dim])) if len(x) else 0.0
            cuts.append((dim, at))
            nxt += [x[~(x[:, dim] > at)], x[x[:, dim] > at]] if len(x) else [x, x]
        out.append(cuts)
        parts = nxt
    return out


def cell_of(x: np.ndarray, tree: list[list[tuple[int, float]]]) -> np.ndarray:
    cell = np.zeros(len(x), int)
    for cuts in tree:
        dims, ats = (np.array(v) for v in zip(*cuts, strict=True))
        cell = 2 * cell + (x[np.arange(len(x)), dims[cell]] > ats[cell])
    return cell


def split_rows(x: np.ndarray, rows: np.ndarray, most: int):
    """Groups of at most ``most`` rows that lie close together: halves along the widest dimension."""
    todo = [rows]
    while todo:
        r = todo.pop()
        if len(r) <= most:
            yield r
            continue
        dim = int(np.argmax(x[r].max(0) - x[r].min(0)))
        r = r[np.argpartition(x[r, dim], len(r) // 2)]
        todo += [r[:len(r) // 2], r[len(r) // 2:]]


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, ids: str, tree, sample: np.ndarray, block_rows: int, k: int, p: float) -> DataFrame:
    """Rows (``ids``, x and y) as a stored table of blocks, one a row: box (lo, hi), ids, x and y as arrays of bytes.
    Without y they are queries: r is a distance within which each has k training rows, ``reach`` the largest of them. A task
    packs the rows of a slice of one cell, at most SLICE_BYTES."""
    query = "y" not in df.columns
    kept = f"{ids} long, x array<double>" + ("" if query else ", y double")

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(x, tree), pa.int32())], names=[*b.schema.names, "cell"])

    def block(x, r, i, y):
        row = {"lo": x[r].min(0).tolist(), "hi": x[r].max(0).tolist(), "ids": i[r].astype("int64").tobytes(), "x": x[r].tobytes()}
        if not query:
            return row | {"y": y[r].tobytes()}
        near = np.full(len(r), np.inf)
        if len(sample) >= k:
            at, _, dist = nearest(x[r], sample, k, p)
            near[:] = 0
            np.maximum.at(near, at, dist)
            near[np.bincount(at, minlength=len(r)) < k] = np.inf
        return row | {"r": near.tobytes(), "reach": float(near.max())}

    schema = "lo array<double>, hi array<double>, ids binary, x binary, " + ("r binary, reach double" if query else "y binary")
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def pack(t: pa.Table) -> pa.Table:
        if not query:
            t = t.sort_by("tid")
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        i = t.column(ids).to_numpy()
        y = None if query else t.column("y").to_numpy().astype(float)
        # in a block the rows are in order of their keys, so that ties go to the smaller
        return pa.Table.from_pylist([block(x, np.sort(r), i, y) for r in split_rows(x, np.arange(len(x)), block_rows)], schema=arrow)

    held = df.select(*[c.split()[0] for c in kept.split(", ")]).mapInArrow(place, f"{kept}, cell int")
    most = max(block_rows, SLICE_BYTES // (8 * sample.shape[1] + 16))
    sizes = {r["cell"]: r["count"] for r in held.groupBy("cell").count().collect()}  # at most CELLS rows
    parts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 0) // most) or 1) for c in range(2 ** len(tree))]), F.col("cell") + 1)
    blocks = held.withColumn("part", F.pmod(F.xxhash64(ids), parts)).groupBy("cell", "part").applyInArrow(pack, schema)
    return _kept(blocks, "knn-blocks")


def box_distance(p: float):
    """Least distance of two boxes (lo, hi) and (tlo, thi), a little less for its rounding."""
    gaps = F.zip_with(F.zip_with("tlo", "hi", lambda a, b: a - b), F.zip_with("lo", "thi", lambda a, b: a - b),
                      lambda u, v: F.pow(F.greatest(u, v, F.lit(0.0)), F.lit(float(p))))
    return F.pow(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g), F.lit(1.0 / p)) * (1 - 1e-9)


def _block_pairs(k: int, p: float):
    """mapInArrow function over pairs of blocks. The pairs of a query block follow each other: its best k are kept while
    they last. Queries farther from a training block's box than their k-th best so far are left out of its products."""
    names = ["qid", "tid", "dist", "y"]

    def told(qids, best):
        rows = best[0] >= 0
        place = np.nonzero(rows)[0]
        return pa.RecordBatch.from_arrays([pa.array(qids[place], pa.int64()), pa.array(best[2][rows], pa.int64()), pa.array(best[1][rows], pa.float64()),
                                           pa.array(best[3][rows], pa.float64())], names=names)

    def run(batches):
        held, x, r, best = None, None, None, []
        for b in batches:
            for n in range(b.num_rows):
                ids, vectors, reach, tids, tx, y = (np.frombuffer(b.column(c)[n].as_buffer(), t) for c, t in enumerate(("int64", float, float, "int64", float, float)))
                if held is None or not (np.array_equal(held, ids) and np.array_equal(x.ravel(), vectors, equal_nan=True)):
                    if held is not None:
                        yield told(held, best)
                    held, r = ids.copy(), reach.copy()
                    x = vectors.reshape(len(held), -1).copy()
                    # found, distance, key and y of the best k so far
                    best = [np.full((len(held), k), v, t) for v, t in ((-1, int), (np.inf, float), (0, "int64"), (np.nan, float))]
                tx = tx.reshape(len(tids), -1)
                gap = _distances(np.maximum(np.maximum(tx.min(0) - x, x - tx.max(0)), 0), np.zeros(x.shape[1]), p) * (1 - 1e-9)
                some = np.flatnonzero(~(gap > np.minimum(r, best[1][:, -1])))
                if len(some):
                    i, j, dist = nearest(x[some], tx, k, p)
                    best = merged(best, some[i], dist, tids[j], y[j], k)
        if held is not None:
            yield told(held, best)

    return run


def merged(best: list[np.ndarray], i: np.ndarray, dist: np.ndarray, tid: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """``best`` with the rows found for queries ``i``: each query's k of least distance, then least key."""
    rows, cols = np.nonzero(best[0] >= 0)
    old = np.isin(rows, i)
    rows, cols = rows[old], cols[old]
    q = np.concatenate([rows, i])
    d, t, v = (np.concatenate([best[n][rows, cols], new]) for n, new in ((1, dist), (2, tid), (3, y)))
    order = np.lexsort((t, d, q))
    q, d, t, v = q[order], d[order], t[order], v[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    for n, new in enumerate((np.ones(len(q), int), d, t, v)):
        best[n][q[keep], place[keep]] = new[keep]
    return best


def knn_candidates(queries: DataFrame, train: DataFrame, k: int, p: float = 2.0, block_rows: int = 2048) -> DataFrame:
    """queries(qid, x array<double>), train(tid, x array<double>, y double) → the exact top-k
    (qid, tid, dist, y, rank) with rank 1..k."""
    ensure_checkpoint_dir(queries.sparkSession)
    # of equal training rows only the k smallest keys can be among the nearest
    same = F.row_number().over(Window.partitionBy("x").orderBy("tid"))
    train = _kept(train.select("tid", "x", "y").withColumn("_rn", same).where(F.col("_rn") <= k).drop("_rn"), "knn-first")
    rows = train.count()
    if not rows:
        return queries.where("false").selectExpr("qid", "0L as tid", "0D as dist", "0D as y", "0 as rank")
    sample = sample_of(train, SAMPLE)
    tree = cells(sample, min(CELL_LEVELS, max(0, math.ceil(math.log2(max(1, rows / (8 * block_rows)))))))
    tb = packed(train, "tid", tree, sample, block_rows, k, p).select(
        F.col("lo").alias("tlo"), F.col("hi").alias("thi"), F.col("ids").alias("tids"), F.col("x").alias("tx"), "y")
    qb = packed(queries, "qid", tree, sample, block_rows, k, p)
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, qb.count() // 64)
    far = box_distance(p)
    pairs = qb.repartition(tasks).join(tb.hint("shuffle_replicate_nl"), F.isnan(far) | (far <= F.col("reach")))
    cand = pairs.select("ids", "x", "r", "tids", "tx", "y").mapInArrow(_block_pairs(k, p), "qid long, tid long, dist double, y double")

    def best(by):
        w = Window.partitionBy(*by).orderBy("dist", "tid")
        return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    parts = tb.rdd.getNumPartitions()  # each task of a query block is one of these
    cand = cand.withColumn("part", F.spark_partition_id()) if parts > MERGE_FANIN else cand
    while parts > MERGE_FANIN:
        parts = -(-parts // MERGE_FANIN)
        cand = cand.withColumn("part", F.pmod("part", F.lit(parts)))
        cand = best(["qid", "part"])
    return best(["qid"]).select("qid", "tid", "dist", "y", "rank")


@dataclass
class Layout:
    """Hash functions of all tables: bucket i of a table is floor((a·x + b) / width), its key all of the table's."""

    a: np.ndarray  # (tables · hashes, d)
    b: np.ndarray
    width: float
    hashes: int


def collision(u: np.ndarray, width: float, p: float) -> np.ndarray:
    """Chance that one hash puts rows at distance u into one bucket (normal for p = 2, Cauchy for p = 1)."""
    u = np.maximum(u, 1e-300) / width
    if p == 1:
        return 2 * np.arctan(1 / u) / math.pi - u * np.log1p(1 / u ** 2) / math.pi
    below = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in 1 / u.ravel()]).reshape(u.shape)
    return 1 - 2 * below - 2 * u / math.sqrt(2 * math.pi) * (1 - np.exp(-1 / (2 * u ** 2)))


def lay_out(train: DataFrame, k: int, p: float, recall: float, seed: int = 42) -> Layout:
    """Hashes for a wanted recall, from the distances to the k-th neighbour within a sample of at most SAMPLE rows (in the
    whole table they are no larger): as many hashes a table as leave that share of neighbours in a common bucket of
    some table, look-ups beyond the bucket not counted."""
    x = sample_of(train, SAMPLE)
    i, _, dist = nearest(x, x, k + 1, p)
    far = dist.reshape(len(x), -1)[:, -1]  # its own row comes first
    far = far[far > 0] if (far > 0).any() else np.ones(1)
    width = 4.0 * float(np.median(far))
    hashes = 1
    while hashes < 24 and (1 - (1 - collision(far, width, p) ** (hashes + 1)) ** TABLES).mean() >= recall:
        hashes += 1
    rng = np.random.default_rng(seed)
    size = (TABLES * hashes, x.shape[1])
    return Layout(rng.standard_cauchy(size) if p == 1 else rng.normal(size=size), rng.uniform(0, width, TABLES * hashes), width, hashes)


def _keyed(df: DataFrame, layout: Layout, probes: int, kept: str) -> DataFrame:
    """Rows (id, x) with every (tab, key) they are found under: their own buckets, and for ``probes`` > 1 the neighbouring
    buckets whose borders are nearest."""
    schema = f"{kept}, tab int, key long"
    names = df.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(names.index("x")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            at = (x @ layout.a.T + layout.b) / layout.width
            cell = np.floor(at)
            share = (at - cell).reshape(len(x), TABLES, layout.hashes)
            cell = cell.astype(np.int64).reshape(len(x), TABLES, layout.hashes)
            mix = (np.arange(layout.hashes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            keys = [(cell.astype(np.uint64) * mix).sum(2, dtype=np.uint64)]
            # how far a row is from the border below and above, for each hash
            border = np.concatenate([share, 1 - share], 2)
            for near in np.argsort(border, 2)[:, :, :probes - 1].transpose(2, 0, 1) if probes > 1 else ():
                step = np.where(near < layout.hashes, np.uint64(2**64 - 1), np.uint64(1))
                keys.append(keys[0] + step * mix[near % layout.hashes])
            tab = np.tile(np.arange(TABLES), len(x))
            for key in keys:
                rows = np.repeat(np.arange(len(x)), TABLES)
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows)).columns, pa.array(tab, pa.int32()), pa.array(key.ravel().view(np.int64))],
                                                 names=[*names, "tab", "key"])

    return df.mapInArrow(run, schema)


def lsh_candidates(queries: DataFrame, train: DataFrame, k: int, p: float = 2.0, recall: float = 0.95, block_rows: int = 2048,
                   layout: Layout | None = None) -> DataFrame:
    """As ``knn_candidates``, from the rows that share a bucket with the query in one of the tables; queries that meet
    fewer than k rows are compared with all. p must be 1 or 2."""
    if p not in (1, 2):
        raise ValueError("hash tables know the distances p = 1 and p = 2; use method='exact'")
    ensure_checkpoint_dir(queries.sparkSession)
    n = train.count()
    if not n:
        return knn_candidates(queries, train, k, p, block_rows)
    layout = layout or lay_out(train, k, p, recall)
    q = _keyed(queries.select("qid", "x"), layout, PROBES, "qid long, x array<double>")
    t = _keyed(train.select("tid", "x", "y"), layout, 1, "tid long, x array<double>, y double")
    # how many slices each side of a large bucket has: at most one bucket for SLICE_ROWS rows, so they travel with the tasks
    large = [d.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > SLICE_ROWS).select(
        "tab", "key", *[(F.ceil(F.col("n") / SLICE_ROWS) if c == side else F.lit(1).cast("long")).alias(c) for c in ("n_q", "n_t")])
        for d, side in ((q, "n_q"), (t, "n_t"))]
    sizes = large[0].unionByName(large[1]).groupBy("tab", "key").agg(F.max("n_q").alias("n_q"), F.max("n_t").alias("n_t")).checkpoint(eager=True)

    def sliced(d):
        one = F.lit(1).cast("long")
        return d.join(F.broadcast(sizes), ["tab", "key"], "left").withColumns({c: F.coalesce(c, one) for c in ("n_q", "n_t")})

    # the slice of one side meets all slices of the other
    q = sliced(q).select("qid", "x", "tab", "key", F.pmod(F.xxhash64("qid"), "n_q").alias("qs"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_t") - 1)).alias("ts"))
    t = sliced(t).select("tid", F.col("x").alias("tx"), "y", "tab", "key", F.pmod(F.xxhash64("tid"), "n_t").alias("ts"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q") - 1)).alias("qs"))
    by = ["tab", "key", "qs", "ts"]
    found = q.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(_block_topk(k, p, 3), _CAND)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "tid"))
    found = found.select("qid", "tid", "dist", "y").distinct().withColumn("rank", rank).where(F.col("rank") <= k).checkpoint(eager=True)
    met = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n)).select("qid")
    rest = queries.select("qid", "x").join(met, "qid", "left_anti").checkpoint(eager=True)
    found = found.join(met, "qid", "left_semi")
    return found if rest.isEmpty() else found.unionByName(knn_candidates(rest, train, k, p, block_rows))


def knn_predict(cands: DataFrame, weights: str = "uniform") -> DataFrame:
    """(qid, prediction) from the top-k candidates."""
    if weights == "uniform":
        return cands.groupBy("qid").agg(F.avg("y").alias("prediction"))
    zero = F.col("dist") == 0
    return cands.groupBy("qid").agg(
        F.when(F.count_if(zero) > 0, F.avg(F.when(zero, F.col("y"))))
        # the sums skip zero distances (try_divide → NULL); that case takes the branch above
        .otherwise(F.sum(F.try_divide(F.col("y"), F.col("dist"))) / F.sum(F.try_divide(F.lit(1.0), F.col("dist"))))
        .alias("prediction"))


class _KNNParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    k = Param(Params._dummy(), "k", "neighbours", typeConverter=TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform|distance", typeConverter=TypeConverters.toString)
    p = Param(Params._dummy(), "p", "Minkowski power", typeConverter=TypeConverters.toFloat)
    blockRows = Param(Params._dummy(), "blockRows", "rows per block", typeConverter=TypeConverters.toInt)
    method = Param(Params._dummy(), "method", "exact|lsh", typeConverter=TypeConverters.toString)
    recall = Param(Params._dummy(), "recall", "share of neighbours that lsh is laid out for", typeConverter=TypeConverters.toFloat)


class KNNModel(Model, _KNNParams, TableState):
    """The model is its training rows, a table saved and loaded with it."""

    TABLE = "tid bigint, x array<double>, y double"

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", k=5, weights="uniform",
                 p=2.0, blockRows=2048, tablePath="", method="exact", recall=0.95):
        super().__init__()
        self._setDefault(k=5, weights="uniform", p=2.0, blockRows=2048, tablePath="", method="exact", recall=0.95)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        train = self.table(spark)
        fc = self.getOrDefault(self.featuresCol)
        # equal queries are asked once; their features, not the row, find the prediction
        q = df.withColumn("_x", vector_to_array(qcol(fc)))
        asked = _kept(q.select(F.col("_x").alias("x")).distinct().withColumn("qid", F.monotonically_increasing_id()), "knn-asked")
        k, p, rows = (self.getOrDefault(v) for v in (self.k, self.p, self.blockRows))
        if self.getOrDefault(self.method) == "lsh":
            cands = lsh_candidates(asked, train, k, p, self.getOrDefault(self.recall), rows)
        else:
            cands = knn_candidates(asked, train, k, p, rows)
        pred = knn_predict(cands, self.getOrDefault(self.weights)).join(asked, "qid").select(
            F.col("x").alias("_x"), F.col("prediction").alias(self.getOrDefault(self.predictionCol)))
        return q.join(pred, "_x", "left").drop("_x")


class KNNRegressor(Estimator, _KNNParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitting materialises (tid, x, y) as Parquet in the shared checkpoint folder."""

    idCol = Param(Params._dummy(), "idCol", "training key (ties → smaller)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", k=5, weights="uniform",
                 p=2.0, blockRows=2048, idCol="", method="exact", recall=0.95):
        super().__init__()
        self._setDefault(k=5, weights="uniform", p=2.0, blockRows=2048, idCol="", method="exact", recall=0.95)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> KNNModel:
        spark = df.sparkSession
        if self.getOrDefault(self.method) not in ("exact", "lsh"):
            raise ValueError("kNN methods: 'exact' and 'lsh'")
        idc = self.getOrDefault(self.idCol)
        tid = qcol(idc).cast("long") if idc else F.monotonically_increasing_id()
        path = f"{checkpoint_dir(spark).rstrip('/')}/quarry/knn-train-{uuid.uuid4().hex}"
        df.select(tid.alias("tid"), vector_to_array(qcol(self.getOrDefault(self.featuresCol))).alias("x"),
                  qcol(self.getOrDefault(self.labelCol)).cast("double").alias("y")).filter(
            F.col("y").isNotNull()).write.parquet(path)
        return KNNModel(featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
                        predictionCol=self.getOrDefault(self.predictionCol), k=self.getOrDefault(self.k),
                        weights=self.getOrDefault(self.weights), p=self.getOrDefault(self.p),
                        blockRows=self.getOrDefault(self.blockRows), tablePath=path, method=self.getOrDefault(self.method),
                        recall=self.getOrDefault(self.recall))
