"""Target-distribution importance resampling over hashed n-grams.

A document's words, joined by one space, are scanned once: the running CRC-32 is kept at each word's start and end.
CRC-32 is linear over GF(2), so the CRC of a run of words needs no second look at its bytes: with the running CRCs
A before the run and B behind it, and n bytes between, it is B xor shift(A, n), where the shift by n zero bytes is a
product of 32x32 bit matrices. Shifts are applied to whole arrays with byte tables, one for each power of two.

The buckets of all n-grams are stored, counted over the whole corpus and the target (one row a bucket and task is
shuffled), and turned into gains, 64-bit whole numbers. A document's weight is the floored mean gain of its n-grams;
Gumbel noise from its id turns the draw without replacement into the choice of the highest scores.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_list, discard, free_name, map_arrow, slices, stored

#: A-Z to a-z; every other ASCII character but a-z and 0-9 to the separator. Bytes over 0x7F belong to words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Rows of an Arrow batch worked on at a time.
BATCH = 256


def shift_tables(bits: int = 32) -> np.ndarray:
    """[k, b, v]: the CRC register with byte b equal to v, others 0, after 2^k zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    out = np.empty((bits, 4, 256), np.uint32)
    for b in range(4):  # one zero byte
        v = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
        out[0, b] = byte[v & 0xFF] ^ (v >> np.uint32(8))
    for k in range(1, bits):
        for b in range(4):
            out[k, b] = _apply(out[k - 1], out[k - 1, b])
    return out


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0][v & 0xFF] ^ table[1][v >> 8 & 0xFF] ^ table[2][v >> 16 & 0xFF] ^ table[3][v >> 24]


def shift(crc: np.ndarray, n: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as ``n`` says."""
    crc, n = crc.copy(), n.copy()
    k = 0
    while n.any():
        at = np.flatnonzero(n & 1)
        crc[at] = _apply(tables[k], crc[at])
        n >>= 1
        k += 1
    return crc


def running(text: str | None) -> tuple[list[int], list[int], np.ndarray]:
    """Of each word: the CRC before it, the CRC behind it, and the bytes up to its end (in the normalised text)."""
    words = (text or "").encode().translate(NORMAL).split()
    before, behind, crc = [], [], 0
    for i, w in enumerate(words):
        if i:
            crc = zlib.crc32(b" ", crc)
        before.append(crc)
        crc = zlib.crc32(w, crc)
        behind.append(crc)
    return before, behind, np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1


def buckets_of(texts: list, least: int, most: int, buckets: int, tables: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Number of words and buckets of the n-grams (least <= n <= most) of each text."""
    scanned = [running(t) for t in texts]
    sizes = np.array([len(s[0]) for s in scanned], np.int64)
    before = np.array([c for s in scanned for c in s[0]], np.uint32)
    behind = np.array([c for s in scanned for c in s[1]], np.uint32)
    ends = np.concatenate([s[2] for s in scanned]) if len(scanned) else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    starts = np.zeros(len(ends), np.int64)  # a word starts one byte behind the end of the one before
    starts[1:] = ends[:-1] + 1
    starts[first[sizes > 0]] = 0
    text_of = np.repeat(np.arange(len(texts)), sizes)
    left = (first + sizes)[text_of] - np.arange(len(ends))  # words from this one to the end of its text
    found, owner = [], []
    for n in range(least, most + 1):
        at = np.flatnonzero(left >= n)
        last = at + n - 1
        crc = behind[last] ^ shift(before[at], ends[last] - starts[at], tables)
        found.append((crc % np.uint32(buckets)).astype(np.int64))
        owner.append(text_of[at])
    found, owner = np.concatenate(found), np.concatenate(owner)
    found = found[np.argsort(owner, kind="stable")]
    return sizes.tolist(), np.split(found, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]) if len(texts) else []


def hashed(docs: DataFrame, columns: list, text_col: str, ngrams: tuple[int, int], buckets: int) -> DataFrame:
    """``columns`` (id long, row long) of each row with n_words and the buckets of its n-grams."""
    tables = shift_tables()

    def run(batches):
        for b in slices(batches, BATCH):
            words, found = buckets_of(b.column(2).to_pylist(), *ngrams, buckets, tables)
            yield {"id": b.column(0), "row": b.column(1), "n_words": words,
                   "buckets": as_list(np.concatenate(found), np.cumsum([0, *map(len, found)]), "int32")}

    return map_arrow(docs.select(*columns, F.col(text_col).alias("text")), run, "id long, row long, n_words long, buckets array<int>")


def counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; a task hands on one row a bucket, the driver gets one row a bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield {"bucket": at, "n": total[at]}

    out = np.zeros(buckets, np.int64)
    for r in map_arrow(features.select("buckets"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, B their number."""
    all_s, all_t, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, least_words: int = 20,
             share: tuple[int, int] = (10, 100), seed: str = "2024", id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters; features the runs of
    ngrams[0] to ngrams[1] words. Of the rows with at least ``least_words`` words the highest scores are drawn, as
    many as share[0] * rows // share[1], ties to the smaller id, then in a fixed order of the rows; ``rank`` is their
    place, null for the others. Null and empty texts have no features and weight 0; a null id counts as the empty text in the noise and
    comes first among ties; rows of one id share their noise, each is a row of its own. Empty tables are fine on both sides. Other
    columns are not read."""
    spark = docs.sparkSession
    row = free_name(docs, "row_number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    ids = [F.col(id_col).cast("long").alias("id"), F.col(row).alias("row")]
    features = stored(hashed(numbered, ids, text_col, ngrams, buckets), "features")
    wanted = hashed(target, [F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("row")], target_col, ngrams, buckets)
    gain = gains(counts(features, buckets), counts(wanted, buckets))

    def weigh(batches):
        for b in batches:
            lists = b.column(3)
            n = np.diff(lists.offsets.to_numpy())
            total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            at = np.concatenate([[0], np.cumsum(n)])
            weight = (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in b.column(4).to_pylist()]
            yield {"id": b.column(0), "row": b.column(1), "n_words": b.column(2), "n_features": n.astype(np.int64), "weight": weight,
                   "score": weight + np.array(noise, np.int64)}

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    scored = stored(map_arrow(features.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")), weigh,
                              "id long, row long, n_words long, n_features long, weight long, score long"), "scored")
    discard(features)
    # scores are whole thousandths of logarithms: a few ten thousand values at any size of the corpus
    fit = F.col("n_words") >= least_words
    levels = sorted(((r.score, r.n) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = share[0] * sum(n for _, n in levels) // share[1]
    reached = list(accumulate((n for _, n in levels), initial=0))
    cut = next((s for (s, _), before in zip(levels, reached) if before >= draw), None)  # the first level not needed
    chosen = fit & (F.col("score") > cut) if cut is not None else fit
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("row")]
    ranked = _numbered(scored.where(chosen), order)
    keep = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    return scored.where(~chosen).select(*keep, none).unionAll(
        ranked.select(*keep, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")))


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rank`` 1, 2, 3 ... in the order: range partitions, each counted and numbered from the sum of those before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = rows.columns

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield {**{n: b.column(i) for i, n in enumerate(names)}, "part": [part] * b.num_rows, "place": np.arange(at + 1, at + b.num_rows + 1)}
            at += b.num_rows

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = stored(map_arrow(dealt, run, f"{fields}, part int, place long"), "ranked")
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.max("place").alias("n")).collect())  # one row a partition
    before = [(p, b) for (p, _), b in zip(sizes, accumulate((n for _, n in sizes), initial=0), strict=False)]
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("place") + F.col("before"))
