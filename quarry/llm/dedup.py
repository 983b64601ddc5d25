"""Exact de-duplication by content sort.

Rows are range-partitioned by the beginning of their normalised text and its digest (Spark samples the splitters, which
so stay under a hundred bytes however long the texts) and sorted inside each partition with Spark's spilling sort by
these and the whole text, so equal texts lie next to each other; each row's whole text is compared with the row before. The order goes on with the rank inside a group, so the first row of a run is the one to keep and a large
group can be cut over many partitions. Runs that touch a partition's edge are joined by comparing their whole
texts, at most two for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, map_arrow, stored

#: Characters of a text that its place in the order begins with; the digest decides among texts that share them.
HEAD = 16

RUNS = "row long, doc_id long, n_chars long, text_sha256 string, part int, run long, first boolean, edge string"


def _runs(docs: DataFrame, partitions: int | None) -> DataFrame:
    """Every row with its run (part, run) in the sorted table; ``edge`` is the text of a partition's first and last run."""
    key, rank = [F.col("head"), F.col("digest")], [F.col("n_chars").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    docs = docs.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    dealt = docs.repartitionByRange(*([partitions] if partitions else []), *key, *rank).sortWithinPartitions(*key, "norm", *rank)

    def run(batches):
        from pyspark import TaskContext

        part, at, last, sha = TaskContext.get().partitionId(), -1, None, None
        for b in batches:
            rows, ids, chars = (b.column(i) for i in range(3))
            texts, digests = b.column(3).to_pylist(), b.column(4).to_pylist()
            out_sha, out_run, out_first, edge = [], [], [], []
            for t, digest in zip(texts, digests, strict=True):
                new = t != last
                if new:
                    at, last, sha = at + 1, t, digest.hex()
                out_sha.append(sha)
                out_run.append(at)
                out_first.append(new)
                edge.append(t if new and at == 0 else None)
            yield {"row": rows, "doc_id": ids, "n_chars": chars, "text_sha256": out_sha, "part": [part] * len(texts),
                   "run": out_run, "first": out_first, "edge": edge}
        if at > 0:  # a row of its own for the last run's text
            yield {"row": [None], "doc_id": [None], "n_chars": [-1], "text_sha256": [sha], "part": [part], "run": [at],
                   "first": [False], "edge": [last]}

    return map_arrow(dealt.select("row", "doc_id", "n_chars", "norm", "digest"), run, RUNS)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                 partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after white space is deleted; null counts as empty. Of a group the row with the
    most code points, then the smallest doc_id (null last) is kept; of repeated rows one. ``row_col`` names a column
    that tells rows apart and comes back as ``row`` (else it is null). An empty table gives no rows; other columns
    are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select((F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
                      F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"),
                      F.regexp_replace(text, SPACE + "+", "").alias("norm"))
    rows = stored(_runs(src, partitions), "runs")
    real = rows.where("n_chars >= 0")
    # the texts of at most two runs a partition, compared whole; each run goes by its group's first run
    edges = (rows.where("edge is not null").select("edge", "part", "run").distinct()
             .groupBy("edge").agg(F.collect_set(F.struct("part", "run")).alias("members"))
             .select(F.array_min("members").alias("g"), F.explode("members").alias("m"))
             .select("g", F.col("m.part").alias("part"), F.col("m.run").alias("run")))
    best = F.min(F.struct((-F.col("n_chars")).alias("least"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    runs = (real.groupBy("part", "run").agg(F.count("*").alias("n"), best.alias("best"))
            .join(edges, ["part", "run"], "left")
            .withColumn("g", F.coalesce("g", F.struct("part", "run"))))
    groups = runs.groupBy("g").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    known = runs.select("part", "run", "g").join(groups, "g").select(
        "part", "run", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("g") == F.struct("part", "run")).alias("leads"))
    return real.join(known, ["part", "run"]).select(
        "row", "doc_id", "keep_id", "group_size", (F.col("first") & F.col("leads")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, a stored table, without the rows that ``exact_groups`` does not keep; columns as they were."""
    from quarry.llm.common import free_name

    row = free_name(docs, "row_number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    gone = exact_groups(numbered, id_col, text_col, row).where("not kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
