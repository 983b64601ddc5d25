"""Isotonic regression without a driver-side pool.

Rows are summed up by distinct x, range-partitioned and sorted; each task pools adjacent violators in one pass over a
stack of blocks. What can still be wrong are neighbours across a cut. So the blocks are cut again, elsewhere, in runs of
at most ``RUN`` blocks, and pooled again until no cut separates violators: pooling in any order gives the one solution,
and a round only ever joins blocks. The driver sees two means a run. Noisy data leave few blocks (one run, one more
round); monotone data leave many blocks and nothing to pool.

The model is a Parquet table of blocks, saved with it. Between two blocks predictions are interpolated, outside they
are those of the first and last block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import qcol
from quarry.models.tables import TableState
from quarry.operators.quantiles import BROADCAST_BYTES
from quarry.session import materialize, scratch_path

#: Blocks that one task pools after the first round.
RUN = 1 << 20
#: Blocks of one stretch of a model too large to be broadcast.
STRETCH = 128

_BLOCKS = "run long, pos long, lo double, hi double, w double, s double"


def _pool(batches):
    """Pool adjacent violators of every run, from rows (run, lo, hi, w, s) in order."""
    def emit(run, stack):
        lo, hi, w, s = (np.array(v, float) for v in zip(*stack, strict=True))
        return pd.DataFrame({"run": run, "pos": np.arange(len(stack)), "lo": lo, "hi": hi, "w": w, "s": s})

    here, stack = None, []
    for pdf in batches:
        for run, lo, hi, w, s in zip(*(pdf[c].tolist() for c in ("run", "lo", "hi", "w", "s")), strict=True):
            if run != here:
                if stack:
                    yield emit(here, stack)
                here, stack = run, []
            while stack and stack[-1][3] * w > s * stack[-1][2]:  # the mean before is larger
                first = stack.pop()
                lo, w, s = first[0], first[2] + w, first[3] + s
            stack.append((lo, hi, w, s))
    if stack:
        yield emit(here, stack)


def blocks(df: DataFrame, x: Column, y: Column, run_size: int | None = None) -> DataFrame:
    """The solution's blocks as a stored table (run, pos, lo, hi, w, s): on [lo, hi] the fit is s / w. Rows with a
    missing x or y take no part; rows of one x count as their mean. No rows give no blocks."""
    spark, run_size = df.sparkSession, run_size or RUN
    order = ["run", "lo"]
    sums = (df.select(x.cast("double").alias("lo"), y.cast("double").alias("y")).where("lo is not null and not isnan(lo) and y is not null and not isnan(y)")
            .groupBy("lo").agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("s")))
    dealt = sums.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "lo").sortWithinPartitions("lo")
    cut = dealt.select(F.spark_partition_id().cast("long").alias("run"), "lo", F.col("lo").alias("hi"), "w", "s")
    table = materialize(cut.mapInPandas(_pool, _BLOCKS), "isotonic")
    turn = 0
    while True:
        mean = F.col("s") / F.col("w")
        ends = table.groupBy("run").agg(F.count("*").alias("n"), F.min_by(mean, "pos").alias("first"), F.max_by(mean, "pos").alias("last"),
                                        F.min("lo").alias("lo")).orderBy("lo").collect()
        if all(a["last"] <= b["first"] for a, b in zip(ends, ends[1:], strict=False)):
            return table
        # cut anew: runs of equal size over the blocks' places in the whole, begun elsewhere in each round
        before = np.cumsum([0, *(r["n"] for r in ends)]).tolist()
        offsets = spark.createDataFrame([(r["run"], b) for r, b in zip(ends, before, strict=False)], "run long, before long")
        shift = int(turn * 0.618 * run_size) % run_size
        placed = table.join(F.broadcast(offsets), "run").withColumn("run", F.floor((F.col("before") + F.col("pos") + shift) / run_size).cast("long"))
        n = -(-(before[-1] + shift) // run_size)
        cut = placed.repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))), "run").sortWithinPartitions(*order)
        table = materialize(cut.select("run", "lo", "hi", "w", "s").mapInPandas(_pool, _BLOCKS), "isotonic")
        turn += 1


class _IsotonicParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    steps = Param(Params._dummy(), "steps", "rows of the table", typeConverter=TypeConverters.toInt)


class IsotonicModel(Model, _IsotonicParams, TableState):
    """prediction = the step at the first feature. The steps are broadcast while they fit BROADCAST_BYTES; beyond,
    every STRETCH-th is, and the rows are joined with the steps of their stretch."""

    TABLE = "at bigint, lo double, hi double, value double"

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", tablePath="", steps=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, out = df.sparkSession, self.getOrDefault(self.predictionCol)
        x = vector_to_array(qcol(self.getOrDefault(self.featuresCol)))[0]
        kept = [qcol(c) for c in df.columns if c != out]
        steps = self.table(spark)
        if not self.getOrDefault(self.steps):
            return df.select(*kept, F.lit(None).cast("double").alias(out))
        if self.getOrDefault(self.steps) * 24 <= BROADCAST_BYTES:
            t = steps.orderBy("at").toPandas()
            # knots in order: a block's ends, or its only point
            knots = np.stack([t["lo"], t["hi"]], 1).ravel()
            held = spark.sparkContext.broadcast((knots, np.repeat(t["value"].to_numpy(), 2)))

            @F.pandas_udf("double")
            def at(v: pd.Series) -> pd.Series:
                return pd.Series(np.where(v.isna(), np.nan, np.interp(v.astype(float), *held.value)), index=v.index)

            return df.select(*kept, F.nanvl(at(x), F.lit(None).cast("double")).alias(out))
        index = spark.sparkContext.broadcast(steps.where(F.col("at") % STRETCH == 0).orderBy("at").select("lo").toPandas()["lo"].to_numpy())

        @F.pandas_udf("bigint")
        def stretch(v: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(index.value, v.astype(float), "right") - 1, 0), index=v.index)

        # every step with the one after it; the first and last reach to the ends
        after = [F.lead(c).over(_neighbours()) for c in ("lo", "value")]
        t = steps.withColumn("quarry_stretch", F.floor(F.col("at") / STRETCH).cast("bigint"))
        edge = t.select((F.col("quarry_stretch") - 1).alias("quarry_stretch"), "at", "lo", "hi", "value").where(F.col("at") % STRETCH == 0).where("at > 0")
        t = t.unionByName(edge).select("quarry_stretch", "at", "lo", "hi", "value", after[0].alias("next_lo"), after[1].alias("next_value"))
        t = t.where((F.floor(F.col("at") / STRETCH) == F.col("quarry_stretch")))
        q = df.withColumn("quarry_x", x).withColumn("quarry_stretch", F.when(F.isnan("quarry_x") | F.col("quarry_x").isNull(), None).otherwise(stretch("quarry_x")))
        within = ((q["quarry_stretch"] == t["quarry_stretch"]) & ((q["quarry_x"] >= t["lo"]) | (t["at"] == 0))
                  & ((q["quarry_x"] < t["next_lo"]) | t["next_lo"].isNull()))
        share = F.greatest(F.lit(0.0), F.try_divide(q["quarry_x"] - t["hi"], t["next_lo"] - t["hi"]))
        value = F.when(t["next_lo"].isNull() | (q["quarry_x"] <= t["hi"]), t["value"]).otherwise(t["value"] + share * (t["next_value"] - t["value"]))
        return q.join(t, within, "left").select(*[q[f"`{c}`"] for c in df.columns if c != out], value.alias(out))


def _neighbours():
    from pyspark.sql import Window

    return Window.partitionBy("quarry_stretch").orderBy("at")


class IsotonicRegressor(Estimator, _IsotonicParams):
    """Least-squares fit that never decreases in the first feature."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> IsotonicModel:
        spark = df.sparkSession
        found = blocks(df, vector_to_array(qcol(self.getOrDefault(self.featuresCol)))[0], qcol(self.getOrDefault(self.labelCol)))
        ends = found.groupBy("run").agg(F.count("*").alias("n"), F.min("lo").alias("lo")).orderBy("lo").collect()
        before = np.cumsum([0, *(r["n"] for r in ends)]).tolist()
        offsets = spark.createDataFrame([(r["run"], b) for r, b in zip(ends, before, strict=False)], "run long, before long")
        path = scratch_path(spark, "steps")
        (found.join(F.broadcast(offsets), "run").select((F.col("before") + F.col("pos")).alias("at"), "lo", "hi", (F.col("s") / F.col("w")).alias("value"))
         .write.parquet(path))
        return IsotonicModel(featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
                             predictionCol=self.getOrDefault(self.predictionCol), tablePath=path, steps=before[-1])
