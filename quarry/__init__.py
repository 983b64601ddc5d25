"""quarry — tabular preparation, profiling, chart aggregates and regression on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function (fitted operators also
return their statistics as a DataFrame), so they chain with ``df.transform``.
Statistics are computed on the executors with partial aggregation; the driver only
ever sees bounded summaries (one row per column / group / bucket).
"""

from quarry.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
