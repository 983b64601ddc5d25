"""Facade with the survey's proposed names for chart data."""

from quarry.operators.charts import (  # noqa: F401
    area_data,
    bar_data,
    box_stats,
    distribution,
    histogram,
    kde,
    line_data,
    pair_data,
    pie_data,
    scatter_grid,
    scatter_points,
    violin,
)
from quarry.operators.profile import correlation_matrix  # noqa: F401
