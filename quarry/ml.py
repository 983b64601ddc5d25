"""Facade with the survey's proposed names for modelling."""

from quarry.models.metrics import evaluate, overfit_flags  # noqa: F401
from quarry.models.pipeline import FittedModel, fit, importances, make_regressor  # noqa: F401
from quarry.models.prep import poly_expand, prepare, split  # noqa: F401
from quarry.models.registry import ModelRegistry  # noqa: F401
from quarry.models.scoring import decode_prediction, fit_defaults, score  # noqa: F401
from quarry.models.selection import auto_select, cross_validate, cv_summary, grid_search  # noqa: F401
from quarry.models.train import report_tables, train  # noqa: F401
from quarry.streaming.score import score_stream  # noqa: F401
