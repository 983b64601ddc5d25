"""Facade with the survey's proposed names for cleaning, encoding, transforms and profiling."""

from quarry.operators.clean import (  # noqa: F401
    drop_all_null_columns,
    drop_columns,
    drop_columns_by_null_share,
    drop_duplicates,
    drop_rows_with_missing,
    duplicate_count,
    gui_clean_missing,
    handle_missing,
    head,
    impute,
    scoring_fill,
    select_features,
    sort_stable,
    training_clean,
)
from quarry.operators.encode import apply_dictionary, decode, encode, label_encode, one_hot  # noqa: F401
from quarry.operators.outliers import flag_outliers, treat_outliers  # noqa: F401
from quarry.operators.profile import correlation_matrix, null_share, profile, value_counts  # noqa: F401
from quarry.operators.transform import deskew, scale  # noqa: F401
from quarry.operators.workspace import Workspace  # noqa: F401
