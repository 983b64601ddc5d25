"""Training-data preparation: split (M1), polynomial terms (M2), feature/target prep."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import classify, hash_bucket, qcol
from quarry.operators.clean import apply_fill, drop_rows_with_missing, training_clean, training_fills


def split(df: DataFrame, key_cols: Sequence[str], test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: deterministic train/test split by a hash of the row key (first 32 bits of md5 mod 100,
    salted with the seed unless seed == 42, the reference default). Reproducible across engines
    and re-executions (survives executor loss), no shuffle."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    cols = list(key_cols) if seed == 42 else [F.lit(str(seed))] + list(key_cols)
    b = hash_bucket(*cols, buckets=100)
    cut = int(round(test_size * 100))
    return df.filter(b >= cut), df.filter(b < cut)


def fold_column(key_cols: Sequence[str], folds: int = 5, name: str = "fold") -> Column:
    """A fold id in [0, folds) from the row-key hash (used by CV, M17)."""
    return (hash_bucket(*key_cols, buckets=1_000_003) % F.lit(folds)).cast("int").alias(name)


def poly_terms(names: Sequence[str], degree: int) -> list[tuple[str, tuple[int, ...]]]:
    """M2: sklearn PolynomialFeatures(degree, include_bias=False) terms, in its order:
    degree 1 first, then each degree's combinations with replacement (lexicographic)."""
    out = []
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(range(len(names)), d):
            counts = {}
            for i in combo:
                counts[i] = counts.get(i, 0) + 1
            label = " ".join(names[i] if k == 1 else f"{names[i]}^{k}" for i, k in sorted(counts.items()))
            out.append((label, combo))
    return out


def poly_expand(df: DataFrame, cols: Sequence[str], degree: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """M2 as plain columns: every monomial up to ``degree`` named like sklearn's
    get_feature_names_out (``a``, ``a^2``, ``a b``). Narrow, JVM-side products."""
    if not 1 <= degree <= 4:
        raise ValueError("degree must be between 1 and 4")
    exprs = []
    for label, combo in poly_terms(list(cols), degree):
        e = None
        for i in combo:
            c = qcol(cols[i]).cast("double")
            e = c if e is None else e * c
        exprs.append(e.alias(label))
    return df.select(*[qcol(k) for k in keep], *exprs)


def poly_sql(cols: Sequence[str], degree: int) -> tuple[list[str], str]:
    """(term names, SQL select list) for a SQLTransformer stage in a persisted pipeline."""
    parts, names = [], []
    for label, combo in poly_terms(list(cols), degree):
        safe = "quarry_p" + "_".join(str(i) for i in combo)
        parts.append(" * ".join("CAST(`" + cols[i].replace("`", "``") + "` AS DOUBLE)" for i in combo) + f" AS `{safe}`")
        names.append((label, safe))
    return names, ", ".join(parts)


def prepare(df: DataFrame, features: Sequence[str], target: str, impute_target: bool = False,
            remove_duplicates: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """M27 (``keys``: more columns to carry along, which take no part in the fills; of rows that are duplicates
    in features and target the one with the smallest keys stays): F2 select → (drop rows with a missing target) → I10 impute (median / mode) + R1 →
    F6 on the target. ``impute_target=True`` reproduces the reference, which median-fills the
    target before its drop (so no row is dropped)."""
    features = list(features)
    if target in features:
        raise ValueError("the target must not be a feature")
    if not features:
        raise ValueError("select at least one feature")
    extra = [k for k in dict.fromkeys(keys) if k not in features and k != target]
    d = df.select(*[qcol(c) for c in features], qcol(target), *[qcol(k) for k in extra])
    if not impute_target:
        d = drop_rows_with_missing(d, [target])
    if extra:
        filled = apply_fill(d, training_fills(d.select(*[qcol(c) for c in [*features, target]])))
        if remove_duplicates:
            least = F.min(F.struct(*[qcol(k).alias(f"k{i}") for i, k in enumerate(extra)])).alias("_least_keys")
            filled = filled.groupBy(*[qcol(c) for c in [*features, target]]).agg(least).select(
                *[qcol(c) for c in [*features, target]], *[F.col(f"_least_keys.k{i}").alias(k) for i, k in enumerate(extra)])
        return drop_rows_with_missing(filled, [target])
    d = training_clean(d, "median", "mode", remove_duplicates)
    return drop_rows_with_missing(d, [target])
