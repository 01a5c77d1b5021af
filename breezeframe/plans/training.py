"""Training and evaluation end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.operators.evaluate import horizon_metrics, merge_metrics, overfit_gap
from breezeframe.operators.frames import chrono_split, targets
from breezeframe.operators.models import fit_trees, left_out, predict_trees
from breezeframe.schema import KEYS, TARGETS, TIME
from breezeframe.session import materialise


def supervised(
    df: DataFrame, features: Sequence[str], horizons: Sequence[int], cols: Sequence[str] = TARGETS, test: float = 0.2,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows with all features, future targets and a chronological train flag per key."""
    whole = df.select(*dict.fromkeys([*keys, TIME, "seq", *features, *cols])).na.drop(subset=list(features))
    return chrono_split(targets(whole, cols, horizons, keys), test, keys=keys)


def train_and_evaluate(
    df: DataFrame, features: Sequence[str], horizons: Sequence[int], cols: Sequence[str] = TARGETS, test: float = 0.2,
    keys: Sequence[str] = KEYS, limit: float = 0.1, **params,
) -> tuple[Mapping[tuple[str, int], object], DataFrame]:
    """Models fitted on the earlier rows only, and one row per key, horizon and target with the
    metrics on both parts, the gap between them, and how many of the key's rows lack a feature and
    were left out. Runs the fitting jobs when called."""
    rows = materialise(supervised(df, features, horizons, cols, test, keys), "supervised")
    models = fit_trees(rows.where("is_train"), features, horizons, cols, **params)
    by = [*keys, "h", "target"]
    pred = predict_trees(models, rows, features, [*keys, TIME, "is_train"]).where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    metrics = horizon_metrics(pred, [*by, "is_train"])
    train, held = (metrics.where(F.col("is_train") == flag).drop("is_train") for flag in (True, False))
    gap = overfit_gap(train, held, by, limit)
    shown = [held.select(*by, *[F.col(c).alias(f"test_{c}") for c in ("rmse", "mae", "n")]),
             train.select(*by, *[F.col(c).alias(f"train_{c}") for c in ("rmse", "mae", "n")])]
    for part in shown:
        gap = gap.join(part, by)
    lacking = left_out(df, features, keys).select(*keys, F.col("incomplete").alias("n_left_out"))
    return models, gap.join(lacking, list(keys))


def banded(short: DataFrame, long: DataFrame, cut: int = 12) -> DataFrame:
    """One table of two trainings: up to ``cut`` hours the short model's, beyond it the long's."""
    return merge_metrics(short, long, cut)
