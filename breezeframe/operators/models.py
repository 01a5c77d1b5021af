"""Tree forecasts with Spark ML, rollout, scoring frame and forecast report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeframe.functions.aqi import aqi_clamped
from breezeframe.functions.features import TAU, base_from_template
from breezeframe.operators.joins import _ranked
from breezeframe.operators.shaping import band_merge
from breezeframe.schema import KEYS, TARGETS
from breezeframe.session import materialise

FEATURES = "_features"


def complete(features: Sequence[str]) -> Column:
    """Whether a row has all features: neither null nor NaN."""
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return out


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature vector column; a missing feature is NaN there."""
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep").transform(df)


def left_out(df: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key the rows that fitting cannot use, and per feature how many lack it."""
    lacks = [F.count(F.when(~complete([f]), 1)).alias(f"no_{f}") for f in features]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(~complete(features), 1)).alias("incomplete"), *lacks
    )


def _regressor(kind: str, label: str, prediction: str, **params):
    make = {"forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    return make(featuresCol=FEATURES, labelCol=label, predictionCol=prediction, **params)


def fit_trees(
    df: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    targets: Sequence[str] = TARGETS,
    kind: str = "forest",
    **params,
) -> dict[tuple[str, int], object]:
    """One regressor per target and horizon on ``<target>_target_<h>h`` columns.

    Rows with a missing feature are not fitted on; :func:`left_out` counts them. The assembled
    rows are written out once, then each fit reads them.
    """
    labels = {(t, h): f"{t}_target_{h}h" for t in targets for h in horizons}
    rows = assemble(df.where(complete(features)), features).select(FEATURES, *labels.values())
    rows = materialise(rows, "training-rows")
    return {
        key: _regressor(kind, label, f"pred_{label}", **params).fit(rows.filter(F.col(label).isNotNull()))
        for key, label in labels.items()
    }


def predict_trees(models: Mapping[tuple[str, int], object], df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long predictions ``(keep, h, target, y_true, y_pred)`` of all fitted models: one row for each
    input row and model. The prediction is null where a feature is missing."""
    out = assemble(df.withColumn("_complete", complete(features)), features)
    for m in models.values():
        out = m.transform(out)
    cells = F.array(*[
        F.struct(
            F.lit(h).alias("h"), F.lit(t).alias("target"),
            F.col(f"{t}_target_{h}h").alias("y_true"),
            F.when(F.col("_complete"), F.col(f"pred_{t}_target_{h}h")).alias("y_pred"),
        )
        for t, h in models
    ])
    return out.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def importance(models: Mapping[tuple[str, int], object], features: Sequence[str], spark) -> DataFrame:
    """``(target, h, feature, importance)``: one row per model and feature."""
    rows = [
        (t, h, f, float(v))
        for (t, h), m in models.items()
        for f, v in zip(features, m.featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "target string, h int, feature string, importance double")


def top_importance(imp: DataFrame, k: int = 15, by: Sequence[str] = ("target",), combined: int = 10) -> DataFrame:
    """Best ``k`` features per group and best ``combined`` of the mean over groups."""
    w = [F.col("importance").desc(), F.col("feature")]
    each = _ranked(imp.groupBy(*by, "feature").agg(F.avg("importance").alias("importance")), k, by, w)
    rest = [b for b in by if b != "target"]
    mean = imp.groupBy(*rest, "feature").agg(F.avg("importance").alias("importance")).withColumn("target", F.lit("combined"))
    return each.unionByName(_ranked(mean, combined, [*rest, "target"], w))


def rollout(
    models: Mapping[str, object],
    df: DataFrame,
    features: Sequence[str],
    steps: int,
    keep: Sequence[str],
    exog: Sequence[str] = (),
    to_lag: Mapping[str, Callable[[Column], Column]] | None = None,
    checkpoint_every: int = 6,
) -> DataFrame:
    """Apply one-step models again and again, feeding each prediction back as the newest lag.

    ``features`` holds ``<target>_lag_{1,2,3}h`` and ``<x>_target_1h`` for each exogenous x;
    at step h the latter are swapped for ``<x>_target_<h>h``. All base rows advance together:
    one distributed transform per step, written out every few steps to cut the lineage.
    """
    to_lag = to_lag or {}
    lags = [f"{t}_lag_{k}h" for t in models for k in (1, 2, 3)]
    now = [f"{x}_target_1h" for x in exog]
    state = df.select(
        *keep,
        *[f for f in features if f not in now],
        *[F.col(f"{x}_target_{h}h") for x in exog for h in range(1, steps + 1)],
    )
    fixed = state.columns
    done: list[str] = []
    for h in range(1, steps + 1):
        swapped = state.select(*[c for c in state.columns if c not in now or h == 1], *[
            F.col(f"{x}_target_{h}h").alias(f"{x}_target_now") for x in exog
        ])
        names = [f"{f.removesuffix('_target_1h')}_target_now" if f in now else f for f in features]
        step = VectorAssembler(inputCols=names, outputCol=FEATURES, handleInvalid="keep").transform(swapped)
        for t, m in models.items():
            step = m.copy({m.predictionCol: f"{t}_hat_{h}"}).transform(step)
            done.append(f"{t}_hat_{h}")

        def moved(t: str, k: int, h=h) -> Column:
            if k > 1:
                return F.col(f"{t}_lag_{k - 1}h").alias(f"{t}_lag_{k}h")
            return to_lag.get(t, lambda c: c)(F.col(f"{t}_hat_{h}")).alias(f"{t}_lag_1h")

        others = [c for c in fixed if c not in lags]
        if h > 1:
            others = [c for c in others if c in step.columns]
        state = step.select(*others, *done, *[moved(t, k) for t in models for k in (1, 2, 3)])
        if h % checkpoint_every == 0 and h < steps:
            state = materialise(state, "rollout")
    cells = F.array(*[
        F.struct(F.lit(h).alias("h"), F.lit(t).alias("target"), F.col(f"{t}_hat_{h}").alias("y_pred"))
        for h in range(1, steps + 1)
        for t in models
    ])
    return state.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.*")


def scoring_frame(
    forecasts: DataFrame,
    last: DataFrame,
    templates: Sequence[str],
    steps: int,
    keys: Sequence[str] = KEYS,
    step: str = "step_hour",
    pm0: Sequence[str] = ("pm2_5_scaled", "pm10_scaled"),
) -> DataFrame:
    """Decoder input per step: exogenous values in template order, step on the circle, last PM.

    ``last`` has one row per key.
    """
    names = [base_from_template(t) for t in templates]
    missing = [n for n in names if n not in forecasts.columns]
    if missing:
        raise ValueError(f"missing decoder features: {', '.join(missing)}")
    angle = F.lit(TAU) * F.col(step) / F.lit(float(steps))
    aux = forecasts.filter(F.col(step) <= steps).select(
        *keys, step, *names, F.sin(angle).alias("pos_sin"), F.cos(angle).alias("pos_cos")
    )
    return aux.join(last.select(*keys, *[F.col(c).alias(f"{c}_0") for c in pm0]), list(keys))


def forecast_report(short: DataFrame, mid: DataFrame, cut: int = 12, prefer: str = "short") -> DataFrame:
    """Banded PM forecast with its indices; inputs hold ``pm2_5`` and ``pm10`` per step ``h``."""
    merged = band_merge(short, mid, cut, prefer=prefer)
    pm25, pm10 = aqi_clamped(F.col("pm2_5"), "pm2_5"), aqi_clamped(F.col("pm10"), "pm10")
    return merged.withColumns({"aqi_pm2_5": pm25, "aqi_pm10": pm10}).withColumn(
        "aqi", F.greatest("aqi_pm2_5", "aqi_pm10")
    )
