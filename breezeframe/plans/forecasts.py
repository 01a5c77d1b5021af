"""Forecast collection, training frames, cleaning and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeframe.functions.features import cyclic_time, time_key, wind_vector
from breezeframe.operators.frames import chrono_split, targets_long
from breezeframe.operators.joins import align_offset_join, distinct_rows
from breezeframe.operators.scaling import apply_scaler, fit_scaler, inverse_scaler
from breezeframe.operators.shaping import drop_nulls, iqr_filter_seq, keep_positive
from breezeframe.operators.windows import fill_gaps
from breezeframe.schema import CYCLIC_COLUMNS, IQR_COLUMNS, KEYS, SCALE_GROUPS, SEQ, TARGETS, TIME
from breezeframe.session import materialise
from breezeframe.sources.payloads import flatten_forecast, flatten_pollution_forecast

FORECAST_COLUMNS = [
    "temperature", "humidity", "pressure", "wind_speed", "wind_direction_sin", "wind_direction_cos",
    *CYCLIC_COLUMNS, "carbon_monoxide", "ozone", "sulphur_dioxide", "nh3",
]


def forecast_features(weather: DataFrame, pollution: DataFrame, keys: Sequence[str] = KEYS, hours: int = 72) -> DataFrame:
    """Decoder columns per step: aligned forecasts, forecast calendar, wind vector, hour key."""
    merged = align_offset_join(weather, pollution, keys, hours=hours)
    merged = cyclic_time(wind_vector(merged), "target_time", mode="forecast")
    cols = [c for c in FORECAST_COLUMNS if c in merged.columns]
    return merged.select(*keys, "step_hour", "target_time", *cols).withColumn("time_str", time_key("target_time"))


def collect_forecast(weather_docs: DataFrame, pollution_docs: DataFrame, **kw) -> DataFrame:
    """From payload documents to the forecast table."""
    return forecast_features(flatten_forecast(weather_docs), flatten_pollution_forecast(pollution_docs), **kw)


def clean_series(df: DataFrame, mode: str = "a", keys: Sequence[str] = KEYS) -> DataFrame:
    """Training cleanup. ``a``: dedupe, fill, drop nulls, positive PM, IQR. ``b``: the same
    without filling. ``c``: dedupe, fill, IQR.

    Rows are written out once before the quartile passes re-read them.
    """
    if mode not in ("a", "b", "c"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = distinct_rows(df)
    if mode in ("a", "c"):
        measures = [c for c in rows.columns if c not in {*keys, TIME, SEQ}]
        rows = fill_gaps(rows, measures, keys, default=None)
    if mode in ("a", "b"):
        rows = keep_positive(drop_nulls(rows), [c for c in TARGETS if c in rows.columns])
    return iqr_filter_seq(materialise(rows, "clean"), [c for c in IQR_COLUMNS if c in rows.columns], keys=keys)


def training_frame(df: DataFrame, horizons: Sequence[int], test: float = 0.2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scaled delta targets per base row, horizon and target, with a chronological train flag.

    The scaler is fitted on each station's training rows only.
    """
    flagged = chrono_split(df, test, keys=keys)
    params = materialise(fit_scaler(flagged, {"pm": list(TARGETS)}, "is_train", keys), "scaler")
    long = targets_long(flagged, TARGETS, horizons, keys, carry=["is_train"])
    scale = params.select(*keys, F.col("feature").alias("target"), "mean", "scale")
    scaled = long.join(scale, [*keys, "target"]).withColumns({
        "y_scaled": (F.col("y") - F.col("mean")) / F.col("scale"),
        "base_scaled": (F.col("y_base") - F.col("mean")) / F.col("scale"),
    })
    return scaled.select(
        *keys, TIME, "h", "target", "is_train", "y", "y_scaled", "base_scaled",
        (F.col("y_scaled") - F.col("base_scaled")).alias("y_delta"),
    )


def undo_predictions(pred: DataFrame, params: DataFrame, keys: Sequence[str] = KEYS, cols: Sequence[str] = TARGETS) -> DataFrame:
    """Model output (delta on scaled values, per step) back to concentrations."""
    restored = pred.withColumns({c: F.col(c) + F.col(f"{c}_scaled_0") for c in cols})
    return inverse_scaler(restored, params, cols, keys)


def scaled_forecast(forecasts: DataFrame, params: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Forecast with ``<x>_scaled`` for the weather and pollutant columns; any fitted superset serves."""
    cols = [*SCALE_GROUPS["weather"], *SCALE_GROUPS["pollutant"]]
    return apply_scaler(forecasts, params, cols, keys)
