"""The hourly job: raw readings to the clean feature table."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeframe.functions import features as X
from breezeframe.functions.aqi import with_aqi
from breezeframe.operators import windows as W
from breezeframe.operators.joins import union_history
from breezeframe.operators.layout import CHUNK_HOURS, carried
from breezeframe.operators.shaping import cast_schema, drop_static, select_clean
from breezeframe.schema import (
    BASE_INTERACTIONS,
    CLEAN_FEATURES,
    CYCLIC_COLUMNS,
    EXTRA_INTERACTIONS,
    FLAG_COLUMNS,
    KEYS,
    MEASURES,
    ROW_CHANGES,
    SEQ,
    TIME,
)

RAW = "_raw_"


def _on_raw(spec):
    return spec._replace(column=RAW + spec.column)


def engineer_features(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    only: Collection[str] | None = None,
    chunk_hours: float | str = CHUNK_HOURS,
) -> DataFrame:
    """All engineered columns, or just those named in ``only``.

    Lags, range statistics, flags and products read the readings as they came. Gaps are then
    filled column by column, so a product is filled from the last product, not from filled
    factors. Products added on top of the base set keep their gaps.

    Two shuffles of whole rows by (station, time piece): one for fills and row changes, one for all
    windows.
    """
    want = None if only is None else set(only)
    keep = lambda name: want is None or name in want
    if "us_aqi" not in df.columns:
        df = with_aqi(df)
    src = X.interactions(X.powers(X.threshold_flags(X.time_flags(X.cyclic_time(drop_static(df))))), BASE_INTERACTIONS)
    raw = [c for c in MEASURES if c in src.columns]
    never_null = {*keys, TIME, SEQ, *FLAG_COLUMNS, *CYCLIC_COLUMNS}
    fill = [
        f.name
        for f in src.schema
        if f.name not in never_null and isinstance(f.dataType, T.NumericType) and (f.name in raw or keep(f.name))
    ]
    known = carried(src, fill, keys, ahead=True)
    changes = {n: c for n, c in ROW_CHANGES.items() if c in raw and keep(n)}

    def filled(c: str):
        zero = F.lit(0).cast(src.schema[c].dataType)
        return F.coalesce(F.col(c), F.col(f"_prev_{c}"), F.col(f"_next_{c}"), zero).alias(c)

    base = known.select(
        *[filled(c) if c in fill else F.col(c) for c in src.columns],
        *[F.col(c).alias(RAW + c) for c in raw],
        *[W.padded_change(c).alias(n) for n, c in changes.items()],
    )
    have = lambda spec: spec.column in raw and keep(spec.name)
    out = W.window_features(
        base,
        lags=[_on_raw(s) for s in [*W.target_lags(), *W.extra_lags()] if have(s)],
        rolls=[_on_raw(s) for s in [*W.target_rolling(), *W.extra_rolling()] if have(s)],
        changes=[_on_raw(s) for s in W.target_changes() if have(s)],
        keys=keys,
        chunk_hours=chunk_hours,
        # what lies around a bucket needs no fills
        source=src.select(*keys, TIME, SEQ, *[F.col(c).alias(RAW + c) for c in raw]),
    )
    out = X.wind_source_flags(X.wind_vector(out, f"{RAW}wind_direction"))
    pairs = {
        n: tuple(RAW + c if c in raw else c for c in ab) for n, ab in EXTRA_INTERACTIONS.items() if keep(n)
    }
    out = X.interactions(out, pairs).drop(*[RAW + c for c in raw])
    return cast_schema(out).withColumn("time_str", X.time_key())


def clean_features(df: DataFrame, keys: Sequence[str] = KEYS, history: DataFrame | None = None, **kw) -> DataFrame:
    """The clean feature list over stored history plus new readings."""
    if history is not None:
        df = union_history(history, df)
    return select_clean(engineer_features(df, keys, only=CLEAN_FEATURES, **kw), keys)
